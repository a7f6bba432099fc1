"""The license scan against a plain scan, and its rules one by one."""

import random
import re
import re._constants as sre
import re._parser as parser

import pytest
from pyspark.sql import functions as F

from talewright.llm import licenses as li

TEXTS = {
    "Released under the MIT License.": {"mit"},
    "SPDX-License-Identifier: GPL-3.0-or-later": {"gpl-3.0"},
    "Licensed under the Apache License, Version 2.0": {"apache-2.0"},
    "This file is part of X; see the GNU Lesser General Public License v2.1": {"lgpl-2.1", "gpl"},
    "Photos: CC-BY-SA 4.0, texts: CC BY.": {"cc-by-sa-4.0", "cc-by"},
    "Copyright (c) 2019 Some Body. ALL RIGHTS RESERVED": {"copyright", "reserved"},
    "Redistribution and use in source and binary forms, with or without modification, are permitted": {"bsd"},
    "https://creativecommons.org/licenses/by-nc/4.0/": {"cc-by-nc-4.0"},
    "The quick brown fox has no license to jump, she admits.": set(),
    "Eclipse over the boost of the common apache.": set(),
}


def found(text, rules=li.RULES):
    return li.Scanner(rules).scan(text)[1]


@pytest.mark.parametrize("text", TEXTS)
def test_labels_of_texts(text):
    assert {d[2] for d in found(text)} == TEXTS[text]


def sample(items, rng):
    """A text that a parsed pattern matches."""
    out = ""
    for op, arg in items:
        if op is sre.LITERAL:
            out += chr(arg)
        elif op is sre.NOT_LITERAL:
            out += rng.choice("xyz")
        elif op is sre.IN:
            kind, what = rng.choice(arg)
            out += "xyz"[rng.randrange(3)] if kind is sre.NEGATE or arg[0][0] is sre.NEGATE else chr(what if kind is sre.LITERAL else rng.randint(*what))
        elif op is sre.SUBPATTERN:
            out += sample(arg[3], rng)
        elif op is sre.BRANCH:
            out += sample(rng.choice(arg[1]), rng)
        elif op is sre.MAX_REPEAT:
            least, most, inner = arg
            out += "".join(sample(inner, rng) for _ in range(rng.randint(least, min(most, least + 2))))
        else:
            raise ValueError(op)
    return out


def test_every_match_holds_a_keyword():
    """What a rule's pattern matches has one of the rule's keywords among its words, so the keywords never hide a match."""
    rng = random.Random(9)
    for rule in li.RULES:
        assert rule.keywords and rule.priority in li.SURE, rule
        for _ in range(12):
            text = sample(parser.parse(rule.pattern), rng)
            assert re.fullmatch(rule.pattern, text) and set(rule.keywords) & set(text.split()), (rule, text)
    assert len(li.RULES) > 200


def plain(text, rules=li.RULES):
    """Every rule tried on the text, every pair of spans compared."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    line = " " + " ".join(words) + " "
    spans = [(m.start(), m.end(), r.priority, n) for n, r in enumerate(rules) for m in re.finditer(" (?:" + r.pattern + ")(?= )", line)]
    beats = lambda a, b: (a[2], a[1] - a[0], -a[3]) > (b[2], b[1] - b[0], -b[3])
    free = [s for s in spans if not rules[s[3]].base]
    alive = []
    for s in sorted(free, key=lambda s: (-s[2], -(s[1] - s[0]), s[3])):
        if not any(k[0] <= s[0] and s[1] <= k[1] and beats(k, s) for k in alive):
            alive.append(s)
    spans = sorted([s for s in spans if rules[s[3]].base] + alive)
    word = lambda at: line[:at].count(" ")
    return len(words), [(word(a), word(b), rules[n].label, p, rules[n].base) for a, b, p, n in spans]


def noise(rng, n):
    bits = list(TEXTS) + ["license", "cc by", "cc-by-nc", "4.0", "general public license version 3", "Général public licence", "all rights  reserved", "the", "gpl", "v2", "a\x00b", "日本", "no rights reserved"]
    return " ".join(rng.choice(bits) for _ in range(n))


def test_scan_equals_plain_scan():
    rng = random.Random(4)
    for _ in range(60):
        text = noise(rng, rng.randint(0, 40))
        assert li.Scanner(li.RULES).scan(text) == plain(text)


def test_kept_spans_of_nested_and_equal_spans():
    spans = [(0, 10, 2, 1), (2, 5, 4, 2), (2, 5, 4, 3), (3, 5, 4, 4), (0, 4, 1, 5), (9, 12, 1, 6), (2, 5, 3, 7), (0, 10, 2, 8)]
    assert li.kept(spans) == [(0, 10, 2, 1), (2, 5, 4, 2), (9, 12, 1, 6)]


def test_op12_on_odd_documents(spark, odd_documents, no_documents):
    rows = li.scan(odd_documents).collect()
    want = sorted(((r.doc_id, *plain(r.text)) for r in odd_documents.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_words, [tuple(d) for d in r.detections]) for r in rows), key=repr) == want
    assert li.scan(no_documents).count() == 0
    named = odd_documents.select(F.col("doc_id").alias("n_words"), "text", F.col("score").alias("detections"))
    assert li.scan(named.select(F.col("n_words").alias("key"), "text"), id_col="key").count() == 10


def test_op12_query_equals_plain_scan(spark, sf_dir):
    from talewright.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op12_licenses"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, spans = plain(docs[r.doc_id])
        base = [s for s in spans if s[4]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min((s[0] for s in base), default=None), max((s[0] for s in base), default=None))
        assert r.base_labels == ",".join(sorted({s[2] for s in base})) and r.labels == ",".join(sorted({s[2] for s in spans}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(spans)


def test_many_detections_take_linear_time():
    n, spans = li.Scanner(li.RULES).scan("mit license, all rights reserved. " * 100_000)
    assert n == 500_000 and len(spans) == 200_000
