"""License scans by ordered signature rules.

A text is read as words of lower-case letters and digits, and of characters beyond ASCII, with one space between. Each signature
rule is a pattern over such words. Its keywords decide whether it is tried: a text's words are looked up in one table of all
keywords, so most texts meet none and cost no more than that. What the patterns find is resolved by priority and then by length: a detection that lies
within a kept one of the same or a higher priority goes. The base phrases are rules as well, whose places stay whatever lies over
them.

A text is read in its own row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused
from .license_rules import RULES as RULE_TEXT

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: How sure a detection of a priority is that its license applies to the text.
SURE = {1: 0.3, 2: 0.5, 3: 0.7, 4: 0.85, 5: 0.95}
BASE_PRIORITY = 2
_PARTS = {"v} ": "(?: (?:version|v|ver|release))? v?", "l}": "licen[cs]e", "any}": "(?: [^ ]+){0,3}"}
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
DETECTION = "struct<start:long,end:long,label:string,priority:int,base:boolean>"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str
    base: bool = False

    def compiled(self) -> re.Pattern:
        """The pattern over bytes: the space before a match belongs to it, the one after it does not."""
        return re.compile(b" (?:" + self.pattern.encode() + b")(?= )")


def read_rules(text: str = RULE_TEXT) -> tuple[Rule, ...]:
    """Rules from lines of label | priority | keywords | pattern, after the base phrases."""
    rules = [Rule(label, BASE_PRIORITY, (phrase.split()[0],), re.escape(phrase).replace("\\ ", " "), True) for phrase, label in BASE]
    for line in text.strip().splitlines():
        label, priority, keywords, pattern = (part.strip() for part in line.split(" | ", 3))
        for name, part in _PARTS.items():
            pattern = pattern.replace("{" + name, part)
        rules.append(Rule(label, int(priority), tuple(keywords.split()), pattern))
    return tuple(rules)


RULES = read_rules()


def kept(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of spans (start, end, priority, order) those that lie within no other of a higher priority, nor of the same one if it is longer or
    comes first in the order of rules; sorted by start. Only kept spans count against others."""
    starts: list[int] = []
    reach: list[int] = []  # the farthest end of the spans of higher priorities that start here or before
    out: list[tuple[int, int, int, int]] = []
    for priority in sorted({s[2] for s in spans}, reverse=True):
        far, fresh = -1, []
        for s in sorted((s for s in spans if s[2] == priority), key=lambda s: (s[0], -s[1], s[3])):
            at = bisect_right(starts, s[0])
            if s[1] > far and (not at or reach[at - 1] < s[1]):
                fresh.append(s)
                far = s[1]
        out += fresh
        starts, reach, far = [], [], -1
        for s in sorted(out):
            far = max(far, s[1])
            starts.append(s[0])
            reach.append(far)
    return sorted(out)


class Scanner:
    """Rules compiled, with a table from each keyword to the rules that it opens."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [r.compiled() for r in rules]
        self.opens: dict[bytes, list[int]] = {}
        for n, rule in enumerate(rules):
            for k in rule.keywords:
                self.opens.setdefault(k.encode(), []).append(n)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str, int, bool]]]:
        """The number of words of a text, and its detections (first word, word after the last, label, priority, base) by place."""
        words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
        tried = sorted({n for k in self.opens.keys() & set(words) for n in self.opens[k]})
        if not tried:
            return len(words), []
        n_words, line = len(words), b" " + b" ".join(words) + b" "
        del words
        base, spans = [], []
        for n in tried:
            rule = self.rules[n]
            (base if rule.base else spans).extend((m.start(), m.end(), rule.priority, n) for m in self.compiled[n].finditer(line))
        found, word, at = [], 0, 0
        for start, end, priority, n in sorted(base + kept(spans)):
            word, at = word + line.count(b" ", at, start), start
            found.append((word, word + line.count(b" ", start, end), self.rules[n].label, priority, self.rules[n].base))
        return n_words, found


def score(found: list[tuple[int, int, str, int, bool]]) -> float:
    """From 0 to 1: how sure it is that some license or reservation is meant, each label counting once, at its surest."""
    sure: dict[str, float] = {}
    for _, _, label, priority, _ in found:
        sure[label] = max(sure.get(label, 0.0), SURE[priority])
    doubt = 1.0
    for label in sorted(sure):
        doubt *= 1 - sure[label]
    return 1 - doubt


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, detections, score) of every row of docs; detections are structs of start and end (words from 0, end exclusive), label,
    priority and base, by place. The id column keeps its name and type.

    Null and empty texts have no words and score 0. Repeated rows and rows without an id are read like any other, texts as a whole
    whatever their length; other columns are left out, whatever their names. An empty table gives an empty one.
    """
    key = unused(docs.select(text_col), "id")
    kind = docs.schema[id_col].dataType.simpleString()
    detections = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        names = ("start", "end", "label", "priority", "base")
        for b in batches:
            read = [scanner.scan(t or "") for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([n for n, _ in read], pa.int64()), pa.array([[dict(zip(names, d, strict=True)) for d in found] for _, found in read], detections), pa.array([score(found) for _, found in read], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "detections", "score"])

    rows = docs.select(F.col(id_col).alias(key), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_words long, detections array<{DETECTION}>, score double").withColumnRenamed(key, id_col)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])
    labels = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda d: d["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"), "score"
    )
