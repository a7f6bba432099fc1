"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regex is turned into a Boolean query of the trigrams that any match must hold (an OR of ANDs). The index holds
a posting (trigram, document) for every trigram that some query asks for. The postings of each AND are intersected per
document; only documents that are left are searched with the rule's regex. A rule without a mandatory trigram (a run of
hexadecimal digits) searches every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table, unused

try:
    import re._constants as sre
    import re._parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The base kinds and their patterns. A run of 24 or more is the same as a maximal run that is dropped below 24.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds beside the base: openings of private keys, and tokens of well-known forms.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
#: Values of a lot of a running fold.
LOT = 32
#: Characters of a slice that pieces of a text are taken from.
SLICE = 4096
#: Candidates that are broadcast at most: an id and some of the rules' kinds each, so 100 MB at most.
CANDIDATES = 500_000
#: More alternatives than this are not spelt out; the text around them still counts.
MAX_ALTERNATIVES = 64


def _literals(items) -> list[list[str]]:
    """The alternatives of a parsed regex, each as runs of literal text; '\\0' marks where anything may stand."""
    out = [""]
    for op, arg in items:
        if op is sre.LITERAL:
            part = [chr(arg)]
        elif op is sre.IN and len(arg) <= 5 and all(o is sre.LITERAL for o, _ in arg):
            part = [chr(c) for _, c in arg]
        elif op is sre.SUBPATTERN:
            part = _literals(arg[3])
        elif op is sre.BRANCH:
            part = [x for branch in arg[1] for x in _literals(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            once = _literals(inner)
            part = ["", *once] if (least, most) == (0, 1) else [f"{x}\0{x}" for x in once] if least else ["\0"]
        elif op is sre.AT:
            part = [""]
        else:
            part = ["\0"]
        out = [a + b for a in out for b in part] if len(out) * len(part) <= MAX_ALTERNATIVES else [a + "\0" for a in out]
    return out


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """The trigrams (lower case) that a text must hold to match: any one of the sets, whole. None: no such trigrams."""
    query = []
    for alternative in _literals(parser.parse(regex)):
        grams = frozenset(run[i : i + 3].lower() for run in alternative.split("\0") for i in range(len(run) - 2))
        if not grams:
            return None
        query.append(grams)
    return [q for q in query if not any(other < q for other in query)]


def postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, doc_id): one row for each of the trigrams that a text holds, whatever its case."""
    low = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("low")).where("low is not null")
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kinds): for each document the indexed rules whose trigram query it meets; documents that meet none are
    not there. Rows that share an id count together, so they may be named too often but never too rarely."""
    spark = docs.sparkSession
    wanted = [(r.kind, n, g) for r in rules for n, grams in enumerate(trigram_query(r.regex) or ()) for g in sorted(grams)]
    sizes = {}
    for kind, n, _ in wanted:
        sizes[kind, n] = sizes.get((kind, n), 0) + 1
    seen: dict = {}
    terms = []
    for kind, n, g in wanted:
        bit = seen.get((kind, n), 0)
        seen[kind, n] = bit + 1
        terms.append((g, kind, n, 1 << bit, (1 << sizes[kind, n]) - 1))
    query = spark.createDataFrame(terms, "trigram string, kind string, part int, bit long, whole long")
    posts = postings(docs, sorted({g for _, _, g in wanted}), id_col, text_col)
    met = posts.join(F.broadcast(query), "trigram").groupBy("doc_id", "kind", "part", "whole").agg(F.bit_or("bit").alias("bits"))  # the query has a row for each term of the rules
    return met.where("bits = whole").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, op, levels: int = 3) -> Column:
    """array<int>: for each of the values (0 or more) what op makes of 0 and all the values before it.

    An array that grows step by step is copied at each step. So the values are folded by lots of LOT, the same is done to the lots'
    results, and a value's result is that before its lot, folded with the values before it in the lot.
    """
    fold = lambda some: F.aggregate(some, F.lit(0), op)
    each = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    if levels == 1:
        return _let(values, lambda v: F.transform(each(F.size(v)), lambda i: fold(F.slice(v, F.lit(1), i))))
    lots = lambda v: F.transform(each(F.ceil(F.size(v) / LOT).cast("int")), lambda k: fold(F.slice(v, k * LOT + 1, F.lit(LOT))))
    inside = lambda v, i: fold(F.slice(v, i - i % LOT + 1, i % LOT))
    return _let(values, lambda v: _let(_before(lots(v), op, levels - 1), lambda s: F.transform(each(F.size(v)), lambda i: op(F.get(s, F.floor(i / LOT).cast("int")), inside(v, i)))))


SPAN = "struct<start:int,ord:int,end:int,kind:string>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<SPAN> of a rule's matches, leftmost first, in code points.

    The pieces between the matches and the matches themselves take turns, so their lengths add up to the places.
    """
    regex = F.lit(rule.regex)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    parts = F.regexp_extract_all(text, regex, F.lit(rule.group))
    gaps = F.transform(F.slice(F.split(text, rule.regex, -1), 1, F.size(matches)), F.length)
    both = F.arrays_zip(gaps.alias("gap"), F.transform(matches, F.length).alias("hit"), F.transform(parts, lambda p: F.length(p) >= rule.least).alias("kept"))

    def placed(rows):
        at = _before(F.transform(rows, lambda x: x["gap"] + x["hit"]), lambda a, b: a + b)
        spans = F.zip_with(rows, at, lambda x, n: F.when(x["kept"], F.struct((n + x["gap"]).alias("start"), F.lit(order).alias("ord"), (n + x["gap"] + x["hit"]).alias("end"), F.lit(rule.kind).alias("kind"))))
        return F.array_compact(spans).cast(f"array<{SPAN}>")

    return F.when(F.regexp_like(text, regex), _let(both, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with the column out: array<struct<start, ord, end, kind>> by start, then in the order of the rules.

    All rows and columns stay; a column of docs that is named like out is an error. Null and empty texts have no spans; rows
    without an id are not in the index and searched with every rule.

    The candidates of the index, ids and kinds, are broadcast where they are CANDIDATES rows at most, so that no text moves. Where they are more,
    rows and candidates meet by their ids; those without an id stay where they are.
    """
    if unused(docs, out) != out:
        raise ValueError(f"docs has a column {out} already")
    indexed = tuple(r for r in rules if trigram_query(r.regex))
    key, kinds = unused(docs, "_id"), unused(docs, "_kinds")
    found = settle(candidates(docs.where(F.col(id_col).isNotNull()), indexed, id_col, text_col).select(F.col("doc_id").alias(key), F.col("kinds").alias(kinds)))
    every = F.array(*(F.lit(r.kind) for r in indexed)).cast("array<string>")
    same = F.col(id_col) == F.col(key)
    if found.count() <= CANDIDATES:
        rows = docs.join(F.broadcast(found), same, "left").withColumn(kinds, F.when(F.col(id_col).isNull(), every).otherwise(F.col(kinds)))
    else:
        rows = docs.where(F.col(id_col).isNotNull()).join(found.hint("shuffle_hash"), same, "left").unionByName(docs.where(F.col(id_col).isNull()).withColumn(kinds, every), allowMissingColumns=True)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for n, rule in enumerate(rules):
        spans = _spans(text, rule, n)
        parts.append(F.when(F.array_contains(kinds, rule.kind), spans).otherwise(none) if rule in indexed else spans)
    return rows.select(*docs.columns, F.array_sort(F.concat(*parts)).alias(out))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]", spans_col: str = "spans") -> DataFrame:
    """docs (with spans) with each found span's text replaced by the mark; overlapping spans get one. Other texts stay.

    A kept piece begins where the spans before a span end, and ends where the span starts. A text is first cut to slices of SLICE
    characters, from which the pieces are taken, as a place in a long text is found by counting from its start.
    """
    hit = F.size(spans_col) > 0
    end = F.array(F.struct(F.length(text_col).alias("start"), F.length(text_col).alias("end")))
    marks = F.concat(F.transform(spans_col, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), end)

    def kept(rows):
        free = _before(F.transform(rows, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        last = F.size(rows) - 1
        some = F.transform(F.arrays_zip(rows.alias("x"), free.alias("a")), lambda z, i: F.when((i == last) | (z["x"]["start"] >= z["a"]), F.struct(z["a"].alias("a"), F.greatest(z["a"], z["x"]["start"]).alias("b"))))
        return F.array_compact(some)

    pieces, slices = unused(docs, "_pieces"), unused(docs, "_slices")
    rows = docs.withColumn(pieces, F.when(hit, _let(marks, kept)))
    rows = rows.withColumn(slices, F.when(hit, F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0))))

    def cut(p):
        first, last = F.floor(p["a"] / SLICE).cast("int"), F.floor(p["b"] / SLICE).cast("int")
        of = lambda i: F.coalesce(F.get(slices, i), F.lit(""))
        begin = F.substring(of(first), p["a"] % SLICE + 1, F.when(first == last, p["b"] - p["a"]).otherwise(F.lit(SLICE)))
        rest = F.concat(F.array_join(F.slice(slices, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(of(last), F.lit(1), p["b"] % SLICE))
        return F.concat(begin, F.when(first == last, "").otherwise(rest))

    text = F.array_join(F.transform(pieces, cut), mark)
    return rows.withColumn(text_col, F.when(hit, text).otherwise(F.col(text_col))).drop(pieces, slices)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["ord"] < len(BASE))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
