"""Lexicon mining, merging and checking. A lexicon table has list, ord, key, and value where there is one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talewright.functions import automaton
from talewright.functions.shared import slices


def alternatives(key: Column, is_regex: Column) -> Column:
    """The words that a key stands for: itself, or the alternatives of a regex, without its signs."""
    plain = F.transform(F.split(key, "\\|"), lambda part: F.regexp_replace(part, "[\\\\^$.*+?()\\[\\]{}]", ""))
    return F.when(F.coalesce(is_regex, F.lit(False)), plain).otherwise(F.array(key))


def term_hits(texts: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """M1: (list, key, hits) of every key (list, key, is_regex) over the corpus, zeros too; of a regex the first alternative counts.

    All keys are looked for in one reading of the texts (``automaton.totals``), so ten thousand take hardly longer than ten.
    """
    rows = lexicon.withColumn("word", F.element_at(alternatives(F.col("key"), F.col("is_regex")), 1))
    sums = automaton.totals(texts, rows, text_col)
    return rows.join(sums, "word", "left").select("list", "key", F.coalesce("n", F.lit(0)).cast("long").alias("hits"))


def hit_rates(hits: DataFrame) -> DataFrame:
    """M1 by list: (list, keys, hit, rate) of term hits; lists without a key are not there."""
    return hits.groupBy("list").agg(F.count("*").alias("keys"), F.count_if(F.col("hits") > 0).alias("hit")).withColumn("rate", F.round(F.col("hit") / F.col("keys"), 6))


def dead_entries(texts: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """M2: (list, key) of keys longer than one character without a hit; a regex lives if an alternative of more than one does."""
    long = lexicon.where(F.length("key") > 1)
    keep = F.filter(alternatives(F.col("key"), F.col("is_regex")), lambda w: (F.length(w) > 1) | ~F.coalesce(F.col("is_regex"), F.lit(False)))
    pairs = long.select("key", F.explode(keep).alias("word")).distinct()
    alive = automaton.totals(texts, pairs, text_col).select("word")
    living = pairs.join(alive, "word", "left_semi").select("key").distinct()
    return long.join(living, "key", "left_anti").select("list", "key")


def harvest_candidates(sentences: DataFrame, patterns: list[tuple[str, str]], known: DataFrame, least: int = 3, top: int = 40) -> DataFrame:
    """M3: (list, word, n, rank): what the lists' patterns (one group each) find in sentences, without known words, found
    at least so often, the top of each list. Words are summed before the shuffle, so frequent ones are no hot keys."""

    def words(name: str, pattern: str):
        return F.transform(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(1)), lambda w: F.struct(F.lit(name).alias("list"), w.alias("word")))

    found = F.flatten(F.array(*(words(n, p) for n, p in patterns)))
    counts = sentences.select(F.explode(found).alias("f")).groupBy("f.list", "f.word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    fresh = counts.join(known.select(F.col("key").alias("word")).distinct(), "word", "left_anti")
    order = Window.partitionBy("list").orderBy(F.desc("n"), "word")
    return fresh.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("list", "word", "n", "rank")


def mine_tagged_tokens(tokens: DataFrame, known: DataFrame, thresholds: dict[str, int], suffixes: str, manner: tuple[str, ...]) -> DataFrame:
    """M4: (list, word, n) from (doc_id, pos, word, flag): a noun before a speech verb (role; of up to three characters, or with a
    role's suffix), a place noun or a noun before a locative (place), verbs of two or three characters (action), adjectives and the
    words after a word of manner (face)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    after, before = F.lead("flag").over(w), F.lag("word").over(w)
    noun = F.col("flag") == "n"
    role = noun & (after == "vs") & ((F.length("word") <= 3) | F.col("word").rlike(f"(?:{suffixes})$"))
    kind = F.when(role, "role").when((F.col("flag") == "ns") | (noun & (after == "f")), "place").when((F.col("flag") == "v") & F.length("word").between(2, 3), "action").when((F.col("flag") == "a") | before.isin(*manner), "face")
    counts = tokens.withColumn("list", kind).where("list IS NOT NULL").groupBy("list", "word").agg(F.count("*").alias("n"))
    need = F.lit(1 << 30)
    for name, n in thresholds.items():
        need = F.when(F.col("list") == name, n).otherwise(need)
    return counts.where(F.col("n") >= need).join(known.select(F.col("key").alias("word")).distinct(), "word", "left_anti").select("list", "word", "n")


def concordance(sentences: DataFrame, terms: list[str], reach: int = 12) -> DataFrame:
    """M5: (term, example): the first sentence of more than four characters that holds a term, cut around it."""
    listed = F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(F.col("sentence"), t))
    rows = sentences.where(F.length("sentence") > 4).select("novel_id", "sent_no", "sentence", F.explode(listed).alias("term"))
    first = rows.groupBy("term").agg(F.min_by("sentence", F.struct("novel_id", "sent_no")).alias("s"))
    at = F.instr("s", F.col("term"))
    start, end = F.greatest(at - reach, F.lit(1)), F.least(at + F.length("term") + reach, F.length("s") + 1)
    return first.select("term", F.concat(F.when(start > 1, "…").otherwise(""), F.substring("s", start, end - start), F.when(end <= F.length("s"), "…").otherwise("")).alias("example"))


def numbered(rows: DataFrame, part: list, order: list, by: tuple[str, ...] = ("list",)) -> DataFrame:
    """rows with ord, from 0 within each list (the rows that are equal in by), by the columns of part and then by those of order. Each
    part is numbered on its own and begins where the ones before it end, so that no task sorts a whole list."""
    cut = [c.alias(f"_p{i}") for i, c in enumerate(part)]
    names = [f"_p{i}" for i in range(len(part))]
    rows = rows.select("*", *cut)
    sizes = rows.groupBy(*by, *names).agg(F.count("*").alias("_n"))
    begins = sizes.withColumn("_at", F.sum("_n").over(Window.partitionBy(*by).orderBy(*names)) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, *names).orderBy(*order))
    return rows.withColumn("_k", place).join(begins, [*by, *names]).withColumn("ord", F.col("_at") + F.col("_k") - 1).drop("_at", "_k", *names)


def _with_kind(lexicon: DataFrame) -> DataFrame:
    kind = F.coalesce("kind", F.lit("pairs")) if "kind" in lexicon.columns else F.lit("pairs")
    value = F.col("value") if "value" in lexicon.columns else F.lit(None).cast("string")
    return lexicon.select("list", kind.alias("kind"), "ord", "key", value.alias("value"))


def fresh_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """(list, kind, ord, key, value): the entries of new whose key the old list lacks; in lists of pairs and sets the first of a key."""
    rows = _with_kind(new).join(old.select("list", "key").distinct(), ["list", "key"], "left_anti").select("list", "kind", "ord", "key", "value")
    once = rows.where("kind <> 'plain'").groupBy("list", "kind", "key").agg(F.min(F.struct("ord", "value")).alias("e")).select("list", "kind", "e.ord", "key", "e.value")
    return once.unionByName(rows.where("kind = 'plain'"))


def merge_lexicons(old: DataFrame, new: DataFrame) -> DataFrame:
    """M6: (list, ord, key, value) of the merged lists. The kind of a list (column kind, else pairs) is pairs, set or plain.

    Entries of new whose key a list lacks come first, then the old list; the old entry of a repeated key stays. Lists of pairs have each
    key once, a value (a close-up of the key where there is none) and go by the length of keys, longest first. Sets have each key once and plain
    lists what they have; both keep their order and get no values. A list without a new key stays as it is. Lists have no null names or keys.
    """
    fresh, known = fresh_entries(old, new), _with_kind(old)
    changed = fresh.select("list").distinct().withColumn("changed", F.lit(True))
    known = known.join(F.broadcast(changed), "list", "left").withColumn("once", F.coalesce("changed", F.lit(False)) & (F.col("kind") != "plain"))  # a row for each list
    first = known.where("once").groupBy("list", "kind", "key").agg(F.min(F.struct("ord", "value")).alias("e")).select("list", "kind", "e.ord", "key", "e.value", F.lit(True).alias("changed"))
    kept = first.unionByName(known.where("NOT once").select("list", "kind", "ord", "key", "value", "changed"))
    rows = fresh.withColumn("changed", F.lit(True)).withColumn("src", F.lit(0)).unionByName(kept.withColumn("src", F.lit(1)))
    pairs = F.coalesce("changed", F.lit(False)) & (F.col("kind") == "pairs")
    rows = numbered(rows.withColumnRenamed("ord", "was").withColumn("pairs", pairs), [F.when(F.col("pairs"), -F.length("key")).otherwise(0), F.col("src")], ["was", "key"])
    return rows.select("list", "ord", "key", F.when(F.col("pairs"), F.coalesce("value", F.concat("key", F.lit("特寫")))).otherwise(F.col("value")).alias("value"))


def merge_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """M6: (list, fresh, repeated, total): entries of new that a list lacked, those that it had or that new repeats, and the entries of the
    merged list."""
    count = lambda rows, name: rows.groupBy("list").agg(F.count("*").alias(name))
    counts = count(merge_lexicons(old, new), "total").join(count(new, "given"), "list", "left").join(count(fresh_entries(old, new), "fresh"), "list", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return counts.select("list", n("fresh").alias("fresh"), (n("given") - n("fresh")).alias("repeated"), "total")


def merge_pools(old: DataFrame, new: DataFrame) -> DataFrame:
    """M6 for pools, which are trees: (pool, path, ord, value), a row for each value, the path naming the leaf that it belongs to.

    A leaf that only one side has is taken as it is. A leaf that both have keeps its old values in their order, and then has the new ones that it
    lacked. A leaf of a single value (column single, else false) keeps the old one.
    """
    single = lambda rows: F.coalesce("single", F.lit(False)) if "single" in rows.columns else F.lit(False)
    leaf = ["pool", "path"]
    given = new.select(*leaf, F.col("ord").alias("was"), "value", single(new).alias("single"))
    had = old.select(*leaf).distinct().withColumn("had", F.lit(True))
    known = old.select(*leaf, "value").distinct().withColumn("known", F.lit(True))
    more = given.join(had, leaf, "left").join(known, [*leaf, "value"], "left").where("had IS NULL OR (known IS NULL AND NOT single)")
    rows = old.select(*leaf, F.col("ord").alias("was"), "value", F.lit(0).alias("src")).unionByName(more.select(*leaf, "was", "value", F.lit(1).alias("src")))
    return numbered(rows, [F.col("src")], ["was", "value"], ("pool", "path")).select("pool", "path", "ord", "value")


def pool_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """M6 for pools: (pool, before, after): the values of all leaves."""
    count = lambda rows, name: rows.groupBy("pool").agg(F.count("*").alias(name))
    both = count(old, "before").join(count(merge_pools(old, new), "after"), "pool", "full_outer")
    return both.select("pool", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("before", "after")))


#: Kinds of lists whose entries have a form of their own; entries of other kinds need a key only.
FORMS = ("pairs", "set", "plain", "regex", "characters", "weights")


def malformed(lexicon: DataFrame) -> DataFrame:
    """M7: (list, key, problem) of entries that their list's kind does not allow: no key at all; a pair without a value, a weight that is no
    number, a word with blanks around it, a regex that does not compile, a key of a character list with more than one character, and an unknown kind."""

    def fails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([not _compiles(k) for k in b.column(1).to_pylist()])], names=["list", "key", "fails"])

    rows = _with_kind(lexicon)
    key, value = F.col("key"), F.col("value")
    problem = (
        F.when(F.trim(F.coalesce(key, F.lit(""))) == "", "empty")
        .when(~F.col("kind").isin(*FORMS), "unknown kind")
        .when((F.col("kind") == "pairs") & (F.trim(F.coalesce(value, F.lit(""))) == ""), "pair without a value")
        .when((F.col("kind") == "weights") & value.try_cast("int").isNull(), "weight is no number")
        .when((F.col("kind") == "characters") & (F.length(key) != 1), "more than one character")
        .when((F.col("kind") != "regex") & (F.trim(key) != key), "blanks around the word")
    )
    told = rows.select("list", "key", problem.alias("problem")).where("problem IS NOT NULL")
    regexes = rows.where("kind = 'regex' AND trim(key) <> ''").select("list", "key").mapInArrow(fails, "list string, key string, fails boolean")
    return told.union(regexes.where("fails").select("list", "key", F.lit("regex does not compile")))


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except (re.error, OverflowError):
        return False
    return True


def lexicon_checks(lexicon: DataFrame) -> DataFrame:
    """M7: (list, key, problem): repeated keys, malformed entries, and keys that stand before a longer key that they are part of. Each key
    brings its proper parts, which are joined by (list, key): a few rows for each character of the lexicon, never pairs of keys."""
    repeated = lexicon.groupBy("list", "key").agg(F.count("*").alias("n")).where("n > 1").select("list", "key", F.lit("repeated").alias("problem"))
    first = lexicon.where("key <> ''").groupBy("list", "key").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    n = F.length("key")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring("key", i, k))))
    longer = first.where(n > 1).select("list", F.explode(F.array_distinct(parts)).alias("key"), F.col("last").alias("ord_of_longer")).groupBy("list", "key").agg(F.max("ord_of_longer").alias("ord_of_longer"))
    hidden = first.join(longer, ["list", "key"]).where(F.col("first") < F.col("ord_of_longer"))
    forms = lexicon if "kind" in lexicon.columns else lexicon.withColumn("kind", F.lit("plain"))
    return repeated.union(malformed(forms)).union(hidden.select("list", "key", F.lit("hides a longer key").alias("problem")))


#: Entries of an exported row at most.
EXPORT = 1000


def export_lexicon(lexicon: DataFrame) -> DataFrame:
    """M8: (list, part, n, entries): each list (ord from 0 without gaps) in its order as JSON arrays of EXPORT keys. An empty list is no
    list: it has no rows, and a lexicon without entries is an error."""
    if lexicon.isEmpty():
        raise ValueError("the lexicon is empty")
    rows = lexicon.groupBy("list", F.floor(F.col("ord") / EXPORT).alias("part")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "key"))).alias("e"))
    return rows.select("list", "part", "n", F.to_json(F.transform("e", lambda x: x["key"])).alias("entries"))
