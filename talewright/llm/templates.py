"""Benchmark decontamination by templates, in DataFrame operations only.

Texts are brought to a canonical form: lower-case words without punctuation, in which names (capitalised words), numbers (in digits
or as English words) and units are typed placeholders. A window of five tokens is posted with its names as placeholders and, beside that, with
its names as plain words, so that a copy in other case still meets its item. The windows of every document are hash-joined
with those of the benchmark that hold two literal words at least; windows of hardly anything but placeholders say nothing.
An item of fewer tokens is one window, of its whole length; documents are read in windows of the lengths that items have.

Where windows meet, the values that fill the placeholders are compared: along one alignment of a document with an item,
equal values of the item must stand for equal values of the document, and different names for different names (different
numbers may come to be equal by chance). A question with other numbers or names keeps to that.

A document is contaminated by an item if consistent alignments hold at least COVERAGE of the item's windows. One changed
word spoils five windows, so half of the windows still means that about nine words in ten are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

WINDOW = 5
COVERAGE = 0.5
#: The benchmark's windows are broadcast up to so many rows (about 100 bytes each); more are joined by a shuffle.
MAX_BROADCAST = 200_000

# Placeholders: private-use characters, for names, numbers and units; the fourth ends a value.
NAME, NUMBER, UNIT, END = map(chr, range(0xE000, 0xE004))
# Words that are units after a number.
UNITS = (
    "kg|g|mg|km|m|cm|mm|l|ml|mph|kmh|h|min|s|ms|percent|dollars|euros|usd|eur|years|year|days|day|weeks|week|months|month"
    "|hours|hour|minutes|minute|seconds|second|miles|mile|feet|foot|inches|inch|pounds|pound|degrees|grams|meters|metres|liters|litres"
)
# Numbers that are written as words.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()
NAMES_RE = r"(^|[^\p{L}\p{M}\p{N}])(\p{Lu}\p{Ll}+)"
NUMBERS_RE = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
WORD = r"[\p{L}\p{M}]+"
#: Literal words that a window of an item has at least.
LITERALS = 2


def values(text: Column) -> Column:
    """Tokens of a text: words in lower case, names after their mark, numbers and units between their mark and END. Each word of a
    number is a token, as a name of two words is two; units are marked after digits only."""
    t = F.regexp_replace(text, f"[{NAME}-{END}]", " ")
    t = F.regexp_replace(t, NAMES_RE, f"$1{NAME}$2{END}")
    t = F.regexp_replace(t, NUMBERS_RE, f" {NUMBER}$0{END} ")
    t = F.regexp_replace(F.lower(t), f"{END} \\x20?({UNITS})\\b", f"{END} {UNIT}$1{END} ")
    tokens = F.regexp_extract_all(t, F.lit(f"([{NAME}-{UNIT}][^{END}]*{END}|{WORD})"), F.lit(1))
    counts = lambda x: x.isin([*NUMBER_WORDS, *(f"{NAME}{w}{END}" for w in NUMBER_WORDS)])
    number = lambda x: F.concat(F.lit(NUMBER), F.translate(x, NAME + END, ""), F.lit(END))
    return F.transform(tokens, lambda x: F.when(counts(x), number(x)).otherwise(x))


def template(value: Column) -> Column:
    """A token with a name, number or unit as its placeholder."""
    return F.when(value < NAME, value).otherwise(F.substring(value, 1, 1))


def word(value: Column) -> Column:
    """A token with a number or unit as its placeholder, and a name as the word that it is."""
    return F.when(value < NAME, value).when(value < NUMBER, F.translate(value, NAME + END, "")).otherwise(F.substring(value, 1, 1))


def windows(rows: DataFrame, sizes: tuple[int, ...] = (WINDOW,)) -> DataFrame:
    """rows (with v, the values of a text) exploded to pos and, for each size n of 2 to 5 tokens, the hashes of both forms of the window
    there, words_n and template_n; null where the text ends before.

    A token is hashed once for each form; the hashes of more tokens that stand together are made of those of fewer."""
    from_ = lambda c, start: F.slice(c, start, F.size(c))
    joined = lambda a, b: F.xxhash64(a, b)
    both = {"_w": word, "_t": template}
    kept = rows.columns
    hashed = lambda form: F.transform("v", lambda x: F.xxhash64(form(x)))
    rows = rows.select(*kept, *(hashed(form).alias(c) for c, form in both.items()))
    rows = rows.select(*kept, *both, *(F.zip_with(c, from_(c, 2), joined).alias(f"{c}2") for c in both))
    rows = rows.select("*", *(F.zip_with(f"{c}2", from_(f"{c}2", 3), joined).alias(f"{c}4") for c in both))
    of = {2: lambda c: F.col(f"{c}2"), 3: lambda c: F.zip_with(f"{c}2", from_(c, 3), joined), 4: lambda c: F.col(f"{c}4"), 5: lambda c: F.zip_with(f"{c}4", from_(c, WINDOW), joined)}
    fitting = lambda n, c: F.slice(of[n](c), 1, F.greatest(F.size("v") - n + 1, F.lit(0)))
    names = [(f"{kind}_{n}", fitting(n, c)) for n in sizes for kind, c in (("words", "_w"), ("template", "_t"))]
    return rows.select(*kept, F.posexplode(F.arrays_zip(*(c.alias(name) for name, c in names))).alias("pos", "_h")).select(*kept, "pos", "_h.*")


def posts(rows: DataFrame, sizes: tuple[int, ...], *keep: str) -> DataFrame:
    """The windows as rows with one hash: of the words, and of the template where it is another."""
    other = lambda n: F.when(F.col(f"words_{n}") != F.col(f"template_{n}"), F.col(f"template_{n}"))
    if len(sizes) == 1:  # every window has the size, so its words are there
        n = sizes[0]
        hashes = F.when(other(n).isNull(), F.array(f"words_{n}")).otherwise(F.array(f"words_{n}", f"template_{n}"))
    else:
        hashes = F.array_compact(F.array(*(c for n in sizes for c in (F.col(f"words_{n}"), other(n)))))
    return rows.select(*keep, F.explode(hashes).alias("hash"))


#: Sizes of windows; those under WINDOW are of items that are no longer.
SIZES = (2, 3, 4, WINDOW)


def bench_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(hash, item_id, item_pos, n_windows, item_values): windows with LITERALS literals at least in the form that is posted; the
    values are those of the window, and n_windows is how many windows of the item have so many words and names. An item of two to four
    tokens is one window; one of a single token has none."""
    rows = bench.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), values(F.col(text_col).cast("string")).alias("v")).distinct()
    size = F.least(F.size("v"), F.lit(WINDOW))
    form_of = lambda kind: F.coalesce(*(F.when(size == n, F.col(f"{kind}_{n}")) for n in SIZES))
    rows = windows(rows, SIZES).withColumns({"as_words": form_of("words"), "as_template": form_of("template"), "item_values": F.slice("v", F.col("pos") + 1, size)}).where("as_words IS NOT NULL")
    literals = lambda form: F.size(F.filter("item_values", lambda x: form(x) < NAME)) >= LITERALS
    plain, named = literals(word), F.exists("item_values", lambda x: template(x) == NAME) & literals(template)
    rows = rows.withColumns({"plain": plain, "named": named})
    counts = rows.groupBy("item_id", "v").agg(F.count_if("plain").alias("n_windows"))
    rows = rows.select("item_id", "v", "pos", "item_values", F.explode(F.array_compact(F.array(F.when(F.col("plain"), F.col("as_words")), F.when(F.col("named"), F.col("as_template"))))).alias("hash")).join(counts, ["item_id", "v"])
    return rows.select("hash", "item_id", F.col("pos").alias("item_pos"), "n_windows", "item_values")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage) of every document and item with coverage of COVERAGE or more.

    Null texts, items of a single token and items without a window of two literal words meet nothing; rows that share an id
    count as one document each time an alignment is the same in both; rows without an id are left out. Repeated items are one item.
    """
    items = settle(bench_windows(bench, item_col, item_text_col).distinct())
    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    sizes = tuple(sorted(r.n for r in items.select(F.size("item_values").alias("n")).distinct().collect())) or (WINDOW,)  # four at most
    found = posts(windows(rows.select("doc_id", values(F.col("text")).alias("v")), sizes), sizes, "doc_id", "pos")
    keys = items.select("hash").distinct()
    few = items.count() <= MAX_BROADCAST
    met = settle(found.join(F.broadcast(keys) if few else keys, "hash", "left_semi"))
    hits = met.join(F.broadcast(items) if few else items, "hash")
    # The values of the windows that met, from the texts of their documents only.
    named = met.select("doc_id").distinct()
    told = rows.join(named.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", values(F.col("text")).alias("v"))
    places = met.groupBy("doc_id").agg(F.collect_set("pos").alias("places"))  # no more than the document has windows
    filled = told.join(places, "doc_id").select("doc_id", "v", F.explode("places").alias("pos")).select("doc_id", "pos", F.slice("v", F.col("pos") + 1, WINDOW).alias("doc_values")).distinct()
    pairs = hits.join(filled, ["doc_id", "pos"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    filled_by = F.transform(F.arrays_zip(F.col("item_values").alias("a"), F.slice("doc_values", 1, F.size("item_values")).alias("b")), lambda x: F.struct(x["a"].alias("a"), F.translate(x["b"], NAME + END, "").alias("b")))
    slots = F.filter(filled_by, lambda x: x["a"] >= NAME)
    by_shift = pairs.groupBy("doc_id", "item_id", "n_windows", "shift").agg(F.collect_set("item_pos").alias("seen"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"))
    of = lambda side, some: F.size(F.array_distinct(F.transform(some, lambda x: x[side])))
    names = F.filter("slots", lambda x: x["a"] < NUMBER)
    consistent = (of("a", F.col("slots")) == F.size("slots")) & (of("b", names) == F.size(names))
    covered = by_shift.where(consistent).groupBy("doc_id", "item_id", "n_windows").agg((F.size(F.array_distinct(F.flatten(F.collect_list("seen")))) / F.col("n_windows")).alias("coverage"))
    return covered.where(F.col("coverage") >= COVERAGE).groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose document no item contaminates; rows without an id or a text stay."""
    bad = contamination(docs, bench, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad.hint("shuffle_hash"), id_col, "left_anti").select(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with whether the benchmark contaminates it, by which items, and the largest coverage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    items = found.groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))
    rows = docs.select("doc_id").join(items, "doc_id", "left")
    none = F.array().cast("array<bigint>")
    return rows.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.round(F.coalesce("coverage", F.lit(0.0)), 9).alias("coverage"))
