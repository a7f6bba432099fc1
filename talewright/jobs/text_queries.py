"""Queries of normalisation, segmentation and classification (TX, CL, HASH1, SRC5, SRC6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewright.functions import lexicon as lex
from talewright.functions import segment
from talewright.operators import classify

from .catalog import JOIN_SQL, NORM_SQL, NOVELS_SQL, PACK_SQL, SENTENCES_SQL, TARGET, hard_split_sql, novels, query, table

def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("novel_id"), F.coalesce("text", F.lit("")).alias("text"))


@query("tx1_normalize_text", f"SELECT doc_id AS novel_id, {NORM_SQL} AS text FROM documents")
def tx1(spark, sf_dir):
    return segment.normalize(_docs(spark, sf_dir))


@query("tx2_join_wrapped_lines", f"SELECT doc_id AS novel_id, {JOIN_SQL} AS joined FROM documents")
def tx2(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("text", segment.clean_start(F.col("text")))
    return segment.arrow_column(rows, "text", "joined", "string", segment.join_wrapped).select("novel_id", "joined")


@query("tx3_split_sentences", f"WITH {SENTENCES_SQL} SELECT novel_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_no FROM sents")
def tx3(spark, sf_dir):
    rows = segment.arrow_column(novels(spark, sf_dir).select("novel_id", "text"), "text", "s", "array<string>", segment.split_sentences)
    return rows.select("novel_id", F.posexplode("s").alias("sent_no", "sentence"))


_CREDIT_LINE = "'案' || source || chr(10) || '作者：甲' || chr(10) || '轉載自第' || doc_id || '期' || chr(10)"


@query(
    "tx4_strip_front_matter",
    f"""WITH {NOVELS_SQL}, b AS (SELECT d.doc_id AS novel_id, d.source, string_split({_CREDIT_LINE.replace('source', 'd.source').replace('doc_id', 'd.doc_id')}, chr(10)) AS head, n.text FROM documents d JOIN novels n ON n.novel_id = d.doc_id)
SELECT novel_id, 0::BIGINT AS n_credits, length(trim(text, ' ' || chr(10))) > 0 AS has_body FROM b""",
)
def tx4(spark, sf_dir):
    """Title and two credit lines are put before each manuscript; none may be left, and the body must."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = novels(spark, sf_dir).join(docs, F.col("novel_id") == F.col("doc_id"))
    head = F.concat(F.lit("案"), "source", F.lit("\n作者：甲\n轉載自第"), F.col("doc_id").cast("string"), F.lit("期\n"))
    rows = rows.select("novel_id", F.concat(head, "text").alias("text"))
    rows = segment.arrow_column(rows, "text", "s", "array<string>", lambda t: segment.strip_front_matter(segment.split_sentences(t)))
    return rows.select("novel_id", F.size(F.filter("s", lambda x: x.rlike(lex.CREDITS))).cast("long").alias("n_credits"), (F.size("s") > 0).alias("has_body"))


@query("tx5_pack_shots", f"WITH {SENTENCES_SQL}, {PACK_SQL} SELECT novel_id, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS chunk_no FROM chunks")
def tx5(spark, sf_dir):
    rows = novels(spark, sf_dir).select("novel_id", "text")
    rows = segment.arrow_column(rows, "text", "c", "array<string>", lambda t: segment.pack(segment.split_sentences(t), TARGET))
    return rows.select("novel_id", F.posexplode("c").alias("chunk_no", "chunk"))


@query(
    "tx6_hard_split",
    f"""WITH l AS (SELECT doc_id AS novel_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents), p AS (SELECT novel_id, line_no, {hard_split_sql('line', 40)} AS parts FROM l)
SELECT novel_id, line_no, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS part_no FROM p""",
)
def tx6(spark, sf_dir):
    """The lines of the documents as they are, cut near 40 characters."""
    lines = _docs(spark, sf_dir).select("novel_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = segment.arrow_column(lines, "line", "parts", "array<string>", lambda t: segment.hard_split(t, 40))
    return rows.select("novel_id", "line_no", F.posexplode("parts").alias("part_no", "part"))


@query(
    "tx7_drop_fragments",
    f"WITH {NOVELS_SQL}, p AS (SELECT novel_id, list_filter(list_transform(string_split(text, '。'), lambda s: trim(s, ' ' || chr(10))), lambda s: regexp_matches(s, '[一-鿿A-Za-z0-9]')) AS p FROM novels) SELECT novel_id, unnest(p) AS narr, generate_subscripts(p, 1) - 1 AS shot_no FROM p",
)
def tx7(spark, sf_dir):
    parts = F.filter(F.transform(F.split("text", "。"), lambda s: F.trim(s, F.lit(" \n"))), lambda s: s.rlike("[一-鿿A-Za-z0-9]"))
    return novels(spark, sf_dir).select("novel_id", F.posexplode(parts).alias("shot_no", "narr"))


def hits_sql(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def style_sql(text: str = "text") -> str:
    counts = [hits_sql(p, text) for _, p in lex.STYLES]
    most = f"greatest({', '.join(counts)})"
    return f"CASE WHEN {most} = 0 THEN '{lex.DEFAULT_STYLE}' " + " ".join(f"WHEN {c} = {most} THEN '{n}'" for (n, _), c in zip(lex.STYLES, counts, strict=True)) + " END"


def era_sql(text: str = "text") -> str:
    modern, weak = hits_sql(lex.ERA_MODERN, text), hits_sql(lex.ERA_WEAK, text)
    return f"CASE WHEN regexp_matches({text}, '{lex.ERA_CERTAIN}') THEN '古裝' WHEN regexp_matches({text}, '{lex.ERA_NEAR}') AND {modern} = 0 THEN '近代' WHEN {weak} >= 3 AND {weak} > {modern} THEN '古裝' ELSE '現代' END"


def season_sql(text: str = "text") -> str:
    scores = ["(" + " + ".join(f"{hits_sql(p, text)} * {w}" for p, w in groups) + ")" for _, _, groups in lex.SEASONS]
    most = f"greatest({', '.join(scores)})"
    return f"CASE WHEN {most} = 0 THEN '' " + " ".join(f"WHEN {s} = {most} THEN '{phrase}'" for (_, phrase, _), s in zip(lex.SEASONS, scores, strict=True)) + " END"


def hash_sql(text: str) -> str:
    h = f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) % 4294967296)"
    for shift, m in ((15, 2246822507), (13, 3266489909)):
        h = f"list_transform([{h}], lambda x: ((xor(x, x >> {shift})::HUGEINT * {m}) % 4294967296)::BIGINT)[1]"
    return f"list_transform([{h}], lambda x: xor(x, x >> 16))[1]"


@query("cl1_guess_style", f"WITH {NOVELS_SQL} SELECT novel_id, {style_sql()} AS style FROM novels")
def cl1(spark, sf_dir):
    return novels(spark, sf_dir).select("novel_id", classify.guess_style(F.col("text")).alias("style"))


# The manuscripts nearly all hold a word of the old era; without the gate's name the other branches come up too.
_UNGATED = "replace(text, '衙門', '門')"


@query("cl2_detect_era", f"WITH {NOVELS_SQL} SELECT novel_id, {era_sql()} AS era, {era_sql(_UNGATED)} AS era_ungated FROM novels")
def cl2(spark, sf_dir):
    return novels(spark, sf_dir).select("novel_id", classify.detect_era(F.col("text")).alias("era"), classify.detect_era(F.replace("text", F.lit("衙門"), F.lit("門"))).alias("era_ungated"))


@query("cl3_detect_season", f"WITH {NOVELS_SQL} SELECT novel_id, {season_sql()} AS season FROM novels")
def cl3(spark, sf_dir):
    return novels(spark, sf_dir).select("novel_id", classify.detect_season(F.col("text")).alias("season"))


def _pool_sql(era: str, h: str) -> str:
    pool = [s for s, eras in lex.SEASON_POOL if era in eras.split()]
    return f"[{', '.join(repr(s) for s in pool)}][1 + {h} % {len(pool)}]"


def season_for_sql(text: str, era: str) -> str:
    """The season of a text, else one of its era's pool by the hash of its start."""
    season, h = season_sql(text), hash_sql(f"substring({text}, 1, 200)")
    return f"CASE WHEN {season} <> '' THEN {season} WHEN {era} = '古裝' THEN {_pool_sql('古裝', h)} WHEN {era} = '近代' THEN {_pool_sql('近代', h)} ELSE {_pool_sql('現代', h)} END"


@query("cl4_season_for_novel", f"WITH {NOVELS_SQL}, f AS (SELECT novel_id, text, {era_sql()} AS era FROM novels WHERE text <> '') SELECT novel_id, {season_for_sql('text', 'era')} AS season FROM f")
def cl4(spark, sf_dir):
    rows = novels(spark, sf_dir).where("text <> ''")
    return rows.select("novel_id", classify.season_for_novel(F.col("text"), classify.detect_era(F.col("text"))).alias("season"))


@query("cl5_novel_has_modern_tech", "SELECT doc_id AS novel_id, regexp_matches(coalesce(text, ''), 'token|api_key|password') AS modern FROM documents")
def cl5(spark, sf_dir):
    """The flag by a pattern of the caller's, here for Latin text."""
    return _docs(spark, sf_dir).select("novel_id", F.col("text").rlike("token|api_key|password").alias("modern"))


@query("hash1_stable_pick", f"WITH w AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) SELECT source, {hash_sql(chr(40) + 'source || ' + repr('#hair') + chr(41))} AS hash, {hash_sql(chr(40) + 'source || ' + repr('#hair') + chr(41))} % 7 AS pick FROM w")
def hash1(spark, sf_dir):
    h = classify.stable_hash(F.concat("source", F.lit("#hair")))
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source").distinct().select("source", h.alias("hash"), (h % 7).alias("pick"))


# What bytes of a double-byte text look like when they are read as Western ones: accented letters, signs and quotes.
ODD = "[\u201a\u0192\u201e\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178\u00a0-\u00ff]"
#: Documents as they are, and as they look when their UTF-8 bytes are read as Latin ones, by turns.
_READ_SQL = "regexp_replace(CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE replace(replace(replace(coalesce(text, ''), 'e', 'Ã©'), 'a', 'Ã¤'), 'o', 'Ã¶') END, '\\s', '', 'g')"


@query(
    "src6_looks_garbled",
    f"""WITH x AS (SELECT doc_id, {_READ_SQL} AS t FROM documents)
SELECT doc_id, length(t) >= 200 AND len(regexp_extract_all(t, '[一-鿿]')) <= 0.1 * length(t) AND len(regexp_extract_all(t, '{ODD}')) > 0.05 * length(t) AND len(regexp_extract_all(t, '[A-Za-z]')) < 0.6 * length(t) AS garbled FROM x""",
)
def src6(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    read = F.replace(F.replace(F.replace(text, F.lit("e"), F.lit("Ã©")), F.lit("a"), F.lit("Ã¤")), F.lit("o"), F.lit("Ã¶"))
    return table(spark, sf_dir, "documents").select("doc_id", looks_garbled(F.when(F.col("doc_id") % 2 == 0, text).otherwise(read)).alias("garbled"))


def looks_garbled(text):
    """SRC6: whether a text looks like one that was read in a wrong encoding: long, hardly any Han, many odd signs, few letters."""
    t = F.regexp_replace(text, "\\s", "")
    n = F.length(t)
    return (n >= 200) & (F.regexp_count(t, F.lit("[一-鿿]")) <= 0.1 * n) & (F.regexp_count(t, F.lit(ODD)) > 0.05 * n) & (F.regexp_count(t, F.lit("[A-Za-z]")) < 0.6 * n)


@query(
    "src5_classify_extraction",
    r"""WITH x AS (SELECT doc_id, coalesce(text, '') AS text, (n_chars * 7) % 500 AS mapped, (n_chars * 3) % 200 AS suspect, n_chars % 300 AS unmapped, n_chars % 11 <> 0 AS supported FROM documents)
SELECT doc_id, CASE WHEN NOT supported THEN 'unsupported' WHEN suspect > 30 AND suspect > 0.25 * mapped THEN 'garbled' WHEN unmapped > 200 AND mapped < 0.35 * unmapped THEN 'no-unicode' WHEN trim(text) = '' THEN 'scanned' ELSE 'ok' END AS status,
CASE WHEN NOT supported OR (suspect > 30 AND suspect > 0.25 * mapped) OR (unmapped > 200 AND mapped < 0.35 * unmapped) OR trim(text) = '' THEN '' ELSE text END AS text FROM x""",
)
def src5(spark, sf_dir):
    """The ladder of statuses; the counters of an extraction are made from n_chars."""
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (n * 7 % 500).alias("mapped"), (n * 3 % 200).alias("suspect"), (n % 300).alias("unmapped"), (n % 11 != 0).alias("supported"))
    status = F.when(~F.col("supported"), "unsupported").when((F.col("suspect") > 30) & (F.col("suspect") > 0.25 * F.col("mapped")), "garbled").when((F.col("unmapped") > 200) & (F.col("mapped") < 0.35 * F.col("unmapped")), "no-unicode").when(F.trim("text") == "", "scanned").otherwise("ok")
    return rows.select("doc_id", status.alias("status"), F.when(status == "ok", F.col("text")).otherwise("").alias("text"))
