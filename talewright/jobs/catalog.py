"""Where queries and their SQL are entered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talewright.functions import segment
from talewright.functions.zh import NOVELS_SQL, manuscripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Enter a function of (spark, sf_dir) under a name, with SQL that gives the same rows."""

    def enter(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return enter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def novels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Chinese manuscripts that ``documents`` project to."""
    return manuscripts(table(spark, sf_dir, "documents"))


TARGET = 17  # round(260 / 60 * 4) characters a shot

_STARTER_SQL = r"^\s*(第\s*[0-9一二三四五六七八九十百零〇]+\s*[章節回篇]|【|——|─|[0-9]+[、.．]|[（(][0-9]+[)）]|[-*+]\s|#)"
_CLEAN_SQL = "regexp_replace(translate(translate(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(65279), ''), chr(12288), ' '), '[ \\t]+', ' ', 'g')"
_PREV = r"regexp_extract(acc, '[^\n]*$')"
JOIN_SQL = f"""list_reduce(string_split({_CLEAN_SQL}, chr(10)), lambda acc, ln: CASE
  WHEN {_PREV} <> '' AND trim(ln, ' ') <> '' AND NOT regexp_matches({_PREV}, '[。！？…」』：；、,;:]$') AND NOT regexp_matches(ln, '{_STARTER_SQL}') AND NOT regexp_matches({_PREV}, '{_STARTER_SQL}')
  THEN acc || CASE WHEN regexp_matches({_PREV}, '[A-Za-z0-9]$') AND regexp_matches(trim(ln, ' '), '^[A-Za-z0-9]') THEN ' ' ELSE '' END || trim(ln, ' ')
  ELSE acc || chr(10) || ln END)"""
NORM_SQL = f"""trim(regexp_replace(regexp_replace(regexp_replace({JOIN_SQL}, '(?m)^[ \\t]*[-—=*_#~]{{3,}}[ \\t]*$', chr(10), 'g'),
  '(?m)^[ \\t]*第[ \\t]*[0-9一二三四五六七八九十百零〇]+[ \\t]*[章節回篇].*$', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))"""

_Q0 = "[「『][^「」『』]*[」』]"
_Q1 = f"[「『][^「」『』]*(?:{_Q0}[^「」『』]*)*[」』]"
_Q2 = f"[「『][^「」『』]*(?:{_Q1}[^「」『』]*)*[」』]"
_SENTENCE = rf"(?s)(?:{_Q2}|[「『].*$|[^「『。！？!?…\n.]+|\.)*?(?:[。！？!?…\n]|\.(?:\s|$)|$)"
SENTENCES_SQL = NOVELS_SQL + f", sents AS (SELECT novel_id, list_filter(list_transform(regexp_extract_all(text, '{_SENTENCE}'), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS s FROM novels)"
PACK_SQL = f"""packs AS (
  SELECT novel_id, list_reduce(list_transform(s, lambda x: {{'buf': x, 'out': []::VARCHAR[]}}), lambda a, x: CASE
    WHEN length(a.buf) >= 0.7 * {TARGET} OR (length(a.buf) + length(x.buf) > 2 * {TARGET} AND length(a.buf) >= 0.5 * {TARGET}) THEN {{'buf': x.buf, 'out': list_append(a.out, a.buf)}}
    ELSE {{'buf': a.buf || x.buf, 'out': a.out}} END) AS r FROM sents WHERE len(s) > 0
), chunks AS (SELECT novel_id, list_append(r.out, r.buf) AS c FROM packs)"""


def hard_split_sql(text: str, target: int) -> str:
    """A chunk as the list of its parts, cut as ``segment.hard_split`` cuts it: the marks are tried one after the other."""
    wide = int(target * 1.6 + 0.5)
    at = lambda mark: f"CASE WHEN contains(w, '{mark}') THEN length(w) - strpos(reverse(w), '{mark}') ELSE -1 END"
    cut = f"list_transform([substring(a.rest, 1, {wide + 1})], lambda w: list_reduce([-1, {', '.join(at(m) for m in '，、；：,; ')}], lambda k, i: CASE WHEN i > k AND i >= {target // 2} THEN i + 1 ELSE k END))"
    step = f"list_transform(list_transform({cut}, lambda k: CASE WHEN k < 0 THEN {target} ELSE k END), lambda k: {{'rest': substring(a.rest, (k + 1)::BIGINT), 'out': list_append(a.out, substring(a.rest, 1, k::BIGINT))}})[1]"
    steps = f"list_prepend({{'rest': {text}, 'out': []::VARCHAR[]}}, list_transform(range(0, length({text}) // {target // 2} + 1), lambda i: {{'rest': '', 'out': []::VARCHAR[]}}))"
    done = f"list_reduce({steps}, lambda a, b: CASE WHEN length(a.rest) > {target} THEN {step} ELSE a END)"
    return f"list_transform([{done}], lambda r: CASE WHEN r.rest = '' THEN r.out ELSE list_append(r.out, r.rest) END)[1]"


#: The shots of a manuscript: sentences packed to about TARGET characters, long ones cut, fragments dropped; numbered from 0. The
#: manuscripts of the projection hold no credits, so the SQL strips none.
SHOTS_SQL = f"""{SENTENCES_SQL}, {PACK_SQL}, split AS (SELECT novel_id, flatten(list_transform(c, lambda x: CASE WHEN length(x) > {1.8 * TARGET} THEN {hard_split_sql('x', TARGET)} ELSE [x] END)) AS c FROM chunks),
parts AS (SELECT novel_id, list_filter(list_transform(c, lambda x: trim(x, ' ' || chr(10))), lambda x: regexp_matches(x, '[一-鿿A-Za-z0-9]')) AS p FROM split),
shots AS (SELECT novel_id, unnest(p) AS narr, generate_subscripts(p, 1) - 1 AS shot_no FROM parts)"""
#: Sentences as shots, for what reads sentences only.
SENTENCE_SHOTS_SQL = (
    NOVELS_SQL
    + """, parts AS (
  SELECT novel_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？\\n])', '\\1' || chr(30), 'g'), chr(30)), lambda s: trim(s, ' ' || chr(10))), lambda s: regexp_matches(s, '[一-鿿A-Za-z0-9]')) AS p FROM novels
), shots AS (SELECT novel_id, unnest(p) AS narr, generate_subscripts(p, 1) - 1 AS shot_no FROM parts)"""
)


def packed_shots(texts: DataFrame, target: int = TARGET) -> DataFrame:
    """(novel_id, shot_no, narr): the shots of normalised texts, without a shuffle."""
    rows = segment.arrow_column(texts.select("novel_id", "text"), "text", "parts", "array<string>", lambda t: segment.shots_of(t, target))
    return rows.select("novel_id", F.posexplode("parts").alias("shot_no", "narr"))


def sentence_shots(texts: DataFrame) -> DataFrame:
    """(novel_id, shot_no, narr): one shot for each sentence, without a shuffle."""
    parts = F.split(F.regexp_replace("text", "([。！？\n])", "$1\u001e"), "\u001e")
    kept = F.filter(F.transform(parts, lambda s: F.trim(s, F.lit(" \n"))), lambda s: s.rlike("[一-鿿A-Za-z0-9]"))
    return texts.select("novel_id", F.posexplode(kept).alias("shot_no", "narr"))
