"""A projection of the ``documents`` table to Chinese manuscripts, the same in Spark and in SQL.

Every word becomes the token that its length and first character choose, so the same documents give the same manuscripts
in either engine, of any number and length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS = (
    "。狄明說道：「快走。」", "」", "，馬華", "書房", "。", "的", "王美麗問道：「誰？我」", "」", "林探長", "，", "她", "他", "走進", "碼頭", "。\n", "我",
    "皺眉", "鑰匙", "，阿信", "小陳", "說", "花園", "線索", "雨", "。", "母親", "覺得", "忠厚", "、", "衙門口", "客廳", "！",
    "後來", "。呂明山", "山仔", "推開門", "月色", "機車", "中秋", "？", "眾人", "桌子", "想起", "臉", "轉身", "，德山", "，德山很高興地說", "。我叫馬華，",
    "天空", "老爺", "電話", "屍體", "手裡", "你知道", "戴著眼鏡", "年輕", "看著", "。第二天，", "…", "『走吧！』", "』", "河邊", "醫生",
    "，歐陽修說道：", "。司馬相如推開門", "，名字叫諸葛亮，", "歐陽修先生", "，司馬相如很高興地問道：",
)


# Two of three manuscripts declare a place at their start, by the number of the document.
MARKERS = ("場景：舊倉庫，", "【河邊】", "")


def manuscripts(documents: DataFrame) -> DataFrame:
    """(novel_id, source_name, text) of every row of documents."""
    lead = F.element_at(F.array(*(F.lit(m) for m in MARKERS)), (F.col("doc_id") % len(MARKERS) + 1).cast("int"))
    tokens = F.array(*(F.lit(t) for t in TOKENS))
    words = F.split(F.coalesce("text", F.lit("")), " ")
    text = F.array_join(F.transform(words, lambda w: F.element_at(tokens, (F.lit(1) + (F.length(w) * 31 + F.ascii(w)) % len(TOKENS)).cast("int"))), "")
    return documents.select(F.col("doc_id").alias("novel_id"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_name"), F.concat(lead, text).alias("text"))


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values_sql(rows, *columns: str) -> str:
    """A VALUES list as a derived table with an ordinal column ord first."""
    cell = lambda v: "NULL" if v is None else quote(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join([str(i), *(cell(v) for v in (r if isinstance(r, tuple) else (r,)))]) + ")" for i, r in enumerate(rows))
    return f"(VALUES {body}) AS t(ord, {', '.join(columns)})"


_LIST = ", ".join("'" + t.replace("\n", "'||chr(10)||'") + "'" for t in TOKENS)
#: CTE ``novels`` for DuckDB.
NOVELS_SQL = f"""novels AS (
  SELECT doc_id AS novel_id, source || '_' || doc_id || '.txt' AS source_name,
    [{', '.join(f"'{m}'" for m in MARKERS)}][1 + doc_id % {len(MARKERS)}] || array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda w: [{_LIST}][1 + (length(w) * 31 + ascii(w)) % {len(TOKENS)}]), '') AS text
  FROM documents
)"""
