"""Places of a manuscript."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talewright.functions import automaton
from talewright.functions.lexicon import DEFAULT, Lexicon


def place_counts(novels: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """L1: (novel_id, name, n) of the lexicon's places that a text holds; a place within another counts for both. All places are
    looked for in one reading of a text."""
    return automaton.counts_by_row(novels, [p for p, _ in lex.PLACES])


def place_markers(novels: DataFrame) -> DataFrame:
    """L2: places that the text declares itself: 場景：X counts 99, 【X】 counts 50."""
    trim = lambda c: F.trim(c, F.lit(" \n\t"))
    scene = novels.select("novel_id", F.explode(F.regexp_extract_all("text", F.lit("場景\\s*[：:]\\s*([^\n，,。；;]{2,12})"), F.lit(1))).alias("name")).select("novel_id", trim("name").alias("name"), F.lit(99).alias("n"))
    bracket = novels.select("novel_id", F.explode(F.regexp_extract_all("text", F.lit("[【〖]([^】〗]{2,12})[】〗]"), F.lit(1))).alias("name")).select("novel_id", trim("name").alias("name"), F.lit(50).alias("n"))
    return scene.union(bracket).where("name <> ''").groupBy("novel_id", "name").agg(F.sum("n").alias("n"))


def top_places(counts: DataFrame, limit: int = 6, lex: Lexicon = DEFAULT) -> DataFrame:
    """L3: (novel_id, rank, name, count, type): the most frequent, ties in the lexicon's order, then by name."""
    known = counts.sparkSession.createDataFrame([(p, t, i) for i, (p, t) in enumerate(lex.PLACES)], "name string, type string, ord int")
    sums = counts.groupBy("novel_id", "name").agg(F.sum("n").alias("count")).join(F.broadcast(known), "name", "left")  # a row for each place of the lexicon
    order = Window.partitionBy("novel_id").orderBy(F.desc("count"), F.col("ord").asc_nulls_last(), "name")
    ranked = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("novel_id", "rank", "name", "count", F.coalesce("type", F.lit("室外")).alias("type"))


def places(novels: DataFrame, limit: int = 6, lex: Lexicon = DEFAULT) -> DataFrame:
    return top_places(place_counts(novels, lex).unionByName(place_markers(novels)), limit, lex)
