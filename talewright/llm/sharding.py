"""Sharding by a k-d tree over the rows' metadata, in DataFrame operations only.

Every node is split at its weighted median along the metadata dimension (language, source, logarithm of the size) in which
its rows spread widest, until there are as many leaves as shards (or leaves of the target bytes). All nodes of a level are
split together. The medians come from distributed histograms: each round sums the bytes per node and bin and finds the bin
that holds the median, which the next round cuts into finer bins. The driver holds one row for each node of the tree, and
rows find their node's cut by a broadcast join with that table, which has no more rows than there are shards.

A row's place along a dimension is 60 bits: 20 of the dimension, then, as a tie only, 20 of the text's checksum and 20 of a
hash of the id. So equal values are no obstacle: a hot value splits by text, and a group of equal texts stays together
unless it would put the node out of balance by more than SNAP of its bytes; then it splits by id.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, settle, table

SHARDS = 16
PART_BITS = 20
#: Bits that a round of histograms adds to a median; it divides PART_BITS.
STEP = 10
#: Share of a node's bytes by which a group of equal texts may shift its median.
SNAP = 0.004
#: Levels of the tree between two cuts of the lineage.
LEVELS = 4
DIMENSIONS = ("d0", "d1", "d2")


def _scaled(value: Column, low: float, high: float) -> Column:
    """20 bits of a number between low and high; null comes first."""
    top = (1 << PART_BITS) - 1
    span = (high - low) or 1.0
    return F.coalesce(F.floor((value - F.lit(low)) / F.lit(span) * top).cast("long"), F.lit(0).cast("long"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32 and the dimensions d0, d1, d2: language, source, log of the size) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = lambda c, n: F.crc32(F.col(c).cast("string")).cast("double").alias(n)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), name(lang_col, "d0"), name(source_col, "d1"))
    return rows.withColumn("d2", F.log2("size"))


def _nodes(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows of the driver's tree as a table; broadcast, as there are no more of them than shards."""
    return F.broadcast(spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("n")).select("n.*"))


def kd_assign(rows: DataFrame, shards: int) -> DataFrame:
    """rows (of ``measures``) with the column shard, 0 to shards - 1, of about equal bytes."""
    total = rows.agg(F.sum("size"), *(f(d) for d in DIMENSIONS for f in (F.min, F.max))).first()
    if total[0] is None or shards < 2:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"))
    bounds = [(total[1 + 2 * i] or 0.0, total[2 + 2 * i] or 0.0) for i in range(len(DIMENSIONS))]
    tie = F.shiftleft(F.shiftright("text_crc32", 32 - PART_BITS), PART_BITS).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << PART_BITS) - 1)))
    places = [F.shiftleft(_scaled(F.col(d), *b), 2 * PART_BITS).bitwiseOR(tie).alias(f"k{i}") for i, (d, b) in enumerate(zip(DIMENSIONS, bounds, strict=True))]
    points = settle(rows.select("doc_id", "size", "text_crc32", *places, F.lit(0).cast("long").alias("node")))
    ranges, level = {0: (0, shards)}, 0  # node: its shards
    while any(b - a > 1 for a, b in ranges.values()):
        points, ranges = _split(points, ranges)
        level += 1
        if level % LEVELS == 0:
            points = settle(points)
    leaves = _nodes(points.sparkSession, [{"node": n, "shard": a} for n, (a, _) in ranges.items()], "node:long,shard:int")
    return points.join(leaves, "node").select("doc_id", "size", "text_crc32", "shard")


def _split(points: DataFrame, ranges: dict[int, tuple[int, int]]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """One level of the tree: every node with more than one shard becomes two."""
    spread = points.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(f"k{i}").alias(f"{f.__name__}{i}") for i in range(len(DIMENSIONS)) for f in (F.min, F.max))).collect()
    todo, cut = {}, {}
    for r in spread:
        a, b = ranges[r.node]
        if b - a > 1:
            axis = max(range(len(DIMENSIONS)), key=lambda i: ((r[f"max{i}"] >> 2 * PART_BITS) - (r[f"min{i}"] >> 2 * PART_BITS), -i))
            # need: bytes still to be found below the cut
            todo[r.node] = {"node": r.node, "axis": axis + 1, "low": 0, "bits": 3 * PART_BITS, "need": r.bytes * ((b - a) // 2) / (b - a), "total": r.bytes}
    axes = {n: t["axis"] for n, t in todo.items()}
    place = F.element_at(F.array(*(F.col(f"k{i}") for i in range(len(DIMENSIONS)))), F.col("axis"))
    while todo:
        nodes = [{**{k: t[k] for k in ("node", "axis", "low", "need")}, "high": t["low"] + (1 << t["bits"]) - 1, "shift": t["bits"] - STEP} for t in todo.values()]
        mine = points.select("node", "size", *(f"k{i}" for i in range(len(DIMENSIONS)))).join(_nodes(points.sparkSession, nodes, "node:long,axis:int,low:long,need:double,high:long,shift:int"), "node")
        mine = mine.withColumn("k", place).where(F.col("k").between(F.col("low"), F.col("high")))
        sums = mine.groupBy("node", "need", F.expr("shiftright(k, shift)").alias("bin")).agg(F.sum("size").alias("bytes"))
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin"))  # a node has 2 ** STEP bins at most
        for r in sums.withColumn("upto", upto).where("upto >= need AND upto - bytes < need").collect():
            t = todo[r.node]
            t["bits"] -= STEP
            t["low"] = r.bin << t["bits"]
            under, over = t["need"] - (r.upto - r.bytes), r.upto - t["need"]
            t["need"] = under
            if (min(under, over) <= SNAP * t["total"] and t["bits"] >= PART_BITS) or t["bits"] == 0:
                cut[r.node] = t["low"] if under <= over else t["low"] + (1 << t["bits"])  # the first place above the cut
                del todo[r.node]
    out, cuts = {}, []
    for n, (a, b) in ranges.items():
        middle = a + (b - a) // 2
        if n in cut:
            out[2 * n], out[2 * n + 1] = (a, middle), (middle, b)
            cuts.append({"node": n, "axis": axes[n], "cut": cut[n]})
        else:  # one shard, or no rows
            out[2 * n] = (a, a + 1)
    known = _nodes(points.sparkSession, cuts, "node:long,axis:int,cut:long")
    node = F.col("node") * 2 + F.when(place >= F.col("cut"), 1).otherwise(0)
    return points.join(known, "node", "left").withColumn("node", node).drop("axis", "cut"), out


def number_slots(rows: DataFrame, shard_col: str = "shard", id_col: str = "doc_id") -> DataFrame:
    """rows with the column slot: 0, 1, 2 ... within each shard.

    A shard is numbered in parts, dealt by a hash of the id, of which each begins where the ones before it end; so no task
    holds a whole shard.
    """
    n = partitions(rows.sparkSession)
    parts = rows.withColumn("_part", F.pmod(F.xxhash64(id_col, "text_crc32"), F.lit(n)).cast("int"))
    counts = parts.groupBy(shard_col, "_part").agg(F.count("*").alias("_n"))
    begins = counts.withColumn("_begin", F.sum("_n").over(Window.partitionBy(shard_col).orderBy("_part")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy(shard_col, "_part").orderBy(id_col, "text_crc32"))
    return parts.withColumn("_row", within).join(begins, [shard_col, "_part"]).withColumn("slot", F.col("_begin") + F.col("_row") - 1).drop("_part", "_row", "_begin")


def shard(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row.

    ``shards`` leaves of about equal bytes, or as many as give leaves of ``target_bytes`` at most on average. Null texts
    have size 1; rows without an id, language, source or text are dealt like any other; equal rows get slots of their own;
    other columns are left out. An empty table gives an empty one.
    """
    rows = settle(measures(docs, id_col, text_col, lang_col, source_col))
    if target_bytes:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    return number_slots(settle(kd_assign(rows, shards or 1)))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
