"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


#: Parts that the neighbours of a node are dealt to, so that a node with very many is no hot key.
SALTS = 64


def _hub(edges: DataFrame, both_ways: bool) -> DataFrame:
    """(src, dst, low): the edges with the least node among src and its neighbours.

    The least is found in two steps, of each part of the neighbours and then of the parts, and told to the parts that there are.
    ``src + 0`` hides the grouping from the planner, so both sides of the join get an exchange of their own and the adaptive
    planner can split a part that is still large.
    """
    sym = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if both_ways else edges
    sym = sym.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int"))
    parts = sym.groupBy("src", "salt").agg(F.min("dst").alias("m"))
    low = parts.groupBy("src").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))  # SALTS at most
    told = low.select((F.col("src") + F.lit(0)).alias("node"), F.explode("salts").alias("part"), F.least("src", "m").alias("low"))
    return sym.hint("merge").join(told, (F.col("src") == F.col("node")) & (F.col("salt") == F.col("part"))).select("src", "dst", "low")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node that can be reached.

    Large-star and small-star steps by turns: each step links neighbours to the least of them, and both keep the
    components. The edges end as stars around the least nodes after about log n rounds, whatever the shapes. Null ends,
    loops and repeated edges count for nothing; without edges the result is empty.
    """
    e = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).where("src != dst")
    e = settle(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = None
    while True:
        large = _hub(e, True).where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src != dst").distinct()
        small = _hub(large, False)
        small = small.select("src", F.col("low").alias("dst")).union(small.select(F.col("dst").alias("src"), F.col("low").alias("dst")))
        e = settle(small.where("src != dst").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(e.select("dst", "dst").distinct())
