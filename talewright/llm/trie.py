"""The prefix trie of conversations, by preorder intervals, in DataFrame operations.

A node is a distinct sequence of first turns. It is named by its depth and 128 bits: the exclusive or of a hash of each turn with its
place, which is a running sum along the conversation, taken in blocks. A node belongs to its smallest member, so a conversation owns
the nodes of one run of depths, from where it branches off another conversation to its end.

Preorder, children by smallest member, is an order of the conversations: by the list of (branching depth, conversation) from the root to
the conversation itself, deeper branchings first. That list is short: a conversation whose list has j entries needs j others that
share ever longer parts of it. The conversations' ranks in this order and the numbers of nodes that they own, summed, give every node
its place; the owned runs stay together, a node's members are the n_convs ranks from its owner's on, and its subtree ends where the conversation
after them begins. Leaves and savings are differences of prefix sums over the places.

No key is hot: sorted tables are numbered by parts and offsets, running sums go by blocks of places, members of a node are summed by
salted parts which are then told the sum, and what all nodes of a long conversation ask for is told to its blocks. Only the hash of the
numbers of members that end at one node is made in one task, from a row for each LOT members, as its definition allows no other way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, settle, table

#: The contract's rebuilding: conversations of a block of ids share the first turns of the block's first one, fewer than SHARES of them.
GROUP = 5
SHARES = 9
SALTS = 64
#: Places of a block of a running sum, and depths of a long conversation's block.
BLOCK = 1 << 16
DEPTHS = 1 << 12
#: Members of a row of those that end at one node.
LOT = 256
_PLACE = (1 << 33) - 1  # monotonically_increasing_id: a partition's number, and a place in it


def sorted_table(df: DataFrame, order: list[Column], tie: Column | None = None) -> DataFrame:
    """df in one order over all partitions, cut off its lineage, with _pid (partition) and _idx (place in it)."""
    keys = [*order, tie] if tie is not None else order
    rows = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    rows = settle(rows.withColumn("_at", F.monotonically_increasing_id()))
    return rows.withColumn("_pid", F.shiftright("_at", 33)).withColumn("_idx", F.col("_at").bitwiseAND(_PLACE)).drop("_at")


def running(df: DataFrame, place: str, values: dict[str, str], keys: tuple[str, ...] = (), xor: bool = False) -> DataFrame:
    """df with the running sums (or exclusive ors) of the values over the rows of the same keys at earlier places; an exclusive or takes the
    row's own value in. Places are numbers from 0, nearly without gaps. Rows are summed by blocks of places, and blocks by blocks of blocks."""
    fold = F.bit_xor if xor else F.sum
    zero = F.lit(0).cast("long")
    rows = df.withColumn("_b", F.floor(F.col(place) / BLOCK).cast("long"))
    own = Window.partitionBy(*keys, "_b").orderBy(place).rowsBetween(Window.unboundedPreceding, 0 if xor else -1)
    inner = rows.select("*", *(F.coalesce(fold(v).over(own), zero).alias(f"_in_{out}") for out, v in values.items()))
    blocks = rows.groupBy(*keys, "_b").agg(*(fold(v).alias(f"_t_{out}") for out, v in values.items()))
    sup = F.floor(F.col("_b") / BLOCK).cast("long")
    before = Window.partitionBy(*keys, "_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_s", sup)
    tops = blocks.groupBy(*keys, "_s").agg(*(fold(f"_t_{out}").alias(f"_u_{out}") for out in values))
    above = Window.partitionBy(*keys, F.lit(0)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 2^32 places
    tops = tops.select(*keys, "_s", *(F.coalesce(fold(f"_u_{out}").over(above), zero).alias(f"_v_{out}") for out in values))
    blocks = blocks.select(*keys, "_s", "_b", *(F.coalesce(fold(f"_t_{out}").over(before), zero).alias(f"_w_{out}") for out in values)).join(tops, [*keys, "_s"])
    plus = lambda a, b: a.bitwiseXOR(b) if xor else a + b
    blocks = blocks.select(*keys, "_b", *(plus(F.col(f"_v_{out}"), F.col(f"_w_{out}")).alias(f"_v_{out}") for out in values))
    joined = inner.join(blocks, [*keys, "_b"])
    return joined.select(*df.columns, *(plus(F.col(f"_v_{out}"), F.col(f"_in_{out}")).alias(out) for out in values))


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, at, h1, h2, size): the turns of each conversation, numbered from 0 by turn (null first; equal ones by a hash of
    role and text), as two hashes and the text's bytes. Rows without a conv_id are left out; null roles and texts are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit("second"), role, text).alias("h2"), F.octet_length(text).cast("long").alias("size")
    ).where("conv_id is not null")
    rows = sorted_table(rows, [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("h1").asc(), F.col("h2").asc()], F.rand(13).asc())
    own = Window.partitionBy("conv_id", "_pid").orderBy("_idx")
    parts = rows.groupBy("conv_id", "_pid").agg(F.count("*").alias("n"))
    begins = parts.select("conv_id", "_pid", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    rows = rows.withColumn("k", F.row_number().over(own) - 1).join(begins, ["conv_id", "_pid"])
    return rows.select("conv_id", (F.col("begin") + F.col("k")).alias("at"), "h1", "h2", "size")


def rebuilt(told: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, size) of numbered turns: each conversation begins with the first h turns of the first one of its block
    (conv_id - conv_id % GROUP), h being crc32(conv_id) % SHARES, and goes on with its own turns after its first h. Depths are from 1; a
    row of depth 0 stands for each conversation, also those without turns."""
    h = F.crc32(F.col("conv_id").cast("string")) % SHARES
    lengths = settle(told.groupBy("conv_id").agg((F.max("at") + 1).alias("length")))
    ids = lengths.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", h)
    known = lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    ids = ids.join(known, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_length", F.lit(0))))
    first = told.where(F.col("at") < SHARES - 1).withColumnRenamed("conv_id", "base")  # at most SHARES - 1 of a conversation
    heads = ids.select("conv_id", "base", "h").join(first, "base").where("at < h").select("conv_id", (F.col("at") + 1).alias("depth"), "h1", "h2", "size")
    block = F.floor(F.col("at") / DEPTHS).cast("long")
    shares = ids.where("length > h").select("conv_id", "h", "shared", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / DEPTHS).cast("long"))).alias("block"))
    own = told.withColumn("block", block).join(shares, ["conv_id", "block"]).where("at >= h")
    own = own.select("conv_id", (F.col("shared") + F.col("at") - F.col("h") + 1).alias("depth"), "h1", "h2", "size")
    zero = F.lit(0).cast("long")
    return heads.union(own).union(lengths.select("conv_id", zero, zero, zero, zero))


def _ends(convs: DataFrame) -> DataFrame:
    """(owner, depth, ends): the hash of the members that end at a node."""
    number = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    lots = convs.groupBy("owner", F.col("length").alias("depth"), F.floor(F.col("rank") / LOT).alias("lot")).agg(number.alias("ids"))  # LOT at most
    lots = settle(lots.withColumn("lots", F.count("*").over(Window.partitionBy("owner", "depth"))))
    few = lots.where("lots = 1").select("owner", "depth", F.sha2(F.col("ids").cast("binary"), 256).alias("ends"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        made = lambda: pa.RecordBatch.from_pydict({"owner": [now[0]], "depth": [now[1]], "ends": [state.hexdigest()]}, pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends", pa.string())]))
        for b in batches:
            for owner, depth, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != (owner, depth):
                    if now:
                        yield made()
                    now, state = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if now:
            yield made()

    many = lots.where("lots > 1").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "lot")
    return few.union(many.select("owner", "depth", "ids").mapInArrow(hashes, "owner long, depth long, ends string"))


def prefix_trie(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end) of every node.

    paths has (conv_id, depth, h1, h2, size): a row of depth 0 for each conversation, and its turns from depth 1 on without gaps.
    preorder is the node's place, and subtree_end that of the first node after its subtree. No paths give no nodes.
    """
    place = [F.xxhash64("depth", "h1", "h2"), F.xxhash64("h2", "depth", "h1")]
    rows = paths.select("conv_id", "depth", "size", *(F.when(F.col("depth") > 0, c).otherwise(0).alias(n) for c, n in zip(place, ("t1", "t2"), strict=True)))
    rows = running(settle(rows), "depth", {"g1": "t1", "g2": "t2"}, ("conv_id",), xor=True)
    rows = settle(rows.select("conv_id", "depth", "size", "g1", "g2", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int").alias("salt")))
    node = ["depth", "g1", "g2"]
    parts = rows.groupBy(*node, "salt").agg(F.min("conv_id").alias("m"), F.count("*").alias("n"), F.max("size").alias("size"))
    nodes = settle(parts.groupBy(*node).agg(F.min("m").alias("owner"), F.sum("n").alias("n"), F.max("size").alias("size"), F.collect_list("salt").alias("salts")))  # SALTS at most

    shared = nodes.where("n > 1").select(*node, "owner", F.explode("salts").alias("salt"))
    runs = rows.join(shared, [*node, "salt"]).where("owner <> conv_id").groupBy("conv_id", "owner").agg(F.min("depth").alias("b"), F.max("depth").alias("e"))
    path = F.sort_array(F.collect_list(F.struct("b", "owner")))
    branches = runs.groupBy("conv_id").agg(path.alias("path"), (F.max("e") + 1).alias("branch"))  # see the docstring
    convs = rows.groupBy("conv_id").agg(F.max("depth").alias("length")).join(branches, "conv_id", "left")
    convs = convs.withColumn("branch", F.coalesce("branch", F.lit(0).cast("long")))
    steps = F.transform(F.coalesce("path", F.array().cast("array<struct<b:bigint,owner:bigint>>")), lambda p: F.struct((-p["b"]).alias("b"), p["owner"].alias("owner")))
    key = F.concat(steps, F.array(F.struct((-F.col("branch")).alias("b"), F.col("conv_id").alias("owner"))))
    convs = convs.select("conv_id", "length", "branch", F.try_element_at("path", F.lit(-1))["owner"].alias("parent"), key.alias("key"), F.greatest(F.lit(0).cast("long"), F.col("length") - F.col("branch") + 1).alias("own"))
    convs = sorted_table(convs, [F.col("key").asc()]).drop("key")
    sums = convs.groupBy("_pid").agg(F.count("*").alias("n"), F.sum("own").alias("own"))  # a row for each partition
    earlier = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_pid", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", "own")))
    inside = Window.partitionBy("_pid").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
    convs = convs.withColumn("start", F.coalesce(F.sum("own").over(inside), F.lit(0))).join(offsets, "_pid")
    convs = settle(convs.select("conv_id", "length", "branch", "parent", "own", (F.col("_n") + F.col("_idx")).alias("rank"), (F.col("_own") + F.col("start")).alias("start"), F.when(F.col("own") > 0, F.col("conv_id")).otherwise(F.col("parent")).alias("owner")))

    block = F.floor(F.col("depth") / DEPTHS).cast("long")
    deep = lambda c: F.floor(F.col(c) / DEPTHS).cast("long")
    of_owner = convs.where("own > 0").select("owner", "rank", "start", "branch", "length", "parent", F.explode(F.sequence(deep("branch"), deep("length"))).alias("block"))
    children = convs.where("own > 0 and parent is not null").groupBy(F.col("parent").alias("owner"), (F.col("branch") - 1).alias("depth")).agg(F.count("*").alias("branches"))
    tree = nodes.select("owner", "depth", "n", "size", block.alias("block")).join(of_owner, ["owner", "block"]).join(children, ["owner", "depth"], "left").join(_ends(convs), ["owner", "depth"], "left")
    tree = tree.select(
        "owner", "depth", "n", "block", "rank", "branch", (F.col("start") + F.col("depth") - F.col("branch")).alias("preorder"), ((F.col("n") - 1) * F.col("size")).alias("saving"),
        F.when(F.col("depth") > F.col("branch"), F.col("owner")).otherwise(F.col("parent")).alias("parent"), (F.coalesce("branches", F.lit(0)) + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"), F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends"),
    )
    tree = settle(tree).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    tree = settle(running(tree, "preorder", {"leaves": "leaf", "saved": "saving"}))
    last = tree.agg(F.count("*").alias("end"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saving"), F.lit(0)).alias("saved")).first()

    # The conversation after a node's members may own no nodes itself; its start is the place of the next node all the same.
    starts = tree.where("depth = branch").select(F.col("preorder").alias("_end"), F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    tree = tree.withColumn("after", F.col("rank") + F.col("n"))
    asked = tree.where("n > 1").select("owner", "block", "after").distinct()  # a row for each block of depths
    asked = asked.join(convs.select(F.col("rank").alias("after"), F.col("start").alias("_end")), "after").join(starts, "_end", "left")
    tree = tree.join(asked, ["owner", "block", "after"], "left")
    alone = F.col("n") == 1
    from_ = lambda c, mine: (F.coalesce(f"_{c}", F.lit(last[c])) - F.col(mine)).cast("long")
    tree = tree.join(of_owner.select("owner", "block", (F.col("length") + 1).alias("chain")), ["owner", "block"])
    chain = F.col("preorder") + F.col("chain") - F.col("depth")
    return tree.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.when(alone, 1).otherwise(from_("leaves", "leaves")).alias("n_leaves"), F.when(alone, 0).otherwise(from_("saved", "saved")).alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"), "preorder", F.when(alone, chain).otherwise(F.coalesce("_end", F.lit(last["end"]))).alias("subtree_end"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = settle(turns(table(spark, sf_dir, "conversations")))
    return prefix_trie(rebuilt(told)).drop("preorder", "subtree_end")


# The sixteen constants of CRC-32 by four bits, of the polynomial EDB88320 (reflected).
_CRC = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_NIBBLE = lambda x: f"xor({_CRC}[(({x}) & 15) + 1], ({x}) >> 4)"
_CRC_SQL = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {_NIBBLE(_NIBBLE('xor(c, b)'))}))"

ORACLE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS w, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_CRC_SQL} % {SHARES} AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
r AS (SELECT i.conv_id, 0 AS own, t.place, w, size FROM ids i JOIN t ON t.conv_id = i.base AND t.place < i.h UNION ALL SELECT i.conv_id, 1, t.place, w, size FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.place >= i.h),
p AS (SELECT conv_id, row_number() OVER x AS depth, size, md5(string_agg(w, ',') OVER x) AS p FROM r WINDOW x AS (PARTITION BY conv_id ORDER BY own, place ROWS UNBOUNDED PRECEDING) UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
q AS MATERIALIZED (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
n AS MATERIALIZED (SELECT p, depth, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n, any_value(size) AS size, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM q GROUP BY p, depth),
k AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM n c WHERE c.up = n.p AND c.depth = n.depth + 1) AS kids FROM n),
s AS (SELECT q.p, q.depth, sum((k.n - 1) * k.size)::BIGINT AS saved, count(*) FILTER (k.kids = 0) AS leaves FROM k JOIN q ON q.conv_id = k.conv_id AND q.depth <= k.depth GROUP BY q.p, q.depth)
SELECT k.conv_id, k.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, k.n AS n_convs, k.kids AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, k.ends AS ends_sha256
FROM k JOIN s ON s.p = k.p AND s.depth = k.depth LEFT JOIN n u ON u.p = k.up AND u.depth = k.depth - 1
"""
