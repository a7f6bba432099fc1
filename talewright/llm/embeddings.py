"""Embedding near-duplicates by cross-polytope hashing.

A vector is padded to a power of two and turned by a fast pseudo-random rotation (three rounds of random signs and a
Hadamard transform). Its cross-polytope hash is the axis, with its sign, that it then lies nearest to. A table of the
index joins several such hashes to a bucket; multiprobe posts a vector in the buckets of its next nearest axes too.
Vectors that share a bucket are candidates, and every candidate pair is verified by its cosine in double precision.

Equal vectors are one point with a weight. Buckets with one point go before anything is compared. A posting brings a sketch of its
vector along, some rotated coordinates in a byte each and the length of the rest, which gives a bound of the cosine of two vectors. In
buckets of BLOCK points at most, postings go whose bound with all others there is below the threshold: no link is lost, and hardly any
posting of unlike vectors is left. So buckets may hold several unlike vectors each (MEAN), and the number of hashes and tables grows the later. In a large bucket the
points within half the threshold's angle of one pivot form a ball: any two of them are linked, so a large group of near
copies is counted without comparing its pairs. What is left is compared block by block, each block pair a matrix product
in some task, so a hot bucket spreads over the cluster. A task returns links counted per point and a spanning forest of
them, never the pairs. A pair that meets in several buckets counts in the first.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .components import connected_components

THRESHOLD = 0.9
TABLES = 12
#: Next nearest axes that are probed beside the nearest, for each hash of a table in turn.
PROBES = 2
#: Points of one block of a bucket.
BLOCK = 256
#: Rows that small buckets are packed to, so that a task compares many at once. Buckets go to packs by their least point, as groups
#: of near copies share many buckets: a pack gets each vector once, with the list of its buckets there.
PACK = 2000
#: Postings of small buckets that are sifted at once.
LOT = 5_000
SEED = 2
#: Unlike vectors of a bucket, on average, at most.
MEAN = 16
#: Rotated coordinates of a sketch.
SKETCH = 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        pairs = x.reshape(len(x), -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def codes(x: np.ndarray, hashes: int, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables * buckets of each): 64-bit hashes of the bucket of each table and choice of axes."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng = np.random.default_rng(seed)
    out = []
    for t in range(tables):
        ranked = []
        for _ in range(hashes):
            turned = rotate(x, rng)
            both = np.concatenate([turned, -turned], 1)
            best = np.argpartition(-both, probes, axis=1)[:, : probes + 1]
            ranked.append(np.take_along_axis(best, np.argsort(-np.take_along_axis(both, best, 1), axis=1, kind="stable"), 1))
        choices = [[0] * hashes] + [[p if i == j else 0 for i in range(hashes)] for j in range(hashes) for p in range(1, probes + 1)]
        for choice in choices:
            code = np.full(len(x), (t + 1) * 0xD1342543DE82EF95 % 2**64, np.uint64)  # far from those of the other tables, whatever axis comes first
            for r, p in zip(ranked, choice, strict=True):
                code = (code ^ r[:, p].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
            out.append(code.view(np.int64))
    return np.stack(out, 1)


def sketches(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """(rows, coordinates + 1) bytes of unit vectors: the first SKETCH coordinates of a rotation, and the length of the others, rounded up."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    part = rotate(np.pad(x, ((0, 0), (0, d - x.shape[1]))), np.random.default_rng(seed + 1))[:, :SKETCH]
    rest = np.sqrt(np.maximum(0, 1 - (part * part).sum(1)) + 1e-12)
    whole = np.concatenate([np.rint(part * 127), np.ceil(np.minimum(rest, 1) * 127)[:, None]], 1)
    return np.clip(whole, -127, 127).astype(np.int8)


def may_link(s: np.ndarray) -> np.ndarray:
    """Which pairs of vectors may have a cosine of THRESHOLD, by their sketches: all that have it, and few others. The cosine is at most the
    product of the coordinates and that of the lengths of the rest; rounding moves each coordinate by 1/254 at most."""
    off = math.sqrt(s.shape[1] - 1) / 254
    v = s.astype(np.float32) / np.float32(127)
    return v @ v.T + (2 * off + off * off + 1e-5) >= THRESHOLD


def hashes_for(points: int, dimension: int, probes: int = PROBES) -> int:
    """Hashes of a table: as many as keep the mean bucket of unlike vectors at MEAN points or fewer, whatever their number."""
    axes, hashes = 2 << max(1, (dimension - 1).bit_length()), 1
    while MEAN * axes**hashes < points * (1 + probes * hashes):
        hashes += 1
    return hashes


def tables_for(hashes: int) -> int:
    """Tables of the index: vectors at the threshold share a bucket of a table the more rarely, the more hashes it joins. (With
    them, 0.99 of such pairs of 64 dimensions share some bucket at one to six hashes, and more of closer ones.)"""
    return TABLES if hashes <= 3 else TABLES * 2 ** (hashes - 3)


def _units(values: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in values])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that links reach from each of n numbers."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _compare(t: pa.Table, tables: int) -> pa.Table:
    """Links of packed block pairs: for each point the weight linked to it, and its root in the pack's forest."""
    t = t.combine_chunks().sort_by("rep")
    reps, weight, ball = (t[c].to_numpy() for c in ("rep", "weight", "ball"))
    x = _rows(t["embedding"])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    keys = _rows(t["keys"])
    items = t["items"].combine_chunks()
    at = np.repeat(np.arange(len(reps)), np.diff(items.offsets.to_numpy()))
    k, block, b1, b2 = (items.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "b1", "b2"))
    names = np.unique(np.concatenate((block, b1, b2)).astype(str), return_inverse=True)[1].reshape(3, -1)
    order = np.lexsort((at, *names[[0, 2, 1]], k))
    k, at, (block, b1, b2) = k[order], at[order], names[:, order]
    links, ends = np.zeros(len(reps), np.int64), []
    edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1]))))
    for s, e in zip(edge, np.append(edge[1:], len(k)), strict=True):
        left = at[s:e][block[s:e] == b1[s]]
        if b1[s] == b2[s]:
            i, j = np.nonzero(np.triu(x[left] @ x[left].T >= THRESHOLD, 1))
            i, j = left[i], left[j]
        else:
            right = at[s:e][block[s:e] == b2[s]]
            i, j = np.nonzero(x[left] @ x[right].T >= THRESHOLD)
            i, j = left[i], right[j]
        apart = ball[i] != ball[j]
        i, j = i[apart], j[apart]
        if len(i):
            ends.append((i, j))
            for a in range(0, len(i), 4096):
                p, q = i[a : a + 4096], j[a : a + 4096]
                first = _first_shared(keys[p], keys[q], tables) == k[s]
                np.add.at(links, p[first], weight[q[first]])
                np.add.at(links, q[first], weight[p[first]])
    if not ends:
        return pa.table({"rep": reps[:0], "links": links[:0], "root": reps[:0]})
    i, j = (np.concatenate(c) for c in zip(*ends, strict=True))
    seen = np.unique(np.concatenate((i, j)))
    root = _forest(len(reps), i, j)
    return pa.table({"rep": reps[seen], "links": links[seen], "root": reps[root[seen]]})


def _sifted(t: pa.Table) -> pa.Table:
    """The postings of whole small buckets without those that may link with no other of their bucket; low is the least point that is left."""
    t = t.combine_chunks().sort_by("key")
    key, rep = (t[c].to_numpy() for c in ("key", "rep"))
    s = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.int8).reshape(len(key), -1)
    kept, low = np.zeros(len(key), bool), rep.copy()
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    for a, b in zip(edge, np.append(edge[1:], len(key)), strict=True):
        if b - a > 1:
            near = may_link(s[a:b])
            np.fill_diagonal(near, False)
            kept[a:b] = some = near.any(1)
            if some.any():
                low[a:b] = rep[a:b][some].min()
    return t.select(["rep", "key", "n"]).append_column("low", pa.array(low)).filter(pa.array(kept))


def _first_shared(a: np.ndarray, b: np.ndarray, tables: int) -> np.ndarray:
    """The least bucket number that each pair of rows has in common (they have one)."""
    low = np.full(len(a), np.iinfo(np.int64).max)
    step = a.shape[1] // tables
    for t, (p, q) in itertools.product(range(tables), itertools.product(range(step), range(step))):
        u, v = a[:, t * step + p], b[:, t * step + q]
        low = np.where((u == v) & (u < low), u, low)
    return low


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold a null or a number that is not finite link with nothing; so do vectors
    without an id, whose component is null. Vectors of different lengths are compared within their length. n_links counts
    the other rows with a cosine of THRESHOLD or more that share a bucket; rows with an equal vector are linked. An empty
    table gives an empty one.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda c: c != 0), F.lit(False))
    v = settle(v.withColumn("good", good))
    points = settle(v.where("good").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    found = None
    for size, n in sorted((r.size, r.n) for r in points.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).collect()):
        part = _links(points.where(F.size("embedding") == size), hashes_for(n, size))
        found = part if found is None else found.union(part)
    if found is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = settle(found)
    components = connected_components(found, "rep", "root")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_point = points.join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    of_point = of_point.select("embedding", F.coalesce(F.col("component"), F.col("rep")).alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    of_point = of_point.select(F.col("embedding").alias("e"), "component", "links", F.lit(True).alias("is_good"))
    rows = v.join(of_point, F.col("good") & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(points: DataFrame, hashes: int) -> DataFrame:
    """(rep, links, root): verified links of points, per task that found some."""
    tables = tables_for(hashes)

    def post(batches):
        for b in batches:
            x = _units(b.column(1).to_pylist())
            c = codes(x, hashes, tables)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, c.shape[1]), pa.int32()), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), keys, pa.array([r.tobytes() for r in sketches(x)], pa.binary())], names=["rep", "keys", "sketch"])

    coded = settle(points.select("rep", "embedding").mapInArrow(post, "rep long, keys array<long>, sketch binary"))
    posts = coded.select("rep", "sketch", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select((F.col("key") + F.lit(0)).alias("k"), "n")
    met = posts.hint("merge").join(sizes, F.col("key") == F.col("k"))
    lots = F.pmod(F.xxhash64("key"), F.lit(max(1, coded.count() * tables * (1 + PROBES * hashes) // LOT)))
    small = met.where(F.col("n") <= BLOCK).select(lots.alias("lot"), "rep", "key", "n", "sketch")
    sifted = small.groupBy("lot").applyInArrow(_sifted, "rep long, key long, n long, low long")
    shared = settle(sifted.union(met.where(F.col("n") > BLOCK).select("rep", "key", "n", F.lit(0).cast("long").alias("low"))))  # low is of small buckets only
    balls = settle(_balls(shared.where(F.col("n") > BLOCK), points))
    sums = balls.join(points, "rep").groupBy("ball").agg(F.sum("weight").alias("total"), F.min("rep").alias("root")).select((F.col("ball") + F.lit(0)).alias("b"), "total", "root")
    inside = balls.join(points, "rep").hint("merge").join(sums, F.col("ball") == F.col("b")).select("rep", (F.col("total") - F.col("weight")).alias("links"), "root")

    shared = shared.join(balls, "rep", "left").withColumn("ball", F.coalesce("ball", "rep"))
    rows = settle(_blocks(shared))
    packs = max(1, rows.count() // PACK)
    pack = F.when(F.col("n") <= BLOCK, F.pmod(F.xxhash64("low"), F.lit(packs))).otherwise(F.xxhash64("key", "b1", "b2"))
    items = rows.groupBy(pack.alias("pack"), "rep", "ball").agg(F.collect_list(F.struct("key", "block", "b1", "b2")).alias("items"))  # the buckets of one point
    full = items.join(points, "rep").join(coded.select("rep", "keys"), "rep").select("pack", "rep", "ball", "embedding", "weight", "keys", "items")
    return inside.union(full.groupBy("pack").applyInArrow(lambda t: _compare(t, tables), "rep long, links long, root long"))


def _balls(hot: DataFrame, points: DataFrame) -> DataFrame:
    """(rep, ball): the points of the large buckets that lie within half the threshold's angle of a bucket's pivot, its
    least point. Two points of one ball are linked whatever their places, so they need not be compared. A point near
    several pivots belongs to the least."""
    pivots = hot.groupBy("key").agg(F.min("rep").alias("pivot")).select((F.col("key") + F.lit(0)).alias("k"), "pivot")
    pairs = hot.hint("merge").join(pivots, F.col("key") == F.col("k")).select("rep", "pivot").distinct()
    own, other = points.select("rep", F.col("embedding").alias("x")), points.select(F.col("rep").alias("pivot"), F.col("embedding").alias("y"))
    pairs = pairs.join(own, "rep").join(other, "pivot")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, c: t + c)
    cosine = dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))
    return pairs.where(cosine >= math.sqrt((1 + THRESHOLD) / 2) + 1e-9).groupBy("rep").agg(F.min("pivot").alias("ball"))


def _blocks(shared: DataFrame) -> DataFrame:
    """Rows (rep, key, n, ball, and low where there is one) once for each pair of blocks, b1 and b2, that their block of the bucket is compared in.

    A ball with more than BLOCK points in a bucket has blocks of its own, which are not compared with each other; all other
    points of the bucket are dealt to blocks that are compared with every block.
    """
    parts = shared.groupBy("key", "ball").agg(F.count("*").alias("m")).withColumn("part", F.when(F.col("m") > BLOCK, F.col("ball").cast("string")).otherwise(""))
    widths = parts.groupBy("key", "part").agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("width"))
    widths = widths.groupBy("key").agg(F.collect_list(F.struct("part", "width")).alias("widths"))  # a row for each BLOCK points at most, and one
    own = parts.select((F.col("key") + F.lit(0)).alias("k"), F.col("ball").alias("b"), "part").join(widths.select((F.col("key") + F.lit(0)).alias("k"), "widths"), "k")
    rows = shared.hint("merge").join(own, (F.col("key") == F.col("k")) & (F.col("ball") == F.col("b"))).drop("k", "b")
    width = F.filter("widths", lambda w: w["part"] == F.col("part"))[0]["width"]
    name = lambda part, i: F.concat_ws(":", part, i.cast("string"))
    rows = rows.withColumn("block", name(F.col("part"), F.pmod(F.xxhash64("rep"), width)))
    facing = F.filter("widths", lambda w: (w["part"] != F.col("part")) | (F.col("part") == ""))
    others = F.flatten(F.transform(facing, lambda w: F.transform(F.sequence(F.lit(0), w["width"] - 1), lambda i: name(w["part"], i))))
    kept = [c for c in ("rep", "key", "n", "low", "ball", "block") if c in rows.columns]
    rows = rows.select(*kept, F.explode(others).alias("other"))
    return rows.select(*kept, F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), g AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda c: c * c))) AS len FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda c: c IS NOT NULL AND isfinite(c))) AND list_bool_or(list_transform(e, lambda c: c <> 0))
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.9
), r(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) n USING (vec_id)
"""
