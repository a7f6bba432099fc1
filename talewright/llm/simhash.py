"""SimHash near-duplicates through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of their eight bytes, so they share six
positional bytes (a position and the byte there) at least: the guaranteed minimum of the count filter.

Lists of single positional bytes would hold one fingerprint in 256 each, and a tally over them would touch a share of all
pairs. So the index posts positional bytes four at a time: the eight positions form four pairs of neighbours, and a list is
keyed by the four bytes of two of the pairs, which makes six lists for each fingerprint. That loses nothing: whichever two
bytes differ, two of the pairs are whole, so every pair of fingerprints with six shared bytes meets in some list. And it
counts the same: a fingerprint is in the list of a positional byte exactly if it has that byte, so the number of single-byte
lists that two fingerprints share is the number of their equal bytes, which the posting itself tells. Where two postings meet,
the shared positional bytes are tallied, pairs with fewer than six go, and the rest are verified by their differing bits.

A list longer than ``MAX_LIST`` is not paired. Its members are posted once more, under every value that differs from
them in at most one of the 32 bits that the list leaves open. Members of one such value differ in two bits at most, so
all of them link, and two members that differ in two bits or fewer share one: the value halfway. That is exact, takes 33
rows a member, and a value never has more than 33 members. So both ways find the same components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .components import connected_components
from .embeddings import BLOCK, _blocks

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Bytes that two fingerprints within MAX_BITS share at least.
MIN_SHARED = 8 - MAX_BITS
#: Lists up to this length are paired, longer ones are posted again by their one-bit neighbours; in ``links`` both ways
#: are exact. ``similar_documents`` compares longer ones in blocks.
MAX_LIST = 48


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as a signed integer: ASCII-lower-cased words, word shingles with repeats, XXH64."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    packed = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for a in range(0, len(packed), 1 << 16):
        counts += np.unpackbits(packed[a : a + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(packed), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; a null, empty or blank text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in texts], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


#: Every choice of two of the four pairs of byte positions.
LISTS = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a in range(4) for b in range(a + 1, 4)]


def _keys(fp: Column) -> Column:
    keys = []
    for n, at in enumerate(LISTS):
        key = F.lit(n).cast("long")
        for i in at:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, i))
        keys.append(key)
    return F.array(*keys)


def shared_bytes(a: Column, b: Column) -> Column:
    """How many positional bytes two fingerprints share."""
    x = a.bitwiseXOR(b)
    tally = F.lit(0)
    for i in range(8):
        tally = tally + F.when(_byte(x, i) == 0, 1).otherwise(0)
    return tally


def links(fps: DataFrame) -> DataFrame:
    """(src, dst): edges among distinct fingerprints (column fp) that connect all pairs within MAX_BITS, and no others."""
    posts = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select((F.col("key") + F.lit(0)).alias("k"), "n")
    shared = settle(posts.hint("merge").join(sizes, F.col("key") == F.col("k")).select("key", "fp", "n"))
    small = shared.where(F.col("n") <= MAX_LIST)
    a, b = small.select("key", F.col("fp").alias("src")), small.select("key", F.col("fp").alias("dst"))
    near = (shared_bytes(F.col("src"), F.col("dst")) >= MIN_SHARED) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MAX_BITS)
    pairs = a.join(b, "key").where((F.col("src") < F.col("dst")) & near).select("src", "dst")

    masks = [[0, *(1 << bit for i in range(8) if i not in at for bit in range(8 * i, 8 * i + 8))] for at in LISTS]
    masks = F.array(*(F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in row)) for row in masks))
    around = shared.where(F.col("n") > MAX_LIST).select("fp", F.explode(F.element_at(masks, (F.shiftright("key", 32) + 1).cast("int"))).alias("mask"))
    around = around.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value")).distinct()
    stars = around.groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.explode("fps").alias("src"), F.array_min("fps").alias("dst")).where("src != dst")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest id that links of at most MAX_BITS differing bits reach, the row's own included. Equal
    fingerprints (copies) are one node of the graph and are never paired. Rows without an id get the component of their
    fingerprint (null if it has no id at all); repeated rows and ids stay as they are; an empty table gives an empty one.
    """
    rows = settle(fingerprints(docs, id_col, text_col))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    component = connected_components(links(fps.select("fp")))
    joined = fps.join(component, fps.fp == component.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    joined = settle(joined)
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id")).select((F.col("component") + F.lit(0)).alias("c"), "component_id")
    of_fp = joined.hint("merge").join(least, F.col("component") == F.col("c")).select((F.col("fp") + F.lit(0)).alias("f"), "component_id")
    return rows.hint("merge").join(of_fp, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


# Similarity of whole texts. Texts that are alike to 0.8 differ in about ten of 64 SimHash bits, and then no positional byte is
# sure to be shared. So the same index is fed with bytes that are shared as often as texts are alike: byte i comes from
# the smallest of the shingles' hashes under the i-th mixing.

SIMILARITY = 0.8
TEXT_SHINGLE = 5
POSITIONS = 48
#: Shared bytes that a candidate pair needs: pairs of similarity 0.8 share 38.4 on average and fewer than 28 once in 5,000.
MIN_POSITIONS = 28
_ODD = np.random.default_rng(11).integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes | None, shingle: int = TEXT_SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles of a text, lower-cased in ASCII; of the whole sequence if it has fewer words."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def positional_bytes(hashes: np.ndarray) -> bytes:
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[a : a + 4096, None] * _ODD).min(0))
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common shingles of two sorted sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, sig): node is the same for equal sets of shingles, sig holds the positional bytes as six longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sigs = [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                h = shingle_hashes(t)
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63))
                sigs.append(np.frombuffer(positional_bytes(h), "<i8"))
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, POSITIONS // 8), pa.int32()), flat)], names=["doc_id", "node", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, node long, sig array<long>")


def _lists(nodes: DataFrame) -> DataFrame:
    """(key, node, sig, n): the nodes (node, sig) in twelve lists of four positional bytes each, and the lists' lengths."""
    word = lambda i: F.shiftrightunsigned(F.col("sig")[i // 2], 32 * (i % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
    keys = F.array(*(word(i).bitwiseOR(F.lit(i << 32)) for i in range(POSITIONS // 4)))
    posts = nodes.select("node", "sig", F.explode(keys).alias("key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select((F.col("key") + F.lit(0)).alias("k"), "n")
    return settle(posts.hint("merge").join(sizes, F.col("key") == F.col("k")).select("key", "node", "sig", "n"))


def _candidates(shared: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes that may be alike, from the lists.

    A list up to MAX_LIST is paired. In a longer one (a large group of near copies) every member is paired with two only: the
    one that meets most others over all its lists, as the text that the group derives from does, and the least. What
    these do not link is left to ``_rest``.
    """
    alike = sum((shared_bytes(F.col("sig_a")[i], F.col("sig_b")[i]) for i in range(POSITIONS // 8)), F.lit(0)) >= MIN_POSITIONS
    small = shared.where(F.col("n") <= MAX_LIST)
    left, right = small.select("key", F.col("node").alias("a"), F.col("sig").alias("sig_a")), small.select("key", F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & alike).select("a", "b")
    large = shared.where(F.col("n") > MAX_LIST)
    met = shared.groupBy("node").agg(F.sum("n").alias("met")).select((F.col("node") + F.lit(0)).alias("m"), "met")
    large = large.hint("merge").join(met, F.col("node") == F.col("m"))
    heads = large.groupBy("key").agg(F.array_distinct(F.array(F.max_by(F.struct("node", "sig"), F.struct("met", "node")), F.min_by(F.struct("node", "sig"), "node"))).alias("heads"))
    stars = large.hint("merge").join(heads.select((F.col("key") + F.lit(0)).alias("k"), F.explode("heads").alias("h")), F.col("key") == F.col("k"))
    stars = stars.select("node", F.col("sig").alias("sig_a"), F.col("h.node").alias("other"), F.col("h.sig").alias("sig_b")).where((F.col("node") != F.col("other")) & alike)
    return pairs.union(stars.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))).distinct()


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of left shares with each of right, as products of 0/1 matrices by parts of the elements."""
    x, y = np.concatenate(left), np.concatenate(right)
    known = np.intersect1d(x, y)
    counts = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for flat, sets in ((x, left), (y, right)):
        at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        mine = known[at] == flat if len(known) else np.zeros(len(flat), bool)
        order = np.argsort(at[mine], kind="stable")
        sides.append((row[mine][order], at[mine][order], len(sets)))
    for a in range(0, len(known), 4096):
        part = []
        for row, at, n in sides:
            of = slice(*np.searchsorted(at, (a, a + 4096)))
            m = np.zeros((n, min(4096, len(known) - a)), np.float32)
            m[row[of], at[of] - a] = 1
            part.append(m)
        counts += part[0] @ part[1].T
    return counts.astype(np.int64)


def _block_links(table: pd.DataFrame, least: float) -> pd.DataFrame:
    """(src, dst): components that pairs of texts alike to least link, as a forest for each pair of blocks."""
    hashes: dict[int, np.ndarray] = {}
    found: set[tuple[int, int]] = set()
    for (key, b1, b2), t in table.groupby(["key", "b1", "b2"], sort=False):
        t = t.reset_index(drop=True)
        sig = np.array(t["sig"].tolist(), np.int64).view(np.uint8).reshape(-1, POSITIONS)
        ball = t["ball"].to_numpy()
        size = np.zeros(len(t), np.int64)
        for i, (node, text) in enumerate(zip(t["rep"].tolist(), t["text"], strict=True)):
            if node not in hashes:
                hashes[node] = shingle_hashes(text)
            size[i] = len(hashes[node])
        left, right = (np.flatnonzero((t["block"] == b).to_numpy()) for b in (b1, b2))
        if not len(left) or not len(right):
            continue
        earlier = sig.view("<u4")[:, : key >> 32]  # a pair that shares an earlier list is compared there
        todo = np.zeros((len(left), len(right)), bool)
        for i, a in enumerate(left):
            ok = (ball[right] != ball[a]) & (np.minimum(size[right], size[a]) / np.maximum(size[right], size[a]) >= least)
            if b1 == b2:
                ok &= right > a
            ok[ok] = ~(earlier[right[ok]] == earlier[a]).any(1) & ((sig[right[ok]] == sig[a]).sum(1) >= MIN_POSITIONS)
            todo[i] = ok
        rows, cols = np.flatnonzero(todo.any(1)), np.flatnonzero(todo.any(0))
        if not len(rows):
            continue
        nodes = t["rep"].to_numpy()
        common = _common([hashes[n] for n in nodes[left[rows]].tolist()], [hashes[n] for n in nodes[right[cols]].tolist()])
        union = size[left[rows]][:, None] + size[right[cols]] - common
        root: dict[int, int] = {}
        for i, j in np.argwhere(todo[np.ix_(rows, cols)] & (common / union >= least)).tolist():
            a, b = int(ball[left[rows[i]]]), int(ball[right[cols[j]]])
            x, y = a, b
            while x in root:
                x = root[x]
            while y in root:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                found.add((a, b))
    return pd.DataFrame(list(found), columns=["src", "dst"], dtype="int64")


def _rest(shared: DataFrame, joined: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float) -> DataFrame | None:
    """(src, dst): components among ``joined`` that further pairs in the lists over MAX_LIST link, or None if there are no such.

    Every pair of a long list is compared on the whole texts, save those of one component already, those with fewer than
    MIN_POSITIONS common bytes (as in short lists) and those that another list compares. The list is cut into blocks,
    each pair of blocks is compared in a group of its own; a large component is never compared with itself.
    """
    of_node = joined.select(F.col("node").alias("c_node"), F.col("component").alias("ball"))
    long = shared.where(F.col("n") > MAX_LIST).select("key", F.col("node").alias("rep"), "n").hint("merge").join(of_node, F.col("rep") == F.col("c_node")).drop("c_node")
    mixed = long.groupBy("key").agg(F.min("ball").alias("low"), F.max("ball").alias("high")).where("low != high").select((F.col("key") + F.lit(0)).alias("k"))
    long = settle(long.hint("merge").join(mixed, F.col("key") == F.col("k")).drop("k"))
    if long.isEmpty():
        return None
    rows = settle(_blocks(long))
    packs = max(1, rows.count() // BLOCK)
    pack = F.when(F.col("n") <= BLOCK, F.pmod(F.xxhash64("key"), F.lit(packs))).otherwise(F.xxhash64("key", "b1", "b2"))
    texts = settle(texts_of(rows.select(F.col("rep").alias("node")).distinct()))
    sigs = shared.select("node", "sig").dropDuplicates(["node"]).join(texts, "node").withColumnRenamed("node", "t_node")
    full = rows.hint("merge").join(sigs, F.col("rep") == F.col("t_node")).select(pack.alias("pack"), "rep", "key", "ball", "block", "b1", "b2", "sig", F.col("text").cast("binary").alias("text"))
    links = settle(full.groupBy("pack").applyInPandas(lambda t: _block_links(t, least), "src long, dst long"))
    return None if links.isEmpty() else links


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for every row: documents whose sets of five-word shingles are alike to ``least`` or more are
    linked, and component_id is the smallest id that links reach. Candidate pairs are verified on their whole texts.

    Equal sets are one node. Texts without words are alike. Rows without an id get the component of their set (null if it has no id at
    all); repeated rows stay; an empty table gives an empty one.
    """
    rows = settle(signatures(docs, id_col, text_col))
    nodes = settle(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    shared = _lists(nodes.where("rep IS NOT NULL").select("node", "sig"))
    pairs = settle(_candidates(shared))

    def texts_of(wanted: DataFrame) -> DataFrame:
        needed = wanted.join(nodes.select("node", "rep"), "node")
        texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
        return texts.join(needed.hint("shuffle_hash"), "rep").groupBy("node").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))

    texts = settle(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            alike = [similarity(shingle_hashes(p), shingle_hashes(q)) >= least for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["src", "dst"]).filter(pa.array(alike, pa.bool_()))

    component = connected_components(both.select("a", "b", "x", "y").mapInArrow(verify, "src long, dst long"))
    joined = settle(nodes.select("node", "rep").join(component.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left").select("node", "rep", F.coalesce("component", "node").alias("component")))
    more = _rest(shared, joined, texts_of, least)
    if more is not None:
        wider = connected_components(more).select(F.col("node").alias("c_node"), F.col("component").alias("wider"))
        joined = settle(joined.hint("merge").join(wider, F.col("component") == F.col("c_node"), "left").select("node", "rep", F.coalesce("wider", "component").alias("component")))
    best = joined.groupBy("component").agg(F.min("rep").alias("component_id")).select((F.col("component") + F.lit(0)).alias("c"), "component_id")
    of_node = joined.hint("merge").join(best, F.col("component") == F.col("c")).select((F.col("node") + F.lit(0)).alias("n"), "component_id")
    return rows.hint("merge").join(of_node, F.col("node") == F.col("n")).select("doc_id", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
