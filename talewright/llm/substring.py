"""Exact substring deduplication with fixed-block anchors.

A run of ``window`` words always holds a whole block of ``window // 2`` words that starts at a multiple of that length,
wherever it stands in a document. So the non-overlapping blocks of every document are the index, and every rolling
window of the block's length is a probe. A block that another document's probe meets is an anchor. Around the anchors
the runs of ``window`` words are compared by 96-bit hashes, each with the smallest id it starts in; overlapping runs that
start in an earlier document merge to the maximal repeats, which go.

Documents are dealt to batches of about BATCH_BYTES by a hash of id and text, so the number of batches follows the data and
a task holds no more text at once, whatever the settings. What the batches tell each other goes through two exchanges, of
anchors and of runs, as sorted binary blocks, one for each batch and range of hash values; empty blocks are not sent, so
there are never more of them than words. Each batch sends a value once, so a passage that stands in a third of all documents
costs a few bytes a batch, and no task ever holds the places where a value occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

WINDOW = 50
#: Ids of rows without one: after all others.
NO_ID = (1 << 63) - 1
#: Bytes of text of a batch, on average; a worker holds one batch at a time. Longer texts are batches of their own size.
BATCH_BYTES = 32 << 20
#: Batches for each shuffle partition at least, so that all tasks have work.
BATCHES = 2
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
#: Bits of an anchor's hash beside its range. A chance hit only costs comparing a run that is no repeat.
ANCHOR_BITS = 40

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1 << max(10, (n - 1).bit_length()), np.uint64)
        have[1:] = np.uint64(base)
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    lengths = ends - starts
    at = np.flatnonzero(word)
    begin = np.cumsum(lengths) - lengths
    if len(starts):
        local = np.arange(len(at)) - np.repeat(begin, lengths)
        terms = _BYTES[data[at]] * _powers(_BASE, int(lengths.max()))[local]
        hashes = _mix(np.add.reduceat(terms, begin) + lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    else:
        hashes = np.zeros(0, np.uint64)
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def rolling(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, len(hashes)))))
    inverse = pow(base, -1, 1 << 64)
    return _mix((sums[n:] - sums[:-n]) * _powers(inverse, len(hashes) - n + 1))


class _Batch:
    """The documents of a batch as word hashes."""

    def __init__(self, texts: list[bytes]):
        parts, counts, group, held = [], [], [], 0
        for t in texts:
            group.append(t)
            held += len(t)
            if held > CHUNK:
                h, c = word_hashes(group)
                parts.append(h), counts.append(c)
                group, held = [], 0
        if group:
            h, c = word_hashes(group)
            parts.append(h), counts.append(c)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.cumsum(self.counts) - self.counts

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all runs of n words within a document, and the number of each one's document."""
        doc = np.repeat(np.arange(len(self.counts)), np.maximum(self.counts - n + 1, 0))
        inner = np.maximum(self.counts - n + 1, 0)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(inner) - inner, inner) + self.first[doc]
        return at, doc

    def anchors(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value, place and document of each rolling window of n words."""
        at, doc = self.runs(n)
        return rolling(self.words, n, _BASE ^ 0x1234568)[at] if len(at) else np.zeros(0, np.uint64), at, doc

    def keys(self, n: int, at: np.ndarray) -> np.ndarray:
        """96 bits of the runs of n words at the places given, as (high, low)."""
        out = np.zeros(len(at), [("a", "<u8"), ("b", "<u4")])
        if len(at):
            out["a"] = rolling(self.words, n, _BASE ^ 0x2345678)[at]
            out["b"] = (rolling(_mix(self.words ^ np.uint64(0xA0761D6478BD642F)), n, _BASE ^ 0x3456788)[at] >> np.uint64(32)).astype(np.uint32)
        return out


def _texts(t: pa.Table) -> list[bytes]:
    return [x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()]


def _ids(t: pa.Table) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in t.column("doc_id").to_pylist()], np.int64)


def _first_of(values: np.ndarray) -> np.ndarray:
    """Places of the first of each run of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))


def _pack(sorted_values: np.ndarray) -> bytes:
    """Differences of sorted numbers below 2 ** 40, all first bytes, all second bytes and so on."""
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(5, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :5] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's text without the runs of ``window`` words that start in a row with
    a smaller id.

    Words are maximal runs without ASCII white space, unchanged; kept words are joined by one space. Null, empty and short
    texts lose nothing. Rows without an id come after all others and are returned with a null id; rows that share an id
    take nothing from each other. An empty table gives an empty one; other columns are left out.
    """
    block = window // 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(BATCHES * partitions(docs.sparkSession), -(-held // BATCH_BYTES))
    bits = min(64 - ANCHOR_BITS, max(8, (n // BATCHES - 1).bit_length()))
    ranges = 1 << bits
    rest = np.uint64(ANCHOR_BITS)
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def anchor_of(values: np.ndarray) -> np.ndarray:
        return values >> np.uint64(64 - bits - ANCHOR_BITS)

    def probe(t: pa.Table) -> pa.Table:
        b = _Batch(_texts(t))
        values, at, doc = b.anchors(block)
        values = anchor_of(values)
        order = np.argsort(values, kind="stable")
        values, doc, index = values[order], doc[order], ((at - b.first[doc]) % block == 0)[order]
        first = _first_of(values)
        last = np.append(first[1:], len(values))[: len(first)] - 1
        indexed = np.logical_or.reduceat(index, first) if len(first) else np.zeros(0, bool)
        several = doc[first] != doc[last]
        values = values[first]
        cuts = np.searchsorted(values, np.arange(ranges + 1, dtype=np.uint64) << rest)
        out = []
        for r in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[r], cuts[r + 1])
            out.append((int(r), _pack(values[s] - (np.uint64(r) << rest)), np.packbits(indexed[s]).tobytes(), np.packbits(several[s]).tobytes()))
        number = t.column("batch")[0].as_py()
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"hash_range": pa.array(cols[0], pa.int32()), "batch": pa.array([number] * len(out), pa.int32()), "vals": pa.array(cols[1], pa.binary()), "indexed": pa.array(cols[2], pa.binary()), "several": pa.array(cols[3], pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        parts = [_unpack(v) for v in t.column("vals").to_pylist()]
        sizes = [len(p) for p in parts]
        bit = lambda name: np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:k] for x, k in zip(t.column(name).to_pylist(), sizes, strict=True)]).view(bool)
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        first = _first_of(values[order])
        many = np.diff(np.append(first, len(values))) > 1
        hot = np.logical_or.reduceat(bit("indexed")[order], first) & (many | np.logical_or.reduceat(bit("several")[order], first))
        of = np.zeros(len(values), bool)
        of[order] = np.repeat(hot, np.diff(np.append(first, len(values))))
        r = np.uint64(t.column("hash_range")[0].as_py()) << rest
        out, a = [], 0
        for number, p in zip(t.column("batch").to_pylist(), parts, strict=True):
            mine = p[of[a : a + len(p)]]
            a += len(p)
            if len(mine):
                out.append((number, (mine + r).tobytes()))
        return pa.table({"batch": pa.array([x[0] for x in out], pa.int32()), "hot": pa.array([x[1] for x in out], pa.binary())})

    def candidates(b: _Batch, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and documents of the runs of a whole window that hold an anchor."""
        values, at, _ = b.anchors(block)
        hit = np.zeros(len(b.words) + 1, np.int64)
        if len(hot) and len(values):
            values = anchor_of(values)
            found = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
            hit[at[hot[found] == values] + 1] = 1
        seen = np.cumsum(hit)
        at, doc = b.runs(window)
        keep = seen[at + window - block + 1] > seen[at]
        return at[keep], doc[keep]

    def sorted_keys(b: _Batch, hot: np.ndarray, ids: np.ndarray):
        """Candidate runs in the order of their keys: keys, places, documents; and where each new key begins."""
        at, doc = candidates(b, hot)
        keys = b.keys(window, at)
        order = np.lexsort((ids[doc], keys["b"], keys["a"]))
        keys, at, doc = keys[order], at[order], doc[order]
        return keys, at, doc, _first_of(keys)

    def hot_of(t: pa.Table) -> np.ndarray:
        return np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("hot").to_pylist()] or [np.zeros(0, np.uint64)]))

    def extend(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids = _ids(left)
            keys, _, doc, first = sorted_keys(_Batch(_texts(left)), hot_of(right), ids)
            keys, least = keys[first], ids[doc[first]]
            cuts = np.searchsorted(keys["a"] >> np.uint64(64 - bits), np.arange(ranges + 1, dtype=np.uint64))
            number = left.column("batch")[0].as_py()
            for r in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[r], cuts[r + 1])
                out.append((int(r), number, keys["a"][s].tobytes(), keys["b"][s].tobytes(), least[s].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table({"hash_range": pa.array(cols[0], pa.int32()), "batch": pa.array(cols[1], pa.int32()), "a": pa.array(cols[2], pa.binary()), "b": pa.array(cols[3], pa.binary()), "least": pa.array(cols[4], pa.binary())})

    def least_of(t: pa.Table) -> pa.Table:
        sizes = [len(x) // 8 for x in t.column("a").to_pylist()]
        keys = np.zeros(sum(sizes), [("a", "<u8"), ("b", "<u4")])
        keys["a"] = np.frombuffer(b"".join(t.column("a").to_pylist()), "<u8")
        keys["b"] = np.frombuffer(b"".join(t.column("b").to_pylist()), "<u4")
        ids = np.concatenate([np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel() for x in t.column("least").to_pylist()])
        order = np.lexsort((ids, keys["b"], keys["a"]))
        first = _first_of(keys[order])
        least = np.zeros(len(ids), np.int64)
        least[order] = np.repeat(ids[order][first], np.diff(np.append(first, len(ids))))
        out, a = [], 0
        for number, k in zip(t.column("batch").to_pylist(), sizes, strict=True):
            s = slice(a, a + k)
            a += k
            out.append((number, t.column("hash_range")[0].as_py(), least[s].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()))
        return pa.table({"batch": pa.array([x[0] for x in out], pa.int32()), "hash_range": pa.array([x[1] for x in out], pa.int32()), "hot": pa.array([None] * len(out), pa.binary()), "least": pa.array([x[2] for x in out], pa.binary())})

    def cut(_, left: pa.Table, right: pa.Table) -> pa.Table:
        texts, ids = _texts(left), _ids(left)
        b = _Batch(texts)
        drop = np.zeros(len(b.words) + 1, np.int64)
        told = sorted((r, x) for r, x in zip(right.column("hash_range").to_pylist(), right.column("least").to_pylist(), strict=True) if x is not None)
        if told:
            hot = hot_of(right.filter(pc.is_valid(right.column("hot"))))
            keys, at, doc, first = sorted_keys(b, hot, ids)
            least = np.concatenate([np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel() for _, x in told])
            at = at[np.repeat(least, np.diff(np.append(first, len(keys)))) < ids[doc]]
            np.add.at(drop, at, 1)
            np.add.at(drop, at + window, -1)
        gone = np.cumsum(drop)[:-1] > 0
        removed, kept = [], []
        for t, a, k in zip(texts, b.first.tolist(), b.counts.tolist(), strict=True):
            words, out = t.split(), gone[a : a + k]
            r = int(out.sum())
            removed.append(r)
            kept.append(b" ".join([words[i] for i in np.flatnonzero(~out)] if r else words))
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(b.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    probes = rows.groupBy("batch").applyInArrow(probe, "hash_range int, batch int, vals binary, indexed binary, several binary")
    hot = probes.groupBy("hash_range").applyInArrow(meet, "batch int, hot binary")
    runs = rows.groupBy("batch").cogroup(hot.groupBy("batch")).applyInArrow(extend, "hash_range int, batch int, a binary, b binary, least binary")
    least = runs.groupBy("hash_range").applyInArrow(least_of, "batch int, hash_range int, hot binary, least binary")
    told = least.unionByName(hot.select("batch", F.lit(None).cast("int").alias("hash_range"), "hot", F.lit(None).cast("binary").alias("least")))
    return rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
