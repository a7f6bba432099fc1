"""Encoding with a SentencePiece vocabulary, N-best, and decoding.

A segmentation's score is the sum of its pieces' scores in the model file; a character that no piece holds becomes its
UTF-8 bytes (byte pieces) at the score of the worst piece less 10. The best segmentation is the forward Viterbi path over
the lattice of pieces. The N best come from a backward A-star search: a partial path from the end is worth its own score
plus the forward Viterbi score of the place it has reached, which is exactly what the rest can still add, so paths leave
the queue in the order of their scores.

No piece goes over from a letter to the space mark, so a text is a chain of units (spaces and the word after them) whose
segmentations are independent. A batch of documents solves each distinct unit once, units of one length together in
numpy. What the second-best segmentation of a unit costs follows from forward and backward scores; the N best of a text
can differ from the best in no more than the N - 1 cheapest units, so only those are searched, and their alternatives
are combined best first.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
MARK = "▁"
PENALTY = 10.0
_UNITS = re.compile(f" +[^ \n{MARK}]*|[^ \n{MARK}]+|\n|{MARK}")
#: Longer units are solved one at a time.
LONG = 40
#: Bytes of text that a task works on at once, and units that it remembers.
SLICE = 1 << 23
UNITS = 150_000
_INF = float("-inf")


class Vocabulary:
    """Pieces of a model file, for lookups by text and by the hashes of many substrings at once."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.score: dict[str, tuple[int, float]] = {}
        self.byte = [0] * 256
        self.bytes: list[bytes] = []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                self.score[piece] = (i, sp.get_score(i))
                self.bytes.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece goes over from a letter to the space mark: words are not independent")
        if "\n" in "".join(self.score):
            raise ValueError("a piece holds a newline: lines are not independent")
        self.longest = max(map(len, self.score))
        self.fallback = min(s for _, s in self.score.values()) - PENALTY
        self.base = np.uint64(0x9E3779B97F4A7C15)
        hashes = np.array([self._hash(p) for p in self.score], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.ids = np.array([i for i, _ in self.score.values()])[order]
        self.scores = np.array([s for _, s in self.score.values()])[order]

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.base) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes in ids and scores, -1 for those of no piece."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def edges(v: Vocabulary, unit: str) -> list[list[tuple[int, int, float]]]:
    """For each end in the unit the pieces that end there: (start, id, score); id -1 stands for bytes."""
    out: list[list[tuple[int, int, float]]] = [[]]
    for e in range(1, len(unit) + 1):
        here = [(s, *v.score[unit[s:e]]) for s in range(max(0, e - v.longest), e) if unit[s:e] in v.score]
        if not here or here[-1][0] != e - 1:
            here.append((e - 1, -1, v.fallback))
        out.append(here)
    return out


def forward(lattice: list[list[tuple[int, int, float]]]) -> list[float]:
    """Viterbi scores: the best way from the start to each place."""
    best = [0.0]
    for here in lattice[1:]:
        best.append(max(best[s] + score for s, _, score in here))
    return best


def n_best(v: Vocabulary, unit: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a unit, best first: (score, ids)."""
    lattice = edges(v, unit)
    h = forward(lattice)
    queue: list = [(-h[-1], len(unit), 0, 0.0, None)]  # minus the worth, place reached, turn, own score, edges so far
    out, turn = [], 0
    while queue and len(out) < n:
        total, place, _, own, link = heapq.heappop(queue)
        if place == 0:
            ids: list[int] = []
            while link:
                (start, end, i), link = link
                ids += [i] if i >= 0 else [v.byte[b] for b in unit[start:end].encode()]
            out.append((-total, ids))
            continue
        for start, i, score in lattice[place]:
            turn += 1
            heapq.heappush(queue, (-(own + score + h[start]), start, turn, own + score, ((start, place, i), link)))
    return out


def _solve_group(v: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Best score, cost of the second best (infinite if there is none) and ids of units of one length."""
    n, count = len(units[0]), len(units)
    text = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").reshape(count, n).astype(np.uint64)
    best = np.full((n + 1, count), _INF)
    best[0] = 0
    back = np.zeros((n + 1, count), np.int64)
    piece = np.full((n + 1, count), -1, np.int64)
    lattice: dict[tuple[int, int], np.ndarray] = {}
    for s in range(n):
        h = np.zeros(count, np.uint64)
        for e in range(s + 1, min(n, s + v.longest) + 1):
            h = h * v.base + text[:, e - 1] + np.uint64(1)
            at = v.find(h)
            score = np.where(at >= 0, v.scores[at], v.fallback if e == s + 1 else _INF)
            if e > s + 1 and not (at >= 0).any():
                continue
            lattice[s, e] = score
            total = best[s] + score
            better = total > best[e]
            best[e] = np.where(better, total, best[e])
            back[e] = np.where(better, s, back[e])
            piece[e] = np.where(better, np.where(at >= 0, v.ids[at], -1), piece[e])
    rest = np.full((n + 1, count), _INF)
    rest[n] = 0
    for (s, e), score in sorted(lattice.items(), reverse=True):
        rest[s] = np.maximum(rest[s], score + rest[e])
    on_path = np.zeros((n + 1, count), bool)
    place = np.full(count, n)
    ids = np.full((count, n), -2, np.int64)
    for k in range(n - 1, -1, -1):
        go = place > 0
        rows = np.flatnonzero(go)
        on_path[place[rows], rows] = True
        ids[rows, k] = piece[place[rows], rows]
        place[rows] = back[place[rows], rows]
    second = np.full(count, _INF)
    for (s, e), score in lattice.items():
        mine = on_path[e] & (back[e] == s)
        second = np.maximum(second, np.where(mine, _INF, best[s] + score + rest[e]))
    out = [row[row > -2] for row in ids]
    for i in np.flatnonzero((ids == -1).any(1)):
        out[i] = np.array(n_best(v, units[i], 1)[0][1])
    return best[n], best[n] - second, out


def solve(v: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Best score, cost of the second best, and ids of each unit."""
    score, cost = np.zeros(len(units)), np.zeros(len(units))
    ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(units)
    by_length: dict[int, list[int]] = {}
    for i, u in enumerate(units):
        by_length.setdefault(len(u), []).append(i)
    for n, rows in by_length.items():
        if n > LONG:
            for i in rows:
                found = n_best_long(v, units[i])
                score[i], cost[i], ids[i] = found
            continue
        for a in range(0, len(rows), 8192):
            part = rows[a : a + 8192]
            score[part], cost[part], got = _solve_group(v, [units[i] for i in part])
            for i, x in zip(part, got, strict=True):
                ids[i] = x
    return score, cost, ids


def n_best_long(v: Vocabulary, unit: str) -> tuple[float, float, np.ndarray]:
    """The same for one long unit, by plain Viterbi both ways."""
    lattice = edges(v, unit)
    h = forward(lattice)
    rest = [_INF] * len(lattice)
    rest[-1] = 0.0
    for e in range(len(unit), 0, -1):
        for s, _, score in lattice[e]:
            rest[s] = max(rest[s], score + rest[e])
    place, path, ids = len(unit), set(), []
    while place:
        s, i, _ = max(lattice[place], key=lambda x: (h[x[0]] + x[2], -x[0]))
        path.add((s, place))
        ids.append([i] if i >= 0 else [v.byte[b] for b in unit[s:place].encode()])
        place = s
    second = max((h[s] + score + rest[e] for e in range(1, len(lattice)) for s, _, score in lattice[e] if (s, e) not in path), default=_INF)
    return h[-1], h[-1] - second, np.array([i for part in ids[::-1] for i in part])


def units_of(text: str) -> list[str]:
    """The units of a text, the space that the encoding puts before it included."""
    return _UNITS.findall(" " + text)


def _lattice_text(unit: str) -> str:
    """A unit as the lattice has it. A space mark in the text itself is no space: it becomes bytes."""
    return "\0" if unit == MARK else unit.replace(" ", MARK)


def combine(options: list[list[tuple]], n: int) -> list[tuple[float, int, tuple[int, ...]]]:
    """The n cheapest sums of one option of each list; each list starts with (0, 0) and is in order: (cost, length, the option of each
    list)."""
    sums: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 0, ())]
    for own in options:
        sums = heapq.nsmallest(n, ((c + o[0], k + o[1], (*chosen, i)) for c, k, chosen in sums for i, o in enumerate(own)))
    return sums


def _spread(options: list[list[tuple]], of: np.ndarray, n: int) -> list[list[tuple]]:
    """The options at the places that they are for, among n."""
    out: list[list[tuple]] = [[]] * n
    for i, own in zip(of.tolist(), options, strict=True):
        out[i] = own
    return out


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about SLICE bytes of its column ``text``, one row at least."""
    column = batch.column(text)
    upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(upto // SLICE, prepend=0)) if len(upto) else np.zeros(0, np.int64)
    edges_ = [0, *(c for c in cuts.tolist() if c), batch.num_rows]
    for a, b in zip(edges_, edges_[1:], strict=False):
        if a < b or not batch.num_rows:
            yield batch.slice(a, b - a)


class _Known:
    """The units that a task has solved, forgotten when there are more than UNITS of them."""

    def __init__(self, v: Vocabulary):
        self.v, self.index = v, {}
        self._forget()

    def _forget(self) -> None:
        self.index.clear()
        self.names: list[str] = []
        self.score: list[float] = []
        self.cost: list[float] = []
        self.ids: list[np.ndarray] = []
        self.others: dict[int, list[tuple[float, int, list[int]]]] = {}

    def numbers(self, texts: Iterable[list[str]]) -> list[np.ndarray]:
        """The units of each text by number; new ones are solved together."""
        if len(self.index) > UNITS:
            self._forget()
        first = len(self.index)
        out = [np.fromiter((self.index.setdefault(u, len(self.index)) for u in units), np.int32, len(units)) for units in texts]
        new = list(islice(self.index, first, None))
        names = [_lattice_text(u) for u in new]
        score, cost, ids = solve(self.v, names)
        for i, u in enumerate(new):
            if u == MARK:
                ids[i] = np.array([self.v.byte[c] for c in MARK.encode()])
        self.names += names
        self.score += score.tolist()
        self.cost += cost.tolist()
        self.ids += ids
        return out

    def alternatives(self, u: int, n: int) -> list[tuple[float, int, list[int]]]:
        """(cost, tokens more, ids) of the n best segmentations of a unit against the best."""
        if u not in self.others:
            found = n_best(self.v, self.names[u], n)
            self.others[u] = [(found[0][0] - s, len(x) - len(found[0][1]), x) for s, x in found]
        return self.others[u]


def encode(docs: DataFrame, path: str = MODEL, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), all_ids: bool = False) -> DataFrame:
    """(doc_id, ids, n_tokens, scores, lengths, with all_ids n_best, and the columns to keep) of every row.

    ids: the best segmentation, little-endian numbers of two bytes (four for a vocabulary above 65,536). scores and
    lengths: score and number of tokens of the n best segmentations, best first (fewer where there are fewer); n_best: their ids. A null
    text is encoded as an empty one: the empty segmentation, with score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        kind = "<u2" if v.size <= 1 << 16 else "<u4"
        known = _Known(v)
        for b in (part for batch in batches for part in _slices(batch, 1)):
            docs_units = known.numbers(units_of(t) if t else [] for t in b.column(1).to_pylist())
            flags = np.zeros(len(known.index), bool)
            for units in docs_units:
                flags[units] = True
            used = np.flatnonzero(flags)
            place = np.cumsum(flags, dtype=np.int32) - 1
            ids = [known.ids[u] for u in used.tolist()]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate(ids).astype(kind) if ids else np.zeros(0, kind)
            start = np.cumsum(size) - size
            score, cost = (np.array([c[u] for u in used.tolist()]) for c in (known.score, known.cost))
            out_ids, tokens, scores, lengths, all_of, first = [], [], [], [], [], [0]
            for numbers in docs_units:
                units = place[numbers]
                k = size[units]
                total = int(k.sum())
                at = np.repeat(start[units] - (np.cumsum(k) - k), k) + np.arange(total)
                out_ids.append(flat[at].tobytes())
                tokens.append(total)
                options, of = [], np.zeros(0, np.int64)
                if n > 1 and len(units):
                    c = cost[units]
                    cheap = np.argpartition(c, n - 1)[: n - 1] if len(c) > n - 1 else np.arange(len(c))
                    of = cheap[np.isfinite(c[cheap])]
                    options = [known.alternatives(u, n) for u in numbers[of].tolist()]
                sums = combine(options, n)
                best = float(score[units].sum())
                scores.append([best - c for c, _, _ in sums])
                lengths.append([total + m for _, m, _ in sums])
                if all_ids:
                    every = [known.ids[u] for u in numbers.tolist()]
                    for _, _, chosen in sums:
                        other = dict(zip(of.tolist(), chosen, strict=True))
                        parts = [options_of[other[i]][2] if other.get(i) else ids_of for i, (ids_of, options_of) in enumerate(zip(every, _spread(options, of, len(every)), strict=True))]
                        all_of.append(np.concatenate(parts).astype(kind).tobytes() if parts else b"")
                    first.append(len(all_of))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out_ids, pa.binary()), pa.array(tokens, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(lengths, pa.list_(pa.int64())), *([pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(all_of, pa.binary()))] if all_ids else []), *b.columns[2:]],
                names=["doc_id", "ids", "n_tokens", "scores", "lengths", *(["n_best"] if all_ids else []), *keep],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("_doc_id"), F.col(text_col).cast("string").alias("_text"), *keep)
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long, scores array<double>, lengths array<long>" + (", n_best array<binary>" if all_ids else "") + extra)


def decode(encoded: DataFrame, path: str = MODEL, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids in place of them; null ids give a null text."""
    names = [c for c in encoded.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        kind = "<u2" if v.size <= 1 << 16 else "<u4"
        for b in (part for batch in batches for part in _slices(batch, len(names))):
            texts = [None if x is None else b"".join(map(v.bytes.__getitem__, np.frombuffer(x, kind).tolist()))[1:].decode("utf-8", "replace") for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*names, text_col])

    rows = encoded.select(*names, ids_col)
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"{text_col} string"]))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, the N best scores and a digest of the ids of every document, and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("want"))
    coded = encode(docs, keep=("want",)).withColumn("ids_sha256", F.sha2("ids", 256))
    back = decode(coded)
    return back.select("doc_id", "n_tokens", "scores", "lengths", "ids_sha256", (F.xxhash64("decoded") == F.col("want")).alias("round_trip"))
