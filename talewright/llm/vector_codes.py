"""Vector codes: product quantisation of integer vectors by Lloyd's rounds with Hamerly's bounds.

A vector's components become the integers floor(SCALE * x); the vector is cut into PARTS equal parts, and each part position has a
codebook of ENTRIES entries. Every part keeps its entry, one upper bound of the distance to it and one lower bound of the distance
to the second nearest. When entries move, the upper bound grows by the move of the own entry and the lower one shrinks by the
longest move of the others. While the upper bound is below the lower one (or half the way to the entry's nearest neighbour),
strictly, the entry is the only nearest one and the part is left alone. Else the upper bound is made exact, and if the bounds
still don't decide, all integer distances are compared and the lower index wins a tie. Bounds are kept as 32-bit floats,
rounded outwards, so they never decide wrongly.

Vectors never move: each round is a pass over the table of the round before, which holds the integers as bytes with the codes and
bounds, and is written to the shared folder, so a lost executor costs its tasks alone. Each task sums its own parts by entry;
only those sums are shuffled. The driver holds the codebooks (ENTRIES entries, whatever the number of vectors) and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table, unused, written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Bits of the pieces that sums travel in, so that sums of any size stay exact.
LIMB = 40
#: Salts of a label, so that a label with very many rows is no hot key.
SALTS = 64
#: What bounds are widened by before they are rounded outwards; far more than the rounding of the steps between.
SLACK = 1e-12

Books = list[list[list[int]]]


@dataclass(frozen=True)
class Numbers:
    """How integers of a size are stored and compared: exactly in doubles, else in 64-bit integers, else in Python's."""

    width: int
    stored: str
    compared: str

    @classmethod
    def of(cls, width: int, top: int) -> Numbers:
        farthest = max(1, width // PARTS) * (2 * top + 2) ** 2
        compared = "f8" if farthest < 1 << 52 else "i8" if farthest < 1 << 62 else "O"
        return cls(width, "f8" if compared == "O" else "i2" if top < 1 << 14 else "i4" if top < 1 << 30 else "i8", compared)

    def store(self, column: pa.Array) -> pa.Array:
        """The vectors of a column of lists as bytes, padded with zeros to the width."""
        offsets = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False).astype("f8")[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        x = np.zeros((len(sizes), self.width))
        row, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
        x[row, at] = flat
        if self.compared != "O":
            x = np.floor(x * SCALE)
        data = np.ascontiguousarray(x.astype(self.stored))
        return pa.array([r.tobytes() for r in data], pa.binary())

    def load(self, column: pa.Array) -> np.ndarray:
        """(rows, PARTS, width of a part) in the type to compare in."""
        x = np.frombuffer(b"".join(column.to_pylist()), self.stored).reshape(len(column), self.width)
        if self.compared == "O":
            x = np.array([[_floor(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
        return x.astype(self.compared).reshape(len(column), PARTS, self.width // PARTS)


def _floor(v: float) -> int:
    """floor(SCALE * v), exactly, for any finite v."""
    over, under = v.as_integer_ratio()
    return over * SCALE // under


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in the type of the rows."""
    d = x - y
    return (d * d).sum(1)


def _all_squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry, exact in the type of the rows."""
    if x.dtype.kind == "f":
        return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None]
    d = x[:, None, :] - book[None]
    return (d * d).sum(2)


def _roots(squared: np.ndarray, up: bool) -> np.ndarray:
    """Square roots that are never too small (up) or never too large, as doubles."""
    return np.sqrt(squared.astype("f8")) * (1 + SLACK if up else 1 - SLACK)


def _outwards(bound: np.ndarray, up: bool) -> np.ndarray:
    """32-bit floats that are no less (up) or no more than the bounds."""
    with np.errstate(over="ignore"):
        out = bound.astype("f4")
    wrong = out.astype("f8") < bound if up else out.astype("f8") > bound
    return np.where(wrong, np.nextafter(out, np.float32(np.inf if up else -np.inf)), out)


class Rounds:
    """A codebook that parts are assigned to, and how far its entries are from where they were and from each other."""

    def __init__(self, numbers: Numbers, now: Books, before: Books | None):
        k = numbers.width // PARTS
        as_array = lambda books: [np.array(b, numbers.compared).reshape(len(b), k) for b in books]
        self.books = as_array(now)
        self.step = {"f": 16384, "i": 1024, "O": 64}[self.books[0].dtype.kind]
        moves = [_roots(_squared(a, b), True) for a, b in zip(self.books, as_array(before), strict=True)] if before else []
        self.moves = moves
        #: The longest move of any entry but this one.
        self.others = [np.where(np.arange(len(m)) == m.argmax(), np.sort(m)[-2] if len(m) > 1 else 0.0, m.max()) for m in moves]
        self.half = []
        for book in self.books if before else ():
            apart = np.full(len(book), np.inf)
            for a in range(0, len(book), 64):
                gaps = _roots(_all_squared(book[a : a + 64], book), False)
                gaps[np.arange(len(gaps)), np.arange(a, a + len(gaps))] = np.inf
                apart[a : a + 64] = gaps.min(1) / 2
            self.half.append(apart)

    def scan(self, x: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry, and the distances to it and to the second nearest, by all integer distances."""
        book, near, first, second = self.books[part], [], [], []
        for a in range(0, len(x), self.step):
            d = _all_squared(x[a : a + self.step], book)
            at = d.argmin(1)
            rows = np.arange(len(d))
            near.append(at)
            first.append(_roots(d[rows, at], True))
            rest = d.astype("f8")
            rest[rows, at] = np.inf
            second.append(_roots(rest.min(1), False))
        join = lambda c: np.concatenate(c) if c else np.zeros(0)
        return join(near).astype("i8"), join(first), join(second)

    def assign(self, x: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring codes and bounds (rows, PARTS) up to date, in place; how many parts were scanned in full."""
        scanned = 0
        for p in range(PARTS):
            open_ = np.arange(len(x))
            if self.moves:
                own = codes[:, p].astype("i8")
                u = (upper[:, p] + self.moves[p][own]) * (1 + SLACK)
                low = lower[:, p].astype("f8")
                shrunk = np.maximum(low - self.others[p][own] - low * SLACK, 0) if len(self.books[p]) > 1 else low
                bound = np.maximum(shrunk, self.half[p][own])
                open_ = np.flatnonzero(~(u < bound))
                u[open_] = _roots(_squared(x[open_, p], self.books[p][own[open_]]), True)
                upper[:, p], lower[:, p] = _outwards(u, True), _outwards(shrunk, False)
                open_ = open_[~(u[open_] < bound[open_])]
            near, first, second = self.scan(x[open_, p], p)
            codes[open_, p] = near
            upper[open_, p], lower[open_, p] = _outwards(first, True), _outwards(second, False)
            scanned += len(open_)
        return scanned


STATE = "vec_id long, x binary, codes binary, upper binary, lower binary"


def _fixed(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), PARTS).copy()


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _state(batches: Iterator[pa.RecordBatch], numbers: Numbers, rounds: Rounds) -> Iterator[pa.RecordBatch]:
    """Batches of (vec_id, label, x and, but in the first round, codes, upper, lower) with codes and bounds up to date."""
    for b in batches:
        x = numbers.load(b["x"])
        n = len(x)
        codes, upper, lower = (_fixed(b["codes"], "u1"), _fixed(b["upper"], "f4"), _fixed(b["lower"], "f4")) if rounds.moves else (np.zeros((n, PARTS), "u1"), np.zeros((n, PARTS), "f4"), np.zeros((n, PARTS), "f4"))
        rounds.assign(x, codes, upper, lower)
        yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["x"], _bytes(codes), _bytes(upper), _bytes(lower)], names=["vec_id", "label", "x", "codes", "upper", "lower"])


def _sums(batches: Iterator[pa.RecordBatch], numbers: Numbers, entries: int) -> Iterator[pa.RecordBatch]:
    """(slot, limb, total) of a task: the sums of its parts' components, and their number, for each entry of each part."""
    k = numbers.width // PARTS
    exact = "O" if numbers.compared == "O" else "i8"
    totals = np.zeros((PARTS, entries, k + 1), object)
    for b in batches:
        x, codes = numbers.load(b["x"]).astype(exact), _fixed(b["codes"], "u1")
        for p in range(PARTS):
            sums = np.zeros((entries, k + 1), exact)
            np.add.at(sums, codes[:, p], np.concatenate([x[:, p], np.ones((len(x), 1), exact)], 1))
            totals[p] += sums.astype(object)
    rows = []
    for slot, total in enumerate(totals.ravel().tolist()):
        limb = 0
        while total:
            rows.append((slot, limb, total & ((1 << LIMB) - 1) if abs(total) >> LIMB else total))
            total = total >> LIMB if abs(total) >> LIMB else 0
            limb += 1
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["slot", "limb", "total"])


def _moved(state: DataFrame, numbers: Numbers, books: Books) -> Books:
    """The codebooks after an update: floor(sum / count) of each entry's parts; entries without parts stay."""
    entries, k = len(books[0]), numbers.width // PARTS
    parts = state.select("x", "codes").mapInArrow(lambda it: _sums(it, numbers, entries), "slot int, limb int, total long")
    totals = [0] * (PARTS * entries * (k + 1))
    for r in parts.groupBy("slot", "limb").agg(F.sum("total").alias("total")).collect():  # a few rows for each number of the codebooks
        totals[r.slot] += r.total << (LIMB * r.limb)
    out = []
    for p in range(PARTS):
        rows = [totals[(p * entries + e) * (k + 1) :][: k + 1] for e in range(entries)]
        out.append([[s // r[k] for s in r[:k]] if r[k] else books[p][e] for e, r in enumerate(rows)])
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Books]:
    """(vec_id, label, codes, error) of every vector that can be coded, and the codebooks, by part and entry.

    Rows whose vector is null or holds a null or a number that is not finite are dropped. codes are PARTS bytes, error is the squared
    integer distance to the coded vector (null if it is more than a long holds). The codebooks begin with the vectors of the ENTRIES
    smallest ids (equal ids by vector, null ids last; fewer vectors give fewer entries). Vectors count as padded with zeros to the
    longest length and to a multiple of PARTS. Repeated rows count as often as they stand; a null label is a label. An empty table
    gives an empty result and empty codebooks.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = kept.where("v is not null").where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    facts = kept.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    if facts.width is None:
        return spark.createDataFrame([], "vec_id long").select("vec_id", F.lit(None).cast(kept.schema["label"].dataType).alias("label"), F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), [[]] * PARTS
    numbers = Numbers.of(-(-facts.width // PARTS) * PARTS, -_floor(-(facts.top or 0.0)) + 1)
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    k = numbers.width // PARTS
    whole = [[_floor(c) for c in r.v] + [0] * (numbers.width - len(r.v)) for r in seeds]
    books: Books = [[v[p * k : (p + 1) * k] for v in whole] for p in range(PARTS)]
    label = f"`label` {kept.schema['label'].dataType.simpleString()}"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], numbers.store(b["v"])], names=["vec_id", "label", "x"])

    rounds = Rounds(numbers, books, None)
    schema = STATE.replace("x binary", f"{label}, x binary")
    state = kept.mapInArrow(lambda it: _state(store(it), numbers, rounds), schema)
    for n in range(ROUNDS):
        if n:
            state = state.mapInArrow(lambda it, r=rounds: _state(it, numbers, r), schema)
        state = written(state, "vector-codes")
        books, before = _moved(state, numbers, books), books
        rounds = Rounds(numbers, books, before)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _state(batches, numbers, rounds):
            x, codes = numbers.load(b["x"]), _fixed(b["codes"], "u1").astype("i8")
            error = sum(_squared(x[:, p], rounds.books[p][codes[:, p]]) for p in range(PARTS))
            error = pa.array([int(e) if e < 1 << 63 else None for e in error.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["codes"], error], names=["vec_id", "label", "codes", "error"])

    return state.mapInArrow(finish, f"vec_id long, {label}, codes binary, error long"), books


def label_errors(rows: DataFrame) -> DataFrame:
    """rows (label, error and more) with label_error, the errors summed over equal labels (nulls are equal; null where the sum is more
    than a long holds). A label's rows are dealt to SALTS parts: sums of parts are summed, and the sum is told to the parts."""
    salt, total = unused(rows, "salt"), unused(rows, "total")
    rows = rows.withColumn(salt, F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    error = F.coalesce(F.col("error").cast("decimal(38,0)"), F.lit(str(1 << 63)).cast("decimal(38,0)"))
    parts = rows.groupBy("label", salt).agg(F.sum(error).alias(total))
    sums = parts.groupBy("label").agg(F.sum(total).alias(total), F.collect_list(salt).alias("salts"))  # SALTS at most
    told = sums.select(F.col("label").alias("_label"), F.explode("salts").alias("_salt"), F.col(total).try_cast("long").alias("label_error"))
    return rows.join(told.hint("shuffle_hash"), F.col("label").eqNullSafe(F.col("_label")) & (F.col(salt) == F.col("_salt")), "left").drop(salt, "_label", "_salt")


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    found = label_errors(settle(rows))
    return found.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    near = "arg_min(b.entry, {'d': list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), 'e': b.entry})"
    return f"""a{n} AS MATERIALIZED (SELECT p.vec_id, p.part, any_value(p.x) AS x, {near} AS entry FROM p JOIN b{n} b USING (part) GROUP BY p.vec_id, p.part)"""


def _update_sql(n: int) -> str:
    return f"""m{n} AS (SELECT part, entry, list(m ORDER BY i) AS x FROM (SELECT part, entry, i, floor(sum(c) / count(*)) AS m FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY ALL) GROUP BY part, entry),
b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m USING (part, entry))"""


ORACLE = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, e[part * len(e) // {PARTS} + 1:(part + 1) * len(e) // {PARTS}] AS x FROM k, range({PARTS}) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p JOIN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{', '.join(f'{_round_sql(n)}, {_update_sql(n)}' for n in range(ROUNDS))}, {_round_sql(ROUNDS)},
f AS (SELECT a.vec_id, string_agg(printf('%02x', a.entry), '' ORDER BY a.part) AS code, sum(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::BIGINT AS error FROM a{ROUNDS} a JOIN b{ROUNDS} b USING (part, entry) GROUP BY a.vec_id),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: c::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) AS h FROM b{ROUNDS}),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM f JOIN k USING (vec_id) GROUP BY label)
SELECT f.vec_id, f.code, f.error, l.label_error, s.h AS codebooks_sha256 FROM f JOIN k USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM k.label, s
"""
