"""Vector codes against plain Lloyd's rounds in Python integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from talewright.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label string, error long, codes string"


def plain(rows):
    """{(vec_id, place): (code, error, label_error)} and the codebooks, by full scans."""
    kept = [(i, list(v), lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    whole = [[math.floor(Fraction(c) * 1024) for c in v] + [0] * (width - len(v)) for _, v, _ in kept]
    k = width // 4
    parts = [[w[p * k : (p + 1) * k] for w in whole] for p in range(4)]
    books = [[list(x) for x in part[:256]] for part in parts]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(4):
        for p in range(4):
            at = [near(x, books[p]) for x in parts[p]]
            for e in range(len(books[p])):
                own = [x for x, a in zip(parts[p], at, strict=True) if a == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, sums = [], {}
    for n, (i, _, lab) in enumerate(kept):
        at = [near(parts[p][n], books[p]) for p in range(4)]
        error = sum(far(parts[p][n], books[p][at[p]]) for p in range(4))
        sums[lab] = sums.get(lab, 0) + error
        out.append((i, lab, "".join(f"{a:02x}" for a in at), error))
    return sorted(((i, c, e if e < 2**63 else None, sums[lab] if sums[lab] < 2**63 else None) for i, lab, c, e in out), key=repr), books


def run(spark, rows):
    df = spark.createDataFrame([(i, v, lab, 7, "x") for i, v, lab in rows], SCHEMA).repartition(3)
    found, books = vc.compress(df)
    got = vc.label_errors(found).select("vec_id", F.lower(F.hex("codes")), "error", "label_error").collect()
    return sorted((tuple(r) for r in got), key=repr), [[list(map(int, e)) for e in b] for b in books]


def blobs(seed, n, width, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return [(int(i), [float(c) for c in centres[rng.integers(12)] + spread * rng.normal(size=width)], rng.choice(["a", "a", "b", None])) for i in rng.permutation(n)]


def test_codes_equal_plain_rounds(spark):
    rows = blobs(1, 330, 8)
    assert run(spark, rows) == plain(rows)


def test_codes_with_ties_and_repeated_rows(spark):
    """Few distinct vectors, so that entries are equal and many parts lie between entries."""
    rng = np.random.default_rng(3)
    rows = [(i // 2, [float(c) / 1024 for c in rng.integers(-3, 4, 4)], "a") for i in range(400)]
    rows += rows[:40]
    assert run(spark, rows) == plain(rows)


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, "a"), (2, [1.0, None, 0.0], "a"), (3, [nan, 1.0], "a"), (4, [inf], None), (None, [0.5, -0.25], None), (5, [], None), (6, [-0.0001, 0.5, 0.25, 1.0, 2.0], "b"), (6, [-0.0001, 0.5, 0.25, 1.0, 2.0], "b"), (-9, [0.0] * 5, None)]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("size", [3e4, 3e38])
def test_codes_of_large_numbers_are_exact(spark, size):
    rows = [(i, [c * size for c in v], lab) for i, v, lab in blobs(5, 290, 4)]
    assert run(spark, rows) == plain(rows)


def test_codes_of_no_rows(spark):
    assert run(spark, []) == ([], [[]] * 4)
    assert run(spark, [(1, None, "a")]) == ([], [[]] * 4)


def test_bounds_spare_most_scans():
    """Once the entries move little, few parts are scanned, and those that are not have the code that a scan gives."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-900, 900, (64, 32))
    x = (centres[rng.integers(64, size=4000)] + rng.integers(-30, 31, (4000, 32))).astype(float).reshape(4000, 4, 8)
    numbers = vc.Numbers.of(32, 1000)
    books = [x[:64, p].astype(int).tolist() for p in range(4)]
    codes, upper, lower = np.zeros((4000, 4), "u1"), np.zeros((4000, 4), "f4"), np.zeros((4000, 4), "f4")
    before, scanned = None, []
    for _ in range(4):
        scanned.append(vc.Rounds(numbers, books, before).assign(x, codes, upper, lower))
        for p in range(4):
            d = ((x[:, p, None] - np.array(books[p], float)[None]) ** 2).sum(2)
            assert (codes[:, p] == d.argmin(1)).all()
            assert (upper[:, p] >= np.sqrt(d.min(1))).all() and (lower[:, p] <= np.sqrt(np.partition(d, 1, axis=1)[:, 1])).all()
        before, books = books, [[np.floor(x[codes[:, p] == e, p].mean(0)).astype(int).tolist() if (codes[:, p] == e).any() else books[p][e] for e in range(64)] for p in range(4)]
    assert scanned[0] == 16000 and scanned[-1] < 4000
