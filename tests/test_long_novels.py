"""Units of novels in segments against the plain fold over a whole novel."""

import random

import pytest
from pyspark.sql import functions as F

from talewright.operators import project, unit_fold


def _story(rng, n, calm=False):
    scene = [rng.choice(("", "甲", "乙", "丙")) if rng.random() < (0 if calm else 0.1) else "甲" for _ in range(n)]
    return scene, [rng.choice((0, 20, 33, 46, 80)) for _ in range(n)]


def _by_segments(scene, tenths, least, most, tail, size):
    changed = [k > 0 and s != "" and s != scene[k - 1] for k, s in enumerate(scene)]
    cuts = [unit_fold.Cuts(unit_fold.np.array(changed[a : a + size], bool), unit_fold.np.array(tenths[a : a + size], int), least * 10, most * 10) for a in range(0, len(scene), size)]
    begins = unit_fold.compose([{"total": c.total, "steps": c.steps()} for c in cuts], least * 10, tail * 10)
    of, hard = [], []
    for c, b in zip(cuts, begins, strict=True):
        u, h = c.shots(b["elapsed"], b["unit"], b["end_hard"])
        of += [min(x, b["last"]) for x in u.tolist()]
        hard += [b["last_hard"] if x > b["last"] else y for x, y in zip(u.tolist(), h.tolist(), strict=True)]
    return of, hard


def test_segments_cut_as_the_plain_fold_does():
    rng = random.Random(7)
    for _ in range(400):
        n, size = rng.randrange(1, 300), rng.choice((1, 2, 7, 64, 1000))
        least, most, tail = rng.choice(((60, 90, 30), (0, 5, 3), (90, 60, 100), (5, 5, 0)))
        scene, tenths = _story(rng, n, rng.random() < 0.2)
        of, hard = project.unit_numbers(scene, tenths, least, most, tail)
        assert _by_segments(scene, tenths, least, most, tail, size) == (of, [hard[u] for u in of])


def test_steps_are_few_whatever_the_segment():
    rng = random.Random(3)
    scene, tenths = _story(rng, 20_000)
    cuts = unit_fold.Cuts(unit_fold.np.array([False] * len(scene)), unit_fold.np.array(tenths), 6000, 9000)
    assert 0 < len(cuts.steps()) <= 9001


@pytest.mark.parametrize("size", [3, 64, 4096])
def test_units_of_novels_in_a_table(spark, size):
    rng = random.Random(size)
    stories = {i: _story(rng, n) for i, n in enumerate((1, 63, 64, 65, 700, 128))}
    shots = spark.createDataFrame([(i, k, s, t / 10, "x") for i, (scene, tenths) in stories.items() for k, (s, t) in enumerate(zip(scene, tenths, strict=True))], "novel_id long, shot_no long, scene string, dur double, segment string")
    got = project.with_units(shots, 60, 90, 30, size)
    assert got.columns == [*shots.columns, "unit_no", "hard"]
    for i, (scene, tenths) in stories.items():
        of, hard = project.unit_numbers(scene, tenths, 60, 90, 30)
        rows = sorted((r.shot_no, r.unit_no, r.hard) for r in got.where(F.col("novel_id") == i).collect())
        assert rows == [(k, u, hard[u]) for k, u in enumerate(of)]
    assert project.with_units(shots.limit(0), 60, 90, 30, size).count() == 0


def test_a_novel_of_a_million_shots(spark):
    n = 1_000_000
    shots = spark.range(n).select(F.lit(1).cast("long").alias("novel_id"), F.col("id").alias("shot_no"), F.when(F.col("id") % 97 < 90, "甲").when(F.col("id") % 5 == 0, "乙").otherwise("").alias("scene"), (F.col("id") * 7919 % 61 / 10 + 2).alias("dur"))
    rows = project.with_units(shots).select("shot_no", "unit_no", "hard").toPandas().sort_values("shot_no")
    tenths = [k * 7919 % 61 + 20 for k in range(n)]
    scene = ["甲" if k % 97 < 90 else "乙" if k % 5 == 0 else "" for k in range(n)]
    of, hard = project.unit_numbers(scene, tenths, project.UNIT_MIN, project.UNIT_MAX, project.TAIL)
    assert rows.unit_no.tolist() == of
    assert rows.hard.tolist() == [hard[u] for u in of]
