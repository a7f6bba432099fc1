"""Units of novels of any length: a fold in segments.

Whether a unit is cut at a shot depends on all shots since the last cut, so the rule is a fold along the novel. Here the novel is dealt
to segments of SEGMENT shots, each a row of its own:

1. What a segment does to the fold depends on one number only, the time that the open unit has lasted when the segment begins: the more,
   the earlier its first cut. So the segment is a short table of steps: from which time on the first cut is where, and how many cuts
   and how much time follow from there. There are no more steps than tenths of a second in the longest unit.
2. The tables of a novel are composed in their order, which gives each segment the time and the unit that it begins with, and how the
   unit that it leaves open ends. That is one row of a novel, but of a few numbers for each segment.
3. Each segment cuts its own shots from there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewright.functions.shared import settled, slices

#: Shots of a segment.
SEGMENT = 4096

_STEPS = "array<struct<need:long,before:long,changed:boolean,cuts:long,left:long,hard:boolean>>"


class Cuts:
    """Where units are cut in one segment, of which changed tells where the scene is a new one, and tenths the lengths of its shots.

    A unit is cut before a shot if it has lasted least and the scene changes there, or if it has lasted more than most.
    """

    def __init__(self, changed: np.ndarray, tenths: np.ndarray, least: int, most: int):
        self.changed, self.least, self.most = changed, least, most
        self.before = np.cumsum(tenths) - tenths
        self.total = int(tenths.sum())
        soft = np.flatnonzero(changed)
        n = len(tenths)
        hard_at = np.maximum(np.searchsorted(self.before, self.before + most, "right"), np.arange(n) + 1)
        k = np.maximum(np.searchsorted(self.before[soft], self.before + least), np.searchsorted(soft, np.arange(n), "right"))
        # the cut after a unit that starts at each shot; n if there is none in the segment
        self.next = np.minimum(hard_at, np.append(soft, n)[k]) if n else np.zeros(0, np.int64)

    def hard(self, at: int, lasted: int) -> bool:
        """Whether the cut of a unit that has lasted so long is a hard one at this place: no change of scene allows it."""
        return not (self.changed[at] and lasted >= self.least)

    def needs(self) -> np.ndarray:
        """The least time an open unit has lasted at the start that is cut at each shot."""
        return np.where(self.changed, np.minimum(self.least, self.most + 1), self.most + 1) - self.before

    def steps(self) -> list[dict]:
        """The segment as a table: need, from which time on the first cut is at this place (rows go down in need, on in place); before,
        the time of the segment before that place; changed; cuts, left and hard: how many cuts are made, the time of the last unit, and
        whether the last cut is hard (null where it is the first)."""
        need = self.needs()
        if not len(need):
            return []
        best = np.minimum.accumulate(need)
        first = np.flatnonzero(np.append(True, best[1:] < best[:-1]))
        last = np.flatnonzero(best[first] <= 0)
        first = first[: last[0] + 1] if len(last) else first  # an open unit has lasted nothing at least
        known: dict[int, tuple[int, int, bool | None]] = {}
        for start in first.tolist():
            chain = []
            while start < len(need) and start not in known:
                chain.append(start)
                start = int(self.next[start])
            for at in reversed(chain):
                after, lasted = int(self.next[at]), -int(self.before[at])
                if after == len(need):
                    known[at] = (1, lasted + self.total, None)
                else:
                    cuts, left, hard = known[after]
                    known[at] = (cuts + 1, left, self.hard(after, lasted + int(self.before[after])) if hard is None else hard)
        keys = ("need", "before", "changed", "cuts", "left", "hard")
        return [dict(zip(keys, (int(need[j]), int(self.before[j]), bool(self.changed[j]), *known[j]), strict=True)) for j in first.tolist()]

    def shots(self, elapsed: int, unit: int, end_hard: bool) -> tuple[np.ndarray, np.ndarray]:
        """Unit of each shot, and whether that unit ends in a hard cut, from what the segment begins with; end_hard is of the unit left open."""
        n = len(self.before)
        reached = np.flatnonzero(self.needs() <= elapsed)
        at, since, places, hard = (int(reached[0]) if len(reached) else n), -elapsed, [], []
        while at < n:
            places.append(at)
            hard.append(self.hard(at, int(self.before[at]) - since))
            since, at = int(self.before[at]), int(self.next[at])
        of = np.searchsorted(np.array(places, np.int64), np.arange(n), "right")
        return unit + of, np.array([*hard, end_hard])[of]


def compose(segments: list[dict], least: int, tail: int) -> list[dict]:
    """What each segment (total, steps) of a novel begins with: elapsed, unit, end_hard, last, the greatest unit that is kept, and last_hard,
    whether the last cut is hard.

    A last unit shorter than tail joins the one before, which keeps what is said of its cut."""
    elapsed, unit, last_hard, out = 0, 0, False, []
    first_hard: list[bool | None] = []
    for s in segments:
        out.append({"elapsed": elapsed, "unit": unit})
        step = next((x for x in s["steps"] if x["need"] <= elapsed), None)
        if step is None:
            first_hard.append(None)
            elapsed += s["total"]
        else:
            first_hard.append(not (step["changed"] and elapsed + step["before"] >= least))
            last_hard = first_hard[-1] if step["hard"] is None else step["hard"]
            elapsed, unit = step["left"], unit + step["cuts"]
    last = unit - 1 if unit and elapsed < tail else unit
    coming = False
    for row, hard in zip(reversed(out), reversed(first_hard), strict=True):
        row.update(end_hard=coming, last=last, last_hard=last_hard)
        coming = coming if hard is None else hard
    return out


def unit_of_shots(shots: DataFrame, least: int, most: int, tail: int, segment: int = SEGMENT) -> DataFrame:
    """(novel_id, segment, unit, hard): of shots (novel_id; shot_no, from 0 without gaps; scene; t, tenths of a second, null as none), for each
    segment the unit of each of its shots, and whether that unit ends in a hard cut. least, most and tail are tenths too."""
    no = F.col("shot_no")
    # the last shot of a segment goes to the next one too, which has to know its scene
    seg = F.floor(no / segment)
    places = F.when((no + 1) % segment == 0, F.array(seg, seg + 1)).otherwise(F.array(seg))
    rows = shots.select("novel_id", "shot_no", F.coalesce("scene", F.lit("")).alias("scene"), F.greatest(F.coalesce("t", F.lit(0)), F.lit(0)).cast("long").alias("t"), F.explode(places).alias("segment"))
    rows = rows.groupBy("novel_id", "segment").agg(F.array_sort(F.collect_list(F.struct("shot_no", "scene", "t"))).alias("s"))
    own = F.when(F.col("segment") == 0, F.col("s")).otherwise(F.slice("s", 2, segment))
    scenes, prior = F.transform(own, lambda x: x["scene"]), F.transform("s", lambda x: x["scene"])
    prior = F.when(F.col("segment") == 0, F.concat(F.slice(scenes, 1, 1), prior)).otherwise(prior)
    changed = F.zip_with(scenes, F.slice(prior, 1, F.size(scenes)), lambda x, p: (x != "") & (x != p))
    rows = settled(rows.select("novel_id", "segment", changed.alias("changed"), F.transform(own, lambda x: x["t"]).alias("t")).where(F.size("t") > 0))

    def cuts_of(b: pa.RecordBatch) -> list[Cuts]:
        arrays = zip(b.column("changed").to_pylist(), b.column("t").to_pylist(), strict=True)
        return [Cuts(np.array(c, bool), np.array(t, np.int64), least, most) for c, t in arrays]

    def tables(batches):
        for b in slices(batches):
            cuts = cuts_of(b)
            kind = pa.list_(pa.struct([("need", pa.int64()), ("before", pa.int64()), ("changed", pa.bool_()), ("cuts", pa.int64()), ("left", pa.int64()), ("hard", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column("novel_id"), b.column("segment"), pa.array([c.total for c in cuts], pa.int64()), pa.array([c.steps() for c in cuts], kind)], names=["novel_id", "segment", "total", "steps"])

    def composed(batches):
        for b in slices(batches):
            for i, parts in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                told = compose(parts, least, tail)
                columns = [pa.array([i.as_py()] * len(told), pa.int64()), pa.array([p["segment"] for p in parts], pa.int64())]
                columns += [pa.array([x[k] for x in told], pa.int64()) for k in ("elapsed", "unit", "last")]
                columns += [pa.array([x[k] for x in told], pa.bool_()) for k in ("end_hard", "last_hard")]
                yield pa.RecordBatch.from_arrays(columns, names=["novel_id", "segment", "elapsed", "unit", "last", "end_hard", "last_hard"])

    def cut(batches):
        for b in slices(batches):
            begins = zip(cuts_of(b), *(b.column(c).to_pylist() for c in ("elapsed", "unit", "end_hard", "last", "last_hard")), strict=True)
            both = [(np.minimum(u, last), np.where(u > last, tail_hard, h)) for c, e, u0, h0, last, tail_hard in begins for u, h in [c.shots(e, u0, h0)]]
            columns = [pa.array([list(u) for u, _ in both], pa.list_(pa.int32())), pa.array([list(h) for _, h in both], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("novel_id"), b.column("segment"), *columns], names=["novel_id", "segment", "unit", "hard"])

    steps = rows.mapInArrow(tables, f"novel_id long, segment long, total long, steps {_STEPS}")
    of_novel = steps.groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct("segment", "total", "steps"))).alias("parts"))
    begins = of_novel.mapInArrow(composed, "novel_id long, segment long, elapsed long, unit long, last long, end_hard boolean, last_hard boolean")
    return rows.join(begins, ["novel_id", "segment"]).mapInArrow(cut, "novel_id long, segment long, unit array<int>, hard array<boolean>")
