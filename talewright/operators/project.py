"""Units, casts, prompts and the project tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talewright.functions.lexicon import DEFAULT, Lexicon

from . import unit_fold
from .mining import numbered

UNIT_MIN, UNIT_MAX, TAIL = 600, 900, 300


def unit_numbers(scene: list[str], tenths: list[int], least: int, most: int, tail: int) -> tuple[list[int], list[bool]]:
    """The unit of each shot, and whether each unit ends in a hard cut.

    A unit is cut where the scene changes once it has lasted least, and anywhere once it has lasted more than most; a last
    unit shorter than tail joins the one before. Times are tenths of a second.
    """
    unit, hard, of, elapsed, lengths = 0, [], [], 0, []
    for k, t in enumerate(tenths):
        if k and ((elapsed >= least * 10 and scene[k] and scene[k] != scene[k - 1]) or elapsed > most * 10):
            hard.append(not (elapsed >= least * 10 and scene[k] and scene[k] != scene[k - 1]))
            lengths.append(elapsed)
            unit, elapsed = unit + 1, 0
        of.append(unit)
        elapsed += t
    hard.append(False)
    if unit and elapsed < tail * 10:
        of = [min(u, unit - 1) for u in of]
        hard = hard[:-1]
    return of, hard


def with_units(shots: DataFrame, least: int = UNIT_MIN, most: int = UNIT_MAX, tail: int = TAIL, segment: int = unit_fold.SEGMENT) -> DataFrame:
    """Shots (numbered from 0 without gaps, with scene and dur) with unit_no and hard, whether the unit ends in a hard cut: the rule of
    unit_numbers, worked out in segments of a novel (unit_fold), so that no task holds a novel. A null dur counts as none."""
    timed = shots.select("novel_id", "shot_no", "scene", tenths(F.col("dur")).alias("t"))
    units = unit_fold.unit_of_shots(timed, least * 10, most * 10, tail * 10, segment).withColumnsRenamed({"segment": "_seg", "unit": "_units", "hard": "_hards"})
    rows = shots.withColumn("_seg", F.floor(F.col("shot_no") / segment)).join(units, ["novel_id", "_seg"])
    at = (F.col("shot_no") % segment).cast("int")
    return rows.withColumns({"unit_no": F.get("_units", at), "hard": F.get("_hards", at)}).drop("_seg", "_units", "_hards")


#: Shots of a bin of the range join.
BIN = 1024


def assign_unit(shots: DataFrame, units: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Shots (novel_id, shot_no and more) with the unit_no of each unit of a table (novel_id, unit_no, from_shot, to_shot; others are left
    out) that holds them: a row for each where units overlap, one with null where none does.

    A range join by bins: a unit stands in the bins of shot numbers that it reaches, a shot in one; they meet by novel and bin, then the
    bounds decide. So a long novel is many keys, and a unit has a row for each bin_size of its shots.
    """
    bins = F.sequence(F.floor(F.col("from_shot") / bin_size), F.floor(F.col("to_shot") / bin_size))
    spread = units.where("from_shot <= to_shot").select(F.col("novel_id").alias("_n"), "unit_no", "from_shot", "to_shot", F.explode(bins).alias("_b"))
    here = (F.col("novel_id") == F.col("_n")) & (F.floor(F.col("shot_no") / bin_size) == F.col("_b")) & F.col("shot_no").between(F.col("from_shot"), F.col("to_shot"))
    return shots.join(spread, here, "left").drop("_n", "_b", "from_shot", "to_shot")


def units_of_shots(shots: DataFrame) -> DataFrame:
    """(novel_id, unit_no, from_shot, to_shot, dur, hard) of shots with unit_no and hard."""
    sums = shots.groupBy("novel_id", "unit_no").agg(F.min("shot_no").alias("from_shot"), F.max("shot_no").alias("to_shot"), (F.sum(tenths(F.col("dur"))) / 10).alias("dur"), F.max("hard").alias("hard"))
    return sums.select("novel_id", "unit_no", "from_shot", "to_shot", "dur", "hard")


def plan_units(shots: DataFrame, least: int = UNIT_MIN, most: int = UNIT_MAX, tail: int = TAIL) -> DataFrame:
    """(novel_id, unit_no, from_shot, to_shot, dur, hard) of shots with scene and dur."""
    return units_of_shots(with_units(shots.select("novel_id", "shot_no", "scene", "dur"), least, most, tail))


def tenths(column):
    return F.round(column * 10).cast("long")


def novel_stats(shots: DataFrame) -> DataFrame:
    """Of shots with unit_no."""
    s = shots.groupBy("novel_id").agg(F.count("*").alias("shots"), F.sum("n_chars").cast("long").alias("total_chars"), F.sum(tenths(F.col("dur"))).alias("t"), (F.max("unit_no") + 1).cast("long").alias("units"))
    return s.select("novel_id", "shots", "total_chars", (F.col("t") / 10).alias("total_dur"), (F.floor(F.col("t") / 60 + 0.5) / 10).alias("minutes"), "units")


def unit_summary(shots: DataFrame, least: int = UNIT_MIN) -> DataFrame:
    """Of shots with unit_no and hard: per unit length, counts, first and last scene, start and end within the novel, flags."""
    s = shots.groupBy("novel_id", "unit_no").agg(F.count("*").alias("shots"), F.sum("n_chars").cast("long").alias("chars"), F.sum(tenths(F.col("dur"))).alias("t"), F.min_by("scene", "shot_no").alias("first_scene"), F.max_by("scene", "shot_no").alias("last_scene"), F.max("hard").alias("hard"))
    end = F.sum("t").over(Window.partitionBy("novel_id").orderBy("unit_no"))
    return s.withColumns({"start": (end - F.col("t")) / 10, "end": end / 10, "dur": F.col("t") / 10, "short": F.col("t") < least * 10}).drop("t")


def pace_check(stats: DataFrame, wpm: int = 260) -> DataFrame:
    """U4: characters a minute against the aim; off if more than a tenth away."""
    pace = F.when(F.col("total_dur") > 0, F.round(F.col("total_chars") / F.col("total_dur") * 60, 3))
    return stats.select("novel_id", pace.alias("pace"), F.coalesce(F.abs(pace - wpm) > 0.1 * wpm, F.lit(False)).alias("off"))


def estimate_units(chars, wpm: int = 260):
    """Minutes of narration, and the units of 10 to 15 minutes that they make."""
    minutes = F.floor(chars / F.lit(float(wpm)) * 10 + 0.5) / 10
    most, fewest = F.greatest(F.lit(1), F.floor(minutes / 10)).cast("int"), F.greatest(F.lit(1), F.ceil(minutes / 15)).cast("int")
    return F.struct(minutes.alias("minutes"), fewest.alias("fewest"), most.alias("most"))


def unit_label(source_name, number, unit_no, n_units):
    """The cleaned source name, a stand-in where nothing is left, and the unit's number if there are several."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(source_name, "\\.[A-Za-z0-9]+$", ""), "^doc_[0-9a-f]{6,}_", ""), "_OCR$", "")
    base = F.when(F.trim(base).isin("", "document", "untitled", "原稿"), F.concat(F.lit("原稿"), number.cast("string"))).otherwise(F.trim(base))
    return F.when(n_units > 1, F.concat(base, F.lit(" U"), (unit_no + 1).cast("string"))).otherwise(base)


def merge_cast(cast: DataFrame, persons: DataFrame) -> DataFrame:
    """U8: the project's cards, with new ones (face .85, body .5) for persons whose name it lacks."""
    new = persons.join(cast.select("name"), "name", "left_anti").select("name", "role", "desc", F.lit("").alias("ref"), F.lit(0.85).alias("face"), F.lit(0.5).alias("body"))
    return cast.select("name", "role", "desc", "ref", "face", "body").unionByName(new)


def merge_scenes(scenes: DataFrame, places: DataFrame) -> DataFrame:
    """U8 for scenes: the project's, with new ones (body .65) for places whose name it lacks."""
    new = places.join(scenes.select("name"), "name", "left_anti").select("name", "type", "desc", F.lit("").alias("ref"), F.lit(0.65).alias("body"))
    return scenes.select("name", "type", "desc", "ref", "body").unionByName(new)


def import_cast_cards(cast: DataFrame, cards: DataFrame) -> DataFrame:
    """Upsert by name; non-empty texts and given strengths of a card win. outcome: kept, updated or added."""
    c = cards.where("name <> ''").select("name", *(F.col(x).alias(f"c_{x}") for x in ("role", "desc", "ref", "face", "body")), F.lit(True).alias("card"))
    m = cast.withColumn("old", F.lit(True)).join(c, "name", "full_outer")
    text = lambda x: F.coalesce(F.nullif(F.col(f"c_{x}"), F.lit("")), F.col(x), F.lit("")).alias(x)
    outcome = F.when(F.col("card").isNull(), "kept").when(F.col("old").isNull(), "added").otherwise("updated")
    return m.select("name", text("role"), text("desc"), text("ref"), F.coalesce("c_face", "face", F.lit(0.85)).alias("face"), F.coalesce("c_body", "body", F.lit(0.5)).alias("body"), outcome.alias("outcome"))


def shot_id(number: Column) -> Column:
    """S001, S002 ... S1000: padded to three digits, never cut."""
    return F.format_string("S%03d", number.cast("long"))


def replace_unit_shots(project: DataFrame, incoming: DataFrame) -> DataFrame:
    """The project's shots (project_id, unit, seq, narr) without the units that come in, then the incoming ones, numbered
    anew S001, S002 ... within the project. Each unit is numbered on its own and begins where the ones before it end."""
    kept = project.join(incoming.select("project_id", "unit").distinct(), ["project_id", "unit"], "left_anti").withColumn("turn", F.lit(0))
    rows = kept.unionByName(incoming.withColumn("turn", F.lit(1)))
    rows = numbered(rows, [F.col("turn"), F.col("unit")], ["seq"], ("project_id",))
    return rows.select("project_id", "unit", "seq", "narr", shot_id(F.col("ord") + 1).alias("shot_id"))


def first_style(projects: DataFrame, incoming: DataFrame) -> DataFrame:
    """(project_id, style): a project keeps the style that it has; one without a style, or a new one, takes that which comes in."""
    full = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    both = projects.select("project_id", "style").join(incoming.select("project_id", F.col("style").alias("_new")), "project_id", "full_outer")
    return both.select("project_id", F.coalesce(F.when(full("style").isNotNull(), F.col("style")), F.when(full("_new").isNotNull(), F.col("_new")), F.lit("")).alias("style"))


def build_prompt(shots: DataFrame, chars: DataFrame, scenes: DataFrame, style: Column) -> DataFrame:
    """B1 (after the documentation): shots with prompt: description of the character and of the scene, lens and style, empty parts
    skipped. The descriptions of a novel's few characters and scenes travel as maps, so that no shot is joined to rows."""
    of = lambda rows, name: rows.where("desc IS NOT NULL").groupBy("novel_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "desc"))).alias(name))
    part = lambda x: F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit(""))
    rows = shots.join(of(chars, "_c"), "novel_id", "left").join(of(scenes, "_s"), "novel_id", "left")
    prompt = F.concat_ws("\n\n", part(F.try_element_at("_c", F.col("who"))), part(F.try_element_at("_s", F.col("scene"))), part(F.col("lens")), part(style))
    return rows.withColumn("prompt", prompt).drop("_c", "_s")


def ref_strength(size, who, lex: Lexicon = DEFAULT):
    """B2 (after the documentation): strengths of the references; the face only with a character."""
    face, body, text = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit("")
    dot = lambda x: re.sub("^0", "", f"{x:,.2f}")
    for name, f, b in lex.STRENGTHS:
        whole = "" if b is None else f"主體 {dot(b)}"
        led = whole if f is None else "／".join(x for x in (f"臉部 {dot(f)}", whole) if x)
        face = F.when(size == name, F.lit(f).cast("double")).otherwise(face)
        body = F.when(size == name, F.lit(b).cast("double")).otherwise(body)
        text = F.when(size == name, F.when(who != "", led).otherwise(whole)).otherwise(text)
    return F.struct(F.when(who != "", face).alias("face"), body.alias("body"), text.alias("text"))


def timecode(shots: DataFrame, within: tuple[str, ...] = ("novel_id",)) -> DataFrame:
    """With start (seconds) and code m:ss, the time before each shot within the novel (or unit); the seconds may print as 60."""
    before = Window.partitionBy(*within).orderBy("shot_no").rowsBetween(Window.unboundedPreceding, -1)
    t = F.coalesce(F.sum(tenths(F.col("dur"))).over(before), F.lit(0).cast("long"))
    return shots.withColumn("_t", t).withColumns({"start": F.col("_t") / 10, "code": F.concat(F.floor(F.col("_t") / 600).cast("string"), F.lit(":"), F.lpad(F.floor((F.col("_t") % 600) / 10 + 0.5).cast("string"), 2, "0"))}).drop("_t")


def unit_cast(shots: DataFrame, people: DataFrame, scenes: DataFrame) -> DataFrame:
    """Of shots with unit_no: (novel_id, unit_no, kind, name, used) for every person and scene of the novel and every unit."""
    every = people.select("novel_id", F.lit("person").alias("kind"), "name").unionByName(scenes.select("novel_id", F.lit("scene").alias("kind"), "name"))
    of_novel = every.groupBy("novel_id").agg(F.collect_list(F.struct("kind", "name")).alias("every"))  # a few rows of one novel
    units = shots.groupBy("novel_id", "unit_no").agg(F.collect_set("who").alias("person"), F.collect_set("scene").alias("scene")).join(of_novel, "novel_id")
    used = F.when(F.col("x.kind") == "person", F.array_contains("person", F.col("x.name"))).otherwise(F.array_contains("scene", F.col("x.name")))
    return units.select("novel_id", "unit_no", "person", "scene", F.explode("every").alias("x")).select("novel_id", "unit_no", "x.kind", "x.name", used.alias("used"))


def unit_season(shots: DataFrame, scenes: DataFrame) -> DataFrame:
    """The most frequent season (last part of the scene's description) of a unit's shots; ties to the first seen."""
    s = scenes.select("novel_id", F.col("name").alias("scene"), F.element_at(F.split("desc", "；"), -1).alias("season"))
    counts = shots.join(s, ["novel_id", "scene"]).groupBy("novel_id", "unit_no", "season").agg(F.count("*").alias("n"), F.min("shot_no").alias("first"))
    return counts.groupBy("novel_id", "unit_no").agg(F.min_by("season", F.struct((-F.col("n")).alias("n"), "first")).alias("season"))


def asset_files(assets: DataFrame) -> DataFrame:
    """(unit, shot, version, status, path) of the files (path, status) that are named {unit}_{shot}_v{n}.png; others are left out."""
    name = "^(.+)_(S[0-9]+)_v([0-9]+)\\.png$"
    rows = assets.where(F.col("path").rlike(name))
    return rows.select(F.regexp_extract("path", name, 1).alias("unit"), F.regexp_extract("path", name, 2).alias("shot"), F.regexp_extract("path", name, 3).cast("int").alias("version"), "status", "path")


def asset_latest(assets: DataFrame) -> DataFrame:
    """(unit, shot, version, status, path): the latest version of each shot. Of files of one version the first path counts, then the
    first status; a file without a status has an empty one."""
    last = F.struct((-F.col("version")).alias("v"), "path", F.coalesce("status", F.lit("")).alias("status"))
    rows = asset_files(assets).groupBy("unit", "shot").agg(F.min(last).alias("f"))
    return rows.select("unit", "shot", (-F.col("f.v")).alias("version"), "f.status", "f.path")


def asset_counts(assets: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Per unit a column for each status with the shots whose latest file has it, and the others."""
    latest = asset_latest(assets)
    known = F.when(F.col("status").isin(*statuses), F.col("status")).otherwise("other")
    counts = latest.withColumn("_s", known).groupBy("unit").pivot("_s", [*statuses, "other"]).agg(F.count(F.lit(1)))
    return counts.select("unit", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in (*statuses, "other")))


def asset_pending(wanted: DataFrame, assets: DataFrame) -> DataFrame:
    """(unit, shot, next) of the wanted shots without a file, with the name of the one to make."""
    rows = wanted.select("unit", "shot").distinct().join(asset_files(assets).select("unit", "shot"), ["unit", "shot"], "left_anti")
    return rows.select("unit", "shot", F.concat_ws("_", "unit", "shot", F.lit("v1.png")).alias("next"))


def asset_redo(wanted: DataFrame, assets: DataFrame, redo: tuple[str, ...]) -> DataFrame:
    """(unit, shot, status, path, next) of the wanted shots whose latest file asks to be done again. Versions go up and no file is ever
    overwritten, so the next name is that of the version after the latest."""
    latest = asset_latest(assets).where(F.col("status").isin(*redo))
    rows = latest.join(wanted.select("unit", "shot").distinct(), ["unit", "shot"], "left_semi")
    return rows.select("unit", "shot", "status", "path", F.format_string("%s_%s_v%d.png", "unit", "shot", F.col("version") + 1).alias("next"))


def asset_report(wanted: DataFrame, assets: DataFrame, redo: tuple[str, ...]) -> DataFrame:
    """Per unit the wanted shots (unit, shot), those with a file, those whose latest status asks to do them again, and those that
    are still to be made."""
    rows = wanted.select("unit", "shot").distinct().join(asset_latest(assets).select("unit", "shot", "status"), ["unit", "shot"], "left")
    again = F.col("status").isin(*redo)
    return rows.groupBy("unit").agg(F.count("*").alias("wanted"), F.count_if(F.col("status").isNotNull() & ~again).alias("done"), F.count_if(again).alias("redo"), F.count_if(F.col("status").isNull()).alias("pending"))
