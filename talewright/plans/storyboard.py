"""From manuscripts to storyboards, in one plan.

Normalised texts give the facts of each novel, its people with narrator and genders, its scenes, and its shots; the shots get
scene, subject, size, move, length and picture, then units and prompts. Everything is keyed by novel_id. Of a novel only the
people and scenes (a few rows each) are joined to its text, as arrays, and one pass over the text makes its shots whole (``operators/board``), so
shots are not shuffled here. ``annotate`` does the same to a table of shots that is there already, step by step.

Normalised texts are read by several steps, and people and scenes are asked for many times, so they are written to the folder that
``spark.checkpoint.dir`` names, where it is set; without it they are worked out again. For people, narrators and genders a text is read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewright.functions import segment
from talewright.functions.lexicon import DEFAULT, Lexicon
from talewright.functions.shared import settled
from talewright.operators import board, classify, looks, people, places, project, shots


@dataclass(frozen=True)
class Options:
    """What a user chooses: pace, how many people and scenes, style (empty: guessed), and the length of units in seconds."""

    wpm: int = 260
    sec_per_shot: float = 4
    persons: int = 8
    scenes: int = 6
    style: str = ""
    unit_least: int = project.UNIT_MIN
    unit_most: int = project.UNIT_MAX
    unit_tail: int = project.TAIL

    @property
    def target(self) -> int:
        """Characters of a shot."""
        return max(8, int(self.wpm / 60 * self.sec_per_shot + 0.5))


@dataclass(frozen=True)
class Storyboard:
    """Tables of a storyboard.

    novels: (novel_id, text, style, era, modern, season); persons: (novel_id, rank, name, count, role, gender, is_narrator, desc);
    narrators: (novel_id, wo, first_person, name); scenes: (novel_id, rank, name, count, type, desc); shots: (novel_id, shot_no,
    unit_no, hard, shot_id, narr, size, move, dur, start, code, unit_start, unit_code, who, who_from, phrase, scene, hit, lens, n_chars, prompt, cues), or
    those columns of them that were asked for; units: (novel_id, unit_no, from_shot, to_shot, dur, hard).
    """

    novels: DataFrame
    persons: DataFrame
    narrators: DataFrame
    scenes: DataFrame
    shots: DataFrame
    units: DataFrame


def facts(novels: DataFrame, lex: Lexicon = DEFAULT, style: str = "") -> DataFrame:
    """novels with style, era, modern (whether the text knows modern things) and season."""
    rows = segment.arrow_column(novels, "text", "_f", "array<string>", classify.facts_of(style, lex))
    style_, era, modern, season = (F.col("_f")[i] for i in range(4))
    return rows.withColumns({"style": style_, "era": era, "modern": modern != "", "season": season}).drop("_f")


def cast(novels: DataFrame, limit: int = 8, lex: Lexicon = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(persons with gender and is_narrator, narrators) of normalised novels."""
    read = settled(people.scan(novels, lex))
    found = settled(people.persons_of(read, limit, lex))
    told = settled(people.narrator(read, found, lex))
    sexes = people.genders(read, found, lex)
    named = told.where("name <> ''").select("novel_id", "name", F.lit(True).alias("is_narrator"))
    rows = found.join(sexes, ["novel_id", "name"]).join(named, ["novel_id", "name"], "left").withColumn("is_narrator", F.coalesce("is_narrator", F.lit(False)))
    return settled(rows), told


def shots_of(novels: DataFrame, options: Options = Options(), lex: Lexicon = DEFAULT) -> DataFrame:
    """(novel_id, shot_no, narr) of normalised novels, without a shuffle."""
    rows = segment.arrow_column(novels.select("novel_id", "text"), "text", "parts", "array<string>", lambda t: segment.shots_of(t, options.target, lex.CREDITS))
    return rows.select("novel_id", F.posexplode("parts").alias("shot_no", "narr"))


def annotate(rows: DataFrame, persons: DataFrame, narrators: DataFrame, scenes: DataFrame, options: Options = Options(), lex: Lexicon = DEFAULT) -> DataFrame:
    """Shots (novel_id, shot_no, narr) with who, who_from, phrase, hit, scene, size, dur, n_chars, move, the cues and lens."""
    rows = shots.resolve_subject(rows, persons, narrators, persons, lex)
    rows = shots.scene_carry_forward(shots.scene_hit(rows, scenes))
    narr = F.col("narr")
    rows = rows.withColumns({"size": shots.shot_size(narr, lex), "dur": shots.shot_duration(narr, options.wpm, options.sec_per_shot), "n_chars": shots.n_chars(narr)})
    return shots.compose_lens(shots.cue_tags(shots.camera_move(rows, lex), lex), lex)


def drawn(novels: DataFrame, persons: DataFrame, narrators: DataFrame, scenes: DataFrame, options: Options = Options(), lex: Lexicon = DEFAULT, columns: tuple[str, ...] = board.COLUMNS) -> DataFrame:
    """The whole shots of normalised novels, or the columns that are asked for, from one reading of each text."""
    units = (options.unit_least, options.unit_most, options.unit_tail)
    return board.drawn(novels, persons, narrators, scenes, columns, lex, options.target, options.wpm, options.sec_per_shot, units)


def described(novels: DataFrame, persons: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """persons with desc: sex, age and calling, hints of the text, look."""
    told = looks.told_of(novels, persons, lex)
    of_novel = novels.select("novel_id", "era", "modern", "style")
    dressed = looks.suggest_look(persons.withColumn("rank", F.col("rank") - 1).join(of_novel, "novel_id"), lex)
    rows = persons.join(dressed, ["novel_id", "name"]).join(told, ["novel_id", "name"], "left")
    return looks.draft_person_desc(rows).select(*persons.columns, "desc")


def scenes_of(novels: DataFrame, limit: int = 6, lex: Lexicon = DEFAULT) -> DataFrame:
    """(novel_id, rank, name, count, type, desc) of novels with era and season."""
    found = settled(places.places(novels, limit, lex))
    rows = found.withColumn("rank", F.col("rank") - 1).join(novels.select("novel_id", "era", "season"), "novel_id")
    return looks.draft_scene_desc(rows, lex).select("novel_id", (F.col("rank") + 1).alias("rank"), "name", "count", "type", "desc")


def storyboard(novels: DataFrame, lex: Lexicon = DEFAULT, options: Options = Options(), columns: tuple[str, ...] = board.COLUMNS) -> Storyboard:
    """The storyboards of novels (novel_id, text).

    Null texts count as empty, and empty ones have no shots, people or scenes; novel_id must be there and unique. Other columns are left
    out. An empty table gives empty tables. Who needs some columns of the shots only names them, as the others are not made then; cues come
    along with narr.
    """
    texts = segment.normalize(novels.select("novel_id", F.coalesce("text", F.lit("")).alias("text")))
    texts = settled(facts(texts, lex, options.style))
    persons, narrators = cast(texts, options.persons, lex)
    scenes = settled(scenes_of(texts, options.scenes, lex))
    persons = settled(described(texts, persons, lex))
    rows = drawn(texts, persons, narrators, scenes, options, lex, columns)
    units = project.units_of_shots(drawn(texts, persons, narrators, scenes, options, lex, ("shot_no", "unit_no", "hard", "dur")))
    rows = shots.cue_tags(rows, lex) if "narr" in columns else rows
    return Storyboard(texts, persons, narrators, scenes, rows, units)
