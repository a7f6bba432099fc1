"""The shots of a storyboard from one reading of each text: equal to the single steps, and without a shuffle or a sort of shots."""

import random

import pytest
from pyspark.sql import functions as F

from talewright.functions import segment
from talewright.functions.zh import TOKENS
from talewright.jobs import registry
from talewright.operators import board, classify, project
from talewright.plans import storyboard as plan

WORDS = (*TOKENS, "山仔", "蘭姊", "白玉蘭，", "其他", "神色憔悴", "你知道", "他們", "低頭", "照片", "桌子", "微笑", "燭光", "，", "。", "次日")


def _stories():
    rng = random.Random(5)
    return [(i, "".join(rng.choice(WORDS) for _ in range(n))) for i, n in enumerate((0, 1, 3, 40, 400, 400, 400, 3000))]


def _by_steps(texts, persons, narrators, scenes, options):
    """The operators on tables of shots, one after the other."""
    rows = plan.annotate(plan.shots_of(texts, options), persons, narrators, scenes, options)
    rows = project.with_units(rows, options.unit_least, options.unit_most, options.unit_tail)
    rows = project.timecode(rows).withColumn("shot_id", project.shot_id(F.col("shot_no") + 1))
    unit = project.timecode(rows.select("novel_id", "unit_no", "shot_no", "dur"), ("novel_id", "unit_no")).select("novel_id", "shot_no", F.col("start").alias("unit_start"), F.col("code").alias("unit_code"))
    rows = rows.join(unit, ["novel_id", "shot_no"]).join(texts.select("novel_id", "style"), "novel_id")
    return project.build_prompt(rows, persons, scenes, F.col("style")).select("novel_id", *board.COLUMNS)


def test_one_reading_tells_what_the_steps_tell(spark):
    options = plan.Options(unit_least=20, unit_most=30, unit_tail=10)
    told = plan.storyboard(spark.createDataFrame(_stories(), "novel_id long, text string"), options=options)
    want = _by_steps(told.novels, told.persons, told.narrators, told.scenes, options)
    got = told.shots.select("novel_id", *board.COLUMNS)
    assert got.dtypes == want.dtypes
    got, want = ({(r.novel_id, r.shot_no): r for r in df.collect()} for df in (got, want))
    assert got == want and len(want) > 500
    assert {r.who_from for r in got.values()} == {"", "氣質詞", "點名", "我＝敘述者", "代名詞"} and len({r.unit_no for r in got.values()}) > 3


def test_columns_that_are_asked_for(spark):
    told = plan.storyboard(spark.createDataFrame(_stories()[3:5], "novel_id long, text string"), columns=("shot_no", "prompt"))
    assert told.shots.columns == ["novel_id", "shot_no", "prompt"] and told.shots.where("prompt <> ''").count() > 10
    assert told.units.where("hard IS NULL").count() == 0


def test_rows_go_on_beyond_a_batch(spark, monkeypatch):
    monkeypatch.setattr(board, "BATCH", 7)
    novels = spark.createDataFrame([(1, "天黑了沒有人在這裡走動說話。" * 50), (2, "雨一直下到第二天的早上才停。" * 20)], "novel_id long, text string")
    shots = plan.storyboard(novels, columns=("shot_no",)).shots.groupBy("novel_id").agg(F.count("*").alias("n"), F.max("shot_no").alias("last")).collect()
    assert len(shots) == 2 and all(r.n == r.last + 1 > 7 for r in shots)


def test_facts_of_one_reading_equal_the_columns(spark):
    rows = spark.createDataFrame([*_stories(), (90, "旗袍雪雪冬至線索機器人"), (91, "太爺大人老爺電話手機"), (92, "旗袍電話")], "novel_id long, text string")
    text = F.col("text")
    for style in ("", "黑色電影", "none such"):
        want = rows.withColumns({"style": classify.guess_style(text, F.lit(style) if style else None), "era": classify.detect_era(text), "modern": classify.has_modern_tech(text)})
        want = want.withColumn("season", classify.season_for_novel(text, F.col("era")))
        got = plan.facts(rows, style=style)
        assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())


def test_normalised_text():
    assert segment.normalized("﻿甲　乙\r\n丙\t\t丁\n\n\n\n  ----  \n第 3 章 開始\n戊。") == "甲 乙丙 丁\n\n戊。"


@pytest.mark.parametrize("name", ["snk1_write_shot_tsv", "snk2_write_storyboard_md", "snk4_write_prompt_txt", "q10_run_report", "b1_build_prompt"])
def test_shots_are_made_once_and_not_sorted(spark, sf_dir, name):
    made = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # only the last plan: what is settled before is read as a table
    assert "MapInArrow" in made and "Window" not in made and "posexplode" not in made
