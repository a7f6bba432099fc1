"""Lexicon tables, units by ranges, stored projects, files of several formats."""

import os
import random

import pytest
from pyspark.sql import functions as F

from talewright.functions.lexicon import DEFAULT, Lexicon, pool_rows, read_pools
from talewright.operators import looks, mining, project
from talewright.plans.storyboard import storyboard
from talewright.sources import readers, sinks

ENTRY = "list string, kind string, ord long, key string, value string"
POOL = "pool string, path string, ord long, value string"


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_merged_lists_go_by_their_kind(spark):
    old = spark.createDataFrame([("p", "pairs", 0, "臉", "x"), ("p", "pairs", 1, "臉", "again"), ("p", "pairs", 2, "眼睛", None), ("s", "set", 0, "b", None), ("s", "set", 1, "b", None), ("w", "plain", 0, "b", None), ("same", "pairs", 0, "q", None), ("same", "pairs", 1, "q", None)], ENTRY)
    new = spark.createDataFrame([("p", "pairs", 0, "臉", "new"), ("p", "pairs", 1, "手", None), ("p", "pairs", 2, "手指頭", "z"), ("p", "pairs", 3, "手", "k"), ("s", "set", 0, "c", None), ("s", "set", 1, "c", None), ("w", "plain", 0, "long", None), ("w", "plain", 1, "a", None), ("w", "plain", 2, "b", None), ("same", "pairs", 0, "q", "n")], ENTRY)
    got = {}
    for r in mining.merge_lexicons(old, new).orderBy("list", "ord").collect():
        got.setdefault(r.list, []).append((r.key, r.value))
    assert got == {"p": [("手指頭", "z"), ("眼睛", "眼睛特寫"), ("手", "手特寫"), ("臉", "x")], "s": [("c", None), ("b", None)], "w": [("long", None), ("a", None), ("b", None)], "same": [("q", None), ("q", None)]}
    assert _rows(mining.merge_report(old, new), "list", "fresh", "repeated", "total") == [("p", 2, 2, 4), ("s", 1, 1, 2), ("same", 0, 1, 2), ("w", 2, 1, 3)]
    merged = mining.merge_lexicons(old, new)
    again = mining.merge_lexicons(merged.withColumn("kind", F.when(F.col("list") == "s", "set").when(F.col("list") == "w", "plain").otherwise("pairs")), new)
    assert _rows(again, "list", "ord", "key", "value") == _rows(merged, "list", "ord", "key", "value")


def test_pools_merge_leaf_by_leaf_and_dress_people(spark):
    old = spark.createDataFrame([("hair", "/f", 0, "長髮"), ("hair", "/f", 1, "短髮"), ("face", "/n", 0, "圓臉")], POOL)
    new = spark.createDataFrame([("hair", "/f", 0, "短髮"), ("hair", "/f", 1, "捲髮"), ("hair", "/m", 0, "平頭"), ("mark", "/n", 0, "痣")], POOL)
    merged = mining.merge_pools(old, new)
    assert _rows(merged, "pool", "path", "ord", "value") == [("face", "/n", 0, "圓臉"), ("hair", "/f", 0, "長髮"), ("hair", "/f", 1, "短髮"), ("hair", "/f", 2, "捲髮"), ("hair", "/m", 0, "平頭"), ("mark", "/n", 0, "痣")]
    assert _rows(mining.pool_report(old, new), "pool", "before", "after") == [("face", 1, 1), ("hair", 2, 4), ("mark", 0, 1)]
    lex = read_pools(merged)
    assert looks.allowed("hair", "現代", "f", True, lex) == ["長髮", "短髮", "捲髮"] and looks.allowed("eyes", "現代", "f", True, lex) == looks.allowed("eyes", "現代", "f", True)
    people = spark.createDataFrame([(1, "甲", 0, "f", "現代", True)], "novel_id long, name string, rank int, gender string, era string, modern boolean")
    look = looks.suggest_look(people, lex).first()
    assert look.hair in ("長髮", "短髮", "捲髮") and look.face == "圓臉" and look.mark == "痣"


def test_all_pools_go_through_a_table(spark):
    lex = read_pools(spark.createDataFrame(pool_rows(), POOL), Lexicon(**{**vars(DEFAULT), "SEASONS": (), "ROLE_OUTFITS": ()}))
    assert sorted(lex.POOLS) == sorted(DEFAULT.POOLS)
    for name in ("ROLE_OUTFITS", "STYLE_OUTFITS", "SCENE_TEXTURE", "SCENE_LIGHT", "SCENE_BY_NAME", "SEASONS"):
        assert getattr(lex, name) == getattr(DEFAULT, name), name
    for pool, path in (("hat", "/n"), ("hair", "f"), ("hair", "/x")):
        with pytest.raises(ValueError):
            read_pools(spark.createDataFrame([(pool, path, 0, "v")], POOL))
    assert read_pools(spark.createDataFrame([("hat", "", 0, ""), ("hat", "", 0, None)], POOL)).POOLS == DEFAULT.POOLS


def test_malformed_entries_are_rows(spark):
    rows = [("a", "pairs", 0, "臉", "x"), ("a", "pairs", 1, "手", None), ("a", "pairs", 2, " ", "x"), ("b", "weights", 0, "說", "2"), ("b", "weights", 1, "問", "two"), ("c", "regex", 0, "a(b", None), ("c", "regex", 1, "a(b)", None), ("c", "regex", 2, None, None), ("d", "characters", 0, "王", None), ("d", "characters", 1, "歐陽", None), ("e", "set", 0, " x", None), ("f", "list", 0, "x", None)]
    got = _rows(mining.malformed(spark.createDataFrame(rows, ENTRY)), "list", "key", "problem")
    assert got == sorted([("a", "手", "pair without a value"), ("a", " ", "empty"), ("b", "問", "weight is no number"), ("c", "a(b", "regex does not compile"), ("c", None, "empty"), ("d", "歐陽", "more than one character"), ("e", " x", "blanks around the word"), ("f", "x", "unknown kind")], key=repr)


def test_shots_meet_units_that_overlap_and_leave_gaps(spark):
    rng = random.Random(5)
    units = [(n, u, a, a + rng.randint(-1, 40)) for n in range(3) for u in range(12) for a in [rng.randint(0, 90)]] + [(9, 0, 0, 1_000_000)]
    shots = [(n, s) for n in range(4) for s in range(100)] + [(9, 999_999), (9, 1_000_001)]
    got = project.assign_unit(spark.createDataFrame(shots, "novel_id long, shot_no int"), spark.createDataFrame(units, "novel_id long, unit_no int, from_shot int, to_shot int"), bin_size=16)
    want = []
    for n, s in shots:
        inside = [u for m, u, a, b in units if m == n and a <= s <= b]
        want += [(n, s, u) for u in inside or [None]]
    assert _rows(got, "novel_id", "shot_no", "unit_no") == sorted(want, key=repr)


def test_lists_of_pictures(spark):
    files = spark.createDataFrame([("U1_S001_v1.png", "ok"), ("U1_S001_v2.png", "redo"), ("U1_S002_v9.png", "ok"), ("U1_S002_v10.png", None), ("U_2_S003_v1.png", "odd"), ("note.txt", "ok"), (None, "ok")], "path string, status string")
    wanted = spark.createDataFrame([("U1", "S001"), ("U1", "S002"), ("U1", "S003"), ("U1", "S003")], "unit string, shot string")
    assert _rows(project.asset_latest(files), "unit", "shot", "version", "status") == [("U1", "S001", 2, "redo"), ("U1", "S002", 10, ""), ("U_2", "S003", 1, "odd")]
    assert _rows(project.asset_counts(files, ("ok", "redo")), "unit", "ok", "redo", "other") == [("U1", 0, 1, 1), ("U_2", 0, 0, 1)]
    assert _rows(project.asset_pending(wanted, files), "unit", "shot", "next") == [("U1", "S003", "U1_S003_v1.png")]
    assert _rows(project.asset_redo(wanted, files, ("redo",)), "shot", "next") == [("S001", "U1_S001_v3.png")]


def test_units_of_a_stored_project_are_replaced_alone(spark, tmp_path):
    at = str(tmp_path / "shots")
    rows = lambda units, mark: spark.createDataFrame([("p", u, i, f"{mark}{i}") for u in units for i in range(3)], "project_id string, unit string, seq int, narr string")
    sinks.replace_units(rows(["U1", "U2", "U3"], "old"), at)
    stamp = lambda unit: sorted((f, os.stat(f"{at}/project_id=p/unit={unit}/{f}").st_mtime_ns) for f in os.listdir(f"{at}/project_id=p/unit={unit}"))
    before = stamp("U1"), stamp("U3")
    for _ in range(2):
        sinks.replace_units(rows(["U2", "U4"], "new"), at)
        got = _rows(sinks.read_units(spark, at), "shot_id", "unit", "narr")
        assert got == [(f"S{n + 1:03d}", f"U{n // 3 + 1}", f"{'new' if n // 3 in (1, 3) else 'old'}{n % 3}") for n in range(12)]
        assert (stamp("U1"), stamp("U3")) == before


def test_a_project_keeps_its_first_style(spark):
    style = lambda rows: spark.createDataFrame(rows, "project_id int, style string")
    got = project.first_style(style([(1, "noir"), (2, ""), (3, None)]), style([(1, "new"), (2, "new"), (4, "new"), (5, " ")]))
    assert _rows(got, "project_id", "style") == [(1, "noir"), (2, "new"), (3, ""), (4, "new"), (5, "")]


def test_a_folder_of_five_formats_becomes_a_storyboard(spark, tmp_path):
    text = "狄明說道：「快走。」狄明走進書房。馬華問道：「誰？」馬華轉身看著碼頭，雨一直下。" * 3
    files = {"a.txt": text.encode("big5", "replace"), "b.md": b"\xff\xfe" + text.encode("utf-16le"), "sub/c.HTML": f"<head><title>no</title></head><p>{text}</p><script>no</script>".encode(), "d.docx": readers.make_docx(text), "e.json": b'{"chars": []}', "f.doc": b"old", "g.docx": b"PK broken", "i.txt": "短".encode(), "j.docx": readers.make_docx(text)[:80]}
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    read = readers.load_files(spark, str(tmp_path))
    got = {r.path.split("/")[-1]: (r.route, r.enc, r.reject_reason, r.text) for r in read.collect()}
    assert {k: v[2] for k, v in got.items() if v[2]} == {"f.doc": "old format", "g.docx": "broken file", "i.txt": "too short", "j.docx": "broken file"}
    assert got["a.txt"][1] == "big5" and got["b.md"][1] == "utf-16le" and got["e.json"][0] == "project"
    assert {got[k][3].strip() for k in ("a.txt", "b.md", "c.HTML", "d.docx")} == {text}
    none = spark.createDataFrame([("a.txt", b""), ("b.docx", None), (None, b"  "), ("c.pdf", b"%PDF")], "path string, content binary")
    assert _rows(readers.read_files(none), "path", "reject_reason") == sorted([("a.txt", "blank"), ("b.docx", "blank"), (None, "blank"), ("c.pdf", "give its runs to layout_runs_to_text")], key=repr)
    board = storyboard(read.where("route <> 'project' AND reject_reason = ''").select(F.xxhash64("path").alias("novel_id"), "text"))
    assert board.shots.select("novel_id").distinct().count() == 4 and "狄明" in {r.name for r in board.persons.collect()}


def test_many_novels_are_written_to_few_folders(spark, tmp_path):
    rows = spark.range(600).select(F.col("id").alias("novel_id"), (F.col("id") % 2).alias("unit_no"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("shot_no"))
    lines = sinks.headed(rows.withColumn("line", F.concat_ws("-", "novel_id", "shot_no")), "head")
    sinks.write_text(lines, str(tmp_path / "t"), "line", order="shot_no", buckets=7)
    folders = [f for f in os.listdir(tmp_path / "t") if f.startswith("bucket")]
    assert len(folders) == 7 and all(sum(x.endswith(".txt") for x in os.listdir(tmp_path / "t" / f)) == 1 for f in folders)
    text = spark.read.text(str(tmp_path / "t"), wholetext=True)
    blocks = {b.split("\n")[0]: b.strip().split("\n")[1:] for r in text.collect() for b in r.value.split("== ")[1:]}
    assert len(blocks) == 600 and all(b == ["head", *(f"{k.split()[0]}-{i}" for i in range(3))] for k, b in blocks.items())
