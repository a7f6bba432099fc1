"""Whole storyboards, their files, lexicons from tables, and cases that went wrong before."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from talewright.functions.lexicon import read_lexicon
from talewright.functions.shared import settled
from talewright.jobs.text_queries import looks_garbled
from talewright.operators import audit, looks, mining, people, project
from talewright.plans.storyboard import Options, storyboard
from talewright.sources import readers, sinks

STORY = """黑河案
作者：甲
天剛亮，狄明說道：「碼頭出事了。」狄明推開門，走進書房。馬華問道：「誰報的案？」
我叫馬華，我在書房等了一夜。我看著狄明。馬華說：「我去碼頭。」
呂明山站在碼頭，山仔低頭看著鑰匙。山仔轉身就走。他神色憔悴。
到了客廳，母親微笑。母親說：「回來了。」她坐下，母親皺眉。
"""


@pytest.fixture(scope="module")
def board(spark):
    novels = spark.createDataFrame([(1, STORY), (2, ""), (3, None)], "novel_id long, text string")
    return storyboard(novels, options=Options(unit_least=8, unit_most=16, unit_tail=2))


def test_a_storyboard_from_raw_text(board):
    persons = {r.name: r for r in board.persons.where("novel_id = 1").collect()}
    assert {"狄明", "馬華", "呂明山", "母親"} <= set(persons) and "山仔" not in persons
    assert persons["母親"].gender == "f" and persons["馬華"].is_narrator and persons["馬華"].desc
    assert {r.name: r.first_person for r in board.narrators.collect() if r.novel_id == 1} == {"馬華": True}
    assert {"碼頭", "書房", "客廳"} <= {r.name for r in board.scenes.collect()}
    shots = board.shots.orderBy("novel_id", "shot_no").collect()
    assert {r.novel_id for r in shots} == {1} and [r.shot_no for r in shots] == list(range(len(shots)))
    assert "".join("".join(r.narr.split()) for r in shots).count("狄明推開門") == 1
    alias = [r for r in shots if "山仔低頭" in r.narr and "馬華" not in r.narr]
    assert alias and all(r.who == "呂明山" for r in alias)
    assert any(r.who == "馬華" and r.who_from == "我＝敘述者" for r in shots)
    assert all(r.prompt.endswith("寫實電影感") or r.prompt.endswith("黑色電影") for r in shots) and shots[0].shot_id == "S001"
    desc = {r.name: r.desc for r in board.persons.collect()}
    assert all(desc[r.who] in r.prompt for r in shots if r.who)
    units = board.units.where("novel_id = 1").orderBy("unit_no").collect()
    assert len(units) > 1 and units[0].from_shot == 0 and all(a.to_shot + 1 == b.from_shot for a, b in zip(units, units[1:], strict=False)) and units[-1].to_shot == len(shots) - 1


def test_files_of_a_storyboard_are_read_back(spark, board, tmp_path):
    sheet = sinks.sheet(board.shots)
    sinks.write_shot_tsv(sheet, f"{tmp_path}/tsv")
    files = sorted(glob.glob(f"{tmp_path}/tsv/novel_id=1/unit_no=*/*.txt"))
    rows = [line.split("\t") for f in files for line in open(f, encoding="utf-8").read().splitlines()]
    n = board.units.where("novel_id = 1").count()
    shots = board.shots.orderBy("shot_no").collect()
    assert len(files) == n and rows[0] == list(sinks.TSV_COLUMNS) and all(len(r) == 13 for r in rows)
    assert sorted(r[0] for r in rows if r[0] != "shot_id") == sorted(r.shot_id for r in shots) and rows[1][1] == "0:00"

    sinks.write_storyboard_md(sinks.storyboard_md(sheet, board.persons, board.scenes, board.novels), f"{tmp_path}/md")
    texts = [open(f, encoding="utf-8").read() for f in glob.glob(f"{tmp_path}/md/novel_id=1/unit_no=*/*.txt")]
    assert len(texts) == n and all(sinks.NEGATIVE in t and "## 分鏡" in t for t in texts) and sum(t.count("\n### S") for t in texts) == len(shots)

    sinks.write_project_json(sinks.project_json(board.shots, board.persons, board.scenes, board.novels), f"{tmp_path}/json")
    tables = readers.read_projects(spark, f"{tmp_path}/json/novel_id=1")
    back = tables["shots"].orderBy("turn").collect()
    assert [(r.id, r.narr, r.who, r.scene, r.dur) for r in back] == [(r.shot_id, r.narr, r.who, r.scene, r.dur) for r in shots]
    assert {r.name for r in tables["chars"].collect()} == {r.name for r in board.persons.collect()}
    assert {(r.name, r.desc) for r in tables["scenes"].collect()} == {(r.name, r.desc) for r in board.scenes.collect()}
    assert tables["projects"].first().title == "1"
    cards = json.loads(sinks.cast_json(board.persons).first().json)
    assert cards["type"] == "cast-lib" and len(cards["chars"]) == board.persons.count()

    sinks.write_prompt_txt(sinks.prompt_txt(board.shots), f"{tmp_path}/txt")
    lines = [line for f in glob.glob(f"{tmp_path}/txt/novel_id=1/unit_no=*/*.txt") for line in open(f, encoding="utf-8").read().splitlines()]
    assert len(lines) == len(shots)


def test_a_lexicon_table_changes_what_is_found(spark):
    table = spark.createDataFrame([("roles", 0, "道士", None), ("places", 0, "道觀", "室外"), ("aliases", 0, "小雲兒", "柳雲"), ("full_names", 0, "柳雲", None), ("cues.face", 0, "苦笑", "嘴角一扯"), ("speak", 0, "嚷道", "2")], "list string, ord int, key string, value string")
    lex = read_lexicon(table)
    novels = spark.createDataFrame([(1, "柳雲嚷道：「道士在道觀。」小雲兒苦笑。道士走了。道士笑。小雲兒轉身。")], "novel_id long, text string")
    board = storyboard(novels, lex)
    assert {"柳雲", "道士"} <= {r.name for r in board.persons.collect()} and {(r.name, r.type) for r in board.scenes.collect()} == {("道觀", "室外")}
    assert any("嘴角一扯" in r.lens for r in board.shots.collect())
    with pytest.raises(ValueError):
        read_lexicon(spark.createDataFrame([("nolist", 0, "x", None)], "list string, ord int, key string, value string"))


def test_shot_ids_go_on_beyond_999(spark):
    kind = "project_id long, unit string, seq long, narr string"
    old = spark.createDataFrame([(1, "U1", i, "x") for i in range(1100)] + [(1, "U2", 0, "old")], kind)
    got = project.replace_unit_shots(old, spark.createDataFrame([(1, "U2", 0, "new")], kind)).collect()
    assert len({r.shot_id for r in got}) == 1101 and {r.shot_id for r in got if r.narr == "new"} == {"S1101"} and not any(r.narr == "old" for r in got)


def test_pages_of_one_and_of_two_columns():
    line = lambda y, xs, words: [(0, x, y, w) for x, w in zip(xs, words, strict=True)]
    number = lambda runs: [(i, *r[1:]) for i, r in enumerate(runs)]
    one = number([r for k in range(12) for r in line(700 - 14 * k, range(50, 550, 50), [f"{k}.{i} " for i in range(10)])])
    assert readers.page_text(one).split("\n") == ["".join(f"{k}.{i} " for i in range(10)).rstrip() for k in range(12)]
    two = number([r for k in range(8) for r in line(700 - 14 * k, (50, 90, 320, 360), (f"a{k}", "b", f"c{k}", "d"))])
    assert readers.page_text(two).split("\n") == [f"a{k}b" for k in range(8)] + [f"c{k}d" for k in range(8)]
    indented = number([r for k in range(12) for r in line(700 - 14 * k, [80 if k % 4 == 0 else 50, 300], ["x", "y"])][:-20])
    assert readers.page_text(indented) == "xy\nxy"
    assert readers.page_text([]) == ""


def test_text_in_a_wrong_encoding_is_garbled(spark):
    bad = "".join(random.Random(3).choice("éàüß‰Š§¶") for _ in range(300))
    rows = spark.createDataFrame([(bad,), ("A plain English text, of some length. " * 10,), ("短",), ("漢字" * 150,), ("Üb" + "er die Brücke ging er schön langsam. " * 8,)], "text string")
    assert [r.g for r in rows.select(looks_garbled(F.col("text")).alias("g")).collect()] == [True, False, False, False, False]


def test_looks_equal_a_plain_fold(spark):
    """The choice for each person in turn, written out for one novel."""
    names = ["林探長", "母親", "甲一", "乙二", "丙三", "丁四", "戊五", "己六"]
    people_ = spark.createDataFrame([(1, i, n, "f" if n == "母親" else "m", "現代", False, "黑色電影") for i, n in enumerate(names)], "novel_id long, rank int, name string, gender string, era string, modern boolean, style string")
    got = {r.name: r for r in looks.suggest_look(people_).collect()}
    for kind, step in looks.PARTS:
        used: list[str] = []
        for rank, name in enumerate(names):
            sex = "f" if name == "母親" else "m"
            pool = looks.outfits(name, "現代", sex, False, "黑色電影") if kind == "outfit" else looks.allowed(kind, "現代", sex, False)
            first = (looks.fnv(f"{name}#{kind}") + rank * step) % len(pool)
            order = [pool[(first + k) % len(pool)] for k in range(len(pool))]
            fresh = [v for v in order if v not in used]
            want = order[0] if kind == "eyes" or not fresh else fresh[0]
            used.append(want)
            assert got[name][kind] == want, (kind, name)
    assert got["林探長"].outfit in dict(looks.DEFAULT.ROLE_OUTFITS)["探長|警官|刑警|偵探"]
    assert got["乙二"].outfit in dict(looks.DEFAULT.STYLE_OUTFITS)["黑色電影"]


def test_checks_of_a_lexicon_find_every_hidden_key(spark):
    rng = random.Random(5)
    rows = [("a" if i % 3 else "b", i, "".join(rng.choice("甲乙丙") for _ in range(rng.randrange(0, 5)))) for i in range(120)]
    got = {(r.list, r.key, r.problem) for r in mining.lexicon_checks(spark.createDataFrame(rows, "list string, ord int, key string")).collect()}
    want = {(n, k, "repeated") for n, _, k in rows if sum((x[0], x[2]) == (n, k) for x in rows) > 1} | {(n, k, "empty") for n, _, k in rows if not k}
    want |= {(n, k, "hides a longer key") for n, i, k in rows for m, j, x in rows if k and n == m and i < j and len(x) > len(k) and k in x}
    assert got == want


def test_regex_keys_of_a_lexicon(spark):
    texts = spark.createDataFrame([(1, "書房裡有書齋，屋頂很高。書房。")], "novel_id long, text string")
    lex = spark.createDataFrame([("place", 0, "書房|書齋", True), ("place", 1, "天台|屋頂", True), ("place", 2, "河邊", False), ("place", 3, "廟|寺", True)], "list string, ord int, key string, is_regex boolean")
    hits = mining.term_hits(texts, lex)
    assert {r.key: r.hits for r in hits.collect()} == {"書房|書齋": 2, "天台|屋頂": 0, "河邊": 0, "廟|寺": 0}
    assert {r.key for r in mining.dead_entries(texts, lex).collect()} == {"河邊", "廟|寺"} and mining.hit_rates(hits).first().rate == 0.25


def test_a_short_novel_has_failed_and_banned_words_are_leaks(spark):
    eras = spark.createDataFrame([(1, "古裝"), (2, "古裝"), (3, "古裝")], "novel_id long, era string")
    shots = spark.createDataFrame([(1, "字" * 40)] * 5 + [(2, "字" * 40)] * 5 + [(3, "手機")], "novel_id long, narr string")
    output = shots.selectExpr("novel_id", "narr AS text").union(spark.createDataFrame([(1, "手機和電腦"), (1, "手機")], "novel_id long, text string"))
    assert {r.novel_id: (r.status, r.leaks) for r in audit.era_leak_scan(eras, output, shots).collect()} == {1: ("leaks", "手機,電腦"), 2: ("clean", ""), 3: ("failed", "手機")}


def test_people_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "。" * 50), (4, "狄明說。" * 2000)], "novel_id long, text string")
    assert {(r.novel_id, r.name) for r in people.persons(rows).collect()} == {(4, "狄明")}


def test_settled_tables_are_not_broadcast(spark):
    """Their files are small and their rows are not: joins by novel stay merge joins; a table that is broadcast by name still is."""
    people = settled(spark.range(20_000).selectExpr("id DIV 8 AS novel_id", "'馬華' AS name", "id AS rank"))
    cast = people.groupBy("novel_id").agg(F.collect_list("name").alias("names"))
    shots = spark.range(40_000).selectExpr("id DIV 16 AS novel_id", "id AS shot_no")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(shots.join(cast, "novel_id", "left")) and "Broadcast" not in plan(people.join(shots, "novel_id"))
    assert "BroadcastHashJoin" in plan(people.join(F.broadcast(spark.createDataFrame([("馬華",)], "name string")), "name"))


def test_leaks_of_shots_are_found_where_the_shots_are_counted(spark):
    """The shots' own texts need no second pass as output."""
    eras = spark.createDataFrame([(1, "古裝"), (2, "古裝"), (3, "古裝")], "novel_id long, era string")
    shots = spark.createDataFrame([(i, "他走進書房看著窗外的月色想起後來的事情很久很久" * (5 if i < 3 else 1), "他，手機放大看清" if i == 1 else None) for i in (1, 2, 3) for _ in range(5 if i < 3 else 1)], "novel_id long, narr string, lens string")
    output = spark.createDataFrame([(1, "電腦"), (3, "手機"), (2, None)], "novel_id long, text string")
    told = lambda rows: {r.novel_id: (r.status, r.leaks) for r in rows.collect()}
    once = told(audit.era_leak_scan(eras, output, shots, texts=("narr", "lens")))
    assert once == {1: ("leaks", "手機,電腦"), 2: ("clean", ""), 3: ("failed", "手機")}
    every = output.union(shots.select("novel_id", F.explode(F.array("narr", "lens"))))
    assert once == told(audit.era_leak_scan(eras, every, shots))


def test_outfits_are_chosen_from_once_for_all_people_alike(spark, monkeypatch):
    """Searching the pools for each person took most of the time of a look; the people of all novels share a few choices."""
    kept, asked = [], []
    plain, column = looks.outfits, looks.arrow_column
    monkeypatch.setattr(looks, "arrow_column", lambda *a: kept.append(a[-1]) or column(*a))
    people = [{"rank": i, "name": name, "gender": sex, "era": era, "modern": era == "現代", "style": style} for i, name in enumerate(("馬華", "林探長", "王醫生", "阿信")) for sex in ("f", "m", "") for era in looks.ERAS for style in ("", "無此風格")]
    looks.suggest_look(spark.createDataFrame([(1, *people[0].values())], "novel_id long, rank int, name string, gender string, era string, modern boolean, style string"))
    monkeypatch.setattr(looks, "outfits", lambda *a: asked.append(a) or plain(*a))
    for p in people * 3:
        sex = "f" if p["gender"] == "f" else "m"
        pool = plain(p["name"], p["era"], sex, p["modern"], p["style"]) or [""]
        assert kept[0]([p])[0][-1] == pool[(looks.fnv(f"{p['name']}#outfit") + p["rank"]) % len(pool)]
    assert len(asked) <= 24
