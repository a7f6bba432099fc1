"""What the operators do to small passages of our own."""

import random

from pyspark.sql import functions as F

from talewright.functions import segment
from talewright.jobs.catalog import sentence_shots
from talewright.operators import classify, looks, mining, people, places, project, shots
from talewright.sources import readers


def _novel(spark, text):
    return spark.createDataFrame([(1, text)], "novel_id long, text string")


def _value(spark, column, text):
    return _novel(spark, text).select(column(F.col("text")).alias("v")).first().v


# -- text


def test_wrapped_lines_are_joined_and_headings_break(spark):
    text = "狄明走進\r\n書房，看見\n一封信。\n第一章 開端\n他走了。\n=====\n\nThe ship\nsailed on\n"
    got = segment.normalize(_novel(spark, text)).first().text
    assert got == "狄明走進書房，看見一封信。\n\n他走了。\n\nThe ship sailed on"


def test_sentences_are_not_cut_in_quotes():
    assert segment.split_sentences("他說：「走。快走！」然後走了。v1.5 works. Yes") == ["他說：「走。快走！」然後走了。", "v1.5 works.", "Yes"]
    assert segment.strip_front_matter([]) == [] and segment.shots_of("", 17) == []
    assert segment.split_sentences("「未完。還有") == ["「未完。還有"] and segment.split_sentences("」。好。") == ["」。", "好。"]


def test_sentences_keep_every_character():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("他說「」『』。！ab. \n，") for _ in range(60))
        assert "".join("".join(segment.split_sentences(text)).split()) == "".join(text.split())


def test_packing_and_splitting_keep_the_text():
    parts = [f"第{i}句話很短。" for i in range(40)]
    assert "".join(segment.pack(parts, 17)) == "".join(parts)
    long = "一段很長的句子，" * 12
    cut = segment.hard_split(long, 17)
    assert "".join(cut) == long and all(c.endswith("，") for c in cut) and max(map(len, cut)) <= 28
    assert segment.hard_split("字" * 50, 17) == ["字" * 17, "字" * 17, "字" * 16]


def test_front_matter_goes_and_the_body_stays():
    got = segment.strip_front_matter(["黑騎士案", "作者：甲", "某雜誌轉載自第六期", "天亮了，狄明走進書房。", "他坐下。", "版權所有"])
    assert got == ["天亮了，狄明走進書房。", "他坐下。"]


# -- classification


def test_styles_eras_and_seasons(spark):
    assert _value(spark, classify.guess_style, "偵探找到線索和證據。") == "黑色電影"
    assert _value(spark, classify.guess_style, "校園的教室裡，青春正好，偵探經過。") == "日系動畫"
    assert _value(spark, classify.guess_style, "他走了。") == "寫實電影感"
    assert [_value(spark, classify.detect_era, t) for t in ("縣衙裡", "留聲機響著", "留聲機和電話", "老爺、大人、江湖", "老爺坐汽車打電話，大人看報紙上的江湖")] == ["古裝", "近代", "現代", "古裝", "現代"]
    assert _value(spark, classify.detect_season, "時近中秋，二月的雪早忘了") == "冬天，濕冷"
    assert _value(spark, classify.detect_season, "中秋節") == "秋天，落葉堆在角落" and _value(spark, classify.detect_season, "無") == ""


def test_hash_is_the_same_in_columns_and_rows(spark):
    for text in ("", "a", "狄明#hair", "長" * 50):
        assert _value(spark, classify.stable_hash, text) == looks.fnv(text)


# -- people


def test_names_are_found_and_common_words_are_not(spark):
    text = "狄明說道：「走。」狄明推開門。馬華問道：「誰？」馬華轉身。王醫生走進書房，王醫生說：「好。」眾人高聲說道。阿信走了。阿信笑。阿信說。"
    got = {r.name: r for r in people.persons(_novel(spark, text)).collect()}
    assert {"狄明", "馬華", "王醫生", "阿信"} <= set(got) and not {"高聲", "眾人", "醫生"} & set(got)


def test_aliases_count_for_the_full_name(spark):
    text = "呂明山來了。山仔笑了。山仔說好。山仔走了。"
    got = {r.name: r["count"] for r in people.drop_half_names(people.fuse(people.candidates(_novel(spark, text)))).collect()}
    assert got["呂明山"] == 4 and "山仔" not in got
    assert "呂明山" not in {r.name for r in people.persons(_novel(spark, "山仔笑了。山仔說好。")).collect()}


def test_pronouns_go_to_the_nearest_name(spark):
    """A name's first pronoun decides; 其他 is none, and nothing is looked for beyond twenty characters."""
    cast = spark.createDataFrame([(1, 0, "甲子"), (1, 1, "乙丑")], "novel_id long, rank int, name string")
    text = "甲子坐下其他人他，後來乙丑來，她笑他" + "。" * 40 + "她"
    assert {(r.name, r.gender) for r in people.gender_by_pronoun(people.scan(_novel(spark, text)), cast).collect()} == {("甲子", "m"), ("乙丑", "f")}
    far = "甲子" + "，" * 19 + "她"
    assert people.gender_by_pronoun(people.scan(_novel(spark, far)), cast).count() == 0 and people.gender_by_pronoun(people.scan(_novel(spark, far[:2] + far[3:])), cast).count() == 1


def test_a_name_over_the_pronoun_is_found(spark):
    """A name may hold the pronoun (a surname and 她 before a verb); names that begin at or after the pronoun get nothing."""
    cast = spark.createDataFrame([(1, 1, "馬華"), (1, 2, "馬華她"), (1, 3, "她她"), (1, 4, "山仔")], "novel_id long, rank int, name string")
    got = lambda text: {(r.name, r.gender) for r in people.gender_by_pronoun(people.scan(_novel(spark, text)), cast).collect()}
    assert got("，馬華她說") == {("馬華", "f")}
    cast = cast.where("rank > 1")
    assert got("，馬華她說") == {("馬華她", "f")} and got("，馬華他說") == set()
    assert got("他山仔，馬華她") == {("馬華她", "f")} and got("，她她山仔") == {("她她", "f")} and got("，她山仔") == set()


# -- shots


def _annotated(spark, text, names=("母親", "狄明"), narrator="", genders=()):
    novels = _novel(spark, text)
    cast = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "novel_id long, rank int, name string")
    tell = spark.createDataFrame([(1, narrator)], "novel_id long, name string")
    sex = spark.createDataFrame([(1, n, g) for n, g in genders] or [(1, "-", "")], "novel_id long, name string, gender string")
    return [(r.who, r.who_from) for r in shots.resolve_subject(sentence_shots(novels), cast, tell, sex).orderBy("shot_no").collect()]


def test_subjects_of_shots(spark):
    got = _annotated(spark, "母親的杯子碎了。狄明看著母親，狄明笑。他走了。她哭了。我去找狄明。天黑。", narrator="馬華", genders=(("狄明", "m"), ("母親", "f")))
    assert got == [("", ""), ("狄明", "點名"), ("狄明", "代名詞"), ("", ""), ("馬華", "我＝敘述者"), ("", "")]
    assert _annotated(spark, "母親身邊的狄明神色忠厚。")[0] == ("狄明", "氣質詞")


def test_scenes_carry_on_until_the_next(spark):
    novels = _novel(spark, "起初無事。他走進書房。坐下。到了碼頭。風大。")
    rows = shots.scene_carry_forward(shots.scene_hit(sentence_shots(novels), places.places(novels))).orderBy("shot_no").collect()
    assert [r.scene for r in rows] == ["", "書房", "書房", "碼頭", "碼頭"]


def test_durations_have_bounds(spark):
    assert [_value(spark, shots.shot_duration, t) for t in ("短", "字" * 20, "字" * 500)] == [2.0, 4.6, 8.0]


# -- units and casts


def test_units_tile_the_shots_and_cut_at_scenes():
    rng = random.Random(2)
    for _ in range(100):
        n = rng.randrange(1, 400)
        scene, tenths = [rng.choice("甲乙丙") if rng.random() < 0.1 else "甲" for _ in range(n)], [rng.randrange(20, 80) for _ in range(n)]
        of, hard = project.unit_numbers(scene, tenths, 60, 90, 30)
        assert of == sorted(of) and set(of) == set(range(of[-1] + 1)) and len(hard) == of[-1] + 1
        for k in range(1, n):
            if of[k] != of[k - 1] and not hard[of[k - 1]]:
                assert scene[k] != scene[k - 1]


def test_cards_update_and_add(spark):
    kind = "name string, role string, desc string, ref string, face double, body double"
    old = spark.createDataFrame([("甲", "偵探", "舊", "", 0.85, 0.5), ("乙", "", "", "", 0.85, 0.5)], kind)
    cards = spark.createDataFrame([("甲", "", "新", "r.png", None, 0.3), ("丙", "", "客", "", None, None), ("", "x", "", "", None, None)], kind)
    got = {r.name: tuple(r)[1:] for r in project.import_cast_cards(old, cards).collect()}
    assert got == {"甲": ("偵探", "新", "r.png", 0.85, 0.3, "updated"), "乙": ("", "", "", 0.85, 0.5, "kept"), "丙": ("", "客", "", 0.85, 0.5, "added")}


def test_looks_differ_within_a_novel_and_stay_the_same(spark):
    rows = [(1, i, n, "m", "現代", False) for i, n in enumerate(("甲一", "乙二", "丙三", "丁四", "戊五"))]
    df = spark.createDataFrame(rows, "novel_id long, rank int, name string, gender string, era string, modern boolean")
    a, b = (sorted(map(tuple, looks.suggest_look(df).collect())) for _ in range(2))
    assert a == b and len({r[6] for r in a}) == 5 and len({r[2] for r in a}) == 5 and not any("手機" in r[5] for r in a)


# -- lexicons


def test_merging_a_lexicon_twice_changes_nothing(spark):
    kind = "list string, ord int, key string, value string"
    old = spark.createDataFrame([("a", 0, "門", "x"), ("b", 0, "窗", None)], kind)
    new = spark.createDataFrame([("a", 0, "大門口", None), ("a", 1, "門", "y"), ("b", 0, "窗", "z")], kind)
    once = mining.merge_lexicons(old, new)
    got = sorted((r.list, r.ord, r.key, r.value) for r in once.collect())
    assert got == [("a", 0, "大門口", "大門口特寫"), ("a", 1, "門", "x"), ("b", 0, "窗", None)]
    assert sorted((r.list, r.ord, r.key, r.value) for r in mining.merge_lexicons(once, new).collect()) == got


# -- sources


def test_bytes_are_decoded():
    text = "狄明走進書房。"
    assert readers.decode(text.encode("big5")) == (text, "big5") and readers.decode("狄公審問犯人，眾人齊聲說話，這個國家變化。".encode("gbk")) == ("狄公審問犯人，眾人齊聲說話，這個國家變化。", "gbk")
    assert readers.decode(b"\xef\xbb\xbf" + text.encode()) == (text, "utf-8") and readers.decode(b"\xff\xfe" + text.encode("utf-16le")) == (text, "utf-16le")


def test_docx_and_html_give_their_text():
    assert readers.docx_text(readers.make_docx("a <b> & c\nsecond")) == "a <b> & c\nsecond"
    assert readers.strip_html("<head><title>t</title></head><h1>A</h1><p>b<br>c &amp; d</p><script>x<1</script><nav>n</nav>") == "A\nb\nc & d"


def test_runs_drawn_twice_count_once():
    runs = [(0, 10, 700, "字"), (1, 10.5, 700, "字"), (2, 24, 699, "母"), (3, 10, 680, "二")]
    assert readers.page_text(runs) == "字母\n二"
