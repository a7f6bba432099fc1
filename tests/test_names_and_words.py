"""Many words in one reading, and names with surnames of several characters."""

import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talewright.functions import automaton
from talewright.functions.lexicon import DEFAULT, read_lexicon
from talewright.functions.shared import slices
from talewright.operators import mining, people, places


def _novel(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "novel_id long, text string")


def _plain(words, text):
    """Of every word the places from left to right that do not overlap the one before."""
    out = Counter()
    for w in words:
        at = text.find(w)
        while at >= 0:
            out[w] += 1
            at = text.find(w, at + len(w))
    return out


def test_counts_equal_plain_counts():
    rng = random.Random(2)
    for _ in range(300):
        words = ["".join(rng.choice("ab雨") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))]
        text = "".join(rng.choice("ab雨") for _ in range(rng.randint(0, 40)))
        assert automaton.counts(automaton.of_words(words), text) == _plain(set(words), text)
    assert automaton.counts(automaton.of_words(["aa"]), "aaaaa") == {"aa": 2}
    assert automaton.counts(automaton.of_words(["", "a"]), None) == {} and automaton.counts(automaton.of_words([]), "a") == {}


def test_totals_in_one_or_many_parts(spark):
    texts = _novel(spark, "書房書房裡的書", None, "", "走廊上有書房，書房外有走廊")
    words = spark.createDataFrame([("書房",), ("書",), ("走廊",), ("沒有",), ("",), (None,), ("書房",)], "word string")
    want = {"書房": 4, "書": 5, "走廊": 2}
    for limit in (1, 10, automaton.LIMIT):
        assert {r.word: r.n for r in automaton.totals(texts, words, limit=limit).collect()} == want


def test_term_hits_and_dead_entries_of_regexes(spark):
    lex = spark.createDataFrame([("place", "書房|書齋", True), ("place", "天台|屋頂", True), ("role", "醫生", False), ("role", "a|b", False), ("role", "尼", False), ("odd", "^霧氣?", True)], "list string, key string, is_regex boolean")
    texts = _novel(spark, "醫生走進書齋。屋頂有霧氣。a|b", "醫生醫生")
    assert {(r.key, r.hits) for r in mining.term_hits(texts, lex).collect()} == {("書房|書齋", 0), ("天台|屋頂", 0), ("醫生", 3), ("a|b", 1), ("尼", 0), ("^霧氣?", 1)}
    assert {r.key for r in mining.dead_entries(texts, lex).collect()} == set()
    assert {r.key for r in mining.dead_entries(_novel(spark, "醫生"), lex).collect()} == {"書房|書齋", "天台|屋頂", "a|b", "^霧氣?"}


def test_many_keys_take_hardly_longer_than_few(spark):
    """Ten thousand keys against fifty, over texts that hold the fifty only."""
    texts = _novel(spark, *("夜裡的雨落在第一座碼頭上，醫生走進書房。" * 400 for _ in range(40))).repartition(4)
    keys = ["碼頭", "醫生", "書房"] + [chr(0x4E00 + i) + chr(0x5E00 + i) for i in range(47)]
    more = keys + [chr(0x4E00 + i % 5000) + chr(0x6E00 + i // 3) + "詞" for i in range(10_000)]

    def took(some):
        lex = spark.createDataFrame([("x", k, False) for k in some], "list string, key string, is_regex boolean").persist()
        lex.count()
        mining.term_hits(texts, lex).collect()
        began = time.perf_counter()
        hits = {r.key: r.hits for r in mining.term_hits(texts, lex).collect()}
        return time.perf_counter() - began, hits

    few, many = took(keys), took(more)
    assert many[0] < 3 * few[0] + 2
    assert many[1]["碼頭"] == few[1]["碼頭"] == 16_000 and sum(many[1].values()) == sum(few[1].values())


def test_places_are_counted_in_one_reading(spark):
    rows = places.place_counts(_novel(spark, "衙門口的人走進衙門，衙門口", None)).collect()
    assert {(r.novel_id, r.name, r.n) for r in rows} == {(0, "衙門", 3), (0, "衙門口", 2)}


def test_longest_surname_wins():
    trie = people.Trie(["歐", "歐陽", "司馬", "陳"])
    assert [trie.longest(s) for s in ("歐陽修", "歐洲", "司機", "司馬", "陳", "", "王")] == [2, 1, 0, 2, 1, 0, 0]


@pytest.mark.parametrize("s, name", [("歐陽修", True), ("司馬相如", True), ("歐陽", True), ("司馬相如說", False), ("王美麗", True), ("王美麗人", False), ("阿信", True), ("阿的", False), ("向歐陽", False), ("醫生", False), ("王", False)])
def test_what_a_name_is(s, name):
    assert people.Rules().is_name(s) == name


@pytest.mark.parametrize(
    "rule, text, name",
    [
        ("p4", "，歐陽修說道：走。", "歐陽修"), ("p4", "司馬相如走進書房", "司馬相如"), ("p4", "對司馬相如說", "司馬相如"), ("p5", "，司馬相如很高興地說", "司馬相如"), ("p5", "。歐陽修微笑著說", "歐陽修"),
        ("p6", "我叫司馬相如，", "司馬相如"), ("p6", "他的名字叫歐陽修。", "歐陽修"), ("p6", "人人叫作王明，", "王明"), ("p6", "我是王明", "王明"), ("p8", "，歐陽修先生來了", "歐陽修"), ("p7", "找林探長去", "林探長"),
    ],
)
def test_rules_find_names_of_two_to_four_characters(spark, rule, text, name):
    assert {r.name for r in people.candidates(_novel(spark, text), (rule,)).collect()} == {name}


def test_heroes_with_compound_surnames_are_people(spark):
    text = "歐陽修說道：「走。」司馬相如推開門。歐陽修轉身。司馬相如很高興地問道：「誰？」歐陽修先生問。" * 2
    got = {r.name: r for r in people.persons(_novel(spark, text)).collect()}
    assert {"歐陽修", "司馬相如"} <= set(got) and "相如" not in got and "陽修" not in got


def test_a_table_of_surnames_takes_compound_ones(spark):
    rows = [("surnames", 0, "王", None), ("surnames", 1, "哥舒", None), ("intro", 0, "人稱", None)]
    lex = read_lexicon(spark.createDataFrame(rows, "list string, ord int, key string, value string"))
    assert lex.SURNAMES == "王" and lex.COMPOUND == ("哥舒",) and DEFAULT.COMPOUND != lex.COMPOUND
    assert {r.name for r in people.candidates(_novel(spark, "人稱哥舒翰。歐陽修說道"), ("p4", "p6"), lex).collect()} >= {"哥舒翰"}


def test_one_reading_gives_narrator_roles_and_pronouns(spark):
    text = "我叫馬華，我是探長。我走進書房。馬華說：「我我我」。醫生來了，醫生坐下，林醫生說。其他人問她。馬華看她。"
    row = people.scan(_novel(spark, text, None)).where("novel_id = 0").first()
    assert row.wo == 3 and any(a.startswith("走進") for a in row.after_me)
    assert sum(r.n for r in row.roles if r.role == "醫生") == 3 and {p.gender for p in row.pronouns} == {"f"}
    empty = people.scan(_novel(spark, None)).select("n_chars", "wo", F.size("found").alias("f"), F.size("roles").alias("r")).first()
    assert tuple(empty) == (0, 0, 0, 0)


def test_a_task_holds_a_slice_of_a_batch(spark):
    """Whatever Spark puts into a batch, few rows at a time become Python objects, and all come out in their order."""
    batch = pa.RecordBatch.from_pydict({"novel_id": list(range(3000)), "text": ["馬華說道。" * (1 + i % 7) for i in range(3000)]})
    cut = list(slices([batch], 100, 4000))
    assert pa.Table.from_batches(cut).equals(pa.table({c: batch.column(c) for c in batch.schema.names})) and all(b.num_rows <= 100 and b.nbytes <= 4000 for b in cut)
    assert [b.num_rows for b in slices([batch.slice(0, 3)], 100, 1)] == [1, 1, 1] and not list(slices([batch.slice(0, 0)]))

    class Batches:
        """Stands for a DataFrame that keeps what its tasks would run."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return [b.num_rows for b in run(iter([batch]))]

    read = people.scan(Batches())
    assert sum(read) == 3000 and max(read) <= 256


def test_words_are_counted_a_slice_at_a_time(spark):
    """Counts of a batch's texts come out slice by slice, as many as before."""
    batch = pa.RecordBatch.from_pydict({"novel_id": list(range(3000)), "text": ["書房" * (i % 3) for i in range(3000)]})

    class Batches:
        """Stands for a DataFrame that keeps what its tasks would run."""

        schema = spark.range(0).withColumnRenamed("id", "novel_id").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return list(run(iter([batch])))

    told = automaton.counts_by_row(Batches(), ["書房"])
    assert len(told) >= 3000 // 256 and max(b.num_rows for b in told) <= 256
    assert pa.Table.from_batches(told).to_pydict() == {"novel_id": [i for i in range(3000) if i % 3], "name": ["書房"] * 2000, "n": [i % 3 for i in range(3000) if i % 3]}
