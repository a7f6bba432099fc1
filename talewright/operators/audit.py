"""Audits of finished storyboards; shots have novel_id, shot_no, narr, and who, scene, lens where an audit needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talewright.functions.lexicon import DEFAULT, Lexicon

from .shots import NO_ACTION, in_row, n_chars

FILLS = (("unseen", "聽者正對鏡頭|只見影子|話聲來自畫外"), ("reaction", "目光落到鏡頭外|背景化開|右邊留白|靜靜站著"), ("memory", "回想："), ("time", "光陰流過"), ("reason", "物證排開"), ("case", "事發之處"), ("weather", "天候："), ("none", NO_ACTION))


#: What a scene's description says where it says nothing of its own, and what belongs to towns only.
GENERIC_DESC = "白牆與日光|泥土小徑"
URBAN_DESC = "柏油|招牌|路燈|霓虹"


def quality_audit(shots: DataFrame, persons: DataFrame, scenes: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """Q1: per novel and in all (novel_id null): persons, places, shots, shots with credits, scenes with a description that fits
    anything, natural scenes with a town's things (of those that are not such), shots without a clear action and their share in %."""
    s = shots.groupBy("novel_id").agg(F.count("*").alias("shots"), F.count_if(F.col("narr").rlike(lex.CREDITS)).alias("credits"), F.count_if(F.contains("lens", F.lit(NO_ACTION))).alias("no_action"))
    p = persons.groupBy("novel_id").agg(F.count("*").alias("persons"))
    generic = F.col("desc").rlike(GENERIC_DESC)
    q = scenes.groupBy("novel_id").agg(F.count("*").alias("places"), F.count_if(generic).alias("generic"), F.count_if(~generic & F.col("name").rlike(lex.NATURE) & F.col("desc").rlike(URBAN_DESC)).alias("town_in_nature"))
    rows = s.join(p, "novel_id", "left").join(q, "novel_id", "left")
    sums = rows.rollup("novel_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("persons", "places", "shots", "credits", "generic", "town_in_nature", "no_action")))
    return sums.withColumn("no_action_pct", F.round(F.col("no_action") * 100 / F.col("shots"), 3))


def fill_breakdown(shots: DataFrame) -> DataFrame:
    """Q2: (fill, n): how many lenses match each pattern; a lens may match several."""
    matched = F.array_compact(F.array(*(F.when(F.col("lens").rlike(p), n) for n, p in FILLS)))
    return shots.select(F.explode(matched).alias("fill")).groupBy("fill").agg(F.count("*").alias("n"))


def fragment_rate(shots: DataFrame) -> DataFrame:
    """Q3: per novel the shots of at most 7 characters that do not end in punctuation, and their share."""
    short = (n_chars(F.col("narr")) <= 7) & ~F.col("narr").rlike("[。！？!?…」』]$")
    return shots.groupBy("novel_id").agg(F.count_if(short).alias("fragments"), F.round(F.avg(short.cast("int")), 6).alias("share"))


def longest_subject_run(shots: DataFrame) -> DataFrame:
    """Q4: per novel the longest run of shots with one subject: gaps and islands."""
    w, v = Window.partitionBy("novel_id").orderBy("shot_no"), Window.partitionBy("novel_id", "who").orderBy("shot_no")
    runs = shots.withColumn("island", F.row_number().over(w) - F.row_number().over(v)).where("who <> ''").groupBy("novel_id", "who", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("novel_id").agg(F.max("n").alias("longest"))


def repeated_lens(shots: DataFrame, least: int = 8) -> DataFrame:
    """Q5: (novel_id, lens, n) of lenses used so often in a novel."""
    return shots.groupBy("novel_id", "lens").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def no_subject_rate(shots: DataFrame) -> DataFrame:
    """Q6."""
    return shots.groupBy("novel_id").agg(F.round(F.avg((F.col("who") == "").cast("int")), 6).alias("rate"))


def scene_conflicts(shots: DataFrame, places: DataFrame) -> DataFrame:
    """Q7: (novel_id, shot_no, scene) of shots that name places, none of them their scene."""
    rows = in_row(shots, places, "_p").withColumn("named", F.filter("_p", lambda p: F.contains(F.col("narr"), p)))
    return rows.where((F.size("named") > 0) & ~F.array_contains("named", F.col("scene"))).select("novel_id", "shot_no", "scene")


def missed_names(novels: DataFrame, people: DataFrame, least: int = 5, lex: Lexicon = DEFAULT) -> DataFrame:
    """Q8: (novel_id, name, n): 老X, 小X and X with a title, seen so often, that no known person contains or is contained in."""
    found = F.regexp_extract_all("text", F.lit(f"([老小][一-鿿]|[一-鿿](?:{'|'.join(lex.TITLES)}))"), F.lit(1))
    counts = novels.select("novel_id", F.explode(found).alias("name")).groupBy("novel_id", "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    known = people.groupBy("novel_id").agg(F.collect_list("name").alias("known"))  # the cast of one novel
    rows = counts.join(known, "novel_id", "left")
    related = F.exists("known", lambda k: F.contains(k, F.col("name")) | F.contains(F.col("name"), k))
    return rows.where(F.col("known").isNull() | ~related).select("novel_id", "name", "n")


def era_leak_scan(eras: DataFrame, output: DataFrame, shots: DataFrame, lex: Lexicon = DEFAULT, texts: tuple[str, ...] = ()) -> DataFrame:
    """Q9: (novel_id, status, leaks) of novels (novel_id, era): the distinct words that the era bans in what was made of the novel
    (output: novel_id, text; a row for each shot, picture and description). Under 100 Han characters or 5 shots it failed, never
    clean. Columns of shots that texts names are searched too, in the pass that counts the shots; output need not hold them then."""

    def banned(text: str) -> Column:
        out = F.array().cast("array<string>")
        for era, ban in lex.ERA_BAN:
            out = F.when((F.col("era") == era) & F.col(text).isNotNull(), F.regexp_extract_all(text, F.lit(f"({ban})"), F.lit(1))).otherwise(out)
        return out

    of = eras.select("novel_id", "era")
    distinct = lambda found: F.array_distinct(F.flatten(F.collect_set(found)))
    made = output.join(of, "novel_id").groupBy("novel_id").agg(distinct(F.array_distinct(banned("text"))).alias("made"))  # banned words only
    named = F.array_distinct(F.concat(*map(banned, texts))) if texts else F.array().cast("array<string>")
    told = shots.join(of, "novel_id").groupBy("novel_id").agg(F.count("*").alias("shots"), F.sum(F.regexp_count("narr", F.lit("[一-鿿]"))).alias("han"), distinct(named).alias("told"))
    rows = of.join(made, "novel_id", "left").join(told, "novel_id", "left")
    none = F.array().cast("array<string>")
    found = F.array_sort(F.array_union(F.coalesce("made", none), F.coalesce("told", none)))
    little = (F.coalesce("han", F.lit(0)) < 100) | (F.coalesce("shots", F.lit(0)) < 5)
    return rows.select("novel_id", F.when(little, "failed").when(F.size(found) > 0, "leaks").otherwise("clean").alias("status"), F.array_join(found, ",").alias("leaks"))


def run_report(novels: DataFrame, shots: DataFrame, scenes: DataFrame) -> DataFrame:
    """Q10: per novel with text and era: Han characters, shots, object close-ups, shots without action, and whether its scenes
    have one season (the last part of their descriptions)."""
    s = shots.groupBy("novel_id").agg(F.count("*").alias("shots"), F.count_if(F.col("size") == "物件").alias("close_ups"), F.count_if(F.contains("lens", F.lit(NO_ACTION))).alias("no_action"))
    seasons = scenes.groupBy("novel_id").agg((F.countDistinct(F.element_at(F.split("desc", "；"), -1)) <= 1).alias("one_season"))
    rows = novels.select("novel_id", "era", F.length(F.regexp_replace("text", "[^一-鿿]+", "")).cast("long").alias("han")).join(s, "novel_id").join(seasons, "novel_id", "left")
    return rows.withColumn("one_season", F.coalesce("one_season", F.lit(True)))
