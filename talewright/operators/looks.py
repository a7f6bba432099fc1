"""Descriptions of characters and scenes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewright.functions.lexicon import DEFAULT, Lexicon
from talewright.functions.segment import arrow_column

from .classify import era_allows, fnv, folded, mixed, stable_hash  # noqa: F401

CLAUSE_MARKS = "[。！？，、；：\n「」『』（）]"
ERAS = ("古裝", "近代", "現代")


def _cast(people: DataFrame) -> DataFrame:
    """(novel_id, _p): the names of a novel's few people, so that a text meets them all in its own row."""
    return people.groupBy("novel_id").agg(F.sort_array(F.collect_set("name")).alias("_p"))


#: Mentions of a person that are looked at, and characters to either side.
MENTIONS, AROUND = 6, 12


def mentioned(text: str, name: str) -> tuple[str, str]:
    """The contexts of a name's first mentions, joined by a bar, and what follows the first one (four characters, but no second mention)."""
    at: list[int] = []
    k = text.find(name)
    while k >= 0 and len(at) < MENTIONS:
        at.append(k)
        k = text.find(name, k + len(name))
    near = "｜".join(text[max(0, k - AROUND) : k + len(name) + AROUND] for k in at)
    after = text[at[0] + len(name) : at[1] if len(at) > 1 else None][:4] if at else ""
    return near, after


def contexts(novels: DataFrame, people: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """(novel_id, name, hints, near, after) of all people, from one pass over the texts: D1's hints, and what ``mentioned`` gives, null for a
    name that the text does not hold."""
    marks, looks = re.compile(CLAUSE_MARKS), [(re.compile(p).search, h) for p, h in lex.APPEARANCE]

    def told(t: dict) -> list[list[str | None]]:
        text, rows = t["text"] or "", []
        clauses = marks.split(text)
        for name in t["_p"]:
            near = "｜".join([c for c in clauses if name in c])
            hints = "，".join([h for search, h in looks if h is not None and search(near)])
            rows.append([name, hints, *(mentioned(text, name) if name and name in text else (None, None))])
        return rows

    joined = novels.select("novel_id", "text").join(_cast(people), "novel_id").select("novel_id", F.struct("text", "_p").alias("t"))
    rows = arrow_column(joined, "t", "_n", "array<array<string>>", told).select("novel_id", F.explode("_n").alias("n"))
    return rows.select("novel_id", *(F.col("n")[i].alias(c) for i, c in enumerate(("name", "hints", "near", "after"))))


def appearance_hints(novels: DataFrame, people: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """(novel_id, name, hints): what the clauses that hold the name say of a look, in the order of the rules."""
    return contexts(novels, people, lex).select("novel_id", "name", "hints")


def age_and_job(novels: DataFrame, people: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """(novel_id, name, age, job) from the contexts of the first six mentions, 12 characters to either side.

    job: the longest role that the name ends in, else the role right after the first mention, else the first role word of the
    lexicon, no kin, in the contexts.
    """
    return told_of(novels, people, lex).drop("hints")


def told_of(novels: DataFrame, people: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """D1 and D2 in one pass: (novel_id, name, age, job, hints) of the people that the text names."""
    rows = contexts(novels, people, lex).where("near IS NOT NULL")
    age = F.coalesce(*(F.when(F.contains("near", F.lit(a)), a) for a in lex.AGES), F.lit(""))
    by_length = sorted(lex.ROLES, key=lambda r: -len(r))
    suffix = [F.when(F.endswith("name", F.lit(r)) & (F.length("name") > len(r)), r) for r in by_length]
    plain = [r for r in lex.ROLES if r not in lex.KIN]
    after = [F.when(F.startswith("after", F.lit(r)) & (F.col("name") != r), r) for r in plain]
    close = [F.when(F.contains("near", F.lit(r)) & (F.col("name") != r), r) for r in plain]
    return rows.select("novel_id", "name", age.alias("age"), F.coalesce(*suffix, *after, *close, F.lit("")).alias("job"), "hints")


def allowed(kind: str, era: str, sex: str, modern_tech: bool, lex: Lexicon = DEFAULT) -> list[str]:
    """D5 for one pool: its values for era and sex without those that the era bans, or modern things where there are none."""
    return [v for k, e, s, values in lex.POOLS if k == kind and e in ("", era) and s in ("n", sex) for v in values if era_allows(v, era, modern_tech, lex)]


def era_filter(era: Column, modern_tech: Column, lex: Lexicon = DEFAULT) -> Column:
    """Array of (pool, ord, value): of all pools the values for an era, without those that it bans, or modern things where
    there are none. The lexicon's pools are filtered when the plan is made; a row only chooses."""
    kind = "array<struct<pool:string,ord:int,value:string>>"
    out = F.array().cast(kind)
    for e in ERAS:
        for modern in (False, True):
            every = [(k, i, v) for k, only, _, values in lex.POOLS if only in ("", e) for i, v in enumerate(values) if era_allows(v, e, modern, lex)]
            listed = F.array(*(F.struct(F.lit(k).alias("pool"), F.lit(i).alias("ord"), F.lit(v).alias("value")) for k, i, v in every)).cast(kind)
            out = F.when((era == e) & (modern_tech == F.lit(modern)), listed).otherwise(out)
    return out


def outfits(name: str, era: str, sex: str, modern: bool, style: str, lex: Lexicon = DEFAULT) -> list[str]:
    """The outfits to choose from: those of the first calling that the name shows, as far as the era allows them; else, but for the
    old era, those of the style; else those of the era."""
    for pattern, values in lex.ROLE_OUTFITS:
        if re.search(pattern, name) and (some := [v for v in values if era_allows(v, era, modern, lex)]):
            return some
    some = [v for v in dict(lex.STYLE_OUTFITS).get(style, ()) if era_allows(v, era, modern, lex)] if era != ERAS[0] else []
    return some or allowed("outfit", era, sex, modern, lex)


#: Parts of a look, and how far a person's rank moves the choice of each.
PARTS = (("hair", 1), ("face", 1), ("eyes", 2), ("mark", 5), ("outfit", 1))


def suggest_look(people: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """D3: (novel_id, name, hair, face, eyes, mark, outfit) of people with rank, gender, era, modern and maybe style: hash-chosen, and
    all but the eyes without a repeat within a novel while the pools last. The few people of a novel are dressed in one row, in the
    order of rank."""
    pools = {(k, e, s, m): allowed(k, e, s, m, lex) or [""] for k, _ in PARTS for e in ERAS for s in "fm" for m in (False, True)}
    callings, styles = [re.compile(pattern) for pattern, _ in lex.ROLE_OUTFITS], {style for style, _ in lex.STYLE_OUTFITS}
    worn: dict[tuple, list[str]] = {}  # outfits by all that they go by: callings in the name, era, sex, modern things and a style of the lexicon

    def clothes(p: dict, sex: str) -> list[str]:
        key = (*(bool(c.search(p["name"])) for c in callings), p["era"], sex, p["modern"], p["style"] if p["style"] in styles else None)
        if key not in worn:
            worn[key] = outfits(p["name"], p["era"], sex, p["modern"], p["style"], lex) or [""]
        return worn[key]

    def dress(cast: list[dict]) -> list[list[str]]:
        taken: dict[str, set[str]] = {k: set() for k, _ in PARTS}
        rows = []
        for p in cast:
            sex, look, h = ("f" if p["gender"] == "f" else "m"), [], folded(f"{p['name']}#")
            for kind, step in PARTS:
                pool = clothes(p, sex) if kind == "outfit" else pools[kind, p["era"], sex, p["modern"]]
                at = (mixed(folded(kind, h)) + p["rank"] * step) % len(pool)
                turn = pool[at:] + pool[:at]
                look.append(next((v for v in turn if v not in taken[kind]), turn[0]) if kind != "eyes" else turn[0])
                taken[kind].add(look[-1])
            rows.append([p["name"], *look])
        return rows

    people = people if "style" in people.columns else people.withColumn("style", F.lit(""))
    cast = people.groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "gender", "era", "modern", "style"))).alias("p"))  # the people of one novel
    rows = arrow_column(cast, "p", "l", "array<array<string>>", dress).select("novel_id", F.explode("l").alias("l"))
    return rows.select("novel_id", *(F.col("l")[i].alias(n) for i, n in enumerate(("name", *(k for k, _ in PARTS)))))


def draft_person_desc(p: DataFrame) -> DataFrame:
    """Desc of rows with gender, age, role, job, is_narrator, hints and the look, empty parts left out."""
    full = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    calling = F.coalesce(full(F.col("role")), full(F.col("job")), F.when(F.col("is_narrator"), "第一人稱敘述者"))
    head = F.concat_ws("，", F.when(F.col("gender") == "f", "女性").when(F.col("gender") == "m", "男性"), full(F.col("age")), calling)
    look = F.concat_ws("，", full(F.col("hair")), full(F.col("face")), full(F.col("eyes")))
    return p.withColumn("desc", F.concat_ws("；", *(full(c) for c in (head, F.col("hints"), look, F.col("outfit"), F.col("mark")))))


def _choose(values_by_case: list[tuple[object, list[str]]], h) -> object:
    out = F.lit("")
    for when, values in values_by_case:
        out = F.when(when, F.element_at(F.array(*(F.lit(v) for v in values)), (h % len(values) + 1).cast("int"))).otherwise(out)
    return out


def scene_pool(values: tuple[str, ...], era: str, ban: str = "", lex: Lexicon = DEFAULT) -> list[str]:
    """The values that an era allows, without those that ban matches where some are left; all if none is."""
    some = [v for v in values if era_allows(v, era, lex=lex)]
    return [v for v in some if not (ban and re.search(ban, v))] or some or list(values)


def draft_scene_desc(places: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """Desc of places with name, rank, type, era and season: texture, light and season. The texture is that of the place's
    name where there is one, else one of its type that belongs to no other place; natural places get no town light."""
    on = lambda t, e: (F.col("type") == t) & (F.col("era") == e)
    seeded = lambda salt: stable_hash(F.concat("name", F.lit(f"#{salt}"))) + F.col("rank")
    texture = _choose([(on(t, e), scene_pool(values, e, lex.PLACE_SPECIFIC, lex)) for t, values in lex.SCENE_TEXTURE for e in ERAS], seeded("tex"))
    for pattern, values in reversed(lex.SCENE_BY_NAME):
        texture = F.when(F.col("name").rlike(pattern), _choose([(F.col("era") == e, scene_pool(values, e, "", lex)) for e in ERAS], seeded("name"))).otherwise(texture)
    nature = F.col("name").rlike(lex.NATURE)
    light = _choose([(on(t, e) & (nature == F.lit(n)), scene_pool(values, e, lex.URBAN_LIGHT if n else "", lex)) for t, values in lex.SCENE_LIGHT for e in ERAS for n in (False, True)], seeded("slight"))
    return places.withColumn("desc", F.concat("name", F.lit("："), texture, F.lit("；"), light, F.lit("；"), F.col("season")))
