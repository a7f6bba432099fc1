"""Queries of descriptions of people and scenes (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talewright.functions import lexicon as lex
from talewright.functions.zh import NOVELS_SQL, quote
from talewright.operators import classify, looks, people, places
from talewright.plans import storyboard as plan

from .catalog import novels, query
from .people_queries import GENDERS_SQL, PERSONS_SQL
from .shot_queries import PLACES_SQL
from .text_queries import era_sql, hash_sql, season_for_sql, style_sql

_CLAUSES = "array_to_string(list_filter(string_split_regex(x.text, '[。！？，、；：\\n「」『』（）]'), lambda x: contains(x, p.name)), '｜')"
_HINTS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(near, '{p}') THEN '{h}' END" for p, h in lex.APPEARANCE) + "], lambda x: x IS NOT NULL), '，')"
HINTS_SQL = f"clauses AS (SELECT p.novel_id, p.name, {_CLAUSES} AS near FROM persons p JOIN novels x ON x.novel_id = p.novel_id), hints AS (SELECT novel_id, name, {_HINTS} AS hints FROM clauses)"


@query("d1_appearance_hints", f"WITH {PERSONS_SQL}, {HINTS_SQL} SELECT novel_id, name, hints FROM hints")
def d1(spark, sf_dir):
    texts = novels(spark, sf_dir)
    return looks.appearance_hints(texts, people.persons(texts))


_PLAIN = [r for r in lex.ROLES if r not in lex.KIN]
_AT = "list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * length(name)"
_JOB = "coalesce(" + ", ".join([
    *(f"CASE WHEN ends_with(name, '{r}') AND length(name) > {len(r)} THEN '{r}' END" for r in sorted(lex.ROLES, key=lambda r: -len(r))),
    *(f"CASE WHEN starts_with(after, '{r}') AND name <> '{r}' THEN '{r}' END" for r in _PLAIN),
    *(f"CASE WHEN contains(near, '{r}') AND name <> '{r}' THEN '{r}' END" for r in _PLAIN),
]) + ", '')"
AGE_JOB_SQL = f"""uses AS (SELECT p.novel_id, p.name, x.text, string_split(x.text, p.name) AS pieces FROM persons p JOIN novels x ON x.novel_id = p.novel_id AND contains(x.text, p.name)),
contexts AS (SELECT novel_id, name, array_to_string(list_transform(list_transform(range(1, least(6, len(pieces) - 1) + 1), lambda i: {_AT}), lambda k: substring(text, (greatest(k - 12, 0) + 1)::BIGINT, (length(name) + 12 + least(k, 12))::BIGINT)), '｜') AS near, substring(text, length(pieces[1]) + length(name) + 1, 4) AS after FROM uses),
age_job AS (SELECT novel_id, name, coalesce({', '.join(f"CASE WHEN contains(near, '{a}') THEN '{a}' END" for a in lex.AGES)}, '') AS age, {_JOB} AS job FROM contexts)"""


@query("d2_age_and_job", f"WITH {PERSONS_SQL}, {AGE_JOB_SQL} SELECT novel_id, name, age, job FROM age_job")
def d2(spark, sf_dir):
    texts = novels(spark, sf_dir)
    return looks.age_and_job(texts, people.persons(texts))


FACTS_SQL = f"facts AS (SELECT novel_id, style, era, modern, {season_for_sql('text', 'era')} AS season FROM (SELECT novel_id, text, {style_sql()} AS style, {era_sql()} AS era, regexp_matches(text, '{lex.MODERN_TECH}') AS modern FROM novels))"
_LIST = lambda values: "[" + ", ".join(map(quote, values)) + "]"


def _pool(kind: str) -> str:
    """The pool of a kind for era, sex and modern, by the library's own lists."""
    cases = " ".join(f"WHEN era = '{e}' AND sex = '{s}' AND modern = {m} THEN {_LIST(looks.allowed(kind, e, s, m))}" for e in looks.ERAS for s in "fm" for m in (False, True))
    if kind != "outfit":
        return f"CASE {cases} END"
    some = lambda values, e, m: [v for v in values if classify.era_allows(v, e, m)]
    first = [f"WHEN regexp_matches(name, '{p}') AND era = '{e}' AND modern = {m} THEN {_LIST(ok)}" for p, values in lex.ROLE_OUTFITS for e in looks.ERAS for m in (False, True) if (ok := some(values, e, m))]
    then = [f"WHEN style = '{n}' AND era = '{e}' AND modern = {m} THEN {_LIST(ok)}" for n, values in lex.STYLE_OUTFITS for e in looks.ERAS[1:] for m in (False, True) if (ok := some(values, e, m))]
    return f"CASE {' '.join(first + then)} {cases} END"


def _look(kind: str, step: int) -> str:
    """(novel_id, names, values): the choices of a kind along a novel's people, by rank."""
    element = f"{{'pool': {_pool(kind)}, 'at': {hash_sql(f'(name || {quote(chr(35) + kind)})')} + (rank - 1) * {step}, 'used': []::VARCHAR[], 'out': []::VARCHAR[]}}"
    turn = "list_transform(range(0, len(e.pool)), lambda k: e.pool[1 + ((e.at + k) % len(e.pool))::BIGINT])"
    value = f"coalesce(list_filter({turn}, lambda v: NOT list_contains(s.used, v))[1], ({turn})[1])" if kind != "eyes" else f"({turn})[1]"
    fold = f"list_reduce(list_prepend({{'pool': []::VARCHAR[], 'at': 0::BIGINT, 'used': []::VARCHAR[], 'out': []::VARCHAR[]}}, list({element} ORDER BY rank)), lambda s, e: list_transform([{value}], lambda v: {{'pool': e.pool, 'at': 0::BIGINT, 'used': list_append(s.used, v), 'out': list_append(s.out, v)}})[1])"
    return f"look_{kind} AS (SELECT novel_id, unnest(list(name ORDER BY rank)) AS name, unnest({fold}.out) AS {kind} FROM wearers GROUP BY novel_id)"


LOOKS_SQL = f"""{FACTS_SQL}, wearers AS (SELECT p.novel_id, p.rank, p.name, CASE WHEN g.gender = 'f' THEN 'f' ELSE 'm' END AS sex, f.era, f.modern, f.style FROM persons p JOIN genders g ON g.novel_id = p.novel_id AND g.name = p.name JOIN facts f ON f.novel_id = p.novel_id),
{', '.join(_look(k, n) for k, n in looks.PARTS)},
look AS (SELECT * FROM look_hair {' '.join(f'JOIN look_{k} USING (novel_id, name)' for k, _ in looks.PARTS[1:])})"""


def dressed(texts):
    persons, _ = plan.cast(texts)
    rows = persons.withColumn("rank", F.col("rank") - 1).join(plan.facts(texts).select("novel_id", "era", "modern", "style"), "novel_id")
    return looks.suggest_look(rows)


@query("d3_suggest_look", f"WITH {GENDERS_SQL}, {LOOKS_SQL} SELECT novel_id, name, hair, face, eyes, mark, outfit FROM look")
def d3(spark, sf_dir):
    return dressed(novels(spark, sf_dir))


DESC_SQL = f"""{AGE_JOB_SQL}, {HINTS_SQL}, {LOOKS_SQL}, described AS (
  SELECT p.novel_id, p.rank, p.name, p.count, p.role, concat_ws('；', nullif(concat_ws('，', CASE g.gender WHEN 'f' THEN '女性' WHEN 'm' THEN '男性' END, nullif(a.age, ''), coalesce(nullif(p.role, ''), nullif(a.job, ''), CASE WHEN w.name = p.name THEN '第一人稱敘述者' END)), ''), nullif(h.hints, ''), concat_ws('，', k.hair, k.face, k.eyes), k.outfit, k.mark) AS "desc"
  FROM persons p JOIN genders g ON g.novel_id = p.novel_id AND g.name = p.name JOIN look k ON k.novel_id = p.novel_id AND k.name = p.name LEFT JOIN age_job a ON a.novel_id = p.novel_id AND a.name = p.name LEFT JOIN hints h ON h.novel_id = p.novel_id AND h.name = p.name
  LEFT JOIN narrators w ON w.novel_id = p.novel_id)"""


@query("d4_draft_person_desc", f'WITH {GENDERS_SQL}, {DESC_SQL} SELECT novel_id, name, "desc" FROM described')
def d4(spark, sf_dir):
    texts = plan.settled(plan.facts(novels(spark, sf_dir)))
    return plan.described(texts, plan.cast(texts)[0]).select("novel_id", "name", "desc")


_POOLS = [(e, m, k, i, v) for e in looks.ERAS for m in (False, True) for k, only, _, values in lex.POOLS if only in ("", e) for i, v in enumerate(values)]
_BANS = [(e, m, p if m else f"{p}|{lex.MODERN_BAN}") for e, p in lex.ERA_BAN for m in (False, True)]
_ROWS = lambda rows, *names: f"(VALUES {', '.join('(' + ', '.join(quote(v) if isinstance(v, str) else str(v) for v in r) + ')' for r in rows)}) AS t({', '.join(names)})"


@query("d5_era_filter", f"WITH {NOVELS_SQL}, {FACTS_SQL}, pools AS (SELECT * FROM {_ROWS(_POOLS, 'era', 'modern', 'pool', 'ord', 'value')}), bans AS (SELECT * FROM {_ROWS(_BANS, 'era', 'modern', 'ban')}) SELECT f.novel_id, p.pool, p.ord, p.value FROM facts f JOIN pools p ON p.era = f.era AND p.modern = f.modern JOIN bans b ON b.era = f.era AND b.modern = f.modern WHERE NOT regexp_matches(p.value, b.ban)")
def d5(spark, sf_dir):
    """What every novel may choose from."""
    rows = plan.facts(novels(spark, sf_dir)).select("novel_id", F.explode(looks.era_filter(F.col("era"), F.col("modern"))).alias("p"))
    return rows.select("novel_id", "p.*")


def _cases(pairs, h: str, ban: str, nature: bool) -> str:
    out = []
    for t, values in pairs:
        for e in looks.ERAS:
            for n in (False, True) if nature else (False,):
                pool = looks.scene_pool(values, e, ban if n or not nature else "")
                on = f"type = '{t}' AND era = '{e}'" + (f" AND {'' if n else 'NOT '}regexp_matches(name, '{lex.NATURE}')" if nature else "")
                out.append(f"WHEN {on} THEN {_LIST(pool)}[1 + ({h} + rank - 1) % {len(pool)}]")
    return " ".join(out)


def _by_name() -> str:
    pools = [(p, e, looks.scene_pool(values, e)) for p, values in lex.SCENE_BY_NAME for e in looks.ERAS]
    return " ".join(f"WHEN regexp_matches(name, '{p}') AND era = '{e}' THEN {_LIST(pool)}[1 + ({hash_sql('(name || ' + quote('#name') + ')')} + rank - 1) % {len(pool)}]" for p, e, pool in pools)


_TEX = f"CASE {_by_name()} {_cases(lex.SCENE_TEXTURE, hash_sql('(name || ' + quote('#tex') + ')'), lex.PLACE_SPECIFIC, False)} END"
_LIGHT = f"CASE {_cases(lex.SCENE_LIGHT, hash_sql('(name || ' + quote('#slight') + ')'), lex.URBAN_LIGHT, True)} END"
#: Scenes with their descriptions, on facts.
SCENES_SQL = f"""set_ AS (SELECT p.*, f.era, f.season FROM places p JOIN facts f ON f.novel_id = p.novel_id), scenes AS (SELECT novel_id, rank, name, count, type, name || '：' || {_TEX} || '；' || {_LIGHT} || '；' || season AS "desc" FROM set_)"""


@query("d6_draft_scene_desc", f'WITH {NOVELS_SQL}, {FACTS_SQL}, {PLACES_SQL}, {SCENES_SQL} SELECT novel_id, name, "desc" FROM scenes')
def d6(spark, sf_dir):
    return plan.scenes_of(plan.facts(novels(spark, sf_dir))).select("novel_id", "name", "desc")
