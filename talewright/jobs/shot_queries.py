"""Queries of places and shot annotation (L, A), on the people, narrators and genders that the texts give."""

from __future__ import annotations

from pyspark.sql import functions as F

from talewright.functions import lexicon as lex
from talewright.functions.zh import NOVELS_SQL, quote, values_sql
from talewright.operators import people, places, shots
from talewright.plans import storyboard as plan

from .catalog import SHOTS_SQL, novels, packed_shots, query
from .people_queries import GENDERS_SQL
from .text_queries import hash_sql

_L1 = f"l1 AS (SELECT novel_id, name, len(regexp_extract_all(text, name))::BIGINT AS n FROM novels, {values_sql(lex.PLACES, 'name', 'type')} WHERE contains(text, name))"
# How texts declare a place, and what it counts.
_L2 = r"""l2 AS (SELECT novel_id, name, sum(n)::BIGINT AS n FROM (
  SELECT novel_id, trim(unnest(regexp_extract_all(text, '場景\s*[：:]\s*([^\n，,。；;]{2,12})', 1))) AS name, 99 AS n FROM novels
  UNION ALL SELECT novel_id, trim(unnest(regexp_extract_all(text, '[【〖]([^】〗]{2,12})[】〗]', 1))), 50 FROM novels) WHERE name <> '' GROUP BY ALL)"""
PLACES_SQL = f"""{_L1}, {_L2}, places AS (SELECT novel_id, rank, name, count, coalesce(type, '室外') AS type FROM (
  SELECT s.novel_id, s.name, s.count, t.type, row_number() OVER (PARTITION BY s.novel_id ORDER BY s.count DESC, t.ord NULLS LAST, s.name) AS rank
  FROM (SELECT novel_id, name, sum(n)::BIGINT AS count FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY ALL) s LEFT JOIN {values_sql(lex.PLACES, 'name', 'type')} ON t.name = s.name) WHERE rank <= 6)"""
#: The people, narrators and genders, then the shots.
CAST_SQL = f"{GENDERS_SQL}, {SHOTS_SQL.removeprefix(f'{NOVELS_SQL}, ')}"


@query("l1_place_counts", f"WITH {NOVELS_SQL}, {_L1} SELECT * FROM l1")
def l1(spark, sf_dir):
    return places.place_counts(novels(spark, sf_dir))


@query("l2_place_markers", f"WITH {NOVELS_SQL}, {_L2} SELECT * FROM l2")
def l2(spark, sf_dir):
    return places.place_markers(novels(spark, sf_dir))


@query("l3_top_places", f"WITH {NOVELS_SQL}, {PLACES_SQL} SELECT * FROM places")
def l3(spark, sf_dir):
    return places.places(novels(spark, sf_dir))


@query("a1_dialogue_flag", f"WITH {SHOTS_SQL} SELECT novel_id, shot_no, contains(narr, '「') OR contains(narr, '『') AS dialogue FROM shots")
def a1(spark, sf_dir):
    return packed_shots(novels(spark, sf_dir)).select("novel_id", "shot_no", shots.is_dialogue(F.col("narr")).alias("dialogue"))


SCENED_SQL = f"""{SHOTS_SQL}, {PLACES_SQL}, scene_hits AS (
  SELECT s.novel_id, s.shot_no, s.narr, (SELECT arg_min(p.name, p.rank) FROM places p WHERE p.novel_id = s.novel_id AND contains(s.narr, p.name)) AS hit FROM shots s
), scened AS (SELECT *, coalesce(last_value(hit IGNORE NULLS) OVER (PARTITION BY novel_id ORDER BY shot_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS scene FROM scene_hits)"""


def hit(texts):
    return shots.scene_hit(packed_shots(texts), places.places(texts))


def scened(texts):
    return shots.scene_carry_forward(hit(texts))


@query("a2_scene_hit", f"WITH {SCENED_SQL} SELECT novel_id, shot_no, hit FROM scene_hits")
def a2(spark, sf_dir):
    return hit(novels(spark, sf_dir)).select("novel_id", "shot_no", "hit")


@query("a3_scene_carry_forward", f"WITH {SCENED_SQL} SELECT novel_id, shot_no, scene FROM scened")
def a3(spark, sf_dir):
    return scened(novels(spark, sf_dir)).select("novel_id", "shot_no", "scene")


# Places of a name or alias in a shot, from 0, by the lengths of what lies between; own: not followed by a modifier's mark.
MENTIONS_SQL = f"""{CAST_SQL}, words AS (SELECT novel_id, rank, name, name AS word FROM persons UNION ALL SELECT p.novel_id, 1000 + t.ord, p.name, t.alias FROM persons p JOIN {values_sql(lex.ALIASES, 'alias', 'full_name')} ON t.full_name = p.name),
pieces AS (
  SELECT s.novel_id, s.shot_no, s.narr, p.name, p.word, p.rank, string_split(s.narr, p.word) AS pieces FROM shots s JOIN words p ON p.novel_id = s.novel_id AND contains(s.narr, p.word)
), found AS (SELECT novel_id, shot_no, narr, name, word, rank, list_transform(range(1, len(pieces)), lambda i: (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * length(word))::BIGINT) AS hits,
  list_transform(list_filter(range(1, len(pieces)), lambda i: NOT regexp_matches(pieces[i + 1], '^[的家宅府]')), lambda i: (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * length(word))::BIGINT) AS own FROM pieces)"""
_TRAIT_SQL = f"""trait AS (SELECT novel_id, shot_no, arg_min(name, {{'o': ord, 'g': gap, 'r': rank}}) AS trait_name, arg_min(phrase, {{'o': ord, 'g': gap, 'r': rank}}) AS phrase FROM (
  SELECT *, k - list_max(list_filter(hits, lambda h: h < k)) - length(word) AS gap FROM (SELECT f.*, t.ord, t.phrase, strpos(f.narr, t.key) - 1 AS k FROM found f JOIN {values_sql(lex.TRAITS, 'key', 'phrase')} ON contains(f.narr, t.key)))
  WHERE gap BETWEEN 0 AND 8 GROUP BY novel_id, shot_no)"""
_NAMED_SQL = """named AS (SELECT novel_id, shot_no, arg_min(name, {'n': -len(own), 'a': list_min(own), 'r': rank}) AS named, arg_min(list_min(hits), {'n': -len(own), 'a': list_min(own), 'r': rank}) AS raw_at FROM found WHERE len(own) > 0 GROUP BY novel_id, shot_no)"""
_LAST_SQL = """lastm AS (SELECT novel_id, shot_no, arg_min(name, {'s': -spot, 'r': rank}) AS mention FROM (SELECT *, greatest(coalesce(list_max(own), -1), CASE WHEN list_contains(hits, 0) THEN 0 ELSE -1 END) AS spot FROM found WHERE word = name) WHERE spot >= 0 GROUP BY novel_id, shot_no)"""


def found(texts):
    return shots.mentions(packed_shots(texts), plan.settled(people.persons(texts)))


@query("a4_trait_subject", f"WITH {MENTIONS_SQL}, {_TRAIT_SQL} SELECT novel_id, shot_no, trait_name, phrase FROM trait")
def a4(spark, sf_dir):
    return shots.trait_subject(found(novels(spark, sf_dir)))


@query("a5_named_subject", f"WITH {MENTIONS_SQL}, {_NAMED_SQL} SELECT novel_id, shot_no, named FROM named")
def a5(spark, sf_dir):
    return shots.named_subject(found(novels(spark, sf_dir))).select("novel_id", "shot_no", "named")


@query("a6_last_mention", f"WITH {MENTIONS_SQL}, {_LAST_SQL} SELECT novel_id, shot_no, mention FROM lastm")
def a6(spark, sf_dir):
    return shots.last_mention(found(novels(spark, sf_dir)))


WHO_SQL = f"""{MENTIONS_SQL}, {_TRAIT_SQL}, {_NAMED_SQL}, {_LAST_SQL},
ctx AS (SELECT s.*, t.trait_name, t.phrase, n.named, n.raw_at, w.name AS narrator, strpos(regexp_replace(s.narr, '其[他她我]', '其其', 'g'), '我') - 1 AS me, regexp_replace(s.narr, '其[他她我]', '其其', 'g') AS clean,
  last_value(m.mention IGNORE NULLS) OVER (PARTITION BY s.novel_id ORDER BY s.shot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM shots s LEFT JOIN trait t ON t.novel_id = s.novel_id AND t.shot_no = s.shot_no LEFT JOIN named n ON n.novel_id = s.novel_id AND n.shot_no = s.shot_no LEFT JOIN lastm m ON m.novel_id = s.novel_id AND m.shot_no = s.shot_no LEFT JOIN narrators w ON w.novel_id = s.novel_id
), sexed AS (SELECT ctx.*, nullif(g.gender, '') AS gender, CASE WHEN contains(narr, '她') AND NOT contains(clean, '他') THEN 'f' WHEN contains(clean, '他') AND NOT contains(narr, '她') THEN 'm' ELSE '' END AS want FROM ctx LEFT JOIN genders g ON g.novel_id = ctx.novel_id AND g.name = ctx.prior
), subject AS (SELECT *, CASE WHEN trait_name IS NOT NULL THEN '氣質詞' WHEN named IS NOT NULL AND (me < 0 OR raw_at <= me) THEN '點名' WHEN me >= 0 AND narrator <> '' THEN '我＝敘述者' WHEN named IS NOT NULL THEN '點名'
  WHEN regexp_matches(clean, '[他她]') AND prior IS NOT NULL AND (want = '' OR gender IS NULL OR want = gender) THEN '代名詞' ELSE '' END AS who_from FROM sexed
), who AS (SELECT novel_id, shot_no, narr, phrase, who_from, CASE who_from WHEN '氣質詞' THEN trait_name WHEN '點名' THEN named WHEN '我＝敘述者' THEN narrator WHEN '代名詞' THEN prior ELSE '' END AS who FROM subject)"""


def subjects(texts):
    persons, narrators = plan.cast(texts)
    return shots.resolve_subject(packed_shots(texts), persons, narrators, persons)


@query("a7_resolve_subject", f"WITH {WHO_SQL} SELECT novel_id, shot_no, who, who_from FROM who")
def a7(spark, sf_dir):
    return subjects(novels(spark, sf_dir)).select("novel_id", "shot_no", "who", "who_from")


SIZE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(narr, '{p}') THEN '{s}'" for p, s in lex.SIZES) + " WHEN contains(narr, '「') OR contains(narr, '『') THEN '近景' ELSE '中景' END"


@query("a8_shot_size", f"WITH {SHOTS_SQL} SELECT novel_id, shot_no, {SIZE_SQL} AS size FROM shots")
def a8(spark, sf_dir):
    return packed_shots(novels(spark, sf_dir)).select("novel_id", "shot_no", shots.shot_size(F.col("narr")).alias("size"))


_CYCLE = "[" + ", ".join(quote(m) for m in lex.MOVE_CYCLE) + "]"
MOVE_SQL = f"""CASE WHEN shot_no = 0 OR (lag(scene) OVER w <> '' AND lag(scene) OVER w <> scene) THEN '緩慢推近' WHEN contains(narr, '「') OR contains(narr, '『') THEN '固定' WHEN lead(hit) OVER w IS NOT NULL THEN '緩慢拉遠' ELSE {_CYCLE}[1 + shot_no % 4] END"""


@query("a9_camera_move", f"WITH {SCENED_SQL} SELECT novel_id, shot_no, {MOVE_SQL} AS move FROM scened WINDOW w AS (PARTITION BY novel_id ORDER BY shot_no)")
def a9(spark, sf_dir):
    return shots.camera_move(scened(novels(spark, sf_dir))).select("novel_id", "shot_no", "move")


CHARS_SQL = "length(regexp_replace(narr, '[\\s　]', '', 'g'))"
DUR_SQL = f"least(8.0, greatest(2.0, floor({CHARS_SQL}::DOUBLE / 260.0::DOUBLE * 60 * 10 + 0.5) / 10))::DOUBLE"


@query("a10_shot_duration", f"WITH {SHOTS_SQL} SELECT novel_id, shot_no, {DUR_SQL} AS dur, {CHARS_SQL} AS n_chars FROM shots")
def a10(spark, sf_dir):
    return packed_shots(novels(spark, sf_dir)).select("novel_id", "shot_no", shots.shot_duration(F.col("narr")).alias("dur"), shots.n_chars(F.col("narr")).alias("n_chars"))


def _case(rows) -> str:
    return "CASE " + " ".join(f"WHEN contains(narr, '{k}') THEN '{p}'" for k, p in rows) + " END"


_ACTS = "list_filter([" + ", ".join(f"CASE WHEN contains(narr, '{k}') THEN '{p}' END" for k, p in lex.CUES["action"]) + "], lambda x: x IS NOT NULL)[1:2]"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(narr, '{p}') THEN '{n}'" for n, p in lex.KINDS) + " END"
CUES_SQL = ", ".join(f"{_case(lex.CUES[n])} AS {n}" for n in ("face", "light", "object", "noun", "jump")) + f", {_ACTS} AS actions, {_KIND} AS kind, regexp_matches(narr, '{lex.ADDRESS}') AS address, regexp_matches(narr, '{lex.CROWD}') AS crowd"


@query("a11_cue_tags", f"WITH {SHOTS_SQL} SELECT novel_id, shot_no, {CUES_SQL} FROM shots")
def a11(spark, sf_dir):
    return shots.cue_tags(packed_shots(novels(spark, sf_dir))).drop("narr")


def _pick(values, salt: str) -> str:
    return f"[{', '.join(quote(v) for v in values)}][1 + {hash_sql('(narr || ' + quote('#' + salt) + ')')} % {len(values)}]"


_OF_KIND = lambda some: "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in some) + " END"
_KINDS = list(shots.KIND_LENS.items())
LENS_SQL = f"""{WHO_SQL}, {PLACES_SQL}, scene_hits AS (SELECT s.novel_id, s.shot_no, (SELECT arg_min(p.name, p.rank) FROM places p WHERE p.novel_id = s.novel_id AND contains(s.narr, p.name)) AS hit FROM shots s),
scened AS (SELECT *, coalesce(last_value(hit IGNORE NULLS) OVER (PARTITION BY novel_id ORDER BY shot_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS scene FROM scene_hits),
full_ AS (SELECT w.*, s.hit, s.scene, {SIZE_SQL} AS size, {CUES_SQL} FROM who w JOIN scened s USING (novel_id, shot_no)),
lens_parts AS (SELECT *, list_filter([
  CASE WHEN who <> '' THEN who || CASE WHEN phrase IS NOT NULL THEN '，' || phrase WHEN face IS NOT NULL THEN '，' || face ELSE '' END || CASE WHEN len(actions) > 0 THEN '，' || array_to_string(actions, '、') WHEN crowd THEN '{shots.TOGETHER}' WHEN face IS NULL THEN '，' || size || {_pick(shots.REACTIONS, 'rxn')} ELSE '' END END,
  CASE WHEN hit <> scene THEN '{shots.CUT_TO}' || hit END, CASE WHEN object IS NOT NULL THEN object || '{shots.CLEAR}' WHEN noun IS NOT NULL AND who = '' THEN noun || '{shots.INSERT}' END, light, jump, CASE WHEN address THEN '{shots.TO_US}' END], lambda x: x IS NOT NULL) AS p FROM full_),
lenses AS (SELECT novel_id, shot_no, narr, who, who_from, hit, scene, size, substring(CASE WHEN len(p) > 0 THEN concat_ws('；', array_to_string(p, '；'), CASE WHEN len(actions) = 0 AND object IS NULL AND jump IS NULL THEN {_OF_KIND(_KINDS[: lex.MENTAL])} END)
  WHEN contains(narr, '「') OR contains(narr, '『') THEN {_pick(shots.UNSEEN, 'nod')} WHEN kind IS NOT NULL THEN {_OF_KIND(_KINDS)} WHEN scene <> '' THEN scene || {_pick(shots.EMPTY, 'empty')} ELSE '{shots.NOTHING[0]}' || size || '{shots.NOTHING[1]}' END, 1, 80) AS lens FROM lens_parts)"""


def full_shots(texts, persons=None, narrators=None, scenes=None, columns=("shot_no", "narr", "who", "scene", "size", "lens")):
    """Shots with what the columns name, from one reading of the texts."""
    if persons is None:
        persons, narrators = plan.cast(texts)
    return plan.drawn(texts, persons, narrators, places.places(texts) if scenes is None else scenes, columns=columns)


@query("a12_compose_lens", f"WITH {LENS_SQL} SELECT novel_id, shot_no, lens FROM lenses")
def a12(spark, sf_dir):
    return full_shots(novels(spark, sf_dir)).select("novel_id", "shot_no", "lens")
