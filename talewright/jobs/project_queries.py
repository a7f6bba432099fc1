"""Queries of units, casts, prompts and assets (U, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talewright.functions import lexicon as lex
from talewright.operators import places, project, shots
from talewright.plans import storyboard as plan

from .catalog import SHOTS_SQL, novels, packed_shots, query, table
from .desc_queries import DESC_SQL, FACTS_SQL, SCENES_SQL
from .shot_queries import CHARS_SQL, DUR_SQL, LENS_SQL, SCENED_SQL, SIZE_SQL, WHO_SQL, full_shots, scened, subjects

# Manuscripts of the projection are short, so units are a tenth of the usual length here.
LEAST, MOST, TAIL = 60, 90, 30
_TIMED = f"timed AS (SELECT novel_id, shot_no, narr, scene, {CHARS_SQL} AS n_chars, round({DUR_SQL} * 10)::BIGINT AS t FROM scened)"
_CUT = f"(w.e >= {LEAST * 10} AND n.scene <> '' AND n.scene <> w.scene)"
#: Units of timed shots.
WALK_SQL = f"""w(novel_id, shot_no, scene, u, e, hard) AS (
  SELECT novel_id, shot_no, scene, 0, t, FALSE FROM timed WHERE shot_no = 0
  UNION ALL SELECT n.novel_id, n.shot_no, n.scene, CASE WHEN {_CUT} OR w.e > {MOST * 10} THEN w.u + 1 ELSE w.u END, CASE WHEN {_CUT} OR w.e > {MOST * 10} THEN n.t ELSE w.e + n.t END, NOT {_CUT} AND w.e > {MOST * 10}
  FROM w JOIN timed n ON n.novel_id = w.novel_id AND n.shot_no = w.shot_no + 1
), walked AS (SELECT w.novel_id, w.shot_no, w.u, w.hard, timed.narr, timed.scene, timed.n_chars, timed.t, max(w.u) OVER (PARTITION BY w.novel_id) AS last_u FROM w JOIN timed ON timed.novel_id = w.novel_id AND timed.shot_no = w.shot_no
), tails AS (SELECT *, sum(CASE WHEN u = last_u THEN t ELSE 0 END) OVER (PARTITION BY novel_id) < {TAIL * 10} AND last_u > 0 AS merged FROM walked
), placed AS (SELECT novel_id, shot_no, narr, scene, n_chars, t, CASE WHEN merged AND u = last_u THEN u - 1 ELSE u END AS unit_no, hard, u FROM tails
), units AS (SELECT p.novel_id, p.unit_no, min(p.shot_no) AS from_shot, max(p.shot_no) AS to_shot, sum(p.t)::BIGINT AS t, coalesce(bool_or(h.hard), FALSE) AS hard FROM placed p
  LEFT JOIN (SELECT novel_id, u - 1 AS unit_no, bool_or(hard) AS hard FROM tails GROUP BY ALL) h ON h.novel_id = p.novel_id AND h.unit_no = p.unit_no GROUP BY p.novel_id, p.unit_no)"""
UNITS_SQL = f"{SCENED_SQL}, {_TIMED}, {WALK_SQL}"


def timed(texts):
    return scened(texts).withColumns({"dur": shots.shot_duration(F.col("narr")), "n_chars": shots.n_chars(F.col("narr"))})


def with_units(rows):
    return project.with_units(rows, LEAST, MOST, TAIL)


@query("u1_plan_units", f"WITH RECURSIVE {UNITS_SQL} SELECT novel_id, unit_no, from_shot, to_shot, t / 10 AS dur, hard FROM units")
def u1(spark, sf_dir):
    return project.plan_units(timed(novels(spark, sf_dir)), LEAST, MOST, TAIL)


_STATS = "stats AS (SELECT novel_id, count(*) AS shots, sum(n_chars)::BIGINT AS total_chars, sum(t)::BIGINT AS t FROM timed GROUP BY novel_id)"


@query("u2_novel_stats", f"WITH RECURSIVE {UNITS_SQL}, {_STATS} SELECT novel_id, shots, total_chars, t / 10 AS total_dur, floor(t / 60 + 0.5) / 10 AS minutes, (SELECT count(*) FROM units u WHERE u.novel_id = stats.novel_id) AS units FROM stats")
def u2(spark, sf_dir):
    return project.novel_stats(with_units(timed(novels(spark, sf_dir))))


@query(
    "u3_unit_summary",
    f"""WITH RECURSIVE {UNITS_SQL}, s AS (SELECT novel_id, unit_no, count(*) AS shots, sum(n_chars)::BIGINT AS chars, sum(t)::BIGINT AS t, arg_min(scene, shot_no) AS first_scene, arg_max(scene, shot_no) AS last_scene FROM placed GROUP BY ALL)
SELECT s.novel_id, s.unit_no, shots, chars, first_scene, last_scene, (sum(s.t) OVER w - s.t) / 10 AS start, sum(s.t) OVER w / 10 AS "end", s.t / 10 AS dur, s.t < {LEAST * 10} AS short, u.hard FROM s JOIN units u ON u.novel_id = s.novel_id AND u.unit_no = s.unit_no WINDOW w AS (PARTITION BY s.novel_id ORDER BY s.unit_no)""",
)
def u3(spark, sf_dir):
    return project.unit_summary(with_units(timed(novels(spark, sf_dir))), LEAST)


@query("u4_pace_check", f"WITH {SCENED_SQL}, {_TIMED}, {_STATS} SELECT novel_id, CASE WHEN t > 0 THEN round(total_chars / (t / 10) * 60, 3) END AS pace, coalesce(abs(round(total_chars / (t / 10) * 60, 3) - 260) > 26, FALSE) AS off FROM stats")
def u4(spark, sf_dir):
    rows = timed(novels(spark, sf_dir))
    stats = rows.groupBy("novel_id").agg(F.sum("n_chars").alias("total_chars"), (F.sum(project.tenths(F.col("dur"))) / 10).alias("total_dur"))
    return project.pace_check(stats)


@query("u5_estimate_units", "WITH m AS (SELECT doc_id, floor(n_chars / 260.0::DOUBLE * 10 + 0.5) / 10 AS minutes FROM documents) SELECT doc_id, minutes, greatest(1, ceil(minutes / 15))::INT AS fewest, greatest(1, floor(minutes / 10))::INT AS most FROM m")
def u5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", project.estimate_units(F.col("n_chars")).alias("e")).select("doc_id", "e.*")


@query(
    "u6_unit_label",
    r"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'doc_' || '00ab12cd' || '_' || source || '_OCR.pdf' WHEN doc_id % 5 = 1 THEN 'untitled.txt' ELSE source || '.docx' END AS n, doc_id % 3 AS u, doc_id % 2 + 1 AS k FROM documents),
b AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(n, '\.[A-Za-z0-9]+$', ''), '^doc_[0-9a-f]{6,}_', ''), '_OCR$', '')) AS t FROM x)
SELECT doc_id, CASE WHEN t IN ('', 'document', 'untitled', '原稿') THEN '原稿' || doc_id ELSE t END || CASE WHEN k > 1 THEN ' U' || (u + 1) ELSE '' END AS label FROM b""",
)
def u6(spark, sf_dir):
    i = F.col("doc_id")
    name = F.when(i % 5 == 0, F.concat(F.lit("doc_00ab12cd_"), "source", F.lit("_OCR.pdf"))).when(i % 5 == 1, F.lit("untitled.txt")).otherwise(F.concat("source", F.lit(".docx")))
    return table(spark, sf_dir, "documents").select("doc_id", project.unit_label(name, i, i % 3, i % 2 + 1).alias("label"))


@query("u7_assign_unit", f"WITH RECURSIVE {UNITS_SQL} SELECT novel_id, shot_no, unit_no FROM placed")
def u7(spark, sf_dir):
    return with_units(timed(novels(spark, sf_dir))).select("novel_id", "shot_no", "unit_no")


# Ten shots are a unit of a table; every other one reaches two shots into the next, the rest end two shots early.
@query(
    "u7_assign_from_table",
    f"""WITH {SHOTS_SQL}, t AS (SELECT DISTINCT novel_id, shot_no // 10 AS unit_no FROM shots), units AS (SELECT novel_id, unit_no, unit_no * 10 AS a, unit_no * 10 + CASE WHEN unit_no % 2 = 0 THEN 11 ELSE 7 END AS b FROM t)
SELECT s.novel_id, s.shot_no, u.unit_no FROM shots s LEFT JOIN units u ON u.novel_id = s.novel_id AND s.shot_no BETWEEN u.a AND u.b""",
)
def u7_table(spark, sf_dir):
    rows = packed_shots(novels(spark, sf_dir)).select("novel_id", "shot_no")
    k = F.floor(F.col("shot_no") / 10)
    units = rows.select("novel_id", k.alias("unit_no")).distinct()
    units = units.withColumns({"from_shot": F.col("unit_no") * 10, "to_shot": F.col("unit_no") * 10 + F.when(F.col("unit_no") % 2 == 0, 11).otherwise(7)})
    return project.assign_unit(rows, units)


# Cast cards made from documents: the project's from even sources, the incoming ones from all.
_CARDS = "SELECT source AS name, CASE WHEN count(*) % 2 = 0 THEN 'lead' ELSE '' END AS role, CASE WHEN count(*) % 3 = 0 THEN '' ELSE max(lang) END AS \"desc\", '' AS ref, CASE WHEN count(*) % 4 = 0 THEN NULL ELSE 0.7 END::DOUBLE AS face, 0.6::DOUBLE AS body FROM documents WHERE source IS NOT NULL GROUP BY source"
_OLD = "SELECT source AS name, 'old' AS role, 'kept look' AS \"desc\", 'r.png' AS ref, 0.85::DOUBLE AS face, 0.5::DOUBLE AS body FROM documents WHERE source IS NOT NULL AND doc_id % 40 < 20 GROUP BY source"


def _cards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    n = F.count("*")
    cards = docs.groupBy(F.col("source").alias("name")).agg(F.when(n % 2 == 0, "lead").otherwise("").alias("role"), F.when(n % 3 == 0, "").otherwise(F.max("lang")).alias("desc"), F.first(F.lit("")).alias("ref"), F.when(n % 4 == 0, F.lit(None)).otherwise(0.7).cast("double").alias("face"), F.first(F.lit(0.6)).alias("body"))
    old = docs.where("doc_id % 40 < 20").select(F.col("source").alias("name"), F.lit("old").alias("role"), F.lit("kept look").alias("desc"), F.lit("r.png").alias("ref"), F.lit(0.85).alias("face"), F.lit(0.5).alias("body")).distinct()
    return old, cards


@query("u8_merge_cast", f"WITH c AS ({_CARDS}), o AS ({_OLD}) SELECT * FROM o UNION ALL SELECT name, role, \"desc\", '' AS ref, 0.85::DOUBLE, 0.5::DOUBLE FROM c WHERE name NOT IN (SELECT name FROM o)")
def u8(spark, sf_dir):
    old, cards = _cards(spark, sf_dir)
    return project.merge_cast(old, cards)


_NEW_SCENES = "SELECT lang || '-' || source AS name, CASE WHEN count(*) % 2 = 0 THEN '室內' ELSE '室外' END AS type, max(lang) AS \"desc\" FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY lang, source"
_OLD_SCENES = "SELECT DISTINCT lang || '-' || source AS name, '室外' AS type, 'kept look' AS \"desc\", 's.png' AS ref, 0.4::DOUBLE AS body FROM documents WHERE source IS NOT NULL AND lang = 'en'"


@query("u8_merge_scenes", f"WITH c AS ({_NEW_SCENES}), o AS ({_OLD_SCENES}) SELECT * FROM o UNION ALL SELECT name, type, \"desc\", '', 0.65::DOUBLE FROM c WHERE name NOT IN (SELECT name FROM o)")
def u8_scenes(spark, sf_dir):
    """Scenes of every language and series, of which the project has those of one language."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL").withColumn("name", F.concat_ws("-", "lang", "source"))
    new = docs.groupBy("name").agg(F.when(F.count("*") % 2 == 0, "室內").otherwise("室外").alias("type"), F.max("lang").alias("desc"))
    old = docs.where("lang = 'en'").select("name", F.lit("室外").alias("type"), F.lit("kept look").alias("desc"), F.lit("s.png").alias("ref"), F.lit(0.4).alias("body")).distinct()
    return project.merge_scenes(old, new)


@query(
    "u9_import_cast_cards",
    f"""WITH c AS ({_CARDS}), o AS ({_OLD}) SELECT coalesce(o.name, c.name) AS name, coalesce(nullif(c.role, ''), o.role, '') AS role, coalesce(nullif(c."desc", ''), o."desc", '') AS "desc", coalesce(nullif(c.ref, ''), o.ref, '') AS ref,
coalesce(c.face, o.face, 0.85) AS face, coalesce(c.body, o.body, 0.5) AS body, CASE WHEN c.name IS NULL THEN 'kept' WHEN o.name IS NULL THEN 'added' ELSE 'updated' END AS outcome FROM o FULL OUTER JOIN c ON o.name = c.name""",
)
def u9(spark, sf_dir):
    old, cards = _cards(spark, sf_dir)
    return project.import_cast_cards(old, cards)


@query(
    "u10_replace_unit_shots",
    """WITH p AS (SELECT conv_id AS project_id, 'U' || turn // 2 AS unit, turn AS seq, text AS narr FROM conversations),
i AS (SELECT conv_id AS project_id, 'U' || turn // 2 AS unit, turn AS seq, '+' || text AS narr FROM conversations WHERE role = 'assistant'),
a AS (SELECT *, 0 AS turn FROM p WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.project_id = p.project_id AND i.unit = p.unit) UNION ALL SELECT *, 1 FROM i), n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY turn, unit, seq)::VARCHAR AS k FROM a)
SELECT project_id, unit, seq, narr, 'S' || CASE WHEN length(k) < 3 THEN lpad(k, 3, '0') ELSE k END AS shot_id FROM n""",
)
def u10(spark, sf_dir):
    """Each conversation is a project of units of two turns; the turns of the assistant come in anew."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project_id"), F.concat(F.lit("U"), F.floor(F.col("turn") / 2).cast("string")).alias("unit"), F.col("turn").alias("seq"), F.col("text").alias("narr"), "role")
    return project.replace_unit_shots(rows.drop("role"), rows.where("role = 'assistant'").withColumn("narr", F.concat(F.lit("+"), "narr")).drop("role"))


@query(
    "u10_first_style",
    """WITH p AS (SELECT conv_id AS project_id, max(CASE WHEN turn % 2 = 1 THEN role ELSE '' END) AS style FROM conversations WHERE turn < 2 GROUP BY 1), i AS (SELECT conv_id + 1 AS project_id, max(role) AS style FROM conversations GROUP BY 1)
SELECT coalesce(p.project_id, i.project_id) AS project_id, coalesce(nullif(p.style, ''), nullif(i.style, ''), '') AS style FROM p FULL OUTER JOIN i ON i.project_id = p.project_id""",
)
def u10_style(spark, sf_dir):
    """A conversation is a project, its style the role of its second turn; styles come in for all but the first project, and a new one."""
    rows = table(spark, sf_dir, "conversations")
    had = rows.where("turn < 2").groupBy(F.col("conv_id").alias("project_id")).agg(F.max(F.when(F.col("turn") % 2 == 1, F.col("role")).otherwise("")).alias("style"))
    return project.first_style(had, rows.groupBy((F.col("conv_id") + 1).alias("project_id")).agg(F.max("role").alias("style")))


#: Prompts of shots with who, scene and lens.
PROMPT_SQL = """concat_ws(chr(10) || chr(10), nullif(trim(p."desc"), ''), nullif(trim(q."desc"), ''), nullif(trim(l.lens), ''), f.style) AS prompt"""
PROMPT_FROM = """lenses l JOIN facts f ON f.novel_id = l.novel_id LEFT JOIN described p ON p.novel_id = l.novel_id AND p.name = l.who LEFT JOIN scenes q ON q.novel_id = l.novel_id AND q.name = l.scene"""


@query("b1_build_prompt", f"WITH {LENS_SQL}, {DESC_SQL}, {SCENES_SQL} SELECT l.novel_id, l.shot_no, {PROMPT_SQL} FROM {PROMPT_FROM}")
def b1(spark, sf_dir):
    texts = plan.settled(plan.facts(novels(spark, sf_dir)))
    persons, narrators = plan.cast(texts)
    return full_shots(texts, plan.described(texts, persons), narrators, plan.scenes_of(texts), ("shot_no", "prompt"))


_FACE = "CASE " + " ".join(f"WHEN size = '{n}' AND who <> '' THEN {f if f is not None else 'NULL'}::DOUBLE" for n, f, _ in lex.STRENGTHS) + " END"
_BODY = "CASE " + " ".join(f"WHEN size = '{n}' THEN {b}::DOUBLE" for n, _, b in lex.STRENGTHS) + " END"
_DOT = lambda x: f"regexp_replace(format('{{:.2f}}', {x}), '^0', '')"


STRENGTH_SQL = f"SELECT novel_id, shot_no, face, body, concat_ws('／', '臉部 ' || {_DOT('face')}, '主體 ' || {_DOT('body')}) AS text FROM (SELECT *, {_FACE} AS face, {_BODY} AS body FROM (SELECT novel_id, shot_no, who, {SIZE_SQL} AS size FROM who))"


@query("b2_ref_strength", f"WITH {WHO_SQL} {STRENGTH_SQL}")
def b2(spark, sf_dir):
    rows = subjects(novels(spark, sf_dir)).withColumn("size", shots.shot_size(F.col("narr")))
    return rows.select("novel_id", "shot_no", project.ref_strength(F.col("size"), F.col("who")).alias("r")).select("novel_id", "shot_no", "r.*")


@query("b3_timecode", f"WITH {SCENED_SQL}, {_TIMED}, c AS (SELECT novel_id, shot_no, coalesce(sum(t) OVER (PARTITION BY novel_id ORDER BY shot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM timed) SELECT novel_id, shot_no, b / 10 AS start, (b // 600)::VARCHAR || ':' || lpad(floor((b % 600) / 10 + 0.5)::INT::VARCHAR, 2, '0') AS code FROM c")
def b3(spark, sf_dir):
    return project.timecode(timed(novels(spark, sf_dir))).select("novel_id", "shot_no", "start", "code")


# Ten shots make a unit here.
@query(
    "b4_unit_cast",
    f"""WITH {WHO_SQL}, {SCENED_SQL.removeprefix(SHOTS_SQL + ', ')}, q AS (SELECT w.novel_id, w.shot_no // 10 AS unit_no, w.who, s.scene FROM who w JOIN scened s ON s.novel_id = w.novel_id AND s.shot_no = w.shot_no), u AS (SELECT DISTINCT novel_id, unit_no FROM q)
SELECT u.novel_id, u.unit_no, 'person' AS kind, p.name, EXISTS (SELECT 1 FROM q WHERE q.novel_id = u.novel_id AND q.unit_no = u.unit_no AND q.who = p.name) AS used FROM u JOIN persons p ON p.novel_id = u.novel_id
UNION ALL SELECT u.novel_id, u.unit_no, 'scene', p.name, EXISTS (SELECT 1 FROM q WHERE q.novel_id = u.novel_id AND q.unit_no = u.unit_no AND q.scene = p.name) FROM u JOIN places p ON p.novel_id = u.novel_id""",
)
def b4(spark, sf_dir):
    texts = novels(spark, sf_dir)
    persons, narrators = plan.cast(texts)
    scenes = plan.settled(places.places(texts))
    rows = full_shots(texts, persons, narrators, scenes).withColumn("unit_no", F.floor(F.col("shot_no") / 10))
    return project.unit_cast(rows, persons, scenes)


@query(
    "b5_unit_season",
    f"""WITH {SCENED_SQL}, {FACTS_SQL}, {SCENES_SQL}, d AS (SELECT novel_id, name, string_split("desc", '；')[-1] AS season FROM scenes), c AS (SELECT s.novel_id, s.shot_no // 10 AS unit_no, d.season, count(*) AS n, min(s.shot_no) AS first FROM scened s JOIN d ON d.novel_id = s.novel_id AND d.name = s.scene GROUP BY ALL)
SELECT novel_id, unit_no, arg_min(season, {{'n': -n, 'f': first}}) AS season FROM c GROUP BY ALL""",
)
def b5(spark, sf_dir):
    texts = plan.settled(plan.facts(novels(spark, sf_dir)))
    return project.unit_season(scened(texts).withColumn("unit_no", F.floor(F.col("shot_no") / 10)), plan.scenes_of(texts))


# A picture of the events: its name has a unit, a shot and a version, its status is the event's type. Nine units have pictures, twelve are wanted.
_FILES = r"""a AS (SELECT 'U' || user_id % 9 || '_S' || lpad((event_id % 40)::VARCHAR, 3, '0') || '_v' || event_id % 6 || CASE WHEN event_id % 17 = 0 THEN '.jpg' ELSE '.png' END AS path, event_type AS status FROM events),
r AS (SELECT regexp_extract(path, '^(.+)_(S[0-9]+)_v([0-9]+)\.png$', 1) AS unit, regexp_extract(path, '^(.+)_(S[0-9]+)_v([0-9]+)\.png$', 2) AS shot, regexp_extract(path, '^(.+)_(S[0-9]+)_v([0-9]+)\.png$', 3)::INT AS version, path, coalesce(status, '') AS status FROM a WHERE regexp_matches(path, '^(.+)_(S[0-9]+)_v([0-9]+)\.png$')),
l AS (SELECT unit, shot, version, status, path FROM (SELECT *, row_number() OVER (PARTITION BY unit, shot ORDER BY version DESC, path, status) AS k FROM r) WHERE k = 1),
w AS (SELECT DISTINCT 'U' || user_id % 12 AS unit, 'S' || lpad((event_id % 40)::VARCHAR, 3, '0') AS shot FROM events)"""
_STATUSES = ("click", "purchase", "view")


def _pictures(spark, sf_dir):
    """(wanted shots, files)."""
    e, events = F.col("event_id"), table(spark, sf_dir, "events")
    path = F.concat(F.lit("U"), (F.col("user_id") % 9).cast("string"), F.lit("_S"), F.lpad((e % 40).cast("string"), 3, "0"), F.lit("_v"), (e % 6).cast("string"), F.when(e % 17 == 0, ".jpg").otherwise(".png"))
    wanted = events.select(F.concat(F.lit("U"), (F.col("user_id") % 12).cast("string")).alias("unit"), F.concat(F.lit("S"), F.lpad((e % 40).cast("string"), 3, "0")).alias("shot"))
    return wanted, events.select(path.alias("path"), F.col("event_type").alias("status"))


@query("b6_asset_latest", f"WITH {_FILES} SELECT * FROM l")
def b6(spark, sf_dir):
    return project.asset_latest(_pictures(spark, sf_dir)[1])


_COUNTS = ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in _STATUSES)


@query("b6_asset_counts", f"WITH {_FILES} SELECT unit, {_COUNTS}, count(*) FILTER (status NOT IN {_STATUSES}) AS other FROM l GROUP BY unit")
def b6_counts(spark, sf_dir):
    return project.asset_counts(_pictures(spark, sf_dir)[1], _STATUSES)


@query("b6_asset_pending", f"WITH {_FILES} SELECT unit, shot, unit || '_' || shot || '_v1.png' AS next FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.unit = w.unit AND r.shot = w.shot)")
def b6_pending(spark, sf_dir):
    return project.asset_pending(*_pictures(spark, sf_dir))


@query("b6_asset_redo", f"WITH {_FILES} SELECT unit, shot, status, path, unit || '_' || shot || '_v' || (version + 1) || '.png' AS next FROM l SEMI JOIN w USING (unit, shot) WHERE status IN ('click', 'view')")
def b6_redo(spark, sf_dir):
    return project.asset_redo(*_pictures(spark, sf_dir), ("click", "view"))


@query(
    "b6_asset_report",
    f"WITH {_FILES} SELECT w.unit, count(*) AS wanted, count(*) FILTER (status IS NOT NULL AND status <> 'click') AS done, count(*) FILTER (status = 'click') AS redo, count(*) FILTER (status IS NULL) AS pending FROM w LEFT JOIN l USING (unit, shot) GROUP BY w.unit",
)
def b6_report(spark, sf_dir):
    return project.asset_report(*_pictures(spark, sf_dir), ("click",))
