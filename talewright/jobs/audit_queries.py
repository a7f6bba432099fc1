"""Queries of mining and audits (M, Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talewright.functions import lexicon as lex
from talewright.functions.zh import NOVELS_SQL, values_sql
from talewright.operators import audit, classify, mining, people, places, shots
from talewright.plans import storyboard as plan

from .catalog import SENTENCE_SHOTS_SQL, SHOTS_SQL, novels, packed_shots, query, sentence_shots, table
from .desc_queries import DESC_SQL, SCENES_SQL
from .people_queries import PERSONS_SQL
from .shot_queries import LENS_SQL, SCENED_SQL, WHO_SQL, full_shots, subjects
from .text_queries import era_sql

# A lexicon of all the library's lists, with two words that no text has.
_LEXICON = [("role", w) for w in lex.ROLES] + [("place", p) for p, _ in lex.PLACES] + [("face", k) for k, _ in lex.CUES["face"]] + [("action", k) for k, _ in lex.CUES["action"]] + [("action", "拈花惹草"), ("place", "天文台"), ("place", "書房|書齋"), ("place", "天台|屋頂|樹林"), ("role", "和尚|尼姑")]
_ROWS = [(i, n, k, "|" in k) for i, (n, k) in enumerate(_LEXICON)]
_LEX_SQL = f"lexi AS (SELECT ord, list, key FROM {values_sql(_LEXICON, 'list', 'key')})"
_HITS_SQL = f"{_LEX_SQL}, first_words AS (SELECT key, string_split(key, '|')[1] AS word FROM (SELECT DISTINCT key FROM lexi)), counts AS (SELECT key, sum(len(string_split(text, word)) - 1)::BIGINT AS hits FROM novels, first_words GROUP BY key), term_hits AS (SELECT list, key, coalesce(hits, 0)::BIGINT AS hits FROM lexi LEFT JOIN counts USING (key))"


def lexicon(spark):
    return spark.createDataFrame(_ROWS, "ord int, list string, key string, is_regex boolean")


@query("m1_term_hits", f"WITH {NOVELS_SQL}, {_HITS_SQL} SELECT * FROM term_hits")
def m1(spark, sf_dir):
    return mining.term_hits(novels(spark, sf_dir), lexicon(spark))


@query("m1_hit_rates", f"WITH {NOVELS_SQL}, {_HITS_SQL} SELECT list, count(*) AS keys, count(*) FILTER (hits > 0) AS hit, round(count(*) FILTER (hits > 0) / count(*), 6) AS rate FROM term_hits GROUP BY list")
def m1_rates(spark, sf_dir):
    return mining.hit_rates(mining.term_hits(novels(spark, sf_dir), lexicon(spark)))


@query("m2_dead_entries", f"WITH {NOVELS_SQL}, {_LEX_SQL}, w AS (SELECT key, unnest(string_split(key, '|')) AS word FROM (SELECT DISTINCT key FROM lexi)), alive AS (SELECT DISTINCT key FROM w, novels WHERE length(word) > 1 AND contains(text, word)) SELECT list, key FROM lexi WHERE length(key) > 1 AND key NOT IN (SELECT key FROM alive)")
def m2(spark, sf_dir):
    return mining.dead_entries(novels(spark, sf_dir), lexicon(spark))


_PATTERNS = [("speaker", "([一-鿿]{2})說"), ("place", "走進([一-鿿]{2})"), ("action", "他([一-鿿]{2})"), ("face", "臉([一-鿿]{2})")]


@query(
    "m3_harvest_candidates",
    f"WITH {SENTENCE_SHOTS_SQL}, {_LEX_SQL}, f AS ({' UNION ALL '.join(f'''SELECT '{n}' AS list, unnest(regexp_extract_all(narr, '{p}', 1)) AS word FROM shots''' for n, p in _PATTERNS)}), c AS (SELECT list, word, count(*) AS n FROM f WHERE word NOT IN (SELECT key FROM lexi) GROUP BY ALL HAVING count(*) >= 3) SELECT * FROM (SELECT list, word, n, row_number() OVER (PARTITION BY list ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 40",
)
def m3(spark, sf_dir):
    return mining.harvest_candidates(sentence_shots(novels(spark, sf_dir)).withColumnRenamed("narr", "sentence"), _PATTERNS, lexicon(spark))


# Tokens with made-up tags: the tag of a word of a document goes by its length.
_FLAGS = "CASE WHEN ends_with(word, '.') THEN 'vs' WHEN length(word) = 2 THEN 'f' WHEN length(word) = 3 THEN 'v' WHEN length(word) % 5 = 0 THEN 'n' WHEN length(word) % 5 = 1 THEN 'ns' WHEN length(word) % 5 = 2 THEN 'v' ELSE 'a' END"


@query(
    "m4_mine_tagged_tokens",
    f"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents), t AS (SELECT *, {_FLAGS} AS flag FROM w), l AS (SELECT *, lead(flag) OVER w AS nxt, lag(word) OVER w AS prv FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT CASE WHEN flag = 'n' AND nxt = 'vs' AND (length(word) <= 3 OR regexp_matches(word, '(?:er|or|in)$')) THEN 'role' WHEN flag = 'ns' OR (flag = 'n' AND nxt = 'f') THEN 'place' WHEN flag = 'v' AND length(word) BETWEEN 2 AND 3 THEN 'action' WHEN flag = 'a' OR prv IN ('the', 'das', 'la') THEN 'face' END AS list, word FROM l)
SELECT list, word, count(*) AS n FROM k WHERE list IS NOT NULL AND word NOT IN ('the', 'and') GROUP BY ALL HAVING count(*) >= CASE list WHEN 'role' THEN 2 WHEN 'place' THEN 2 ELSE 3 END""",
)
def m4(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    known = spark.createDataFrame([("the",), ("and",)], "key string")
    return mining.mine_tagged_tokens(words.withColumn("flag", F.expr(_FLAGS.replace("ends_with", "endswith"))), known, {"role": 2, "place": 2, "action": 3, "face": 3}, "er|or|in", ("the", "das", "la"))


_TERMS = ["線索", "推開門", "月色", "屍體", "河邊", "想起"]


@query(
    "m5_concordance",
    f"""WITH {SENTENCE_SHOTS_SQL}, f AS (SELECT key AS term, arg_min(narr, {{'n': novel_id, 's': shot_no}}) AS s FROM shots, {values_sql(_TERMS, 'key')} WHERE length(narr) > 4 AND contains(narr, key) GROUP BY key), p AS (SELECT term, s, greatest(strpos(s, term) - 12, 1) AS a, least(strpos(s, term) + length(term) + 12, length(s) + 1) AS b FROM f)
SELECT term, CASE WHEN a > 1 THEN '…' ELSE '' END || substring(s, a, b - a) || CASE WHEN b <= length(s) THEN '…' ELSE '' END AS example FROM p""",
)
def m5(spark, sf_dir):
    return mining.concordance(sentence_shots(novels(spark, sf_dir)).select("novel_id", F.col("shot_no").alias("sent_no"), F.col("narr").alias("sentence")), _TERMS)


# Two lexicons from the vocabulary: each language is a list, its short words the keys. The new one has a word once for each of two halves of
# the documents, so lists repeat keys.
_KIND = "CASE lang WHEN 'de' THEN 'plain' WHEN 'fr' THEN 'set' ELSE 'pairs' END"
_WORDS = "SELECT lang, doc_id, unnest(string_split(text, ' ')) AS word FROM documents WHERE lang IS NOT NULL"
_OLD = f"SELECT lang AS list, {_KIND} AS kind, min(doc_id) AS ord, word AS key, NULL::VARCHAR AS value FROM ({_WORDS}) WHERE length(word) BETWEEN 2 AND 4 GROUP BY lang, word"
_NEW = f"SELECT lang AS list, {_KIND} AS kind, max(doc_id) AS ord, word AS key, 'v' || length(word) AS value FROM ({_WORDS} AND lang <> 'es') WHERE length(word) BETWEEN 3 AND 5 GROUP BY lang, word, doc_id % 2"
_TURN = "row_number() OVER (PARTITION BY list ORDER BY CASE WHEN changed AND kind = 'pairs' THEN -length(key) ELSE 0 END, src, ord, key)"
MERGED_SQL = f"""o AS ({_OLD}), n AS ({_NEW}), f AS (SELECT list, kind, ord, key, value FROM (SELECT *, row_number() OVER (PARTITION BY list, key ORDER BY ord) AS k FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.list = n.list AND o.key = n.key)) WHERE k = 1 OR kind = 'plain'),
a AS (SELECT *, 0 AS src FROM f UNION ALL SELECT *, 1 FROM o), d AS (SELECT a.*, EXISTS (SELECT 1 FROM f WHERE f.list = a.list) AS changed FROM a),
merged AS (SELECT list, {_TURN} - 1 AS ord, key, CASE WHEN changed AND kind = 'pairs' THEN coalesce(value, key || '特寫') ELSE value END AS value FROM d)"""


def _lists(spark, sf_dir):
    words = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang", "doc_id", F.explode(F.split("text", " ")).alias("word"))
    of = lambda rows, by, ord, value: rows.groupBy("lang", "word", *by).agg(ord("doc_id").alias("ord")).select(F.col("lang").alias("list"), F.expr(_KIND).alias("kind"), "ord", F.col("word").alias("key"), value.cast("string").alias("value"))
    old = of(words.where("length(word) BETWEEN 2 AND 4"), [], F.min, F.lit(None))
    new = of(words.where("lang <> 'es' AND length(word) BETWEEN 3 AND 5"), [F.col("doc_id") % 2], F.max, F.concat(F.lit("v"), F.length("word")))
    return old, new


@query("m6_merge_lexicons", f"WITH {MERGED_SQL} SELECT list, ord, key, value FROM merged")
def m6(spark, sf_dir):
    return mining.merge_lexicons(*_lists(spark, sf_dir))


@query(
    "m6_merge_report",
    f"WITH {MERGED_SQL} SELECT m.list, (SELECT count(*) FROM f WHERE f.list = m.list) AS fresh, (SELECT count(*) FROM n WHERE n.list = m.list) - (SELECT count(*) FROM f WHERE f.list = m.list) AS repeated, count(*) AS total FROM merged m GROUP BY m.list",
)
def m6_report(spark, sf_dir):
    return mining.merge_report(*_lists(spark, sf_dir))


# Pools from the vocabulary: each language is a pool, each first letter a leaf; the leaf a holds a single value.
_LEAF = "lang AS pool, substring(word, 1, 1) AS path"
POOLS_SQL = f"""po AS (SELECT {_LEAF}, min(doc_id) AS ord, word AS value FROM ({_WORDS}) WHERE length(word) BETWEEN 2 AND 4 GROUP BY lang, word), pn AS (SELECT {_LEAF}, max(doc_id) AS ord, word AS value, substring(word, 1, 1) = 'a' AS single FROM ({_WORDS} AND lang <> 'es') WHERE length(word) BETWEEN 3 AND 5 GROUP BY lang, word),
pm AS (SELECT *, 1 AS src FROM pn WHERE NOT EXISTS (SELECT 1 FROM po WHERE po.pool = pn.pool AND po.path = pn.path) OR NOT (single OR EXISTS (SELECT 1 FROM po WHERE po.pool = pn.pool AND po.path = pn.path AND po.value = pn.value))),
pools AS (SELECT pool, path, row_number() OVER (PARTITION BY pool, path ORDER BY src, ord, value) - 1 AS ord, value FROM (SELECT pool, path, ord, value, 0 AS src FROM po UNION ALL SELECT pool, path, ord, value, src FROM pm))"""


def _pools(spark, sf_dir):
    words = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang", "doc_id", F.explode(F.split("text", " ")).alias("word"))
    of = lambda rows, ord: rows.groupBy("lang", "word").agg(ord("doc_id").alias("ord")).select(F.col("lang").alias("pool"), F.substring("word", 1, 1).alias("path"), "ord", F.col("word").alias("value"))
    new = of(words.where("lang <> 'es' AND length(word) BETWEEN 3 AND 5"), F.max)
    return of(words.where("length(word) BETWEEN 2 AND 4"), F.min), new.withColumn("single", F.col("path") == "a")


@query("m6_merge_pools", f"WITH {POOLS_SQL} SELECT pool, path, ord, value FROM pools")
def m6_pools(spark, sf_dir):
    return mining.merge_pools(*_pools(spark, sf_dir))


@query("m6_pool_report", f"WITH {POOLS_SQL} SELECT pool, (SELECT count(*) FROM po WHERE po.pool = pools.pool) AS before, count(*) AS after FROM pools GROUP BY pool")
def m6_pool_report(spark, sf_dir):
    return mining.pool_report(*_pools(spark, sf_dir))


@query(
    "m7_lexicon_checks",
    f"""WITH x AS (SELECT list, ord, key FROM ({_OLD}) UNION ALL SELECT list, ord, key FROM ({_NEW})), k AS (SELECT list, key, min(ord) AS first, max(ord) AS last FROM x WHERE key <> '' GROUP BY ALL),
s AS (SELECT DISTINCT list, substring(key, i, n) AS part, last FROM (SELECT *, unnest(range(1, length(key) + 1)) AS i FROM k), range(1, 5) r(n) WHERE i + n - 1 <= length(key) AND n < length(key)), l AS (SELECT list, part, max(last) AS last FROM s GROUP BY ALL)
SELECT list, key, 'repeated' AS problem FROM x GROUP BY list, key HAVING count(*) > 1 UNION ALL SELECT list, key, 'empty' FROM x WHERE trim(key, ' ') = '' UNION ALL SELECT list, key, 'blanks around the word' FROM x WHERE trim(key, ' ') <> '' AND trim(key, ' ') <> key
UNION ALL SELECT k.list, k.key, 'hides a longer key' FROM k JOIN l ON l.list = k.list AND l.part = k.key WHERE k.first < l.last""",
)
def m7(spark, sf_dir):
    old, new = _lists(spark, sf_dir)
    return mining.lexicon_checks(old.select("list", "ord", "key").union(new.select("list", "ord", "key")))


# The form of a word's list goes by its language; every ninth document's words make patterns with a bracket that nothing closes.
_FORM = "CASE lang WHEN 'de' THEN 'regex' WHEN 'fr' THEN 'characters' WHEN 'es' THEN 'weights' ELSE 'pairs' END"
_FORM_KEY = "CASE WHEN lang = 'de' AND doc_id % 9 = 0 THEN '(' || regexp_replace(word, '[^a-z]', '') ELSE regexp_replace(word, '[^a-z]', '') END"
_FORM_VALUE = "CASE WHEN lang = 'es' THEN CASE WHEN length(word) > 4 THEN 'many' ELSE '3' END WHEN length(word) = 3 THEN '' ELSE word END"


@query(
    "m7_malformed",
    f"""WITH x AS (SELECT DISTINCT lang AS list, {_FORM} AS kind, {_FORM_KEY.replace("'[^a-z]', ''", "'[^a-z]', '', 'g'")} AS key, {_FORM_VALUE} AS value FROM ({_WORDS}))
SELECT list, key, CASE WHEN trim(key) = '' THEN 'empty' WHEN kind = 'pairs' AND value = '' THEN 'pair without a value' WHEN kind = 'weights' AND value = 'many' THEN 'weight is no number' WHEN kind = 'characters' AND length(key) <> 1 THEN 'more than one character' WHEN kind = 'regex' AND starts_with(key, '(') THEN 'regex does not compile' END AS problem FROM x WHERE problem IS NOT NULL""",
)
def m7_malformed(spark, sf_dir):
    words = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang", "doc_id", F.explode(F.split("text", " ")).alias("word"))
    return mining.malformed(words.select(F.col("lang").alias("list"), F.expr(_FORM).alias("kind"), F.lit(0).alias("ord"), F.expr(_FORM_KEY).alias("key"), F.expr(_FORM_VALUE).alias("value")).distinct())


@query(
    "m8_export_lexicon",
    f"WITH {MERGED_SQL} SELECT list, ord // {mining.EXPORT} AS part, count(*) AS n, to_json(list(key ORDER BY ord))::VARCHAR AS entries FROM merged GROUP BY ALL",
)
def m8(spark, sf_dir):
    return mining.export_lexicon(mining.merge_lexicons(*_lists(spark, sf_dir)))


_SUM = lambda c: f"coalesce(sum({c}), 0)::BIGINT AS {c}"


@query(
    "q1_quality_audit",
    f"""WITH {LENS_SQL}, {DESC_SQL}, {SCENES_SQL}, s AS (SELECT novel_id, count(*) AS shots, count(*) FILTER (regexp_matches(narr, '{lex.CREDITS}')) AS credits, count(*) FILTER (contains(lens, '{audit.NO_ACTION}')) AS no_action FROM lenses GROUP BY novel_id),
p AS (SELECT novel_id, count(*) AS persons FROM persons GROUP BY novel_id),
q AS (SELECT novel_id, count(*) AS places, count(*) FILTER (regexp_matches("desc", '{audit.GENERIC_DESC}')) AS generic, count(*) FILTER (NOT regexp_matches("desc", '{audit.GENERIC_DESC}') AND regexp_matches(name, '{lex.NATURE}') AND regexp_matches("desc", '{audit.URBAN_DESC}')) AS town_in_nature FROM scenes GROUP BY novel_id),
j AS (SELECT * FROM s LEFT JOIN p USING (novel_id) LEFT JOIN q USING (novel_id)), r AS (SELECT novel_id, {', '.join(map(_SUM, ('persons', 'places', 'shots', 'credits', 'generic', 'town_in_nature', 'no_action')))} FROM j GROUP BY ROLLUP (novel_id))
SELECT *, round(no_action * 100 / shots, 3) AS no_action_pct FROM r""",
)
def q1(spark, sf_dir):
    texts = plan.settled(plan.facts(novels(spark, sf_dir)))
    persons, narrators = plan.cast(texts)
    scenes = plan.settled(plan.scenes_of(texts))
    return audit.quality_audit(full_shots(texts, persons, narrators, scenes), persons, scenes)


@query("q2_fill_breakdown", f"WITH {LENS_SQL}, f AS (SELECT name, pattern FROM {values_sql(audit.FILLS, 'name', 'pattern')}) SELECT f.name AS fill, count(*) AS n FROM lenses JOIN f ON regexp_matches(lens, f.pattern) GROUP BY f.name")
def q2(spark, sf_dir):
    return audit.fill_breakdown(full_shots(novels(spark, sf_dir)))


_SHORT = "(length(regexp_replace(narr, '[\\s　]', '', 'g')) <= 7 AND NOT regexp_matches(narr, '[。！？!?…」』]$'))"


@query("q3_fragment_rate", f"WITH {SHOTS_SQL} SELECT novel_id, count(*) FILTER ({_SHORT}) AS fragments, round(avg({_SHORT}::INT), 6) AS share FROM shots GROUP BY novel_id")
def q3(spark, sf_dir):
    return audit.fragment_rate(packed_shots(novels(spark, sf_dir)))


@query("q4_longest_subject_run", f"WITH {WHO_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY novel_id ORDER BY shot_no) - row_number() OVER (PARTITION BY novel_id, who ORDER BY shot_no) AS island FROM who), r AS (SELECT novel_id, count(*) AS n FROM i WHERE who <> '' GROUP BY novel_id, who, island) SELECT novel_id, max(n) AS longest FROM r GROUP BY novel_id")
def q4(spark, sf_dir):
    return audit.longest_subject_run(subjects(novels(spark, sf_dir)))


@query("q5_repeated_lens", f"WITH {LENS_SQL} SELECT novel_id, lens, count(*) AS n FROM lenses GROUP BY ALL HAVING count(*) >= 8")
def q5(spark, sf_dir):
    return audit.repeated_lens(full_shots(novels(spark, sf_dir)))


@query("q6_no_subject_rate", f"WITH {WHO_SQL} SELECT novel_id, round(avg((who = '')::INT), 6) AS rate FROM who GROUP BY novel_id")
def q6(spark, sf_dir):
    return audit.no_subject_rate(subjects(novels(spark, sf_dir)))


# The scene of the shot before stands for a wrong one.
@query("q7_scene_conflicts", f"WITH {SCENED_SQL}, l AS (SELECT novel_id, shot_no, narr, coalesce(lag(scene) OVER (PARTITION BY novel_id ORDER BY shot_no), '') AS scene FROM scened), n AS (SELECT *, (SELECT list(p.name) FROM places p WHERE p.novel_id = l.novel_id AND contains(l.narr, p.name)) AS named FROM l) SELECT novel_id, shot_no, scene FROM n WHERE len(named) > 0 AND NOT list_contains(named, scene)")
def q7(spark, sf_dir):
    texts = novels(spark, sf_dir)
    ranked = plan.settled(places.places(texts))
    rows = shots.scene_carry_forward(shots.scene_hit(packed_shots(texts), ranked))
    return audit.scene_conflicts(rows.withColumn("scene", F.coalesce(F.lag("scene").over(shots.order()), F.lit(""))).drop("hit"), ranked)


_MISSED = f"([老小][一-鿿]|[一-鿿](?:{'|'.join(lex.TITLES)}))"


@query("q8_missed_names", f"WITH {PERSONS_SQL}, c AS (SELECT novel_id, name, count(*) AS n FROM (SELECT novel_id, unnest(regexp_extract_all(text, '{_MISSED}', 1)) AS name FROM novels) GROUP BY ALL HAVING count(*) >= 5) SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM persons p WHERE p.novel_id = c.novel_id AND (contains(p.name, c.name) OR contains(c.name, p.name)))")
def q8(spark, sf_dir):
    texts = novels(spark, sf_dir)
    return audit.missed_names(texts, people.persons(texts))


# The era that the texts show without the gate's name, which nearly all of them hold: so some leak.
_UNGATED = "replace(text, '衙門', '門')"
_LEAKS = "CASE era " + " ".join(f"WHEN '{e}' THEN regexp_extract_all(text, '{b}')" for e, b in lex.ERA_BAN) + " END"


@query(
    "q9_era_leak_scan",
    f"""WITH {LENS_SQL}, {DESC_SQL}, {SCENES_SQL}, eras AS (SELECT novel_id, {era_sql(_UNGATED)} AS era FROM novels), made AS (SELECT novel_id, narr AS text FROM lenses UNION ALL SELECT novel_id, lens FROM lenses UNION ALL SELECT novel_id, "desc" FROM described UNION ALL SELECT novel_id, "desc" FROM scenes),
bad AS (SELECT novel_id, list_sort(list(DISTINCT w)) AS leaks FROM (SELECT novel_id, unnest({_LEAKS}) AS w FROM made JOIN eras USING (novel_id)) GROUP BY novel_id), k AS (SELECT novel_id, count(*) AS shots, sum(len(regexp_extract_all(narr, '[一-鿿]'))) AS han FROM lenses GROUP BY novel_id)
SELECT novel_id, CASE WHEN coalesce(han, 0) < 100 OR coalesce(shots, 0) < 5 THEN 'failed' WHEN leaks IS NOT NULL THEN 'leaks' ELSE 'clean' END AS status, coalesce(array_to_string(leaks, ','), '') AS leaks FROM eras LEFT JOIN bad USING (novel_id) LEFT JOIN k USING (novel_id)""",
)
def q9(spark, sf_dir):
    texts = plan.settled(plan.facts(novels(spark, sf_dir)))
    persons, narrators = plan.cast(texts)
    scenes = plan.settled(plan.scenes_of(texts))
    rows = full_shots(texts, persons, narrators, scenes).select("novel_id", "narr", "lens")
    made = plan.described(texts, persons).select("novel_id", F.col("desc").alias("text")).unionByName(scenes.select("novel_id", F.col("desc").alias("text")))
    eras = texts.select("novel_id", classify.detect_era(F.replace("text", F.lit("衙門"), F.lit("門"))).alias("era"))
    return audit.era_leak_scan(plan.settled(eras), made, rows, texts=("narr", "lens"))


@query(
    "q10_run_report",
    f"""WITH {LENS_SQL}, {DESC_SQL}, {SCENES_SQL}, s AS (SELECT novel_id, count(*) AS shots, count(*) FILTER (size = '物件') AS close_ups, count(*) FILTER (contains(lens, '{audit.NO_ACTION}')) AS no_action FROM lenses GROUP BY novel_id),
o AS (SELECT novel_id, count(DISTINCT string_split("desc", '；')[-1]) <= 1 AS one_season FROM scenes GROUP BY novel_id)
SELECT s.*, facts.era, len(regexp_extract_all(text, '[一-鿿]'))::BIGINT AS han, coalesce(one_season, TRUE) AS one_season FROM s JOIN novels USING (novel_id) JOIN facts USING (novel_id) LEFT JOIN o USING (novel_id)""",
)
def q10(spark, sf_dir):
    texts = plan.settled(plan.facts(novels(spark, sf_dir)))
    scenes = plan.settled(plan.scenes_of(texts))
    return audit.run_report(texts, full_shots(texts, *plan.cast(texts), scenes, ("size", "lens")), scenes)
