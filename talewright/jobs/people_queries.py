"""Queries of character extraction, narrator and gender (P, N1, G). The SQL works on a row for each character."""

from __future__ import annotations

from pyspark.sql import functions as F

from talewright.functions import lexicon as lex
from talewright.functions.shared import settled
from talewright.functions.zh import quote, values_sql
from talewright.operators import people

from .catalog import NOVELS_SQL, novels, query

_IN = lambda words: "(" + ", ".join(quote(w) for w in words) + ")"
_SET = lambda chars: "'" + chars.replace("'", "''").replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'").replace("\r", "'||chr(13)||'") + "'"


def _has(chars: str, c: str) -> str:
    return f"({c} <> '' AND contains({_SET(chars)}, {c}))"


def _han(s: str) -> str:
    return f"regexp_full_match({s}, '[一-鿿]+')"


def _name(s: str) -> str:
    return f"(length({s}) BETWEEN 2 AND 4 AND {_han(s)} AND {s} NOT IN {_IN(lex.NOT_NAMES + lex.ROLES)} AND NOT {_has(lex.NOT_NAME_START, s + '[1]')} AND CASE WHEN left({s}, 2) IN {_IN(lex.COMPOUND)} THEN TRUE WHEN length({s}) = 2 AND {_has(lex.NICK_PREFIX, s + '[1]')} THEN NOT {_has(lex.NICK_BAD, s + '[2]')} ELSE length({s}) <= 3 AND {_has(lex.SURNAMES, s + '[1]')} END)"


def _compound(s: str) -> str:
    return f"({_name(s)} AND left({s}, 2) IN {_IN(lex.COMPOUND)})"


def _bare(s: str) -> str:
    return f"(length({s}) BETWEEN 2 AND 3 AND {s} NOT IN {_IN(lex.NOT_NAMES + lex.ROLES + lex.TITLES + lex.KIN)} AND NOT {_has(lex.NOT_NAME_START + lex.HARD_BOUND, s + '[1]')} AND NOT {_has(lex.BAD_TAIL + lex.THING_TAIL, s + '[-1]')} AND NOT regexp_matches({s}, '[{lex.BAD_CHARS}]'))"


def _bound(c: str) -> str:
    return f"({c} = '' OR {_has(lex.NAME_BOUND, c)})"


def _hard(c: str) -> str:
    return f"({c} = '' OR {_has(lex.HARD_BOUND, c)})"


_LEADS = ", ".join(f"coalesce(lead(c, {n}) OVER w, '') AS c{n}" for n in range(1, 9))
_LAGS = ", ".join(f"coalesce(lag(c, {n}) OVER w, '') AS p{n}" for n in range(1, 7))
CHARS_SQL = (
    NOVELS_SQL
    + f""", cs AS (SELECT novel_id, length(text) AS len, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM novels WHERE text <> ''),
ch AS MATERIALIZED (SELECT novel_id, len, pos, c AS c0, {_LEADS}, {_LAGS} FROM cs WINDOW w AS (PARTITION BY novel_id ORDER BY pos))"""
)


def _intro_sql(lead: str) -> str:
    """A lead and the longest name right after it that no Han character follows."""
    k = len(lead)
    name = lambda n: " || ".join(f"c{k + i}" for i in range(n))
    fits = lambda n: f"c{k + n - 1} <> '' AND {_name('(' + name(n) + ')')} AND NOT {_han(f'c{k + n}')}"
    return f"""SELECT novel_id, len, 'p6' AS rule, name, 1 AS n, pos + {k} AS first, FALSE AS loose FROM (
      SELECT novel_id, len, pos, CASE WHEN {fits(4)} THEN {name(4)} WHEN {fits(3)} THEN {name(3)} WHEN {fits(2)} THEN {name(2)} END AS name FROM ch WHERE {' || '.join(f'c{i}' for i in range(k))} = {quote(lead)}) WHERE name IS NOT NULL"""


_VERBS = f"(SELECT v, n FROM {values_sql(lex.SPEAK + lex.MOVES, 'v', 'n')})"
_HIT = {
    "p1": f"SELECT novel_id, len, 'p1' AS rule, c0 || c1 AS name, 1 AS n, pos AS first, FALSE AS loose FROM ch WHERE {_has(lex.NICK_PREFIX, 'c0')} AND {_name('(c0 || c1)')} AND {_bound('p1')} AND NOT {_has(lex.THING_TAIL, 'c2')}",
    "p2": f"SELECT novel_id, len, 'p2' AS rule, c0 || c1 || c2 AS name, 1 AS n, pos AS first, FALSE AS loose FROM ch WHERE c0 || c1 || c2 IN {_IN(lex.FULL_NAMES)}",
    "p3": f"""SELECT a.novel_id, a.len, 'p3' AS rule, t.name, 1 AS n, a.pos AS first, FALSE AS loose FROM ch a JOIN {values_sql(lex.ALIASES, 'alias', 'name')} ON a.c0 || a.c1 = t.alias
      WHERE EXISTS (SELECT 1 FROM ch q WHERE q.novel_id = a.novel_id AND q.c0 || q.c1 || q.c2 = t.name) AND NOT EXISTS (SELECT 1 FROM ch q WHERE q.novel_id = a.novel_id AND q.c0 || q.c1 || q.c2 = t.name AND a.pos < q.pos + 3 AND a.pos + 2 > q.pos)""",
    "p4": f"""SELECT novel_id, len, 'p4' AS rule, coalesce(name, far) AS name, n, pos - length(coalesce(name, far)) AS first, name IS NOT NULL AND loose AS loose FROM (
      SELECT novel_id, len, pos, n, CASE WHEN p4 <> '' AND {_compound('s4')} AND {_bound('p5')} THEN s4 WHEN p3 <> '' AND {_compound('s3')} AND {_bound('p4')} THEN s3 END AS far, CASE WHEN NOT {_han('s2')} OR p2 = '' OR NOT {_bound('p3')} THEN NULL WHEN {_name('s2')} THEN s2 WHEN {_bare('s2')} AND {_hard('p3')} THEN s2
        WHEN p3 = '' OR NOT {_han('s3')} OR NOT {_bound('p4')} THEN NULL WHEN {_name('s3')} THEN s3 WHEN {_bare('s3')} AND {_hard('p4')} THEN s3
        WHEN p4 = '' OR NOT {_han('s4')} OR NOT {_bound('p5')} THEN NULL WHEN {_name('s4')} THEN s4 END AS name,
        CASE WHEN {_name('s2')} THEN FALSE WHEN {_bare('s2')} AND {_hard('p3')} THEN TRUE WHEN {_name('s3')} THEN FALSE ELSE {_bare('s3')} AND {_hard('p4')} END AS loose
      FROM (SELECT ch.*, v.n, p2 || p1 AS s2, p3 || p2 || p1 AS s3, p4 || p3 || p2 || p1 AS s4 FROM ch JOIN {_VERBS} v ON CASE WHEN length(v.v) = 1 THEN c0 ELSE c0 || c1 END = v.v)) WHERE coalesce(name, far) IS NOT NULL""",
    "p6": " UNION ALL ".join(_intro_sql(lead) for lead in lex.INTRO),
    "p7": f"SELECT novel_id, len, 'p7' AS rule, p1 || c0 || c1 AS name, 1 AS n, pos - 1 AS first, FALSE AS loose FROM ch WHERE c0 || c1 IN {_IN(lex.ROLES)} AND {_has(lex.SURNAMES, 'p1')} AND ({_bound('p2')} OR {_has(lex.ROLE_BOUND, 'p2')})",
    "p8": f"""SELECT novel_id, len, 'p8' AS rule, name, 1 AS n, pos - length(name) AS first, FALSE AS loose FROM (
      SELECT novel_id, len, pos, coalesce(CASE WHEN p3 <> '' AND {_han('s3')} AND NOT {_bound('p4')} THEN NULL WHEN p3 <> '' AND {_name('s3')} THEN s3 WHEN p2 <> '' AND {_han('s2')} AND {_bound('p3')} AND {_name('s2')} THEN s2 END,
        CASE WHEN p4 <> '' AND {_compound('s4')} AND {_bound('p5')} THEN s4 WHEN p3 <> '' AND {_compound('s3')} AND {_bound('p4')} THEN s3 END) AS name
      FROM (SELECT *, p4 || p3 || p2 || p1 AS s4, p3 || p2 || p1 AS s3, p2 || p1 AS s2 FROM ch WHERE c0 || c1 IN {_IN(lex.TITLES)})) WHERE name IS NOT NULL""",
    "p9": f"""SELECT novel_id, len, 'p9' AS rule, name, 1 AS n, pos AS first, FALSE AS loose FROM (
      SELECT novel_id, len, pos, CASE WHEN c2 <> '' AND {_han('s3')} AND s3 IN {_IN(lex.CLAUSE_STOP)} THEN NULL WHEN c2 <> '' AND {_han('s3')} AND {_bare('s3')} THEN s3 WHEN c2 <> '' AND {_han('s3')} AND {_has(lex.THING_TAIL, 'c2')} THEN NULL
        WHEN s2 IN {_IN(lex.CLAUSE_STOP)} THEN NULL WHEN {_bare('s2')} THEN s2 END AS name
      FROM (SELECT *, c0 || c1 || c2 AS s3, c0 || c1 AS s2 FROM ch WHERE {_hard('p1')} AND c1 <> '' AND {_han('(c0 || c1)')})) WHERE name IS NOT NULL""",
}
_S = lambda n: f"right(t, {n})"
_C = lambda n: f"CASE WHEN length(t) > {n} THEN substring(t, length(t) - {n}, 1) ELSE '' END"
# The text before a verb without the adverb at its end; b: thirteen characters at most.
_HIT["p5"] = f"""SELECT novel_id, len, 'p5' AS rule, coalesce(name, far) AS name, n, pos - (length(b) - length(t)) - length(coalesce(name, far)) AS first, name IS NOT NULL AND loose AS loose FROM (
      SELECT *, CASE WHEN length(t) >= 4 AND {_compound('s4')} AND {_bound('c4')} THEN s4 WHEN length(t) >= 3 AND {_compound('s3')} AND {_bound('c3')} THEN s3 END AS far, CASE WHEN length(t) < 2 OR NOT {_han('s2')} OR NOT {_bound('c2')} THEN NULL WHEN {_name('s2')} THEN s2 WHEN {_bare('s2')} AND (free OR {_hard('c2')}) THEN s2
        WHEN length(t) < 3 OR NOT {_han('s3')} OR NOT {_bound('c3')} THEN NULL WHEN {_name('s3')} THEN s3 WHEN {_bare('s3')} AND (free OR {_hard('c3')}) THEN s3
        WHEN length(t) < 4 OR NOT {_han('s4')} OR NOT {_bound('c4')} THEN NULL WHEN {_name('s4')} THEN s4 END AS name,
        CASE WHEN {_name('s2')} THEN FALSE WHEN {_bare('s2')} AND (free OR {_hard('c2')}) THEN TRUE WHEN {_name('s3')} THEN FALSE ELSE {_bare('s3')} AND (free OR {_hard('c3')}) END AS loose
      FROM (SELECT *, {_S(2)} AS s2, {_S(3)} AS s3, {_S(4)} AS s4, {_C(2)} AS c2, {_C(3)} AS c3, {_C(4)} AS c4, ends_with(b, '地') AS free FROM (SELECT *, regexp_replace(b, '{people.ADVERB}', '') AS t FROM (
        SELECT ch.novel_id, ch.len, ch.pos, v.n, substring(x.text, greatest(pos - 12, 1)::BIGINT, least(pos, 13)::BIGINT) AS b FROM ch JOIN {_VERBS} v ON CASE WHEN length(v.v) = 1 THEN c0 ELSE c0 || c1 END = v.v JOIN novels x ON x.novel_id = ch.novel_id)) WHERE t <> b AND t <> '')) WHERE coalesce(name, far) IS NOT NULL"""
_TITLES = {
    "p1": "cand_nickname", "p2": "cand_full_name", "p3": "merge_aliases", "p4": "cand_before_verb", "p5": "cand_adverb_verb",
    "p6": "cand_self_intro", "p7": "cand_surname_role", "p8": "cand_name_title", "p9": "cand_clause_initial",
}


def _rule_query(rule: str, title: str) -> None:
    sql = f"WITH {CHARS_SQL} SELECT novel_id, name, sum(n)::BIGINT AS n, min(first) AS first, bool_or(loose) AS loose FROM ({_HIT[rule]}) GROUP BY novel_id, name"

    @query(f"{rule}_{title}", sql)
    def run(spark, sf_dir):
        return people.candidates(novels(spark, sf_dir), (rule,)).select("novel_id", "name", "n", "first", "loose")


for _rule, _title in _TITLES.items():
    _rule_query(_rule, _title)

FUSED_SQL = f"""{CHARS_SQL}, cand AS ({' UNION ALL '.join(_HIT.values())}), sums AS (
  SELECT novel_id, len, name, sum(CASE WHEN rule = 'p1' THEN n ELSE 0 END) AS nick, sum(CASE WHEN rule = 'p9' THEN n ELSE 0 END) AS clause, sum(CASE WHEN rule NOT IN ('p1', 'p9') THEN n ELSE 0 END) AS rest, bool_or(loose) AS loose, min(first) AS first FROM cand GROUP BY ALL
), cut AS (SELECT *, CASE WHEN len >= 3000 THEN 3 ELSE 2 END AS need, CASE WHEN clause >= CASE WHEN len >= 3000 THEN 8 ELSE 3 END THEN clause ELSE 0 END AS cl FROM sums
), fused AS (SELECT novel_id, name, greatest(CASE WHEN nick >= need THEN nick ELSE 0 END + rest, cl)::BIGINT AS count, first FROM cut
  WHERE greatest(CASE WHEN nick >= need THEN nick ELSE 0 END + rest, cl) > 0 AND (NOT loose OR cl > 0 OR greatest(CASE WHEN nick >= need THEN nick ELSE 0 END + rest, cl) >= need))"""
_WORDS = sorted({*lex.ROLES, *lex.TITLES, *lex.KIN, *lex.FULL_NAMES, *(a for a, _ in lex.ALIASES)})
KEPT_SQL = f"""{FUSED_SQL}, kept AS (SELECT * FROM fused f WHERE NOT EXISTS (SELECT 1 FROM fused g WHERE g.novel_id = f.novel_id AND length(g.name) > length(f.name) AND starts_with(g.name, f.name))
  AND NOT EXISTS (SELECT 1 FROM {values_sql(_WORDS, 'word')} WHERE length(word) > length(f.name) AND starts_with(word, f.name))
  AND NOT EXISTS (SELECT 1 FROM {values_sql(lex.ALIASES, 'alias', 'full_name')} JOIN fused g ON g.name = t.full_name WHERE g.novel_id = f.novel_id AND t.alias = f.name))"""
ROLES_SQL = f"""{KEPT_SQL}, known AS (SELECT novel_id, list(name) AS names FROM kept GROUP BY novel_id), hits AS (
  SELECT ch.novel_id, len, c0 || c1 AS role, pos, [p1 || c0 || c1, CASE WHEN p2 <> '' THEN p2 || p1 || c0 || c1 END, CASE WHEN p3 <> '' THEN p3 || p2 || p1 || c0 || c1 END, CASE WHEN c3 <> '' THEN c2 || c3 END, CASE WHEN c4 <> '' THEN c2 || c3 || c4 END] AS near,
    list_concat(coalesce(names, []), [{', '.join(quote(x) for x in (*lex.FULL_NAMES, *(a for a, _ in lex.ALIASES)))}]) AS names FROM ch LEFT JOIN known ON known.novel_id = ch.novel_id WHERE c0 || c1 IN {_IN(lex.ROLES)}
), roles AS (SELECT novel_id, role AS name, sum(CASE WHEN NOT list_has_any(list_filter(near, lambda x: x IS NOT NULL), names) THEN 1 ELSE 0 END)::BIGINT AS count, min(pos) AS first FROM hits GROUP BY novel_id, len, role
  HAVING count(*) >= CASE WHEN len >= 3000 THEN 3 ELSE 2 END AND sum(CASE WHEN NOT list_has_any(list_filter(near, lambda x: x IS NOT NULL), names) THEN 1 ELSE 0 END) >= CASE WHEN len >= 3000 THEN 3 ELSE 2 END AND NOT bool_or(list_contains(names, role)))"""
PERSONS_SQL = f"""{ROLES_SQL}, persons AS (SELECT * FROM (SELECT novel_id, name, count, role, row_number() OVER (PARTITION BY novel_id ORDER BY role <> '', count DESC, first, name) AS rank FROM (
  SELECT novel_id, name, count, first, '' AS role FROM kept UNION ALL SELECT novel_id, name, count, first, name AS role FROM roles)) WHERE rank <= 8)"""


def read(texts):
    return settled(people.scan(texts))


@query("p10_fuse_evidence", f"WITH {FUSED_SQL} SELECT novel_id, name, count, first FROM fused")
def p10(spark, sf_dir):
    return people.fuse(people.candidates(novels(spark, sf_dir)))


@query("p11_drop_half_names", f"WITH {KEPT_SQL} SELECT novel_id, name, count, first FROM kept")
def p11(spark, sf_dir):
    return people.names_of(read(novels(spark, sf_dir)))


@query("p12_role_characters", f"WITH {ROLES_SQL} SELECT novel_id, name, count, first FROM roles")
def p12(spark, sf_dir):
    texts = read(novels(spark, sf_dir))
    return people.role_characters(texts, people.names_of(texts))


@query("p13_top_persons", f"WITH {PERSONS_SQL} SELECT novel_id, rank, name, count, role FROM persons")
def p13(spark, sf_dir):
    return people.persons(novels(spark, sf_dir))


NARRATOR_SQL = f"""{PERSONS_SQL}, plain AS (SELECT novel_id, regexp_replace(text, '「[^」]*」|『[^』]*』', '', 'g') AS t FROM novels),
wo AS (SELECT novel_id, t, len(regexp_extract_all(t, '我')) AS wo FROM plain),
intro AS (SELECT h.novel_id, arg_min(h.name, {{'f': h.first, 'n': h.name}}) AS introduced FROM (SELECT novel_id, name, min(first) AS first FROM ({_HIT['p6']}) GROUP BY ALL) h JOIN persons p ON p.novel_id = h.novel_id AND p.name = h.name GROUP BY h.novel_id),
apposed AS (SELECT p.novel_id, arg_min(p.name, p.rank) AS apposed FROM persons p JOIN wo USING (novel_id) WHERE wo >= 3 AND regexp_matches(t, '我[，、,]?\\s*' || p.name) GROUP BY p.novel_id),
sole AS (SELECT novel_id, CASE WHEN count(*) = 1 THEN max(name) END AS sole FROM persons WHERE role = '' AND name NOT IN {_IN(lex.ROLES + lex.TITLES + lex.KIN)} GROUP BY novel_id),
narrators AS (SELECT w.novel_id, wo::BIGINT AS wo, wo >= 3 AS first_person, CASE WHEN wo >= 3 THEN coalesce(introduced, apposed, sole, '') ELSE '' END AS name FROM wo w LEFT JOIN intro USING (novel_id) LEFT JOIN apposed USING (novel_id) LEFT JOIN sole USING (novel_id))"""


@query("n1_detect_narrator", f"WITH {NARRATOR_SQL} SELECT * FROM narrators")
def n1(spark, sf_dir):
    texts = read(novels(spark, sf_dir))
    return people.narrator(texts, settled(people.persons_of(texts)))


def _gender_sql(name: str, word: bool) -> str:
    last = f"right({name}, 1)"
    kin = f"WHEN contains('{lex.KIN_FEMALE}', {last}) THEN 'f' WHEN contains('{lex.KIN_MALE}', {last}) THEN 'm'"
    if word:
        return f"CASE WHEN {name} IN {_IN(lex.FEMALE_WORDS)} THEN 'f' WHEN {name} IN {_IN(lex.MALE_WORDS)} THEN 'm' {kin} ELSE '' END"
    return f"CASE WHEN length({name}) < 2 THEN '' {kin} WHEN contains('{lex.NAME_MALE}', {last}) THEN 'm' WHEN contains('{lex.NAME_FEMALE}', {last}) THEN 'f' ELSE '' END"


@query("g1_gender_by_word", f"WITH {PERSONS_SQL} SELECT novel_id, name, {_gender_sql('name', True)} AS gender FROM persons")
def g1(spark, sf_dir):
    return people.persons(novels(spark, sf_dir)).select("novel_id", "name", people.gender_by_word(F.col("name")).alias("gender"))


@query("g3_gender_by_name_char", f"WITH {PERSONS_SQL} SELECT novel_id, name, {_gender_sql('name', False)} AS gender FROM persons")
def g3(spark, sf_dir):
    return people.persons(novels(spark, sf_dir)).select("novel_id", "name", people.gender_by_name_char(F.col("name")).alias("gender"))


GENDERS_SQL = f"""{NARRATOR_SQL}, pr AS (SELECT novel_id, pos, CASE WHEN c0 = '她' THEN 'f' ELSE 'm' END AS gender FROM ch WHERE c0 IN ('他', '她') AND p1 <> '其'),
mentioned AS (SELECT ch.novel_id, ch.pos, p.rank, p.name FROM ch JOIN persons p ON p.novel_id = ch.novel_id AND starts_with(c0 || c1 || c2 || c3, p.name)),
near AS (SELECT pr.novel_id, pr.pos, pr.gender, arg_max(m.name, m.pos * 100 - m.rank) AS name FROM pr JOIN mentioned m ON m.novel_id = pr.novel_id AND m.pos < pr.pos AND pr.pos - m.pos <= 20 GROUP BY ALL),
told AS (SELECT novel_id, name, arg_min(gender, pos) AS gender FROM near GROUP BY novel_id, name),
genders AS (SELECT p.novel_id, p.name, coalesce(nullif({_gender_sql('p.name', True)}, ''), t.gender, nullif({_gender_sql('p.name', False)}, ''), '') AS gender FROM persons p LEFT JOIN told t ON t.novel_id = p.novel_id AND t.name = p.name)"""


@query("g2_gender_by_pronoun", f"WITH {GENDERS_SQL} SELECT novel_id, name, gender FROM told")
def g2(spark, sf_dir):
    texts = read(novels(spark, sf_dir))
    return people.gender_by_pronoun(texts, settled(people.persons_of(texts)))


@query("g4_genders", f"WITH {GENDERS_SQL} SELECT novel_id, name, gender FROM genders")
def g4(spark, sf_dir):
    """All three rules in turn."""
    texts = read(novels(spark, sf_dir))
    return people.genders(texts, settled(people.persons_of(texts)))
