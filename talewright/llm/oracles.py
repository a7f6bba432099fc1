"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from . import embeddings, secrets, templates, trie, vector_codes

SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' '))) AS h FROM w WHERE len(w) >= 50),
win AS (SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) AS s FROM h),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM win JOIN first USING (h) WHERE m < doc_id),
wd AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT wd.doc_id, count(*) AS n_words, count(gone.i) AS n_removed, string_agg(x, ' ' ORDER BY wd.i) FILTER (gone.i IS NULL) AS kept FROM wd LEFT JOIN gone ON gone.doc_id = wd.doc_id AND gone.i = wd.i GROUP BY wd.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_sql(order: int, rule: secrets.Rule) -> str:
    regex = _quoted(rule.regex)
    return f"""SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, start, start + length(hits[i]) AS stop FROM (
  SELECT doc_id, hits, parts, i, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM (
    SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {regex}) AS hits, regexp_extract_all(text, {regex}, {rule.group}) AS parts, string_split_regex(text, {regex}) AS pieces FROM documents WHERE regexp_matches(text, {regex})))) WHERE length(parts[i]) >= {rule.least}"""


SECRETS = f"""
WITH spans AS ({' UNION ALL '.join(_rule_sql(n, r) for n, r in enumerate(secrets.RULES))}),
j AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < {len(secrets.BASE)}) AS base,
  {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)} FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN j USING (doc_id)
"""

_N, _D, _U, _E = templates.NAME, templates.NUMBER, templates.UNIT, templates.END
_BARE = f"regexp_replace(text, '[{_N}-{_E}]', ' ', 'g')"
_TOKENS = f"""regexp_extract_all(regexp_replace(lower(regexp_replace(regexp_replace({_BARE}, '{templates.NAMES_RE}', '\\1{_N}\\2{_E}', 'g'), '{templates.NUMBERS_RE}', ' {_D}\\0{_E} ', 'g')), '{_E} \\x20?({templates.UNITS})\\b', '{_E} {_U}\\1{_E} ', 'g'), '[{_N}-{_U}][^{_E}]*{_E}|{templates.WORD}')"""
_NUMBERS = "(" + ", ".join(f"'{w}', '{_N}{w}{_E}'" for w in templates.NUMBER_WORDS) + ")"
_VALUES = f"list_transform({_TOKENS}, lambda x: CASE WHEN x IN {_NUMBERS} THEN '{_D}' || translate(x, '{_N}{_E}', '') || '{_E}' ELSE x END)"
_W = templates.WINDOW
_FORMS = f"""list_transform(v, lambda x: CASE WHEN x < '{_N}' THEN x WHEN x < '{_D}' THEN translate(x, '{_N}{_E}', '') ELSE x[1] END) AS w, list_transform(v, lambda x: CASE WHEN x < '{_N}' THEN x ELSE x[1] END) AS t"""
# every window in both forms: with names as words, and, where it holds a name, with names as placeholders
_BOTH = f"""SELECT *, w[pos:pos + k - 1] AS win FROM p UNION ALL SELECT *, t[pos:pos + k - 1] FROM p WHERE list_contains(t[pos:pos + k - 1], '{_N}')"""

DECONTAMINATION = f"""
WITH bt AS (SELECT DISTINCT item_id, {_VALUES} AS v FROM benchmark WHERE text IS NOT NULL),
b AS (WITH p AS (SELECT item_id, v, w, t, unnest(range(1, len(v) - k + 2)) AS pos, k FROM (SELECT *, {_FORMS}, least(len(v), {_W}) AS k FROM bt))
  SELECT item_id, v, pos AS bpos, win, list_contains(win, '{_N}') AS named FROM ({_BOTH}) WHERE len(list_filter(win, lambda x: x < '{_N}')) >= {templates.LITERALS}),
bn AS (SELECT item_id, v, count(*) FILTER (NOT named) AS n FROM b GROUP BY ALL),
dt AS (SELECT doc_id, {_VALUES} AS v FROM documents WHERE text IS NOT NULL),
d AS (WITH p AS (SELECT doc_id, w, t, unnest(range(1, len(v) - k + 2)) AS pos, k FROM (SELECT *, {_FORMS} FROM dt) CROSS JOIN (SELECT DISTINCT len(win) AS k FROM b)) SELECT doc_id, pos, win FROM ({_BOTH}) SEMI JOIN b USING (win)),
hits AS (SELECT DISTINCT d.doc_id, b.item_id, bn.n, d.pos, b.bpos, b.v, len(b.win) AS k FROM d JOIN b USING (win) JOIN bn ON bn.item_id = b.item_id AND bn.v = b.v),
s AS (SELECT h.doc_id, h.item_id, h.n, h.pos - h.bpos AS shift, h.bpos, list_filter(list_transform(list_zip(h.v[h.bpos:h.bpos + h.k - 1], dt.v[h.pos:h.pos + h.k - 1]), lambda z: {{'a': z[1], 'b': translate(z[2], '{_N}{_E}', '')}}), lambda z: z.a >= '{_N}') AS slots FROM hits h JOIN dt ON dt.doc_id = h.doc_id),
g AS (SELECT doc_id, item_id, n, shift, list(DISTINCT bpos) AS seen, list_distinct(flatten(list(slots))) AS slots FROM s GROUP BY ALL),
k AS (SELECT *, list_filter(slots, lambda z: z.a < '{_D}') AS names FROM g),
c AS (SELECT doc_id, item_id, len(list_distinct(flatten(list(seen)))) / n AS coverage FROM k WHERE len(list_distinct(list_transform(slots, lambda z: z.a))) = len(slots) AND len(list_distinct(list_transform(names, lambda z: z.b))) = len(names) GROUP BY doc_id, item_id, n),
f AS (SELECT doc_id, list(DISTINCT item_id ORDER BY item_id) AS item_ids, max(coverage) AS coverage FROM c WHERE coverage >= {templates.COVERAGE} GROUP BY doc_id)
SELECT x.doc_id, f.doc_id IS NOT NULL AS contaminated, coalesce(item_ids, []) AS item_ids, round(coalesce(f.coverage, 0), 9) AS coverage FROM documents x LEFT JOIN f USING (doc_id)
"""

ORACLES = {
    "op2_embeddings": embeddings.ORACLE,
    "op3_substring_dedup": SUBSTRING,
    "op8_decontamination": DECONTAMINATION,
    "op9_secrets": SECRETS,
    "op11_vector_codes": vector_codes.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
