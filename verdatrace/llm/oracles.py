"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from verdatrace.llm import decontaminate, licenses, secrets

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

DECONTAMINATION = f"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, {_LETTERS}), {_WORD}) AS w FROM benchmark WHERE text IS NOT NULL),
owned AS (SELECT DISTINCT item, list_slice(w, k, k + 9) AS win FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM item_words WHERE len(w) > 0)),
wins AS (SELECT row_number() OVER () AS wid, win FROM (SELECT DISTINCT win FROM owned)),
doc_words AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), {_WORD}) AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
places AS (SELECT rid, k, n, list_slice(w, k, k + n - 1) AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, k, n, item FROM places JOIN owned USING (win)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT rid, k, n FROM hits)) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid),
asked AS (SELECT wid, unnest(win) AS term, generate_subscripts(win, 1) AS k FROM wins),
pos AS (SELECT rid, term, p FROM (SELECT rid, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM doc_words) WHERE term IN (SELECT term FROM asked)),
freq AS (SELECT term, count(*) AS c FROM pos GROUP BY term),
anchors AS (SELECT wid, arg_min(asked.term, (c, asked.term, k)) AS term, arg_min(k, (c, asked.term, k)) AS a FROM asked JOIN freq USING (term) GROUP BY wid),
starts AS (SELECT wid, a, rid, p FROM anchors JOIN pos USING (term)),
near AS (SELECT starts.wid, starts.rid FROM starts JOIN asked ON asked.wid = starts.wid JOIN pos ON pos.rid = starts.rid AND pos.term = asked.term AND pos.p BETWEEN starts.p + asked.k - starts.a - {decontaminate.SLOP} AND starts.p + asked.k - starts.a + {decontaminate.SLOP}
    GROUP BY starts.wid, starts.rid, starts.p HAVING count(DISTINCT asked.k) = (SELECT len(win) FROM wins WHERE wins.wid = starts.wid)),
close AS (SELECT rid, count(DISTINCT item) AS n_near_items FROM near JOIN wins USING (wid) JOIN owned USING (win) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items
FROM doc_words LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid) LEFT JOIN close USING (rid)"""


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(rank: int, pattern: str, group: int, where: str) -> str:
    """Matches of a kind with their places: pieces between matches and matches alternate."""
    p = _quote(pattern)
    return f"""SELECT rid, {rank} AS rank, e - len(m) AS s, e, v FROM (SELECT rid, m, v, sum(len(g) + len(m)) OVER (PARTITION BY rid ORDER BY i) AS e FROM (
        SELECT rid, i, gaps[i] AS g, ms[i] AS m, vs[i] AS v FROM (SELECT rid, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS vs, unnest(range(1, len(regexp_extract_all(t, {p}, 0)) + 1)) AS i FROM d))) WHERE {where}"""


def secret_scan() -> str:
    kinds = "CASE rank WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'token' END"
    text = f"{kinds} || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
base AS ({_kind(0, secrets.ASSIGN, 2, "len(v) >= 8")} UNION ALL {_kind(1, secrets._ACCESS_LONG, 0, "true")} UNION ALL {_kind(2, secrets._HEX_LONG, 0, "true")}),
tok AS (SELECT * FROM ({_kind(3, secrets.TOKEN, 0, "regexp_matches(v, '[0-9].*[0-9].*[0-9].*[0-9]') AND regexp_matches(v, '[A-Za-z]')")}) t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = t.rid AND b.s < t.e AND t.s < b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM tok),
freq AS (SELECT v, count(DISTINCT owner) AS owners FROM every JOIN d USING (rid) GROUP BY v),
judged AS (SELECT every.*, owners FROM every JOIN freq USING (v)),
lines AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg({text}, ',' ORDER BY s, rank) FILTER (rank < 3) AS base_text, string_agg({text}, ',' ORDER BY s, rank) FILTER (rank < 3 OR owners = 1) AS all_text,
    count(*) FILTER (rank = 3 AND owners = 1) AS n_token, count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners >= {secrets.EXAMPLE_OWNERS}) AS n_example FROM judged GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base_text, '')) AS base_sha256, coalesce(all_text, '') AS spans,
    CAST(coalesce(n_token, 0) AS BIGINT) AS n_token, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_example, 0) AS BIGINT) AS n_example
FROM d LEFT JOIN lines USING (rid)"""


def license_scan() -> str:
    rows, idf, unknown = licenses.template_weights()
    real = lambda x: f"CAST({x!r} AS DOUBLE)"
    weights = ", ".join(f"({k}, '{name}', '{t}', {real(w)})" for k, name, t, w in rows)
    idfs = ", ".join(f"('{t}', {real(w)})" for t, w in sorted(idf.items()))
    stops = ", ".join(f"'{w}'" for w in licenses.STOP_WORDS)
    blocks = " UNION ALL ".join(f"SELECT rid, unnest(list_transform(range(1, len(l) - {w} + 2), lambda i: array_to_string(list_slice(l, i, i + {w - 1}), chr(10)))) AS unit FROM l" for w in licenses.BLOCKS)
    return f"""
WITH weights(template, license, term, w) AS (VALUES {weights}), idfs(term, idf) AS (VALUES {idfs}),
d AS (SELECT row_number() OVER () AS rid, doc_id, concat_ws('/', coalesce(source, ''), concat_ws('/', coalesce(lang, ''), coalesce(CAST(doc_id AS VARCHAR), ''))) AS path, text AS t FROM documents),
l AS (SELECT rid, string_split(t, chr(10)) AS l FROM d WHERE t IS NOT NULL),
units AS (SELECT row_number() OVER () AS uid, rid, unit FROM ({blocks} UNION ALL SELECT rid, t FROM d JOIN l USING (rid))),
terms AS (SELECT uid, rid, term, count(*) AS n FROM (SELECT uid, rid, unnest(regexp_extract_all(lower(unit), '{licenses._TERM}')) AS term FROM units) WHERE term NOT IN ({stops}) AND NOT regexp_matches(term, '{licenses._YEAR}') GROUP BY ALL),
valued AS (SELECT uid, rid, term, n * coalesce(idf, {real(unknown)}) AS v FROM terms LEFT JOIN idfs USING (term)),
norms AS (SELECT uid, sqrt(sum(v * v)) AS norm FROM valued GROUP BY uid),
cosines AS (SELECT valued.uid, rid, template, license, round(sum(v * w) / any_value(norm), 9) AS score FROM valued JOIN weights USING (term) JOIN norms ON norms.uid = valued.uid GROUP BY valued.uid, rid, template, license HAVING count(*) >= {licenses.SHARED}),
best AS (SELECT rid, arg_min(license, (-score, license)) AS own_license, max(score) AS own_score FROM cosines WHERE score >= {licenses.THRESHOLD} GROUP BY rid),
own AS (SELECT d.rid, doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, own_license, own_score, regexp_matches(path, {_quote(licenses.LICENSE_FILE)}) AND own_license IS NOT NULL AS is_license_file FROM d LEFT JOIN best USING (rid)),
speaks AS (SELECT dir AS above, arg_min(own_license, (-own_score, own_license)) AS of_dir FROM own WHERE is_license_file GROUP BY dir),
asking AS (SELECT dir, n AS depth, array_to_string(list_slice(string_split(dir, '/'), 1, n), '/') AS above FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS n FROM (SELECT DISTINCT dir FROM own))),
nearest AS (SELECT dir, arg_max(of_dir, depth) AS inherited_license FROM asking JOIN speaks USING (above) GROUP BY dir)
SELECT doc_id, path, own_license, own_score, is_license_file, inherited_license, coalesce(own_license, inherited_license) AS license FROM own LEFT JOIN nearest USING (dir)"""


ORACLES = {"op3_benchmark_decontamination": DECONTAMINATION, "op5_license_scan": license_scan(), "op8_secret_scan": secret_scan()}
