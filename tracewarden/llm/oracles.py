"""DuckDB SQL that states the results of those queries that SQL can express."""

from __future__ import annotations

from .quality_rules import BOILERPLATE, NAVIGATION
from .url_list import EVENTS, FIRST_MINUTE, MINUTES, STEP

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op1_sql() -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in e) + ")" for e in EVENTS)
    return f"""
WITH events(list_name, kind, pattern, action, event, listed_at) AS (SELECT * FROM (VALUES {rows})),
timed AS (
  SELECT *, CAST(listed_at AS TIMESTAMP) AS valid_from,
         lead(CAST(listed_at AS TIMESTAMP)) OVER (PARTITION BY list_name, kind, pattern ORDER BY CAST(listed_at AS TIMESTAMP), event DESC, action) AS valid_to
  FROM events),
valid AS (SELECT * FROM timed WHERE event = 'add' AND (valid_to IS NULL OR valid_from < valid_to)),
captures AS (
  SELECT page_id, url, TIMESTAMP '{FIRST_MINUTE}' + to_minutes(CAST((page_id * {STEP}) % {MINUTES} AS INTEGER)) AS fetched_at,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.$', '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts,
         regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS query
  FROM pages),
keys AS (
  SELECT page_id, fetched_at, 'domain' AS kind, array_to_string(string_split(host, '.')[i:], '.') AS pattern
  FROM captures, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i) WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 'host', host FROM captures WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 'url', host || CASE WHEN len(parts) > 0 THEN '/' || array_to_string(parts, '/') ELSE '' END || query FROM captures WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 'prefix', host || '/' || array_to_string(parts[1:i], '/') FROM captures, unnest(range(1, len(parts) + 1)) AS t(i) WHERE host <> ''),
active AS (
  SELECT k.page_id, v.*, row_number() OVER (PARTITION BY k.page_id ORDER BY CASE k.kind WHEN 'url' THEN 1 WHEN 'prefix' THEN 2 WHEN 'host' THEN 3 ELSE 4 END, length(k.pattern) DESC, v.action, v.list_name) AS turn,
         count(*) OVER (PARTITION BY k.page_id) AS n
  FROM keys k JOIN valid v ON k.kind = v.kind AND k.pattern = v.pattern AND v.valid_from <= k.fetched_at AND (v.valid_to IS NULL OR k.fetched_at < v.valid_to))
SELECT c.page_id, c.url, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, c.host, coalesce(a.n, 0) AS n_active, coalesce(a.action, 'none') AS decision,
       a.list_name, a.kind, a.pattern, coalesce(a.action, 'none') <> 'block' AS kept
FROM captures c LEFT JOIN active a ON a.page_id = c.page_id AND a.turn = 1
"""


def op3_sql() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS m FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * m >= 85 * (na + nb - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.node = s.doc_id
"""


def op4_sql() -> str:
    navigation, boilerplate = "|".join(NAVIGATION), "|".join(BOILERPLATE)
    solid = f"length(translate(x, {_SPACES}, ''))"
    passes = f"""regexp_matches(x, '[.!?…:;"”»’'')\\]][ \\t\\r\\f\\x0B]*$')
    AND NOT (length(x) - length(translate(x, '|»›·•', '')) >= 2 OR regexp_matches(lower(x), '^[ \\t]*({navigation})([ \\t]+[^ \\t]+){{0,3}}[ \\t\\r]*$'))
    AND NOT regexp_matches(lower(x), '{boilerplate}')
    AND NOT (length(x) - length(translate(x, '#*$%&|<>{{}}[]~^=_\\@', ''))) * 20 > {solid}
    AND NOT (upper(x) = x AND lower(x) <> x AND {solid} > 12)"""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) AS u(k) GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(w) AS n_words, length(translate(t, {_SPACES}, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words,
         list_sum(list_transform(list_filter(list_distinct(l), lambda x: {passes}), lambda x: {solid})) AS left_chars
  FROM d LEFT JOIN cover USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars > 0 AND coalesce(left_chars, 0) / word_chars >= 0.5 AS kept
FROM v
"""


def op8_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS u(i)),
hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS lo FROM win) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, unnest(range(0, 13)) AS u(k)),
per AS (SELECT doc_id, list(i) AS x FROM gone GROUP BY doc_id),
f AS (SELECT d.doc_id, w, coalesce(x, []) AS x FROM d LEFT JOIN per USING (doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT f.doc_id, len(w) AS n_words, len(x) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM f LEFT JOIN kept USING (doc_id)
"""
