"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PARTS = "://([^/?#]*)([^?#]*)"


def _host(url: str) -> str:
    return LOWER.format(f"coalesce(regexp_extract({url}, '{PARTS}', 1), '')")


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '{PARTS}', 2), '')"


def _form(url: str) -> str:
    host = f"regexp_replace(regexp_replace({_host(url)}, ':(?:80|443)$', ''), '^www\\.', '')"
    query = (f"regexp_replace(regexp_replace(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), "
             "'(^|&)(?:utm_[^=&]*|gclid|fbclid)(?:=[^&]*)?', '', 'g'), '^&+', '')")
    whole = f"{host} || regexp_replace({_path(url)}, '/+$', '') || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"
    return f"CASE WHEN contains({url}, '://') THEN {whole} ELSE {url} END"


# "&amp;" last, so that "&amp;lt;" is "&lt;"
_ENTITIES = (("quot|#0*34|#x0*22", '"'), ("apos|#0*39|#x0*27", "''"), ("lt|#0*60|#x0*3c", "<"), ("gt|#0*62|#x0*3e", ">"), ("#0*47|#x0*2f", "/"),
             ("#0*58|#x0*3a", ":"), ("#0*61|#x0*3d", "="), ("#0*63|#x0*3f", "?"), ("amp|#0*38|#x0*26", "&"))


def _decoded(text: str) -> str:
    for names, char in _ENTITIES:
        text = f"regexp_replace({text}, '&(?i:{names});', '{char}', 'g')"
    return text


URL_FILTER = f"""
WITH RECURSIVE rules(rhost, rpath, said) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT page_id, url, html, {_host('url')} AS host, {_path('url')} AS path, {_form('url')} AS form FROM pages),
u AS (SELECT DISTINCT url, host, path, form FROM p WHERE url IS NOT NULL),
fit AS (SELECT url, form, rhost || rpath AS rule, said, row_number() OVER (PARTITION BY url ORDER BY
  length(rhost || rpath) DESC, length(rhost) DESC, said) AS nth
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
ruled AS (SELECT url, form, rule, said FROM fit WHERE nth = 1),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM p WHERE url IS NOT NULL),
written AS (SELECT url, CASE WHEN regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')
    THEN regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')
    THEN regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) END AS href FROM tags),
hrefs AS (SELECT url, {_decoded('href')} AS href, regexp_extract(url, '^([^:/?#]*)://', 1) AS scheme, {_path('url')} AS path FROM written),
rooted AS (SELECT *, scheme || '://' || {_host('url')} AS origin, CASE WHEN starts_with(href, '/') THEN href
  ELSE coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || href END AS whole FROM hrefs WHERE href <> ''),
parts AS (SELECT *, regexp_extract(whole, '^([^?#]*)', 1) AS place, regexp_extract(whole, '^[^?#]*(.*)$', 1) AS rest FROM rooted),
kept AS (SELECT *, list_reduce(list_concat([[]::VARCHAR[]], list_transform(string_split(substr(place, 2), '/'), lambda x: [x])),
  lambda out, x: CASE WHEN x[1] = '.' THEN out WHEN x[1] = '..' THEN out[1:len(out) - 1] ELSE list_concat(out, x) END) AS segments FROM parts),
targets AS (SELECT url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
  WHEN starts_with(href, '//') THEN scheme || ':' || href
  WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR NOT contains(url, '://') THEN NULL
  WHEN starts_with(href, '?') THEN origin || path || href
  WHEN starts_with(href, '#') THEN origin || path || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) || href
  ELSE origin || '/' || array_to_string(segments, '/') || CASE WHEN regexp_matches(place, '/\\.\\.?$') THEN '/' ELSE '' END || rest END AS target FROM kept),
e AS (SELECT DISTINCT {_form('url')} AS a, {_form('target')} AS b FROM targets WHERE target IS NOT NULL),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
tied AS (SELECT a AS form, min(b) AS tied FROM reach GROUP BY a),
blocked AS (SELECT DISTINCT coalesce(tied, ruled.form) AS component FROM ruled LEFT JOIN tied USING (form) WHERE said = 'block')
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN blocked.component IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  coalesce(tied, p.form) AS component
FROM p LEFT JOIN ruled USING (url) LEFT JOIN tied ON p.form = tied.form LEFT JOIN blocked ON coalesce(tied, p.form) = blocked.component
"""

WORD = "[^\\x20\\x09-\\x0D]+"

_METRICS = {"symbols": ("n_symbols", "n_words", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 6),
            "word_length": ("word_chars", "n_words", 1), "capitals": ("n_upper", "word_chars", 1), "marks": ("n_marks", "n_words", 1)}
_CELLS = " UNION ALL ".join(
    f"SELECT r, lang, source, '{m}' AS metric, {unit} AS unit, {a}::BIGINT AS over_, {b}::BIGINT AS under, (1000 * {a})::BIGINT // {b} AS v FROM s WHERE {b} > 0"
    for m, (a, b, unit) in _METRICS.items())
_LAST = "{0} + CASE WHEN {0} < 64 THEN 0 ELSE (1 << (length(bin({0})) - 6)) - 1 END"
_QUANTILES = f"""SELECT {{keys}} metric, size, low, {_LAST.format('high')} AS high, {_LAST.format('top')} AS top FROM (
  SELECT {{keys}} metric, max(size)::BIGINT AS size, min(low) FILTER (upto * 20 >= 5 * size) AS low, min(low) FILTER (upto * 20 >= 15 * size) AS high,
    min(low) FILTER (upto * 20 >= 18 * size) AS top FROM (
    SELECT {{keys}} metric, low, sum(n) OVER (PARTITION BY {{keys}} metric ORDER BY low) AS upto, sum(n) OVER (PARTITION BY {{keys}} metric) AS size
    FROM (SELECT {{keys}} metric, low, count(*) AS n FROM sk GROUP BY {{keys}} metric, low)) GROUP BY {{keys}} metric)"""
_DRAWN = ", ".join("(c.size * c.{0} + 100 * p.{0}) // (c.size + 100) AS {0}".format(q) for q in ("low", "high", "top"))
_BOUND = "CASE WHEN {0}.low > 0 THEN ({0}.high + 6 * ({0}.high - {0}.low)) * c.under ELSE 6 * (({0}.top + 1) * c.under + 1000 * c.unit) END"

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS x, len(ws) AS n
  FROM (SELECT r, regexp_extract_all(t, '{WORD}') AS ws FROM d)),
n3 AS (SELECT r, i, n, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c3 AS (SELECT r, i, CASE WHEN i <= n - 2 AND count(*) OVER (PARTITION BY r, x, y, z) > 1 THEN 1 ELSE 0 END AS again FROM n3),
rep AS (SELECT r, sum(hit) AS n_repeat_words, count(*) AS n_words FROM (
  SELECT r, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM c3) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{WORD}') GROUP BY r),
s AS (SELECT r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_marks
  FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
cells AS ({_CELLS}),
sk AS (SELECT *, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS low FROM cells),
a AS ({_QUANTILES.format(keys='')}),
l AS (SELECT c.lang, c.metric, {_DRAWN} FROM ({_QUANTILES.format(keys='lang,')}) c JOIN a p ON c.metric = p.metric),
g AS (SELECT c.lang, c.source, c.metric, {_DRAWN} FROM ({_QUANTILES.format(keys='lang, source,')}) c
  JOIN l p ON c.lang IS NOT DISTINCT FROM p.lang AND c.metric = p.metric),
bad AS (SELECT DISTINCT r FROM cells c JOIN g ON c.lang IS NOT DISTINCT FROM g.lang AND c.source IS NOT DISTINCT FROM g.source AND c.metric = g.metric
  JOIN a ON c.metric = a.metric WHERE 1000 * over_ > least({_BOUND.format('g')}, {_BOUND.format('a')}))
SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.r IS NULL AS kept
FROM s LEFT JOIN bad USING (r)
"""

_KEY = "('0x' || substr(md5(concat_ws('|', {0})), 1, 15))::BIGINT"

MIXTURE = f"""
WITH f AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n,
  {_KEY.format("'7', coalesce(doc_id::VARCHAR, ''), coalesce(text, '')")} AS key FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS tokens FROM f GROUP BY source),
a AS (SELECT max(tokens)::DOUBLE AS most, sum(tokens)::DOUBLE AS total, CASE WHEN max(tokens) = min(tokens) THEN 0.0::DOUBLE
  ELSE greatest(0, ceil((1 - ln(2) / ln(max(tokens) / min(tokens))) * 1000000) / 1000000) END AS power FROM s WHERE tokens > 0),
b AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens / total, power) ELSE 0 END AS lifted,
  CASE WHEN tokens > 0 THEN greatest(tokens, floor(tokens * pow(tokens / most, power - 1))::BIGINT) ELSE 0 END AS budget FROM s, a),
c AS (SELECT *, round(lifted / sum(lifted) OVER (), 9) AS weight, greatest(1, ceil(sum(budget) OVER () / 1000000)::BIGINT) AS blocks FROM b),
o AS (SELECT f.doc_id, f.source, f.n, f.key, c.tokens, c.budget, c.weight, c.blocks, (sum(n) OVER (PARTITION BY f.source ORDER BY key)
  - sum(n) OVER (PARTITION BY f.source, key))::BIGINT AS start FROM f JOIN c ON f.source IS NOT DISTINCT FROM c.source),
e AS (SELECT *, unnest(range(CASE WHEN tokens > 0 THEN greatest(1, ceil((budget - start) / tokens)::BIGINT) ELSE 1 END)) AS epoch FROM o),
k AS (SELECT *, least(blocks - 1, ((epoch * tokens + start) * blocks) // greatest(budget, 1)) AS block FROM e)
SELECT doc_id, source, n::BIGINT AS n_tokens, weight, epoch, block, {_KEY.format("block::VARCHAR, epoch::VARCHAR, key::VARCHAR")} AS slot FROM k
"""

WARC = """
WITH p AS (SELECT page_id, url, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
o AS (SELECT *, row_number() OVER w AS nth, first_value(page_id) OVER w AS first_id FROM p
  WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS LAST))
SELECT page_id, payload_bytes, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first_id END AS refers_to,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest
FROM o
"""
