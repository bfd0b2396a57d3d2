"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from needlework.llm import embedding_dedup, quality_rules, url_filter

_W = r"[^\x20\x09-\x0D]"

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '{_W}+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines FROM d),
grams AS (SELECT r, i, array_to_string(ws[i:i + {quality_rules.WINDOW - 1}], ' ') AS g
          FROM (SELECT r, ws, unnest(range(1, len(ws) - {quality_rules.WINDOW - 2})) AS i FROM w)),
twice AS (SELECT r, unnest(list(i)) AS i FROM grams GROUP BY r, g HAVING count(*) > 1),
inside AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + {quality_rules.WINDOW})) AS place FROM twice) GROUP BY r),
s AS (SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(inside.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN inside ON inside.r = w.r),
f AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
        100 * n_symbols > {quality_rules.SOFT_SYMBOLS_PERCENT} * greatest(n_words, 1) OR n_dup_lines > {quality_rules.SOFT_DUP_LINES} AS soft FROM s),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR soft)::DOUBLE AS x FROM f GROUP BY source),
p AS (SELECT sum(x) / sum(n) AS m, var_pop(x / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN greatest({quality_rules.LEAST_WEIGHT}, least({quality_rules.MOST_WEIGHT}, m * (1 - m) / v - 1)) ELSE {quality_rules.MOST_WEIGHT} END AS k FROM p),
bad AS (SELECT source FROM h, q WHERE (x + k * m) / (n + k) > m + {quality_rules.HOST_DEVIATIONS} * sqrt(m * (1 - m) / (k + 1)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (soft AND EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source)) AS kept FROM f
"""

_RULES = ", ".join(
    f"('{said}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for said, rule in url_filter.RULES
)
_LINK, _ANCHOR = (x.replace("'", "''") for x in (url_filter.LINK, url_filter.ANCHOR))

OP7 = f"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
l AS (SELECT row_number() OVER () AS r, page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(said, rule, h, p) AS (VALUES {_RULES}),
fit AS (SELECT r, arg_max(said, length(rule)) AS said, arg_max(rule, length(rule)) AS rule FROM l JOIN rules
        ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
ruled AS (SELECT l.*, said, rule FROM l LEFT JOIN fit USING (r)),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(regexp_extract(unnest(regexp_extract_all(coalesce(html, ''), '{_ANCHOR}', 1)), '{_LINK}', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS dst FROM l)
      WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
mass AS (SELECT host, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad FROM ruled WHERE said IS NOT NULL AND host <> '' GROUP BY host),
start AS (SELECT host, {1 - url_filter.DAMPING} * good / (SELECT sum(good + bad) FROM mass) AS t, {1 - url_filter.DAMPING} * bad / (SELECT sum(good + bad) FROM mass) AS d FROM mass),
moves AS (
  SELECT src AS a, dst AS b, {url_filter.DAMPING} * n / sum(n) OVER (PARTITION BY src) AS wt, 0.0::DOUBLE AS wd FROM e
  UNION ALL SELECT dst, src, 0.0, {url_filter.DAMPING} * n / sum(n) OVER (PARTITION BY dst) FROM e
  UNION ALL SELECT '*', host, t, d FROM start UNION ALL SELECT '*', '*', 1.0, 1.0),
ranks AS (SELECT 0 AS k, host, t::DOUBLE AS t, d::DOUBLE AS d FROM start UNION ALL SELECT 0, '*', 1.0, 1.0
  UNION ALL SELECT k + 1, b, sum(t * wt), sum(d * wd) FROM ranks JOIN moves ON a = host WHERE k < {url_filter.STEPS} GROUP BY k, b)
SELECT page_id, ruled.host, path, rule, coalesce(said, CASE WHEN coalesce(d, 0) > {url_filter.DISTRUST} * coalesce(t, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN (SELECT host, t, d FROM ranks WHERE k = {url_filter.STEPS} AND host <> '*') x ON x.host = ruled.host
"""

_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"

OP8 = f"""
WITH RECURSIVE v AS (SELECT vec_id, {_UNIT} AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {embedding_dedup.COSINE}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, min(y) AS component_id, vec_id = min(y) AS kept FROM embeddings JOIN reach ON x = vec_id GROUP BY vec_id
"""
