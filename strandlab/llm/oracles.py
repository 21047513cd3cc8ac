"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

from strandlab.llm.quality_rules import BOILERPLATE, NAVIGATION

WORD = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (
  SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls,
    list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]]) AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM g),
m AS (SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM m, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id),
l AS (
  SELECT doc_id, list_filter(ls, lambda l: NOT (
    len(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > 0.1 * len(l)
    OR len(regexp_extract_all(l, '{NAVIGATION.replace("|", "|")}')) >= 3
    OR (len(regexp_extract_all(l, '\p{{Lu}}')) > len(regexp_extract_all(l, '\p{{Ll}}')) AND len(regexp_extract_all(l, '\p{{Lu}}')) > 0.5 * len(l))
    OR (regexp_matches(lower(l), '{"|".join(BOILERPLATE)}') AND len(l) < 200)
    OR NOT regexp_matches(l, '\p{{L}}'))) AS good FROM g),
c AS (
  SELECT g.doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(regexp_replace(array_to_string(good, ''), '[\x20\x09-\x0D]', '', 'g')) AS left_chars
  FROM g JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (CASE WHEN word_chars > 0 THEN 1 - left_chars / word_chars ELSE 0 END) <= 0.5 AS kept
FROM c
"""

OP6 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM iw WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
dg AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM dw, ks WHERE len(w) >= k),
m AS (SELECT DISTINCT doc_id, item_id, i, k FROM dg JOIN win USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP4 = r"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)) AS h,
    TIMESTAMP '2024-01-01' + to_seconds(('0x' || substr(md5(page_id::VARCHAR), 1, 7))::BIGINT % (366 * 86400)) AS fetched FROM pages),
d AS (SELECT DISTINCT regexp_extract(h, '([^.]+\.[^.]+\.[^.]+)$', 1) AS pattern FROM p),
l AS (
  SELECT pattern, ['adult', 'malware', 'spam'][('0x' || substr(md5(pattern), 2, 2))::BIGINT % 3 + 1] AS list,
    TIMESTAMP '2024-01-01' + to_days((('0x' || substr(md5(pattern), 4, 3))::BIGINT % 366)::INT) AS a,
    to_days((('0x' || substr(md5(pattern), 7, 2))::BIGINT % 120 + 10)::INT) AS span, ('0x' || substr(md5(pattern), 9, 1))::BIGINT % 2 = 0 AS again
  FROM d WHERE pattern <> '' AND ('0x' || substr(md5(pattern), 1, 1))::BIGINT < 8),
iv AS (SELECT pattern, list, a AS f, a + span AS t FROM l UNION ALL SELECT pattern, list, a + span + to_days(7), NULL FROM l WHERE again),
m AS (SELECT p.page_id, list, pattern, f FROM p JOIN iv ON (h = pattern OR ends_with(h, '.' || pattern)) AND f <= fetched AND (t IS NULL OR t > fetched))
SELECT page_id, coalesce(string_agg(DISTINCT list, ',' ORDER BY list), '') AS lists, count(list)::BIGINT AS n_entries, count(list) > 0 AS blocked
FROM (SELECT DISTINCT page_id FROM p) LEFT JOIN m USING (page_id) GROUP BY page_id
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS x FROM documents),
h AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
    ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
p AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (
  SELECT doc_id, t, n, a, b, form, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || left(t, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || left(t, a) || '<M>' || substring(t, a + 1, b - a) END AS o FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(o) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""

ORACLES = {
    "op12_fill_middle": OP12,
    "op4_url_filters": OP4,
    "op6_decontaminate": OP6,
    "op5_quality_rules": OP5,
}
