"""DuckDB SQL of the rows of the queries that SQL can express."""

op3_exact_dedup = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents
), g AS (
  SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g USING (n)
"""

op9_url_filter = r"""
WITH a AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(rule_host, rule_path, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT a.page_id, a.host, a.path, r.rule_host || r.rule_path AS rule, r.action,
         row_number() OVER (PARTITION BY a.page_id, a.host, a.path ORDER BY length(r.rule_host) + length(r.rule_path) DESC NULLS LAST) AS k
  FROM a LEFT JOIN r ON (a.host = r.rule_host OR ends_with(a.host, '.' || r.rule_host)) AND starts_with(a.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
