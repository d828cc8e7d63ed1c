"""DuckDB SQL for the queries that SQL can express."""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0), s AS (
  SELECT q.vec_id AS query_id, q.e AS query, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

OP6 = r"""
WITH docs AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM docs WHERE len(ls) >= 3),
k AS (SELECT doc_id, p, ls[p] AS a, ls[p + 1] AS b, ls[p + 2] AS c FROM w),
o AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS nth FROM k
  WHERE NOT (trim(a, ' ' || chr(9) || chr(13)) = '' AND trim(b, ' ' || chr(9) || chr(13)) = '' AND trim(c, ' ' || chr(9) || chr(13)) = '')
),
gone AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS line FROM o WHERE nth > 1),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS line FROM docs),
kept AS (
  SELECT l.doc_id, string_agg(x, chr(10) ORDER BY l.line) AS t, count(*) AS n
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line WHERE g.line IS NULL GROUP BY 1
)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines,
  (coalesce(len(ls), 0) - CASE WHEN ls IS NULL THEN 0 ELSE coalesce(n, 0) END)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS kept_text
FROM documents d LEFT JOIN (SELECT doc_id, text AS own, ls FROM docs) p ON p.doc_id = d.doc_id AND p.own IS NOT DISTINCT FROM d.text LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

ORACLE_SQL = {"op5_exact_top_k": OP5, "op6_line_dedup": OP6}
