"""DuckDB statements equal to the training-data queries that SQL can express."""

from __future__ import annotations

_LEXIMIN = """
WITH rows AS (
  SELECT query_id, chunk_key, scored_at, loaded_at,
         CASE WHEN isnan(dense_score) THEN NULL ELSE dense_score END AS a,
         CASE WHEN isnan(sparse_score) THEN NULL ELSE sparse_score END AS b,
         CASE WHEN isnan(late_interaction_score) THEN NULL ELSE late_interaction_score END AS c
  FROM native_candidates WHERE query_id IS NOT NULL AND chunk_key IS NOT NULL),
latest AS (
  SELECT * FROM rows QUALIFY row_number() OVER (
    PARTITION BY query_id, chunk_key
    ORDER BY scored_at DESC NULLS LAST, loaded_at DESC NULLS LAST,
             a DESC NULLS LAST, b DESC NULLS LAST, c DESC NULLS LAST) = 1),
pct AS (
  SELECT query_id, chunk_key,
    CASE WHEN a IS NULL THEN 0.0::DOUBLE ELSE
      ((rank() OVER (PARTITION BY query_id ORDER BY a NULLS FIRST) - 1)
       + (count(*) OVER (PARTITION BY query_id, a) + 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY query_id) END AS a,
    CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE
      ((rank() OVER (PARTITION BY query_id ORDER BY b NULLS FIRST) - 1)
       + (count(*) OVER (PARTITION BY query_id, b) + 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY query_id) END AS b,
    CASE WHEN c IS NULL THEN 0.0::DOUBLE ELSE
      ((rank() OVER (PARTITION BY query_id ORDER BY c NULLS FIRST) - 1)
       + (count(*) OVER (PARTITION BY query_id, c) + 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY query_id) END AS c
  FROM latest),
vec AS (SELECT query_id, chunk_key, list_sort([a, b, c]) AS v FROM pct),
ranked AS (
  SELECT query_id, chunk_key, v[1] AS v0, v[2] AS v1, v[3] AS v2,
         row_number() OVER (PARTITION BY query_id ORDER BY v[1] DESC, v[2] DESC, v[3] DESC, chunk_key) AS position
  FROM vec)
"""

_PLAIN = "lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_PATH = _PLAIN.format("replace({}, '\\', '/')")

_GROUPS = f"""
WITH RECURSIVE c AS (
  SELECT DISTINCT case_no AS r, lower(trim(split_name)) AS s, author, entities FROM benchmark_cases WHERE case_no IS NOT NULL),
l AS (
  SELECT case_no AS r, label_id, {_PATH.format("document_id")} AS d FROM case_labels WHERE case_no IS NOT NULL),
own AS (
  SELECT r, label_id, CASE WHEN d NOT IN ('', '-', 'n/a', 'unknown') THEN d END AS d FROM l),
known AS (
  SELECT span_id, min(d) AS d FROM (SELECT span_id, {_PATH.format("document_id")} AS d FROM spans WHERE span_id IS NOT NULL)
  WHERE d NOT IN ('', '-', 'n/a', 'unknown') GROUP BY 1),
named AS (
  SELECT r, 'a' AS kind, {_PLAIN.format("author")} AS t FROM c
  UNION ALL SELECT r, 'e', {_PLAIN.format("u.x")} FROM c, unnest(entities) AS u(x)
  UNION ALL SELECT r, 'd', d FROM own WHERE d IS NOT NULL
  UNION ALL SELECT own.r, 'd', known.d FROM own JOIN known ON own.label_id = known.span_id WHERE own.d IS NULL),
link AS (SELECT DISTINCT r, kind || t AS k FROM named WHERE t NOT IN ('', '-', 'n/a', 'unknown')),
reach(r, x) AS (
  SELECT DISTINCT r, r FROM link
  UNION SELECT reach.r, b.r FROM reach JOIN link a ON reach.x = a.r JOIN link b ON a.k = b.k),
grp AS (SELECT r, min(x) AS g FROM reach GROUP BY 1),
placed AS (SELECT DISTINCT c.r, c.s, coalesce(grp.g, c.r) AS g FROM c LEFT JOIN grp ON c.r = grp.r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _GROUPS + """SELECT DISTINCT r AS case_no FROM placed
            WHERE g IN (SELECT g FROM placed GROUP BY g HAVING count(DISTINCT s) > 1)""",
        "p2_found": """SELECT DISTINCT d.id AS document_id FROM documents_in d
            JOIN phase5_configs c ON c.config_name = coalesce(d.config_name, 'phase3-base')
            WHERE length(regexp_replace(d.content, '^\\s+|\\s+$', '', 'g')) > c.chunk_size""",
        "p1_found": _LEXIMIN + "SELECT query_id, chunk_key FROM ranked WHERE position = 1",
        "p1_ranking": _LEXIMIN + "SELECT query_id, chunk_key, position, v0, v1, v2 FROM ranked",
    }
