"""SQL of those queries that SQL can express on whole tables."""

_RANKS = """
WITH latest AS (
  SELECT query_id, lower(trim(mode)) AS mode, chunk_id,
         CASE WHEN isnan(score) THEN NULL ELSE score END AS score,
         row_number() OVER (PARTITION BY query_id, lower(trim(mode)), chunk_id
                            ORDER BY retrieved_at DESC NULLS LAST,
                                     CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST) AS n
  FROM evidence WHERE query_id IS NOT NULL AND mode IS NOT NULL AND chunk_id IS NOT NULL),
scored AS (SELECT * FROM latest WHERE n = 1 AND score IS NOT NULL AND mode IN ('dense', 'fts', 'sparse', 'hybrid')),
ranked AS (
  SELECT query_id, mode, chunk_id,
         rank() OVER (PARTITION BY query_id, mode ORDER BY score DESC)
         + (count(*) OVER (PARTITION BY query_id, mode, score) - 1) / 2.0 AS r
  FROM scored),
items AS (SELECT DISTINCT query_id, chunk_id FROM ranked),
sizes AS (SELECT query_id, count(*) + 1.0 AS last FROM items GROUP BY query_id),
filled AS (
  SELECT i.query_id, i.chunk_id, CAST(coalesce(r.r, s.last) AS DOUBLE) AS r
  FROM items i JOIN sizes s USING (query_id)
  CROSS JOIN (VALUES ('dense'), ('fts'), ('sparse'), ('hybrid')) m(mode)
  LEFT JOIN ranked r ON r.query_id = i.query_id AND r.chunk_id = i.chunk_id AND r.mode = m.mode),
fused AS (SELECT query_id, chunk_id, median(r) AS median_rank, avg(r) AS mean_rank FROM filled GROUP BY ALL)
"""

SQL = {
    "p4_found": _RANKS + """
SELECT query_id, chunk_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY median_rank, mean_rank, chunk_id) AS place FROM fused)
WHERE place <= 3""",
    "p4_ranks": _RANKS + "SELECT query_id, chunk_id, median_rank, round(mean_rank, 6) AS mean_rank FROM fused",
    "p6_found": """
WITH usable AS (
  SELECT chunk_id, model, min(dense) AS v FROM embed_cache
  WHERE len(dense) = 64 AND chunk_id IS NOT NULL AND model IS NOT NULL
    AND len(list_filter(dense, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(dense, lambda x: x <> 0)) > 0
  GROUP BY chunk_id, model),
pairs AS (
  SELECT a.chunk_id AS a, b.chunk_id AS b, a.model, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS c
  FROM usable a JOIN usable b ON a.model = b.model AND a.chunk_id <> b.chunk_id),
near AS (
  SELECT *, row_number() OVER (PARTITION BY a, model ORDER BY c DESC, b) AS n FROM pairs WHERE c >= 0.85)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b, model FROM near WHERE n <= 5""",
    "p10_found": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '\p{Nd}+(?:[.,:/]\p{Nd}+)*', ' 0 ', 'g'), '[\p{L}\p{N}]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 5], ' ') AS g, len(w) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM words WHERE len(w) >= 6)),
again AS (SELECT doc_id, n, i, min(i) OVER (PARTITION BY doc_id, g) AS f FROM grams),
covered AS (SELECT doc_id, n, count(DISTINCT p) AS c FROM (SELECT doc_id, n, unnest(range(i, i + 6)) AS p FROM again WHERE f < i) GROUP BY doc_id, n)
SELECT DISTINCT doc_id FROM covered WHERE c >= 0.25 * n""",
}
