"""Manifest, merge, cache and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.functions import vectors as V
from vellum.operators import store as K
from vellum.runtime import ship, spread, table


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Last entry with a hash per path of the manifest, separators unified, as the known state."""
    m = table(spark, d, "manifest").where("file_hash is not null").withColumn("source_path", F.translate("source_path", "\\", "/"))
    x = m.groupBy("source_path").agg(F.max(F.struct("run_id", F.lower("file_hash").alias("h"), "doc_id")).alias("x"))
    return x.select("source_path", "x.doc_id", F.col("x.h").alias("file_hash"))


def _now(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents_md").select("source_path", "doc_id", "file_hash").distinct()


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return K.manifest_diff(_known(spark, d), _now(spark, d))


def ingest_order(spark: SparkSession, d: str) -> DataFrame:
    """New and changed paths in order."""
    diff = K.manifest_diff(_known(spark, d), _now(spark, d))
    both = diff.where("status = 'new'").select("source_path").union(diff.where("status = 'changed'").select("source_path")).distinct()
    return both.orderBy("source_path")


def removed_paths(spark: SparkSession, d: str) -> DataFrame:
    """Known paths that are gone."""
    return _known(spark, d).select("source_path").join(_now(spark, d).select("source_path"), "source_path", "left_anti")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct("chunk_index", "doc_id", "token_count")).alias("x")).select("chunk_id", "x.*")


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """All chunks stored with a token less; all chunks of even places upserted twice, at two places."""
    c = _chunks(spark, d)
    batch = c.where("chunk_index % 2 = 0")
    return K.upsert(c.withColumn("token_count", F.col("token_count") - 1), batch.unionByName(batch.withColumn("chunk_index", F.col("chunk_index") + 10))).select("chunk_id", "doc_id", "chunk_index", "token_count")


def delete_by_filter(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents_md").select("doc_id", "doc_type", "language").distinct()
    return K.delete_where(m, F.col("doc_type") == "manual").select("doc_id", "doc_type").distinct()


def fetch_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the evidence names."""
    ids = table(spark, d, "evidence").select("chunk_id")
    return K.fetch(_chunks(spark, d), ids).select("chunk_id", "doc_id")


def document_join(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with fields of their documents."""
    m = table(spark, d, "documents_md").groupBy("doc_id").agg(F.min("file_name").alias("file_name"), F.min("doc_type").alias("doc_type"))
    return K.join_documents(_chunks(spark, d), m).select("chunk_id", "file_name", "doc_type")


#: Models whose vectors the cache holds.
MODELS = ("local:vetor-base:cpu", "local:vetor-mini:cpu")


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk under every model."""
    return _chunks(spark, d).select("chunk_id", F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    r = K.cache_lookup(_wanted(spark, d), table(spark, d, "embed_cache"))
    return r.select("chunk_id", "model", "hit", F.coalesce(F.size("dense"), F.lit(-1)).alias("dims"))


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return K.cache_misses(_wanted(spark, d), table(spark, d, "embed_cache"))


def cache_reassemble(spark: SparkSession, d: str) -> DataFrame:
    wanted, cache = _wanted(spark, d), table(spark, d, "embed_cache")
    fresh = K.cache_misses(wanted, cache).withColumn("dense", F.array().cast("array<float>"))
    return K.reassemble(wanted, cache, fresh).select("chunk_id", "model", "cached")


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.cache_stats(table(spark, d, "embed_cache").select("chunk_id", "model", "dense").distinct())


def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    diff = K.manifest_diff(_known(spark, d), _now(spark, d))
    todo = diff.where("status in ('new', 'changed')").select("doc_id")
    c = _chunks(spark, d).join(todo, "doc_id", "left_semi")
    hits = K.cache_lookup(c.select("chunk_id", F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model")), table(spark, d, "embed_cache"))
    return K.ingest_report(diff, c, hits)


def invalidate_model(spark: SparkSession, d: str) -> DataFrame:
    """A3: entries left after one model's are dropped."""
    left = K.invalidate_model(table(spark, d, "embed_cache"), MODELS[1])
    return left.groupBy("model").agg(F.count_distinct("chunk_id").alias("entries"))


def token_weights_max(spark: SparkSession, d: str) -> DataFrame:
    """Every sparse vector of every model as its tokens twice, at full and half weight, with special
    ids mixed in."""
    e = table(spark, d, "embed_cache").where("sparse is not null and model is not null").select(F.struct("model", "chunk_id").alias("text_id"), F.explode("sparse").alias("token_id", "weight"))
    rows = e.unionByName(e.withColumn("weight", F.col("weight") / 2)).unionByName(e.withColumn("token_id", F.lit(2)))
    return K.token_weights(rows).select("text_id.model", F.col("text_id.chunk_id").alias("text_id"), "token_id", F.round(F.col("weight").cast("double"), 6).alias("weight"))


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", V.l2_normalize(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return e.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(V.norm(F.col("v")), 6).alias("norm"))


def dimension_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.size(V.check_dimension(F.col("embedding"), 64)).alias("dims"))


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    t = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", V.hash_embed(F.col("text"), 64).alias("v"), V.hash_embed_sparse(F.col("text")).alias("s"))
    return t.select("doc_id", F.round(V.norm(F.col("v")), 4).alias("norm"), F.size("s").alias("buckets"))


QUERIES = {
    f.__name__: f
    for f in (manifest_diff, ingest_order, removed_paths, upsert_merge, delete_by_filter, fetch_ids, document_join, cache_lookup, cache_misses, cache_reassemble, cache_stats, ingest_report, invalidate_model, token_weights_max, l2_normalize, dimension_check, hash_embed)
}

_KNOWN = r"""
known AS (SELECT source_path, doc_id, h FROM (SELECT replace(source_path, '\', '/') AS source_path, doc_id, lower(file_hash) AS h,
  row_number() OVER (PARTITION BY replace(source_path, '\', '/') ORDER BY run_id DESC, lower(file_hash) DESC, doc_id DESC) AS n FROM manifest WHERE file_hash IS NOT NULL) WHERE n = 1),
now AS (SELECT DISTINCT source_path, doc_id, file_hash AS h FROM documents_md),
diff AS (SELECT coalesce(k.source_path, n.source_path) AS source_path, coalesce(n.doc_id, k.doc_id) AS doc_id,
  CASE WHEN n.source_path IS NULL THEN 'removed' WHEN k.source_path IS NULL THEN 'new' WHEN k.h IS DISTINCT FROM n.h THEN 'changed' ELSE 'unchanged' END AS status
  FROM known k FULL JOIN now n ON k.source_path = n.source_path)"""
_C = """c AS (SELECT chunk_id, chunk_index, doc_id, token_count FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_index DESC, doc_id DESC, token_count DESC) AS n FROM chunks WHERE chunk_id IS NOT NULL) WHERE n = 1)"""
_W = "w AS (SELECT c.chunk_id, c.doc_id, m.model FROM c CROSS JOIN (VALUES ('local:vetor-base:cpu'), ('local:vetor-mini:cpu')) m(model))"
_CACHED = "(w.chunk_id, w.model) IN (SELECT chunk_id, model FROM embed_cache WHERE chunk_id IS NOT NULL AND model IS NOT NULL)"

SQL = {
    "manifest_diff": f"WITH {_KNOWN} SELECT * FROM diff",
    "ingest_order": f"WITH {_KNOWN} SELECT DISTINCT source_path FROM diff WHERE status IN ('new', 'changed') ORDER BY source_path",
    "removed_paths": f"WITH {_KNOWN} SELECT source_path FROM known WHERE source_path NOT IN (SELECT source_path FROM now)",
    "upsert_merge": f"""WITH {_C} SELECT chunk_id, doc_id, CASE WHEN chunk_index % 2 = 0 THEN chunk_index + 10 ELSE chunk_index END AS chunk_index, CASE WHEN chunk_index % 2 = 0 THEN token_count ELSE token_count - 1 END AS token_count FROM c""",
    "delete_by_filter": "SELECT DISTINCT doc_id, doc_type FROM documents_md WHERE doc_type IS DISTINCT FROM 'manual'",
    "fetch_ids": f"WITH {_C} SELECT chunk_id, doc_id FROM c WHERE chunk_id IN (SELECT chunk_id FROM evidence)",
    "document_join": f"WITH {_C}, m AS (SELECT doc_id, min(file_name) AS file_name, min(doc_type) AS doc_type FROM documents_md GROUP BY doc_id) SELECT chunk_id, file_name, doc_type FROM c JOIN m USING (doc_id)",
    "cache_lookup": f"""WITH {_C}, {_W}, e AS (SELECT chunk_id, model, max(dense) AS dense FROM embed_cache GROUP BY ALL)
SELECT w.chunk_id, w.model, e.chunk_id IS NOT NULL AS hit, CAST(coalesce(len(e.dense), -1) AS INT) AS dims FROM w LEFT JOIN e ON e.chunk_id = w.chunk_id AND e.model = w.model""",
    "cache_misses": f"WITH {_C}, {_W} SELECT chunk_id, model FROM w WHERE NOT {_CACHED}",
    "cache_reassemble": f"WITH {_C}, {_W} SELECT chunk_id, model, {_CACHED} AS cached FROM w",
    "invalidate_model": "SELECT model, count(DISTINCT chunk_id) AS entries FROM embed_cache WHERE model IS DISTINCT FROM 'local:vetor-mini:cpu' GROUP BY model",
    "cache_stats": "SELECT model, count(DISTINCT chunk_id) AS entries, count(*) FILTER (len(dense) > 0) AS full_rows FROM (SELECT DISTINCT chunk_id, model, dense FROM embed_cache) GROUP BY model",
    "ingest_report": f"""WITH {_KNOWN}, {_C}, {_W}, t AS (SELECT * FROM w WHERE doc_id IN (SELECT doc_id FROM diff WHERE status IN ('new', 'changed')))
SELECT count(*) FILTER (status <> 'removed') AS scanned, count(*) FILTER (status = 'new') AS "new", count(*) FILTER (status = 'changed') AS changed,
 count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'unchanged') AS unchanged, (SELECT count(DISTINCT chunk_id) FROM t) AS chunks_upserted,
 (SELECT count(*) FROM t w WHERE {_CACHED}) AS cache_hits, (SELECT count(*) FROM t w WHERE NOT {_CACHED}) AS cache_misses FROM diff""",
    "token_weights_max": """WITH e AS (SELECT model, chunk_id, unnest(map_keys(sparse)) AS t, unnest(map_values(sparse)) AS w FROM embed_cache WHERE sparse IS NOT NULL AND model IS NOT NULL)
SELECT model, chunk_id AS text_id, t AS token_id, round(max(w)::DOUBLE, 6) AS weight FROM e WHERE w > 0 AND t NOT IN (0, 1, 2, 3) GROUP BY model, chunk_id, t""",
    "l2_normalize": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * 3 AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, round(v[1] / greatest(sqrt(list_inner_product(v, v)), 1e-12), 6) AS first, 1.0::DOUBLE AS norm FROM v""",
    "dimension_check": "SELECT vec_id, CAST(len(embedding) AS INT) AS dims FROM embeddings",
}
