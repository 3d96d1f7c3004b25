"""Search, fusion and post-filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from vellum.functions import vectors as V
from vellum.operators import search as S
from vellum.operators.filters import Filters, tag_overlap
from vellum.operators.generation import hit_line
from vellum.runtime import ship, spread, table

STEP = 50  # questions are the rows whose id this divides


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text", "lang", "source", "doc_type", "n_chars"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the documents whose id STEP divides."""
    return table(spark, d, "documents").where((F.col("doc_id") % STEP == 0) & F.col("title").isNotNull()).select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _vector_questions(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where(F.col("doc_id") % STEP == 0).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("v"))


def _show(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank", *more)


def _fts(spark: SparkSession, d: str, p: Column | None = None, k: int = 20) -> DataFrame:
    return S.search_fts(_docs(spark, d), _questions(spark, d), "doc_id", "text", k, p)


def search_fts_topk(spark: SparkSession, d: str) -> DataFrame:
    return _show(_fts(spark, d))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return S.search_dense(_vectors(spark, d), _vector_questions(spark, d), "doc_id", "embedding")


def search_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _show(_dense(spark, d))


def _sparse_rows(spark: SparkSession, d: str) -> DataFrame:
    """One sparse vector per chunk and model, its ids made part of the model."""
    one = table(spark, d, "embed_cache").where("sparse is not null and chunk_id is not null and model is not null").groupBy("chunk_id", "model").agg(F.min(F.array_sort(F.map_entries("sparse"))).alias("e"))
    return one.select("chunk_id", "model", F.map_from_entries(F.transform("e", lambda x: F.struct(F.struct(F.col("model"), x["key"]).alias("key"), x["value"].alias("value")))).alias("sparse"))


def search_sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    """Inner products, each question within its own model; questions: chunks whose id, a hexadecimal
    number at its end, STEP divides."""
    rows = _sparse_rows(spark, d)
    asked = rows.where(F.conv(F.right("chunk_id", F.lit(4)), 16, 10).cast("int") % STEP == 0)
    r = S.search_sparse(rows, asked.select(F.struct("model", "chunk_id").alias("query_id"), F.col("sparse").alias("v")), "chunk_id", "sparse")
    return r.select("query_id.model", F.col("query_id.chunk_id").alias("query_id"), F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "rank")


def _lists(spark: SparkSession, d: str) -> list[DataFrame]:
    return [_dense(spark, d), _fts(spark, d)]


def search_hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Dense and word lists fused with the constant that suits the question."""
    c = _questions(spark, d).select("query_id", S.rank_constant(F.col("text")).alias("rc"))
    lists = [x.join(c, "query_id", "left").withColumn("rc", F.coalesce("rc", F.lit(20))) for x in _lists(spark, d)]
    return _show(S.fuse_rrf(lists, F.col("rc")))


def search_semantic_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Without a sparse vector: dense and word lists with the constant 10."""
    return _show(S.fuse_rrf(_lists(spark, d), 10))


def search_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _show(S.fuse_weighted(_lists(spark, d), [1.0, 0.6]))


def adaptive_rank_constant(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("title is not null").select("doc_id", F.col("title").alias("q"))
    e = table(spark, d, "eval_items").select(F.col("item_id").alias("doc_id"), F.col("text").alias("q"))
    return t.unionByName(e).select("doc_id", S.rank_constant(F.col("q")).alias("constant"))


def _filtered(make: Callable[[], Filters]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _show(_fts(spark, d, make().build()))

    return run


def retrieve_filtered_or(spark: SparkSession, d: str) -> DataFrame:
    return _show(_fts(spark, d, Filters().lt("n_chars", 600).gte("n_chars", 1500).ne("lang", "pt").build_or()))


# --- hits of the evidence table --------------------------------------------------------------


MODES = ("dense", "fts", "sparse", "hybrid")


def _asked() -> Column:
    """A question in one mode is a question of its own: ten times its number and the mode's place."""
    return F.col("query_id") * 10 + F.array_position(F.array(*[F.lit(m) for m in MODES]), F.lower(F.trim("mode")))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """``(query_id)``: all questions in all modes."""
    return table(spark, d, "evidence").where("query_id is not null and mode is not null").select(_asked().alias("query_id")).distinct()


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of every question in every mode: the latest row per chunk, ranked by score."""
    e = table(spark, d, "evidence").where("mode is not null and chunk_id is not null and query_id is not null").withColumn("query_id", _asked())
    late = e.groupBy("query_id", "chunk_id").agg(F.max(F.struct("retrieved_at", "score", "doc_id", "source_path", "file_name", "chunk_index", "snippet", "h1", "h2", "h3", "title", "tags")).alias("x"))
    return S.rank(late.select("query_id", "chunk_id", "x.*").where("score is not null"), 1_000_000, key="chunk_id")


def retrieve_diversified(spark: SparkSession, d: str) -> DataFrame:
    r = S.post_filter(hits(spark, d), per_doc=3, cap=8)
    return r.select("query_id", "chunk_id", "place", F.round("score", 6).alias("score"))


def retrieve_tags_postfilter(spark: SparkSession, d: str) -> DataFrame:
    r = S.post_filter(hits(spark, d), ["interno", "norma"], 0.02, 3, 8)
    return r.select("query_id", "chunk_id", "place")


def retrieve_confidence(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d)
    return S.confidence(S.post_filter(hits(spark, d), ["norma"], 0.03), q).select("query_id", F.round("confidence", 6).alias("confidence"), "hits")


def retrieve_batch_merge(spark: SparkSession, d: str) -> DataFrame:
    r = S.merge_queries(S.post_filter(hits(spark, d)), 8)
    return r.select("chunk_id", F.round("score", 6).alias("score"), "queries")


def score_threshold(spark: SparkSession, d: str) -> DataFrame:
    return S.post_filter(hits(spark, d), threshold=0.5, per_doc=None, cap=None).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def conflict_flag(spark: SparkSession, d: str) -> DataFrame:
    return S.has_conflict(S.post_filter(hits(spark, d)))


def reliability_retry(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose first, filtered attempt found nothing or little, answered by the wider one."""
    first = S.post_filter(hits(spark, d).where("rank <= 4"), ["norma"], 0.02)
    q = asked(spark, d)
    weak = S.confidence(first, q).where("hits = 0 or confidence < 0.02").select("query_id")
    again = S.post_filter(hits(spark, d).where("rank <= 8").join(weak, "query_id", "left_semi"), ["norma"], 0.02)
    both = first.join(weak, "query_id", "left_anti").withColumn("attempt", F.lit(0)).unionByName(again.withColumn("attempt", F.lit(1)))
    return both.select("query_id", "chunk_id", "place", "attempt")


def retrieve_text(spark: SparkSession, d: str) -> DataFrame:
    r = S.post_filter(hits(spark, d))
    return r.select("query_id", "place", hit_line(F.col("place"), 60).alias("line"))


def retrieve_json(spark: SparkSession, d: str) -> DataFrame:
    """Hits per question as JSON, read back to count and sum."""
    r = S.post_filter(hits(spark, d))
    j = r.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("place", "chunk_id", F.round("score", 6).alias("score"))))).alias("j"))
    back = j.select("query_id", F.from_json("j", "array<struct<place:int,chunk_id:string,score:double>>").alias("a"))
    return back.select("query_id", F.size("a").alias("n"), F.array_join(F.transform("a", lambda x: x["chunk_id"]), ",").alias("chunks"))


def tags_overlap(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents_md").select("doc_id", "tags").distinct()
    return m.where(tag_overlap(F.col("tags"), ["bomba", "legado"])).select("doc_id").distinct()


def evidence_projection(spark: SparkSession, d: str) -> DataFrame:
    """F19 over all rows of the table."""
    e = S.evidence(table(spark, d, "evidence").withColumn("query_id", _asked()).distinct())
    return e.select("query_id", "chunk_id", "doc_id", F.round("score", 6).alias("score"), "chunk_index", F.length("snippet").alias("signs"), F.size("tags").alias("n_tags"), "h1", "title").distinct()


def sparse_codec(spark: SparkSession, d: str) -> DataFrame:
    """Every sparse vector packed and read back."""
    ship(spark)
    e = table(spark, d, "embed_cache").where("chunk_id is not null and model is not null").select("chunk_id", "model", "sparse", V.encode_sparse(F.col("sparse")).alias("b"))
    e = e.withColumn("back", V.decode_sparse(F.col("b")))
    total = F.aggregate(F.map_values("back"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.select("chunk_id", "model", F.length("b").alias("bytes"), F.size("back").alias("n"), F.round(total, 4).alias("total"), F.array_max(F.map_keys("back")).alias("last")).where("bytes is not null").distinct()


def rank_within_document(spark: SparkSession, d: str) -> DataFrame:
    """Place of each chunk of the hybrid list within its document."""
    w = W.partitionBy("query_id", "doc_id").orderBy("rank")
    return hits(spark, d).select("query_id", "chunk_id", F.row_number().over(w).alias("place"))


QUERIES = {
    "search_fts_topk": search_fts_topk,
    "search_dense_topk": search_dense_topk,
    "search_sparse_topk": search_sparse_topk,
    "search_hybrid_rrf": search_hybrid_rrf,
    "search_semantic_rrf": search_semantic_rrf,
    "search_weighted": search_weighted,
    "adaptive_rank_constant": adaptive_rank_constant,
    "retrieve_filtered_eq": _filtered(lambda: Filters().eq("lang", "pt")),
    "retrieve_filtered_in": _filtered(lambda: Filters().in_("doc_type", ["manual", "ata"])),
    "retrieve_filtered_like": _filtered(lambda: Filters().like("source", "acervo/%47")),
    "retrieve_filtered_range": _filtered(lambda: Filters().gte("n_chars", 500).lt("n_chars", 1000)),
    "retrieve_filtered_raw": _filtered(lambda: Filters().raw("doc_type is not null and not (lang <=> 'pt')")),
    "retrieve_filtered_or": retrieve_filtered_or,
    "retrieve_diversified": retrieve_diversified,
    "retrieve_tags_postfilter": retrieve_tags_postfilter,
    "retrieve_confidence": retrieve_confidence,
    "retrieve_batch_merge": retrieve_batch_merge,
    "score_threshold": score_threshold,
    "conflict_flag": conflict_flag,
    "reliability_retry": reliability_retry,
    "retrieve_text": retrieve_text,
    "retrieve_json": retrieve_json,
    "tags_overlap": tags_overlap,
    "rank_within_document": rank_within_document,
    "evidence_projection": evidence_projection,
    "sparse_codec": sparse_codec,
}

# --- SQL -------------------------------------------------------------------------------------

_TERMS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def _ranked(source: str, key: str = "doc_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, {key}) AS rank FROM {source}"


def _fts_ctes(where: str = "true") -> str:
    return f"""
docs AS (SELECT doc_id, text, lang, source, doc_type, n_chars FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, unnest({_TERMS.format(x='text')}) AS term FROM docs),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, len({_TERMS.format(x='text')}) AS dl FROM docs),
tot AS (SELECT count(*) AS n, avg(dl::DOUBLE) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT doc_id AS query_id, title AS text FROM documents WHERE doc_id % {STEP} = 0 AND title IS NOT NULL),
qt AS (SELECT DISTINCT query_id, unnest({_TERMS.format(x='text')}) AS term FROM q),
fscored AS (
  SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM qt JOIN post USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN tot
  WHERE doc_id IN (SELECT doc_id FROM docs WHERE {where}) GROUP BY ALL),
f AS (SELECT * FROM ({_ranked('fscored')}) WHERE rank <= 20)"""


def _fts_sql(where: str = "true") -> str:
    return f"WITH {_fts_ctes(where)} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM f"


_DENSE = f"""
dscored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % {STEP} = 0),
v AS (SELECT * FROM ({_ranked('dscored')}) WHERE rank <= 20)"""

_NAMES = r"regexp_matches(q, '[A-Z]{2,}|[A-Z][a-z]+\s[A-Z]')"


def _constant(q: str = "q") -> str:
    n = f"len(list_filter(regexp_split_to_array({q}, '[\\s]+'), lambda w: w <> ''))"
    names = _NAMES.replace("(q,", f"({q},")
    return rf"""CASE WHEN regexp_matches({q}, '\d') AND {names} THEN 5 WHEN regexp_matches({q}, '\d') OR {names} THEN 10
 WHEN regexp_matches(lower({q}), '{S.CONCEPT}') THEN 60 WHEN {n} <= 3 THEN 10 WHEN {n} > 10 THEN 40 ELSE 20 END"""


def _fused(parts: str) -> str:
    return f"""WITH {_fts_ctes()}, {_DENSE},
u AS ({parts}),
s AS (SELECT query_id, doc_id, sum(s) AS score FROM u GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ({_ranked('s')}) WHERE rank <= 20"""


def _hits() -> str:
    return f"""
ev AS (SELECT * REPLACE (query_id * 10 + list_position({list(MODES)}, lower(trim(mode))) AS query_id) FROM evidence WHERE mode IS NOT NULL AND query_id IS NOT NULL),
late AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY retrieved_at DESC NULLS LAST, score DESC NULLS LAST) AS n
  FROM ev WHERE chunk_id IS NOT NULL),
h AS (SELECT * EXCLUDE (n, rank, mode), row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank
      FROM late WHERE n = 1 AND score IS NOT NULL)"""


def _post(name: str, source: str = "h", tags: str = "", threshold: float = 0.0, per_doc: int = 3, cap: int = 8) -> str:
    t = f"coalesce(list_has_any(tags, [{tags}]), false)" if tags else "true"
    return f"""
{name}1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS nd FROM {source} WHERE {t} AND score >= {threshold}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM {name}1 WHERE nd <= {per_doc}) WHERE place <= {cap})"""


_QS = "SELECT DISTINCT query_id FROM ev"

SQL = {
    "search_fts_topk": _fts_sql(),
    "search_dense_topk": f"WITH {_DENSE} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM v",
    "search_sparse_topk": f"""WITH one AS (SELECT DISTINCT chunk_id, model, sparse FROM embed_cache WHERE sparse IS NOT NULL AND model IS NOT NULL),
e AS (SELECT chunk_id, model, unnest(map_keys(sparse)) AS t, unnest(map_values(sparse)) AS w FROM one),
scored AS (SELECT a.model, a.chunk_id AS query_id, b.chunk_id, sum(a.w::DOUBLE * b.w::DOUBLE) AS score FROM e a JOIN e b ON a.t = b.t AND a.model = b.model
  WHERE CAST('0x' || right(a.chunk_id, 4) AS INT) % {STEP} = 0 GROUP BY ALL)
SELECT model, query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM scored) WHERE rank <= 20""",
    "search_hybrid_rrf": _fused(
        f"SELECT x.query_id, x.doc_id, 1.0::DOUBLE / (coalesce({_constant('q.text')}, 20) + x.rank) AS s FROM (SELECT query_id, doc_id, rank FROM v UNION ALL SELECT query_id, doc_id, rank FROM f) x LEFT JOIN q ON q.query_id = x.query_id"
    ).replace(f"coalesce({_constant('q.text')}, 20)", f"(CASE WHEN q.text IS NULL THEN 20 ELSE {_constant('q.text')} END)"),
    "search_semantic_rrf": _fused("SELECT query_id, doc_id, 1.0::DOUBLE / (10 + rank) AS s FROM v UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (10 + rank) FROM f"),
    "search_weighted": _fused(
        """SELECT query_id, doc_id, 1.0::DOUBLE * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS s FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM v)
UNION ALL SELECT query_id, doc_id, 0.6::DOUBLE * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM f)"""
    ),
    "adaptive_rank_constant": f"""SELECT doc_id, CAST({_constant()} AS INT) AS constant FROM (
 SELECT doc_id, title AS q FROM documents WHERE title IS NOT NULL UNION ALL SELECT item_id, text FROM eval_items)""",
    "retrieve_filtered_eq": _fts_sql("lang = 'pt'"),
    "retrieve_filtered_in": _fts_sql("doc_type IN ('manual', 'ata')"),
    "retrieve_filtered_like": _fts_sql("source LIKE 'acervo/%47'"),
    "retrieve_filtered_range": _fts_sql("n_chars >= 500 AND n_chars < 1000"),
    "retrieve_filtered_raw": _fts_sql("doc_type IS NOT NULL AND lang IS DISTINCT FROM 'pt'"),
    "retrieve_filtered_or": _fts_sql("n_chars < 600 OR n_chars >= 1500 OR lang <> 'pt'"),
    "retrieve_diversified": f"WITH {_hits()}, {_post('r')} SELECT query_id, chunk_id, CAST(place AS INT) AS place, round(score, 6) AS score FROM r",
    "retrieve_tags_postfilter": f"WITH {_hits()}, {_post('r', tags=chr(39) + 'interno' + chr(39) + ', ' + chr(39) + 'norma' + chr(39), threshold=0.02)} SELECT query_id, chunk_id, CAST(place AS INT) AS place FROM r",
    "retrieve_confidence": f"""WITH {_hits()}, {_post('r', tags="'norma'", threshold=0.03)}, qs AS ({_QS})
SELECT qs.query_id, round(coalesce(max(score), 0), 6) AS confidence, count(score) AS hits FROM qs LEFT JOIN r ON r.query_id = qs.query_id GROUP BY qs.query_id""",
    "retrieve_batch_merge": f"""WITH {_hits()}, {_post('r')}, m AS (SELECT chunk_id, max(score) AS score, count(DISTINCT query_id) AS queries FROM r GROUP BY chunk_id)
SELECT chunk_id, round(score, 6) AS score, queries FROM m ORDER BY round(m.score, 6) DESC, chunk_id LIMIT 8""",
    "score_threshold": f"WITH {_hits()} SELECT query_id, chunk_id, round(score, 6) AS score FROM h WHERE score >= 0.5",
    "conflict_flag": f"""WITH {_hits()}, {_post('r')},
two AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n2 FROM r)
SELECT query_id, count(*) = 2 AND count(DISTINCT doc_id) = 2 AND max(score) - min(score) <= 0.15::DOUBLE AS conflict FROM two WHERE n2 <= 2 GROUP BY query_id""",
    "reliability_retry": f"""WITH {_hits()}, h4 AS (SELECT * FROM h WHERE rank <= 4), {_post('a', 'h4', "'norma'", 0.02)},
qs AS ({_QS}), weak AS (SELECT qs.query_id FROM qs LEFT JOIN a ON a.query_id = qs.query_id GROUP BY qs.query_id HAVING count(a.score) = 0 OR max(a.score) < 0.02),
h8 AS (SELECT * FROM h WHERE rank <= 8 AND query_id IN (SELECT query_id FROM weak)), {_post('b', 'h8', "'norma'", 0.02)}
SELECT query_id, chunk_id, CAST(place AS INT) AS place, 0 AS attempt FROM a WHERE query_id NOT IN (SELECT query_id FROM weak)
UNION ALL SELECT query_id, chunk_id, CAST(place AS INT), 1 FROM b""",
    "retrieve_text": f"""WITH {_hits()}, {_post('r')}
SELECT query_id, CAST(place AS INT) AS place, printf('[%d] %s  (score=%.3f)', place, array_to_string(list_filter([source_path, h1, h2], lambda x: x IS NOT NULL AND x <> ''), ' > '), floor(score * 1000 + 0.5::DOUBLE) / 1000)
 || chr(10) || '    ' || left(coalesce(snippet, ''), 60) || CASE WHEN length(coalesce(snippet, '')) > 60 THEN '...' ELSE '' END AS line FROM r""",
    "retrieve_json": f"WITH {_hits()}, {_post('r')} SELECT query_id, CAST(count(*) AS INT) AS n, string_agg(chunk_id, ',' ORDER BY place) AS chunks FROM r GROUP BY query_id",
    "tags_overlap": "SELECT DISTINCT doc_id FROM documents_md WHERE list_has_any(tags, ['bomba', 'legado'])",
    "rank_within_document": f"WITH {_hits()} SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS INT) AS place FROM h",
    "evidence_projection": f"""SELECT DISTINCT query_id * 10 + list_position({list(MODES)}, lower(trim(mode))) AS query_id, coalesce(chunk_id, '') AS chunk_id, coalesce(doc_id, '') AS doc_id, round(coalesce(score, 0), 6) AS score,
 coalesce(chunk_index, 0) AS chunk_index, CAST(length(coalesce(snippet, '')) AS INT) AS signs, CAST(len(coalesce(tags, [])) AS INT) AS n_tags, h1, title FROM evidence""",
    "sparse_codec": """SELECT DISTINCT chunk_id, model, CAST(4 + 8 * len(map_keys(sparse)) AS INT) AS bytes, CAST(len(map_keys(sparse)) AS INT) AS n, round(list_sum(list_transform(map_values(sparse), lambda x: x::DOUBLE)), 4) AS total, list_max(map_keys(sparse)) AS last
FROM embed_cache WHERE chunk_id IS NOT NULL AND model IS NOT NULL AND len(map_keys(sparse)) > 0""",
}
