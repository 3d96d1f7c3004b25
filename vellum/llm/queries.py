"""Queries of the training-text problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.llm import bpe, knn, language, leakage, markup, ocr_repair, rank_fusion, repetition, text_stats
from vellum.runtime import cut, ship, spread, table

MODES = ("dense", "fts", "sparse", "hybrid")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "engine_pages").select("doc", F.col("page_num").cast("int").alias("page_num"), "ocr_text"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents_md").select("doc_id", "body", "source_path").distinct())


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang"))


def _texts(spark: SparkSession, d: str, prose_only: bool) -> DataFrame:
    """Scanned texts of problem 1: bodies (page 0) and recognised pages."""
    ship(spark)
    pages = _pages(spark, d)
    if prose_only:
        prose = text_stats.text_stats(pages, ["doc", "page_num"], "ocr_text").where("is_prose").select("doc", "page_num").distinct()
        pages = pages.join(prose, ["doc", "page_num"], "left_semi")
    a = pages.select(F.lit("engine_pages").alias("record"), "doc", "page_num", F.col("ocr_text").alias("text"))
    b = _bodies(spark, d).select(F.lit("documents_md").alias("record"), F.col("doc_id").alias("doc"), F.lit(0).alias("page_num"), F.col("body").alias("text"))
    return a.unionByName(b)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr_repair.find_damage(_texts(spark, d, True)).select("record", "doc", "page_num", "kind")


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return ocr_repair.repaired(_texts(spark, d, False))


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    """Repaired texts with the pages of a document assembled in order."""
    return ocr_repair.assembled(p1_repaired(spark, d))


def p2_stats(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return text_stats.text_stats(_pages(spark, d), ["doc", "page_num"], "ocr_text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_stats(spark, d).where("not is_prose").select("doc", "page_num").distinct()


def _marked(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    a = _bodies(spark, d).select(F.lit("documents_md").alias("record"), F.col("doc_id").alias("record_id"), F.col("body").alias("text"))
    b = spread(table(spark, d, "chunks").select(F.lit("chunks").alias("record"), F.col("chunk_id").alias("record_id"), F.col("chunk_text").alias("text")))
    return a.unionByName(b)


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text per distinct record and text."""
    out = markup.clean_markup(_marked(spark, d), ["record", "record_id"], "text")
    return out.select("record", "record_id", "clean", F.array_join("markup", ",").alias("markup")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = markup.clean_markup(_marked(spark, d), ["record", "record_id"], "text")
    return out.select("record", "record_id", F.explode("markup").alias("markup")).distinct()


def _fused(spark: SparkSession, d: str) -> DataFrame:
    s = rank_fusion.latest_scores(table(spark, d, "evidence"), "query_id", "mode", "chunk_id", "score", "retrieved_at")
    return rank_fusion.fuse(s, MODES)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.top(_fused(spark, d), 3).select(F.col("g").alias("query_id"), F.col("i").alias("chunk_id"))


def p4_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Median and mean rank of every chunk of every query."""
    return _fused(spark, d).select(F.col("g").alias("query_id"), F.col("i").alias("chunk_id"), "median_rank", F.round("mean_rank", 6).alias("mean_rank"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    r = knn.similar_vectors(table(spark, d, "embed_cache").select("chunk_id", "model", "dense"), "chunk_id", "model", "dense")
    return r.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b"), "model").distinct()


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest of every vector, however far."""
    ship(spark)
    r = knn.similar_vectors(table(spark, d, "embed_cache").select("chunk_id", "model", "dense"), "chunk_id", "model", "dense", least=-2.0)
    return r.select(F.col("id").alias("chunk_id"), "model", "neighbour", F.round("cosine", 6).alias("cosine"), "place")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    model = language.fit(table(spark, d, "documents"), "doc_id", "text", "lang")
    return language.segments(_bodies(spark, d), model, "doc_id", "body", "source_path")


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    return s.select("doc_id", "seq", "char_start", "char_end", "language", F.round("confidence", 6).alias("confidence"), "words")


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    s = language.document_language(_segments(spark, d), "doc_id")
    return s.select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "languages")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    passages = cut(language.whole_passages(_segments(spark, d), "doc_id"))  # used twice
    parts = [language.wrong_labels(passages, table(spark, d, t).select("doc_id", "language"), "doc_id", "language").select(F.lit(t).alias("record"), "doc_id", "language") for t in ("documents_md", "manifest")]
    return parts[0].unionByName(parts[1]).distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return bpe.encode_texts(_documents(spark, d), "doc_id", "text")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return bpe.round_trip(_documents(spark, d), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return leakage.find_leaks(_documents(spark, d), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text").select("doc_id", "item_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    r = repetition.repeated_share(_documents(spark, d), "doc_id", "text")
    return r.select("doc_id", "n_words", F.round("repeated_share", 6).alias("repeated_share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return repetition.repeated_share(_documents(spark, d), "doc_id", "text").where("repeated_share >= 0.25").select("doc_id").distinct()


def p10_perplexity(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    r = repetition.perplexity(_documents(spark, d), "doc_id", "text", "lang")
    return r.select("doc_id", "language", "n_words", F.round("perplexity", 4).alias("perplexity"), "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_repaired, p1_documents, p2_found, p2_stats, p3_found, p3_clean, p4_found, p4_ranks, p6_found, p6_nearest, p7_found, p7_segments, p7_documents, p8_ids, p8_round_trip, p9_found, p10_found, p10_shares, p10_perplexity)
}
