"""Ingest: files or documents to the chunk index (section 3.1 of the survey)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.functions.vectors import hash_embed, hash_embed_sparse
from vellum.operators.chunking import ChunkSettings, chunk_documents, parents_h123
from vellum.operators.store import Snapshots, cache_misses, ingest_report, join_documents, manifest_diff, reassemble
from vellum.runtime import cut

#: Columns of the index, in order.
INDEX = (
    "doc_id chunk_id source_path file_name title h1 h2 h3 chunk_index token_count language file_hash doc_type tags is_appendix "
    "ingested_at content dense_embedding sparse_embedding"
).split()
MANIFEST = "doc_id string, source_path string, file_name string, file_hash string, ingested_at bigint, language string, doc_type string, tags array<string>"
CACHE = "chunk_id string, model string, dense array<float>"


@dataclass
class Embedder:
    """A model id and the columns that embed a text; replace the columns for another model."""

    model: str = "hash:64"
    dense: Callable[[Column], Column] = field(default=hash_embed)
    sparse: Callable[[Column], Column] = field(default=hash_embed_sparse)


def index_rows(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, sparse: Callable[[Column], Column]) -> DataFrame:
    """Chunks joined with their documents and vectors, in the index schema."""
    c = join_documents(chunks, docs.drop("body")).join(vectors.select("chunk_id", F.col("dense").alias("dense_embedding")), "chunk_id", "left")
    h1, h2, h3 = parents_h123(F.col("parents"))
    c = c.withColumns({"h1": h1, "h2": h2, "h3": h3, "content": F.col("chunk_text")}).withColumn("sparse_embedding", sparse(F.col("content")))
    return c.select(*INDEX)


class Ingest:
    """Incremental ingest into ``home``: ``index``, ``manifest`` and ``cache`` snapshots.

    ``stale="keep"`` leaves chunks of earlier versions of a changed document searchable, as the
    documented behaviour does; ``"drop"`` removes them."""

    def __init__(self, spark: SparkSession, home: str, settings: ChunkSettings = ChunkSettings(), embedder: Embedder | None = None, stale: str = "keep"):
        if stale not in ("keep", "drop"):
            raise ValueError("stale must be keep or drop")
        self.spark, self.settings, self.embedder, self.stale = spark, settings, embedder or Embedder(), stale
        self.index, self.manifest, self.cache = (Snapshots(spark, f"{home}/{n}", k) for n, k in (("index", "chunk_id"), ("manifest", "doc_id"), ("cache", ["chunk_id", "model"])))

    def run(self, documents: DataFrame) -> DataFrame:
        """One run over ``documents_md`` rows; returns the report."""
        known = self.manifest.read(MANIFEST)
        diff = cut(manifest_diff(known, documents))
        todo = documents.join(diff.where("status in ('new', 'changed')").select("doc_id"), "doc_id", "left_semi")
        chunks = cut(chunk_documents(todo, settings=self.settings))
        cached = self.cache.read(CACHE)
        wanted = chunks.select("chunk_id", F.lit(self.embedder.model).alias("model")).distinct()
        miss = cache_misses(wanted, cached).join(chunks.groupBy("chunk_id").agg(F.min("chunk_text").alias("t")), "chunk_id")
        fresh = cut(miss.select("chunk_id", "model", self.embedder.dense(F.col("t")).alias("dense")))
        vectors = reassemble(wanted, cached, fresh)
        report = cut(ingest_report(diff, chunks, vectors.select(F.col("cached").alias("hit"))))
        rows = index_rows(todo, chunks, vectors, self.embedder.sparse)
        gone = diff.where("status = 'removed'").select("doc_id")
        old = gone.unionByName(todo.select("doc_id")).distinct() if self.stale == "drop" else gone
        lost = self.index.read().join(old, "doc_id", "left_semi").select("chunk_id") if self.index.version() else None
        self.index.upsert(rows, gone=lost)
        self.cache.upsert(fresh.select("chunk_id", "model", "dense"), order=None)
        # A document without chunks stays unknown, so the next run sees it as new again. The manifest is
        # written last: a run that fails before it is repeated whole, and its upserts change nothing.
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        entries = todo.join(chunks.select("doc_id").distinct(), "doc_id", "left_semi").select(*names).dropDuplicates(["doc_id"])
        unknown = gone.unionByName(todo.select("doc_id"))
        self.manifest.upsert(entries, order=None, gone=unknown)
        return report

    def reindex(self, documents: DataFrame, purge: bool = False) -> DataFrame:
        """Forget the manifest (and, with ``purge``, the index) and ingest everything again."""
        if purge and self.index.version():
            self.index.purge()
        if self.manifest.version():
            self.manifest.purge()
        return self.run(documents)
