"""Questions to evidence and answers (sections 3.2 and 3.3 of the survey)."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from vellum.functions.vectors import hash_vector
from vellum.operators import generation as G, search as S
from vellum.operators.filters import Filters

MODES = ("dense", "fts", "sparse", "semantic", "hybrid")


@dataclass(frozen=True)
class RetrievalSettings:
    """Defaults as documented."""

    mode: str = "hybrid"
    top_k: int = 20
    threshold: float = 0.0
    cap: int = 8
    per_doc: int = 3
    low_confidence: float = 0.02
    expand: int = 2

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")


class QueryCache:
    """Least recently used question vectors, on the driver."""

    def __init__(self, dim: int = 64, size: int = 128):
        self.dim, self.size, self.hits, self.misses = dim, size, 0, 0
        self.kept: OrderedDict[str, list[float]] = OrderedDict()

    def vector(self, text: str) -> list[float]:
        if text in self.kept:
            self.hits += 1
            self.kept.move_to_end(text)
            return self.kept[text]
        self.misses += 1
        v = self.kept[text] = hash_vector(text, self.dim)
        if len(self.kept) > self.size:
            self.kept.popitem(last=False)
        return v

    def stats(self) -> dict:
        n = self.hits + self.misses
        return {"size": len(self.kept), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / n if n else 0.0}

    def clear(self) -> None:
        self.kept.clear()
        self.hits = self.misses = 0


def _candidates(index: DataFrame, questions: DataFrame, s: RetrievalSettings, filters: Filters) -> DataFrame:
    """Scored candidates of one mode; questions ``(query_id, text, v, sv)``."""
    p = filters.build()
    fts = lambda: S.search_fts(index, questions, "chunk_id", "content", s.top_k, p)
    dense = lambda: S.search_dense(index, questions.select("query_id", "v"), "chunk_id", "dense_embedding", s.top_k, p)
    pool = filters.apply(index)
    sparse = lambda: S.search_sparse(pool, questions.select("query_id", F.col("sv").alias("v")), "chunk_id", "sparse_embedding", s.top_k)
    has_sparse = "sparse_embedding" in index.columns and "sv" in questions.columns
    if s.mode == "dense":
        return dense()
    if s.mode == "fts" or s.mode == "sparse" and not has_sparse:
        return fts()
    if s.mode == "sparse":
        return sparse()
    constants = questions.select("query_id", (S.rank_constant(F.col("text")) if s.mode == "hybrid" else F.lit(10)).alias("rc"))
    second = sparse() if s.mode == "semantic" and has_sparse else fts()
    lists = [x.join(constants, "query_id") for x in (dense(), second)]
    return S.fuse_rrf(lists, F.col("rc"), s.top_k)


def retrieve(index: DataFrame, questions: DataFrame, settings: RetrievalSettings = RetrievalSettings(), filters: Filters = Filters()) -> DataFrame:
    """Evidence rows of all questions in one plan, with ``place``."""
    found = _candidates(index, questions, settings, filters).withColumnRenamed("id", "chunk_id")
    cols = ["chunk_id", "doc_id", "source_path", "file_name", "chunk_index", F.col("content").alias("snippet"), "h1", "h2", "h3", "title", "tags"]
    hits = found.join(index.select(*cols), "chunk_id")
    return S.post_filter(hits, list(filters.tags), settings.threshold, settings.per_doc, settings.cap)


def retrieve_reliably(index: DataFrame, questions: DataFrame, settings: RetrievalSettings = RetrievalSettings(), filters: Filters = Filters()) -> DataFrame:
    """Second attempt, deeper and never dense only, for the questions whose first attempt found
    nothing or little; one more plan for all of them together."""
    first = retrieve(index, questions, settings, filters)
    conf = S.confidence(first, questions)
    weak = conf.where((F.col("hits") == 0) | (F.col("confidence") < settings.low_confidence)).select("query_id")
    deeper = replace(settings, top_k=settings.top_k * settings.expand, mode="hybrid" if settings.mode == "dense" else settings.mode)
    again = retrieve(index, questions.join(weak, "query_id", "left_semi"), deeper, filters)
    return first.join(weak, "query_id", "left_anti").unionByName(again)


class Retriever:
    """An index, its settings and the cache of question vectors: asks plain texts."""

    def __init__(self, index: DataFrame, settings: RetrievalSettings = RetrievalSettings(), cache: QueryCache | None = None):
        self.index, self.settings, self.cache = index, settings, cache or QueryCache()

    def questions(self, texts: list[str]) -> DataFrame:
        """``(query_id, text, v)``; numbers from 1 in order, vectors from the cache where it holds them."""
        rows = [(n, t, self.cache.vector(t or "")) for n, t in enumerate(texts, 1)]
        return self.index.sparkSession.createDataFrame(rows, "query_id int, text string, v array<double>")

    def retrieve(self, texts: list[str], filters: Filters = Filters(), mode: str | None = None) -> DataFrame:
        return S.evidence(self.hits(texts, filters, mode))

    def hits(self, texts: list[str], filters: Filters = Filters(), mode: str | None = None) -> DataFrame:
        return retrieve(self.index, self.questions(texts), replace(self.settings, mode=mode or self.settings.mode), filters)

    def answer(self, texts: list[str], model: G.LanguageModel | None = None, filters: Filters = Filters()) -> DataFrame:
        return answer(self.index, self.questions(texts), model, settings=self.settings, filters=filters)

    def cache_stats(self) -> dict:
        return self.cache.stats()

    def invalidate_cache(self) -> None:
        self.cache.clear()


def answer(index: DataFrame, questions: DataFrame, model: G.LanguageModel | None = None, mode: str = "answer", settings: RetrievalSettings = RetrievalSettings(), filters: Filters = Filters()) -> DataFrame:
    """``(query_id, text, mode, confidence, insufficient_context, conflict, sources)``."""
    hits = retrieve_reliably(index, questions, settings, filters)
    conf = S.confidence(hits, questions)
    clash = S.has_conflict(hits)
    texts = G.answer(G.build_prompts(questions, hits, mode), model or G.StubModel()).select("query_id", "text")
    out = texts.join(conf, "query_id").join(clash.withColumnRenamed("conflict", "clash"), "query_id", "left").join(G.sources_block(questions, hits), "query_id")
    gap, said = G.answer_flags(F.col("text"), F.col("hits"), F.col("confidence"))
    return out.select("query_id", "text", F.lit(mode).alias("mode"), "confidence", gap, (said | F.coalesce("clash", F.lit(False))).alias("conflict"), "sources")
