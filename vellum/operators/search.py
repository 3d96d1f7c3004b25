"""Search R1-R13: scoring by dense vectors, words and sparse vectors, fusion, post-filters.

Questions are a DataFrame and a batch of them is one plan. Sparse scores come from an equi-join on
terms, so only matching rows meet. For words the texts are packed into blocks of asked words that every
task reads past the questions of its own, so what is stored follows the texts and the result, not the
pairs; a pair costs a few additions. Dense scores are exact: the questions, a stated query set, go to
every block of vectors in slices of bounded size and NumPy multiplies block by block; each block keeps
its own top k before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellum.functions.text import words
from vellum.operators.filters import tag_overlap
from vellum.runtime import cut, ship

K1, B = 1.2, 0.75
#: Questions per slice that is sent to the vectors.
SLICE = 4_096
#: Full-text search: questions whose words are held at a time, questions of a task, texts of a block,
#: and weights of words in texts held at a time.
QUESTIONS, ASKS, TEXTS, CELLS = 65_536, 1_024, 16_384, 1 << 22
#: Query forms of the adaptive constant (fixed values).
CONCEPT = r"o que (é|e|eh|significa)|what is|defina|conceito|qual o significado"
NAMES = r"[A-Z]{2,}|[A-Z][a-z]+\s[A-Z]"


def terms(c: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(term, key, tf)``."""
    return docs.select(F.col(key), F.explode(terms(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def rank(scored: DataFrame, k: int, query: str = "query_id", key: str = "id", score: str = "score") -> DataFrame:
    """L1: places 1..k per query by rounded score, ties by key; pruned inside each task first."""
    w = W.partitionBy(query).orderBy(F.desc(F.round(score, 6)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_fts(docs: DataFrame, questions: DataFrame, key: str, text: str, k: int = 20, predicate: Column | None = None) -> DataFrame:
    """R2: BM25 over ``docs``; ``(query_id, id, score, rank)``.

    Any shared word makes a candidate. Statistics cover the whole collection, ``predicate`` limits
    the candidates. Questions: ``(query_id, text)``; those without words give no rows. Rows of one key
    are one text with a length each, of which every one counts; a null key is no candidate.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = cut(questions.select("query_id", F.explode(terms(F.col("text"))).alias("term")).distinct())
    n = asked.select("query_id").distinct().count()
    out = spark.createDataFrame([], f"query_id {dict(questions.dtypes)['query_id']}, id {dict(docs.dtypes)[key]}, score double")
    for part in range(-(-n // QUESTIONS)):
        own = asked if n <= QUESTIONS else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // QUESTIONS))) == part)
        out = out.unionByName(_fts_slice(docs, own, min(n, QUESTIONS), key, text, k, predicate))
    return rank(out, k)


def _fts_slice(docs: DataFrame, asked: DataFrame, n: int, key: str, text: str, k: int, predicate: Column | None) -> DataFrame:
    """``(query_id, id, score)``: the first ``k`` of about ``n`` questions ``(query_id, term)``.

    A pair of question and text is never a row: the asked words of the texts are packed into blocks,
    stored once, and every task reads them past the questions of its own."""
    sc = docs.sparkSession.sparkContext
    id_kind, q_kind = dict(docs.dtypes)[key], dict(asked.dtypes)["query_id"]
    vocabulary = sorted(r.term for r in asked.select("term").distinct().collect())
    held, size = sc.broadcast(vocabulary), len(vocabulary)
    kind = np.uint16 if size <= 1 << 16 else np.uint32
    ok = F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))

    def ids(lists: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words in the vocabulary, and of each list the words so found and all."""
        every = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
        at = pc.index_in(lists.flatten(), value_set=vocabulary)
        row = np.repeat(np.arange(len(every)), every)[at.is_valid().to_numpy(zero_copy_only=False)]
        return at.drop_null().to_numpy().astype(kind), np.bincount(row, minlength=len(every)), every

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(held.value, pa.string())
        for b in batches:
            w, found, every = ids(b["ts"], words)
            edges = np.concatenate([[0], np.cumsum(found * w.itemsize)]).astype(np.int32)
            w = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(edges), pa.py_buffer(w.tobytes())])
            yield pa.RecordBatch.from_arrays([b["id"], b["ok"], pa.array(every), w], ["id", "ok", "dl", "w"])

    def block(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        dl, w = t["dl"].combine_chunks(), t["w"].combine_chunks()
        rows = pc.list_value_length(w).to_numpy(zero_copy_only=False)
        w = w.flatten()
        tokens = np.frombuffer(b"".join(w.to_pylist()), kind).astype(np.int64)
        doc = np.repeat(np.repeat(np.arange(len(t)), rows), pc.binary_length(w).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize)
        code, tf = np.unique(doc * size + tokens, return_counts=True)
        doc, term = np.divmod(code, size)
        seen, df = np.unique(term, return_counts=True)
        may = pc.and_(t["ok"], pc.is_valid(t["id"])).combine_chunks()
        m = may.to_numpy(zero_copy_only=False)
        keep = m[doc]
        doc, term, tf = doc[keep], term[keep], tf[keep]
        # Once for every row of the key, with that row's length.
        reps = rows[doc]
        nth = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        length = dl.flatten().to_numpy()
        length = length[np.repeat((np.cumsum(rows) - rows)[doc], reps) + nth]
        x = np.stack([np.repeat(v, reps) for v in ((np.cumsum(m) - 1)[doc], term, tf)] + [length]).astype(np.uint32)
        stats = pa.StructArray.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df.astype(np.int64))], ["t", "n"])
        own = t["id"].combine_chunks().filter(may)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (own, stats)]
        total = int(pc.sum(dl.flatten()).as_py() or 0)
        return pa.RecordBatch.from_arrays([pa.array([int(rows.sum())]), pa.array([total]), lists[1], lists[0], pa.array([x.shape[1]]), pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["n", "total", "df", "ids", "entries", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            while len(rest) >= TEXTS:
                yield block(rest.slice(0, TEXTS))
                rest = rest.slice(TEXTS)
        if rest is not None and len(rest):
            yield block(rest)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got).combine_chunks()
            w, found, _ = ids(t["ts"].combine_chunks(), pa.array(held.value, pa.string()))
            q = t["query_id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(q)], pa.int32()), q), pa.array([found.astype(np.int32).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], ["queries", "counts", "terms"])

    seen = docs.select(F.col(key).alias("id"), ok.alias("ok"), terms(F.col(text)).alias("ts")).mapInArrow(read, f"id {id_kind}, ok boolean, dl int, w binary")
    seen = seen.groupBy("id").agg(F.max("ok").alias("ok"), F.collect_list("dl").alias("dl"), F.collect_list("w").alias("w"))
    blocks = cut(seen.mapInArrow(pack, f"n bigint, total bigint, df array<struct<t:int,n:bigint>>, ids array<{id_kind}>, entries bigint, x binary"))
    tasks = max(sc.defaultParallelism, -(-n // ASKS))
    asks = cut(asked.groupBy("query_id").agg(F.collect_list("term").alias("ts")).repartition(tasks).mapInArrow(ask, f"queries array<{q_kind}>, counts binary, terms binary"))
    all_of = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    df = np.zeros(size)
    for r in blocks.select(F.explode("df").alias("x")).groupBy("x.t").agg(F.sum("x.n").alias("n")).collect():
        df[r.t] = r.n
    mean = all_of.total / max(all_of.n, 1)
    idf = sc.broadcast(np.log(1 + (all_of.n - df + 0.5) / (df + 0.5)))
    pairs = blocks.select("ids", "entries", "x").coalesce(1).crossJoin(asks.withColumn("task", F.spark_partition_id()).hint("shuffle_replicate_nl"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, _Best] = {}
        for b in batches:
            for i in range(b.num_rows):
                task = b["task"][i].as_py()
                if task not in states:
                    states[task] = _Best(b["queries"][i].values, np.frombuffer(b["counts"][i].as_py(), np.int32), np.frombuffer(b["terms"][i].as_py(), kind), size, k)
                x = pa.decompress(b["x"][i].as_py(), decompressed_size=16 * b["entries"][i].as_py(), codec="zstd", asbytes=True)
                states[task].meet(b["ids"][i].values, np.frombuffer(x, np.uint32).reshape(4, -1).astype(np.int64), idf.value, mean)
        for s in states.values():
            yield from s.found()

    return cut(pairs.mapInArrow(meet, f"query_id {q_kind}, id {id_kind}, score double"))


class _Best:
    """The first ``k`` texts of each of some questions, of the blocks met so far."""

    def __init__(self, queries: pa.Array, counts: np.ndarray, terms: np.ndarray, size: int, k: int):
        self.queries, self.k, self.table = queries.take(pa.array(np.arange(len(queries)))), k, None  # a copy: the batch is let go
        own, local = np.unique(terms, return_inverse=True)
        self.rows = np.split(local, np.cumsum(counts)[:-1])
        self.own, self.place = len(own), np.full(size, -1)
        self.place[own] = np.arange(len(own))
        self.bound = np.full(len(counts), np.finfo(np.float64).tiny)  # any shared word gives more

    def meet(self, ids: pa.Array, x: np.ndarray, idf: np.ndarray, mean: float) -> None:
        col, term, tf, dl = x
        row = self.place[term]
        ours = row >= 0
        col, row = col[ours], row[ours]
        term, tf, dl = term[ours], tf[ours], dl[ours]
        part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (mean or 1)))
        wide = int(np.clip(CELLS // max(self.own, 1), 64, 4_096))
        out = []
        for at in range(0, len(ids), wide):
            a, b = np.searchsorted(col, [at, at + wide])
            n = min(wide, len(ids) - at)
            if a == b:
                continue
            w = np.bincount(row[a:b] * n + col[a:b] - at, part[a:b], self.own * n).reshape(self.own, n)
            s = np.empty(n)
            for q, rows in enumerate(self.rows):
                if len(rows) == 1:
                    np.copyto(s, w[rows[0]])
                else:
                    np.add(w[rows[0]], w[rows[1]], out=s)
                    for r in rows[2:]:
                        s += w[r]
                c = np.flatnonzero(s >= self.bound[q])
                if len(c) > 2 * self.k:
                    v = s[c]
                    edge = np.partition(v, -self.k)[-self.k] - 1.1e-6  # what may round to as much
                    c = c[v >= edge]
                    self.bound[q] = max(self.bound[q], edge)
                if len(c):
                    out.append((np.full(len(c), q), at + c, s[c]))
        if out:
            q, c, score = (np.concatenate(v) for v in zip(*out))
            new = pa.table({"q": q, "score": score, "shown": np.floor(score * 1e6 + 0.5), "id": ids.take(pa.array(c))})
            t = new if self.table is None else pa.concat_tables([self.table, new])
            t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("shown", "descending"), ("id", "ascending")])).combine_chunks()
            q = t["q"].to_numpy()
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            last = nth == self.k - 1
            self.bound[q[last]] = np.maximum(self.bound[q[last]], t["shown"].to_numpy()[last] / 1e6 - 0.6e-6)
            self.table = t.filter(pa.array(nth < self.k))

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.table is not None:
            t = self.table
            yield from pa.table({"query_id": self.queries.take(t["q"].combine_chunks()), "id": t["id"], "score": t["score"]}).to_batches()


def search_dense(vectors: DataFrame, questions: DataFrame, key: str, vector: str, k: int = 20, predicate: Column | None = None) -> DataFrame:
    """Exact cosine; ``(query_id, id, score, rank)`` from questions ``(query_id, v)``.

    Null and zero vectors, and lengths other than the question's, score nothing.
    """
    spark = vectors.sparkSession
    pool = vectors if predicate is None else vectors.where(predicate)
    kinds = dict(vectors.dtypes)[key], dict(questions.dtypes)["query_id"]
    asked = questions.where(F.col("v").isNotNull()).select("query_id", "v")
    n = asked.count()
    out = None
    for part in range(max(1, -(-n // SLICE))):
        rows = asked if n <= SLICE else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // SLICE))) == part)
        got = [(r.query_id, np.asarray(r.v, np.float64)) for r in rows.collect()]
        held = spark.sparkContext.broadcast(got)

        def score(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            by_dim: dict[int, tuple[list, np.ndarray]] = {}
            for d in {len(v) for _, v in held.value}:
                own = [(q, v) for q, v in held.value if len(v) == d and np.linalg.norm(v) > 0]
                if own:
                    m = np.stack([v for _, v in own])
                    by_dim[d] = [q for q, _ in own], m / np.linalg.norm(m, axis=1, keepdims=True)
            for pdf in batches:
                for d, (qs, m) in by_dim.items():
                    ok = pdf["v"].map(lambda v, d=d: v is not None and len(v) == d)
                    part = pdf[ok]
                    if part.empty:
                        continue
                    x = np.stack(part["v"]).astype(np.float64)
                    size = np.linalg.norm(x, axis=1)
                    good = np.isfinite(size) & (size > 0)
                    ids, x = part["id"].to_numpy()[good], x[good] / size[good, None]
                    if not len(ids):
                        continue
                    s = m @ x.T
                    top = min(2 * k, len(ids))
                    cand = np.argpartition(-s, top - 1, axis=1)[:, :top]
                    val = np.take_along_axis(s, cand, 1)
                    # Keep all ties of the k-th place inside the block.
                    edge = np.sort(-np.round(val, 6), axis=1)[:, min(k, top) - 1 : min(k, top)]
                    full = -np.round(s, 6) <= edge
                    r, c = np.nonzero(full)
                    yield pd.DataFrame({"query_id": np.asarray(qs, dtype=object)[r], "id": ids[c], "score": s[r, c]})

        found = pool.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInPandas(score, f"query_id {kinds[1]}, id {kinds[0]}, score double")
        out = found if out is None else out.unionByName(found)
    return rank(out, k)


def search_sparse(vectors: DataFrame, questions: DataFrame, key: str, vector: str, k: int = 20) -> DataFrame:
    """Inner product over shared ids; questions ``(query_id, v MAP)``."""
    post = vectors.select(F.col(key).alias("id"), F.explode(vector).alias("term", "w"))
    asked = questions.select("query_id", F.explode("v").alias("term", "qw"))
    s = post.join(asked, "term").groupBy("query_id", "id").agg(F.sum(F.col("w").cast("double") * F.col("qw").cast("double")).alias("score"))
    return rank(s, k)


def fuse_rrf(lists: list[DataFrame], constant: Column | int, k: int = 20) -> DataFrame:
    """Reciprocal ranks summed over lists of ``(query_id, id, rank)``; ``constant`` may be a
    column of the lists."""
    c = F.lit(constant) if isinstance(constant, int) else constant
    parts = [x.select("query_id", "id", (F.lit(1.0) / (c + F.col("rank"))).alias("s")) for x in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return rank(both.groupBy("query_id", "id").agg(F.sum("s").alias("score")), k)


def fuse_weighted(lists: list[DataFrame], weights: list[float], k: int = 20) -> DataFrame:
    """Weighted sum of scores, each list scaled to 0..1 per query (a flat list counts as 1)."""
    both = None
    for x, w in zip(lists, weights):
        span = x.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        unit = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
        p = x.join(span, "query_id").select("query_id", "id", (unit * w).alias("s"))
        both = p if both is None else both.unionByName(p)
    return rank(both.groupBy("query_id", "id").agg(F.sum("s").alias("score")), k)


def rank_constant(q: Column) -> Column:
    """Constant of the reciprocal ranks by the form of the question."""
    digits, name = q.rlike(r"\d"), q.rlike(NAMES)
    n = F.size(words(q))
    return F.when(digits & name, 5).when(digits | name, 10).when(F.lower(q).rlike(CONCEPT), 60).when(n <= 3, 10).when(n > 10, 40).otherwise(20)


# --- after the search ------------------------------------------------------------------------


def diversify(hits: DataFrame, per_doc: int | None, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """The first ``per_doc`` hits of each document in rank order; 0 or None: all."""
    if not per_doc:
        return hits
    w = W.partitionBy(query, doc).orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_doc).drop("_n")


def post_filter(hits: DataFrame, tags: list[str] | None = None, threshold: float = 0.0, per_doc: int | None = 3, cap: int | None = 8, query: str = "query_id") -> DataFrame:
    """Tags, threshold, documents, context cap, in this order; ``place`` counts what is left."""
    out = hits.where(tag_overlap(F.col("tags"), tags or [])) if tags else hits
    out = diversify(out.where(F.col("score") >= threshold), per_doc, query)
    out = out.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy("rank")))
    return out.where(F.col("place") <= cap) if cap else out


def confidence(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Best score per question, 0 without hits, and the number of hits."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("c"), F.count("*").alias("n"))
    return questions.select("query_id").distinct().join(best, "query_id", "left").select("query_id", F.coalesce("c", F.lit(0.0)).alias("confidence"), F.coalesce("n", F.lit(0)).alias("hits"))


def merge_queries(hits: DataFrame, k: int = 8) -> DataFrame:
    """One list from many questions: best score per chunk."""
    best = hits.groupBy("chunk_id").agg(F.max("score").alias("score"), F.count_distinct("query_id").alias("queries"))
    return best.orderBy(F.desc(F.round("score", 6)), "chunk_id").limit(k)


def has_conflict(hits: DataFrame, gap: float = 0.15) -> DataFrame:
    """the two best hits come from different documents with nearly equal scores."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    two = hits.withColumn("n", F.row_number().over(w)).where("n <= 2")
    agg = two.groupBy("query_id").agg(F.count("*").alias("k"), F.count_distinct("doc_id").alias("docs"), (F.max("score") - F.min("score")).alias("gap"))
    return agg.select("query_id", ((F.col("k") == 2) & (F.col("docs") == 2) & (F.col("gap") <= gap)).alias("conflict"))


def evidence(hits: DataFrame) -> DataFrame:
    """hits as evidence rows: null names and snippets empty, null numbers zero, null tags none;
    headings and title stay null."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return hits.select(
        "query_id", *[text(c) for c in ("chunk_id", "doc_id", "source_path", "file_name")], F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce(F.col("chunk_index").cast("int"), F.lit(0)).alias("chunk_index"), text("snippet"), "h1", "h2", "h3", "title", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
