"""Persistent collections K1-K4, K8, R14-R16, manifest and cache joins J1-J5, A2, A3.

A collection is a folder of Parquet bases and deltas and a marker per version that names what belongs
to it; a write makes its marker last, and readers resolve one marker and never lock.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def upsert(stored: DataFrame, batch: DataFrame, key: str = "chunk_id", order: str = "chunk_index") -> DataFrame:
    """K1: batch rows replace stored rows of the same key; inside the batch the highest order wins."""
    best = W.partitionBy(key).orderBy(F.desc(order))
    fresh = batch.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true; unknown counts as not true."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def fetch(df: DataFrame, ids: list[str] | DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the given keys."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(list(ids)) if ids else F.lit(False))


def manifest_diff(known: DataFrame, now: DataFrame) -> DataFrame:
    """``(source_path, doc_id, status)``; removed files keep their id."""
    a = known.select("source_path", F.col("doc_id").alias("old_id"), F.col("file_hash").alias("old_hash"))
    b = now.select("source_path", F.col("doc_id").alias("new_id"), F.col("file_hash").alias("new_hash"))
    status = F.when(F.col("new_id").isNull(), "removed").when(F.col("old_id").isNull(), "new").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed").otherwise("unchanged")
    return a.join(b, "source_path", "full_outer").select("source_path", F.coalesce("new_id", "old_id").alias("doc_id"), status.alias("status"))


def join_documents(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with the fields of their documents; one row of ``docs`` per ``doc_id``."""
    return chunks.join(docs, "doc_id")


def cache_lookup(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted ``(chunk_id, model)`` with ``hit`` and the cached vector."""
    one = cache.groupBy("chunk_id", "model").agg(F.max("dense").alias("dense"), F.lit(True).alias("hit"))
    return wanted.join(one, ["chunk_id", "model"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """J3."""
    return wanted.join(cache.select("chunk_id", "model"), ["chunk_id", "model"], "left_anti")


def reassemble(wanted: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Every wanted key with its vector, from the cache or newly made."""
    hits = cache_lookup(wanted, cache).where("hit").select("chunk_id", "model", "dense", F.lit(True).alias("cached"))
    return hits.unionByName(fresh.select("chunk_id", "model", "dense", F.lit(False).alias("cached")))


def cache_stats(cache: DataFrame) -> DataFrame:
    """A3: distinct entries per model, and how many are usable."""
    one = cache.select("chunk_id", "model", F.coalesce(F.size("dense") > 0, F.lit(False)).alias("full"))
    return one.groupBy("model").agg(F.count_distinct("chunk_id").alias("entries"), F.count_if("full").alias("full_rows"))


def invalidate_model(cache: DataFrame, model: str | None = None) -> DataFrame:
    """A3: the cache without one model's entries, or empty."""
    return delete_where(cache, F.lit(True) if model is None else F.col("model") == model)


def ingest_report(diff: DataFrame, chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """A2: counters of one run in one row."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    d = diff.agg(F.count_if(F.col("status") != "removed").alias("scanned"), n("new"), n("changed"), n("removed"), n("unchanged"))
    c = chunks.agg(F.count_distinct("chunk_id").alias("chunks_upserted"))
    h = cached.agg(F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"))
    return d.crossJoin(c).crossJoin(h)  # one row each


def token_weights(tokens: DataFrame, special: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """Largest positive weight per text and token id, special ids left out."""
    ok = (F.col("weight") > 0) & ~F.col("token_id").isin(*special)
    return tokens.where(ok).groupBy("text_id", "token_id").agg(F.max("weight").alias("weight"))


#: Deltas a collection may carry before a write merges them into a new base.
MAX_DELTAS = 16
#: Attempts of a commit against other writers, and seconds of the first pause between two.
ATTEMPTS, PAUSE = 5, 0.5
#: Seconds after which a lock without its marker is taken for a dead writer's.
STALE = 60


class Conflict(RuntimeError):
    """Another writer committed first, ``ATTEMPTS`` times."""


class Snapshots:
    """K1-K3, K8: a collection on shared storage.

    A version is a marker file that names a base folder and the deltas on top of it. Upserts and
    deletes write only their own rows and a marker; readers take the last row of every key, and
    :meth:`optimize`, or every ``MAX_DELTAS`` writes, merges. Markers are created exclusively, so of two
    writers that started from one version one commits and the other tries again on top of it; data
    folders have names of their own and are seen only once a marker names them. ``key``: the columns
    that identify a row.
    """

    def __init__(self, spark: SparkSession, home: str, key: str | list[str] = "chunk_id"):
        self.spark, self.home = spark, home.rstrip("/")
        self.key = [key] if isinstance(key, str) else list(key)
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._fs.Path(f"{self.home}/{name}")

    def _system(self):
        return self._path("").getFileSystem(self._conf)

    def version(self) -> int:
        """Current version; 0 if nothing was ever written."""
        fs = self._system()
        if not fs.exists(self._path("current")):
            return 0
        marks = [s.getPath().getName() for s in fs.listStatus(self._path("current"))]
        return max((int(m) for m in marks if m.isdigit()), default=0)

    def _state(self, version: int) -> dict:
        """Base and deltas of a version."""
        if not version:
            return {"base": None, "deltas": []}
        stream = self._system().open(self._path(f"current/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, state: dict) -> bool:
        """Whether ``version`` could be made with this state; False if it exists.

        The state is written aside and renamed, so a marker is never seen half written; a rename onto
        an existing file fails."""
        fs = self._system()
        fs.mkdirs(self._path("current"))
        aside, mark = self._path(f"current/.{uuid.uuid4().hex}"), self._path(f"current/{version}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        lock = self._path(f"current/.lock-{version}")
        try:
            fs.create(lock, False).close()  # exclusive on every file system
        except Exception:  # noqa: BLE001 - the file system's own exists error
            fs.delete(aside, False)
            # A writer that died between lock and marker must not block the rest.
            if fs.exists(lock) and not fs.exists(mark) and time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > STALE:
                fs.delete(lock, False)
            return False
        return bool(fs.rename(aside, mark))

    def _change(self, make: Callable[[int, dict], dict]) -> int:
        """Commits what ``make`` builds on the current version, again if another writer was faster."""
        for attempt in range(ATTEMPTS):
            v = self.version()
            if self._commit(v + 1, make(v, self._state(v))):
                return v + 1
            time.sleep(PAUSE * 2**attempt * (1 + random.random()))
        raise Conflict(self.home)

    def _put(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.home}/{name}")
        return name

    def _load(self, state: dict) -> DataFrame:
        """Rows of a state: those of the base that no delta names, and of the deltas the last of each key."""
        base = self.spark.read.parquet(f"{self.home}/{state['base']}")
        if not state["deltas"]:
            return base
        deltas = None
        for n, name in enumerate(state["deltas"]):
            one = self.spark.read.parquet(f"{self.home}/{name}").withColumn("_n", F.lit(n))
            deltas = one if deltas is None else deltas.unionByName(one)
        last = deltas.withColumn("_r", F.row_number().over(W.partitionBy(*self.key).orderBy(F.desc("_n")))).where("_r = 1")
        hidden = base.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(self.key)]).columns
        met = last.select(*[F.col(k).alias(b) for k, b in zip(self.key, hidden)])
        same = [base[k].eqNullSafe(met[b]) for k, b in zip(self.key, hidden)]
        kept = base.join(met, reduce(lambda x, y: x & y, same), "left_anti")
        return kept.unionByName(last.where("not _gone").drop("_n", "_r", "_gone"))

    def read(self, schema: str | None = None) -> DataFrame:
        v = self.version()
        if v == 0:
            if schema is None:
                raise FileNotFoundError(f"no snapshot in {self.home}")
            return self.spark.createDataFrame([], schema)
        return self._load(self._state(v))

    def write(self, df: DataFrame) -> int:
        """A new base without deltas; it replaces whatever was there."""
        name = self._put(df)
        return self._change(lambda v, state: {"base": name, "deltas": []})

    def _delta(self, name: str, schema: DataFrame) -> int:
        def make(v: int, state: dict) -> dict:
            if not state["base"]:
                state = {"base": self._put(schema.limit(0).drop("_gone")), "deltas": []}
            state = {"base": state["base"], "deltas": [*state["deltas"], name]}
            return {"base": self._put(self._load(state)), "deltas": []} if len(state["deltas"]) > MAX_DELTAS else state

        return self._change(make)

    def upsert(self, batch: DataFrame, order: str | None = "chunk_index", gone: DataFrame | None = None) -> int:
        """K1: rows of the batch replace stored rows of the same key; of one key in the batch the
        highest ``order`` counts. ``gone``: keys that are deleted in the same version."""
        if order:
            best = W.partitionBy(*self.key).orderBy(F.desc(order))
            batch = batch.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
        rows = batch.withColumn("_gone", F.lit(False))
        if gone is not None:
            lost = gone.select(*self.key).distinct().join(batch.select(*self.key), self.key, "left_anti").withColumn("_gone", F.lit(True))
            rows = rows.unionByName(lost, allowMissingColumns=True)
        return self._delta(self._put(rows), rows)

    def delete(self, predicate: Column) -> int:
        """Rows for which the predicate is true; only their keys are written."""
        now = self.read()
        gone = now.where(F.coalesce(predicate, F.lit(False))).select(*self.key).distinct().withColumn("_gone", F.lit(True))
        rows = now.limit(0).withColumn("_gone", F.lit(False)).unionByName(gone, allowMissingColumns=True)
        return self._delta(self._put(rows), rows)

    def purge(self) -> int:
        """All rows; the schema stays."""
        return self.write(self.read().limit(0))

    def optimize(self, partitions: int, *keys: str) -> int:
        """K8: one base in few files, sorted so that min/max statistics prune. A write that comes
        between makes it start again, so none is lost."""

        def make(v: int, state: dict) -> dict:
            return {"base": self._put(self._load(state).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)), "deltas": []}

        return self._change(make)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes markers older than the last ``keep`` versions and data that no kept one names; no
        writer may be at work."""
        fs, v = self._system(), self.version()
        kept = {n for m in range(max(1, v - keep + 1), v + 1) for s in [self._state(m)] for n in [s["base"], *s["deltas"]]}
        for m in range(1, max(1, v - keep + 1)):
            fs.delete(self._path(f"current/{m}"), False)
        for s in fs.listStatus(self._path("data")):
            if f"data/{s.getPath().getName()}" not in kept:
                fs.delete(s.getPath(), True)

    def stats(self) -> dict:
        """R16."""
        df = self.read()
        return {"version": self.version(), "rows": df.count(), "columns": len(df.columns)}
