"""Processing only new or changed records (problem 5).

A manifest of processed files (path, checksum, run) is the only memory between runs. A run lists
its input, anti-joins the listing with the manifest entries of runs that succeeded, writes the
selected records under the batch's own folder (so a repeated batch overwrites itself) and commits
the manifest entries last. A crash before the commit leaves nothing behind that a later run would
trust; a crash after it leaves nothing to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _hash(c: str) -> Column:
    """Checksums compare without letter case and surrounding blanks."""
    return F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))


def last_success(manifest: DataFrame, runs: DataFrame, key: str = "doc_id", file_hash: str = "file_hash") -> DataFrame:
    """``(key, known_hash)``: the entry of each file in its latest succeeded run.

    Entries of failed, aborted or unlisted runs do not count. Within one run the entry with the
    latest ``ingested_at`` (null first), then the largest hash, counts. The aggregation combines
    map-side, so a file that owns most entries costs no more than another.
    """
    done = runs.where(F.lower(F.trim("status")) == "succeeded").select("run_id").distinct()
    entries = manifest.where(F.col(key).isNotNull()).select(key, "run_id", F.coalesce("ingested_at", F.lit(-(1 << 62))).alias("at"), _hash(file_hash).alias("h"))
    return (
        entries.join(done, "run_id", "left_semi")
        .groupBy(key)
        .agg(F.max(F.struct("run_id", "at", "h")).alias("m"))
        .select(key, F.col("m.h").alias("known_hash"), F.lit(True).alias("known"))
    )


def pending(listing: DataFrame, manifest: DataFrame, runs: DataFrame, key: str = "doc_id", file_hash: str = "file_hash") -> DataFrame:
    """``(key, file_hash, status)`` of the files the next run must process, each once.

    ``new``: no entry from a succeeded run. ``changed``: the latest such entry holds another hash.
    A file without a hash, or known only without one, cannot be shown to be unchanged and is
    processed. Rows without key are left out; exact duplicates and letter case do not matter; a key
    listed with several hashes is decided by the largest. Empty listing: no rows; empty manifest or
    runs: all files are new. Other columns are ignored.
    """
    now = listing.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(_hash(file_hash)).alias("file_hash"))
    return (
        now.join(last_success(manifest, runs, key, file_hash), key, "left")
        .where(F.col("known").isNull() | F.col("file_hash").isNull() | F.col("known_hash").isNull() | (F.col("file_hash") != F.col("known_hash")))
        .select(key, "file_hash", F.when(F.col("known").isNull(), "new").otherwise("changed").alias("status"))
    )


def removed(listing: DataFrame, manifest: DataFrame, runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys with a succeeded entry that the listing no longer holds."""
    return last_success(manifest, runs, key).select(key).join(listing.select(key), key, "left_anti")


class IncrementalRun:
    """File-based commit protocol around :func:`pending`.

    Below ``home``: ``output/batch=<id>/`` results, ``manifest/batch=<id>/`` entries of the files a
    batch held, ``commits/batch=<id>/`` the marker written last. Only entries of batches with a
    marker are believed.
    """

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self) -> DataFrame:
        """Manifest entries of committed batches: ``key, file_hash, run_id, ingested_at``."""
        empty = self.spark.createDataFrame([], "key string, file_hash string, run_id bigint, ingested_at bigint")
        if not (self._exists(f"{self.home}/manifest") and self._exists(f"{self.home}/commits")):
            return empty
        marks = self.spark.read.schema("run_id bigint").parquet(f"{self.home}/commits").select("run_id").distinct()
        entries = self.spark.read.schema("key string, file_hash string, run_id bigint, ingested_at bigint").parquet(f"{self.home}/manifest")
        return entries.select("key", "file_hash", "run_id", "ingested_at").join(marks, "run_id", "left_semi")

    def run(self, records: DataFrame, transform: Callable[[DataFrame], DataFrame], batch_id: int, now_ms: int, key: str = "doc_id", file_hash: str = "file_hash") -> bool:
        """Process what is new or changed. Returns False if this batch was committed before."""
        if self._exists(f"{self.home}/commits/batch={batch_id}/_SUCCESS"):
            return False
        known = self.committed()
        runs = known.select("run_id", F.lit("succeeded").alias("status")).distinct()
        todo = pending(records, known.withColumnRenamed("key", key), runs, key, file_hash)
        todo.select(F.col(key).cast("string").alias("key"), "file_hash", F.lit(batch_id).cast("bigint").alias("run_id"), F.lit(now_ms).cast("bigint").alias("ingested_at")).write.mode("overwrite").parquet(f"{self.home}/manifest/batch={batch_id}")
        chosen = self.spark.read.parquet(f"{self.home}/manifest/batch={batch_id}")
        # By key and hash: a file that changes between the two reads is left to the next run, which finds
        # its new hash unknown, and is never processed under the old one.
        held = chosen.select(F.col("key").cast(dict(records.dtypes)[key]).alias("_k"), F.col("file_hash").alias("_h"))
        rows = records.join(held, (F.col(key) == F.col("_k")) & _hash(file_hash).eqNullSafe(F.col("_h")), "left_semi")
        transform(rows).write.mode("overwrite").parquet(f"{self.home}/output/batch={batch_id}")
        self.spark.range(1).select(F.lit(batch_id).cast("bigint").alias("run_id")).coalesce(1).write.mode("overwrite").parquet(f"{self.home}/commits/batch={batch_id}")
        return True

    def results(self, key: str = "doc_id") -> DataFrame:
        """Output of committed batches, of each key only that of the last batch that processed it, so
        what a changed file gave before is superseded. The output must carry the key."""
        last = self.committed().groupBy(F.col("key").alias("_k")).agg(F.max("run_id").alias("_b"))
        out = self.spark.read.parquet(f"{self.home}/output")
        return out.join(last, (F.col(key).cast("string") == F.col("_k")) & (F.col("batch") == F.col("_b")), "left_semi")
