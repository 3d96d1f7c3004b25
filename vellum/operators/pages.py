"""Readings of pages: choice among candidates, partial results, resume and consolidation.

A page's candidate readings are columns. Results of pages are rows of a table; what a run has left to
do is an anti-join against them, and a document is put together from its latest rows in page order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.functions.quality import has_meaningful_text, route

MODES = ("legacy", "ai_only", "classic_only", "hybrid")
PARTIALS = "doc string, page int, format string, content string, status string, run_id bigint"


@dataclass(frozen=True)
class Reading:
    """A candidate: name of its engine, columns of its text and confidence. A null text is a failure."""

    name: str
    text: str
    confidence: str | None = None


def resolve(native: Column, candidates: list[Reading], fallback: Reading | None, mode: str = "hybrid", threshold: float = 0.7) -> Column:
    """Struct ``(engine, text, confidence, status)`` of the reading that is taken.

    ``legacy`` and ``ai_only`` take the fallback, ``classic_only`` the first candidate, accepted or
    not. ``hybrid`` takes native text of fifty signs or more, else the first candidate that does not
    fail and is accepted (by agreement with native text, else by its score), else the fallback.
    ``status``: ``ok``, or ``failed`` with null text where nothing could be taken.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")

    def taken(r: Reading) -> Column:
        text = F.col(r.text)
        conf = F.col(r.confidence).cast("double") if r.confidence else F.lit(None).cast("double")
        return F.struct(F.lit(r.name).alias("engine"), text.alias("text"), conf.alias("confidence"), F.when(text.isNull(), "failed").otherwise("ok").alias("status"))

    none = F.struct(F.lit(None).cast("string").alias("engine"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("confidence"), F.lit("failed").alias("status"))
    last = taken(fallback) if fallback else none
    if mode in ("legacy", "ai_only"):
        return last
    if mode == "classic_only":
        return taken(candidates[0]) if candidates else none
    out = F.when(has_meaningful_text(native, 50), F.struct(F.lit("native").alias("engine"), native.alias("text"), F.lit(1.0).alias("confidence"), F.lit("ok").alias("status")))
    for r in candidates:
        conf = F.col(r.confidence) if r.confidence else F.lit(None).cast("double")
        out = out.when(F.col(r.text).isNotNull() & route(native, F.col(r.text), conf, threshold)["accepted"], taken(r))
    return out.otherwise(last)


def latest(partials: DataFrame) -> DataFrame:
    """Last result of every page and format; of equal runs the greater content, a failure last."""
    x = F.max(F.struct("run_id", (F.col("status") == "ok").alias("ok"), "content", "status")).alias("x")
    return partials.groupBy("doc", "page", "format").agg(x).select("doc", "page", "format", "x.content", "x.status", "x.run_id")


def pending(pages: DataFrame, partials: DataFrame, formats: list[str]) -> DataFrame:
    """K7: ``(doc, page, format)`` of ``pages (doc, page)`` that no run has finished yet."""
    wanted = pages.select("doc", "page").distinct().withColumn("format", F.explode(F.array(*[F.lit(f) for f in formats])))
    return wanted.join(latest(partials).where("status = 'ok'"), ["doc", "page", "format"], "left_anti")


def consolidate(partials: DataFrame) -> DataFrame:
    """K7, L4: ``(doc, format, content, pages)`` of finished pages in page order: JSON pages as one array,
    others a blank line apart. Empty pages show nothing but count; a document is the unit of work."""
    ok = latest(partials).where("status = 'ok' and content is not null")
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("page", "content")))), lambda x: x["content"])
    one = ok.groupBy("doc", "format").agg(parts.alias("parts"), F.count("*").alias("pages"))
    json = F.concat(F.lit("[\n"), F.array_join("parts", ",\n"), F.lit("\n]"))
    return one.select("doc", "format", F.when(F.col("format") == "json", json).otherwise(F.array_join("parts", "\n\n")).alias("content"), "pages")


def finished(pages: DataFrame, partials: DataFrame, formats: list[str]) -> DataFrame:
    """K7: ``(doc)`` of documents all whose pages are done, whose partials may be dropped."""
    return pages.select("doc").distinct().join(pending(pages, partials, formats).select("doc").distinct(), "doc", "left_anti")


class PageResults:
    """K7: partial results on shared storage, one folder per run; a run that is repeated replaces its own."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.home)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path) or not any(s.getPath().getName().startswith("run_id=") for s in fs.listStatus(path)):
            return self.spark.createDataFrame([], PARTIALS)
        return self.spark.read.schema(PARTIALS).parquet(self.home)

    def append(self, results: DataFrame, run_id: int) -> None:
        """Results ``(doc, page, format, content, status)`` of a run."""
        results.select("doc", F.col("page").cast("int").alias("page"), "format", "content", "status").write.mode("overwrite").parquet(f"{self.home}/run_id={run_id}")

    def drop_finished(self, pages: DataFrame, formats: list[str], run_id: int) -> DataFrame:
        """Writes what is left of unfinished documents as one run and drops the older ones; returns the
        consolidated documents that were finished."""
        from vellum.runtime import cut

        partials = self.read()
        done = cut(finished(pages, partials, formats))
        out = cut(consolidate(partials.join(done, "doc", "left_semi")))
        left = cut(latest(partials.join(done, "doc", "left_anti")).drop("run_id"))
        old = [r.run_id for r in partials.select("run_id").distinct().collect()]  # one row a run
        self.append(left, run_id)
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.home).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for r in old:
            if r != run_id:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/run_id={r}"), True)
        return out
