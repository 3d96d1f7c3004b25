"""Session-level helpers: table access, durable lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a side may be broadcast after its size has been counted.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: the cluster's ``spark.checkpoint.dir``; a temporary one only where
    that is unset and the master is local (tests)."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(shared)
        return shared
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-ck-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and continue from there; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose row count has been measured; larger sides are shuffled."""
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame, per_task_bytes: int = 4 << 20) -> DataFrame:
    """Split few-file inputs so CPU-heavy row work uses every core.

    Parquet inputs of one row group arrive as one partition; inputs that already have as many
    partitions as the cluster has cores are left alone (no shuffle)."""
    cores = max(2, df.sparkSession.sparkContext.defaultParallelism)
    have = df.rdd.getNumPartitions()
    return df if have >= cores else df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once per Spark context)."""
    sc = spark.sparkContext
    if getattr(sc, "_vellum_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="vellum-code-"), "vellum_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("vellum", os.path.relpath(full, here)))
    sc.addPyFile(archive)
    sc._vellum_shipped = True
