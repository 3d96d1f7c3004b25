import pytest
from pyspark.sql import functions as F

from vellum.operators.incremental import IncrementalRun, last_success, pending, removed

LIST = "doc_id string, file_hash string, extra string"
MAN = "doc_id string, file_hash string, ingested_at bigint, run_id int"
RUNS = "run_id int, status string"


def run(spark, listing, manifest, runs):
    r = pending(spark.createDataFrame(listing, LIST), spark.createDataFrame(manifest, MAN), spark.createDataFrame(runs, RUNS))
    return {(x.doc_id, x.status) for x in r.collect()}, r.count()


def test_cases(spark):
    listing = [("a", "H1", "x"), ("a", "h1", "y"), ("b", "h2", None), ("c", "h3", None), ("d", None, None), (None, "h", None), ("e", "h5", None)]
    manifest = [("a", "h1", 1, 1), ("b", "h2", 5, 2), ("b", "old", 1, 1), ("c", "h3", 1, 1), ("c", "zz", None, 3), ("d", "h4", 1, 1), ("e", "h5", 1, 2), ("gone", "h", 1, 1)]
    got, n = run(spark, listing, manifest, [(1, "succeeded"), (2, "FAILED"), (3, "succeeded"), (4, "aborted")])
    assert got == {("b", "changed"), ("c", "changed"), ("d", "changed"), ("e", "new")}
    assert n == 4


def test_empty_tables(spark):
    assert run(spark, [], [], []) == (set(), 0)
    assert run(spark, [("a", "h", None)], [], [])[0] == {("a", "new")}
    assert run(spark, [("a", "h", None)], [("a", "h", 1, 1)], [])[0] == {("a", "new")}


def test_ties_in_one_run_take_latest_then_largest(spark):
    m = spark.createDataFrame([("a", "x", 1, 1), ("a", "y", 2, 1), ("b", "p", 1, 1), ("b", "q", 1, 1), ("b", "q", 1, 1)], MAN)
    r = {x.doc_id: x.known_hash for x in last_success(m, spark.createDataFrame([(1, "succeeded")], RUNS)).collect()}
    assert r == {"a": "y", "b": "q"}


def test_removed(spark):
    m = spark.createDataFrame([("a", "x", 1, 1), ("b", "x", 1, 1)], MAN)
    r = removed(spark.createDataFrame([("a", "x", None)], LIST), m, spark.createDataFrame([(1, "succeeded")], RUNS))
    assert [x.doc_id for x in r.collect()] == ["b"]


def test_failure_before_commit_neither_skips_nor_repeats(spark, tmp_path):
    job = IncrementalRun(spark, str(tmp_path))
    one = spark.createDataFrame([("a", "h1", "t"), ("b", "h2", "t")], LIST)

    def boom(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        job.run(one, boom, 1, 10)
    assert job.committed().count() == 0
    assert job.run(one, lambda df: df.select("doc_id"), 1, 11)
    assert not job.run(one, lambda df: df.select("doc_id"), 1, 12)
    two = spark.createDataFrame([("a", "H1", "t"), ("b", "h9", "t"), ("c", "h3", "t")], LIST)
    assert job.run(two, lambda df: df.select("doc_id"), 2, 13)
    out = spark.read.parquet(f"{tmp_path}/output").groupBy("batch").agg(F.sort_array(F.collect_list("doc_id")).alias("d"))
    assert {r.batch: r.d for r in out.collect()} == {1: ["a", "b"], 2: ["b", "c"]}
    # b is superseded by what its new version gave.
    assert sorted((r.batch, r.doc_id) for r in job.results().collect()) == [(1, "a"), (2, "b"), (2, "c")]


def test_file_that_changes_between_the_reads(spark, tmp_path):
    """The listing names one hash, the records have another by the time they are read."""
    job = IncrementalRun(spark, str(tmp_path / "home"))
    spark.createDataFrame([("a", "h1", "old"), ("b", "h2", "same")], LIST).write.parquet(str(tmp_path / "in"))
    listing = spark.read.parquet(str(tmp_path / "in"))
    changed = spark.createDataFrame([("a", "h9", "new"), ("b", "h2", "same")], LIST)
    import vellum.operators.incremental as module

    first = module.pending
    try:
        module.pending = lambda r, *a, **k: first(listing, *a, **k)
        assert job.run(changed, lambda df: df.select("doc_id", "extra"), 1, 10)
    finally:
        module.pending = first
    assert [r.doc_id for r in job.results().collect()] == ["b"]
    assert job.run(changed, lambda df: df.select("doc_id", "extra"), 2, 11)
    assert sorted((r.doc_id, r.extra) for r in job.results().collect()) == [("a", "new"), ("b", "same")]
