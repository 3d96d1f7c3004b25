"""The registered queries run, and agree with their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as E

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are not here")
CORE = ("search_fts_topk", "search_hybrid_rrf", "retrieve_diversified", "manifest_diff", "p5_found", "quality_score", "chunk_documents", "clean_whitespace")


def test_every_sql_has_its_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    assert E.entry(spark).count() >= 0


@pytest.mark.parametrize("name", CORE)
def test_core_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    rows = E.queries()[name](spark, ROOT)
    cols = sorted(rows.columns)
    got = sorted(repr([r[c] for c in cols]) for r in rows.collect())
    if name not in E.oracle_sql():
        return
    con = duckdb.connect()
    for f in os.listdir(ROOT):
        con.sql(f"create view {f[:-8]} as select * from '{ROOT}/{f}'")
    rel = con.sql(E.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in cols]
    assert got == sorted(repr([r[k] for k in at]) for r in rel.fetchall())


def _both(spark, name, root):
    """Rows of a query and of its SQL over tables of a folder."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(root):
        con.sql(f"create view {f[:-8]} as select * from '{root}/{f}/*.parquet'")
    rel = con.sql(E.oracle_sql()[name])
    return sorted(tuple(r[c] for c in rel.columns) for r in E.queries()[name](spark, root).collect()), sorted(rel.fetchall())


def test_metadata_of_whole_bodies(spark, tmp_path):
    bodies = [("a", "x" * 300 + "one"), ("b", "x" * 300 + "two"), ("c", " \n" + "y" * 500), ("d", None)]
    df = spark.createDataFrame(bodies, "doc_id string, body string")
    df.selectExpr("*", *[f"cast(null as {f.dataType.simpleString()}) {f.name}" for f in spark.read.parquet(f"{ROOT}/documents_md.parquet").schema if f.name not in df.columns]).write.parquet(f"{tmp_path}/documents_md.parquet")
    got, want = _both(spark, "strip_metadata", str(tmp_path))
    assert got == want and len({digest for _, digest in got}) == 3


def test_sparse_search_of_all_models(spark, tmp_path):
    rows = [("c0000", "base", {1: 1.0, 2: 2.0}), ("c0001", "base", {1: 3.0}), ("c0000", "mini", {1: 5.0}), ("c0001", "mini", {1: 7.0, 5: 0.5}), ("c0002", "mini", None), ("c0000", None, {1: 1.0})]
    spark.createDataFrame(rows, "chunk_id string, model string, sparse map<int,float>").write.parquet(f"{tmp_path}/embed_cache.parquet")
    got, want = _both(spark, "search_sparse_topk", str(tmp_path))
    assert got == want and {(m, c, s) for m, q, c, s, _ in got if q == "c0000"} == {("base", "c0000", 5.0), ("base", "c0001", 3.0), ("mini", "c0001", 35.0), ("mini", "c0000", 25.0)}
    got, want = _both(spark, "token_weights_max", str(tmp_path))
    assert got == want == [("mini", "c0001", 5, 0.5)]  # ids up to 3 are special
