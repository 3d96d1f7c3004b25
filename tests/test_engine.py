"""Chunking, search, store, generation, ingest and query plans on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import vectors as V
from vellum.operators import chunking as H, docmodel as D, generation as G, pages as P, search as S, store as K
from vellum.operators.filters import Filters, parse_filters, tag_overlap
from vellum.plans import query as Q
from vellum.plans.ingest import Ingest
from vellum.sources import files
from vellum.streaming.ingest import ingest_stream, stream_documents

SMALL = H.ChunkSettings(target=20, min=5, max=40)


def chunks(spark, body, settings=H.ChunkSettings()):
    return [r.asDict(True) for r in H.chunk_documents(spark.createDataFrame([("d1", body)], "doc_id string, body string"), settings=settings).orderBy("chunk_index").collect()]


def test_chunk_short_and_empty(spark):
    assert len(chunks(spark, "Uma frase curta de exemplo.")) == 1
    assert chunks(spark, "   \n") == [] and chunks(spark, None) == []


def test_chunk_heading_parents(spark):
    c = chunks(spark, "# A\n\ntexto longo de teste aqui\n\n## B\n\noutro texto de teste\n\n## C\n\nmais texto de teste", SMALL)
    levels = {p["level"] for x in c for p in x["parents"]}
    assert {1, 2} <= levels and [x["chunk_index"] for x in c] == list(range(len(c)))


def test_chunk_code_is_reopened(spark):
    c = chunks(spark, "```python\n" + "x = 1  # some code\n" * 2000 + "```", H.ChunkSettings(target=100, min=10, max=200))
    assert len(c) > 1 and all(x["chunk_text"].startswith("```python") and x["chunk_text"].endswith("```") for x in c)


def test_chunk_list_keeps_lead_in(spark):
    body = "Passos a seguir:\n" + "".join(f"- item numero {i} com texto\n" for i in range(60))
    c = chunks(spark, body, H.ChunkSettings(target=150, min=30, max=200))
    assert len(c) > 1 and all(x["chunk_text"].startswith("Passos a seguir:") for x in c)


def test_chunk_appendix_and_strict_table(spark):
    c = chunks(spark, "# T\n\num texto qualquer de teste\n\n## Notas\n\numa nota de teste longa")
    assert any(x["is_appendix"] for x in c)
    t = "| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    kinds = [[b.kind for b in H.Section(t, 0, (), False, s).read()] for s in (False, True)]
    assert kinds == [["text"], ["table"]]


def test_chunk_repeated_text_has_one_id(spark):
    p = "igual texto longo o bastante para um pedaco " * 3
    c = chunks(spark, p + "\n\n" + p, SMALL)
    assert len(c) == 2 and len({x["chunk_id"] for x in c}) == 1


def test_settings_are_checked():
    for kw in ({"min": 700}, {"max": 10}, {"overlap": 0.5}, {"min": 0}):
        with pytest.raises(ValueError):
            H.ChunkSettings(**kw)


def test_windows_overlap_and_reach_the_end():
    rng = random.Random(1)
    s = H.ChunkSettings(target=1, min=1, max=80)
    for n in (81, 148, 149, 500):
        w = [rng.choice("ab") * rng.randint(1, 3) for _ in range(n)]
        got = [b.text.split() for b in H.split_block(H.Block(" ".join(w), 0, 0), s, count=lambda t: len(t.split()) + 81)]
        starts = [k for k in range(0, n, s.step) if k == 0 or k - s.step + s.max < n]
        assert got == [w[k : k + s.max] for k in starts] and got[-1][-1] == w[-1]


DOCS = [("a", "valve pump valve", "pt"), ("b", "pump", "en"), ("c", None, "pt"), ("d", "", None), ("e", "valve", "en")]


def test_fts(spark):
    d = spark.createDataFrame(DOCS, "id string, text string, lang string").withColumnRenamed("id", "k")
    q = spark.createDataFrame([(1, "Valve"), (2, "nothing here"), (3, None)], "query_id int, text string")
    r = [(x.query_id, x.id) for x in S.search_fts(d, q, "k", "text").orderBy("rank").collect()]
    assert r == [(1, "a"), (1, "e")] or r == [(1, "e"), (1, "a")]
    assert [x.id for x in S.search_fts(d, q, "k", "text", predicate=F.col("lang") == "en").collect()] == ["e"]
    assert S.search_fts(d.limit(0), q, "k", "text").count() == 0


def test_dense_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).tolist() + [None, [0.0] * 8, [1.0] * 3, [float("nan")] * 8]
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(v)], "id int, v array<double>, score string")
    q = df.where("id < 5").select(F.col("id").alias("query_id"), "v")
    got = {}
    for r in S.search_dense(df, q, "id", "v", 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    m = np.array(v[:60])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(5):
        assert [x for _, x in sorted(got[i])] == np.argsort(-(m @ m[i]))[:4].tolist()


def test_fusion_and_post_filter(spark):
    a = spark.createDataFrame([(1, "x", 2.0, 1), (1, "y", 1.0, 2)], "query_id int, id string, score double, rank int")
    b = spark.createDataFrame([(1, "y", 9.0, 1)], "query_id int, id string, score double, rank int")
    r = {x.id: x.score for x in S.fuse_rrf([a, b], 10).collect()}
    assert abs(r["y"] - (1 / 12 + 1 / 11)) < 1e-12 and abs(r["x"] - 1 / 11) < 1e-12
    assert {x.id: x.score for x in S.fuse_weighted([a, b], [1.0, 0.6]).collect()} == {"x": 1.0, "y": 0.6}
    hits = spark.createDataFrame([(1, f"c{i}", "d" if i < 6 else f"e{i}", 1.0 - i / 20, i + 1, ["t"] if i % 2 else None) for i in range(12)], "query_id int, chunk_id string, doc_id string, score double, rank int, tags array<string>")
    p = S.post_filter(hits)
    rows = p.collect()
    assert len(rows) <= 8 and sum(x.doc_id == "d" for x in rows) == 3
    assert S.post_filter(hits, ["t"]).where("tags is null").count() == 0
    assert S.has_conflict(hits).first().conflict is False


@pytest.mark.parametrize(("q", "k"), [("norma NBR 123", 5), ("valor 12", 10), ("o que é isso aqui mesmo", 60), ("duas palavras", 10), ("uma pergunta com mais de dez palavras para testar isso aqui agora", 40), ("cinco palavras nesta pergunta simples", 20)])
def test_rank_constant(spark, q, k):
    assert spark.range(1).select(S.rank_constant(F.lit(q)).alias("k")).first().k == k


def test_filters(spark):
    d = spark.createDataFrame([("a", "pt", ["x"]), ("b", "en", None), ("c", None, [])], "doc_id string, language string, tags array<string>")
    ids = lambda f: sorted(r.doc_id for r in f.apply(d).collect())
    assert ids(Filters()) == ["a", "b", "c"] and ids(Filters().in_("language", [])) == []
    assert ids(Filters().eq("language", "it's")) == []
    assert sorted(r.doc_id for r in d.where(Filters().eq("language", "pt").eq("language", "en").build_or()).collect()) == ["a", "b"]
    assert Filters().is_empty() and not Filters().with_tags(["x"]).is_empty() and Filters().with_tags(["x"]).build() is None
    assert ids(parse_filters(["language=pt", "bad", "unknown=1", "language="])) == ["a"]
    assert [r.doc_id for r in d.where(tag_overlap(F.col("tags"), ["x", "y"])).collect()] == ["a"]


def test_store(spark, tmp_path):
    s = K.Snapshots(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([("c1", 0, "a"), ("c1", 1, "b"), ("c2", 0, None)], "chunk_id string, chunk_index int, language string")
    assert s.version() == 0
    s.upsert(one)
    s.upsert(one)
    assert {(r.chunk_id, r.language) for r in s.read().collect()} == {("c1", "b"), ("c2", None)}
    s.delete(F.col("language") == "b")
    assert [r.chunk_id for r in s.read().collect()] == ["c2"]
    s.optimize(1, "chunk_id")
    assert s.stats()["rows"] == 1
    s.purge()
    assert s.stats() == {"version": 5, "rows": 0, "columns": 3}
    s.upsert(one)
    s.vacuum(1)
    assert s.stats() == {"version": 6, "rows": 2, "columns": 3}
    assert K.fetch(one, ["c2"]).count() == 1 and K.fetch(one, []).count() == 0


def test_two_writers_lose_no_update(spark, tmp_path, monkeypatch):
    """Both start from one version; the slower one is built again on top of the other's."""
    row = lambda k, v: spark.createDataFrame([(k, 0, v)], "chunk_id string, chunk_index int, language string")
    monkeypatch.setattr(K, "PAUSE", 0.01)
    a, b = K.Snapshots(spark, str(tmp_path)), K.Snapshots(spark, str(tmp_path))
    a.upsert(row("x", "0"))
    real, stale = b.version, [a.version()]
    b.version = lambda: stale.pop() if stale else real()
    a.upsert(row("y", "a"))
    assert b.upsert(row("z", "b")) == 3
    assert {r.chunk_id for r in a.read().collect()} == {"x", "y", "z"}
    b.version = lambda: 1
    with pytest.raises(K.Conflict):
        b.upsert(row("w", "b"))
    # A dead writer's lock is cleared once it is old.
    (tmp_path / "current" / ".lock-4").touch()
    monkeypatch.setattr(K, "STALE", -1)
    assert a.upsert(row("v", "a")) == 4


def test_deltas_are_merged_and_nulls_are_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MAX_DELTAS", 3)
    s = K.Snapshots(spark, str(tmp_path), ["k", "m"])
    want = {}
    for n in range(9):
        rows = [(f"k{n % 4}", "a", n), (None, "b", n), (f"k{n}", None, n)]
        want.update({(k, m): v for k, m, v in rows})
        s.upsert(spark.createDataFrame(rows, "k string, m string, v int"), order=None)
        assert {(r.k, r.m): r.v for r in s.read().collect()} == want
        assert len(s._state(s.version())["deltas"]) <= 3
    s.delete(F.col("v") < 7)
    assert {(r.k, r.m): r.v for r in s.read().collect()} == {k: v for k, v in want.items() if v >= 7}


@pytest.mark.parametrize("broken", ["index", "cache", "manifest"])
def test_ingest_survives_a_crash_between_its_stores(spark, tmp_path, broken):
    d = docs(spark, [("a", "1", "# Bomba\n\nA bomba principal mede o filtro."), ("b", "1", "A caldeira geral aquece a prensa.")])
    job = Ingest(spark, str(tmp_path), stale="drop")
    store = getattr(job, broken)

    def fail(*_, **__):
        raise OSError("lost")

    store.upsert = fail
    with pytest.raises(OSError):
        job.run(d)
    job = Ingest(spark, str(tmp_path), stale="drop")
    assert job.run(d).first().new == 2
    assert job.index.read().count() == 2 and job.cache.read().count() == 2 and job.manifest.read().count() == 2
    assert job.run(d).first().unchanged == 2


def docs(spark, rows):
    return spark.createDataFrame([(d, f"{d}.md", f"{d}.md", h, b, d, "pt", "manual", ["t"], 1) for d, h, b in rows], "doc_id string, source_path string, file_name string, file_hash string, body string, title string, language string, doc_type string, tags array<string>, ingested_at bigint")


def test_ingest_and_query(spark, tmp_path):
    job = Ingest(spark, str(tmp_path))
    r = job.run(docs(spark, [("a", "1", "# Bomba\n\nA bomba principal mede o filtro."), ("b", "1", "A caldeira geral aquece a prensa."), ("z", "1", "")])).first()
    assert (r.scanned, r.new, r.chunks_upserted, r.cache_misses) == (3, 3, 2, 2)
    r = job.run(docs(spark, [("a", "1", "# Bomba\n\nA bomba principal mede o filtro."), ("b", "2", "A caldeira nova aquece a prensa."), ("z", "1", "")])).first()
    assert (r.new, r.changed, r.unchanged, r.removed) == (1, 1, 1, 0)  # z has no chunks: new again
    assert job.index.read().count() == 3  # the stale chunk of b stays
    job.run(docs(spark, [("b", "2", "A caldeira nova aquece a prensa.")]))
    index = job.index.read()
    assert {x.doc_id for x in index.collect()} == {"b"}
    cache = Q.QueryCache()
    qs = spark.createDataFrame([(1, "caldeira", cache.vector("caldeira")), (2, "inexistente zzz", cache.vector("zzz"))], "query_id int, text string, v array<double>")
    for mode in Q.MODES:
        got = Q.retrieve(index, qs, Q.RetrievalSettings(mode=mode)).where("query_id = 1").collect()
        assert len(got) == 2 and got[0].place == 1
    ans = {x.query_id: x for x in Q.answer(index, qs, settings=Q.RetrievalSettings(mode="fts")).collect()}
    assert ans[1].sources.startswith("Sources:\n[1] b.md") and ans[2].sources == "Sources: (none)" and ans[2].insufficient_context
    with pytest.raises(ValueError):
        Q.RetrievalSettings(mode="other")
    assert job.reindex(docs(spark, [("b", "2", "A caldeira nova aquece a prensa.")]), purge=True).first().new == 1


def test_retriever_uses_its_cache(spark, tmp_path):
    job = Ingest(spark, str(tmp_path))
    job.run(docs(spark, [("a", "1", "# Bomba\n\nA bomba principal mede o filtro."), ("b", "1", "A caldeira geral aquece a prensa.")]))
    r = Q.Retriever(job.index.read(), Q.RetrievalSettings(mode="fts"))
    assert {(x.query_id, x.doc_id) for x in r.retrieve(["caldeira", "bomba", "caldeira"]).collect()} == {(1, "b"), (2, "a"), (3, "b")}
    assert r.cache_stats() == {"size": 2, "hits": 1, "misses": 2, "hit_rate": 1 / 3}
    assert {x.query_id for x in r.retrieve(["bomba", None], mode="dense").collect()} == {1} and r.cache_stats()["hits"] == 2
    text = r.answer(["caldeira"]).transform(G.answer_with_sources).first().text
    assert "\n\nSources:\n[1] b.md" in text
    r.invalidate_cache()
    assert r.cache_stats()["size"] == 0


def test_manifest_file(spark, tmp_path):
    import json

    good = {"doc_id": "a", "source_path": "x\\y/a.md", "file_hash": "h"}
    rows = [good, {**good, "file_hash": "h2", "tags": ["t"], "ingested_at": 5}, {"doc_id": "b"}, {"doc_id": None, "source_path": "p", "file_hash": "h"}, "bad", 7, {**good, "doc_id": "c", "file_name": "n", "language": "pt"}]
    (tmp_path / "m.json").write_text(json.dumps({"entries": rows}, indent=1))
    got = {r.doc_id: r.asDict() for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert got == {
        "a": {"doc_id": "a", "source_path": "x\\y/a.md", "file_name": "a.md", "file_hash": "h2", "ingested_at": 5, "language": "und", "doc_type": None, "tags": ["t"]},
        "c": {"doc_id": "c", "source_path": "x\\y/a.md", "file_name": "n", "file_hash": "h", "ingested_at": 0, "language": "pt", "doc_type": None, "tags": []},
    }
    for text in ("{broken", "", "[]", "{}"):
        (tmp_path / "m.json").write_text(text)
        assert files.read_manifest(spark, str(tmp_path / "m.json")).count() == 0
    assert files.read_manifest(spark, str(tmp_path / "none.json")).count() == 0


def test_readings_and_page_results(spark, tmp_path):
    long = "Texto nativo da página com mais de cinquenta sinais, sem dúvida."
    rows = [(1, long, "x", "y"), (2, "a", "A leitura clássica desta página é boa e tem linhas de tamanho comum.", "y"), (3, None, "|| ~~ ^^", "fallback"), (4, None, None, "fallback"), (5, "", None, None)]
    df = spark.createDataFrame(rows, "page int, native string, classic string, ai string")
    pick = lambda mode, ai=P.Reading("ai", "ai"): {r.page: (r.r.engine, r.r.status) for r in df.select("page", P.resolve(F.col("native"), [P.Reading("c", "classic")], ai, mode).alias("r")).collect()}
    assert pick("hybrid") == {1: ("native", "ok"), 2: ("c", "ok"), 3: ("ai", "ok"), 4: ("ai", "ok"), 5: ("ai", "failed")}
    assert pick("hybrid", None)[3] == (None, "failed") and pick("classic_only")[4] == ("c", "failed") and pick("legacy")[1] == ("ai", "ok")
    with pytest.raises(ValueError):
        P.resolve(F.col("native"), [], None, "other")
    store = P.PageResults(spark, str(tmp_path / "p"))
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("d", 10), ("e", 1)], "doc string, page int")
    new = lambda rows: spark.createDataFrame(rows, "doc string, page int, format string, content string, status string")
    assert store.read().count() == 0 and P.pending(pages, store.read(), ["json"]).count() == 4
    store.append(new([("d", 10, "json", "{}", "ok"), ("d", 1, "json", "1", "ok"), ("d", 2, "json", None, "failed")]), 1)
    assert {(r.doc, r.page) for r in P.pending(pages, store.read(), ["json"]).collect()} == {("d", 2), ("e", 1)}
    store.append(new([("d", 2, "json", "2", "ok"), ("d", 1, "json", "1b", "ok")]), 2)
    store.append(new([("d", 2, "json", "2", "ok"), ("d", 1, "json", "1b", "ok")]), 2)  # repeated
    done = store.drop_finished(pages, ["json"], 3).collect()
    assert [(r.doc, r.content, r.pages) for r in done] == [("d", "[\n1b,\n2,\n{}\n]", 3)] and store.read().count() == 0


def test_blocks_tables_and_exports(spark):
    assert V.unpack_sparse(V.pack_sparse({5: 0.5, 1: -2.0})) == {1: -2.0, 5: 0.5} and V.pack_sparse({}) is None and V.unpack_sparse(b"\0\0\0\0") is None
    lines = "array<struct<spans:array<struct<text:string,font:string,size:double,flags:int>>>>"
    b = spark.createDataFrame([(1, [([("a ", "X-Bold", 9.0, 0), ("b", None, None, None)],), (None,)], [1.0, 2.0, 3.0, 4.0]), (2, None, None), (3, [([("t", "x", 1.0, 2)],)], [1.0])], f"k int, l {lines}, b array<double>")
    got = {r.k: (r.bold, r.f.font_name, r.t, r.b.x1) for r in b.select("k", D.block_is_bold(F.col("l")).alias("bold"), D.block_font(F.col("l")).alias("f"), D.block_text(F.col("l")).alias("t"), D.block_bbox(F.col("b")).alias("b")).collect()}
    assert got == {1: (True, "X-Bold", "a b", 3.0), 2: (False, None, "", 0.0), 3: (True, "x", "t", 0.0)}
    t = spark.createDataFrame([(1, [[" h ", None], [" "], ["a", "b"]]), (2, [["only"]]), (3, [[" "]]), (4, []), (5, None)], "k int, d array<array<string>>")
    got = {r.k: r.t and (r.t.rows, r.t.headers) for r in t.select("k", D.table_item(F.col("d")).alias("t")).collect()}
    assert got == {1: ([["a", "b"]], ["h", ""]), 2: ([["only"]], []), 3: None, 4: None, 5: None}
    schema = "doc string, item_id string, kind string, body_pos int, page_num int, text string, heading_level int, rows array<array<string>>, headers array<string>, caption string, ordered boolean, children array<string>, confidence double"
    item = lambda i, kind, pos, text=None, **k: ("d", i, kind, pos, 1, text, k.get("level"), k.get("rows"), k.get("headers"), k.get("caption"), k.get("ordered"), k.get("children"), 1.0)
    items = spark.createDataFrame([item("h", "heading", 1, "T", level=9), item("t", "text", None, "one"), item("u", "text", None, "two"), item("l", "list", 2, children=["u", "t", "zz"], ordered=True), item("e", "list", 3), item("b", "table", 4, rows=[["1"]]), item("p", "picture", 5), item("w", "text", 6, " ")], schema)
    assert D.document_markdown(items).first().markdown == "\n###### T\n\n1. two\n1. one\n\n| --- |\n| 1 |\n\n\n[Imagem: Image]\n"
    assert D.document_html(items).first().html.split("\n") == ['<!DOCTYPE html><html><head><meta charset="utf-8">', "<title>d</title>", "</head><body>", "<h6>T</h6>", "<ol>", "<li>two</li>", "<li>one</li>", "</ol>", "<ul>", "</ul>", "<table>", "<tbody>", "<tr>", "<td>1</td>", "</tr>", "</tbody></table>", "<figure><figcaption>Image</figcaption></figure>", "</body></html>"]
    scored = {r.item_id: (r.confidence, r.quality.acceptable) for r in D.score_items(items).collect()}
    assert scored["p"] == (1.0, True) and scored["h"] == (0.0, False) and scored["w"] == (0.0, False)
    assert [r.item_id for r in D.body_items(items).orderBy("place").collect()] == ["h", "l", "e", "b", "p", "w"]
    assert D.document_json(items.limit(0)).count() == D.document_html(items.limit(0)).count() == 0


def test_streaming_ingest(spark, tmp_path):
    d = docs(spark, [("a", "1", "A bomba principal mede o filtro.")])
    d.write.parquet(str(tmp_path / "in"))
    job = Ingest(spark, str(tmp_path / "home"))
    q = ingest_stream(stream_documents(spark, str(tmp_path / "in"), ", ".join(f"{n} {t}" for n, t in d.dtypes)), job, str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert job.index.read().count() == 1


def test_generation(spark):
    q = spark.createDataFrame([(1, "Q?"), (2, None)], "query_id int, text string")
    h = spark.createDataFrame([(1, 1, "Top", "Sec", None, "word " * 1000, "f.md", "c0", 0.9)], "query_id int, place int, h1 string, h2 string, h3 string, snippet string, file_name string, chunk_id string, score double")
    p = {r.query_id: r.user for r in G.build_prompts(q, h, limit=100).collect()}
    assert "[1] Top > Sec\nword" in p[1] and p[1].endswith("[…]\n\nQUESTION:\nQ?") and "(empty" in p[2]
    s = {r.query_id: r.sources for r in G.sources_block(q, h).collect()}
    assert s == {1: "Sources:\n[1] f.md — Top / Sec (chunk_id=c0, score=0.900)", 2: "Sources: (none)"}
    with pytest.raises(ValueError):
        G.system_prompt("nonsense")

    class Broken:
        def complete(self, system, user):
            raise RuntimeError("down")

    a = G.answer(G.build_prompts(q, h), Broken()).first().text
    assert a.startswith(G.NOT_FOUND) and "down" in a
    assert G.answer(G.build_prompts(q, h), G.StubModel()).first().text == G.NOT_FOUND


def test_items(spark):
    b = spark.createDataFrame([("d", 1, 0, "Introduction", 14.0, False), ("d", 1, 1, "- a", 10.0, False), ("d", 1, 2, "1. b", 10.0, False), ("d", 1, 3, "text", None, None), ("d", 1, 4, "* c", 9.0, False), ("d", 1, 5, " ", 9.0, True)], "doc string, page_num int, block_no int, text string, font_size double, is_bold boolean")
    got = [(r.kind, r.list_no) for r in D.layout_items(b).orderBy("block_no").collect()]
    assert got == [("heading", None), ("list_text", 1), ("list_text", 1), ("text", None), ("list_text", 2)]
    assert D.median_font(b).first().median_font == 10.0
    t = spark.createDataFrame([([["1", None], ["", " "]], None, "")], "rows array<array<string>>, headers array<string>, caption string")
    assert t.select(D.table_markdown(D.drop_blank_rows(F.col("rows")), F.col("headers"), F.col("caption")).alias("m")).first().m == "| --- | --- |\n| 1 |  |"


FTS_TEXTS = ["a b b", "b c", "", "c c c a", "a", "d", None, "b"]


def _fts_brute(docs, asked, k, may):
    """BM25 by the definition: every row of a key counts with its own length."""
    import math
    from collections import Counter

    split = {}
    for key, text, _ in docs:
        split.setdefault(key, []).append((text or "").split())
    n = len(docs)
    mean = sum(len(t) for x in split.values() for t in x) / n
    tf = {key: Counter(w for t in x for w in t) for key, x in split.items()}
    out = []
    for q, text in asked:
        got = []
        for key in tf:
            if key is None or not any(may(d) for d in docs if d[0] == key):
                continue
            s = 0.0
            for w in set(text.split()):
                df = sum(w in c for c in tf.values())
                if tf[key][w]:
                    s += sum(math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[key][w] * 2.2 / (tf[key][w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for t in split[key])
            if s:
                got.append((-math.floor(s * 1e6 + 0.5), key))
        out += [(q, key, r) for r, (_, key) in enumerate(sorted(got)[:k], 1)]
    return sorted(out)


def test_fts_over_blocks_equals_brute_force(spark, monkeypatch):
    """Ties, repeated and null keys, repeated questions, a filter, and more blocks, tasks and slices than one."""
    for name, size in (("QUESTIONS", 4), ("ASKS", 2), ("TEXTS", 5), ("CELLS", 100)):
        monkeypatch.setattr(S, name, size)
    rows = [(i, FTS_TEXTS[i % 8], i % 3) for i in range(200)] + [(3, "b d", 1), (None, "a d", 0)]
    asked = [(i, t) for i, t in enumerate(["a", "b c", "d", "a b c d", "zz", "c zz", "a a d"])]
    d = spark.createDataFrame(rows, "k bigint, text string, kind int")
    q = spark.createDataFrame(asked + [(1, "b c")], "query_id int, text string")
    for p, may in ((None, lambda r: True), (F.col("kind") == 1, lambda r: r[2] == 1)):
        got = sorted((r.query_id, r.id, r["rank"]) for r in S.search_fts(d, q, "k", "text", 7, p).collect())
        assert got == _fts_brute(rows, asked, 7, may)


@pytest.mark.parametrize("name", ["retrieve_filtered_eq", "retrieve_filtered_range", "search_fts_topk", "search_semantic_rrf", "retrieve_filtered_or", "retrieve_filtered_raw", "search_hybrid_rrf", "search_weighted"])
def test_word_search_stores_texts_not_pairs(spark, tmp_path, name):
    """Eight hundred questions share words with all of four thousand texts: even filtered, the pairs would be 800,000 rows."""
    from vellum.catalog.search import QUERIES

    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    one = ids.select(
        (F.col("doc_id") * 20).alias("doc_id"), F.concat(F.lit("the same words "), (F.col("doc_id") % 97).cast("string")).alias("text"), F.when(F.col("doc_id") % 2 == 0, "pt").otherwise("en").alias("lang"), F.lit("x").alias("source"), F.lit("manual").alias("doc_type"),
        (F.col("doc_id") % 2000).alias("n_chars"), F.lit("the same words").alias("title"),
    )
    one.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    before = _shuffled(spark)
    assert QUERIES[name](spark, str(tmp_path)).count() >= 800 * 20
    assert 0 < _shuffled(spark) - before < 400_000


def _shuffled(spark):
    """Records written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))
