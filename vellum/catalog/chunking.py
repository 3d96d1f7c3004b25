"""Headings, splits, chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.catalog import sqlparts as Q
from vellum.functions.text import count_tokens
from vellum.operators import chunking as H
from vellum.runtime import ship, spread, table

SMALL = H.ChunkSettings(target=60, min=20, max=80)


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace("body", "\r\n?", "\n")
    return spread(table(spark, d, "documents_md").where("body is not null").select("doc_id", t.alias("body")).distinct())


def _each(rows: DataFrame, text: str, schema: str, made: Callable[[str], list[tuple]]) -> DataFrame:
    """``(doc_id, schema)``: what the chunker's own functions make of each text, row by row."""
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(d, *r) for d, t in zip(pdf["d"], pdf["t"]) for r in made(t)], columns=names)

    return rows.select(F.col("doc_id").alias("d"), F.col(text).alias("t")).mapInPandas(work, f"doc_id {kind}, {schema}")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))


def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    """Headings of the documents with their place, as the chunker reads them; appendix titles marked."""
    ship(spark)

    def made(body: str) -> list[tuple]:
        found = [(p[-1], appendix) for p, _, _, appendix in H.sections(body) if p]
        return [(i, level, text, appendix) for i, ((level, text), appendix) in enumerate(found)]

    return _each(_bodies(spark, d), "body", "i int, level int, text string, is_appendix boolean", made)


def heading_path(spark: SparkSession, d: str) -> DataFrame:
    """The first heading of each level above every section, from the parents the chunker gives it."""
    ship(spark)

    def made(body: str) -> list[tuple]:
        found = [p for p, _, _, _ in H.sections(body) if p]
        return [(i, *(next((t for l, t in p if l == n), None) for n in (1, 2, 3))) for i, p in enumerate(found)]

    return _each(_bodies(spark, d), "body", "i int, h1 string, h2 string, h3 string", made)


def parents_h123(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("parents is not null").select("chunk_id", "chunk_index", *H.parents_h123(F.col("parents"))).distinct()


def split_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """H10 by the chunker: every text is too long, no paragraph is."""
    long = H.ChunkSettings(target=5_000, min=20, max=5_000)
    count = lambda x: 10_000 if re.search(r"\n\s*\n", x) else 1
    r = _each(_texts(spark, d), "text", "i int, p string", lambda t: [(i, b.text.strip()) for i, b in enumerate(H.split_block(H.Block(t, 0, len(t)), long, count)) if b.text.strip()])
    return r.select("doc_id", "i", F.sha1("p").alias("digest"))


def window_split(spark: SparkSession, d: str) -> DataFrame:
    """H6, H10, H11, W7 by the chunker: texts over 80 tokens by paragraph, paragraphs over 80 by windows
    of 80 words."""
    r = _each(_texts(spark, d), "text", "i int, w string", lambda t: [(i, b.text) for i, b in enumerate(H.split_block(H.Block(t, 0, len(t)), SMALL))])
    return r.select("doc_id", "i", F.sha1("w").alias("digest"))


def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("chunk_text is not null").select("chunk_id", "chunk_text").distinct()
    p = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("chunk_id"), F.explode(H.paragraphs(F.col("text"))).alias("chunk_text"))
    both = c.unionByName(p)
    return both.groupBy("chunk_id").agg(F.count_if(H.is_noise(F.col("chunk_text"), count_tokens(F.col("chunk_text")), 80)).alias("noise"), F.count("*").alias("n"))


def accumulate_merge(spark: SparkSession, d: str) -> DataFrame:
    """H12, W8 by the chunker's fold over the paragraphs of each text: group sizes in order."""
    s = H.ChunkSettings()

    def made(text: str) -> list[tuple]:
        parts = [x for x in (x.strip() for x in re.split(r"\n\s*\n", text)) if x]
        return [(",".join(str(sum(map(H.tokens_of, b.text.split("\n\n")))) for b in H.accumulate([H.Block(x, 0, 0) for x in parts], s)),)]

    return _each(_texts(spark, d), "text", "sizes string", made)


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    c = H.chunk_documents(_bodies(spark, d))
    return c.select("chunk_id", "doc_id", "chunk_index", "token_count", "char_count", F.to_json("parents").alias("parents"), "is_appendix")


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the stored chunks per document."""
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "chunk_index", "token_count", "char_count", "is_appendix").distinct()
    return c.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max("char_count").alias("longest"),
        F.count_if("is_appendix").alias("appendix"), F.max("chunk_index").alias("last_index"),
    )


QUERIES = {
    f.__name__: f for f in (heading_sections, heading_path, parents_h123, split_paragraphs, window_split, noise_filter, accumulate_merge, chunk_documents, chunk_stats)
}

_HEADS = f"""
b AS (SELECT DISTINCT doc_id, replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body FROM documents_md WHERE body IS NOT NULL),
hl AS (SELECT doc_id, body, list_filter({Q.lines('body')}, lambda l: regexp_matches(l, '^#{{1,6}}\\s+\\S')) AS hl FROM b),
h AS (SELECT doc_id, body, unnest(range(len(hl))) AS i, unnest(hl) AS l FROM hl),
hs AS (SELECT doc_id, body, i, length(regexp_extract(l, '^(#{{1,6}})', 1)) AS level, {Q.strip("regexp_extract(l, '(?s)^#{1,6}\\s+(.*?)(?:\\s+#+\\s*)?$', 1)")} AS text FROM h)"""

_PARAS = rf"""
pr AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: {Q.strip('x')}), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
pp AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM pr)"""

_NOISE = rf"""
n0 AS (SELECT k, t, greatest(1, length(t) // 4) AS tokens, {Q.lines(Q.strip('t'))} AS ls, length(regexp_replace(t, '[\s\d.,;:()\[\]{{}}#*_\-+|/\\%$\^&=<>@!?"]+', '', 'g')) AS core,
  length(regexp_replace(t, '[^\d]', '', 'g')) / greatest(length(t), 1)::DOUBLE AS digits FROM src),
n1 AS (SELECT *, len(list_filter(ls, lambda l: regexp_matches({Q.strip('l')}, '^(?:[-*+]|\d+[.)]\s)'))) AS listed FROM n0),
n2 AS (SELECT *, (contains(t, '|') AND contains(t, chr(10)) AND len(ls) >= 2 AND len(list_filter(ls, lambda l: NOT contains(l, '|'))) = 0)
  OR contains(t, '```') OR (listed > 0 AND listed >= len(ls) * 0.5)
  OR (len(list_filter(ls, lambda l: starts_with({Q.strip('l')}, '#'))) > 0 AND len(list_filter(ls, lambda l: NOT starts_with({Q.strip('l')}, '#') AND {Q.strip('l')} <> '')) > 0) AS keep FROM n1)"""

SQL = {
    "heading_sections": f"""WITH {_HEADS} SELECT doc_id, CAST(i AS INT) AS i, CAST(level AS INT) AS level, text,
 regexp_replace(lower(text), ':+$', '') IN ({', '.join(repr(x) for x in H.APPENDIX)}) AS is_appendix FROM hs""",
    "heading_path": f"""WITH {_HEADS},
o AS (SELECT *, {', '.join(f"first_value(CASE WHEN level = {n} THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id, body ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f{n}" for n in (1, 2, 3))} FROM hs)
SELECT doc_id, CAST(i AS INT) AS i, {', '.join(f"CASE WHEN level = {n} THEN text WHEN level > {n} THEN f{n} END AS h{n}" for n in (1, 2, 3))} FROM o""",
    "parents_h123": "SELECT DISTINCT chunk_id, chunk_index, " + ", ".join(f"list_filter(parents, lambda p: p.level = {n})[1].text AS h{n}" for n in (1, 2, 3)) + " FROM chunks WHERE parents IS NOT NULL",
    "split_paragraphs": f"WITH {_PARAS} SELECT doc_id, CAST(i AS INT) AS i, sha1(p) AS digest FROM pp",
    "window_split": f"""WITH {_PARAS},
parts AS (SELECT doc_id, 0 AS i, text AS p, true AS whole FROM documents WHERE text IS NOT NULL AND greatest(1, length(text) // 4) <= 80
 UNION ALL SELECT pp.doc_id, i, p, greatest(1, length(p) // 4) <= 80 FROM pp JOIN documents d ON d.doc_id = pp.doc_id WHERE greatest(1, length(text) // 4) > 80),
w AS (SELECT doc_id, i, p, whole, {Q.words('p')} AS w FROM parts),
s AS (SELECT doc_id, i, p, whole, w, unnest(range(CASE WHEN whole OR len(w) <= 80 THEN 1 ELSE CAST(ceil((len(w) - 80) / 68.0) AS INT) + 1 END)) AS k FROM w)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INT) AS i, sha1(CASE WHEN whole THEN p ELSE array_to_string(w[k * 68 + 1:k * 68 + 80], ' ') END) AS digest FROM s""",
    "noise_filter": f"""WITH {_PARAS}, src AS (SELECT DISTINCT chunk_id AS k, chunk_text AS t FROM chunks WHERE chunk_text IS NOT NULL UNION ALL SELECT CAST(doc_id AS VARCHAR), p FROM pp), {_NOISE}
SELECT k AS chunk_id, count(*) FILTER (NOT keep AND (core < 5 OR (tokens < 80 AND core < 15) OR (digits > 0.4 AND core < 30))) AS noise, count(*) AS n FROM n2 GROUP BY k""",
    "accumulate_merge": f"""WITH RECURSIVE {_PARAS},
sz AS (SELECT doc_id, i, greatest(1, length(p) // 4) AS x, count(*) OVER (PARTITION BY doc_id) AS m FROM pp),
f AS (
  SELECT doc_id, i, m, x AS cur, '' AS sizes FROM sz WHERE i = 0
  UNION ALL
  SELECT f.doc_id, s.i, f.m, CASE WHEN (f.cur < 80 OR s.x < 80) AND f.cur + s.x <= 800 THEN f.cur + s.x ELSE s.x END,
         CASE WHEN (f.cur < 80 OR s.x < 80) AND f.cur + s.x <= 800 THEN f.sizes ELSE f.sizes || f.cur || ',' END
  FROM f JOIN sz s ON s.doc_id = f.doc_id AND s.i = f.i + 1)
SELECT d.doc_id, coalesce(f.sizes || f.cur, '') AS sizes FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d LEFT JOIN f ON f.doc_id = d.doc_id AND f.i = f.m - 1""",
    "chunk_stats": """SELECT doc_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, max(char_count) AS longest, count(*) FILTER (is_appendix) AS appendix, max(chunk_index) AS last_index
FROM (SELECT DISTINCT chunk_id, doc_id, chunk_index, token_count, char_count, is_appendix FROM chunks) GROUP BY doc_id""",
}
