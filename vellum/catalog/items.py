"""Queries of document items, page readings and page results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.catalog import documents as D, sqlparts as Q
from vellum.operators import docmodel as M, generation as G, pages as P


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Items of the pages with an id, and on each page a list of its first two lines."""
    i = D._items(spark, d).withColumn("item_id", F.concat_ws("-", "doc", "page_num", (F.col("body_pos") % 100_000).cast("string"))).withColumn("children", F.lit(None).cast("array<string>"))
    pages = i.select("doc", "page_num").distinct()
    name = lambda n: F.concat_ws("-", "doc", "page_num", F.lit(n))
    lists = pages.select(
        "doc", "page_num", F.lit("list").alias("kind"), (F.col("page_num") * 100_000 + 99_999).alias("body_pos"), F.lit(1.0).alias("confidence"), (F.col("page_num") % 2 == 0).alias("ordered"), name("list").alias("item_id"), F.array(name("0"), name("1"), name("x")).alias("children")
    )
    return i.unionByName(lists, allowMissingColumns=True)


def document_html(spark: SparkSession, d: str) -> DataFrame:
    return M.document_html(_items(spark, d)).select("doc", F.sha1("html").alias("digest"))


def document_markdown_lists(spark: SparkSession, d: str) -> DataFrame:
    return M.document_markdown(_items(spark, d)).select("doc", F.sha1("markdown").alias("digest"))


def document_json(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON, read back to count and sum."""
    j = M.document_json(_items(spark, d)).select("doc", F.from_json("json", "filename string, items array<struct<kind:string,text:string,children:array<string>>>, stats struct<total_items:bigint,text_items:bigint,total_chars:bigint>").alias("j"))
    chars = F.aggregate("j.items", F.lit(0), lambda a, x: a + F.coalesce(F.length(x["text"]), F.lit(0)))
    return j.select("doc", F.col("j.filename").alias("filename"), F.size("j.items").alias("items"), chars.alias("chars"), F.size(F.filter("j.items", lambda x: x["kind"] == "list")).alias("lists"), "j.stats.total_items", "j.stats.text_items", "j.stats.total_chars")


def child_items(spark: SparkSession, d: str) -> DataFrame:
    return M.child_items(_items(spark, d)).select("doc", "parent", "child", "child_pos", "kind")


def items_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Tables and pictures of first pages."""
    return M.items_of(_items(spark, d), 1, ("table", "picture")).select("doc", "item_id", "kind")


def body_items(spark: SparkSession, d: str) -> DataFrame:
    return M.body_items(_items(spark, d)).select("doc", "item_id", "place")


def item_quality(spark: SparkSession, d: str) -> DataFrame:
    s = M.score_items(_items(spark, d))
    return s.select("doc", "item_id", "kind", D._six("quality.score").alias("score"), "quality.char_count", "quality.acceptable", D._six("confidence").alias("confidence"))


def item_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    """A11 over scored items."""
    return M.quality_summary(M.score_items(_items(spark, d)).withColumn("score", F.col("quality.score")))


_BLOCK = "array(named_struct('spans', array(named_struct('text', p_name, 'font', if(p_partkey % 3 = 0, 'Arial-BoldMT', p_brand), 'size', double(p_size), 'flags', int(p_partkey % 8)), named_struct('text', p_type, 'font', cast(null as string), 'size', 1.0D, 'flags', cast(null as int)))), named_struct('spans', if(p_partkey % 5 = 0, null, array(named_struct('text', concat(p_brand, '  '), 'font', 'x', 'size', 2.0D, 'flags', 0)))))"


def block_helpers(spark: SparkSession, d: str) -> DataFrame:
    """O27 over blocks of two lines made of parts."""
    p = D.table(spark, d, "part").select("p_partkey", F.expr(_BLOCK).alias("l"), F.expr("slice(array(p_size, 1, 2, 3), 1, if(p_partkey % 4 = 0, 3, 4))").alias("b"))
    return p.select("p_partkey", M.block_is_bold(F.col("l")).alias("bold"), M.block_font(F.col("l"))["font_name"].alias("font"), M.block_font(F.col("l"))["font_size"].alias("size"), M.block_text(F.col("l")).alias("text"), M.block_bbox(F.col("b"))["x0"].alias("x0"), M.block_bbox(F.col("b"))["y1"].alias("y1"))


def table_headers(spark: SparkSession, d: str) -> DataFrame:
    """O25 over tables of a blank row, a row of a part and, for two parts in three, another."""
    data = F.expr("concat(array(array(' ', null)), array(array(concat(' ', p_name, ' '), p_brand)), if(p_partkey % 3 = 0, array(), array(array(p_type, null))))")
    t = D.table(spark, d, "part").select("p_partkey", M.table_item(data).alias("t"))
    return t.select("p_partkey", F.array_join("t.headers", "|").alias("headers"), F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "|")), "/").alias("rows"))


def fallback_cascade(spark: SparkSession, d: str) -> DataFrame:
    """O21 in its modes; a page's recognised text is the classic reading, without its digits the fallback."""
    p = D._pages(spark, d).withColumn("ai_text", F.regexp_replace("ocr_text", "[0-9]", ""))
    classic, ai = P.Reading("tesseract", "ocr_text", "confidence"), P.Reading("ai", "ai_text")
    out = p.select("doc", "page_num", F.sha1(F.coalesce("ocr_text", F.lit(""))).alias("page"), *[P.resolve(F.col("native_text"), [classic], ai, m).alias(m) for m in ("hybrid", "classic_only", "ai_only")], P.resolve(F.col("native_text"), [classic], None).alias("alone"))
    return out.select("doc", "page_num", "page", "hybrid.engine", F.sha1("hybrid.text").alias("digest"), "hybrid.status", F.col("classic_only.engine").alias("classic"), F.col("ai_only.engine").alias("ai"), F.col("alone.engine").alias("alone"))


def _partials(spark: SparkSession, d: str) -> DataFrame:
    """Recognised pages as results of two runs: the first fails on every third page, the second does
    every sixth again."""
    p = D.table(spark, d, "engine_pages").where("doc is not null and page_num is not null").groupBy("doc", F.col("page_num").alias("page")).agg(F.max("ocr_text").alias("t"))
    p = p.withColumn("format", F.explode(F.array(F.lit("markdown"), F.lit("json")))).withColumn("content", F.coalesce("t", F.lit("")))
    first = p.select("doc", "page", "format", F.when(F.col("page") % 3 != 0, F.col("content")).alias("content"), F.when(F.col("page") % 3 == 0, "failed").otherwise("ok").alias("status"), F.lit(1).cast("bigint").alias("run_id"))
    second = p.where("page % 6 = 0").select("doc", "page", "format", "content", F.lit("ok").alias("status"), F.lit(2).cast("bigint").alias("run_id"))
    return first.unionByName(second)


def page_consolidate(spark: SparkSession, d: str) -> DataFrame:
    return P.consolidate(_partials(spark, d)).select("doc", "format", F.sha1("content").alias("digest"), "pages")


def pages_pending(spark: SparkSession, d: str) -> DataFrame:
    pages = D.table(spark, d, "engine_pages").where("doc is not null and page_num is not null").select("doc", F.col("page_num").alias("page"))
    return P.pending(pages, _partials(spark, d), ["markdown", "json"])


def answer_with_sources(spark: SparkSession, d: str) -> DataFrame:
    q, h = D._evidence(spark, d)
    a = G.sources_block(q, h).withColumn("text", F.concat(F.lit("A"), F.col("query_id").cast("string")))
    return G.answer_with_sources(a).select("query_id", F.sha1("text").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (document_html, document_markdown_lists, document_json, child_items, items_by_class, body_items, item_quality, item_quality_summary, block_helpers, table_headers, fallback_cascade, page_consolidate, pages_pending, answer_with_sources)
}

_LIST = f"""{D._ITEMS}, pp AS (SELECT DISTINCT doc, page_num FROM it),
ch AS (SELECT doc, page_num, block_no, text FROM it WHERE block_no < 2 AND kind IN ('text', 'heading')),
kids AS (SELECT pp.doc, pp.page_num, string_agg(CASE WHEN pp.page_num % 2 = 0 THEN '1. ' ELSE '- ' END || ch.text, chr(10) ORDER BY block_no) AS md, string_agg('<li>' || ch.text || '</li>', chr(10) ORDER BY block_no) AS li
 FROM pp JOIN ch ON ch.doc = pp.doc AND ch.page_num = pp.page_num GROUP BY ALL)"""
_ID = "doc || '-' || page_num || '-' || block_no"
_ALL = f"""al AS (SELECT doc, page_num, {_ID} AS item_id, kind, page_num * 100000 + block_no AS p, text, confidence FROM it UNION ALL SELECT doc, page_num, doc || '-' || page_num || '-list', 'list', page_num * 100000 + 99999, NULL, 1.0::DOUBLE FROM pp)"""
_SCORED = f"""src AS (SELECT doc, item_id, kind, CASE WHEN kind = 'table' THEN text || ' | x' WHEN kind IN ('text', 'heading') THEN text ELSE '' END AS t, coalesce(confidence, 1.0) AS cf FROM al),
{D._score_ctes('src').replace("< 20 AS short", "< CASE kind WHEN 'heading' THEN 5 WHEN 'table' THEN 10 ELSE 20 END AS short")},
fin AS (SELECT doc, item_id, kind, CASE WHEN kind IN ('text', 'heading', 'table') THEN score ELSE 1.0::DOUBLE END AS score, CAST(CASE WHEN kind IN ('text', 'heading', 'table') THEN length(t) ELSE 0 END AS INT) AS char_count FROM sc)"""
_PART = """pt AS (SELECT doc, page_num AS page, coalesce(max(ocr_text), '') AS content FROM engine_pages WHERE doc IS NOT NULL AND page_num IS NOT NULL GROUP BY ALL)"""
_NT = Q.strip("coalesce(native_text, '')")
_OT = Q.strip("coalesce(ocr_text, '')")

SQL = {
    "document_html": f"""WITH {_LIST}, m AS (SELECT doc, page_num * 100000 + block_no AS p, CASE WHEN kind = 'heading' THEN '<h' || least(lv, 6) || '>' || text || '</h' || least(lv, 6) || '>' WHEN kind = 'text' AND s <> '' THEN '<p>' || text || '</p>'
  WHEN kind = 'table' THEN '<table>' || chr(10) || CASE WHEN caption IS NOT NULL THEN '<caption>cap</caption>' || chr(10) ELSE '' END || '<thead><tr>' || chr(10) || '<th>h</th>' || chr(10) || '<th>i</th>' || chr(10) || '</tr></thead>' || chr(10) || '<tbody>' || chr(10)
   || '<tr>' || chr(10) || '<td>' || text || '</td>' || chr(10) || '<td>x</td>' || chr(10) || '</tr>' || chr(10) || '</tbody></table>'
  WHEN kind = 'picture' THEN '<figure><figcaption>' || coalesce(caption, 'Image') || '</figcaption></figure>' END AS m FROM it
 UNION ALL SELECT pp.doc, pp.page_num * 100000 + 99999, CASE WHEN pp.page_num % 2 = 0 THEN '<ol>' ELSE '<ul>' END || chr(10) || coalesce(li || chr(10), '') || CASE WHEN pp.page_num % 2 = 0 THEN '</ol>' ELSE '</ul>' END FROM pp LEFT JOIN kids k ON k.doc = pp.doc AND k.page_num = pp.page_num)
SELECT doc, sha1('<!DOCTYPE html><html><head><meta charset="utf-8">' || chr(10) || '<title>' || doc || '</title>' || chr(10) || '</head><body>' || chr(10) || string_agg(m, chr(10) ORDER BY p) || chr(10) || '</body></html>') AS digest FROM m WHERE m IS NOT NULL AND doc IS NOT NULL GROUP BY doc""",
    "document_markdown_lists": D.SQL["document_markdown"].replace(D._ITEMS, _LIST).replace(" END AS m FROM it)", " END AS m FROM it UNION ALL SELECT doc, page_num * 100000 + 99999, md FROM kids)"),
    "document_json": f"""WITH {_LIST}, {_ALL} SELECT doc, doc AS filename, CAST(count(*) AS INT) AS items, CAST(coalesce(sum(length(text)), 0) AS INT) AS chars, CAST(count(*) FILTER (kind = 'list') AS INT) AS lists, count(*) AS total_items,
 count(*) FILTER (kind IN ('text', 'heading')) AS text_items, CAST(coalesce(sum(CASE WHEN kind IN ('text', 'heading') THEN length(text) END), 0) AS BIGINT) AS total_chars FROM al GROUP BY doc""",
    "child_items": f"WITH {_LIST} SELECT doc, doc || '-' || page_num || '-list' AS parent, {_ID} AS child, CAST(block_no AS INT) AS child_pos, kind FROM it WHERE block_no < 2",
    "items_by_class": f"WITH {_LIST}, {_ALL} SELECT doc, item_id, kind FROM al WHERE page_num = 1 AND kind IN ('table', 'picture')",
    "body_items": f"WITH {_LIST}, {_ALL} SELECT doc, item_id, CAST(row_number() OVER (PARTITION BY doc ORDER BY p) AS INT) AS place FROM al",
    "item_quality": f"WITH {_LIST}, {_ALL}, {_SCORED} SELECT doc, item_id, kind, round(score + 1e-9::DOUBLE, 6) AS score, char_count, score >= 0.7::DOUBLE AS acceptable, round(score + 1e-9::DOUBLE, 6) AS confidence FROM fin",
    "item_quality_summary": f"WITH {_LIST}, {_ALL}, {_SCORED} SELECT doc, count(*) AS total_items, count(*) FILTER (score >= 0.7::DOUBLE) AS ok_items, count(*) FILTER (score < 0.7::DOUBLE) AS low_items FROM fin GROUP BY doc",
    "block_helpers": f"""SELECT p_partkey, p_partkey % 3 = 0 OR contains(lower(p_brand), 'bold') OR (p_partkey % 8) & 2 <> 0 AS bold, CASE WHEN p_partkey % 3 = 0 THEN 'Arial-BoldMT' ELSE p_brand END AS font, p_size::DOUBLE AS size,
 {Q.strip("p_name || p_type || chr(10) || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand || '  ' END")} AS text, CASE WHEN p_partkey % 4 = 0 THEN 0.0::DOUBLE ELSE p_size::DOUBLE END AS x0, CASE WHEN p_partkey % 4 = 0 THEN 0.0::DOUBLE ELSE 3.0::DOUBLE END AS y1 FROM part""",
    "table_headers": f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE {Q.strip('p_name')} || '|' || {Q.strip('p_brand')} END AS headers, CASE WHEN p_partkey % 3 = 0 THEN {Q.strip('p_name')} || '|' || {Q.strip('p_brand')} ELSE {Q.strip('p_type')} || '|' END AS rows FROM part""",
    "fallback_cascade": f"""WITH {D._PAGES}, src AS (SELECT doc, page_num, native_text, ocr_text, {_NT} AS nt, {_OT} AS t, coalesce(confidence, 1.0) AS cf FROM pg), {D._score_ctes('src')},
w AS (SELECT *, {D._words('nt')} AS nw, {D._words('t')} AS ow, {D._numbers('nt')} AS nn, {D._numbers('t')} AS onn FROM sc),
v AS (SELECT *, ocr_text IS NOT NULL AND CASE WHEN length(nt) >= 20 THEN len(list_intersect(nw, ow)) / greatest(len(nw), 1)::DOUBLE * 0.7::DOUBLE + CASE WHEN len(nn) = 0 THEN 1 ELSE len(list_intersect(nn, onn)) / len(nn)::DOUBLE END * 0.3::DOUBLE ELSE score END >= 0.7::DOUBLE AS good FROM w)
SELECT doc, page_num, sha1(coalesce(ocr_text, '')) AS page, CASE WHEN length(nt) >= 50 THEN 'native' WHEN good THEN 'tesseract' ELSE 'ai' END AS engine,
 sha1(CASE WHEN length(nt) >= 50 THEN native_text WHEN good THEN ocr_text ELSE regexp_replace(ocr_text, '[0-9]', '', 'g') END) AS digest,
 CASE WHEN length(nt) < 50 AND ocr_text IS NULL THEN 'failed' ELSE 'ok' END AS status, 'tesseract' AS classic, 'ai' AS ai, CASE WHEN length(nt) >= 50 THEN 'native' WHEN good THEN 'tesseract' END AS alone FROM v""",
    "page_consolidate": f"""WITH {_PART}, ok AS (SELECT * FROM pt WHERE page % 3 <> 0 OR page % 6 = 0), f AS (SELECT doc, unnest(['markdown', 'json']) AS format, page, content FROM ok)
SELECT doc, format, sha1(CASE WHEN format = 'json' THEN '[' || chr(10) || coalesce(string_agg(content, ',' || chr(10) ORDER BY page) FILTER (content <> ''), '') || chr(10) || ']' ELSE coalesce(string_agg(content, chr(10) || chr(10) ORDER BY page) FILTER (content <> ''), '') END) AS digest, count(*) AS pages FROM f GROUP BY doc, format""",
    "pages_pending": f"WITH {_PART} SELECT doc, page, unnest(['markdown', 'json']) AS format FROM pt WHERE page % 3 = 0 AND page % 6 <> 0",
    "answer_with_sources": f"WITH {D._EV}, {D._SOURCES} SELECT qs.query_id, sha1('A' || qs.query_id || chr(10) || chr(10) || coalesce(s, 'Sources: (none)')) AS digest FROM qs LEFT JOIN s ON s.query_id = qs.query_id",
}
