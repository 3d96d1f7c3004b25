"""Document items: blocks, tables, layout, exports, scores, statistics (O19, O24, O25, O27-O29, K6, A4,
A5, A9, A11, J6).

Items are rows ``(doc, item_id, body_pos, kind, label, level, page_num, confidence, text, heading_level,
rows, headers, caption, ordered, children, ...)``; every export is an ordered aggregation per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellum.functions.quality import detect_heading, is_list_item, item_min_chars, score_quality
from vellum.functions.text import strip


def item_id(*parts: Column) -> Column:
    """Deterministic identity from document, page and place."""
    return F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12)


def layout_items(blocks: DataFrame) -> DataFrame:
    """Kind of each text block of ``(doc, page_num, block_no, text, font_size, is_bold)``, with
    ``list_no`` for runs of list lines; other kinds break a run. Blank blocks are left out."""
    kind = F.when(detect_heading(F.col("text"), F.col("font_size"), F.col("is_bold")).isNotNull(), "heading").when(is_list_item(F.col("text")), "list_text").otherwise("text")
    page = W.partitionBy("doc", "page_num").orderBy("block_no")
    rows = blocks.where(strip(F.coalesce("text", F.lit(""))) != "").withColumn("kind", kind).withColumn("heading_level", detect_heading(F.col("text"), F.col("font_size"), F.col("is_bold")))
    starts = (F.col("kind") == "list_text") & (F.coalesce(F.lag("kind").over(page), F.lit("")) != "list_text")
    rows = rows.withColumn("_s", F.when(starts, 1).otherwise(0))
    no = F.sum("_s").over(page.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("list_no", F.when(F.col("kind") == "list_text", no)).drop("_s").withColumn("item_id", item_id(F.col("doc"), F.col("page_num"), F.col("block_no")))


def median_font(blocks: DataFrame) -> DataFrame:
    """Upper median of the font sizes per page, 10.0 without any."""
    s = F.sort_array(F.collect_list(F.when(F.col("font_size") > 0, F.col("font_size"))))
    return blocks.groupBy("doc", "page_num").agg(F.coalesce(F.get(s, F.floor(F.size(s) / 2).cast("int")), F.lit(10.0)).alias("median_font"))


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))


def table_markdown(rows: Column, headers: Column, caption: Column) -> Column:
    """Markdown of a table item; without headers the rule comes first; no rows: empty."""
    rule = lambda a: _row(F.transform(a, lambda _: F.lit("---")))
    named = F.coalesce(F.size(headers), F.lit(0)) > 0
    head = F.when(named, F.array(_row(headers), rule(headers))).otherwise(F.array(rule(F.get(rows, F.lit(0)))))
    top = F.when(F.coalesce(caption, F.lit("")) != "", F.array(F.concat(F.lit("**"), caption, F.lit("**\n")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) == 0, F.lit("")).otherwise(F.array_join(F.concat(top, head, F.transform(rows, _row)), "\n"))


def table_text(rows: Column) -> Column:
    """Text of a table as it is judged: rows only."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


# --- blocks of a page: ``lines ARRAY<STRUCT<spans ARRAY<STRUCT<text, font, size, flags>>>>, bbox ARRAY<DOUBLE>``


def block_spans(lines: Column) -> Column:
    """All spans of a block in order; an empty array for a block without lines."""
    return F.flatten(F.filter(F.transform(lines, lambda l: l["spans"]), lambda s: s.isNotNull()))


def block_is_bold(lines: Column) -> Column:
    """A span whose font is named bold or whose second flag bit is set."""
    bold = lambda s: F.lower(F.coalesce(s["font"], F.lit(""))).contains("bold") | (F.coalesce(s["flags"], F.lit(0)).bitwiseAND(F.lit(2)) != 0)
    return F.coalesce(F.exists(block_spans(lines), bold), F.lit(False))


def block_font(lines: Column) -> Column:
    """Struct of the font and size of the first span; nulls without one."""
    first = F.get(block_spans(lines), F.lit(0))
    return F.struct(first["font"].alias("font_name"), first["size"].alias("font_size"))


def block_text(lines: Column) -> Column:
    """Spans of a line side by side, lines below each other, trimmed."""
    line = lambda l: F.array_join(F.transform(F.coalesce(l["spans"], F.array()), lambda s: F.coalesce(s["text"], F.lit(""))), "")
    return strip(F.coalesce(F.array_join(F.transform(lines, line), "\n"), F.lit("")))


def block_bbox(bbox: Column) -> Column:
    """Struct of the corners; zeros unless there are four."""
    four = F.coalesce(F.size(bbox) == 4, F.lit(False))
    return F.struct(*[F.when(four, F.get(bbox, F.lit(i)).cast("double")).otherwise(F.lit(0.0)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def table_item(data: Column) -> Column:
    """Struct of rows and headers of a raw table: cells trimmed, blank rows dropped, the first of
    several rows the header. Null without a row."""
    rows = drop_blank_rows(F.transform(data, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit(""))))))
    several = F.size(rows) > 1
    none = F.array().cast("array<string>")
    return F.when(F.size(rows) > 0, F.struct(F.when(several, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows).alias("rows"), F.when(several, F.get(rows, F.lit(0))).otherwise(none).alias("headers")))


def drop_blank_rows(rows: Column) -> Column:
    """Rows with at least one non-blank cell."""
    return F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))


def item_markdown() -> Column:
    """Markdown of one body item; null if it shows nothing."""
    t = F.col("text")
    return (
        F.when(F.col("kind") == "heading", F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.least("heading_level", F.lit(6))), F.lit(" "), t, F.lit("\n")))
        .when((F.col("kind") == "text") & (strip(t) != ""), t)
        .when(F.col("kind") == "table", F.nullif(F.concat(F.lit("\n"), table_markdown(F.col("rows"), F.col("headers"), F.col("caption")), F.lit("\n")), F.lit("\n\n")))
        .when(F.col("kind") == "picture", F.concat(F.lit("\n[Imagem: "), _alt(), F.lit("]\n")))
        .when((F.col("kind") == "list") & (F.size("child_texts") > 0), F.array_join(F.transform("child_texts", lambda c: F.concat(F.when(F.coalesce("ordered", F.lit(False)), "1. ").otherwise("- "), c)), "\n"))
    )


def _alt() -> Column:
    return F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.lit("Image"))


def item_html() -> Column:
    """HTML of one body item; null if it shows nothing."""
    t = F.col("text")
    cells = lambda tag: lambda r: F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), F.coalesce(c, F.lit("")), F.lit(f"</{tag}>"))), "\n")
    none = F.array().cast("array<string>")
    caption = F.when(F.coalesce("caption", F.lit("")) != "", F.array(F.concat(F.lit("<caption>"), F.col("caption"), F.lit("</caption>")))).otherwise(none)
    head = F.when(F.coalesce(F.size("headers"), F.lit(0)) > 0, F.array(F.lit("<thead><tr>"), cells("th")(F.col("headers")), F.lit("</tr></thead>"))).otherwise(none)
    body = F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.array_join(F.filter(F.array(F.lit("<tr>"), F.nullif(cells("td")(r), F.lit("")), F.lit("</tr>")), lambda x: x.isNotNull()), "\n"))
    table = F.array_join(F.concat(F.array(F.lit("<table>")), caption, head, F.array(F.lit("<tbody>")), body, F.array(F.lit("</tbody></table>"))), "\n")
    tag = F.when(F.coalesce("ordered", F.lit(False)), "ol").otherwise("ul")
    items = F.concat(F.array(F.concat(F.lit("<"), tag, F.lit(">"))), F.transform("child_texts", lambda c: F.concat(F.lit("<li>"), c, F.lit("</li>"))), F.array(F.concat(F.lit("</"), tag, F.lit(">"))))
    h = F.least("heading_level", F.lit(6)).cast("string")
    return (
        F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), h, F.lit(">"), t, F.lit("</h"), h, F.lit(">")))
        .when((F.col("kind") == "text") & (strip(t) != ""), F.concat(F.lit("<p>"), t, F.lit("</p>")))
        .when(F.col("kind") == "table", table)
        .when(F.col("kind") == "picture", F.concat(F.lit("<figure><figcaption>"), _alt(), F.lit("</figcaption></figure>")))
        .when(F.col("kind") == "list", F.array_join(items, "\n"))
    )


def child_items(items: DataFrame) -> DataFrame:
    """``(doc, parent, child_pos, kind, text)``: the items that others name as their children."""
    of = items.select("doc", F.col("item_id").alias("child"), "kind", "text")
    return children(items).join(of, ["doc", "child"]).select("doc", "parent", "child", "child_pos", "kind", "text")


def with_child_texts(items: DataFrame) -> DataFrame:
    """Items with ``child_texts``: the texts of their text children in order; empty without any. Only
    lists have children, so only their rows travel; a list is the unit of work."""
    none = F.array().cast("array<string>")
    if "children" not in items.columns:
        return items.withColumn("child_texts", none).withColumn("ordered", F.lit(False))
    c = child_items(items).where(F.col("kind").isin("text", "heading"))
    texts = c.groupBy("doc", F.col("parent").alias("item_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("child_pos", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))).alias("child_texts"))
    return items.join(texts, ["doc", "item_id"], "left").withColumn("child_texts", F.coalesce("child_texts", none))


def _in_order(items: DataFrame, shown: Column) -> DataFrame:
    """``(doc, parts)`` of what body items show, in order."""
    rows = with_child_texts(items).where(F.col("body_pos").isNotNull()).select("doc", "body_pos", shown.alias("m")).where("m is not null")
    return rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("body_pos", "m"))), lambda x: x["m"]).alias("parts"))


def document_html(items: DataFrame, title: str = "doc") -> DataFrame:
    """``(doc, html)`` of body items in order; ``title`` names the column of the title. A
    document without a shown item gives the empty page."""
    page = items.groupBy("doc").agg(F.first(title, True).alias("_t")) if title != "doc" else items.select("doc", F.col("doc").alias("_t")).distinct()
    full = page.join(_in_order(items, item_html()), "doc", "left")
    named = F.when(F.coalesce("_t", F.lit("")) != "", F.array(F.concat(F.lit("<title>"), F.col("_t"), F.lit("</title>")))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.array(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8">')), named, F.array(F.lit("</head><body>")), F.coalesce("parts", F.array().cast("array<string>")), F.array(F.lit("</body></html>")))
    return full.select("doc", F.array_join(parts, "\n").alias("html"))


def document_json(items: DataFrame) -> DataFrame:
    """K6: ``(doc, json)``: items in body order with their fields and the document's statistics. Fields
    that are null are left out; a document is the unit of work."""
    fields = [c for c in ("body_pos", "item_id", "kind", "page_num", "confidence", "text", "heading_level", "rows", "headers", "caption", "ordered", "children") if c in items.columns]
    own = items.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    stats = document_stats(items)
    both = own.join(stats, "doc")
    return both.select("doc", F.to_json(F.struct(F.col("doc").alias("filename"), F.col("items"), F.struct(*[c for c in stats.columns if c != "doc"]).alias("stats"))).alias("json"))


def items_of(items: DataFrame, page: int | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Items of a page, of some kinds, or both."""
    out = items if page is None else items.where(F.col("page_num") == page)
    return out if kinds is None else out.where(F.col("kind").isin(*kinds))


def body_items(items: DataFrame) -> DataFrame:
    """Items that stand in the body, with their ``place`` from 1 in each document."""
    w = W.partitionBy("doc").orderBy("body_pos")
    return items.where(F.col("body_pos").isNotNull()).withColumn("place", F.row_number().over(w))


def score_items(items: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Items with ``quality`` (score, char_count, alphanumeric_ratio, symbol_ratio, avg_line_length,
    acceptable) and their confidence overwritten by the score. Texts, headings and tables are judged,
    each from its own least length on; other kinds score 1.0."""
    judged = F.col("kind").isin("text", "heading", "table")
    text = F.when(F.col("kind") == "table", table_text(F.col("rows"))).otherwise(F.col("text"))
    q = items.withColumn("_q", score_quality(F.when(judged, text), F.col("confidence"), item_min_chars(F.col("kind"))))
    pick = lambda c, other: F.when(judged, F.col(f"_q.{c}")).otherwise(F.lit(other))
    score = pick("score", 1.0)
    quality = F.struct(score.alias("score"), pick("char_count", 0).alias("char_count"), *[pick(c, 0.0).alias(c) for c in ("alphanumeric_ratio", "symbol_ratio", "avg_line_length")], (score >= threshold).alias("acceptable"))
    return q.withColumn("quality", quality).withColumn("confidence", score).drop("_q")


def document_markdown(items: DataFrame) -> DataFrame:
    """``(doc, markdown)`` of body items in order; ordered aggregation per document."""
    return _in_order(items, item_markdown()).select("doc", F.array_join("parts", "\n").alias("markdown"))


def children(items: DataFrame) -> DataFrame:
    """``(doc, parent, child, child_pos)``."""
    return items.select("doc", F.col("item_id").alias("parent"), F.posexplode("children").alias("child_pos", "child"))


def document_stats(items: DataFrame) -> DataFrame:
    """A4, A5: counts per kind, characters, mean confidence (0.0 without items)."""
    k = lambda *names: F.count_if(F.col("kind").isin(*names))
    return items.groupBy("doc").agg(
        F.count_distinct("page_num").alias("pages"), F.count("*").alias("total_items"), k("text", "heading").alias("text_items"), k("table").alias("table_items"),
        k("picture").alias("picture_items"), F.coalesce(F.sum(F.when(F.col("kind").isin("text", "heading"), F.length("text"))), F.lit(0)).alias("total_chars"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("overall_confidence"),
    )


def quality_summary(scored: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Items at and under the threshold per document."""
    return scored.groupBy("doc").agg(F.count("*").alias("total_items"), F.count_if(F.col("score") >= threshold).alias("ok_items"), F.count_if(F.col("score") < threshold).alias("low_items"))
