"""Prompts, conversions, text quality and document items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.catalog import search as CS, sqlparts as Q
from vellum.functions import convert as V, quality as U
from vellum.operators import docmodel as M, generation as G, search as S
from vellum.runtime import table

# --- generation ------------------------------------------------------------------------------


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = CS.asked(spark, d).withColumn("text", F.concat(F.lit("Q"), F.col("query_id").cast("string")))
    return q, S.post_filter(CS.hits(spark, d), ["norma", "interno"], 0.02)


def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    q, h = _evidence(spark, d)
    return G.build_prompts(q, h, limit=70).select("query_id", "user")


def sources_block(spark: SparkSession, d: str) -> DataFrame:
    q, h = _evidence(spark, d)
    return G.sources_block(q, h)


def answer_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of answers whose text is the best snippet, with a marker in every fifth."""
    q, h = _evidence(spark, d)
    best = h.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("c"), F.min(F.struct("place", "snippet")).alias("b"))
    r = q.join(best, "query_id", "left")
    mark = F.when(F.col("query_id") % 5 == 0, F.lit(" CONFLITO")).when(F.col("query_id") % 7 == 0, F.lit(" Não encontrei.")).otherwise(F.lit(""))
    text = F.concat(F.coalesce("b.snippet", F.lit("")), mark)
    return r.select("query_id", *G.answer_flags(text, F.coalesce("n", F.lit(0)), F.coalesce("c", F.lit(0.0))))


def display_answer(spark: SparkSession, d: str) -> DataFrame:
    q, h = _evidence(spark, d)
    s = G.sources_block(q, h)
    return s.select("query_id", F.sha1(G.display(F.lit("x"), F.col("sources"), F.col("query_id") % 3 == 0, F.col("query_id") % 2 == 0)).alias("digest"))


# --- conversions -----------------------------------------------------------------------------


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents_md").where("body is not null").select("doc_id", "body", "title", "tags").distinct()


def _convert(rule) -> object:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _bodies(spark, d).select("doc_id", F.sha1(rule(F.col("body"))).alias("digest")).distinct()

    return run


def _rows_html(df: DataFrame) -> Column:
    """An HTML table of a row's cells, made from part rows."""
    return F.expr("concat('<table class=\"x\"><tr><th>name</th><th>brand</th></tr><tr><td>', p_name, '</td><td> <b>', p_brand, '</b> </td></tr></table>')")


def html_table_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", V.html_table_to_markdown(_rows_html(p)).alias("md"))


_DOCTAGS = "concat('<doctag><section_header><loc_1>', p_name, '</section_header><text>a <loc_3>b</text>  \\n<unordered_list><list_item><loc_2>', p_brand, '</list_item><list_item> z </list_item></unordered_list><page_header>h</page_header><table><table_row><table_cell>', p_type, '</table_cell><table_cell><loc_4>', cast(p_size as string), '</table_cell></table_row><table_row><table_cell>c</table_cell></table_row></table><page_footer>f</page_footer></doctag>')"


def doctags_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", V.doctags_to_markdown(F.expr(_DOCTAGS)).alias("md"))


def strip_reasoning(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("concat('The user wants text\\n\\n  Here is the page:\\n', body)")
    return _bodies(spark, d).select("doc_id", F.sha1(V.strip_reasoning(t)).alias("digest")).distinct()


def strip_repetition(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("concat(body, '\\n', repeat('Uma linha que se repete.\\n', 9), 'fim')")
    return _bodies(spark, d).select("doc_id", F.sha1(V.strip_repetition(t)).alias("digest")).distinct()


def strip_metadata(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("""concat('[{"label": "t", "bbox": [1, 2]}, {"label": "u", "bbox": [3]}]\\n', body)""")
    return _bodies(spark, d).select("doc_id", F.sha1(V.strip_metadata_prefix(t)).alias("digest")).distinct()


def strip_det(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("concat('<|det|>a b<|/det|>', body, '<|/det|>\\n\\n\\n\\nx')")
    return _bodies(spark, d).select("doc_id", F.sha1(V.strip_det_format(t)).alias("digest")).distinct()


def content_kind(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d).select("doc_id", V.is_html(F.col("body")).alias("html"), V.is_doctags(F.col("body")).alias("doctags")).distinct()


def clean_output(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d).select("doc_id", F.sha1(V.clean_output(F.col("body"))).alias("digest")).distinct()


def csv_to_pipes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select("n_nationkey", V.row_to_pipes(F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")).alias("line"))


# --- quality ---------------------------------------------------------------------------------


def _six(c: Column | str) -> Column:
    """Six places; the shift keeps exact halves, which engines round differently, from the edge."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "engine_pages").select("doc", "page_num", "native_text", F.regexp_replace("ocr_text", "\r\n?", "\n").alias("ocr_text"), "confidence")
    return p.distinct()


def word_set(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("ocr_text is not null").select("doc", "page_num", F.array_join(F.array_sort(U.word_set(F.col("ocr_text"))), " ").alias("words"))


def number_set(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("ocr_text is not null").select("doc", "page_num", F.array_join(F.array_sort(U.number_set(F.col("ocr_text"))), " ").alias("numbers"))


def content_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).where("native_text is not null and ocr_text is not null").select("doc", "page_num", U.overlap(F.col("native_text"), F.col("ocr_text")).alias("o"))
    return p.select("doc", "page_num", "o.word_recall_pct", "o.num_recall_pct", "o.native_words", "o.shared_words", "o.native_numbers", "o.shared_numbers", "o.output_headings")


def completeness_check(spark: SparkSession, d: str) -> DataFrame:
    o = content_overlap(spark, d)
    return o.select("doc", "page_num", U.completeness(F.col("word_recall_pct"), F.col("num_recall_pct"), F.col("native_words"), F.col("native_numbers")).alias("complete"))


def quality_score(spark: SparkSession, d: str) -> DataFrame:
    q = _pages(spark, d).select("doc", "page_num", U.score_quality(F.col("ocr_text"), F.col("confidence")).alias("q"))
    r = lambda c: _six(f"q.{c}").alias(c)
    return q.select("doc", "page_num", *[r(c) for c in ("score", "alphanumeric_ratio", "symbol_ratio", "avg_line_length", "empty_line_ratio", "diacritic_ratio")], "q.char_count", "q.has_repeated_chars")


def diacritic_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", _six(U.diacritic_ratio(F.col("text"))).alias("ratio"), U.is_portuguese(F.col("text")).alias("portuguese"))


def table_quality(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d).select("doc_id", U.looks_like_table(F.col("body")).alias("is_table"), _six(U.table_quality(F.col("body"))).alias("quality")).distinct()


def numeric_density(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("ocr_text is not null").select("doc", "page_num", _six(U.numeric_density(F.col("ocr_text"))).alias("density"))


def router_decision(spark: SparkSession, d: str) -> DataFrame:
    r = _pages(spark, d).select("doc", "page_num", U.route(F.col("native_text"), F.col("ocr_text"), F.col("confidence"), 0.7).alias("r"))
    return r.select("doc", "page_num", "r.method", _six("r.value").alias("value"), "r.accepted")


def native_text_check(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc", "page_num", U.has_meaningful_text(F.col("native_text")).alias("ok"))


def page_confidence(spark: SparkSession, d: str) -> DataFrame:
    """A4, A10: mean of the positive confidences per document, 0 without any."""
    c = F.when(F.col("confidence") > 0, F.col("confidence"))
    return table(spark, d, "engine_pages").distinct().groupBy("doc").agg(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias("confidence"), F.count("*").alias("pages"))


def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quality_report").where("score is not null").select("doc", "page_num", "score", "measured_at").distinct()
    return M.quality_summary(q)


# --- layout and items ------------------------------------------------------------------------


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the pages as text blocks, with a font size and weight derived from their place."""
    p = _pages(spark, d).where("ocr_text is not null").groupBy("doc", "page_num").agg(F.max("ocr_text").alias("t"))
    b = p.select("doc", "page_num", F.posexplode(F.split("t", "\n", -1)).alias("block_no", "text"))
    return b.withColumn("font_size", (F.lit(8) + F.col("block_no") % 11).cast("double")).withColumn("is_bold", F.col("block_no") % 4 == 0)


def heading_detect(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("doc", "page_num", "block_no", U.detect_heading(F.col("text"), F.col("font_size"), F.col("is_bold")).alias("level"))


def list_item_detect(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("doc", "page_num", "block_no", U.is_list_item(F.col("text")).alias("item"))


def layout_items(spark: SparkSession, d: str) -> DataFrame:
    return M.layout_items(_blocks(spark, d)).select("doc", "page_num", "block_no", "kind", F.col("list_no").cast("int").alias("list_no"), "item_id")


def median_font(spark: SparkSession, d: str) -> DataFrame:
    return M.median_font(_blocks(spark, d))


def table_item_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(F.array("p_name", "p_brand"), F.array("p_type", F.col("p_size").cast("string")))
    heads = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", M.table_markdown(rows, heads, F.when(F.col("p_partkey") % 3 == 0, F.lit("Parts"))).alias("md"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Layout blocks as body items, and each page's first row as a picture."""
    b = _blocks(spark, d)
    kind = F.when(F.col("block_no") == 0, "heading").when(F.col("block_no") % 9 == 5, "picture").when(F.col("block_no") % 9 == 7, "table").otherwise("text")
    none = F.lit(None)
    return b.select(
        "doc", "page_num", kind.alias("kind"), (F.col("page_num") * 100_000 + F.col("block_no")).alias("body_pos"), "text", (F.col("page_num") % 8 + 1).cast("int").alias("heading_level"),
        F.array(F.array("text", F.lit("x"))).alias("rows"), F.array(F.lit("h"), F.lit("i")).alias("headers"), F.when(F.col("block_no") % 2 == 1, F.lit("cap")).otherwise(none.cast("string")).alias("caption"), (F.col("font_size") / 20).alias("confidence"),
    )


def document_markdown(spark: SparkSession, d: str) -> DataFrame:
    return M.document_markdown(_items(spark, d)).select("doc", F.sha1("markdown").alias("digest"))


def document_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.document_stats(_items(spark, d))


def items_by_page(spark: SparkSession, d: str) -> DataFrame:
    """Items per page and kind."""
    return _items(spark, d).groupBy("doc", "page_num", "kind").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        prompt_context, sources_block, answer_flags, display_answer, html_table_to_markdown, doctags_to_markdown, strip_reasoning, strip_repetition, strip_metadata, strip_det,
        content_kind, clean_output, csv_to_pipes, word_set, number_set, content_overlap, completeness_check, quality_score, diacritic_ratio, table_quality, numeric_density,
        router_decision, native_text_check, page_confidence, quality_summary, heading_detect, list_item_detect, layout_items, median_font, table_item_markdown,
        document_markdown, document_stats, items_by_page,
    )
} | {
    "html_to_text": _convert(V.html_to_text),
    "html_to_markdown": _convert(V.html_to_markdown),
    "strip_html_attrs": _convert(V.strip_html_attrs),
    "latex_strip": _convert(V.latex_to_text),
    "extract_html": _convert(V.extract_html),
    "trailing_commentary": _convert(V.strip_trailing_commentary),
}

# --- SQL -------------------------------------------------------------------------------------

_EV = f"""{CS._hits()}, {CS._post('r', tags="'norma', 'interno'", threshold=0.02)}, qs AS ({CS._QS})"""


def _path(sep: str) -> str:
    return f"coalesce(nullif(array_to_string(list_filter([h1, h2, h3], lambda x: x IS NOT NULL AND x <> ''), '{sep}'), ''), '(sem secao)')"


_SHORT = "CASE WHEN length(coalesce(snippet, '')) <= 70 THEN coalesce(snippet, '') ELSE regexp_replace(left(snippet, 70), '(?s) [^ ]*$', '') || ' […]' END"
_SOURCES = f"""s AS (SELECT query_id, 'Sources:' || chr(10) || string_agg(printf('[%d] %s — %s (chunk_id=%s, score=%.3f)', place, coalesce(file_name, ''), {_path(' / ')}, chunk_id, floor(score * 1000 + 0.5::DOUBLE) / 1000), chr(10) ORDER BY place) AS s FROM r GROUP BY query_id)"""


def _digest(expression: str, ctes: str = "") -> str:
    with_ = f"WITH {ctes} " if ctes else ""
    return f"{with_}SELECT DISTINCT doc_id, sha1({expression}) AS digest FROM documents_md WHERE body IS NOT NULL"


def _subs(x: str, rules: list[tuple[str, str]]) -> str:
    for p, r in rules:
        x = f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', {r}, 'g')"
    return x


_NL2 = "chr(10) || chr(10)"
_ATTRS = [(r'\sdata-[a-zA-Z_-]+="[^"]*"', "''"), (r"\sdata-[a-zA-Z_-]+='[^']*'", "''"), (r"""\s(?:class|style|id|data)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "''")]


def _table_sql(x: str) -> str:
    """Markdown of a table's inner HTML."""
    rows = f"regexp_extract_all({x}, '(?s)<tr[^>]*>(.*?)</tr>', 1)"
    cells = "regexp_extract_all(r, '(?s)<t[dh][^>]*>(.*?)</t[dh]>', 1)"
    shown = f"'| ' || array_to_string(list_transform({cells}, lambda c: {Q.strip(_subs('c', [('<[^>]+>', chr(39) * 2)]))}), ' | ') || ' |'"
    rule = f"'| ' || array_to_string(list_transform({cells}, lambda c: '---'), ' | ') || ' |'"
    head = f"list_position(list_transform({rows}, lambda r: regexp_matches(r, '(?i)<th')), true)"
    line = f"CASE WHEN i = {head} THEN {shown} || chr(10) || {rule} ELSE {shown} END"
    return f"CASE WHEN len({rows}) = 0 THEN {x} ELSE array_to_string(list_transform({rows}, lambda r, i: {line}), chr(10)) || chr(10) END"


def _between(x: str, pattern: str, inner: str) -> str:
    """Each match of ``pattern`` replaced by ``inner`` of its group ``g``."""
    outside = pattern.replace("(.*?)", ".*?")
    return f"""array_to_string(list_transform(regexp_split_to_array({x}, '{outside}'), lambda o, j: o || CASE WHEN j <= len(regexp_extract_all({x}, '{pattern}', 1)) THEN {inner.replace('@g', f"regexp_extract_all({x}, '{pattern}', 1)[j]")} ELSE '' END), '')"""


def _html_markdown() -> str:
    steps = ["a0 AS (SELECT DISTINCT doc_id, " + _subs("body", _ATTRS) + " AS t FROM documents_md WHERE body IS NOT NULL)"]

    def add(e: str) -> None:
        steps.append(f"a{len(steps)} AS (SELECT doc_id, {e} AS t FROM a{len(steps) - 1})")

    for tag in ("table", "div", "ol", "ul", "p", "pre"):
        add(f"CASE WHEN contains(t, '<{tag}') AND NOT contains(t, '</{tag}>') THEN t || '</{tag}>' ELSE t END")
    add("CASE WHEN contains(t, '<tr') AND NOT contains(t, '<table') THEN '<table>' || t || '</table>' ELSE t END")
    for n in range(1, 7):
        add(_subs("t", [(rf"(?s)<h{n}[^>]*>(.*?)</h{n}>", rf"'{'#' * n} \1'")]))
    add(_between("t", "(?s)<table[^>]*>(.*?)</table>", _table_sql("@g")))
    add(_subs("t", [(r"(?s)<li[^>]*>(.*?)</li>", r"'- \1'"), (r"</?(?:ul|ol)[^>]*>", "''"), (r"<br\s*/?>\s*<br\s*/?>", _NL2), (r"<br\s*/?>", "chr(10)")]))
    p = Q.squeeze("@g")
    add(_between("t", "(?s)<p[^>]*>(.*?)</p>", f"CASE WHEN {p} = '' THEN '' ELSE {p} || chr(10) END"))
    for tag, dot in (("div", "(?s)"), ("span", "(?s)"), ("a", "")):
        add(_subs("t", [(rf"{dot}<{tag}[^>]*>(.*?)</{tag}>", r"'\1'")]))
    add(_subs("t", [(r'<img[^>]*alt="([^"]*)"[^>]*/>', r"'[Imagem: \1]'"), (r"<img[^>]*/>", "''")]))
    for tag, a, b in (("strong", "'**", "**'"), ("b", "'**", "**'"), ("em", "'*", "*'"), ("i", "'*", "*'"), ("code", "'`", "`'"), ("pre", "'```' || chr(10) || '", "' || chr(10) || '```'"), ("th", "'", "'"), ("td", "'", "'")):
        add(_subs("t", [(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", rf"{a}\1{b}")]))
    add(_subs("t", [(r"</?tr[^>]*>", "chr(10)"), (r"</?(?:thead|tbody|caption)[^>]*>", "''"), (r"</?h[1-6][^>]*>", "''"), (r"<[^>]+>", "''"), (r"  +", "' '"), (r"\n{3,}", _NL2), (r"\n[ \t]+\n", _NL2), (r"[ \t]+\n", "chr(10)")]))
    return f"WITH {', '.join(steps)} SELECT DISTINCT doc_id, sha1({Q.strip('t')}) AS digest FROM a{len(steps) - 1}"


_PAGES = "pg AS (SELECT DISTINCT doc, page_num, native_text, replace(replace(ocr_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS ocr_text, confidence FROM engine_pages)"
_STOP = ", ".join(f"'{w}'" for w in U.STOPWORDS)


def _words(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{4,}}')), lambda w: w NOT IN ({_STOP}))"


def _numbers(x: str) -> str:
    """Numbers: greedy digit groups with separators, whole tokens only, without look-around: tokens of
    word signs and separators are cut first, then trimmed to what counts."""
    toks = f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+(?:[.,][\\p{{L}}\\p{{N}}_]+)*')"
    # Inside a token separated pieces may mix letters; only runs of pure digit pieces count.
    parts = f"flatten(list_transform({toks}, lambda t: regexp_extract_all(regexp_replace(t, '(?:^|[.,])[\\p{{N}}_]*[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*', ' ', 'g'), '[\\d.,]+')))"
    trimmed = f"list_transform({parts}, lambda t: regexp_replace(t, '^[.,]+|[.,]+$', '', 'g'))"
    return f"list_distinct(list_filter({trimmed}, lambda t: regexp_matches(t, '^(?:\\d+(?:[.,]\\d+)+|\\d{{2,}})$')))"


_OVERLAP = f"""o AS (SELECT doc, page_num, nw, ow, nn, onn, len(list_intersect(nw, ow)) AS sw, len(list_intersect(nn, onn)) AS sn,
  len(list_filter({Q.lines('ocr_text')}, lambda l: regexp_matches(l, '^#{{1,6}}\\s.'))) AS heads
 FROM (SELECT *, {_words('native_text')} AS nw, {_words('ocr_text')} AS ow, {_numbers('native_text')} AS nn, {_numbers('ocr_text')} AS onn FROM pg WHERE native_text IS NOT NULL AND ocr_text IS NOT NULL)),
op AS (SELECT *, round(sw / greatest(len(nw), 1)::DOUBLE * 100, 1) AS wp, round(sn / greatest(len(nn), 1)::DOUBLE * 100, 1) AS np FROM o)"""


def _pt(x: str) -> str:
    return "(" + " OR ".join(f"contains(' ' || lower(left({x}, 2000)) || ' ', '{h}')" for h in U.PT_HINTS) + ")"


def _dia(x: str) -> str:
    letters = f"regexp_replace(lower({x}), '[^\\p{{L}}]', '', 'g')"
    return f"CASE WHEN length({letters}) = 0 THEN 1.0::DOUBLE ELSE length(regexp_replace({letters}, '[^{U.DIACRITICS}]', '', 'g')) / length({letters})::DOUBLE END"


def _tableq(x: str) -> tuple[str, str]:
    """(looks like a table, quality of the table)."""
    full = f"list_filter({Q.lines(x)}, lambda l: {Q.strip('l')} <> '')"
    body = f"list_filter({Q.lines(x)}, lambda l: {Q.strip('l')} <> '' AND NOT starts_with({Q.strip('l')}, '#'))"
    pipes = f"list_filter({full}, lambda l: contains(l, '|'))"
    pb = f"len(list_filter({body}, lambda l: contains(l, '|')))"
    cols = f"list_transform({pipes}, lambda l: length(regexp_replace(regexp_replace(l, '^\\|+|\\|+$', '', 'g'), '[^|]', '', 'g')))"
    usual = f"list_max(map_values(list_histogram({cols})))" if False else f"list_max(list_transform(list_distinct({cols}), lambda k: len(list_filter({cols}, lambda z: z = k))))"
    n, share = f"len({pipes})", f"(len({pipes}) / greatest(len({full}), 1)::DOUBLE)"
    looks = f"(len({body}) >= 3 AND {pb} >= 2 AND {pb} / len({body})::DOUBLE >= 0.3)"
    return looks, f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE WHEN {share} < 0.3 THEN {share} / 0.3 WHEN {n} < 3 THEN {share} ELSE {share} * 0.3::DOUBLE + {usual} / {n}::DOUBLE * 0.7::DOUBLE END"


def _density(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace({x}, '[^\\p{{Nd}}.%,;()\\[\\]]', '', 'g')) / length({x})::DOUBLE END"


def _score_ctes(source: str) -> str:
    """``sc``: score and parts of ``t`` with confidence ``cf`` of every row of ``source``."""
    looks, quality = _tableq("t")
    return f"""
p0 AS (SELECT *, length({Q.strip('t')}) < 20 AS short, {Q.lines('t')} AS ls, list_filter({Q.lines('t')}, lambda l: {Q.strip('l')} <> '') AS fl, greatest(length(t), 1)::DOUBLE AS n FROM {source}),
p1 AS (SELECT *, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}{Q.BLANK[1:]}', '', 'g')) / n AS alnum, length(regexp_replace(t, '[^|\\\\/<>{{}}\\[\\]~`^_=+@#$%&*!]', '', 'g')) / n AS symbol,
  coalesce(list_sum(list_transform(fl, lambda l: length(l))), 0) / greatest(len(fl), 1)::DOUBLE AS line, (len(ls) - len(fl)) / len(ls)::DOUBLE AS empty,
  len(list_filter(list_distinct(string_split(t, '')), lambda ch: ch <> chr(10) AND contains(t, repeat(ch, 8)))) > 0 AS rep, {_dia('t')} AS dia FROM p0),
sc AS (SELECT *, CASE WHEN short THEN 0.0::DOUBLE ELSE (0.35::DOUBLE * alnum + 0.20::DOUBLE * greatest(0, 1 - symbol / 0.10::DOUBLE) + 0.15::DOUBLE * least(1, line / 60.0::DOUBLE) + 0.10::DOUBLE * greatest(0, 1 - empty / 0.50::DOUBLE)
  + CASE WHEN rep THEN 0 ELSE 0.10::DOUBLE END + 0.10::DOUBLE * cf) * CASE WHEN {_pt('t')} AND dia < 0.008 THEN 0.4::DOUBLE + 0.6::DOUBLE * dia / 0.008::DOUBLE ELSE 1 END
  * CASE WHEN {looks} THEN 0.5::DOUBLE + 0.5::DOUBLE * ({quality}) WHEN {_density('t')} > 0.20 THEN 0.5::DOUBLE ELSE 1 END END AS score FROM p1)"""


_BLOCKS = f"""{_PAGES}, pm AS (SELECT doc, page_num, max(ocr_text) AS t FROM pg WHERE ocr_text IS NOT NULL GROUP BY ALL),
bl AS (SELECT doc, page_num, unnest({Q.lines('t')}) AS text, generate_subscripts({Q.lines('t')}, 1) - 1 AS block_no FROM pm),
bb AS (SELECT *, {Q.strip('text')} AS s, CAST(8 + block_no % 11 AS DOUBLE) AS font_size, block_no % 4 = 0 AS is_bold FROM bl)"""
_LEVEL = f"""CASE WHEN s = '' THEN NULL WHEN is_bold AND font_size >= 16 THEN 1 WHEN is_bold AND font_size >= 14 THEN 2 WHEN is_bold AND font_size >= 12 THEN 3 WHEN is_bold THEN 4
 WHEN length(s) < 100 AND NOT regexp_matches(s, '[.:?]$') AND font_size >= 12 AND regexp_matches(lower(s), '{U.HEADING_WORDS}') THEN CASE WHEN font_size >= 14 THEN 2 ELSE 3 END END"""
_IS_ITEM = r"regexp_matches(s, '^(?:[•\-–—*▪▸▹▶►]|\p{Nd}[.):].)')"
_ITEMS = f"""{_BLOCKS}, it AS (SELECT *, CASE WHEN block_no = 0 THEN 'heading' WHEN block_no % 9 = 5 THEN 'picture' WHEN block_no % 9 = 7 THEN 'table' ELSE 'text' END AS kind,
  page_num % 8 + 1 AS lv, CASE WHEN block_no % 2 = 1 THEN 'cap' END AS caption, font_size / 20 AS confidence FROM bb)"""

SQL = {
    "prompt_context": f"""WITH {_EV}, c AS (SELECT query_id, string_agg('[' || place || '] ' || {_path(' > ')} || chr(10) || {_SHORT}, chr(10) || chr(10) ORDER BY place) AS c FROM r GROUP BY query_id)
SELECT qs.query_id, 'CONTEXT (retrieved chunks):' || chr(10) || coalesce(c, '(empty — no relevant chunks retrieved)') || chr(10) || chr(10) || 'QUESTION:' || chr(10) || 'Q' || qs.query_id AS "user" FROM qs LEFT JOIN c ON c.query_id = qs.query_id""",
    "sources_block": f"WITH {_EV}, {_SOURCES} SELECT qs.query_id, coalesce(s, 'Sources: (none)') AS sources FROM qs LEFT JOIN s ON s.query_id = qs.query_id",
    "answer_flags": f"""WITH {_EV}, b AS (SELECT query_id, count(*) AS n, max(score) AS c, first(snippet ORDER BY place) AS sn FROM r GROUP BY query_id),
t AS (SELECT qs.query_id, coalesce(n, 0) AS n, coalesce(c, 0) AS c, lower(coalesce(sn, '') || CASE WHEN qs.query_id % 5 = 0 THEN ' CONFLITO' WHEN qs.query_id % 7 = 0 THEN ' Não encontrei.' ELSE '' END) AS x FROM qs LEFT JOIN b ON b.query_id = qs.query_id)
SELECT query_id, n = 0 OR c < 0.02 OR contains(x, 'could not find an answer') OR contains(x, 'não encontrei') OR contains(x, 'nao encontrei') AS insufficient_context, contains(x, 'conflict') OR contains(x, 'conflito') AS conflict FROM t""",
    "display_answer": f"""WITH {_EV}, {_SOURCES} SELECT qs.query_id, sha1(CASE WHEN qs.query_id % 3 = 0 THEN '{G.NOT_FOUND}' ELSE 'x' || CASE WHEN qs.query_id % 2 = 0 THEN chr(10) || chr(10) || '(sources conflict)' ELSE '' END
 || chr(10) || chr(10) || coalesce(s, 'Sources: (none)') END) AS digest FROM qs LEFT JOIN s ON s.query_id = qs.query_id""",
    "html_table_to_markdown": "SELECT p_partkey, '| name | brand |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || trim(p_name) || ' | ' || p_brand || ' |' || chr(10) AS md FROM part",
    "doctags_to_markdown": "SELECT p_partkey, '## ' || p_name || chr(10) || 'a b' || chr(10) || chr(10) || '- ' || p_brand || chr(10) || '- z' || chr(10) || '| ' || p_type || ' | ' || p_size || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| c |' || chr(10) || chr(10) || '---' || chr(10) || '*f*' AS md FROM part",
    "strip_reasoning": f"""WITH l AS (SELECT DISTINCT doc_id, body, {Q.lines('body')} AS ls FROM documents_md WHERE body IS NOT NULL),
f AS (SELECT doc_id, body, ls, list_position(list_transform(ls, lambda l: NOT ({Q.strip('l')} = '' OR regexp_matches(lower({Q.strip('l')}), '^(?:{"|".join(V.REASONING).replace(chr(39), chr(39) * 2)})'))), true) AS p FROM l)
SELECT DISTINCT doc_id, sha1(CASE WHEN p IS NULL OR p = 0 THEN 'The user wants text' || chr(10) || chr(10) || '  Here is the page:' || chr(10) || body ELSE array_to_string(ls[p:], chr(10)) END) AS digest FROM f""",
    "strip_repetition": f"""WITH t AS (SELECT DISTINCT doc_id, body || chr(10) || repeat('Uma linha que se repete.' || chr(10), 9) || 'fim' AS t FROM documents_md WHERE body IS NOT NULL),
l AS (SELECT doc_id, t, unnest({Q.lines('t')}) AS l, generate_subscripts({Q.lines('t')}, 1) AS p FROM t),
s AS (SELECT *, {Q.strip('l')} AS s FROM l),
c AS (SELECT *, CASE WHEN length(s) >= 10 THEN row_number() OVER (PARTITION BY doc_id, t, s ORDER BY p) ELSE 0 END AS a, CASE WHEN length(s) >= 10 THEN sum(CASE WHEN length(s) >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, t, left(s, 40) ORDER BY p) ELSE 0 END AS b FROM s),
m AS (SELECT doc_id, t, min(CASE WHEN a > 5 OR b > 10 THEN p END) AS cut FROM c GROUP BY ALL)
SELECT DISTINCT doc_id, sha1(CASE WHEN cut = 1 THEN t ELSE {Q.strip('x')} END) AS digest FROM (SELECT c.doc_id, c.t, m.cut, coalesce(string_agg(CASE WHEN m.cut IS NULL OR p < m.cut THEN l END, chr(10) ORDER BY p), '') AS x FROM c JOIN m USING (doc_id, t) GROUP BY ALL)""",
    "strip_metadata": "SELECT DISTINCT doc_id, sha1(regexp_replace(body, '^\\s*\\n*', '')) AS digest FROM documents_md WHERE body IS NOT NULL",
    "strip_det": _digest(Q.strip(_subs("'a b' || body || chr(10) || chr(10) || chr(10) || chr(10) || 'x'", [(r"<\|/?det\|>", "''"), (r"\n{3,}", _NL2)]))),
    "content_kind": f"""SELECT DISTINCT doc_id, regexp_matches(s, '^<(?:table|html|div|h)') OR contains(left(s, 500), '<table') AS html, contains(left(s, 200), '<doctag') AS doctags
FROM (SELECT doc_id, lower({Q.strip('body')}) AS s FROM documents_md WHERE body IS NOT NULL)""",
    "csv_to_pipes": "SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation",
    "html_to_text": _digest(f"trim({_subs('body', [('<[^>]+>', chr(39) + ' ' + chr(39))])})").replace("sha1(trim(", "sha1(trim(regexp_replace(").replace("'g'))", "'g'), '" + r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]" + "+', ' ', 'g')))", 1).replace(")))) AS", "))) AS"),
    "html_to_markdown": _html_markdown(),
    "strip_html_attrs": _digest(_subs("body", _ATTRS)),
    "latex_strip": _digest(Q.strip(_subs("body", [(r"\\(?:begin|end)\{[^}]*\}", "''"), (r"\\[a-zA-Z]+(\{[^}]*\})*", "''"), (r"[{}]", "''"), (r"\n{3,}", _NL2)]))),
    "extract_html": _digest(Q.strip(_subs("regexp_extract(body, '(?s)<[a-zA-Z].*$')", [(r"(?s)\n\s*\[.*?(\[.*?\])\s*\]\s*\z", "''"), (r"(?s)\n\s*\{.*\}\s*\z", "''"), (r"\n\s*\[", "''")]))),
    "trailing_commentary": _digest(f"CASE WHEN regexp_matches(body, '</[a-zA-Z]+>') THEN {Q.strip('regexp_replace(body, ' + chr(39) + '(?s)^(.*</[a-zA-Z]+>).*$' + chr(39) + ', ' + chr(39) + chr(92) + '1' + chr(39) + ')')} ELSE body END"),
    "word_set": f"WITH {_PAGES} SELECT doc, page_num, array_to_string(list_sort({_words('ocr_text')}), ' ') AS words FROM pg WHERE ocr_text IS NOT NULL",
    "number_set": f"WITH {_PAGES} SELECT doc, page_num, array_to_string(list_sort({_numbers('ocr_text')}), ' ') AS numbers FROM pg WHERE ocr_text IS NOT NULL",
    "content_overlap": f"""WITH {_PAGES}, {_OVERLAP} SELECT doc, page_num, wp AS word_recall_pct, np AS num_recall_pct, CAST(len(nw) AS INT) AS native_words, CAST(sw AS INT) AS shared_words,
 CAST(len(nn) AS INT) AS native_numbers, CAST(sn AS INT) AS shared_numbers, CAST(heads AS INT) AS output_headings FROM op""",
    "completeness_check": f"WITH {_PAGES}, {_OVERLAP} SELECT doc, page_num, (len(nw) = 0 OR wp >= 80) AND (len(nn) = 0 OR np >= 90) AS complete FROM op",
    "quality_score": f"""WITH {_PAGES}, src AS (SELECT doc, page_num, coalesce(ocr_text, '') AS t, coalesce(confidence, 1.0) AS cf FROM pg), {_score_ctes('src')}
SELECT doc, page_num, round(score + 1e-9::DOUBLE, 6) AS score, round(CASE WHEN short THEN 0 ELSE alnum END + 1e-9::DOUBLE, 6) AS alphanumeric_ratio, round(CASE WHEN short THEN 1 ELSE symbol END + 1e-9::DOUBLE, 6) AS symbol_ratio, round(CASE WHEN short THEN 0 ELSE line END + 1e-9::DOUBLE, 6) AS avg_line_length,
 round(CASE WHEN short THEN 1 ELSE empty END + 1e-9::DOUBLE, 6) AS empty_line_ratio, round(CASE WHEN short THEN 0 ELSE dia END + 1e-9::DOUBLE, 6) AS diacritic_ratio, CAST(length(t) AS INT) AS char_count, NOT short AND rep AS has_repeated_chars FROM sc""",
    "diacritic_ratio": f"SELECT doc_id, round({_dia('text')} + 1e-9::DOUBLE, 6) AS ratio, {_pt('text')} AS portuguese FROM documents WHERE text IS NOT NULL",
    "table_quality": f"SELECT DISTINCT doc_id, {_tableq('body')[0]} AS is_table, round({_tableq('body')[1]} + 1e-9::DOUBLE, 6) AS quality FROM documents_md WHERE body IS NOT NULL",
    "numeric_density": f"WITH {_PAGES} SELECT doc, page_num, round({_density('ocr_text')} + 1e-9::DOUBLE, 6) AS density FROM pg WHERE ocr_text IS NOT NULL",
    "router_decision": f"""WITH {_PAGES}, src AS (SELECT doc, page_num, {Q.strip("coalesce(native_text, '')")} AS nt, {Q.strip("coalesce(ocr_text, '')")} AS t, coalesce(confidence, 1.0) AS cf FROM pg), {_score_ctes('src')},
w AS (SELECT *, {_words('nt')} AS nw, {_words('t')} AS ow, {_numbers('nt')} AS nn, {_numbers('t')} AS onn FROM sc),
v AS (SELECT doc, page_num, length(nt) >= 20 AS ref, CASE WHEN length(nt) >= 20 THEN len(list_intersect(nw, ow)) / greatest(len(nw), 1)::DOUBLE * 0.7::DOUBLE + CASE WHEN len(nn) = 0 THEN 1 ELSE len(list_intersect(nn, onn)) / len(nn)::DOUBLE END * 0.3::DOUBLE ELSE score END AS value FROM w)
SELECT doc, page_num, CASE WHEN ref THEN 'reference' ELSE 'heuristic' END AS method, round(value + 1e-9::DOUBLE, 6) AS value, value >= 0.7::DOUBLE AS accepted FROM v""",
    "native_text_check": f"WITH {_PAGES} SELECT doc, page_num, length({Q.strip("coalesce(native_text, '')")}) >= 50 AS ok FROM pg",
    "page_confidence": "SELECT doc, round(coalesce(avg(CASE WHEN confidence > 0 THEN confidence END), 0), 9) AS confidence, count(*) AS pages FROM (SELECT DISTINCT * FROM engine_pages) GROUP BY doc",
    "quality_summary": "SELECT doc, count(*) AS total_items, count(*) FILTER (score >= 0.7) AS ok_items, count(*) FILTER (score < 0.7) AS low_items FROM (SELECT DISTINCT doc, page_num, score, measured_at FROM quality_report WHERE score IS NOT NULL) GROUP BY doc",
    "heading_detect": f"WITH {_BLOCKS} SELECT doc, page_num, CAST(block_no AS INT) AS block_no, {_LEVEL} AS level FROM bb",
    "list_item_detect": f"WITH {_BLOCKS} SELECT doc, page_num, CAST(block_no AS INT) AS block_no, {_IS_ITEM} AS item FROM bb",
    "layout_items": f"""WITH {_BLOCKS}, k AS (SELECT *, CASE WHEN {_LEVEL} IS NOT NULL THEN 'heading' WHEN {_IS_ITEM} THEN 'list_text' ELSE 'text' END AS kind FROM bb WHERE s <> ''),
st AS (SELECT *, CASE WHEN kind = 'list_text' AND coalesce(lag(kind) OVER (PARTITION BY doc, page_num ORDER BY block_no), '') <> 'list_text' THEN 1 ELSE 0 END AS b FROM k)
SELECT doc, page_num, CAST(block_no AS INT) AS block_no, kind, CASE WHEN kind = 'list_text' THEN CAST(sum(b) OVER (PARTITION BY doc, page_num ORDER BY block_no) AS INT) END AS list_no, left(sha1(doc || '|' || page_num || '|' || block_no), 12) AS item_id FROM st""",
    "median_font": f"WITH {_BLOCKS} SELECT doc, page_num, list_sort(list(font_size))[len(list(font_size)) // 2 + 1] AS median_font FROM bb GROUP BY ALL",
    "table_item_markdown": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '**Parts**' || chr(10) || chr(10) ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '| a | b |' || chr(10) ELSE '' END || '| --- | --- |' || chr(10)
 || '| ' || p_name || ' | ' || p_brand || ' |' || chr(10) || '| ' || p_type || ' | ' || p_size || ' |' AS md FROM part""",
    "document_markdown": f"""WITH {_ITEMS}, m AS (SELECT doc, page_num * 100000 + block_no AS p, CASE WHEN kind = 'heading' THEN chr(10) || repeat('#', CAST(least(lv, 6) AS INT)) || ' ' || text || chr(10) WHEN kind = 'text' AND s <> '' THEN text
  WHEN kind = 'table' THEN chr(10) || CASE WHEN caption IS NOT NULL THEN '**cap**' || chr(10) || chr(10) ELSE '' END || '| h | i |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || text || ' | x |' || chr(10)
  WHEN kind = 'picture' THEN chr(10) || '[Imagem: ' || coalesce(caption, 'Image') || ']' || chr(10) END AS m FROM it)
SELECT doc, sha1(string_agg(m, chr(10) ORDER BY p)) AS digest FROM m WHERE m IS NOT NULL GROUP BY doc""",
    "document_stats": f"""WITH {_ITEMS} SELECT doc, count(DISTINCT page_num) AS pages, count(*) AS total_items, count(*) FILTER (kind IN ('text', 'heading')) AS text_items, count(*) FILTER (kind = 'table') AS table_items,
 count(*) FILTER (kind = 'picture') AS picture_items, CAST(coalesce(sum(CASE WHEN kind IN ('text', 'heading') THEN length(text) END), 0) AS BIGINT) AS total_chars, round(coalesce(avg(confidence), 0), 4) AS overall_confidence FROM it GROUP BY doc""",
    "items_by_page": f"WITH {_ITEMS} SELECT doc, page_num, kind, count(*) AS n FROM it GROUP BY ALL",
}
