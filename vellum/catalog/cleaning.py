"""Cleaning, metadata and identity over the documents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.catalog import sqlparts as Q
from vellum.functions import cleaning as C, metadata as M
from vellum.functions.text import count_tokens
from vellum.runtime import ship, spread, table


def _text_query(rule: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    """Documents with the digest and length of their text after a rule."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        t = table(spark, d, "documents").where("text is not null").select("doc_id", rule(F.col("text")).alias("t"))
        return t.select("doc_id", F.sha1("t").alias("digest"), F.length("t").alias("n"))

    return run


def _text_sql(expression: str, ctes: str = "") -> str:
    return f"{ctes} SELECT doc_id, sha1(t) AS digest, length(t) AS n FROM (SELECT doc_id, {expression} AS t FROM documents WHERE text IS NOT NULL)"


def _line_sql(keep: str, show: str = "l") -> str:
    """Documents rebuilt from their lines: those to keep, as they are to be shown."""
    return f"""WITH {Q.fenced('documents')}
SELECT k AS doc_id, sha1(t) AS digest, length(t) AS n
FROM (SELECT k, coalesce(string_agg(CASE WHEN {keep} THEN {show} END, chr(10) ORDER BY p), '') AS t FROM ls GROUP BY k)"""


def clean_text_full(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    t = C.clean_text(spread(table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("t"))), "t")
    return t.select("doc_id", F.sha1("t").alias("digest"), F.length("t").alias("n"))


def clean_repeated_urls(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return _text_query(C.remove_repeated_urls)(spark, d)


def clean_url_fragments(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return _text_query(C.remove_url_fragments)(spark, d)


def clean_dup_lines(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    t = spread(table(spark, d, "documents").where("text is not null")).select("doc_id", C.remove_duplicate_items(F.col("text")).alias("t"))
    return t.select("doc_id", F.sha1("t").alias("digest"), F.length("t").alias("n"))


def chunk_identity(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("chunk_text is not null and doc_id is not null").select("doc_id", "chunk_text").distinct()
    return c.select("doc_id", M.chunk_id(F.col("doc_id"), F.col("chunk_text")).alias("chunk_id")).distinct()


def doc_identity(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where("source_path is not null").select("source_path").distinct()
    return m.select("source_path", M.doc_id(F.col("source_path")).alias("doc_id"))


def file_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents_md").where("body is not null").select("doc_id", F.sha2(F.col("body").cast("binary"), 256).alias("file_hash")).distinct()


def token_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", count_tokens(F.col("text")).alias("tokens"))


def language_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", M.guess_language(F.col("text")).alias("language"))


def doc_type(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents_md").where("body is not null").select("doc_id", "title", "body", "file_name").distinct()
    return m.select("doc_id", M.doc_type(F.col("title"), F.col("body"), F.col("file_name")).alias("doc_type"))


def title(spark: SparkSession, d: str) -> DataFrame:
    """First first-level heading of a body, else the file name."""
    m = table(spark, d, "documents_md").where("body is not null").select("doc_id", F.regexp_replace("body", "\r\n?", "\n").alias("body"), "file_name").distinct()
    return m.select("doc_id", F.coalesce(M.first_heading(F.col("body")), F.regexp_replace("file_name", r"\.[^.]*\z", "")).alias("title"))


def _fronted(d: DataFrame) -> Column:
    """A raw file with front matter, built from a row."""
    tags = F.concat(F.lit("["), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "), F.lit("]"))
    return F.concat(F.lit("---\ntitle: \""), F.coalesce("title", F.lit("")), F.lit("\"\n# note: x\nlang: "), F.coalesce("language", F.lit("")), F.lit("\ntags: "), tags, F.lit("\n---\n"), F.coalesce("file_name", F.lit("")))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents_md").select("doc_id", "title", "language", "tags", "file_name").distinct()
    m = m.select("doc_id", _fronted(m).alias("raw"))
    f = m.withColumn("f", M.parse_front_matter(M.front_matter(F.col("raw"))))
    return f.select("doc_id", F.element_at("f", "title").alias("title"), F.element_at("f", "lang").alias("lang"), M.strip_front_matter(F.col("raw")).alias("rest")).distinct()


def tags_parse(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents_md").where("tags is not null").select("doc_id", F.concat(F.lit("["), F.array_join("tags", " , "), F.lit("]")).alias("s")).distinct()
    return m.select("doc_id", F.array_join(M.parse_tags(F.col("s")), "|").alias("tags")).distinct()


def _count(hint: str, s: str = "s") -> str:
    return f"(length({s}) - length(replace({s}, '{hint}', ''))) // {len(hint)}"


QUERIES = {
    "clean_line_endings": _text_query(C.normalize_line_endings),
    "clean_references": _text_query(C.remove_reference_numbers),
    "clean_url_fragments": clean_url_fragments,
    "clean_keywords": _text_query(C.remove_keyword_blocks),
    "clean_implicit_headings": _text_query(C.detect_implicit_headings),
    "clean_short_lines": _text_query(C.remove_short_lines),
    "clean_whitespace": _text_query(C.normalize_whitespace),
    "clean_control_chars": _text_query(C.remove_invalid_chars),
    "clean_markdown_links": _text_query(C.clean_markdown),
    "clean_normalize_ws": _text_query(C.normalize_ws),
    "clean_repeated_urls": clean_repeated_urls,
    "clean_dup_lines": clean_dup_lines,
    "clean_text_full": clean_text_full,
    "chunk_identity": chunk_identity,
    "doc_identity": doc_identity,
    "file_hash": file_hash,
    "token_count": token_count,
    "language_heuristic": language_heuristic,
    "doc_type": doc_type,
    "title": title,
    "front_matter": front_matter,
    "tags_parse": tags_parse,
}

_FRAGMENT = r"""NOT code AND length(s) < 30 AND (contains(s, '/') OR contains(s, '-')) AND NOT regexp_matches(s, '^(?:#|-|const |let |var )')
 AND NOT regexp_matches(s, '[=<> ]') AND NOT regexp_matches(left(s, 3), '\p{Lu}')"""
_TITLED = rf"""length(s) BETWEEN 10 AND 80 AND NOT regexp_matches(s, '^[#\-*+`]') AND NOT regexp_matches(s, '^\d+[.)]\s') AND NOT regexp_matches(s, '^https?://')
 AND NOT contains(s, ',') AND NOT regexp_matches(s, '[.!?:]$') AND coalesce(lag(s) OVER (PARTITION BY k ORDER BY p), '') = ''
 AND NOT starts_with(coalesce(lead(s) OVER (PARTITION BY k ORDER BY p), ''), '#')
 AND (len(list_filter({Q.words('s')}, lambda w: regexp_matches(w, '^\p{{Lu}}'))) > len({Q.words('s')}) * 0.5
      OR (upper(s) = s AND regexp_matches(s, '\p{{Lu}}')))"""
_TYPES = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(h, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{t}'" for t, ws in M.DOC_TYPES.items()) + " END"



def _normal(x: str) -> str:
    parts = f"regexp_split_to_array({x}, '\\r\\n|[\\n\\x0B\\x0C\\r\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    return Q.strip(f"array_to_string(list_transform({parts}, lambda z: {Q.squeeze('z')}), chr(10))")


SQL = {
    "clean_line_endings": _text_sql("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"),
    "clean_references": _text_sql(Q.sub("text", r"\[\d+\]")),
    "clean_url_fragments": _line_sql(f"NOT ({_FRAGMENT})"),
    "clean_keywords": _text_sql(Q.sub("text", C.KEYWORD_BLOCK)),
    "clean_implicit_headings": f"""WITH {Q.fenced('documents')},
marked AS (SELECT k, p, CASE WHEN {_TITLED} THEN '# ' || s ELSE l END AS l FROM ls)
SELECT k AS doc_id, sha1(t) AS digest, length(t) AS n FROM (SELECT k, string_agg(l, chr(10) ORDER BY p) AS t FROM marked GROUP BY k)""",
    "clean_short_lines": _line_sql(r"length(s) >= 10 OR s = '' OR regexp_matches(s, '^(?:[#\-*+]|```|\d+[.)]\s)')"),
    "clean_whitespace": f"""WITH {Q.fenced('documents')},
tidy AS (SELECT k, p, CASE WHEN code THEN l WHEN regexp_matches(l, '^\\s*(?:[-*+]|\\d+[.)])\\s+')
  THEN repeat(' ', length(l) - length(regexp_replace(l, '^{Q.BLANK}+', ''))) || {Q.squeeze('l')} ELSE {Q.squeeze('l')} END AS l FROM ls)
SELECT k AS doc_id, sha1(t) AS digest, length(t) AS n
FROM (SELECT k, regexp_replace(string_agg(l, chr(10) ORDER BY p), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM tidy GROUP BY k)""",
    "clean_control_chars": _text_sql(Q.sub("text", C.CONTROL)),
    "clean_normalize_ws": _text_sql(_normal("text")),
    "clean_dup_lines": f"""WITH {Q.fenced('documents')},
keyed AS (SELECT *, nullif(regexp_extract(s, 'https?://[^{Q.BLANK[1:-1]}<>"]+'), '') AS u, regexp_replace(s, '^[-*]{Q.BLANK}+|^\\d+\\.{Q.BLANK}+', '') AS i FROM ls),
met AS (SELECT *, u IS NOT NULL AND row_number() OVER (PARTITION BY k, u ORDER BY p) > 1 AS gone FROM keyed),
firsts AS (SELECT *, row_number() OVER (PARTITION BY k, gone, i ORDER BY p) AS r FROM met)
SELECT k AS doc_id, sha1(t) AS digest, length(t) AS n
FROM (SELECT k, coalesce(string_agg(CASE WHEN NOT gone AND (i = '' OR r = 1) THEN l END, chr(10) ORDER BY p), '') AS t FROM firsts GROUP BY k)""",
    "clean_markdown_links": _text_sql(Q.sub(Q.sub(Q.sub(Q.sub("text", r"(?m)^#{1,6}\s*\n"), r"\[[^\]]*\]\(\s*\)"), r"!\[[^\]]*\]\(\s*\)"), r"(?m)^!\s*$")),
    "clean_repeated_urls": f"""WITH RECURSIVE {Q.fenced('documents')},
u AS (SELECT k, p, l, s, regexp_extract_all(l, 'https?://[^{Q.BLANK[1:-1]}<>"]+|www\\.[^{Q.BLANK[1:-1]}<>"]+') AS us FROM ls),
f AS (
  SELECT k, CAST(0 AS BIGINT) AS p, CAST([] AS VARCHAR[]) AS met, CAST(NULL AS VARCHAR) AS l, true AS gone FROM (SELECT DISTINCT k FROM u)
  UNION ALL
  SELECT u.k, u.p, list_concat(f.met, CASE WHEN j.j IS NULL THEN us ELSE us[1:j.j - 1] END), u.l, j.j IS NOT NULL
  FROM f JOIN u ON u.k = f.k AND u.p = f.p + 1,
   LATERAL (SELECT min(x) AS j FROM (SELECT unnest(range(1, len(u.us) + 1)) AS x) r WHERE starts_with(u.s, u.us[x]) AND (list_contains(f.met, u.us[x]) OR list_contains(u.us[1:x - 1], u.us[x]))) j)
SELECT k AS doc_id, sha1(t) AS digest, length(t) AS n FROM (SELECT k, coalesce(string_agg(CASE WHEN NOT gone THEN l END, chr(10) ORDER BY p), '') AS t FROM f WHERE p > 0 GROUP BY k)""",
    "chunk_identity": f"SELECT DISTINCT doc_id, doc_id || '_' || left(sha1({_normal('chunk_text')}), 12) AS chunk_id FROM chunks WHERE chunk_text IS NOT NULL AND doc_id IS NOT NULL",
    "doc_identity": r"SELECT DISTINCT source_path, left(sha1(replace(source_path, '\', '/')), 16) AS doc_id FROM manifest WHERE source_path IS NOT NULL",
    "file_hash": "SELECT DISTINCT doc_id, sha256(body) AS file_hash FROM documents_md WHERE body IS NOT NULL",
    "token_count": "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM documents WHERE text IS NOT NULL",
    "language_heuristic": f"""WITH t AS (SELECT doc_id, ' ' || lower(left(text, 3000)) || ' ' AS s FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, {' + '.join(_count(h) for h in M.PT_HINTS)} AS pt, {' + '.join(_count(h) for h in M.EN_HINTS)} AS en FROM t)
SELECT doc_id, CASE WHEN pt = 0 AND en = 0 THEN 'und' WHEN pt > en THEN 'pt' ELSE 'en' END AS language FROM c""",
    "doc_type": f"""SELECT doc_id, {_TYPES} AS doc_type FROM (
 SELECT DISTINCT doc_id, title, body, file_name, lower(coalesce(title, '') || ' ' || left(body, 1000) || ' ' || coalesce(file_name, '')) AS h
 FROM documents_md WHERE body IS NOT NULL)""",
    "title": r"""WITH b AS (SELECT DISTINCT doc_id, file_name, replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body FROM documents_md WHERE body IS NOT NULL)
SELECT doc_id, coalesce(nullif(""" + Q.strip(r"regexp_extract(body, '(?m)^#\s+(.+?)\s*#*\s*$', 1)") + r""", ''), regexp_replace(file_name, '\.[^.]*$', '')) AS title FROM b""",
    "front_matter": f"""SELECT DISTINCT doc_id, regexp_replace({Q.strip("coalesce(title, '')")}, '^"+|"+$', '', 'g') AS title,
 {Q.strip("coalesce(language, '')")} AS lang, coalesce(file_name, '') AS rest FROM documents_md""",
    "tags_parse": "SELECT DISTINCT doc_id, array_to_string(list_filter(tags, lambda t: trim(t) <> ''), '|') AS tags FROM documents_md WHERE tags IS NOT NULL",
}


def _chained(steps: list[str]) -> str:
    """SQL of rules one after another: each reads the texts that the one before it gives."""
    ctes, source = [], "documents"
    for n, name in enumerate(steps):
        sql = SQL[name].replace("sha1(t) AS digest, length(t) AS n", "t AS text")
        ctes.append(f"c{n} AS ({re.sub(r'(?<![a-z_])documents(?![a-z_])', source, sql)})")
        source = f"c{n}"
    return f"WITH {', '.join(ctes)} SELECT doc_id, sha1(text) AS digest, length(text) AS n FROM {source}"


SQL["clean_text_full"] = _chained(
    "clean_line_endings clean_references clean_repeated_urls clean_url_fragments clean_dup_lines clean_keywords clean_implicit_headings clean_short_lines clean_whitespace clean_control_chars".split()
)
