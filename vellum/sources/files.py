"""File sources S1-S14: Markdown trees and documents of eleven formats, read with ``binaryFile``.

Text formats are decoded in Catalyst. Zip-based office formats need a parser and run, file by file, in
Arrow batches with the standard library alone; a file that cannot be read gives an ``error``.
"""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.functions import cleaning, convert, metadata

#: Extensions read as text, and as archives (fixed values).
TEXT = ("md", "txt", "html", "htm", "tex", "csv")
ARCHIVES = ("docx", "pptx", "xlsx", "xlsm", "epub")


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """``(source_path, file_name, file_hash, doc_id, content)`` of ``*.md`` below ``root``,
    without hidden files and folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace("path", r"^.*?" + re.escape(base) + "/", "")
    rows = files.select(rel.alias("source_path"), F.element_at(F.split(rel, "/"), -1).alias("file_name"), F.sha2("content", 256).alias("file_hash"), metadata.doc_id(rel).alias("doc_id"), "content")
    return rows.where(~F.col("source_path").rlike(r"(?:^|/)\."))


def load_markdown(files: DataFrame) -> DataFrame:
    """``documents_md`` rows: decoded, front matter taken off, cleaned, described."""
    raw = cleaning.normalize_line_endings(F.decode("content", "UTF-8"))
    d = files.withColumn("_raw", raw).withColumn("_front", metadata.parse_front_matter(metadata.front_matter(F.col("_raw"))))
    d = cleaning.clean_text(d.withColumn("body", metadata.strip_front_matter(F.col("_raw"))), "body").withColumn("body", cleaning.clean_markdown(F.col("body")))
    front, body, name = F.col("_front"), F.col("body"), F.col("file_name")
    d = d.withColumn("title", metadata.title(front, body, name))
    named = F.coalesce(F.nullif(F.element_at(front, "type"), F.lit("")), F.nullif(F.element_at(front, "doc_type"), F.lit("")))
    return d.select(
        "doc_id", "source_path", "file_name", "file_hash", "body", "title", metadata.language(front, body).alias("language"),
        F.coalesce(named, metadata.doc_type(F.col("title"), body, name)).alias("doc_type"),
        metadata.parse_tags(F.element_at(front, "tags")).alias("tags"), F.unix_millis(F.current_timestamp()).alias("ingested_at"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest entries of a JSON file ``{"entries": [...]}``.

    A missing or broken file gives no rows; entries without a document id, path or hash are skipped; of
    several entries of a document the last counts. Missing names, times, languages and tags get their
    defaults: the path's last part, 0, ``und`` and no tags."""
    entry = "doc_id string, source_path string, file_name string, file_hash string, ingested_at bigint, language string, doc_type string, tags array<string>"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], entry)
    # Entries are parsed one by one, so that a bad one does not take the others with it.
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "entries array<string>").alias("j"))
    rows = whole.select(F.posexplode("j.entries").alias("n", "e")).select("n", F.from_json("e", entry).alias("e"))
    last = rows.where("e.doc_id is not null and e.source_path is not null and e.file_hash is not null").groupBy("e.doc_id").agg(F.max_by("e", "n").alias("e")).select("e.*")
    name = F.element_at(F.split(F.translate("source_path", "\\", "/"), "/"), -1)
    defaults = {"file_name": name, "ingested_at": F.lit(0).cast("bigint"), "language": F.lit("und"), "tags": F.array().cast("array<string>")}
    return last.select(*[F.coalesce(c, defaults[c]).alias(c) if c in defaults else F.col(c) for c in (x.split()[0] for x in entry.split(", "))])


# --- archives --------------------------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ET.Element, name: str) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == name)


def _pipes(cells: list[str]) -> str:
    return "| " + " | ".join(cells) + " |"


def read_docx(data: bytes) -> str:
    """Headings by style, paragraphs, then tables."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(".//{*}body")
    out, tables = [], []
    for node in body if body is not None else []:
        if _local(node.tag) == "p":
            text = _texts(node, "t").strip()
            style = next((v for s in node.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
            level = re.search(r"(?i)heading\s*(\d)", style)
            if text:
                out.append("#" * int(level.group(1)) + " " + text if level else text)
        elif _local(node.tag) == "tbl":
            tables += [_pipes([_texts(c, "t").strip() for c in r if _local(c.tag) == "tc"]) for r in node.iter() if _local(r.tag) == "tr"]
    return "\n".join(out + tables)


def read_pptx(data: bytes) -> str:
    """Slides with their paragraphs and tables."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = sorted((int(m.group(1)), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for k, (_, name) in enumerate(names, 1):
        out += [f"## Slide {k}", ""]
        root = ET.fromstring(z.read(name))
        inside = {id(p) for t in root.iter() if _local(t.tag) == "tbl" for p in t.iter()}
        for node in root.iter():
            if _local(node.tag) == "p" and id(node) not in inside and (text := _texts(node, "t").strip()):
                out.append(text)
            elif _local(node.tag) == "tr":
                out.append(_pipes([_texts(c, "t").strip() for c in node if _local(c.tag) == "tc"]))
        out += ["", "---", ""]
    return "\n".join(out)


def read_xlsx(data: bytes) -> str:
    """Sheets with their non-empty rows."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = [_texts(s, "t") for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    titles = [s.attrib.get("name", "") for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
    names = sorted((int(m.group(1)), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    out = []
    for title, (_, name) in zip(titles, names):
        out += [f"## {title}", ""]
        for row in (r for r in ET.fromstring(z.read(name)).iter() if _local(r.tag) == "row"):
            cells: list[str] = []
            for c in (c for c in row if _local(c.tag) == "c"):
                column = 0
                for ch in re.match(r"[A-Z]*", c.attrib.get("r", "")).group():
                    column = column * 26 + ord(ch) - 64
                cells += [""] * (column - 1 - len(cells))
                value = _texts(c, "v") if c.attrib.get("t") != "inlineStr" else _texts(c, "t")
                cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else value)
            if any(x.strip() for x in cells):
                out.append(_pipes(cells))
        out.append("")
    return "\n".join(out)


def read_epub(data: bytes) -> str:
    """Per part its title, then headings, then paragraphs, then images."""
    z = zipfile.ZipFile(io.BytesIO(data))
    out = []
    bare = lambda s: html.unescape(re.sub(r"<[^>]+>", "", s)).strip()
    for name in (n for n in z.namelist() if re.search(r"(?i)\.x?html?$", n)):
        text = re.sub(r"(?is)<(script|style|nav)\b.*?</\1>", "", z.read(name).decode("utf-8", "replace"))
        if (m := re.search(r"(?is)<title[^>]*>(.*?)</title>", text)) and bare(m.group(1)):
            out += [f"## {bare(m.group(1))}", ""]
        out += ["#" * int(m.group(1)) + " " + bare(m.group(2)) for m in re.finditer(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", text)]
        out += [bare(m.group(1)) for m in re.finditer(r"(?is)<p\b[^>]*>(.*?)</p>", text) if bare(m.group(1))]
        for m in re.finditer(r"(?is)<img\b[^>]*>", text):
            alt = re.search(r"(?i)\balt=\"([^\"]+)\"", m.group()) or re.search(r"(?i)\btitle=\"([^\"]+)\"", m.group())
            out.append(f"[Imagem: {html.unescape(alt.group(1)) if alt else 'Imagem'}]")
    return "\n".join(out)


def read_csv(data: bytes) -> str:
    """Rows as pipes, quotes resolved."""
    return "\n".join(_pipes(r) for r in csv.reader(io.StringIO(data.decode("utf-8", "replace"))))


_READERS = {"docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx, "xlsm": read_xlsx, "epub": read_epub, "csv": read_csv}


def extract_text(files: DataFrame) -> DataFrame:
    """``(path, extension, text, error)`` from ``(path, content)``; unknown formats give an error,
    they do not stop the others."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = files.select("path", ext.alias("extension"), "content")
    raw = F.decode("content", "UTF-8")
    easy = rows.where(F.col("extension").isin("md", "txt", "html", "htm", "tex")).select(
        "path", "extension", F.when(F.col("extension").isin("html", "htm"), convert.html_to_text(raw)).when(F.col("extension") == "tex", convert.latex_to_text(raw)).otherwise(raw).alias("text"), F.lit(None).cast("string").alias("error")
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for e, c in zip(pdf["extension"], pdf["content"]):
                try:
                    got.append((_READERS[e](bytes(c)), None))
                except KeyError as x:
                    got.append((None, f"unsupported format or part: {x}"))
                except Exception as x:  # noqa: BLE001 - one bad file must not stop the others
                    got.append((None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame({"path": pdf["path"], "extension": pdf["extension"], "text": [g[0] for g in got], "error": [g[1] for g in got]})

    hard = rows.where(~F.col("extension").isin("md", "txt", "html", "htm", "tex")).mapInPandas(parse, "path string, extension string, text string, error string")
    return easy.unionByName(hard)


def list_inputs(spark: SparkSession, root: str) -> DataFrame:
    """S3: ``(path, content)`` of all files of known extensions below ``root`` or of the one file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*TEXT, *ARCHIVES, "pdf", "png", "jpg", "jpeg")).select("path", "content")
