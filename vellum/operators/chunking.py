"""Structural chunking H1-H14.

Headings, paragraph and window splits, the noise rule and identities are Catalyst expressions. The
line state machine and the greedy packing that depends on it are sequential per document and run as
one Arrow function over whole rows; documents are independent, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions.metadata import chunk_id
from vellum.functions.text import count_tokens, lines, strip

#: Patterns and names that must match the documented behaviour (fixed values).
HEADING = r"^(#{1,6})\s+(.*?)(?:\s+#+\s*)?$"
TABLE_ROW = r"^\|.+\|\s*$"
TABLE_RULE = r"^\|?[\s:-]+\|[\s:-|]+\|?\s*$"
LIST_ITEM = r"^(\s*)([-*+]\s+|\d+[.)]\s+)(.*)$"
NOISE = r"[\s\d.,;:()\[\]{}#*_\-+|/\\%$\^&=<>@!?\"]+"
APPENDIX = ("notas", "footnotes", "footnote", "apêndice", "apendice", "anexo", "appendix")
#: The rule of an ordinary table, for ``gfm_strict``.
STRICT_RULE = r"^\|?(?:\s*:?-+:?\s*\|)+(?:\s*:?-+:?\s*)?$"


@dataclass(frozen=True)
class ChunkSettings:
    """Sizes in tokens; ``target`` is validated only, as documented."""

    target: int = 600
    min: int = 80
    max: int = 800
    overlap: float = 0.15
    gfm_strict: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.min <= self.target <= self.max:
            raise ValueError("sizes must satisfy 0 < min <= target <= max")
        if not 0 <= self.overlap < 0.5:
            raise ValueError("overlap must be in [0, 0.5)")

    @property
    def step(self) -> int:
        return max(1, int(self.max * (1 - self.overlap)))


# --- expressions -----------------------------------------------------------------------------


def parents_h123(parents: Column) -> list[Column]:
    """first text of each of the levels 1 to 3."""

    def first(n: int) -> Column:
        return F.get(F.filter(parents, lambda p: p["level"] == n), F.lit(0))["text"].alias(f"h{n}")

    return [first(n) for n in (1, 2, 3)]


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n", -1), strip), lambda p: p != "")


def is_noise(text: Column, tokens: Column, min_tokens: int) -> Column:
    """Numbers, signs or scraps that are no table, code, list or headed text."""
    ls = lines(strip(text))
    listed = F.size(F.filter(ls, lambda l: strip(l).rlike(r"\A(?:[-*+]|\d+[.)]\s)")))
    table = text.contains("|") & text.contains("\n") & (F.size(ls) >= 2) & F.forall(ls, lambda l: l.contains("|"))
    headed = F.exists(ls, lambda l: strip(l).startswith("#")) & F.exists(ls, lambda l: ~strip(l).startswith("#") & (strip(l) != ""))
    keep = table | text.contains("```") | ((listed > 0) & (listed >= F.size(ls) * 0.5)) | headed
    core = F.length(F.regexp_replace(text, NOISE, ""))
    digits = F.length(F.regexp_replace(text, r"[^\d]", "")) / F.greatest(F.length(text), F.lit(1))
    drop = (core < 5) | ((tokens < min_tokens) & (core < 15)) | ((digits > 0.4) & (core < 30))
    return ~keep & drop


# --- sequential part -------------------------------------------------------------------------

_H = re.compile(HEADING, re.M)
_LINE_H = re.compile(HEADING)
_ROW, _RULE, _STRICT, _ITEM = re.compile(TABLE_ROW), re.compile(TABLE_RULE), re.compile(STRICT_RULE), re.compile(LIST_ITEM)


def tokens_of(text: str) -> int:
    """Default token count, as :func:`vellum.functions.text.count_tokens`."""
    return max(1, len(text) // 4)


@dataclass(frozen=True)
class Block:
    text: str
    start: int
    end: int
    parents: tuple = ()
    kind: str = "text"
    appendix: bool = False


class Section:
    """Reader of one section's lines: a cursor, and the paragraph lines not yet emitted."""

    def __init__(self, text: str, offset: int, parents: tuple, appendix: bool, strict: bool):
        self.rows = text.splitlines(keepends=True)
        self.at, self.offset = 0, offset
        self.parents, self.appendix = parents, appendix
        self.rule = _STRICT if strict else _RULE
        self.pending: list[str] = []
        self.since = offset
        self.out: list[Block] = []

    def take(self) -> str:
        row = self.rows[self.at]
        self.at += 1
        self.offset += len(row)
        return row

    def peek(self, ahead: int = 0) -> str | None:
        k = self.at + ahead
        return self.rows[k] if k < len(self.rows) else None

    def emit(self, text: str, start: int, end: int, kind: str, parents: tuple | None = None) -> None:
        self.out.append(Block(text.strip("\n"), start, end, self.parents if parents is None else parents, kind, self.appendix))

    def flush(self) -> None:
        if not self.pending:
            return
        text = "".join(self.pending)
        if text.strip():
            self.emit(text, self.since, self.since + len(text), "text")
        self.pending, self.since = [], self.offset

    def fence(self) -> None:
        start, got = self.offset, [self.take()]
        while self.peek() is not None:
            got.append(self.take())
            if got[-1].lstrip().startswith("```"):
                break
        self.flush()
        self.emit("".join(got), start, self.offset, "code")

    def table(self) -> None:
        start, got = self.offset, [self.take()]
        while (row := self.peek()) is not None and _ROW.match(row):
            got.append(self.take())
        self.flush()
        self.emit("".join(got), start, self.offset, "table")

    def items(self) -> None:
        start, got = self.offset, []
        while (row := self.peek()) is not None:
            after = self.peek(1)
            loose = not row.strip() and after is not None and _ITEM.match(after)
            if not (_ITEM.match(row) or loose or row.strip() and row[:1].isspace()):
                break
            got.append(self.take())
        lead = self.lead_in()
        if lead:
            keep, self.offset = self.offset, start
            self.flush()
            self.offset = keep
        self.emit((lead + "\n" if lead else "") + "".join(got), start, self.offset, "list")
        self.since = self.offset

    def lead_in(self) -> str:
        """The paragraph right above a list belongs to it."""
        k = len(self.pending)
        while k and self.pending[k - 1].strip():
            k -= 1
        lead, self.pending = self.pending[k:], self.pending[:k]
        while self.pending and not self.pending[-1].strip():
            self.pending.pop()
        return "".join(lead).strip("\n")

    def heading(self, m: re.Match) -> None:
        self.flush()
        start, row = self.offset, self.take()
        level = len(m.group(1))
        self.emit(row, start, self.offset, "heading", (*(p for p in self.parents if p[0] < level), (level, m.group(2).strip())))

    def read(self) -> list[Block]:
        while (row := self.peek()) is not None:
            after = self.peek(1)
            if row.lstrip().startswith("```"):
                self.fence()
            elif _ROW.match(row) and after is not None and self.rule.match(after.strip()):
                self.table()
            elif _ITEM.match(row):
                self.items()
            elif m := _LINE_H.match(row.strip()):
                self.heading(m)
            else:
                self.pending.append(self.take())
        self.flush()
        return self.out


def sections(body: str) -> Iterator[tuple[tuple, int, int, bool]]:
    """(parents, start, end, appendix) of the text before the first heading and of each heading's
    text. Parents are all earlier headings of a smaller level and the heading itself, by level."""
    found = [(len(m.group(1)), m.group(2).strip(), m.start()) for m in _H.finditer(body)]
    first = found[0][2] if found else len(body)
    if not found or body[:first].strip():
        yield (), 0, first, False
    smaller: list[list[tuple[int, str]]] = [[] for _ in range(8)]
    for k, (level, text, start) in enumerate(found):
        parents = (*(p for n in range(1, level) for p in smaller[n]), (level, text))
        end = found[k + 1][2] if k + 1 < len(found) else len(body)
        yield parents, start, end, text.lower().rstrip(":") in APPENDIX
        smaller[level].append((level, text))


def _pack(parts: list[str], first: int, limit: int, count: Callable[[str], int]) -> Iterator[list[str]]:
    """Greedy groups of parts whose tokens, with ``first``, stay within the limit if they can."""
    group: list[str] = []
    total = first
    for p in parts:
        n = count(p)
        if group and total + n > limit:
            yield group
            group, total = [], first
        group.append(p)
        total += n
    if group:
        yield group


def split_block(b: Block, s: ChunkSettings, count: Callable[[str], int] = tokens_of) -> list[Block]:
    """Blocks of at most ``max`` tokens where the structure allows."""
    if count(b.text) <= s.max:
        return [b]
    rows = b.text.splitlines(keepends=True)
    made = lambda text: replace(b, text=text.strip("\n"))
    if b.kind == "code":
        closing = rows.pop() if len(rows) > 1 and rows[-1].lstrip().startswith("```") else ""
        return [made(rows[0] + "".join(g) + (closing or "```\n")) for g in _pack(rows[1:], 0, s.max, count)]
    if b.kind == "table":
        if len(rows) < 3:
            return [b]
        head = rows[:2]
        return [made("".join(head + g)) for g in _pack(rows[2:], sum(map(count, head)), s.max, count)]
    if b.kind == "list":
        at = next((k for k, r in enumerate(rows) if _ITEM.match(r)), None)
        if at is None:
            return [b]
        lead = "".join(rows[:at]).strip("\n")
        items: list[str] = []
        for r in rows[at:]:
            if _ITEM.match(r):
                items.append(r)
            else:
                items[-1] += r
        return [made((lead + "\n" if lead else "") + "".join(g)) for g in _pack(items, count(lead) if lead else 0, s.max, count)]
    out = []
    for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", b.text))):
        if count(p) <= s.max:
            out.append(replace(b, text=p))
            continue
        w = p.split()
        for k in range(0, len(w), s.step):
            out.append(replace(b, text=" ".join(w[k : k + s.max])))
            if k + s.max >= len(w):
                break
    return out


def accumulate(seeds: list[Block], s: ChunkSettings, count: Callable[[str], int] = tokens_of) -> list[Block]:
    """Fold short neighbours of one lineage together; merged sizes are summed."""
    out: list[tuple[Block, int]] = []
    for b in seeds:
        n = count(b.text)
        if out:
            cur, m = out[-1]
            if min(m, n) < s.min and m + n <= s.max and (cur.parents, cur.appendix) == (b.parents, b.appendix):
                kind = cur.kind if cur.kind == b.kind else f"{cur.kind}+{b.kind}"
                out[-1] = (replace(cur, text=cur.text + "\n\n" + b.text, end=b.end, kind=kind), m + n)
                continue
        out.append((b, n))
    return [b for b, _ in out]


def seeds_of(body: str, s: ChunkSettings, count: Callable[[str], int] = tokens_of) -> list[Block]:
    """Blocks of a document, split and folded, before the noise rule."""
    found: list[Block] = []
    for parents, start, end, appendix in sections(body):
        if body[start:end].strip():
            for b in Section(body[start:end], start, parents, appendix, s.gfm_strict).read():
                found += split_block(b, s, count)
    kept = (replace(b, text=b.text.strip("\n")) for b in accumulate(found, s, count))
    return [b for b in kept if b.text.strip()]


def chunk_documents(docs: DataFrame, doc: str = "doc_id", body: str = "body", settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """H1: chunks of every document, in the schema of ``chunks``.

    Null and blank bodies give no chunks; a text that occurs twice in a document gives two rows of
    one chunk_id. Rows with equal ids are separate documents. Other columns are ignored.
    """
    kind = dict(docs.dtypes)[doc]
    schema = "text string, s bigint, e bigint, parents array<struct<level:int,text:string>>, kind string, appendix boolean"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [[(b.text, b.start, b.end, [{"level": l, "text": t} for l, t in b.parents], b.kind, b.appendix) for b in seeds_of(t, settings)] for t in pdf["t"]]
            yield pd.DataFrame({"d": pdf["d"], "blocks": [[dict(zip(("text", "s", "e", "parents", "kind", "appendix"), b)) for b in g] for g in got]})

    rows = docs.where(F.col(body).isNotNull()).select(F.col(doc).alias("d"), F.col(body).alias("t")).mapInPandas(read, f"d {kind}, blocks array<struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>>")
    tokens = lambda b: count_tokens(b["text"])
    kept = rows.withColumn("blocks", F.filter("blocks", lambda b: ~is_noise(b["text"], tokens(b), settings.min)))
    one = kept.select("d", F.posexplode("blocks").alias("i", "b"))
    return one.select(
        chunk_id(F.col("d").cast("string"), F.col("b.text")).alias("chunk_id"), F.col("d").alias(doc), F.col("i").alias("chunk_index"), F.col("b.text").alias("chunk_text"),
        F.col("b.s").alias("char_start"), F.col("b.e").alias("char_end"), count_tokens(F.col("b.text")).alias("token_count"), F.length("b.text").alias("char_count"),
        F.col("b.parents").alias("parents"), F.col("b.appendix").alias("is_appendix"),
    )
