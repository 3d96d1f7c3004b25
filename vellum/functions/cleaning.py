"""Text cleaning rules C1-C13, each a ``Column -> Column`` function.

The two rules whose outcome depends on all earlier lines at once (repeated addresses, repeated
items) run with the rule between them in one Arrow function, linear in the text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions.text import BLANK, fence_parity, keep_lines, lines, squeeze, strip, unlines, words

#: Patterns and signs that must match the documented behaviour (fixed values).
REPEATED_URL = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"
ITEM_URL = r"https?://[^\s<>\"]+"
ITEM_MARK = r"^[-*]\s+|^\d+\.\s+"
KEYWORD_BLOCK = r"(?i)(palavras?[\-\s]chaves?|keywords?|tags?|etiquetas?):?\s*\n[^\n]+(?:,[^\n]+)*"
NUMBERED = r"^\d+[.)]\s"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
DECLARATIONS = ("#", "-", "const ", "let ", "var ")


def normalize_line_endings(c: Column) -> Column:
    """C1."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def remove_reference_numbers(c: Column) -> Column:
    """C2."""
    return F.regexp_replace(c, r"\[\d+\]", "")


def remove_keyword_blocks(c: Column) -> Column:
    """Keyword headings with the line below; not anchored, matches do not overlap."""
    return F.regexp_replace(c, KEYWORD_BLOCK, "")


def detect_implicit_headings(c: Column) -> Column:
    """Title-like lines after a blank line become headings."""
    ls = F.transform(lines(c), lambda l: F.struct(l.alias("l"), strip(l).alias("s")))

    def mark(x, i):
        s = x["s"]
        n = F.length(s)
        before, after = F.get(ls, i - 1)["s"], F.get(ls, i + 1)["s"]
        w = words(s)
        capital = F.size(F.filter(w, lambda v: F.substring(v, 1, 1).rlike(r"\p{Lu}")))
        titled = (capital > F.size(w) * 0.5) | ((F.upper(s) == s) & s.rlike(r"\p{Lu}"))
        ok = (
            n.between(10, 80)
            & ~s.rlike(r"^[#\-*+`]")
            & ~s.rlike(NUMBERED)
            & ~s.rlike(r"^https?://")
            & ~s.contains(",")
            & ~s.rlike(r"[.!?:]\z")
            & (F.coalesce(before, F.lit("")) == "")
            & ~F.coalesce(after, F.lit("")).startswith("#")
            & titled
        )
        return F.when(ok, F.concat(F.lit("# "), s)).otherwise(x["l"])

    return unlines(F.transform(ls, mark))


def remove_short_lines(c: Column) -> Column:
    """Lines of one to nine signs that are no heading, list item or fence."""
    return keep_lines(c, lambda l: (F.length(strip(l)) >= 10) | (strip(l) == "") | strip(l).rlike(r"^(?:[#\-*+]|```|\d+[.)]\s)"))


def normalize_whitespace(c: Column) -> Column:
    """Single blanks outside code, list indents kept, at most one blank line."""

    def tidy(x):
        l = x["line"]
        item = l.rlike(r"(?s)^\s*(?:[-*+]|\d+[.)])\s+")
        indent = F.repeat(F.lit(" "), F.length(l) - F.length(F.regexp_replace(l, rf"\A{BLANK}+", "")))
        return F.when(x["code"], l).when(item, F.concat(indent, squeeze(l))).otherwise(squeeze(l))

    return F.regexp_replace(unlines(F.transform(fence_parity(lines(c)), tidy)), r"\n{3,}", "\n\n")


def remove_invalid_chars(c: Column) -> Column:
    """C10."""
    return F.regexp_replace(c, CONTROL, "")


def clean_markdown(c: Column) -> Column:
    """C11: empty headings, links and images without target, lone exclamation marks."""
    c = F.regexp_replace(c, r"(?md)^#{1,6}\s*\n", "")
    c = F.regexp_replace(c, r"\[[^\]]*\]\(\s*\)", "")
    c = F.regexp_replace(c, r"!\[[^\]]*\]\(\s*\)", "")
    return F.regexp_replace(c, r"(?md)^!\s*$", "")


def normalize_ws(c: Column) -> Column:
    """Form of a text from which identities are hashed."""
    rows = F.split(c, r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]", -1)
    return strip(unlines(F.transform(rows, squeeze)))


_REPEATED, _ITEM_URL, _ITEM_MARK = re.compile(REPEATED_URL), re.compile(ITEM_URL), re.compile(ITEM_MARK)


def drop_repeated_urls(text: str) -> str:
    """A line goes if it starts with an address that was met before, in it or above."""
    met: set[str] = set()
    out = []
    for line in text.split("\n"):
        bare, gone = line.strip(), False
        for url in _REPEATED.findall(line):
            if url not in met:
                met.add(url)
            elif bare.startswith(url):
                gone = True
                break
        if not gone:
            out.append(line)
    return "\n".join(out)


def drop_url_fragments(text: str) -> str:
    """C4 on a plain string."""
    out, code = [], False
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("```"):
            code = not code
        elif not code and len(s) < 30 and ("/" in s or "-" in s) and not s.startswith(DECLARATIONS) and not set("=<> ") & set(s) and not any(ch.isupper() for ch in s[:3]):
            continue
        out.append(line)
    return "\n".join(out)


def drop_duplicate_items(text: str) -> str:
    """Later lines equal to an earlier one (list mark aside), or whose first address was met."""
    items: set[str] = set()
    urls: set[str] = set()
    out = []
    for line in text.split("\n"):
        s = line.strip()
        if m := _ITEM_URL.search(s):
            if m.group() in urls:
                continue
            urls.add(m.group())
        key = _ITEM_MARK.sub("", s)
        if key:
            if key in items:
                continue
            items.add(key)
        out.append(line)
    return "\n".join(out)


def _arrow(f):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run.asNondeterministic()  # keeps the step out of the lambdas around it


def remove_repeated_urls(c: Column) -> Column:
    """C3."""
    return _arrow(drop_repeated_urls)(c)


def remove_url_fragments(c: Column) -> Column:
    """C4: outside code fences."""
    return _arrow(drop_url_fragments)(c)


def remove_duplicate_items(c: Column) -> Column:
    """C5."""
    return _arrow(drop_duplicate_items)(c)


def clean_text(df: DataFrame, text: str) -> DataFrame:
    """All rules in their order, C1-C10, on a column of ``df``.

    The Arrow step is its own projection, because functions of lines cannot contain one."""
    out = df.withColumn(text, remove_reference_numbers(normalize_line_endings(F.col(text)))).withColumn(text, _arrow(lambda t: drop_duplicate_items(drop_url_fragments(drop_repeated_urls(t))))(F.col(text)))
    for rule in (remove_keyword_blocks, detect_implicit_headings, remove_short_lines, normalize_whitespace, remove_invalid_chars):
        out = out.withColumn(text, rule(F.col(text)))
    return out
