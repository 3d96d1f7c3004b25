"""Document identity and metadata M1-M6."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vellum.functions.cleaning import normalize_ws
from vellum.functions.text import strip

#: Patterns and word lists that must match the documented behaviour (fixed values).
FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---(?:\s*\n|\s*\z)"
TITLE = r"(?md)^#\s+(.+?)\s*#*\s*$"
PT_HINTS = (" o ", " a ", " de ", " que ", " para ", " com ", " não ")
EN_HINTS = (" the ", " and ", " of ", " to ", " for ", " with ", " not ")
DOC_TYPES = {
    "manual": ("manual", "guia", "guide", "handbook"),
    "relatorio": ("relatorio", "report", "relatório"),
    "estudo": ("estudo", "study", "research", "pesquisa"),
    "codigo": ("codigo", "code", "api", "reference"),
    "politica": ("politica", "policy", "termos", "terms"),
}


def doc_id(path: Column) -> Column:
    """Stable identity of a relative path, whatever its separators."""
    return F.substring(F.sha1(F.replace(path, F.lit("\\"), F.lit("/"))), 1, 16)


def chunk_id(doc: Column, text: Column) -> Column:
    """Identity of a chunk: its document and its text up to white space."""
    return F.concat(doc, F.lit("_"), F.substring(F.sha1(normalize_ws(text)), 1, 12))


def front_matter(raw: Column) -> Column:
    """M1: the block between the first ``---`` lines, or an empty string."""
    return F.regexp_extract(raw, FRONT_MATTER, 1)


def strip_front_matter(raw: Column) -> Column:
    """M1: the text after the front matter."""
    return F.regexp_replace(raw, FRONT_MATTER, "")


def parse_front_matter(block: Column) -> Column:
    """M2: ``map<string,string>`` of ``key: value`` lines; comments skipped, quotes stripped, the
    last of equal keys counts."""
    rows = F.filter(F.transform(F.split(block, r"\r?\n", -1), strip), lambda l: ~l.startswith("#") & l.contains(":"))
    pair = F.transform(rows, lambda l: F.struct(strip(F.regexp_extract(l, r"\A([^:]*):", 1)).alias("key"), unquote(strip(F.regexp_replace(l, r"\A[^:]*:", ""))).alias("value")))
    last = F.filter(pair, lambda p, i: ~F.exists(F.slice(pair, i + 2, F.size(pair)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def unquote(c: Column) -> Column:
    """Without surrounding double, then single quotes."""
    return F.regexp_replace(F.regexp_replace(c, r'\A"+|"+\z', ""), r"\A'+|'+\z", "")


def first_heading(body: Column) -> Column:
    """Text of the first first-level heading; null if there is none."""
    return F.nullif(strip(F.regexp_extract(body, TITLE, 1)), F.lit(""))


def title(front: Column, body: Column, file_name: Column) -> Column:
    """M3: front matter, first heading, file name without extension."""
    return F.coalesce(F.nullif(F.element_at(front, "title"), F.lit("")), first_heading(body), F.regexp_replace(file_name, r"\.[^.]*\z", ""))


def _occurrences(s: Column, hint: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(hint), F.lit("")))) / len(hint)).cast("int")


def guess_language(body: Column) -> Column:
    """M4 without front matter: Portuguese or English by counts of small words, else ``und``."""
    s = F.concat(F.lit(" "), F.lower(F.substring(body, 1, 3000)), F.lit(" "))
    pt = sum((_occurrences(s, h) for h in PT_HINTS[1:]), _occurrences(s, PT_HINTS[0]))
    en = sum((_occurrences(s, h) for h in EN_HINTS[1:]), _occurrences(s, EN_HINTS[0]))
    return F.when((pt == 0) & (en == 0), "und").when(pt > en, "pt").otherwise("en")


def language(front: Column, body: Column) -> Column:
    """M4: a language named in the front matter (blank: ``und``), else the guess."""
    named = F.coalesce(F.nullif(F.element_at(front, "lang"), F.lit("")), F.element_at(front, "language"), F.element_at(front, "lang"))
    has = F.map_contains_key(front, F.lit("lang")) | F.map_contains_key(front, F.lit("language"))
    return F.when(has, F.coalesce(F.nullif(F.substring(strip(named), 1, 8), F.lit("")), F.lit("und"))).otherwise(guess_language(body))


def doc_type(title_: Column, body: Column, file_name: Column) -> Column:
    """M5: the first class of which title, opening or file name holds a hint; null if none."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(title_, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 1000), F.coalesce(file_name, F.lit(""))))
    out = None
    for name, hints in DOC_TYPES.items():
        hit = hay.contains(hints[0])
        for h in hints[1:]:
            hit = hit | hay.contains(h)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def parse_tags(s: Column) -> Column:
    """M6: ``[a, b]`` or ``a, b`` to an array; blanks and quotes trimmed, empty parts dropped."""
    bare = F.when(s.startswith("[") & s.endswith("]"), F.regexp_replace(s, r"\A\[|\]\z", "")).otherwise(s)
    parts = F.filter(F.split(F.coalesce(bare, F.lit("")), ",", -1), lambda t: strip(t) != "")
    return F.transform(parts, lambda t: unquote(strip(t)))
