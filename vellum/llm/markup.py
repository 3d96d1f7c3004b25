"""Markup residue in text documents (problem 3).

HTML, Markdown, wiki and LaTeX constructs are recognised and converted in one pass per text: code and
formulas are set aside untouched, headings become ``#`` lines, list items ``-`` lines, tables rows of
cells, and everything else of the markup goes. What remains is cut to the main text by line-block
distribution: the lengths of stripped lines, text of links not counted, are summed over a sliding
window; a surge opens a block of text, a dive closes it. Outside the blocks, lines that are nothing
but links, the content of navigation elements and, at the ends of a web page, short loose lines are
residue; text that no surge stands out from is kept whole, so a short text survives. Every text is an
independent row: no shuffle, no state beyond one text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

FAMILIES = ("html", "markdown", "wiki", "latex")
#: Line-block distribution: lines per window, characters in a window that open a block, characters
#: from which a line is no loose line.
WINDOW, SURGE, HEAVY = 3, 40, 25

_HOLD, _END = "\ue000", "\ue001"
#: Around the text of a link, and around the content of a navigation element.
_LINKED, _UNLINKED, _NAV, _UNNAV = "\ue002", "\ue003", "\ue004", "\ue005"
_MARKS = re.compile("[\ue002-\ue005]")

# --- patterns: code and formulas -------------------------------------------------------------
_FENCE = re.compile(r"(?ms)^[ ]{0,3}(`{3,}|~{3,})[^\n`]*\n(.*?)(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)")
_VERBATIM = re.compile(r"(?s)\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?\n?(.*?)(?:\\end\{\1\*?\}|\Z)")
_PRE = re.compile(r"(?is)<pre\b[^<>]*>(.*?)(?:</pre\s*>|\Z)")
_NOWIKI = re.compile(r"(?is)<(nowiki|syntaxhighlight|source)\b[^<>]*>(.*?)(?:</\1\s*>|\Z)")
_SCRIPT = re.compile(r"(?is)<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)")
_COMMENT = re.compile(r"(?s)<!--.*?(?:-->|\Z)")
_DISPLAY = re.compile(r"\\\[|\$\$|\\begin\{((?:equation|align|gather|math|displaymath)\*?)\}")
_INLINE = re.compile(r"(?<![\w$\\])\$(?=[^\s$])([^$\n]+)(?<=[^\s\\])\$(?![\w$])|\\\(([^\n]+?)\\\)")
_MATHY = re.compile(r"\\[A-Za-z]+|[\^_]\{|[\^_=<>+]")
_MATHTAG = re.compile(r"(?is)<math\b[^<>]*>(.*?)</math\s*>")
# --- html ------------------------------------------------------------------------------------
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>")
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,8}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
# --- markdown --------------------------------------------------------------------------------
_ATX = re.compile(r"(?m)^[ ]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")
_SETEXT = re.compile(r"(?m)^(?=[^\n]*[^\W\d_])([^\n]+)\n[ ]{0,3}(={3,}|-{3,})[ \t]*$")
_IMAGE = re.compile(r"!\[([^\]\n]*)\]\(([^()\n]*)\)")
_LINK = re.compile(r"(?<!!)\[([^\[\]\n]+)\]\(([^()\s]+)(?:\s+\"[^\"\n]*\")?\)")
_NOTE = re.compile(r"\[\^[^\]\s]{1,20}\](:)?")
_STRONG = re.compile(r"(?<![\w*])\*\*(?=\S)|(?<![\w_])__(?=\S)")
_STRONG_ENDS = {"**": re.compile(r"(?<=\S)(?=\*\*(?!\*))"), "__": re.compile(r"(?<=\S)(?=__(?![\w_]))")}
_EM = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])")
_STRIKE = re.compile(r"(?<!~)~~(?=\S)([^~\n]+?)(?<=\S)~~(?!~)")
_TICK = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)\1(?!`)")
_QUOTE = re.compile(r"(?m)^[ ]{0,3}>[ ]?(?=\S)")
_MD_SEPARATOR = re.compile(r"(?m)^[ ]{0,3}\|?(?:[ \t]*:?-+:?[ \t]*\|)+(?:[ \t]*:?-+:?[ \t]*)?$")
_MD_ROW = re.compile(r"(?m)^[ ]{0,3}\|(?![-}|+])[^|\n]+(?:\|[^|\n]+)+\|[ \t]*$")
_TASK = re.compile(r"(?m)^([ \t]{0,8}[-*+])[ ]+\[[ xX]\][ ]+")
_BULLET = re.compile(r"^[ \t]{0,8}([-*+])[ \t]+(?=[^\W\d_`*\[\ue000\"(])")
_NUMBER = re.compile(r"^[ \t]{0,8}(\d{1,3})[.)][ \t]+(?=\S)")
# --- wiki ------------------------------------------------------------------------------------
_WIKI_HEAD = re.compile(r"(?m)^(={1,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$")
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n]+)\]\]")
_WIKI_URL = re.compile(r"(?<!\])\[(?:https?|ftp)://\S+[ \t]+([^\]\n]+)\]")
_TEMPLATE = re.compile(r"\{\{[^{}\n]*\}\}")
_WIKI_TABLE = re.compile(r"(?m)^\{\|[^\n]*$|^\|\}[ \t]*$|^\|-[^\n|]*$")
_WIKI_CELLS = re.compile(r"(?m)^[!|][ \t]?(?![-}+])([^\n]*(?:!!|\|\|)[^\n]*)$")
_QUOTES = re.compile(r"'{2,5}(?=\S)([^'\n]+(?:'[^'\n]+)*?)'{2,5}")
# --- latex -----------------------------------------------------------------------------------
_TEX_HEAD = re.compile(r"\\(part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\{([^{}\n]*)\}")
_TEX_LEVEL = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
_TEX_ITEM = re.compile(r"(?m)^[ \t]*\\item\b(?:\[([^\]\n]*)\])?[ \t]*")
_TEX_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}((?:\[[^\]\n]*\]|\{[^{}\n]*\})*)")
_TEX_SILENT = re.compile(r"~?\\(?:cite[a-z]*|ref|eqref|pageref|label|index|bibliography|includegraphics|vspace|hspace|usepackage|documentclass|pagestyle)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}")
_TEX_KEEP = re.compile(r"\\(?:text[a-z]{2}|emph|underline|footnote|caption|title|author|mbox|href|url|texttt)\*?\{([^{}]*)\}")
_TEX_COMMAND = re.compile(r"\\(?:maketitle|centering|newpage|clearpage|noindent|bigskip|medskip|smallskip|par|hline|toprule|midrule|bottomrule|tableofcontents|small|large|LaTeX|TeX|ldots|dots)\b(?:\{\})?")
_TEX_ANY = re.compile(r"\\[A-Za-z]{2,}\*?\{([^{}\n]*)\}")
_TABULAR = re.compile(r"(?s)\\begin\{(tabular|tabularx|array|longtable)\*?\}(?:\{[^{}\n]*\})*(.*?)(?:\\end\{\1\*?\}|\Z)")

_BLOCK = {"p", "div", "br", "tr", "table", "ul", "ol", "dl", "dt", "section", "article", "header", "footer", "nav", "blockquote", "hr", "thead", "tbody", "body", "html", "head", "figure", "form"}
_NAVIGATION = {"nav", "header", "footer", "aside", "menu"}
#: Elements that make a text a web page rather than a text with a few tags.
_PAGE_TAG = re.compile(r"(?i)<(?:html|body|div|nav|header|footer|aside|menu|main|article)\b")


def display_spans(s: str) -> list[tuple[int, int, int, int]]:
    """(start, body start, body end, end) of display formulas of any length. Linear: an opening sign
    whose closing sign is not met ahead rules out all later ones of its kind."""
    out, at, missing = [], 0, set()
    while m := _DISPLAY.search(s, at):
        close = f"\\end{{{m.group(1)}}}" if m.group(1) else "\\]" if m.group() == "\\[" else "$$"
        end = -1 if close in missing else s.find(close, m.end() + 1)
        if end < 0:
            missing.add(close)
            at = m.start() + 1
        else:
            at = end + len(close)
            out.append((m.start(), m.end(), end, at))
    return out


def strong_spans(s: str) -> list[tuple[int, int, int, int]]:
    """The same of strong text of any length; possible ends are listed once."""
    out, at, ends = [], 0, {}
    while m := _STRONG.search(s, at):
        sign = m.group()
        if sign not in ends:
            ends[sign] = [x.start() for x in _STRONG_ENDS[sign].finditer(s)]
        k = bisect_left(ends[sign], m.end() + 1)
        if k == len(ends[sign]):
            at = m.start() + 1
        else:
            at = ends[sign][k] + 2
            out.append((m.start(), m.end(), ends[sign][k], at))
    return out


class _Text:
    """One text under conversion: the working string, what is set aside, the families met."""

    def __init__(self, text: str):
        self.s = text.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n").replace(_HOLD, "").replace(_END, "")
        self.s = _MARKS.sub("", self.s)
        self.kept: list[str] = []
        self.found: set[str] = set()

    def hold(self, content: str) -> str:
        self.kept.append(content)
        return f"{_HOLD}{len(self.kept) - 1}{_END}"

    def spans(self, family: str, spans: list[tuple[int, int, int, int]], put) -> None:
        """Replace each span by what ``put`` makes of its body."""
        out, at = [], 0
        for a, b, c, d in spans:
            self.found.add(family)
            out += [self.s[at:a], put(self.s[b:c])]
            at = d
        self.s = "".join(out) + self.s[at:]

    def sub(self, family: str, pattern: re.Pattern, repl) -> None:
        out, n = pattern.subn(repl, self.s)
        if n:
            self.found.add(family)
            self.s = out

    def code(self, family: str, pattern: re.Pattern, group: int, unescape: bool = False) -> None:
        def put(m: re.Match) -> str:
            body = m.group(group) or ""
            if unescape:
                body = html.unescape(_TAG.sub("", body))
            return "\n" + self.hold("```\n" + body.strip("\n") + "\n```") + "\n"

        self.sub(family, pattern, put)

    def release(self, s: str) -> str:
        back = re.compile(f"{_HOLD}(\\d+){_END}")
        while _HOLD in s:
            s = back.sub(lambda m: self.kept[int(m.group(1))], s)
        return s


def _html(t: _Text) -> None:
    def tag(m: re.Match) -> str:
        name, closing = m.group(1).lower(), m.group().startswith("</")
        if re.fullmatch(r"h[1-6]", name):
            return "\n" if closing else "\n" + "#" * int(name[1]) + " "
        if name == "li":
            return "" if closing else "\n- "
        if name in ("td", "th"):
            return "" if closing else " | "
        if name == "a":
            return _UNLINKED if closing else _LINKED
        if name in _NAVIGATION:
            return _UNNAV + "\n" if closing else "\n" + _NAV
        return "\n" if name in _BLOCK else ""

    t.sub("html", _TAG, tag)
    t.sub("html", _ENTITY, lambda m: html.unescape(m.group()).replace("\xa0", " "))


def _latex(t: _Text) -> None:
    def rows(m: re.Match) -> str:
        body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule)\b", "", m.group(2))
        cells = [[c.strip() for c in re.split(r"(?<!\\)&", r)] for r in body.split("\\\\")]
        return "\n" + "\n".join(" | ".join(r) for r in cells if any(r)) + "\n"

    t.sub("latex", _TABULAR, rows)
    t.sub("latex", _TEX_HEAD, lambda m: "\n" + "#" * _TEX_LEVEL[m.group(1)] + " " + m.group(2) + "\n")
    t.sub("latex", _TEX_ITEM, "- ")
    t.sub("latex", _TEX_ENV, "")
    t.sub("latex", _TEX_SILENT, "")
    for _ in range(3):
        t.sub("latex", _TEX_KEEP, r"\1")
    t.sub("latex", _TEX_COMMAND, "")
    t.sub("latex", _TEX_ANY, r"\1")


def _wiki(t: _Text) -> None:
    t.sub("wiki", _WIKI_HEAD, lambda m: "#" * len(m.group(1)) + " " + m.group(2))
    t.sub("wiki", _TEMPLATE, "")
    t.sub("wiki", _WIKI_LINK, lambda m: _LINKED + m.group(1).rpartition("|")[2] + _UNLINKED)
    t.sub("wiki", _WIKI_URL, rf"{_LINKED}\1{_UNLINKED}")
    t.sub("wiki", _WIKI_CELLS, lambda m: re.sub(r"[ \t]*(?:!!|\|\|)[ \t]*", " | ", m.group(1)))
    if _WIKI_TABLE.search(t.s):
        t.sub("wiki", re.compile(r"(?m)^[!|][ \t]+(?=[^\s|])"), "")
    t.sub("wiki", _WIKI_TABLE, "")
    t.sub("wiki", _QUOTES, r"\1")


def _markdown_lists(t: _Text) -> None:
    """A list is an item of letters after a bullet, or numbered lines that count on."""
    lines = t.s.split("\n")
    numbers = {k: int(m.group(1)) for k, l in enumerate(lines) if (m := _NUMBER.match(l))}
    for k, l in enumerate(lines):
        if m := _BULLET.match(l):
            t.found.add("markdown")
            lines[k] = "- " + l[m.end() :]
        elif k in numbers:
            after = next((j for j in range(k + 1, min(k + 3, len(lines))) if lines[j].strip()), None)
            before = next((j for j in range(k - 1, max(k - 3, -1), -1) if lines[j].strip()), None)
            if numbers.get(after) == numbers[k] + 1 or numbers.get(before) == numbers[k] - 1 or numbers[k] == 1 and (k == 0 or not lines[k - 1].strip()):
                t.found.add("markdown")
    t.s = "\n".join(lines)


def _markdown(t: _Text) -> None:
    t.sub("markdown", _TICK, lambda m: t.hold(m.group(2)))
    t.sub("markdown", _IMAGE, r"\1")
    t.sub("markdown", _LINK, rf"{_LINKED}\1{_UNLINKED}")
    t.sub("markdown", _NOTE, "")
    t.sub("markdown", _MD_SEPARATOR, "")
    t.sub("markdown", _MD_ROW, lambda m: m.group().strip().strip("|").strip())
    t.sub("markdown", _SETEXT, lambda m: ("# " if m.group(2)[0] == "=" else "## ") + m.group(1).strip())
    t.sub("markdown", _TASK, r"\1 ")
    t.sub("markdown", _QUOTE, "")
    t.spans("markdown", strong_spans(t.s), lambda body: body)
    t.sub("markdown", _STRIKE, r"\1")
    t.sub("markdown", _EM, r"\1")


def _weigh(lines: list[str]) -> tuple[list[int], list[bool]]:
    """(letters and digits of each line outside links and navigation, whether it is nothing but
    navigation or one of several lines or links that follow each other)."""
    size, residue, links, linked, nav = [], [], [], False, 0
    for l in lines:
        n = other = 0
        if _MARKS.search(l) or linked or nav:
            for part in re.split("([\ue002-\ue005])", l):
                if part in (_LINKED, _UNLINKED):
                    linked = part == _LINKED
                elif part in (_NAV, _UNNAV):
                    nav = max(0, nav + (1 if part == _NAV else -1))
                elif linked or nav:
                    other += len(re.sub(r"[\W_]+", "", part))
                else:
                    n += len(re.sub(r"[\W_]+", "", part))
            linked = linked and bool(l.strip())  # a link left open ends with its paragraph
        else:
            n = len(re.sub(r"[\W_]+", "", l))
        size.append(n if _HOLD not in l else n + SURGE)
        residue.append(other > 0 and n == 0)
        links.append(2 if nav or _UNNAV in l else l.count(_LINKED))
    # One link on its own is a reference; several together are a menu.
    k = 0
    while k < len(lines):
        end, blank = k, 0
        while end < len(lines) and (residue[end] or not lines[end].strip()) and blank < WINDOW:
            blank = 0 if residue[end] else blank + 1
            end += 1
        if sum(links[k:end]) < 2:
            residue[k:end] = [False] * (end - k)
        k = max(end, k + 1)
    return size, residue


def main_blocks(lines: list[str], page: bool = False, window: int = WINDOW, surge: int = SURGE, heavy: int = HEAVY) -> list[str]:
    """Lines of the main text by line-block distribution.

    ``d[k]`` sums the lengths of lines k .. k+window-1, without links and navigation. Where d reaches
    ``surge`` at a line with text a block opens; where d falls to zero (a dive: no text in a whole
    window) it closes. Outside the blocks menus of links and navigation go. In a web page
    (``page``) a block begins and ends with a line of at least ``heavy`` characters or a finished
    sentence, and loose lines before the first and after the last block go too; headings, list items,
    rows of tables, code and formulas stay. Without a surge all lines stay."""
    size, residue = _weigh(lines)
    d = [sum(size[k : k + window]) for k in range(len(lines))]
    keep, blocks, k = [False] * len(lines), [], 0
    while k < len(lines):
        if not (size[k] and d[k] >= surge):
            k += 1
            continue
        end = k
        while end < len(lines) and d[end] > 0:
            end += 1
        full = [i for i in range(k, end) if size[i] >= heavy or re.search(r"[.!?…:;][\"'»”)\]]*\s*$", lines[i])] if page else [i for i in range(k, end) if size[i]]
        if full:
            blocks.append((full[0], full[-1]))
            keep[full[0] : full[-1] + 1] = [True] * (full[-1] + 1 - full[0])
        k = end
    if not blocks:
        return lines
    first, last = blocks[0][0], blocks[-1][1]
    for k, l in enumerate(lines):
        loose = page and (k < first or k > last) and 0 < size[k] < heavy
        structure = l.startswith(("#", "- ")) or " | " in l or _HOLD in l
        keep[k] = keep[k] or not residue[k] and (not loose or structure)
    return [l for l, k in zip(lines, keep) if k]


def convert(text: str | None) -> tuple[str, set[str]]:
    """(clean text, families of markup met). Null and blank texts give ('', {})."""
    if not text or not text.strip():
        return "", set()
    t = _Text(text)
    # What must survive untouched goes first.
    t.code("latex", _VERBATIM, 2)
    t.code("markdown", _FENCE, 2)
    t.sub("html", _COMMENT, "")
    t.sub("html", _SCRIPT, "\n")
    t.code("wiki", _NOWIKI, 2, True)
    t.code("html", _PRE, 1, True)
    t.sub("html", _MATHTAG, lambda m: t.hold("$" + m.group(1).strip() + "$"))
    t.spans("latex", display_spans(t.s), lambda body: "\n" + t.hold("$$ " + body.strip() + " $$") + "\n")

    def inline(m: re.Match) -> str:
        body = m.group(1) or m.group(2)
        if not (m.group(2) or _MATHY.search(body) or re.fullmatch(r"[A-Za-z]", body)) or re.search(r"[A-Z]{1,2}$", body) and not _MATHY.search(body):
            return m.group()
        t.found.add("latex")
        return t.hold("$" + body + "$")

    t.s = _INLINE.sub(inline, t.s)
    # Wiki headings before setext ones; headings of the source before those made from other markup.
    if _ATX.search(t.s):
        t.found.add("markdown")
    _wiki(t)
    _markdown_lists(t)
    _markdown(t)
    _latex(t)
    _html(t)
    s = re.sub(r"[ \t]+\n", "\n", t.s)
    lines = [re.sub(r"[ \t]{2,}", " ", l).rstrip() for l in s.split("\n")]
    body = _MARKS.sub("", "\n".join(main_blocks(lines, bool(_PAGE_TAG.search(text)))))
    return re.sub(r"\n{3,}", "\n\n", t.release(body)).strip(), t.found


def clean_markup(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys..., clean STRING, markup ARRAY<STRING>)``, one row per input row.

    Null and blank texts give an empty text without markup. Headings, list items, code blocks and
    formulas stay; other columns are dropped before the rows leave the JVM.
    """
    kinds = dict(df.dtypes)
    names = [f"k{i}" for i in range(len(keys))]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [convert(x) for x in pdf["t"]]
            out = pdf[names].copy()
            out["clean"] = [c for c, _ in got]
            out["markup"] = [[f for f in FAMILIES if f in fs] for _, fs in got]
            yield out

    schema = ", ".join(f"{n} {kinds[k]}" for n, k in zip(names, keys)) + ", clean string, markup array<string>"
    out = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("t")).mapInPandas(work, schema)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "clean", "markup")
