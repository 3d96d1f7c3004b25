"""Noise in text from scanned pages (problem 1).

Corpus-wide counts of words tell damaged words from sound ones. A sum over fifth powers of character
codes is an anagram hash: exchanging one character sequence for another changes it by a fixed
difference, so rare words meet their frequent variants in one equi-join on hash plus difference, per
kind of confusion, without comparing words pairwise. Corrections are ranked by the variant's count.
Lines at page edges that recur or carry the form of running heads, lines that only number the page,
and words cut at line ends (with the counts of the joined word as evidence) are found per text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellum.llm.text_stats import COMMON
from vellum.runtime import broadcast_if_small, cut

#: Misread sequence and what was printed (fixed values).
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("α", "a"), ("@", "a"), ("ı", "i"), ("!", "i"), ("ŕ", "r"), ("†", "t"), ("7", "t"),
    ("0", "o"), ("ô", "o"), ("1", "l"), ("|", "l"), ("5", "s"), ("8", "b"), ("9", "g"), ("2", "z"), ("6", "é"),
    ("(", "c"), ("¢", "ç"), ("р", "p"), ("ν", "v"), ("ï", "í"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ri", "n"), ("ii", "u"),
    ("cl", "d"), ("rn", "m"), ("li", "h"), ("im", "nn"), ("vv", "w"),
]
#: A word is frequent from this share of all words on, so there are at most 1 / share of them.
FREQUENT_SHARE, FREQUENT_LEAST = 1e-5, 4
#: How many times as frequent a variant must be.
RATIO = 20
_P = 2_147_483_647

_HYPHENS = "-‐­¬"
_CUT = re.compile(rf"(?<![^\W\d_])([^\W\d_]+)([{_HYPHENS}])[ \t]*\n[\s]*([^\W\d_]+)")
_MAY_CUT = re.compile(rf"[{_HYPHENS}][ \t]*\n")
_SPELLED = re.compile(r"(?<![^\s(\"«“])[^\W\d_](?:[ \n][^\W\d_]){2,}(?![^\s.,;:)!?\"»”])")
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_PAGE = re.compile(
    rf"[-–—\[(]?\s*(?:(?:p[aáà@α]g[iı!í]na|p[aα@]ge|se[iı!]te|p[aá]g|fol?ha|hoja|p|s)\.?\s*)?(?:\d{{1,4}}|{_ROMAN})(?:\s*(?:/|de|of|sur|von)\s*\d{{1,4}})?\s*[-–—\])]?",
    re.I,
)
_PAGE_ENDS = frozenset("ivxlcdmIVXLCDMıİ-–—])")  # what a page number without a digit at its end may end with
_ITEM = re.compile(r"\s*(?:[-*+•–—·|>#]|\d{1,3}[.)]\s|\d{1,3} - |\[[ xX]?\]|\\|<|\{|\[\^|={2,}|!|`|~)")
_FORM = re.compile(
    r"\S {3,}\S|\d\.\d {2}\S|[^\W\d_]{3} [·|—] [^\W\d_]|[a-zà-ÿ](?:[A-ZÀ-Þ][a-zà-ÿ]+|[A-ZÀ-Þ]{2}-\d+)(?: |$)|^[A-ZÀ-Þ][^\W\d_]*(?: [A-ZÀ-Þ][^\W\d_]*)? \d\.\d {2}"
)
_FOLD = str.maketrans({"α": "a", "@": "a", "ı": "i", "!": "i", "ŕ": "r", "†": "t", "7": "t", "0": "o", "ô": "o", "1": "l", "|": "l", "c": "e", "(": "e", "¢": "ç", "р": "p", "ν": "v"})

#: Words of a text as the vocabulary counts them: letters with misread signs among them.
WORD = r"[\p{L}\p{M}0-9!|@†¢]++(?:\([\p{L}\p{M}0-9!|@†¢]++)*+"


def _joined(t: Column) -> Column:
    """Text whose line-end hyphens are closed and whose addresses are gone."""
    plain = F.when(F.contains(t, F.lit("://")) | F.lower(t).contains("www."), F.regexp_replace(t, r"(?i)\b(?:https?|ftp)://\S+|\bwww\.\S+", " ")).otherwise(t)
    # The hyphen stands before the look behind it, so that only hyphens are looked at.
    return F.regexp_replace(plain, rf"[{_HYPHENS}](?<=\p{{L}}[{_HYPHENS}])[ \t]*\r?\n\s*(?=\p{{L}})", "")


def raw_words(t: Column) -> Column:
    """Written forms of a text's words, hyphened compounds whole."""
    return F.regexp_extract_all(_joined(t), F.lit(f"({WORD}(?:-{WORD})*+)"), F.lit(1))


def plain_form(o: Column) -> Column:
    """A written form without closing ``!`` or ``|``; null unless it has at least three letters and is
    mostly letters. Meant for distinct forms, not for every word of the corpus."""
    w = F.regexp_replace(o, r"[!|(]+$", "")
    letters = F.length(F.regexp_replace(w, r"[^\p{L}]", ""))
    return F.when((letters >= 3) & (letters * 2 > F.length(w)), w)


def anagram_hash(w: Column) -> Column:
    """Sum over the characters of code ** 5 modulo a prime: the same for all orders of the letters."""

    def power(c):
        x = F.ascii(c).cast("bigint")
        x2 = x * x % F.lit(_P)
        return x2 * x2 % F.lit(_P) * x % F.lit(_P)

    return F.aggregate(F.split(w, ""), F.lit(0).cast("bigint"), lambda a, c: a + F.when(c == "", F.lit(0).cast("bigint")).otherwise(power(c)))


def _hash(s: str) -> int:
    return sum(pow(ord(c), 5, _P) for c in s)


def prepared(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``(keys..., text)`` and ``h``, the hash of the text."""
    return texts.select(*keys, "text").distinct().withColumn("h", F.xxhash64("text"))


def written_forms(rows: DataFrame) -> DataFrame:
    """``(o, n, n_rows)``: how often each written form stands in distinct texts and in all rows of
    :func:`prepared`; combined map-side."""
    once = rows.where("text is not null").groupBy("text").agg(F.count("*").alias("copies"))
    return once.select("copies", F.explode(raw_words(F.col("text"))).alias("o")).groupBy("o").agg(F.count("*").alias("n"), F.sum("copies").alias("n_rows"))


def _parts(forms: DataFrame, *columns: str) -> DataFrame:
    """Written forms by the parts of compounds, ``p`` being the plain form of each."""
    return forms.select("o", *columns, F.explode(F.split("o", "-")).alias("p")).withColumn("p", plain_form(F.col("p"))).where("p is not null")


def vocabulary(forms: DataFrame) -> DataFrame:
    """``(w, n, capital, n_rows)`` from :func:`written_forms`: counts of lower-cased words and how many
    began with a capital only, over distinct texts, and counts over all rows."""
    capital = F.when(F.col("p").rlike(r"^\p{Lu}.*\p{Ll}"), F.col("n")).otherwise(0)
    return _parts(forms, "n", "n_rows").groupBy(F.lower("p").alias("w")).agg(F.sum("n").alias("n"), F.sum(capital).alias("capital"), F.sum("n_rows").alias("n_rows"))


def frequent_floor(vocab: DataFrame, share: float = FREQUENT_SHARE, least: int = FREQUENT_LEAST) -> int:
    """Least count of a frequent word."""
    return max(least, int((vocab.agg(F.sum("n")).first()[0] or 0) * share))


def corrections(vocab: DataFrame, floor: int, ratio: int = RATIO) -> DataFrame:
    """``(w, fix, n)``: best frequent variant of each rare word that a listed confusion explains.

    The rare side carries one row per confusion it contains, with the hash its variant must have;
    equality is verified on the words themselves (one place, or all places of the confusion). A word
    met with a capital only is a name, not the misread form of a word usually written without.

    Copies of a damaged text must not make its words look sound, so a variant counts that is frequent
    and ``ratio`` times as frequent over distinct texts; one that is so over all rows counts too if it
    is the more frequent over distinct texts."""
    clean = vocab.where((F.col("n") >= floor) & F.col("w").rlike(r"^[\p{L}\p{M}]+$")).select(F.col("w").alias("fix"), F.col("n").alias("m"), F.col("n_rows").alias("m_rows"), (F.col("capital") / F.col("n")).alias("fix_capital"), anagram_hash(F.col("w")).alias("h"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(_hash(b) - _hash(a)).cast("bigint").alias("d")) for a, b in CONFUSIONS])
    odd = vocab.withColumn("x", F.explode(F.filter(pairs, lambda p: F.contains(F.col("w"), p["a"]))))
    times = ((F.length("w") - F.length(F.replace(F.col("w"), F.col("x.a"), F.lit("")))) / F.length("x.a")).cast("int")
    odd = odd.withColumn("times", times).withColumn("k", F.explode(F.array_distinct(F.array(F.lit(1), F.col("times")))))
    odd = odd.select("w", "n", "n_rows", "capital", "x", "k", (anagram_hash(F.col("w")) + F.col("k") * F.col("x.d")).alias("h"))
    times_more = (F.col("m") >= F.col("n") * ratio) | (F.col("m_rows") >= F.col("n_rows") * ratio) & (F.col("m") > F.col("n"))
    met = odd.join(clean, "h").where(times_more & ~((F.col("capital") > 0.8 * F.col("n")) & (F.col("fix_capital") < 0.5)))
    once = F.expr("exists(sequence(1, length(w)), p -> substring(w, p, length(x.a)) = x.a and concat(substring(w, 1, p - 1), x.b, substring(w, p + length(x.a), length(w))) = fix)")
    met = met.where(F.when(F.col("k") == 1, once).otherwise(F.replace(F.col("w"), F.col("x.a"), F.col("x.b")) == F.col("fix")))
    return met.groupBy("w").agg(F.max(F.struct("m", "fix")).alias("b"), F.first("n").alias("n")).select("w", F.col("b.fix").alias("fix"), "n")


def written_fixes(forms: DataFrame, fixes: DataFrame) -> DataFrame:
    """``(o, w, fix)``: the corrections by written form."""
    return _parts(forms).select("o", F.lower("p").alias("w")).distinct().join(fixes.select("w", "fix"), "w")


def misread_words(rows: DataFrame, keys: list[str], by_form: DataFrame, n_forms: int) -> DataFrame:
    """``(keys..., w, fix)``: the corrections that occur in each text, each once."""
    words = rows.where("text is not null").select(*keys, F.explode(F.array_distinct(raw_words(F.col("text")))).alias("o"))
    return words.join(broadcast_if_small(by_form, n_forms), "o").select(*keys, "w", "fix").distinct()


# --- per text --------------------------------------------------------------------------------


def _lines(text: str) -> list[str]:
    return re.split(r"\n|\f", text)


def is_page_number(line: str) -> bool:
    """A line that only numbers the page."""
    s = line.strip()
    if not s or not (s[-1].isdigit() or s[-1] in _PAGE_ENDS) or not _PAGE.fullmatch(s):
        return False
    return not re.fullmatch(r"[a-z]", s, re.I) or s.lower() in "ivx"


def head_key(line: str) -> str | None:
    """Comparable form of a line that could be a running head; None if it cannot.

    The longest part counts, because names and numbers beside the title change sides or drop out
    from page to page."""
    s = line.strip()
    if not s or len(s) > 100 or _ITEM.match(line) or re.search(r"[.!?;,:]$|[()=]", s) or is_page_number(line):
        return None
    letters = re.findall(r"[^\W\d_]+", s)
    if len(letters) < 2 or len(letters) > 14 or sum(map(len, letters)) < 6 or letters[-1].lower() in COMMON or s[0].islower():
        return None
    part = max(re.split(r"\s{2,}| [·|—] ", s), key=len)
    return re.sub(r"\s+", " ", re.sub(r"\d+", "#", part)).casefold().translate(_FOLD)


def has_head_form(line: str) -> bool:
    """Whether a possible running head shows its parts: a title and a name or number set apart."""
    s = line.strip()
    letters = re.findall(r"[^\W\d_]+", s)
    if sum(len(x) == 1 for x in letters) > len(letters) / 3:
        return False
    return bool(_FORM.search(s)) and bool(re.match(r"[A-ZÀ-Þ]", s))


def edge_lines(lines: list[str], depth: int = 2) -> list[str]:
    """First and last lines of a page; lines that number the page do not count towards the depth."""
    full = [l for l in lines if l.strip()]
    body = [l for l in full if not is_page_number(l)]
    return body[:depth] + body[max(depth, len(body) - depth) :]


def is_cut_word(m: re.Match, frequent: Counter | dict) -> bool:
    """Whether a line-end hyphen cuts a word, by the counts of the joined word and of its hyphenated
    form; otherwise it is the hyphen of a compound."""
    a, mark, b = m.groups()
    if b[0].isupper() and not a.isupper():
        return False
    whole = frequent.get(a.lower() + "-" + b.lower(), 0)
    return mark != "-" or not whole or frequent.get((a + b).lower(), 0) > whole


_LETTERS = re.compile(r"[^\W\d_]+")
_RIGHT = re.compile(r"[ \n]([^\W\d_]+)(?![\w\-/])")


def is_gap(a: str, b: str, frequent: Counter | dict) -> bool:
    """Whether two neighbours are one word split by a gap: the joined word is frequent, a part is not."""
    if len(a) + len(b) < 5 or b[0].isupper() and not a.isupper():
        return False
    low = (a.lower(), b.lower())
    return low[0] + low[1] in frequent and (low[0] not in frequent and len(a) > 1 or low[1] not in frequent and len(b) > 1)


def gaps(text: str, frequent: Counter | dict) -> Iterator[tuple[int, int, int]]:
    """(start of the first part, its end, end of the second) of the words split by one gap, in order.

    A part of such a word is rare, so only rare words are looked at with their neighbours."""
    low = text.lower()
    if len(low) == len(text):
        rare = [m.span() for m in _LETTERS.finditer(low) if m.group() not in frequent]
    else:  # a sign whose lower case is longer
        rare = [m.span() for m in _LETTERS.finditer(text) if m.group().lower() not in frequent]
    starts = set()
    for a, e in rare:
        starts.add(a)
        if a > 1 and text[a - 1] in " \n" and text[a - 2].isalpha():
            k = a - 2
            while k and text[k - 1].isalpha():
                k -= 1
            starts.add(k)
    for a in sorted(starts):
        if a and (text[a - 1] in "-/" or text[a - 1] == "_" or text[a - 1].isalnum()):
            continue
        one = _LETTERS.match(text, a)
        if one and (two := _RIGHT.match(text, one.end())) and is_gap(one.group(), two.group(1), frequent):
            yield a, one.end(), two.end()


def inspect(text: str, frequent: Counter | dict, paged: bool) -> tuple[set[str], list[str]]:
    """(kinds of damage seen inside the text, keys of lines that may be running heads).

    ``paged``: the text is one page, so heads and page numbers stand at its edges; otherwise pages
    follow each other and a head recurs within the text."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    kinds: set[str] = set()
    lines = _lines(text)
    # Hyphenation, by the counts of the joined word and of its hyphenated form.
    cuts = bool(_MAY_CUT.search(text))
    if cuts and any(is_cut_word(m, frequent) for m in _CUT.finditer(text)):
        kinds.add("hyphenation")
    # Page numbers.
    full = [l for l in lines if l.strip()]
    where = full[:2] + full[-2:] if paged else full
    if any(is_page_number(l) for l in where):
        kinds.add("page_number")
    # Running heads: form, and recurrence within the text.
    keys: list[str] = []
    if paged:
        for l in edge_lines(lines):
            if k := head_key(l):
                keys.append(k)
                if has_head_form(l):
                    kinds.add("header")
    else:
        seen: Counter = Counter()
        form = False
        for l in full:
            if k := head_key(l):
                seen[k] += 1
                form = form or has_head_form(l) and len(l.strip()) < 90
        if form or any(n > 1 for n in seen.values()):
            kinds.add("header")
    # Gaps inside words.
    body = _CUT.sub(r"\1\3", text) if cuts else text
    for m in _SPELLED.finditer(body):
        run = re.sub(r"\s", "", m.group()).lower()
        if len(run) >= 5 or run in frequent:
            kinds.add("misread")
            break
    else:
        if next(gaps(body, frequent), None):
            kinds.add("misread")
    return kinds, keys


def frequent_words(forms: DataFrame, share: float) -> dict[str, int]:
    """Counts over distinct texts of frequent words of any length, hyphened ones included; at most
    1 / share."""
    word = F.regexp_extract_all(F.lower("o"), F.lit(r"(?<![\p{L}\p{N}])(\p{L}+(?:-\p{L}+)?)(?![\p{L}\p{N}])"), F.lit(1))
    w = cut(forms.select(F.explode(word).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")))
    floor = max(FREQUENT_LEAST, int((w.agg(F.sum("n")).first()[0] or 0) * share))
    return {r.w: r.n for r in w.where(F.col("n") >= floor).collect()}


def recurring_heads(heads: DataFrame) -> DataFrame:
    """Of ``(record, doc, page_num, head)`` those whose head stands on several pages of its document."""
    heads = heads.select("record", "doc", "page_num", "head").distinct()
    again = heads.groupBy("record", "doc", "head").agg(F.count("*").alias("n")).where("n > 1").select("record", "doc", "head")
    return heads.join(again, ["record", "doc", "head"], "left_semi")


def evidence(rows: DataFrame, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written forms, corrections of words, and corrections by written form, each materialised."""
    forms = cut(written_forms(rows))
    vocab = cut(vocabulary(forms))
    fixes = cut(corrections(vocab, frequent_floor(vocab, share)))
    return forms, fixes, cut(written_fixes(forms, fixes))


def find_damage(texts: DataFrame, page: str = "page_num", share: float = FREQUENT_SHARE) -> DataFrame:
    """``(record, doc, page_num, kind)`` from ``(record, doc, page_num, text)``.

    Kinds: hyphenation, misread, header, page_number, each at most once per text. ``page_num`` 0
    marks a text of several pages. Null and blank texts give nothing; repeated rows give one; of
    texts without a doc neither misread words nor recurring heads are reported (keys join by value).
    Heads of single pages are compared over the pages of their document by counting (document,
    line) pairs, so a document of very many pages is never gathered.
    """
    keys = ["record", "doc", "page_num"]
    rows = cut(prepared(texts.where(F.length(F.trim("text")) > 0), keys))
    forms, fixes, by_form = evidence(rows, share)
    misread = misread_words(rows, keys, by_form, by_form.count()).select(*keys).distinct().withColumn("kind", F.lit("misread"))
    held = rows.sparkSession.sparkContext.broadcast(frequent_words(forms, share))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = held.value
        for pdf in batches:
            out = []
            for r, d, p, t in zip(pdf["record"], pdf["doc"], pdf["page_num"], pdf["text"]):
                kinds, heads = inspect(t, frequent, bool(p))
                out.append((r, d, p, sorted(kinds), heads))
            yield pd.DataFrame(out, columns=[*keys, "kinds", "heads"])

    seen = cut(rows.select(*keys, "text").mapInPandas(look, "record string, doc string, page_num int, kinds array<string>, heads array<string>"))
    inside = seen.select(*keys, F.explode("kinds").alias("kind"))
    recurring = recurring_heads(seen.select(*keys, F.explode("heads").alias("head"))).select(*keys).withColumn("kind", F.lit("header"))
    return inside.unionByName(misread).unionByName(recurring).distinct()


def close_gaps(run: str, frequent: dict[str, int]) -> str:
    """A spelled-out run as one word, or as two where a one-letter word stands at its edge."""
    w = re.sub(r"\s", "", run)
    if w.lower() in frequent or len(w) < 4:
        return w if w.lower() in frequent or len(w) > 4 else run
    if w[1:].lower() in frequent:
        return f"{w[0]} {w[1:]}"
    if w[:-1].lower() in frequent:
        return f"{w[:-1]} {w[-1]}"
    return w if len(w) > 4 else run


def close_splits(text: str, frequent: dict[str, int]) -> str:
    """Text whose words split by one gap are closed; a word is joined to one neighbour only."""
    out, at, used = [], 0, -1
    for a, e, end in gaps(text, frequent):
        if a > used:
            out.append(text[at:e])
            at, used = e + 1, end
    return "".join(out) + text[at:]


def _close_cuts(text: str, frequent: dict[str, int]) -> str:
    """Text whose line-end hyphens are closed; the hyphen of a compound stays."""
    return _CUT.sub(lambda m: m.group(1) + ("" if is_cut_word(m, frequent) else m.group(2)) + m.group(3), text)


def _kept_lines(lines: list[str], heads: set[str], paged: bool) -> list[str]:
    """Lines without heads and page numbers, which stand at the edges of a page as in :func:`inspect`."""
    if not paged:
        seen = Counter(k for l in lines if (k := head_key(l)))
        return [l for l in lines if not (is_page_number(l) or (k := head_key(l)) and (k in heads or seen[k] > 1 or has_head_form(l)))]
    full = [i for i, l in enumerate(lines) if l.strip()]
    body = [i for i in full if not is_page_number(lines[i])]
    drop = {i for i in full[:2] + full[-2:] if is_page_number(lines[i])}
    drop |= {i for i in body[:2] + body[max(2, len(body) - 2) :] if (k := head_key(lines[i])) and (k in heads or has_head_form(lines[i]))}
    return [l for i, l in enumerate(lines) if i not in drop]


def repair(text: str | None, fixes: dict[str, str], heads: set[str], frequent: dict[str, int] | None = None, paged: bool = False) -> str:
    """Readable paragraphs: heads and page numbers dropped, cut words joined, misread words, split
    and spelled-out words corrected, wrapped lines unwrapped. Null gives an empty text.

    ``paged``: the text is one page, ``heads`` are the keys that recur over the pages of its document."""
    if not text:
        return ""
    frequent = frequent or {}
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    s = _close_cuts("\n".join(_kept_lines(_lines(text), heads, paged)), frequent)
    s = _SPELLED.sub(lambda m: close_gaps(m.group(), frequent), s)
    s = close_splits(s, frequent)

    def fix(m: re.Match) -> str:
        f = fixes.get(m.group().lower())
        if f is None:
            return m.group()
        return f.upper() if m.group().isupper() and len(f) > 1 else f.capitalize() if m.group()[0].isupper() else f

    if fixes:
        s = re.sub(r"[^\W_]?[\w!|@†¢(]*[\w]", fix, s)
    out: list[str] = []
    for l in s.split("\n"):
        l = l.strip()
        if not l:
            out.append("")
        elif out and out[-1] and not _ITEM.match(l):
            out[-1] += " " + l
        else:
            out.append(l)
    return re.sub(r"\n{2,}", "\n\n", "\n".join(out)).strip()


def repaired(texts: DataFrame, share: float = FREQUENT_SHARE) -> DataFrame:
    """``(record, doc, page_num, text)`` with the text repaired, one row per distinct input row.

    Corrections and the heads that recur over the pages of its document travel with their own text only."""
    keys = ["record", "doc", "page_num"]
    rows = cut(prepared(texts, keys))
    forms, fixes, by_form = evidence(rows, share)
    found = misread_words(rows, [*keys, "h"], by_form, by_form.count())
    own = found.groupBy(*keys, "h").agg(F.map_from_arrays(F.collect_list("w"), F.collect_list("fix")).alias("fixes"))
    held = rows.sparkSession.sparkContext.broadcast(frequent_words(forms, share))

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pages = [{k for l in edge_lines(_lines(t.replace("\r\n", "\n").replace("\r", "\n"))) if (k := head_key(l))} for t in pdf["text"]]
            yield pdf[keys].assign(head=[sorted(x) for x in pages]).explode("head").dropna(subset=["head"])

    pages = rows.where("text is not null and page_num <> 0").select(*keys, "text").mapInPandas(edges, "record string, doc string, page_num int, head string")
    heads = recurring_heads(cut(pages)).groupBy(*keys).agg(F.collect_set("head").alias("heads"))
    joined = rows.join(own, [*keys, "h"], "left").join(heads, keys, "left").drop("h")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = zip(pdf["text"], pdf["fixes"], pdf["heads"], pdf["page_num"])
            yield pdf[keys].assign(text=[repair(t, dict(f) if f is not None else {}, set(h) if h is not None else set(), held.value, p != 0) for t, f, h, p in each])

    return joined.mapInPandas(work, "record string, doc string, page_num int, text string")


def assemble(pages: list[str]) -> str:
    """One text of repaired pages in order: a page that breaks off goes on in the next if that begins
    in lower case, and its line-end hyphen is closed then; otherwise a paragraph ends with the page."""
    out = ""
    for p in pages:
        if not p:
            continue
        if out and p[0].islower() and (m := re.search(rf"[^\W\d_][{_HYPHENS}]$", out)):
            out = out[: m.start() + 1] + p
        elif out:
            out += (" " if p[0].islower() and not re.search(r"[.!?:;…]$", out) else "\n\n") + p
        else:
            out = p
    return out


def assembled(pages: DataFrame) -> DataFrame:
    """``(record, doc, text)``: the repaired pages of each document as one text, in page order; a
    document is the unit of work. Texts without a doc belong together with nothing and stay alone."""
    alone = F.when(F.col("doc").isNull(), F.struct("page_num", "text"))
    whole = pages.groupBy("record", "doc", alone.alias("alone")).agg(F.transform(F.sort_array(F.collect_list(F.struct("page_num", "text"))), lambda x: x["text"]).alias("pages"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["record", "doc"]].assign(text=[assemble(list(p)) for p in pdf["pages"]])

    return whole.select("record", "doc", "pages").mapInPandas(work, "record string, doc string, text string")
