"""Per-document text quality statistics and the prose verdict (problem 2).

A text is cut into chunks of fixed length, each up to the next blank, so no word is cut. A chunk gives
counts that add up and, because a cut may fall inside a line or a sentence, a boundary state of fixed
size: the counters of the line and of the sentence open at its start and at its end. Joining two
neighbours closes what meets at the cut and adds up, so the result does not depend on where the cuts
fall, and what is carried is a row of numbers however long a line or sentence is. Partials of texts
with several chunks are joined in a tree, ``FAN`` neighbours at a time; texts of one chunk are counted
where they lie. Ratios and rules are derived from the joined counts alone.

Characters are classified by table lookup over whole batches; words are described once per distinct
form, and lines and sentences are sums between their ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Characters of a chunk (its last word is never cut); chunks joined per tree level; characters read at once.
CHUNK, FAN, BATCH = 65_536, 16, 1_000_000

#: Common words of the five languages (fixed values; the default of ``common``).
COMMON = frozenset(
    """a o as os um uma de do da dos das em no na nos nas por para com sem que se e ou não é foi foram ao à aos às pelo pela
    pelos pelas mais já como até quando enquanto isso mesmo assim ser sua seu
    the an of and to in on at is was were be by for with without that which it this if while not must should now until from
    there no when as its their has have
    el la los las y del en un una con sin su lo al fue es más ya hasta cuando mientras hay debe sobre
    le les des du et pour avec sans qui ne pas est été au aux son plus comme il faut sur dans par une jusqu tant même
    der die das den dem ein eine einen einem einer und oder im am an auf aus bei mit nach von vor zu zum zur für über unter
    nicht ist wird war dass wenn man sich weil durch""".split()
)
#: Signs counted as symbols (fixed values).
SYMBOLS = frozenset("|\\/<>{}[]~`^_=+@#$%&*!§°¬¦")
#: Vowels with marks of Portuguese (fixed values).
DIACRITICS = frozenset("áàãâäéêëíîïóôõöúûüçñ")

_LETTERS = re.compile(r"[^\W\d_]+")
_ITEM = re.compile(r"(?:[-*+•–·▪‣]|\d{1,3}[.)]?|\[[ xX]?\]|\[|[a-z]\))$")
_END = re.compile(r"[.!?…][\"'»”)\]]*$")
_LEADER = re.compile(r"\.{3,}|…{2,}|_{3,}")

#: Additive counts of a partial, then the longest run of one sign (a maximum).
COUNTS = ("chars", "alnum", "letters", "digits", "blank", "symbols", "diacritics", "words", "word_chars", "common", "singles", "lines", "full_lines", "line_chars", "stopped_lines", "item_lines", "sentences", "prose_words", "run")
#: Counters of a piece of a line: signs, whether it has words, begins with an item, ends with a stop.
LINE = ("chars", "pieces", "items", "stop")
#: Counters of a piece of a sentence: words, letter words, common words, single letters, semicolons.
SENTENCE = ("words", "letters", "common", "singles", "semis")
#: Boundary state: the pieces before the first and after the last end of a line (all in the first if
#: ``broken`` is 0), the same of sentences, and whether the first sentence is finished.
STATE = (*COUNTS, "broken", *[f"{e}_{c}" for e in ("hl", "tl") for c in LINE], "closed", "finished", *[f"{e}_{c}" for e in ("hs", "ts") for c in SENTENCE])
_AT = {c: i for i, c in enumerate(STATE)}

_ALNUM, _LETTER, _DIGIT, _SYMBOL, _MARKED, _BLANK, _NEWLINE = 1, 2, 4, 8, 16, 32, 64
_classes: np.ndarray | None = None


def _class(ch: str) -> int:
    out = _BLANK * ch.isspace() + _NEWLINE * (ch in "\n\f")
    if ch.isalnum():
        return out + _ALNUM + _LETTER * ch.isalpha() + _DIGIT * ch.isdigit() + _MARKED * (ch in DIACRITICS or ch.lower() in DIACRITICS)
    return out + _SYMBOL * (ch in SYMBOLS)


def _classify(codes: np.ndarray) -> np.ndarray:
    """Class bits of every character; the table of the basic plane is made once per process."""
    global _classes
    if _classes is None:
        _classes = np.array([_class(chr(c)) for c in range(0x10000)], np.uint8)
    out = _classes[np.minimum(codes, 0xFFFF)]
    for c in np.unique(codes[codes > 0xFFFF]):
        out[codes == c] = _class(chr(c))
    return out


class Tokens:
    """What the counts need to know of a run of non-blanks, worked out once per distinct run."""

    ITEM, LEADER, STOPPED, LAST, ORDINAL = 6, 7, 8, 9, 10

    def __init__(self, common: frozenset[str] = COMMON):
        self.common = common
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.n, self.table = 0, np.zeros((4096, 11), np.int64)

    def _add(self, tok: str) -> int:
        """Words, letters, word characters, common words, single letters, semicolons, then flags."""
        words = _LETTERS.findall(tok)
        leader = bool(_LEADER.search(tok))
        stopped = bool(_END.search(tok)) and not leader
        count = len(words) if words else int(any(map(str.isalnum, tok)))
        row = (
            count, len(words), sum(map(len, words)), sum(w.lower() in self.common for w in words), sum(len(w) == 1 for w in words), tok.count(";"),
            bool(_ITEM.match(tok)), leader, stopped, stopped or tok[-1] in ":;,", bool(re.fullmatch(r"\d{1,2}\.", tok)),
        )
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n] = row
        self.n += 1
        if len(tok) <= 64:
            self.rows[tok] = self.n - 1
        return self.n - 1

    def describe(self, tokens: list[str]) -> np.ndarray:
        if self.n > 200_000:
            self._reset()
        known = self.rows.get
        ids = [known(t) for t in tokens]
        for k, i in enumerate(ids):
            if i is None:
                i = known(tokens[k])
                ids[k] = self._add(tokens[k]) if i is None else i
        return self.table[ids] if ids else np.zeros((0, 11), np.int64)


def _is_prose(s: np.ndarray) -> np.ndarray:
    """Finished sentences of at least five letter words, a fifth of them common, not spelled out in
    single letters and not a row of items between semicolons."""
    letters = s[:, 1]
    return (letters >= 5) & (s[:, 2] >= 2) & (s[:, 2] >= 0.18 * letters) & (s[:, 3] <= 0.7 * letters) & (s[:, 4] <= 1)


def partials(texts: list[str], fresh: list[bool] | np.ndarray, tokens: Tokens) -> np.ndarray:
    """One row of ``STATE`` per chunk. ``fresh``: the chunk begins its text; others follow a word.

    Line ends are newlines and form feeds; carriage returns are taken for blanks."""
    n = len(texts)
    out = np.zeros((n, len(STATE)), np.int64)
    if not n:
        return out
    fresh = np.asarray(fresh, bool)
    whole = "\n".join(texts) + "\n"
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size + 1) - 1  # the newline put after each text
    begin = end - size
    cls = _classify(codes)
    at = lambda name: out[:, _AT[name]]
    at("chars")[:] = size
    for name, bit in (("alnum", _ALNUM), ("letters", _LETTER), ("digits", _DIGIT), ("symbols", _SYMBOL), ("diacritics", _MARKED), ("blank", _BLANK)):
        at(name)[:] = np.add.reduceat((cls & bit) > 0, begin, dtype=np.int64)
    at("blank")[:] -= 1
    # Longest run of one sign.
    blank = (cls & _BLANK) > 0
    change = np.ones(len(codes), bool)
    change[1:] = codes[1:] != codes[:-1]
    change[begin] = True
    runs = np.flatnonzero(change)
    length = np.where(blank[runs], 0, np.diff(np.append(runs, len(codes))))
    at("run")[:] = np.maximum.reduceat(length, np.searchsorted(runs, begin))
    # Words and their lines.
    found = whole.split()
    f = tokens.describe(found)
    starts = ~blank
    starts[1:] &= blank[:-1]
    pos = np.flatnonzero(starts)
    own = np.searchsorted(begin, pos, "right") - 1
    breaks = np.flatnonzero(cls & _NEWLINE)
    line = np.searchsorted(breaks, pos)
    head, tail = np.searchsorted(breaks, begin), np.searchsorted(breaks, end)
    m = len(breaks)
    new = np.ones(len(pos), bool)
    new[1:] = line[1:] != line[:-1]
    first = new & (fresh[own] | (line != head[own])) if len(pos) else new
    item = first & (f[:, Tokens.ITEM] > 0)
    lines = np.zeros((m, len(LINE)), np.int64)
    a = np.flatnonzero(new)
    lines[line[a], 0] = breaks[line[a]] - pos[a]
    lines[line[a], 1] = 1
    lines[line[a], 2] = item[a]
    z = np.append(a[1:], len(pos)) - 1 if len(a) else a
    lines[line[z], 3] = f[z, Tokens.LAST]
    lines[head[~fresh], 0] = breaks[head[~fresh]] - begin[~fresh]
    at("broken")[:] = tail > head
    out[:, _AT["hl_chars"] : _AT["hl_chars"] + 4] = lines[head]
    out[:, _AT["tl_chars"] : _AT["tl_chars"] + 4] = lines[tail] * (tail > head)[:, None]
    # Lines with both ends inside.
    inner = np.column_stack([np.ones(m, np.int64), lines[:, 1], lines[:, 0] * lines[:, 1], lines[:, 3], lines[:, 2]])
    total = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(inner, 0)])
    i = _AT["lines"]
    out[:, i : i + 5] = np.where((tail > head)[:, None], total[tail] - total[np.minimum(head + 1, tail)], 0)
    if not len(pos):
        return out
    # Sums over the words of each chunk.
    some, where = np.unique(own, return_index=True)
    for name, c in (("words", 0), ("word_chars", 2), ("common", 3), ("singles", 4)):
        at(name)[some] = np.add.reduceat(f[:, c], where)
    # Sentences: an item or a row of dots ends one unfinished, a stop finishes it. A number with a
    # point may be an ordinal; the sentence goes on then, as it does after the mark of an item.
    before = item | (f[:, Tokens.LEADER] > 0)
    after = (f[:, Tokens.STOPPED] > 0) & ~item & (f[:, Tokens.ORDINAL] == 0)
    cut = before.copy()
    cut[where] = True
    cut[1:] |= after[:-1]
    seg = np.flatnonzero(cut)
    sums = np.add.reduceat(f[:, [0, 1, 3, 4, 5]], seg)
    ended = after[np.append(seg[1:], len(pos)) - 1]
    seg_own = own[seg]
    is_first = np.ones(len(seg), bool)
    is_first[1:] = seg_own[1:] != seg_own[:-1]
    is_last = np.append(is_first[1:], True)
    is_head, is_tail = is_first & ~before[seg], is_last & ~ended
    mid = ~is_head & ~is_tail
    np.add.at(at("sentences"), seg_own[mid & ended], 1)
    prose = mid & ended & _is_prose(sums)
    np.add.at(at("prose_words"), seg_own[prose], sums[prose, 0])
    h, t = _AT["hs_words"], _AT["ts_words"]
    out[seg_own[is_head], h : h + 5] = sums[is_head]
    at("finished")[seg_own[is_head]] = ended[is_head]
    at("closed")[some] = 1
    at("closed")[seg_own[is_head & is_tail]] = 0
    only_tail = is_tail & ~is_head
    out[seg_own[only_tail], t : t + 5] = sums[only_tail]
    return out


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two pieces of one line."""
    return np.array([a[0] + b[0], a[1] | b[1], a[2] if a[1] else b[2], b[3] if b[1] else a[3]], np.int64)


def _end_line(s: np.ndarray, p: np.ndarray) -> None:
    s[_AT["lines"]] += 1
    if p[1]:
        s[_AT["full_lines"] : _AT["full_lines"] + 4] += np.array([1, p[0], p[3], p[2]])


def _end_sentence(s: np.ndarray, p: np.ndarray) -> None:
    s[_AT["sentences"]] += 1
    if _is_prose(p[None])[0]:
        s[_AT["prose_words"]] += p[0]


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """State of two neighbouring chunks; associative."""
    s, run = a + b, _AT["run"]
    s[run] = max(a[run], b[run])
    for kind, size, flag in (("l", 4, "broken"), ("s", 5, "closed")):
        h, t, c = _AT["hl_chars" if kind == "l" else "hs_words"], _AT["tl_chars" if kind == "l" else "ts_words"], _AT[flag]
        meet = _meet if kind == "l" else np.add
        s[c] = a[c] | b[c]
        if not a[c]:
            s[h : h + size], s[t : t + size] = meet(a[h : h + size], b[h : h + size]), b[t : t + size]
            if kind == "s":
                s[_AT["finished"]] = b[_AT["finished"]]
            continue
        s[h : h + size] = a[h : h + size]
        p = meet(a[t : t + size], b[h : h + size])
        s[t : t + size] = b[t : t + size] if b[c] else p
        if kind == "l" and b[c]:
            _end_line(s, p)
        if kind == "s":
            s[_AT["finished"]] = a[_AT["finished"]]
            if b[c] and b[_AT["finished"]]:
                _end_sentence(s, p)
    return s


def finish(s: np.ndarray) -> np.ndarray:
    """Counts of whole texts from their states (rows): the first line and sentence end, and the last
    line if it has words."""
    out = s[:, : len(COUNTS)].copy()
    h, t, broken = s[:, _AT["hl_chars"] :], s[:, _AT["tl_chars"] :], s[:, _AT["broken"]] > 0
    i = _AT["lines"]
    for p, ends in ((h, broken | (h[:, 1] > 0)), (t, broken & (t[:, 1] > 0))):
        full = ends & (p[:, 1] > 0)
        out[:, i] += ends
        out[:, i + 1 : i + 5] += np.column_stack([np.ones(len(s), np.int64), p[:, 0], p[:, 3], p[:, 2]]) * full[:, None]
    words = s[:, _AT["hs_words"] : _AT["hs_words"] + 5]
    done = (s[:, _AT["closed"]] > 0) & (s[:, _AT["finished"]] > 0)
    out[:, _AT["sentences"]] += done
    out[:, _AT["prose_words"]] += np.where(done & _is_prose(words), words[:, 0], 0)
    return out


def _in_parts(texts: list[str], fresh, tokens: Tokens) -> np.ndarray:
    """:func:`partials` over slices of bounded length."""
    done, at, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > BATCH or k == len(texts) - 1:
            done.append(partials(texts[at : k + 1], fresh[at : k + 1], tokens))
            at, size = k + 1, 0
    return np.concatenate(done) if done else np.zeros((0, len(STATE)), np.int64)


#: A blank as Python and this module see it, for Java patterns.
_JAVA_BLANK = r"\p{IsWhite_Space}\x1c-\x1f"


def _count_all(df: DataFrame, names: list[str], chunk: int, common: frozenset[str]) -> DataFrame:
    """``(names..., c)`` from ``(names..., t)``: counts per distinct row."""
    kinds = dict(df.dtypes)
    keys = ", ".join(f"{n} {kinds[n]}" for n in names)

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(common)
        for pdf in batches:
            got = finish(_in_parts(pdf["t"].tolist(), np.ones(len(pdf), bool), tokens))
            yield pdf[names].assign(c=list(got))

    small = df.where(F.length("t") <= chunk).mapInPandas(short, f"{keys}, c array<bigint>")
    longest = df.agg(F.max(F.length("t"))).first()[0] or 0
    if longest <= chunk:
        return small
    state = f"{keys}, h bigint, i bigint, c array<bigint>"

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(common)
        for pdf in batches:
            got = _in_parts(pdf["t"].tolist(), (pdf["i"] == 0).to_numpy(), tokens)
            yield pdf[[*names, "h", "i"]].assign(c=list(got))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        out = None
        for c in pdf["c"]:
            c = np.asarray(c, np.int64)
            out = c if out is None else join(out, c)
        return pdf.iloc[:1][[*names, "h", "i"]].assign(i=pdf["i"].iloc[0] // FAN, c=[out])

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[names].assign(c=list(finish(np.stack([np.asarray(c, np.int64) for c in pdf["c"]]))))

    # One linear pass cuts a text; pieces are spread over the cluster before they are read.
    cuts = df.where(F.length("t") > chunk).withColumn("h", F.xxhash64("t"))
    pieces = F.regexp_extract_all("t", F.lit(rf"(?s).{{1,{chunk}}}[{_JAVA_BLANK}]*[^{_JAVA_BLANK}]*"), F.lit(0))
    cuts = cuts.select(*names, "h", F.posexplode(pieces).alias("i", "t")).withColumn("i", F.col("i").cast("bigint"))
    parts = cuts.repartition(*names, "h", "i").mapInPandas(begin, state)
    n = -(-longest // chunk)
    while n > 1:
        by = [*names, "h", F.expr(f"i div {FAN}").alias("g")]
        parts = parts.groupBy(*by).applyInPandas(merge, state)
        n = -(-n // FAN)
    return small.unionByName(parts.mapInPandas(end, f"{keys}, c array<bigint>"))


#: Rule limits of the verdict.
MIN_PROSE_SHARE = 0.3


def text_stats(df: DataFrame, keys: list[str], text: str, chunk: int = CHUNK, common: frozenset[str] = COMMON) -> DataFrame:
    """Statistics and verdict per distinct (keys, text).

    Columns: keys, n_chars, n_words, n_lines, mean_word_length, alphanumeric_ratio (of non-blank
    signs), symbol_ratio, digit_ratio, diacritic_ratio, avg_line_length, empty_line_ratio,
    punct_line_ratio, item_line_ratio, common_word_ratio, prose_word_ratio, has_repeated_chars,
    is_prose (null for texts without a sign). Ratios over nothing are null. Null texts count as
    empty; exact repeated rows give one row; other columns are ignored. ``common`` are the words that
    count as common. The largest unit of work is a chunk of ``chunk`` characters and its last word.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n").alias("t")).distinct()
    counted = _count_all(rows, names, chunk, common)
    c = {name: F.col("c")[i] for i, name in enumerate(COUNTS)}
    ratio = lambda a, b: F.when(b > 0, a / b)
    signs = c["chars"] - c["blank"]
    prose = ratio(c["prose_words"], c["words"])
    return counted.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)],
        c["chars"].alias("n_chars"),
        c["words"].alias("n_words"),
        c["lines"].alias("n_lines"),
        ratio(c["word_chars"], c["words"]).alias("mean_word_length"),
        ratio(c["alnum"], signs).alias("alphanumeric_ratio"),
        ratio(c["symbols"], signs).alias("symbol_ratio"),
        ratio(c["digits"], c["alnum"]).alias("digit_ratio"),
        ratio(c["diacritics"], c["letters"]).alias("diacritic_ratio"),
        ratio(c["line_chars"], c["full_lines"]).alias("avg_line_length"),
        ratio(c["lines"] - c["full_lines"], c["lines"]).alias("empty_line_ratio"),
        ratio(c["stopped_lines"], c["full_lines"]).alias("punct_line_ratio"),
        ratio(c["item_lines"], c["full_lines"]).alias("item_line_ratio"),
        ratio(c["common"], c["words"]).alias("common_word_ratio"),
        prose.alias("prose_word_ratio"),
        (c["run"] >= 8).alias("has_repeated_chars"),
        F.when(signs > 0, F.coalesce(prose >= MIN_PROSE_SHARE, F.lit(False))).alias("is_prose"),
    )
