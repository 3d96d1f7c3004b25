"""Evaluation texts leaking into training text (problem 9): prefix-filtered set join.

Held-out items and documents are cut into shingles of five words, held as 64-bit hashes. The corpus is
read once, for any number of items: a filter of fixed size, made of the items' shingles, lets pass the
document shingles that an item may have, and only these, with the words around them, are written to
the shared folder. All else is joins over that table:

* rarity: in how many places of the corpus each shingle of an item stands;
* prefix: a leak holds at least ``need`` shingles of an item, in at most ``runs`` runs. If the ``drop``
  most common shingles of the item are left out, one of its runs still holds ``q`` of the remaining
  ones in a row, where ``runs * (q - 1) < need - drop``; so of every ``q`` neighbouring ones only the
  rarest is needed to find the leak. Each item takes the ``q`` whose shingles stand in the fewest
  places of the corpus;
* a place of the corpus that meets a prefix shingle of an item is a candidate; enough of their common
  shingles must lie on one diagonal (length and positional bound);
* the item-sized window there is compared word by word.

Standing phrases that many items share are common, so rarity keeps them out of the prefixes, and no
list of items or documents is gathered anywhere.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vellum.llm.words import WordMemo
from vellum.runtime import broadcast_if_small, cut

SHINGLE = 5
#: Items of fewer words leak only if a document holds them whole.
WHOLE = 2 * SHINGLE
#: Bits of the filter: 16 per shingle up to ``2 ** 27`` (16 MB), which is full at eight million
#: shingles; beyond that more document shingles pass that no item has, and the joins drop them.
FILTER_BITS = 27
#: Words of an item compared with its window at a time.
SLICE = 2_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def needed(n_words: int, share: float, replaced: float) -> tuple[int, int, int]:
    """(words, shingles, runs) that a passage holding at least ``share`` of the item's words has in
    common with it, if at most one word more than ``replaced`` of the passage was exchanged: so many
    words, and so many shingles in at most so many runs. Items of fewer than ``WHOLE`` words are held whole."""
    if n_words < WHOLE:
        return n_words, max(1, n_words - SHINGLE + 1), 1
    words = max(1, math.ceil(n_words * share))
    runs = math.ceil(words * replaced) + 2
    return words, max(1, words - (SHINGLE - 1) * runs), runs


def slack(n_words: int) -> int:
    """How far a passage may be shifted against the item by words put in or left out."""
    return max(4, n_words // 6)


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from hashes of words."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, np.uint64(size), np.uint64)
        for k in range(size):
            out = (out ^ h[k : len(h) - size + 1 + k]) * _MIX
            out ^= out >> np.uint64(29)
    return out


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


class Filter:
    """Set of shingle hashes with false positives only: two bits of each."""

    def __init__(self, log2: int, at: np.ndarray, bits: np.ndarray):
        self.mask = np.uint64((1 << log2) - 1)
        self.words = np.zeros(max(1, (1 << log2) >> 6), np.uint64)
        self.words[at] = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for bit in (h & self.mask, (h >> np.uint64(32)) & self.mask):
            out &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
        return out


def make_filter(grams: DataFrame, n: int) -> Filter:
    """Filter of the column ``h``; the driver receives its bits (at most ``2 ** FILTER_BITS``)."""
    log2 = min(FILTER_BITS, max(10, math.ceil(math.log2(16 * max(1, n)))))
    mask = F.lit((1 << log2) - 1)
    bit: Column = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask)))
    set_bits = grams.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("bits")).toPandas()
    return Filter(log2, set_bits["w"].to_numpy(np.int64), set_bits["bits"].to_numpy(np.int64).view(np.uint64))


def item_shingles(items: DataFrame, share: float, replaced: float) -> DataFrame:
    """``(u, n, need, runs, size, p, h)``: the shingles of ``(u, t)``. Items of fewer than five words are
    one shingle of their own ``size``; those without a word give nothing."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordMemo(_hash)
        for pdf in batches:
            for u, t in zip(pdf["u"], pdf["t"]):
                h, (n,) = memo.values([t])
                if n:
                    size = min(SHINGLE, n)
                    g = shingles(h, size).view(np.int64)
                    _, need, runs = needed(n, share, replaced)
                    yield pd.DataFrame({"u": u, "n": n, "need": need, "runs": runs, "size": size, "p": np.arange(len(g)), "h": g})

    return items.mapInPandas(work, "u bigint, n int, need int, runs int, size int, p int, h bigint")


def meeting_places(corpus: DataFrame, known: Filter, sizes_of: list[int], reach: int) -> DataFrame:
    """``(d, s, words, pos, h)`` from ``(d, t)``: the stretches of each text around shingles that pass
    the filter, at least ``reach`` words on both sides, with the places of these shingles in them.
    ``s`` tells apart the stretches of all rows."""
    kind = dict(corpus.dtypes)["d"]
    held = corpus.sparkSession.sparkContext.broadcast(known)

    def some(ids: list, texts: list[str], memo: WordMemo) -> pd.DataFrame:
        w, sizes = memo.values(texts)
        end = np.cumsum(sizes)
        pos, hs = [], []
        for size in sizes_of:
            h = shingles(w, size)
            at = np.flatnonzero(held.value.has(h))
            at = at[at + size <= end[np.searchsorted(end, at, "right")]]  # within one text
            pos.append(at)
            hs.append(h[at])
        pos, hs = np.concatenate(pos), np.concatenate(hs).view(np.int64)
        order = np.argsort(pos, kind="stable")
        pos, hs, out = pos[order], hs[order], []
        own = np.searchsorted(end, pos, "right")
        for k, a, e in zip(*np.unique(own, return_index=True), [*(np.flatnonzero(np.diff(own)) + 1), len(own)]):
            words, first = memo.words(texts[k]), end[k] - sizes[k]
            at = pos[a:e] - first
            for x, y in zip(*_groups(at, reach)):
                lo = max(0, int(at[x]) - reach)
                out.append((ids[k], " ".join(words[lo : int(at[y - 1]) + SHINGLE + reach]), (at[x:y] - lo).tolist(), hs[a:e][x:y].tolist()))
        return pd.DataFrame(out, columns=["d", "words", "pos", "h"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordMemo(_hash)
        for pdf in batches:
            ids, texts = pdf["d"].tolist(), pdf["t"].tolist()
            for a in range(0, len(pdf), 500):
                if len(out := some(ids[a : a + 500], texts[a : a + 500], memo)):
                    yield out

    found = corpus.mapInPandas(work, f"d {kind}, words string, pos array<int>, h array<bigint>")
    return found.withColumn("s", F.xxhash64("words", "pos"))


def _groups(pos: np.ndarray, reach: int) -> tuple[list[int], list[int]]:
    """Bounds of the groups of sorted places that lie at most ``reach`` apart."""
    gaps = np.flatnonzero(np.diff(pos) > reach) + 1
    return [0, *gaps.tolist()], [*gaps.tolist(), len(pos)]


def rarest(have: list[tuple[int, int]], need: int, runs: int) -> set[int]:
    """Hashes of the prefix of an item with shingles ``(places in the corpus, hash)`` in order."""
    hot = sorted(range(len(have)), key=lambda p: have[p], reverse=True)
    best: tuple[int, set] | None = None
    for q in range(1, (need - 1) // runs + 2):
        dropped = set(hot[: need - runs * (q - 1) - 1])
        rest = [x for p, x in enumerate(have) if p not in dropped]
        chosen = {min(rest[a : a + q]) for a in range(max(1, len(rest) - q + 1))} if rest else set()
        cost = sum(c for c, _ in chosen)
        if best is None or cost < best[0]:
            best = cost, chosen
    return {h for c, h in best[1] if c}  # those the corpus does not have find nothing


def prefixes(grams: DataFrame, seen: DataFrame) -> DataFrame:
    """``(h, u)``: the shingles by which an item's leaks are found, by ``seen (h, c)``. An item is the
    unit of work."""
    place = F.struct("p", F.coalesce("c", F.lit(0)).cast("bigint").alias("c"), "h")
    ranked = grams.join(seen, "h", "left").groupBy("u", "need", "runs").agg(F.sort_array(F.collect_list(place)).alias("x"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(h, u) for u, need, runs, x in zip(pdf["u"], pdf["need"], pdf["runs"], pdf["x"]) for h in rarest([(r["c"], r["h"]) for r in x], need, runs)]
            if out:
                yield pd.DataFrame(out, columns=["h", "u"])

    return ranked.mapInPandas(work, "h bigint, u bigint")


def passage(item: list[str], window: list[str]) -> tuple[int, int]:
    """(matched words, length in words) of the densest stretch of the item found, in order, in the
    window: longest common subsequence, then the stretch of largest matches minus twice the gaps.

    Items of more than ``SLICE`` words are compared slice by slice with the part of the window where
    the slice can lie."""
    n, m = len(item), len(window)
    hit = np.zeros(n, bool)
    over = max(0, m - n)
    for a in range(0, n, SLICE):
        part = item[a : a + SLICE]
        lo, hi = (0, m) if n <= SLICE else (max(0, a - over), min(m, a + SLICE + 2 * over))
        hit[a : a + SLICE] = _common(part, window[lo:hi])
    best, result, current, start, matched = 0, (0, 0), 0, 0, 0
    for x, h in enumerate(hit.tolist()):
        if current <= 0:
            current, start, matched = 0, x, 0
        current += 1 if h else -2
        matched += h
        if current > best:
            best, result = current, (matched, x + 1 - start)
    return result


def _common(item: list[str], window: list[str]) -> np.ndarray:
    """Which words of ``item`` are in a longest common subsequence with ``window``, earliest first."""
    n, m = len(item), len(window)
    ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
    x, y = np.array([ids[w] for w in item]), np.array([ids.get(w, -1) for w in window], np.int64)
    rows = np.zeros((n + 1, m + 1), np.int32)
    for a in range(n - 1, -1, -1):
        below = rows[a + 1]
        step = np.maximum(below[:-1], below[1:] + (y == x[a]))
        rows[a, :-1] = np.maximum.accumulate(step[::-1])[::-1]
    hit, a, b = np.zeros(n, bool), 0, 0
    while a < n and b < m:
        if x[a] == y[b]:
            hit[a] = True
            a, b = a + 1, b + 1
        elif rows[a + 1, b] >= rows[a, b + 1]:
            a += 1
        else:
            b += 1
    return hit


def held_share(item: list[str], words: list[str], offsets: list[int], share: float, replaced: float) -> float:
    """Share of the item's words held by a passage of ``words``, 0 if it is no leak. ``offsets``: the
    differences of the places of common shingles in the words and in the item."""
    n = len(item)
    if n < WHOLE:
        return float(any(words[o : o + n] == item for o in set(offsets) if o >= 0))
    need_words, need, _ = needed(n, share, replaced)
    wide = slack(n)
    have = Counter(item)
    offsets = sorted(offsets)
    best, lo = 0.0, 0
    while lo < len(offsets):
        hi = lo
        while hi + 1 < len(offsets) and offsets[hi + 1] - offsets[lo] <= 2 * wide:
            hi += 1
        # Positional bound: shingles on one diagonal, give or take the slack.
        if hi - lo + 1 < need:
            lo += 1
            continue
        mid = offsets[(lo + hi) // 2]
        window = words[max(0, mid - 2 * wide) : max(0, mid + n + 2 * wide)]
        # No more words match in order than in any order.
        matched, span = passage(item, window) if (have & Counter(window)).total() >= need_words else (0, 0)
        if matched >= need_words and matched >= 0.75 * span:
            best = max(best, matched / n)
        lo = hi + 1
    return best


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, share: float = 0.5, replaced: float = 0.12) -> DataFrame:
    """``(doc_id, item_id, held)``: documents holding at least ``share`` of an item's words as one
    passage, in which letter case, accents, punctuation, spacing, emphasis and a few words differ.

    Items of fewer than ten words must stand in the document whole and in order. Null ids, null texts
    and texts without a word give nothing; repeated rows give one; rows that share an id are texts of
    one item or document; other columns are ignored.
    """
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    side = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).distinct()
    side = side.withColumn("u", F.xxhash64("i", "t"))
    grams = cut(item_shingles(side.select("u", "t"), share, replaced))
    size = grams.agg(F.count("*").alias("n"), F.max("n").alias("longest"), F.collect_set("size").alias("sizes")).first()
    corpus = docs.where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t"))
    reach = (size.longest or 1) + 4 * slack(size.longest or 1)
    places = cut(meeting_places(corpus, make_filter(grams, size.n), sorted(size.sizes) or [SHINGLE], reach))
    each = places.select("d", "s", F.explode(F.arrays_zip("pos", "h")).alias("x")).select("d", "s", "x.pos", "x.h")
    met = each.join(broadcast_if_small(grams.select("h").distinct(), size.n), "h", "left_semi")
    prefix = cut(prefixes(grams, met.groupBy("h").agg(F.count("*").alias("c"))))
    candidates = met.join(broadcast_if_small(prefix, prefix.count()), "h").select("d", "s", "u").distinct()
    common = candidates.join(met, ["d", "s"]).join(broadcast_if_small(grams.select("u", "h", "p", "n", "need"), size.n), ["u", "h"])
    lines = common.groupBy("d", "s", "u", "n", "need").agg(F.sort_array(F.collect_list(F.col("pos") - F.col("p"))).alias("offsets"))
    # Positional bound: enough shingles on one diagonal, give or take the slack.
    near = "exists(sequence(0, size(offsets) - need), k -> offsets[k + need - 1] - offsets[k] <= 2 * greatest(4, n div 6))"
    close = cut(lines.where("size(offsets) >= need").where(near).select("d", "s", "u", "offsets"))
    found_in = places.select("d", "s", "words").join(broadcast_if_small(close, close.count()), ["d", "s"])
    pairs = found_in.join(broadcast_if_small(side, side.count()), "u").select("d", "i", "t", "words", "offsets")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordMemo(_hash)
        for pdf in batches:
            out = []
            for d, i, t, words, offsets in zip(pdf["d"], pdf["i"], pdf["t"], pdf["words"], pdf["offsets"]):
                if x := held_share(memo.words(t), words.split(" "), offsets.tolist(), share, replaced):
                    out.append((d, i, x))
            if out:
                yield pd.DataFrame(out, columns=["d", "i", "held"])

    found = pairs.mapInPandas(verify, f"d {kinds[0]}, i {kinds[1]}, held double")
    return found.groupBy(F.col("d").alias(doc_id), F.col("i").alias(item_id)).agg(F.max("held").alias("held"))
