"""Repetition inside a single document (problem 10).

Two operators. :func:`perplexity` is the method named for the problem: an interpolated trigram model
with modified Kneser-Ney discounts, counted in Spark over the whole corpus and kept as sorted hash
arrays, scores every document, and language-specific lower and upper bands judge the perplexity.
:func:`repeated_share` measures what the problem asks for, the share of words in runs that stood
earlier in the same text. Perplexity under a corpus model cannot express that share (a repeated
sentence of a common pattern is no less likely than its first copy); see the README for figures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellum.llm.words import measured_words
from vellum.runtime import broadcast_if_small, cut

RUN = 6
#: Trigrams of the model, and half the words of documents, that one scoring task should hold.
GROUP_ROWS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def share_of_runs(words: list[str], run: int = RUN) -> float:
    """Share of words lying in runs of at least ``run`` words that began earlier in the text too."""
    n = len(words)
    if n < run:
        return 0.0
    seen: set[tuple] = set()
    covered = end = 0
    for k in range(n - run + 1):
        gram = tuple(words[k : k + run])
        if gram in seen:
            covered += k + run - max(k, end)
            end = k + run
        else:
            seen.add(gram)
    return covered / n


def repeated_share(df: DataFrame, key: str, text: str, run: int = RUN) -> DataFrame:
    """``(key, n_words, repeated_share)``, one row per input row with a key.

    Letter case, punctuation and the value of numbers are disregarded. Null, empty and very short
    texts have share 0. Each text is read once, in one pass, with memory linear in its length.
    """
    kind = dict(df.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [measured_words(t) for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "n": [len(w) for w in words], "s": [share_of_runs(w, run) for w in words]})

    out = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(work, f"k {kind}, n bigint, s double")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_words"), F.col("s").alias("repeated_share"))


# --- corpus language model -------------------------------------------------------------------


def _word_hash(words: list[str], memo: dict[str, int]) -> np.ndarray:
    import xxhash

    if len(memo) > 500_000:
        memo.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (b + _MIX + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _grams(text: str | None, memo: dict[str, int]) -> tuple[np.ndarray, ...]:
    """(trigram, its first two words, its last two, middle, last) hashes, two start marks in front."""
    w = measured_words(text)
    h = np.concatenate([np.array([1, 2], np.uint64), _word_hash(w, memo)])
    two = _pair(h[:-1], h[1:])
    return _pair(two[:-1], h[2:]), two[:-1], two[1:], h[1:-1], h[2:]


def count_trigrams(df: DataFrame, text: str) -> DataFrame:
    """``(tri, ctx, suf, mid, last, c)``: counts of all trigrams, combined inside each Arrow batch
    before they are shuffled."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for pdf in batches:
            parts = [_grams(t, memo) for t in pdf["t"]]
            if not parts:
                continue
            cols = [np.concatenate(x) for x in zip(*parts)]
            tri, at, n = np.unique(cols[0], return_index=True, return_counts=True)
            yield pd.DataFrame({"tri": tri.view(np.int64), **{k: cols[i][at].view(np.int64) for i, k in ((1, "ctx"), (2, "suf"), (3, "mid"), (4, "last"))}, "n": n})

    part = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(work, "tri bigint, ctx bigint, suf bigint, mid bigint, last bigint, n bigint")
    return part.groupBy("tri", "ctx", "suf", "mid", "last").agg(F.sum("n").alias("c"))


def _discounts(counts: DataFrame, c: str) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two and more."""
    got = {r.c: r.n for r in counts.where(F.col(c) <= 4).groupBy(F.col(c).alias("c")).agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (got.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return [min(max(v, 0.05), k + 0.95) for k, v in enumerate(d)]


def _take(c: Column, d: list[float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def kneser_ney(tri: DataFrame) -> DataFrame:
    """``(tri, logp)``: natural log of the interpolated probability of every trigram seen.

    Lower orders use continuation counts. A context's totals and discounts are sums, so they
    combine map-side whatever the context's share of the corpus; they are joined back broadcast where
    their counted rows are few, else by shuffles whose hot keys adaptive execution splits (the side of
    the totals has one row a key).
    """
    tri = cut(tri)  # the counts are read five times
    bi = cut(tri.groupBy("suf", "mid", "last").agg(F.count("*").alias("k")))
    uni = bi.groupBy("last").agg(F.count("*").alias("k"))
    d3, d2 = _discounts(tri, "c"), _discounts(bi, "k")
    total = uni.agg(F.sum("k").alias("s"), F.count("*").alias("v")).first()
    s, v = float(total.s or 1), float(total.v or 1)
    d1 = 0.75
    p1 = uni.select("last", ((F.col("k") - d1) / s + F.lit(d1 * v / s / v)).alias("p1"))
    mids = bi.groupBy("mid").agg(F.sum("k").alias("total"), F.sum(_take(F.col("k"), d2)).alias("held"))
    words = uni.count()
    p2 = bi.join(broadcast_if_small(mids, words), "mid").join(broadcast_if_small(p1, words), "last").select("suf", ((F.col("k") - _take(F.col("k"), d2)) / F.col("total") + F.col("held") / F.col("total") * F.col("p1")).alias("p2"))
    ctxs = tri.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(_take(F.col("c"), d3)).alias("held"))
    p3 = tri.join(ctxs, "ctx").join(p2, "suf")
    p = (F.col("c") - _take(F.col("c"), d3)) / F.col("total") + F.col("held") / F.col("total") * F.col("p2")
    return p3.select("tri", "c", F.log(p).alias("logp"))


def hash_arrays(model: DataFrame, buckets: int) -> DataFrame:
    """``(b, keys, values)``: the model as arrays sorted by hash, one pair per bucket."""
    rows = model.groupBy(F.pmod("tri", F.lit(buckets)).cast("int").alias("b")).agg(F.sort_array(F.collect_list(F.struct("tri", F.col("logp").cast("float").alias("logp")))).alias("x"))
    return rows.select("b", F.col("x.tri").alias("keys"), F.col("x.logp").alias("values"))


#: Half width of a language's band, in standard deviations of the log perplexity as the median
#: deviation estimates them: below the lower and above the upper.
LOW_BAND, HIGH_BAND = 3.5, 3.5


def perplexity(df: DataFrame, key: str, text: str, language: str, low: float = LOW_BAND, high: float = HIGH_BAND) -> DataFrame:
    """``(key, language, n_words, perplexity, verdict)``.

    Verdict ``low`` or ``high``: beyond the language's band, ``low`` / ``high`` robust deviations of log
    perplexity below or above the median over all documents of that language, so that of alike texts
    none falls out; ``ok`` otherwise; ``empty`` for texts without words (perplexity null). A null
    language is the language ``und``. ``key`` must be unique; the model is counted over every row, the
    scored one included.

    Words travel packed: one row of arrays per slice of documents and bucket of the model. A bucket
    whose trigrams are frequent is split by its own count, the others are not.
    """
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.lower(F.trim(language)), F.lit("und")).alias("l"))
    model = cut(kneser_ney(count_trigrams(docs, "t")))
    buckets = max(8, math.ceil(model.count() / GROUP_ROWS))
    load = {r.b: r.c for r in model.groupBy(F.pmod("tri", F.lit(buckets)).cast("int").alias("b")).agg(F.sum("c").alias("c")).collect()}  # one row a bucket
    splits = np.array([max(1, math.ceil(load.get(b, 0) / (2 * GROUP_ROWS))) for b in range(buckets)])
    held = df.sparkSession.sparkContext.broadcast(splits)
    kind = dict(df.dtypes)[key]

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        splits, n = held.value, 0
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                some = pdf.iloc[a : a + 500]
                grams = [_grams(t, memo)[0] for t in some["t"]]
                who = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
                if not len(who):
                    continue
                tri = np.concatenate(grams).view(np.int64)
                b = np.mod(tri, buckets)
                order = np.argsort(b, kind="stable")
                who, tri, b = who[order], tri[order], b[order]
                at = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
                keys, out = some["k"].to_numpy(), []
                for x, y in zip(at[:-1], at[1:]):
                    n += 1
                    own, place = np.unique(who[x:y], return_inverse=True)
                    out.append((int(b[x]), n % int(splits[b[x]]), keys[own], place.astype(np.int32), tri[x:y]))
                yield pd.DataFrame(out, columns=["b", "s", "ks", "who", "tri"])

    packed = docs.where(F.col("t").isNotNull()).select("k", "t").mapInPandas(spell, f"b int, s int, ks array<{kind}>, who array<int>, tri array<bigint>")
    copies = df.sparkSession.createDataFrame([(b, int(x)) for b, x in enumerate(splits)], "b int, splits int")
    arrays = hash_arrays(model, buckets).join(broadcast_if_small(copies, buckets), "b").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"k": [], "n": np.zeros(0, np.int64), "lp": np.zeros(0)})
        keys, values = np.asarray(right["keys"].iloc[0]), np.asarray(right["values"].iloc[0], np.float64)
        out = []
        for ks, who, tri in zip(left["ks"], left["who"], left["tri"]):
            lp = values[np.minimum(np.searchsorted(keys, tri), len(keys) - 1)]
            out.append(pd.DataFrame({"k": ks, "n": np.bincount(who, minlength=len(ks)), "lp": np.bincount(who, lp, len(ks))}))
        return pd.concat(out)

    scored = packed.groupBy("b", "s").cogroup(arrays.groupBy("b", "s")).applyInPandas(score, f"k {kind}, n bigint, lp double")
    sums = scored.groupBy("k").agg(F.sum("n").alias("n"), F.sum("lp").alias("lp"))
    per = cut(docs.select("k", "l").join(sums, "k", "left").withColumn("x", -F.col("lp") / F.col("n")))
    middle = per.where("x is not null").groupBy("l").agg(F.percentile_approx("x", 0.5, 10_000).alias("mid"))
    languages = middle.count()
    apart = per.join(broadcast_if_small(middle, languages), "l").groupBy("l", "mid").agg((1.4826 * F.percentile_approx(F.abs(F.col("x") - F.col("mid")), 0.5, 10_000)).alias("sd"))
    verdict = F.when(F.col("x").isNull(), "empty").when(F.col("x") < F.col("mid") - low * F.col("sd"), "low").when(F.col("x") > F.col("mid") + high * F.col("sd"), "high").otherwise("ok")
    return per.join(broadcast_if_small(apart, languages), "l", "left").select(F.col("k").alias(key), F.col("l").alias("language"), F.coalesce("n", F.lit(0)).alias("n_words"), F.exp("x").alias("perplexity"), verdict.alias("verdict"))
