"""One ranking from several differently scaled scores (problem 4): median rank aggregation.

Only ranks enter, so neither the range nor the distribution of a score matters. Ranks of one list
are computed without gathering the list in one task: rows are first counted per distinct score
(map-side), the distinct scores are ranked inside narrow score bands, and the bands are offset by
running counts over the bands alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Bands per factor of two of the score.
BANDS = 256


def _band(s: Column) -> Column:
    """A non-decreasing function of the score with few values per order of magnitude."""
    up = lambda x: F.floor(F.log2(x) * BANDS) + F.lit(BANDS * 2000)
    return F.when(s > 0, up(s)).when(s < 0, -up(-s)).otherwise(F.lit(0)).cast("bigint")


def latest_scores(df: DataFrame, group: str, mode: str, item: str, score: str, at: str) -> DataFrame:
    """One score per (group, mode, item): that of the latest row, the higher one on a tie of time.

    Rows with a null group, mode or item are left out, null times count as earliest. If the latest
    row has a null or NaN score, the item has no score in that mode.
    """
    s = F.when(F.isnan(score), None).otherwise(F.col(score).cast("double"))
    late = F.struct(F.col(at).alias("at"), s.alias("s"))
    return (
        df.where(F.col(group).isNotNull() & F.col(mode).isNotNull() & F.col(item).isNotNull())
        .groupBy(F.col(group).alias("g"), F.lower(F.trim(mode)).alias("m"), F.col(item).alias("i"))
        .agg(F.max(late).alias("x"))
        .select("g", "m", "i", F.col("x.s").alias("s"))
    )


def mid_ranks(scores: DataFrame) -> DataFrame:
    """``(g, m, i, r)`` from ``(g, m, i, s)``: descending rank in the list (g, m), ties share the
    mean of their places; items without score are absent."""
    have = scores.where("s is not null")
    distinct = have.groupBy("g", "m", "s").agg(F.count("*").alias("n")).withColumn("b", _band(F.col("s")))
    bands = distinct.groupBy("g", "m", "b").agg(F.sum("n").alias("bn"))
    before = W.partitionBy("g", "m").orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    bands = bands.select("g", "m", "b", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("above"))
    inside = W.partitionBy("g", "m", "b").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, -1)
    ranked = distinct.withColumn("higher", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bands, ["g", "m", "b"])
    ranked = ranked.select("g", "m", "s", (F.col("above") + F.col("higher") + (F.col("n") + 1) / 2).alias("r"))
    return have.join(ranked, ["g", "m", "s"]).select("g", "m", "i", "r")


def weighted_median(pairs: Column) -> Column:
    """Median of ``array<struct<r, w>>``; with half the weight on either side, the middle of both."""
    p = F.array_sort(pairs)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x["w"])
    init = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

    def step(a, x):
        c = a["c"] + x["w"]
        return F.struct(c.alias("c"), F.coalesce(a["lo"], F.when(c >= total / 2, x["r"])).alias("lo"), F.coalesce(a["hi"], F.when(c > total / 2, x["r"])).alias("hi"))

    return F.aggregate(p, init, step, lambda a: (a["lo"] + F.coalesce(a["hi"], a["lo"])) / 2)


def fuse(scores: DataFrame, modes: Sequence[str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """``(g, i, median_rank, mean_rank)`` from ``(g, m, i, s)``.

    An item absent from a mode takes, there, the place after all items of the group, so absence
    gains nothing. Modes outside ``modes`` and items with no score in any mode are left out; a mode
    no item of a group has counts the same for all. Empty input gives no rows.
    """
    w = {m: float((weights or {}).get(m, 1.0)) for m in modes}
    if not modes or min(w.values()) < 0 or sum(w.values()) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    ranks = mid_ranks(scores.where(F.col("m").isin(*modes)))
    size = ranks.groupBy("g", "i").agg(*[F.max(F.when(F.col("m") == m, F.col("r"))).alias(f"r{k}") for k, m in enumerate(modes)])
    groups = size.groupBy("g").agg((F.count("*") + 1.0).alias("last"))
    full = size.join(groups, "g")
    rs = [F.coalesce(F.col(f"r{k}"), F.col("last")).cast("double") for k in range(len(modes))]
    pairs = F.array(*[F.struct(r.alias("r"), F.lit(w[m]).alias("w")) for r, m in zip(rs, modes)])
    mean = sum(r * F.lit(w[m]) for r, m in zip(rs, modes)) / F.lit(sum(w.values()))
    return full.select("g", "i", weighted_median(pairs).alias("median_rank"), mean.alias("mean_rank"))


def top(fused: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of each group by (median rank, mean rank, identifier), with ``place``.

    ``row_number() <= k`` prunes inside each task before the shuffle (WindowGroupLimit)."""
    w = W.partitionBy("g").orderBy("median_rank", "mean_rank", "i")
    return fused.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
