"""Building blocks: lines, blanks, words. Regular expressions follow Java; ``\\s`` is made Unicode-aware
by ``(?U)`` and line anchors are avoided by working on arrays of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: White space as Python knows it, in a form Java and RE2 share.
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed, and stands in the plan, once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, rf"\A{BLANK}+|{BLANK}+\z", "")


def squeeze(c: Column) -> Column:
    """Words joined by single blanks."""
    return strip(F.regexp_replace(c, rf"{BLANK}+", " "))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def unlines(a: Column) -> Column:
    return F.array_join(a, "\n")


def map_lines(c: Column, f: Callable[[Column], Column]) -> Column:
    return unlines(F.transform(lines(c), f))


def keep_lines(c: Column, f: Callable[[Column], Column]) -> Column:
    return unlines(F.filter(lines(c), f))


def words(c: Column) -> Column:
    """Array of white-space separated words; empty for blank texts."""
    s = squeeze(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " ", -1))


def inside_fence(all_lines: Column) -> Column:
    """``array<struct<line, code>>``: each line and whether a code fence is open there; fence lines
    themselves count as code. One pass with a running parity."""
    fence = lambda l: strip(l).startswith("```")
    init = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<line:string,code:boolean>>").alias("out"))

    def step(a, l):
        return F.struct(
            F.when(fence(l), ~a["open"]).otherwise(a["open"]).alias("open"),
            F.concat(a["out"], F.array(F.struct(l.alias("line"), (a["open"] | fence(l)).alias("code")))).alias("out"),
        )

    return F.aggregate(all_lines, init, step, lambda a: a["out"])


def fence_parity(all_lines: Column) -> Column:
    """Same as :func:`inside_fence` for texts known to hold a fence; texts without one skip the fold."""
    plain = F.transform(all_lines, lambda l: F.struct(l.alias("line"), F.lit(False).alias("code")))
    return F.when(F.exists(all_lines, lambda l: l.contains("```")), inside_fence(all_lines)).otherwise(plain)


def count_tokens(c: Column) -> Column:
    """Approximate number of model tokens: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))
