"""Predicates F1-F14 as composable Column expressions; values are literals, never pasted strings."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

log = logging.getLogger(__name__)

#: Keys that ``key=value`` filters may use (fixed values).
ALLOWED = ("language", "doc_type", "doc_id", "source_path", "file_name")


@dataclass(frozen=True)
class Filters:
    """Immutable list of predicates and tags."""

    parts: tuple[Column, ...] = ()
    tags: tuple[str, ...] = field(default=())

    def _with(self, p: Column) -> Filters:
        return Filters((*self.parts, p), self.tags)

    def eq(self, name: str, value) -> Filters:
        return self._with(F.col(name) == F.lit(value))

    def ne(self, name: str, value) -> Filters:
        return self._with(F.col(name) != F.lit(value))

    def lt(self, name: str, value) -> Filters:
        return self._with(F.col(name) < F.lit(value))

    def lte(self, name: str, value) -> Filters:
        return self._with(F.col(name) <= F.lit(value))

    def gt(self, name: str, value) -> Filters:
        return self._with(F.col(name) > F.lit(value))

    def gte(self, name: str, value) -> Filters:
        return self._with(F.col(name) >= F.lit(value))

    def like(self, name: str, pattern: str) -> Filters:
        return self._with(F.col(name).like(pattern))

    def in_(self, name: str, values: Iterable) -> Filters:
        """An empty list holds for no row."""
        v = list(values)
        return self._with(F.col(name).isin(v) if v else F.lit(False))

    def raw(self, expression: str) -> Filters:
        return self._with(F.expr(expression))

    def with_tags(self, tags: Iterable[str]) -> Filters:
        return Filters(self.parts, (*self.tags, *tags))

    def build(self) -> Column | None:
        """All predicates; None without any."""
        return reduce(lambda a, b: a & b, self.parts) if self.parts else None

    def build_or(self) -> Column | None:
        """Any predicate; None without any."""
        return reduce(lambda a, b: a | b, self.parts) if self.parts else None

    def is_empty(self) -> bool:
        return not self.parts and not self.tags

    def apply(self, df: DataFrame) -> DataFrame:
        p = self.build()
        return df if p is None else df.where(p)


def tag_overlap(tags: Column, wanted: Iterable[str]) -> Column:
    """any wanted tag; rows without tags fail. No wanted tags: every row passes."""
    w = list(wanted)
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in w])), F.lit(False)) if w else F.lit(True)


def parse_filters(pairs: Iterable[str]) -> Filters:
    """``key=value`` strings; malformed, unknown and empty ones are reported and skipped."""
    out = Filters()
    for p in pairs or ():
        key, found, value = p.partition("=")
        key, value = key.strip(), value.strip()
        if not found or key not in ALLOWED or not value:
            log.warning("filter ignored: %s", p)
            continue
        out = out.eq(key, value)
    return out
