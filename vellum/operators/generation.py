"""Prompts, sources and answers G1-G8, rendering of results K5; markers F18."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Answer modes and texts that must match the documented output (fixed values).
MODES = ("answer", "answer_with_citations", "extractive_summary", "study_mode")
HEADER = "CONTEXT (retrieved chunks):"
NO_SECTION = "(sem secao)"
NOT_FOUND = "Based on the documents provided, I could not find an answer."
GAP_MARKERS = ("could not find an answer", "não encontrei", "nao encontrei")
CONFLICT_MARKERS = ("conflict", "conflito")
LOW_CONFIDENCE = 0.02

_RULES = (
    "You answer from retrieved passages.",
    "Use only the passages below; add no outside knowledge.",
    f'If they do not hold the answer, say: "{NOT_FOUND}"',
    "Invent no facts, numbers, names, dates or citations.",
    "If passages contradict each other, say so and cite both.",
    "Answer in the language of the question, briefly, in the words of the sources.",
)
_TASKS = {
    "answer": "Answer directly, without a list of sources.",
    "answer_with_citations": "Answer and mark each claim with [n]; end with the cited sources.",
    "extractive_summary": "Give the most relevant passages word for word, each marked with [n].",
    "study_mode": "Explain step by step, define terms at first use, mark statements with [n], end with key points.",
}


def system_prompt(mode: str) -> str:
    """Instructions of a mode."""
    if mode not in _TASKS:
        raise ValueError(f"mode must be one of {MODES}")
    return "\n".join([*_RULES, f"MODE: {mode}.", _TASKS[mode]])


def section_path(sep: str, *heads: Column) -> Column:
    """Headings joined, without null and empty ones; a placeholder if none is left."""
    full = F.filter(F.array(*heads), lambda h: h.isNotNull() & (h != ""))
    return F.when(F.size(full) == 0, F.lit(NO_SECTION)).otherwise(F.array_join(full, sep))


def shorten(text: Column, limit: int) -> Column:
    """At most ``limit`` signs, cut back to the last blank and marked."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), r"(?s) [^ ]*\z", ""), F.lit(" […]")))


def context_block(i: Column, limit: int = 1600) -> Column:
    """G1: one numbered passage of a hit row."""
    return F.concat(F.lit("["), i.cast("string"), F.lit("] "), section_path(" > ", F.col("h1"), F.col("h2"), F.col("h3")), F.lit("\n"), shorten(F.col("snippet"), limit))


def shown_score() -> Column:
    """The score to three places, halves up, so that every engine prints the same."""
    return F.floor(F.col("score") * 1000 + 0.5) / 1000


def source_line(i: Column) -> Column:
    """One numbered source of a hit row."""
    path = section_path(" / ", F.col("h1"), F.col("h2"), F.col("h3"))
    return F.format_string("[%d] %s — %s (chunk_id=%s, score=%.3f)", i, F.coalesce("file_name", F.lit("")), path, F.col("chunk_id"), shown_score())


def _ordered(parts: Column, order: Column, sep: str) -> Column:
    """Texts of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), parts.alias("t")))), lambda x: x["t"]), sep)


def build_prompts(questions: DataFrame, hits: DataFrame, mode: str = "answer", limit: int = 1600, order: str = "place") -> DataFrame:
    """``(query_id, system, user)`` for every question, with or without hits.

    A question's hits are few (the context cap), so one group holds its prompt."""
    head = system_prompt(mode)
    ctx = hits.groupBy("query_id").agg(_ordered(context_block(F.col(order), limit), F.col(order), "\n\n").alias("ctx"))
    ctx_or = F.coalesce("ctx", F.lit("(empty — no relevant chunks retrieved)"))
    user = F.concat(F.lit(HEADER + "\n"), ctx_or, F.lit("\n\nQUESTION:\n"), F.coalesce("text", F.lit("")))
    return questions.join(ctx, "query_id", "left").select("query_id", F.lit(head).alias("system"), user.alias("user"))


def sources_block(questions: DataFrame, hits: DataFrame, order: str = "place") -> DataFrame:
    """``(query_id, sources)``."""
    s = hits.groupBy("query_id").agg(F.concat(F.lit("Sources:\n"), _ordered(source_line(F.col(order)), F.col(order), "\n")).alias("s"))
    return questions.select("query_id").join(s, "query_id", "left").select("query_id", F.coalesce("s", F.lit("Sources: (none)")).alias("sources"))


def holds_any(text: Column, markers: tuple[str, ...]) -> Column:
    """whether the lower-cased text holds a marker."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = t.contains(markers[0])
    for m in markers[1:]:
        out = out | t.contains(m)
    return out


def answer_flags(text: Column, hits: Column, confidence: Column) -> list[Column]:
    """Insufficient context and conflict."""
    gap = (hits == 0) | (confidence < LOW_CONFIDENCE) | holds_any(text, GAP_MARKERS)
    return [gap.alias("insufficient_context"), holds_any(text, CONFLICT_MARKERS).alias("conflict")]


class LanguageModel(Protocol):
    """What answers prompts; instances travel to the workers."""

    def complete(self, system: str, user: str) -> str: ...


class StubModel:
    """Answers nothing; the default without a model."""

    def complete(self, system: str, user: str) -> str:
        return NOT_FOUND


def answer(prompts: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds ``text``; a failing call gives the fixed not-found text with the error."""

    @F.pandas_udf("string")
    def call(system: pd.Series, user: pd.Series) -> pd.Series:
        def one(s, u):
            try:
                return model.complete(s, u)
            except Exception as e:  # noqa: BLE001 - any failure becomes a text
                return f"{NOT_FOUND} (LLM error: {e})"

        return pd.Series([one(s, u) for s, u in zip(system, user)])

    return prompts.withColumn("text", call("system", "user"))


def answer_with_sources(answers: DataFrame) -> DataFrame:
    """``(query_id, text)``: the answer's text, a blank line and its sources."""
    return answers.select("query_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), F.coalesce("sources", F.lit("Sources: (none)"))).alias("text"))


def display(text: Column, sources: Column, insufficient: Column, conflict: Column) -> Column:
    """Answer, note on conflicts, sources; only a message if the context was insufficient."""
    note = F.when(conflict, F.lit("\n\n(sources conflict)")).otherwise(F.lit(""))
    return F.when(insufficient, F.lit(NOT_FOUND)).otherwise(F.concat(text, note, F.lit("\n\n"), sources))


def hit_line(i: Column, limit: int = 300) -> Column:
    """K5: one hit as text."""
    loc = F.array_join(F.filter(F.array("source_path", "h1", "h2"), lambda x: x.isNotNull() & (x != "")), " > ")
    snippet = F.coalesce("snippet", F.lit(""))
    tail = F.when(F.length(snippet) > limit, "...").otherwise("")
    return F.concat(F.format_string("[%d] %s  (score=%.3f)\n    ", i, loc, shown_score()), F.substring(snippet, 1, limit), tail)
