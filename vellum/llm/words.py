"""Word streams shared by the text operators (plain Python, run inside Arrow batches)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np

_MARKS = re.compile(r"[̀-ͯ­​-‍﻿]")
_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"\d+(?:[.,:/]\d+)*")


def plain_words(text: str | None) -> list[str]:
    """Words without accents, letter case, punctuation and emphasis marks."""
    if not text:
        return []
    return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold())


class WordMemo:
    """:func:`plain_words` with a number for each word, worked out once per run of non-blanks: no word
    goes over a blank and letter case, accents and marks do not act across one."""

    def __init__(self, number: Callable[[str], int], limit: int = 500_000):
        self.number, self.limit = number, limit
        self.known: dict[str, tuple[tuple[str, ...], tuple[int, ...]]] = {}

    def _runs(self, text: str | None) -> list[tuple[tuple[str, ...], tuple[int, ...]]]:
        if not text:
            return []
        if len(self.known) > self.limit:
            self.known.clear()
        runs, get = text.split(), self.known.get
        got = [get(r) for r in runs]
        if None in got:
            for k, x in enumerate(got):
                if x is None:
                    words = tuple(plain_words(runs[k]))
                    x = got[k] = words, tuple(map(self.number, words))
                    if len(runs[k]) <= 64:
                        self.known[runs[k]] = x
        return got

    def words(self, text: str | None) -> list[str]:
        """The same list as :func:`plain_words`."""
        return [w for words, _ in self._runs(text) for w in words]

    def values(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' words in order, and how many each text has."""
        numbers, sizes = [], []
        for t in texts:
            before = len(numbers)
            for _, x in self._runs(t):
                numbers += x
            sizes.append(len(numbers) - before)
        return np.array(numbers, np.uint64), np.array(sizes, np.int64)


def measured_words(text: str | None) -> list[str]:
    """Words without letter case and punctuation; every number is the word ``0``."""
    if not text:
        return []
    return _WORD.findall(_NUMBER.sub(" 0 ", text.casefold()))
