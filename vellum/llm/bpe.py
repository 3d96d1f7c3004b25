"""Encoding with a public byte-level BPE (problem 8) by a lazily determinised transducer.

Byte-level BPE has a local characterisation: a token sequence is the encoding of its bytes exactly
if every adjacent pair is the encoding of that pair's bytes. Reading left to right, the encodings of
all prefixes therefore form a tree in which each prefix hangs, by its last token, on a shorter one.
Only prefixes from which some token may still be spelled are alive; tokens common to all live paths
can never change and are emitted at once, so the output lags the input by at most the longest token.

A configuration (for each live prefix: the trie node reached and the tokens not yet emitted) is a
state of a deterministic transducer. States and transitions are built when first needed and shared
by all texts of a Python worker. Pieces that the pre-tokeniser cuts are independent, so whole pieces
are remembered too.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Splitting pattern of the public vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Transducer states and remembered pieces kept per worker; beyond it they are built anew.
MAX_STATES, MAX_PIECES = 200_000, 500_000


def default_path() -> str:
    """The rank file of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, which is also the merge priority."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Deterministic byte-to-token transducer over a rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        #: Trie in one dict: (node * 256 + byte) -> node; token id per node.
        self.edges: dict[int, int] = {}
        self.token_at: list[int | None] = [None]
        for tok, i in ranks.items():
            node = 0
            for b in tok:
                nxt = self.edges.get(node * 256 + b)
                if nxt is None:
                    nxt = len(self.token_at)
                    self.token_at.append(None)
                    self.edges[node * 256 + b] = nxt
                node = nxt
            self.token_at[node] = i
        self.pair_ok: dict[int, bool] = {}
        self.own_ok: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        #: State 0: nothing read. A state: (last emitted token or None, ((node, pending tokens), ...)).
        start = (None, ((0, ()),))
        self.states = [start]
        self.index = {start: 0}
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def merge(self, text: bytes) -> list[int]:
        """Plain merging by priority; used on single tokens and pairs only."""
        parts = [bytes([b]) for b in text]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            pair, out, k = parts[at] + parts[at + 1], [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] + parts[k + 1] == pair:
                    out.append(pair)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return [self.ranks[p] for p in parts]

    def fits(self, left: int | None, right: int) -> bool:
        """Whether ``right`` may follow ``left``."""
        if left is None:
            ok = self.own_ok.get(right)
            if ok is None:
                ok = self.own_ok[right] = self.merge(self.bytes_of[right]) == [right]
            return ok
        key = left * 65536 + right
        ok = self.pair_ok.get(key)
        if ok is None:
            ok = self.pair_ok[key] = self.fits(None, right) and self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return ok

    def _advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        emitted, live = self.states[state]
        grown, root = [], None
        for node, pending in live:
            nxt = self.edges.get(node * 256 + byte)
            if nxt is None:
                continue
            grown.append((nxt, pending))
            tok = self.token_at[nxt]
            if tok is not None and root is None and self.fits(pending[-1] if pending else emitted, tok):
                root = pending + (tok,)
        if root is None:
            raise ValueError("the vocabulary lacks a byte")
        grown.append((0, root))
        common = root
        for _, p in grown:
            n = 0
            for a, b in zip(common, p):
                if a != b:
                    break
                n += 1
            common = common[:n]
        cut = len(common)
        new = (common[-1] if cut else emitted, tuple((n, p[cut:]) for n, p in grown))
        at = self.index.get(new)
        if at is None:
            at = self.index[new] = len(self.states)
            self.states.append(new)
        return at, common

    def encode(self, text: bytes) -> list[int]:
        """Tokens of one piece."""
        if len(self.states) > MAX_STATES:
            self._reset()
        out: list[int] = []
        state, step = 0, self.step
        for b in text:
            key = state * 256 + b
            got = step.get(key)
            if got is None:
                got = step[key] = self._advance(state, b)
            state = got[0]
            if got[1]:
                out.extend(got[1])
        out.extend(self.states[state][1][-1][1])
        return out


class Encoder:
    """Texts to ids with a memory of pieces."""

    def __init__(self, path: str):
        import regex

        self.fst = Transducer(read_ranks(path))
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts give an empty list. Lone surrogates count as U+FFFD."""
        if not text:
            return []
        known, out = self.known, []
        if len(known) > MAX_PIECES:
            known.clear()
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.fst.encode(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    known[piece] = ids
            out.extend(ids)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


class Utf8Machine:
    """Incremental UTF-8: bytes in, characters out as soon as they are complete.

    Ill-formed input gives one U+FFFD per maximal ill-formed part, as in the Unicode standard."""

    def __init__(self) -> None:
        self.need, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.value = self.value << 6 | b & 0x3F
                    self.low, self.high = 0x80, 0xBF
                    self.need -= 1
                    if not self.need:
                        out.append(chr(self.value))
                    continue
                self.need, self.low, self.high = 0, 0x80, 0xBF
                out.append("�")
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.value = 2, b & 0x0F
                self.low, self.high = (0xA0, 0xBF) if b == 0xE0 else (0x80, 0x9F) if b == 0xED else (0x80, 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.value = 3, b & 0x07
                self.low, self.high = (0x90, 0xBF) if b == 0xF0 else (0x80, 0x8F) if b == 0xF4 else (0x80, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What remains when the input ends inside a character."""
        left, self.need = self.need, 0
        return "�" if left else ""


def decode(ids: list[int], bytes_of: dict[int, bytes]) -> str:
    """Streaming decode, token by token."""
    m = Utf8Machine()
    return "".join(m.feed(bytes_of[i]) for i in ids) + m.end()


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``(key, ids ARRAY<INT>)``, one row per input row.

    Special-token look-alikes are ordinary text. Null and empty texts give an empty list, repeated
    rows are kept, other columns are dropped before the rows leave the JVM. Rows are independent:
    no shuffle, and a worker holds one Arrow batch at a time.
    """
    where = path or default_path()
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(where)
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "ids": [enc.encode(t) for t in pdf["t"]]})

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, ids array<int>")
    return out.select(F.col("k").alias(key), "ids")


def round_trip(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``(key, n_ids, same)``: whether streaming decode of the ids gives the text back."""
    where = path or default_path()
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(where)
        for pdf in batches:
            ids = [enc.encode(t) for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "n_ids": [len(x) for x in ids], "same": [decode(x, enc.fst.bytes_of) == (t or "") for x, t in zip(ids, pdf["t"])]})

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, n_ids bigint, same boolean")
    return out.select(F.col("k").alias(key), "n_ids", "same")
