"""Vectors: normalisation, similarity, hash embeddings."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    """Divided by the norm, at least ``eps``."""
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x.cast("double") / n)


def check_dimension(a: Column, dim: int) -> Column:
    """E5: the vector, or an error if its length is another."""
    return F.when(F.size(a) == dim, a).otherwise(F.raise_error(F.concat(F.lit(f"vector of {dim} values expected, got "), F.size(a).cast("string"))))


_WORD = re.compile(r"\w+")


def hash_vector(text: str | None, dim: int) -> list[float]:
    """Signed counts of words in bands chosen by keyed hashes, unit length; zero without words."""
    v = np.zeros(dim)
    for w in _WORD.findall((text or "").lower()):
        band = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4, key=b"band").digest(), "little") % dim
        sign = hashlib.blake2b(w.encode(), digest_size=4, key=b"sign").digest()[0] & 1
        v[band] += 1.0 if sign else -1.0
    return (v / max(float(np.linalg.norm(v)), 1e-12)).tolist()


def hash_counts(text: str | None, buckets: int = 4096) -> dict[int, float]:
    """Word counts summed into hash buckets."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        out[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4, key=b"band").digest(), "little") % buckets] += float(n)
    return dict(out)


def hash_embed(c: Column, dim: int = 64) -> Column:
    """Dense hash embedding; Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: hash_vector(t, dim))

    return run(c)


def hash_embed_sparse(c: Column, buckets: int = 4096) -> Column:
    """Sparse hash embedding as map of bucket to weight."""

    @F.pandas_udf("map<int,float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: hash_counts(t, buckets))

    return run(c)


def pack_sparse(v: dict[int, float] | None) -> bytes | None:
    """A count, the ids in order and their weights, little-endian words of four bytes; null for none."""
    if not v:
        return None
    ids = sorted(v)
    return np.uint32(len(ids)).astype("<u4").tobytes() + np.array(ids, "<i4").tobytes() + np.array([v[i] for i in ids], "<f4").tobytes()


def unpack_sparse(data: bytes | None) -> dict[int, float] | None:
    """The vector of :func:`pack_sparse`; null for null and for a count of zero."""
    n = int(np.frombuffer(data, "<u4", 1)[0]) if data else 0
    if not n:
        return None
    return dict(zip(np.frombuffer(data, "<i4", n, 4).tolist(), np.frombuffer(data, "<f4", n, 4 + 4 * n).tolist()))


def encode_sparse(c: Column) -> Column:
    """E8 on a column of maps; Arrow batches."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: pack_sparse(dict(v)) if v is not None else None)

    return run(c)


def decode_sparse(c: Column) -> Column:
    """E8 back to a column of maps."""

    @F.pandas_udf("map<int,float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(unpack_sparse)

    return run(c)
