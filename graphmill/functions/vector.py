"""Vector functions on array columns, in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: str | Column) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine; 0 where the lengths differ or a vector is null or all zero."""
    size = norm(a) * norm(b)
    fine = (F.size(_col(a)) == F.size(_col(b))) & (size > 0)
    return F.coalesce(F.when(fine, dot(a, b) / size), F.lit(0.0))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def closeness(a: str | Column, b: str | Column) -> Column:
    """exp(-distance), in [0, 1]."""
    return F.exp(-euclidean(a, b))


def unit(a: str | Column) -> Column:
    """Scaled to length 1; an all-zero vector stays."""
    n = norm(a)
    return F.transform(_col(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def random_vector(dimension: int, seed: int) -> Column:
    """Values in [-1, 1] from the seed and the row's place in it."""
    return F.array(*[F.rand(seed + i) * 2 - 1 for i in range(dimension)])


def hash_embedding(words: str | Column, dimension: int = 128) -> Column:
    """Mean of the words' hashed unit vectors, scaled to length 1; zeros without words.

    Every word is hashed to values in [-1, 1]; no model is needed.  Vectors of
    words are kept per batch, so a frequent word is hashed once.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(lists: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}
        places = np.arange(dimension, dtype=np.uint64)

        def one(word: str) -> np.ndarray:
            if word not in known:
                seed = np.frombuffer(hashlib.blake2b(word.encode(), digest_size=8).digest(), np.uint64)[0]
                x = places * np.uint64(0x9E3779B97F4A7C15) + seed
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                v = ((x ^ (x >> np.uint64(31))) % np.uint64(2000)).astype(float) / 1000 - 1
                known[word] = v / (np.linalg.norm(v) or 1.0)
            return known[word]

        def mean(ws) -> np.ndarray:
            if ws is None or not len(ws):
                return np.zeros(dimension)
            v = np.mean([one(w) for w in ws if w is not None] or [np.zeros(dimension)], axis=0)
            return v / (np.linalg.norm(v) or 1.0)

        return lists.map(mean)

    return embed(_col(words))
