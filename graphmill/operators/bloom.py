"""Set membership by a Bloom filter: a bitmap of bounded size that says "no" for certain and "yes" with few errors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits a key, hash functions, and the least and greatest number of bits (16 MB); more keys only mean more errors.
BITS_A_KEY, HASHES, LEAST, MOST = 16, 4, 16, 27
#: The bitmap is merged in blocks of so many bits, each by one group of an aggregation.
BLOCK = 1 << 16


def _places(keys: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    """Bit numbers of 64-bit keys, by double hashing."""
    k = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, two = k ^ (k >> np.uint64(29)), (k >> np.uint64(17)) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
    for i in range(hashes):
        yield (one + np.uint64(i) * two) >> np.uint64(64 - bits)


class Bloom:
    """Which 64-bit keys may be among the given ones; never "no" for one of them.  Null keys are in no filter."""

    def __init__(self, bits: int, hashes: int, bitmap: np.ndarray) -> None:
        self.bits, self.hashes, self.bitmap = bits, hashes, bitmap

    @classmethod
    def of(cls, keys: DataFrame, col: str, count: int | None = None, hashes: int = HASHES) -> "Bloom":
        """The filter of a bigint column; ``count`` is its expected number of keys, counted if not given."""
        count = keys.count() if count is None else count
        bits = min(MOST, max(LEAST, math.ceil(math.log2(max(1, count) * BITS_A_KEY))))

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = np.zeros(1 << bits, bool)
            for batch in batches:
                k = batch.column(0).drop_null().to_numpy()
                for at in _places(k, bits, hashes):
                    flags[at] = True
            blocks = np.packbits(flags).reshape(-1, BLOCK // 8)
            some = np.flatnonzero(blocks.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[i].tobytes() for i in some], pa.binary())], ["block", "part"])

        def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for b, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    x = np.frombuffer(part, np.uint8)
                    held[b] = held[b] | x if b in held else x
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "part"])

        parts = keys.select(F.col(col).cast("bigint").alias("k")).mapInArrow(fill, "block int, part binary")
        whole = parts.repartition("block").mapInArrow(unite, "block int, part binary").toArrow()  # at most 2**MOST bits
        bitmap = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, BLOCK // 8)
        for b, part in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist()):
            bitmap[b] = np.frombuffer(part, np.uint8)
        return cls(bits, hashes, bitmap.ravel())

    def contains(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in _places(keys, self.bits, self.hashes):
            out &= (self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
        return out

    def admit(self, df: DataFrame, col: str) -> DataFrame:
        """The rows of ``df`` whose key may be in the filter; others never leave the task that read them."""
        shared = df.sparkSession.sparkContext.broadcast((self.bits, self.hashes, self.bitmap))
        place = df.columns.index(col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = Bloom(*shared.value)
            for batch in batches:
                keys = batch.column(place)
                keep = mine.contains(np.asarray(keys.fill_null(0).to_numpy(zero_copy_only=False), np.int64)) & ~np.asarray(keys.is_null())
                if keep.any():
                    yield batch.filter(pa.array(keep))

        return df.mapInArrow(run, df.schema)
