"""Pairs of rows that share a key, from a stream sorted by the key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def splitmix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser on unsigned 64-bit arrays."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def pairs_in_runs(
    batches: Iterator[pa.RecordBatch],
    emit: Callable[[list[np.ndarray], np.ndarray, np.ndarray], pa.RecordBatch | None],
    alone: Callable[[list[np.ndarray]], pa.RecordBatch],
    limit: int,
) -> Iterator[pa.RecordBatch]:
    """Call ``emit(columns, i, j)`` for all row pairs i < j of one key, and ``alone(columns)`` for rows of a longer run than ``limit``.

    The first column is the key; rows of a key follow each other; null keys are
    runs too long.  Of the run that is open at the end of a batch at most
    ``limit`` + 1 rows are held.
    """

    def short(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = cols[0]
        at = np.arange(max(len(key) - 1, 0))
        for step in range(1, min(limit, len(key))):
            at = at[: np.searchsorted(at, len(key) - step)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                return
            for k in range(0, len(at), 1 << 18):
                some = at[k : k + (1 << 18)]
                out = emit(cols, some, some + step)
                if out is not None and out.num_rows:
                    yield out

    held: list[np.ndarray] = []
    over = None  # the key of an open run already known to be long
    for batch in batches:
        if batch.column(0).null_count:
            yield alone(_columns(batch.filter(batch.column(0).is_null())))
            batch = batch.filter(batch.column(0).is_valid())
        cols = _columns(batch)
        if over is not None:
            same = int(np.searchsorted(cols[0] != over, True)) if len(cols[0]) else 0
            if same:
                yield alone([c[:same] for c in cols])
            cols = [c[same:] for c in cols]
            if not len(cols[0]):
                continue
            over = None
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        key = cols[0]
        if not len(key):
            continue
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.diff(np.append(start, len(key)))
        open_ = start[-1]
        long = np.repeat(length > limit, length)
        if long.any():
            yield alone([c[long] for c in cols])
        done = ~long
        done[open_:] = False
        yield from short([c[done] for c in cols])
        over = key[-1] if length[-1] > limit else None
        held = [c[open_:] for c in cols] if over is None else []
    if held:
        yield from short(held)


def by_key(df: DataFrame, key: str, *more: str) -> DataFrame:
    """Rows of a key in one partition and in sequence, ordered by ``more`` inside it."""
    return df.repartition(key).sortWithinPartitions(key, *more)
