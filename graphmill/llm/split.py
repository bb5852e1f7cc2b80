"""Splitting oversized texts at natural boundaries by pointer doubling.

Every place where a piece may end is a node.  A node's successor is the end of
the piece that begins one overlap before it, so the greedy cuts of a text are
the chain of successors from its start.  The chain is not walked: successor
tables are squared (``jump[jump]``) and the set of cuts known so far is mapped
through each power, which doubles it, until the end of the text is met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEWLINE, SPACE, STOPS = 10, 32, (46, 33, 63)


def _forward(pos: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First character start at or after each position (UTF-8: 3 steps at most)."""
    n = len(starts)
    for _ in range(3):
        pos = pos + ((pos < n) & ~starts[np.minimum(pos, n - 1)])
    return pos


def _backward(pos: np.ndarray, starts: np.ndarray) -> np.ndarray:
    for _ in range(3):
        pos = pos - ~starts[pos]
    return pos


def _last_in(ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The last of the sorted ``ends`` in (low, high], or -1."""
    if not len(ends):
        return np.full(len(low), -1, np.int64)
    at = np.searchsorted(ends, high, "right") - 1
    found = ends[np.maximum(at, 0)]
    return np.where((at >= 0) & (found > low), found, -1)


def cut(content: bytes, limit: int = 1500, floor: int = 750, overlap: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of all pieces of one UTF-8 text."""
    n = len(content)
    if n <= limit:
        return np.array([0], np.int64), np.array([n], np.int64)
    b = np.frombuffer(content, np.uint8)
    starts = (b & 0xC0) != 0x80
    newline = b == NEWLINE
    blank = newline | (b == SPACE)
    words = np.flatnonzero(blank) + 1
    sentences = np.flatnonzero(blank[1:] & np.isin(b[:-1], STOPS)) + 2
    after_run = np.append(~newline[2:], True)
    paragraphs = np.flatnonzero(newline[:-1] & newline[1:] & after_run) + 2

    # Between far word ends the fallback may cut at any character.
    edges = np.concatenate(([0], words, [n]))
    nodes = [words]
    for i in np.flatnonzero(np.diff(edges) >= floor):
        nodes.append(np.flatnonzero(starts[edges[i] : edges[i + 1]]) + edges[i])
    node = np.unique(np.concatenate(nodes)).astype(np.int64)

    begin = np.concatenate(([0], _forward(np.maximum(node - overlap, 0), starts)))
    low, high = begin + floor, begin + limit
    end = _last_in(paragraphs, low, high)
    for kind in (sentences, words):
        end = np.where(end < 0, _last_in(kind, low, high), end)
    end = np.where(end < 0, _backward(np.minimum(high, n - 1), starts), end)
    last = n - begin <= limit
    end = np.where(last, n, end)

    stop = len(begin)
    jump = np.append(np.where(last, stop, np.searchsorted(node, end) + 1), stop)
    reach = np.zeros(1, np.int64)
    while True:
        ahead = jump[reach]
        ahead = ahead[ahead != stop]
        whole = len(ahead) < len(reach)
        reach = np.concatenate((reach, ahead))
        if whole:
            break
        jump = jump[jump]
    reach.sort()
    return begin[reach], end[reach]


def split_documents(df: DataFrame, id_col: str = "id", text_col: str = "content", limit: int = 1500, floor: int = 750, overlap: int = 150) -> DataFrame:
    """Pieces ``(document_id, start_offset, end_offset)`` of all texts above ``limit`` bytes.

    Null, empty and short texts give no rows.  An id delivered more than once is
    cut once; if its deliveries differ, the one with the smallest content hash
    counts.  A text without any boundary is cut at character starts.  Other
    columns are not read, so their names cannot clash.
    """
    if not 0 <= overlap < floor < limit:
        raise ValueError("0 <= overlap < floor < limit is needed")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for content in batch.column(1).cast(pa.binary()):
                s, e = cut(content.as_py(), limit, floor, overlap)
                starts.append(s)
                ends.append(e)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["document_id", "h", "s", "e"])

    big = df.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("content")).where(F.octet_length("content") > limit)
    cuts = big.select("document_id", "content", F.xxhash64("content").alias("h")).mapInArrow(pieces, "document_id string, h bigint, s array<bigint>, e array<bigint>")
    once = cuts.groupBy("document_id").agg(F.min_by(F.struct("s", "e"), "h").alias("p"))
    both = once.select("document_id", F.explode(F.arrays_zip(F.col("p.s").alias("s"), F.col("p.e").alias("e"))).alias("x"))
    return both.select("document_id", F.col("x.s").alias("start_offset"), F.col("x.e").alias("end_offset"))
