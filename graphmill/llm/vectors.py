"""The most similar vectors of every vector by a permutation index.

A bounded sample of the vectors serves as pivots.  Each vector is represented
by its nearest pivots in order; it is posted once for every two of them, so a
posting list holds the vectors that see both pivots near.  Candidates are pairs
of one list whose brief permutations (one bit a reference pivot: is it in the
nearer half?) are close; they are ranked by footrule distance of the ordered
pivots, cut at a distance and not at a number, and reranked by exact cosine.

The number of pivots grows with the square root of the number of vectors, so
the expected length of a posting list of evenly spread vectors is constant.
Vectors in a longer list are a crowd, or beyond what ``MOST_PIVOTS`` can tell
apart; they are indexed again among themselves, with pivots from among them,
until lists are short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphmill.llm.runs import by_key, pairs_in_runs
from graphmill.session import materialize

#: Nearest pivots of a vector that are posted, two by two.
PREFIX = 9
#: Pivots a square root of the number of vectors; the bounds prove the size of what is broadcast.
PIVOTS_PER_ROOT, FEWEST_PIVOTS, MOST_PIVOTS = 6.5, 48, 32_768
#: Vectors of a longer list are indexed again, in so many levels at most; lists of the last level give all their pairs.
LIMIT, LEVELS = 2048, 4
#: Bits of the brief permutation, and those in which a candidate pair may differ.
BITS, MAX_BITS_APART = 128, 39
#: Footrule distance of the ordered nearest pivots beyond which a pair is no candidate.
MAX_FOOTRULE = 82.0


def usable(df: DataFrame, id_col: str = "id", vector_col: str = "embedding", dim: int = 96) -> DataFrame:
    """``(id, v)`` of the rows whose vector has ``dim`` values, no null or NaN or infinity, and is not all zero.

    If an id is delivered with different vectors, the one with the smallest hash counts.
    """
    v = F.col(vector_col).cast("array<float>")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("string").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & fine)


def _pivots(distinct: DataFrame, n: int, size: int) -> np.ndarray:
    """A sample of ``n`` of ``size`` vectors by hash, normalised; no task reads more than some 2 n of them."""
    hashed = distinct.select("v", F.xxhash64("h", F.lit(7)).alias("o"))
    if size > 4 * n:
        hashed = hashed.where(F.col("o") < int(2**64 * (2 * n + 100) / size) - 2**63)  # the smallest hashes, and so those of the order below
    rows = hashed.orderBy("o").limit(n).select("v").toArrow()
    m = np.stack([np.asarray(x, np.float64) for x in rows.column(0).to_pylist()])
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    m = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def _post(pivots, prefix: int):
    first, second = np.triu_indices(prefix, 1)
    places = (first * 16 + second).astype(np.int16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        m = len(p)
        bits = min(BITS, m)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                near = _matrix(part.column(1)) @ p.T
                top = np.argpartition(-near, min(prefix, m - 1), axis=1)[:, :prefix]
                order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
                top = np.take_along_axis(top, order, 1).astype(np.int64)
                half = near[:, :bits] > np.median(near[:, :bits], axis=1, keepdims=True)
                brief = np.zeros((len(half), BITS), bool)
                brief[:, :bits] = half
                brief = np.packbits(brief, axis=1).view(np.int64)
                a, b = top[:, first], top[:, second]
                swap = a > b  # the place of the pivot with the smaller number comes first
                key = np.where(swap, b * m + a, a * m + b)
                place = np.where(swap, (places % 16) * 16 + places // 16, places)
                width = key.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), width)), pa.array(place.ravel().astype(np.int16)), *(pa.array(np.repeat(b, width)) for b in brief.T)],
                    ["key", "n", "place", "brief", "brief2"],
                )

    return run


def _meet(apart: int, limit: int):
    """``(x, y, moved)`` of the pairs of a list whose brief permutations are close, and ``(-1, n, 0)`` of those in a longer list."""

    def give(x, y, moved):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(moved.astype(np.int32))], ["x", "y", "moved"])

    def emit(cols: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
        _, n, place, *brief = cols
        close = sum(np.bitwise_count((b[i] ^ b[j]).view(np.uint64)) for b in brief) <= apart
        i, j = i[close], j[close]
        moved = np.abs(place[i] // 16 - place[j] // 16) + np.abs(place[i] % 16 - place[j] % 16)
        return give(np.minimum(n[i], n[j]), np.maximum(n[i], n[j]), moved)

    def alone(cols: list[np.ndarray]) -> pa.RecordBatch:
        n = np.unique(cols[1])
        return give(np.full(len(n), -1), n, np.zeros(len(n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pairs_in_runs(batches, emit, alone, limit)

    return run


def _candidates(nodes: DataFrame, size: int, max_bits_apart: int, max_footrule: float, levels: int) -> list[DataFrame]:
    """Pairs ``(x, y)`` of the vectors ``(n, h, v)`` by the index of each level; a pair may be in several levels."""
    wanted = min(MOST_PIVOTS, size, max(FEWEST_PIVOTS, math.ceil(PIVOTS_PER_ROOT * math.sqrt(size))))
    pivots = _pivots(nodes, wanted, size)  # at most MOST_PIVOTS * dim floats
    prefix = min(PREFIX, len(pivots))
    if prefix < 2:
        return []
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)
    posted = nodes.select("n", "v").mapInArrow(_post(shared, prefix), "key bigint, n bigint, place smallint, brief bigint, brief2 bigint")
    met = by_key(posted, "key", "n").mapInArrow(_meet(max_bits_apart, LIMIT if levels > 1 else 1 << 62), "x bigint, y bigint, moved int")
    # A pair of s common pivots meets s(s-1)/2 times and its moves are counted s-1 times each.
    each = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("meets"), F.sum("moved").alias("moves"))
    common = (1 + F.sqrt(1 + 8 * F.col("meets"))) / 2
    footrule = F.col("moves") / F.greatest(common - 1, F.lit(1)) + (prefix - common) * (prefix + 1)
    ranked = materialize(each.where((F.col("x") < 0) | (footrule <= max_footrule)).select("x", "y"), "ranked")
    crowd = ranked.where("x < 0").select(F.col("y").alias("n"))
    many = crowd.count() if levels > 1 else 0
    out = [ranked.where("x >= 0")]
    if many:
        out += _candidates(materialize(nodes.join(crowd, "n", "left_semi"), "crowd"), many, max_bits_apart, max_footrule, levels - 1)
    return out


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            flat = [np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(c), -1) for c in (part.column(2), part.column(3))]
            a, b = flat
            cos = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cos)], ["x", "y", "cosine"])


def nearest(df: DataFrame, k: int = 5, id_col: str = "id", vector_col: str = "embedding", dim: int = 96, least: float = -1.0, max_bits_apart: int = MAX_BITS_APART, max_footrule: float = MAX_FOOTRULE) -> DataFrame:
    """``(id, neighbour, cosine, rank)``: of every usable vector the ``k`` other ids of highest cosine, at least ``least``.

    Ties go to the smaller id.  Rows with an unusable vector neither ask nor
    answer; repeated rows count once.  Equal vectors are indexed once and only
    their k + 1 smallest ids can be neighbours, so a group of copies costs no
    more than its size.  Vectors far from all others may get fewer than ``k``
    neighbours, which is the accuracy given up.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col, dim).withColumn("h", F.struct(F.xxhash64("v").alias("p"), F.xxhash64(F.lit(1), "v", F.element_at("v", -1)).alias("q")))
    members = rows.groupBy("id").agg(F.min("h").alias("h"))
    distinct = rows.groupBy("h").agg(F.first("v").alias("v"))
    nodes = materialize(distinct.withColumn("n", F.monotonically_increasing_id()), "vectors")
    size = nodes.count()
    if not size:
        return spark.createDataFrame([], "id string, neighbour string, cosine double, rank int")
    levels = _candidates(nodes, size, max_bits_apart, max_footrule, LEVELS)
    if not levels:
        pairs = nodes.select(F.col("n").alias("x"), F.col("n").alias("y")).where(F.lit(False))
    else:
        pairs = levels[0] if len(levels) == 1 else reduce(DataFrame.unionByName, levels).distinct()
    # Joined by sorting at every size: vectors grow with the table and are never broadcast, however few they look.
    one = pairs.hint("merge").join(nodes.select(F.col("n").alias("x"), F.col("v").alias("vx")), "x")
    two = one.hint("merge").join(nodes.select(F.col("n").alias("y"), F.col("v").alias("vy")), "y").select("x", "y", "vx", "vy")
    scored = materialize(two.mapInArrow(_cosines, "x bigint, y bigint, cosine double").where(F.col("cosine") >= least), "cosines")

    named = materialize(members.join(nodes.select("h", "n"), "h").select("n", "id"), "members")
    # The k + 1 smallest ids of each node, first within slices of it, so that no group of copies is one task's.
    sliced = named.withColumn("r", F.row_number().over(W.partitionBy("n", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))).where(F.col("r") <= k + 1)
    heads = sliced.withColumn("r", F.row_number().over(W.partitionBy("n").orderBy("id"))).where(F.col("r") <= k + 1).select("n", "id", "r")
    either = scored.unionByName(scored.select(F.col("y").alias("x"), F.col("x").alias("y"), "cosine"))
    own = heads.groupBy("n").agg(F.max("r").alias("r")).where("r > 1").select(F.col("n").alias("x"), F.col("n").alias("y"), F.lit(1.0).alias("cosine"))
    best = W.partitionBy("x").orderBy(F.desc("cosine"), "id")
    asked = either.unionByName(own).join(heads.select(F.col("n").alias("y"), "id"), "y").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    answers = named.join(asked.select(F.col("x").alias("n"), F.col("id").alias("neighbour"), "cosine"), "n").where("id != neighbour")
    order = W.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "neighbour", "cosine", "rank")
