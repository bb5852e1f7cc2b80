"""Near-duplicate texts: a self-join by PartEnum signatures and a history join by pivot distances.

Both compare the sets of ``WIDTH`` consecutive words of two texts; both work on
distinct contents, of which ids are members, and verify every pair exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.runs import by_key, pairs_in_runs, splitmix
from graphmill.operators.bloom import Bloom
from graphmill.session import exists, materialize, new_path, release

WORD = r"[\p{L}\p{N}]+"
#: Copies of one content up to this number are given as all their pairs, more as pairs with the first of them.
ALL_PAIRS = 64


def filled(col: str | Column) -> Column:
    """Whether a text is neither null nor blank."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).rlike(r"(?U)\S")


def shingle_sets(contents: DataFrame, text_col: str = "content", width: int = 3, min_words: int = 10) -> DataFrame:
    """``(…, m, sh)`` of the texts of at least ``min_words`` words: the distinct hashed runs of ``width`` words."""
    words = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), lambda w: F.lower(w))
    keep = [c for c in contents.columns if c != text_col]
    some = contents.select(*keep, words.alias("w")).where(F.size("w") >= max(min_words, width))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: F.xxhash64(*[F.element_at(F.col("w"), i + k) for k in range(width)]))
    return some.select(*keep, F.array_distinct(runs).alias("sh")).select(*keep, F.size("sh").alias("m"), "sh")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float, a: str = "a", b: str = "b", other: DataFrame | None = None) -> DataFrame:
    """The pairs ``(a, b, similarity)`` whose sets share at least ``threshold`` of their union; sets are keyed by ``n``.

    Where both sides know their distances to the coarse pivots, pairs that
    differ by more in their sum than similar sets can are dropped first.
    """
    other = sets if other is None else other
    coarse = "coarse" in sets.columns and "coarse" in other.columns
    side = lambda df, name, k: df.select(F.col("n").alias(name), F.col("m").alias(f"m{k}"), F.col("sh").alias(f"s{k}"), *([F.col("coarse").alias(f"c{k}")] if coarse else []))
    both = pairs.select(a, b).join(side(sets, a, "a"), a).join(side(other, b, "b"), b).withColumn("t", F.col("ma") + F.col("mb"))
    if coarse:
        apart = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.abs(x - y).cast("int")), F.lit(0), lambda s, x: s + x)
        both = both.where(apart <= F.lit((1 - threshold) / (1 + threshold)) * F.col("t") + 1e-9)
    both = both.select(a, b, "t", F.size(F.array_intersect("sa", "sb")).alias("c"))
    return both.where(F.col("c") >= F.lit(threshold) * (F.col("t") - F.col("c"))).select(a, b, (F.col("c") / (F.col("t") - F.col("c"))).alias("similarity"))


# ---------------------------------------------------------------- frequencies

#: Elements are counted in so many buckets of their hash, a table of fixed size.
COUNT_BITS = 17


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """Occurrences of the elements of all sets by bucket; the driver gets 2**COUNT_BITS numbers at most.

    The counts only give an order of elements.  Any order that is the same for
    all sets leaves the results the same; one by frequency makes fewer candidates.
    """
    bucket = F.shiftrightunsigned(F.col("s"), 64 - COUNT_BITS).cast("int")
    rows = sets.select(F.explode("sh").alias("s")).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return counts


def _rarity(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts[(values.view(np.uint64) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], (1 << 20) - 1).astype(np.uint64)


# ---------------------------------------------------------------- PartEnum

#: Sets of 2**(q-1) to 2**q - 1 elements form size band q; one of band q is signed for bands q and q + 1,
#: so two sets of which neither is twice as large as the other meet in one band.
#: Parts an element of the largest sets of a band, and parts of the bands up to ``SMALL_BAND``, in which
#: no two elements of a set are expected to share a part.
PER_ELEMENT, SMALL_BAND, SMALL_PARTS = 8, 5, 1 << 26
#: Signatures that two similar sets are made to share, where their sizes allow so many.
SHARED = 4
#: A set whose signatures are fewer than expected by so many deviations and so many more takes the exact way.
DEVIATIONS, SLACK = 6, 2
#: So does one with a signature that more sets than this share after the commonest have been left out.
LIMIT = 256


def parts(band: int) -> int:
    """Second-level parts of a band; two of them make a first-level partition."""
    return SMALL_PARTS if band <= SMALL_BAND else PER_ELEMENT * 2**band


@cache
def fewest(band: int) -> np.ndarray:
    """For each size up to the band's largest, the number of signatures that a set has but by rare chance: non-decreasing."""
    n, size = parts(band), np.arange(2**band, dtype=float)
    if band <= SMALL_BAND:
        return size
    mean = n * -np.expm1(size * np.log1p(-1 / n))
    load = size / n
    spread = np.sqrt(np.maximum(n * (np.exp(-load) - (1 + load) * np.exp(-2 * load)), 0))
    low = np.maximum(mean - DEVIATIONS * spread - SLACK, 0)
    return np.minimum.accumulate(low[::-1])[::-1]


def overlap(size: np.ndarray, signs: np.ndarray, band: int, threshold: float) -> np.ndarray:
    """Signatures of a band that a set must share with any similar set there that has as many as ``fewest`` says.

    Similar sets x, y differ in at most r (|x| + |y|) elements, r = (1 - t) / (1 + t).
    An element in which they differ spoils one signature at most, so they share
    max(S(x), S(y)) - r (|x| + |y|).  The least of this over all sizes of y in
    the band is where the two arguments meet, or at an end of the range.
    """
    r, low = (1 - threshold) / (1 + threshold), fewest(band)
    own = size >= 2 ** (band - 1)
    first = np.ceil(np.maximum(size * threshold, np.where(own, 2 ** (band - 2), 2 ** (band - 1))) - 1e-9).astype(np.int64)
    last = np.minimum(np.floor(size / threshold + 1e-9), 2**band - 1).astype(np.int64)
    meet = np.searchsorted(low, signs)
    at = [np.clip(meet + k, first, last) for k in (-1, 0)]
    least = np.minimum(*[np.maximum(signs, low[np.clip(y, 0, len(low) - 1)]) - r * (size + y) for y in at])
    return np.where(first > last, SHARED + signs, np.ceil(least - 1e-9)).astype(np.int64)


def signatures(values: np.ndarray, offsets: np.ndarray, counts: np.ndarray, threshold: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(signature, row)`` of all sets of a batch, given as one flat array and offsets, and what each set must share.

    The feature domain of a band is hashed into first-level partitions and each
    of these into two parts.  A set's elements in one part make one signature
    (of two parts all choices of all but one are enumerated); two sets agree in
    it if they agree on that part, however they differ elsewhere.  Empty parts
    give none, and the number of others bounds what is shared from below
    (``overlap``).  As similar sets share T signatures, each may leave out the
    T - SHARED whose rarest element is commonest and still shares SHARED.
    A set that must share 0 has too few signatures for any such claim.
    """
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    band = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) + 1
    value = splitmix(values.view(np.uint64))
    rarity = _rarity(values, counts)
    must = np.full(len(size), SHARED)
    signs, rows = [], []
    for b in range(int(band.min()), int(band.max()) + 2) if len(size) else ():
        use = (band[row] == b) | (band[row] == b - 1)
        if not use.any():
            continue
        n = parts(b)
        part = (splitmix(value[use] ^ np.uint64(b * 7919)) % np.uint64(n)).astype(np.int64)
        group = row[use] * n + part
        order = np.argsort(group, kind="stable")
        group = group[order]
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        # A signature is named by its elements alone, so one that both bands of a set give is posted once.
        sign = np.add.reduceat(splitmix(value[use][order]), start)
        rank = (np.minimum.reduceat(rarity[use][order], start) << np.uint64(44)) | (sign >> np.uint64(20))
        of = group[start] // n
        have = np.bincount(of, minlength=len(size))
        here = np.flatnonzero((band == b) | (band == b - 1))
        share = overlap(size[here], have[here], b, threshold)
        poor = (have[here] < fewest(b)[size[here]]) | (share < 1)
        must[here] = np.minimum(must[here], np.where(poor, 0, share))
        keep = np.zeros(len(size), np.int64)
        keep[here] = np.where(poor, 0, have[here] - np.maximum(share - SHARED, 0))
        by_rank = np.argsort(rank)
        by_rank = by_rank[np.argsort(of[by_rank].astype(np.uint16), kind="stable")]
        of, sign = of[by_rank], sign[by_rank]
        begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        kept = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of)))) < keep[of]
        signs.append(sign[kept])
        rows.append(of[kept])
    if not signs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), must
    sign, of = np.concatenate(signs), np.concatenate(rows)
    order = np.argsort(sign)
    order = order[np.argsort(of[order].astype(np.uint16), kind="stable")]
    sign, of = sign[order], of[order]
    new = np.append(True, (sign[1:] != sign[:-1]) | (of[1:] != of[:-1]))[: len(sign)]
    return sign[new], of[new], must


def _sign(counts, threshold: float):
    """Rows ``(sign, n)``; a set's number carries what it must share in its last three bits.  Sign null: too few signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = part.column(1)
                sign, row, must = signatures(np.asarray(sets.flatten().to_numpy(zero_copy_only=False)), np.append(0, np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))), counts.value, threshold)
                n = (part.column(0).to_numpy() << 3) | must
                poor = n[must == 0]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(sign.view(np.int64)), pa.nulls(len(poor), pa.int64())]), pa.array(np.append(n[row], poor))], ["sign", "n"])

    return run


def _pairs_of_short_runs(limit: int):
    """All pairs ``(a, b, need)`` of runs of at most ``limit`` rows, and ``(-1, n, need)`` for each row of a longer run or a null key; need 0 says null."""

    def give(a, b, need):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(need.astype(np.int8))], ["a", "b", "need"])

    def emit(cols, i, j):
        a, b = cols[1][i], cols[1][j]
        need = np.minimum(a & 7, b & 7)
        return give(np.minimum(a, b) >> 3, np.maximum(a, b) >> 3, need)

    def alone(cols):
        n = cols[1]
        return give(np.full(len(n), -1), n >> 3, np.minimum(n & 7, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pairs_in_runs(batches, emit, alone, limit)

    return run


def near_pairs(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs ``(a, b, similarity)`` of the stored sets ``(n, m, sh)`` by PartEnum signatures, none lost.

    A similar pair shares the signatures that ``signatures`` promises.  If all
    of them are in lists of at most ``LIMIT`` sets, the pair meets that often.
    If one is in a longer list, both sets are in it: such sets are joined among
    themselves by their rarest elements (``probe``), as many as any similar set
    must meet.  Sets with too few signatures are so joined with all sets.
    """
    spark = sets.sparkSession
    counts = bucket_counts(sets)
    shared = spark.sparkContext.broadcast(counts)
    signed = sets.select("n", "sh").mapInArrow(_sign(shared, threshold), "sign bigint, n bigint")
    met = by_key(signed, "sign").mapInArrow(_pairs_of_short_runs(LIMIT), "a bigint, b bigint, need tinyint")
    counted = materialize(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need")).where("shared >= need"), "met")
    found = counted.where("a >= 0").select("a", "b")
    odd = counted.where("a < 0").select(F.col("b").alias("n"), (F.col("need") == 0).alias("poor"))
    if not odd.isEmpty():
        asked = materialize(sets.select("n", "m", "sh").join(odd, "n"), "asked")
        poor = asked.where("poor").select("n", "m", "sh")
        extra = probe(asked.select("n", "m", "sh"), asked.select("n", "m", "sh"), counts, threshold)
        if not poor.isEmpty():
            extra = extra.unionByName(probe(poor, sets.select("n", "m", "sh"), counts, threshold))
        found = found.unionByName(extra.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()
    return similar(found, sets, threshold)


# ---------------------------------------------------------------- pivot distances

#: With |x - y| the size of the symmetric difference, a metric, and pivots that are disjoint sets,
#: |d(x, p) - d(y, p)| summed over pivots bounds d(x, y) from below.  Fine pivots hold one element each,
#: ``COARSE`` others a part of the element domain each.
COARSE = 64
SETS, PIVOTS = "n bigint, m int, sh array<bigint>, coarse array<smallint>", "pivot bigint, n bigint, m int"


def _nearest_pivots(counts, threshold: float):
    """Rows ``(pivot, n, m)``: the fine pivots to which a set is near and few others are, as many as the bound requires.

    A similar set has threshold * m of x's elements at least, so it is near one
    of any m - threshold * m + 1 of x's pivots, and near SHARED of SHARED - 1
    more; the first of all that are common to both are among these of either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = part.column(2)
                value = np.asarray(sets.flatten().to_numpy(zero_copy_only=False))
                size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                rank = (_rarity(value, counts.value) << np.uint64(44)) | (splitmix(value.view(np.uint64)) >> np.uint64(20))
                order = np.argsort(rank)
                order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
                least = np.ceil(threshold * size - 1e-9).astype(np.int64)
                most = size - least + np.minimum(SHARED, least)
                kept = order[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) < most[row]]
                take = pa.array(row[kept])
                yield pa.RecordBatch.from_arrays([pa.array(value[kept]), part.column(0).take(take), part.column(1).take(take)], ["pivot", "n", "m"])

    return run


def pivot_table(sets: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """``(pivot, n, m)`` of the sets ``(n, m, sh)``, made where a set is; nothing is shuffled.

    m is the distance to the empty pivot and m - 1 that to the pivots listed; to
    all other fine pivots it is m + 1.
    """
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    return sets.select("n", F.col("m").cast("int").alias("m"), "sh").mapInArrow(_nearest_pivots(shared, threshold), PIVOTS)


def meet(keys: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(x, y)`` that the distances to fine pivots and to the empty one do not exclude; x of ``keys``, y of ``table``.

    An equality on the pivot and a range on the distance to the empty pivot.
    """
    t = table.select("pivot", F.col("n").alias("y"), F.col("m").alias("my"))
    in_range = (F.col("my") >= F.col("mx") * threshold) & (F.col("my") <= F.col("mx") / threshold)
    both = keys.withColumnsRenamed({"n": "x", "m": "mx"}).join(t, "pivot").where(in_range & (F.col("x") != F.col("y")))
    need = F.least(F.lit(SHARED), F.ceil(F.lit(threshold) * F.least("mx", "my") - 1e-9))
    return both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"), F.min(need).alias("need")).where("shared >= need").select("x", "y")


def probe(asked: DataFrame, history: DataFrame, counts: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """Pairs ``(x, y)`` of ``asked`` and ``history`` sets that the triangle inequality cannot exclude."""
    return meet(pivot_table(asked, counts, threshold), pivot_table(history, counts, threshold), threshold)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sets = part.column(2)
            values = np.asarray(sets.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            row = np.repeat(np.arange(part.num_rows), sets.value_lengths().to_numpy(zero_copy_only=False))
            table = np.bincount(row * COARSE + (splitmix(values) % np.uint64(COARSE)).astype(np.int64), minlength=part.num_rows * COARSE)
            coarse = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * COARSE, pa.int32()), pa.array(np.minimum(table, 32767).astype(np.int16)))
            yield pa.RecordBatch.from_arrays([*part.columns, coarse], [*part.schema.names, "coarse"])


def profiled(sets: DataFrame) -> DataFrame:
    """``(n, m, sh, coarse)``: the sets with the sizes of their parts in the coarse pivots."""
    return sets.select("n", F.col("m").cast("int").alias("m"), "sh").mapInArrow(_profile, SETS)


class History:
    """The stored table of pivot distances of everything accepted: batches are checked against it and appended.

    ``pivots`` holds the distances to fine pivots, in ranges of the pivot number; ``sets`` the distances to the empty and the coarse pivots and
    the set itself.  Each append writes new files and rewrites none.  The order
    of pivots is that of the first batch and kept with the table, so what is
    stored stays right; it is opened again by its path.

    A check reads the ranges its pivots lie in.  Rows whose pivot no record of
    the batch has are dropped where they are read, by a filter of bounded size,
    so what is shuffled and compared follows the batch.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, threshold: float = 0.5, ranges: int | None = None) -> None:
        self.spark, self.path = spark, path or new_path(spark, "history")
        self.counts: np.ndarray | None = None
        if exists(spark, f"{self.path}/order"):
            row = spark.read.parquet(f"{self.path}/order").first()
            self.counts, self.threshold, self.ranges = np.frombuffer(row["counts"], "<i8"), row["threshold"], row["ranges"]
        else:
            self.threshold, self.ranges = threshold, ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _start(self, sets: DataFrame) -> None:
        if self.counts is None:
            self.counts = bucket_counts(sets)
            row = [(bytearray(self.counts.astype("<i8").tobytes()), float(self.threshold), int(self.ranges))]
            self.spark.createDataFrame(row, "counts binary, threshold double, ranges int").coalesce(1).write.parquet(f"{self.path}/order")

    def range_of(self, pivot: str = "pivot") -> Column:
        """Ranges of equal width over the 64-bit pivot numbers."""
        return F.floor(F.shiftrightunsigned(F.col(pivot), 33) * self.ranges / float(1 << 31)).cast("int")

    def append(self, sets: DataFrame) -> None:
        """Add the sets ``(n, m, sh)`` of accepted records; n is a bigint that is new to the table."""
        batch = uuid4().hex
        at = f"{self.path}/sets/batch={batch}"
        profiled(sets).write.option("compression", "zstd").parquet(at)
        stored = self.spark.read.schema(SETS).parquet(at)
        self._start(stored)
        rows = pivot_table(stored, self.counts, self.threshold).withColumn("range", self.range_of())
        rows.repartition(self.ranges, "range").write.option("compression", "lz4").partitionBy("range").parquet(f"{self.path}/pivots/batch={batch}")

    def _stored(self, kind: str, schema: str) -> DataFrame | None:
        if not exists(self.spark, f"{self.path}/{kind}"):
            return None
        return self.spark.read.schema(f"{schema}, batch string" + (", range int" if kind == "pivots" else "")).option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")

    def admitted(self, keys: DataFrame) -> DataFrame:
        """The stored rows ``(pivot, n, m)`` on pivots of ``keys``, and few others."""
        stored = self._stored("pivots", PIVOTS)
        hit = [r[0] for r in keys.select(self.range_of().alias("range")).distinct().collect()]  # at most ``ranges`` numbers
        if not hit or stored is None:
            return self.spark.createDataFrame([], PIVOTS)
        return Bloom.of(keys, "pivot").admit(stored.where(F.col("range").isin(hit)).select("pivot", "n", "m"), "pivot")

    def check(self, sets: DataFrame, within: bool = True) -> DataFrame:
        """``(x, y, stored)``: similar pairs of the new ``sets`` with stored ones, and with each other (x < y) if ``within``.

        Pivots that both are near make candidates; their distances to the
        coarse pivots must agree as far as the triangle inequality demands;
        the distance itself is then computed.
        """
        own = materialize(profiled(sets), "asked")
        self._start(own)
        keys = materialize(pivot_table(own, self.counts, self.threshold), "asked-pivots")
        pairs = materialize(meet(keys, self.admitted(keys), self.threshold), "candidates")
        hit = pairs.select(F.col("y").alias("n")).distinct()
        stored = self._stored("sets", SETS)
        out = self.spark.createDataFrame([], "x bigint, y bigint, stored boolean")
        if stored is not None and not hit.isEmpty():
            theirs = Bloom.of(hit, "n").admit(stored.select("n", "m", "sh", "coarse"), "n")
            out = similar(pairs, own, self.threshold, "x", "y", theirs).select("x", "y", F.lit(True).alias("stored"))
        if within:
            each = meet(keys, keys, self.threshold).where("x < y")
            out = out.unionByName(similar(each, own, self.threshold, "x", "y").select("x", "y", F.lit(False).alias("stored")))
        return out


# ---------------------------------------------------------------- whole tables


def distinct_contents(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(h, content)`` once per content, and ``(id, h)`` once per id; null contents are left out.

    Contents are told apart by 128 bits.  An id delivered with several contents
    keeps the one with the smallest hash.
    """
    h = F.struct(F.xxhash64("content").alias("p"), F.xxhash64(F.lit(1), "content", F.length("content")).alias("q"))
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("content")).where("id is not null and content is not null").withColumn("h", h)
    return rows.groupBy("h").agg(F.first("content").alias("content")), rows.groupBy("id").agg(F.min("h").alias("h"))


def near_duplicates(df: DataFrame, id_col: str = "id", text_col: str = "content", width: int = 3, threshold: float = 0.5, min_words: int = 10) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, n)`` of each distinct content of at least ``min_words`` words, and pairs ``(a, b, similarity)`` of contents.

    Null, blank and short texts are in neither.  Repeated rows count once.
    """
    contents, members = distinct_contents(df, id_col, text_col)
    sets = materialize(shingle_sets(contents, "content", width, min_words).withColumn("n", F.monotonically_increasing_id()), "sets")
    of = materialize(members.join(sets.select("h", "n"), "h").select("id", "n"), "members")
    return of, near_pairs(sets.select("n", "m", "sh"), threshold)


def id_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id_a, id_b)`` with id_a < id_b: similar ids, and ids of one content.

    A content with more than ``ALL_PAIRS`` ids is given by the pairs of its
    first id with the others, and its first id stands for it in other pairs.
    """
    sized = members.groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("first"))
    known = members.join(sized, "n")
    some = materialize(known.where((F.col("k") <= ALL_PAIRS) | (F.col("id") == F.col("first"))).select("n", "id", "k"), "speakers")
    few = some.where((F.col("k") > 1) & (F.col("k") <= ALL_PAIRS)).select("n", F.col("id").alias("id_a"))
    copies = few.join(few.withColumnRenamed("id_a", "id_b"), "n").where("id_a < id_b").select("id_a", "id_b")
    star = known.where((F.col("k") > ALL_PAIRS) & (F.col("id") != F.col("first"))).select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    across = pairs.join(some.select(F.col("n").alias("a"), F.col("id").alias("i")), "a").join(some.select(F.col("n").alias("b"), F.col("id").alias("j")), "b")
    return across.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).unionByName(copies).unionByName(star)


def new_records(df: DataFrame, index: DataFrame, id_col: str = "id", text_col: str = "content", batch_col: str = "batch_no", threshold: float = 0.5, width: int = 3, min_words: int = 10) -> DataFrame:
    """``(id, batch, verdict)`` of all ids of the batches after batch 0: ``known``, ``copy``, ``near`` or ``accepted``.

    Ids are taken by batch (an id's lowest), then by id.  ``known`` ids have
    their content's proper hash in ``index`` under another document id; ``copy``
    and ``near`` ones have the same or a similar content as an accepted id
    before them.  Ids of batch 0 are accepted.  Ids whose content is null or
    blank get ``empty`` and are not accepted; ids without any batch are left out.

    The history is appended to a ``History``, and the new contents that may be
    accepted are checked against it and against each other, so what is compared
    follows the batches.  As accepting one record can keep a later one out,
    verdicts are settled in rounds along the chains of similar new contents.
    """
    # Only the rows with the earliest batch of an id decide what its content is.
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("content"), F.col(batch_col).cast("int").alias("batch")).where("id is not null and batch is not null")
    rows = rows.withColumn("h", F.when(filled("content"), F.substring(F.sha2("content", 256), 1, 32)))
    records = materialize(rows.groupBy("id").agg(F.min("batch").alias("batch"), F.min_by("h", F.struct("batch", "h")).alias("h")), "records")
    late = records.where("batch >= 1")
    listed = index.select(F.col("content_hash").alias("proper"), F.col("document_id").alias("other")).where("proper is not null and other is not null").distinct()
    known = late.where("h is not null").withColumn("proper", F.concat(F.lit("hash_"), F.substring("h", 1, 16))).join(listed, "proper").where("other != id").select("id").distinct()
    old = records.where("batch < 1 and h is not null").select("h").distinct().withColumn("old", F.lit(True))
    open_ = late.where("h is not null").join(known, "id", "left_anti").join(old, "h", "left")
    firsts = open_.where("old is null").groupBy("h").agg(F.min(F.struct("batch", "id")).alias("first"))
    firsts = materialize(firsts.select("h", F.xxhash64("h").alias("n"), "first.batch", "first.id"), "firsts")

    wanted = old.select("h", F.lit(True).alias("old")).unionByName(firsts.select("h", F.lit(False).alias("old")))
    contents = rows.where("h is not null").select("h", "content").groupBy("h").agg(F.first("content").alias("content")).join(wanted, "h")
    sets = materialize(shingle_sets(contents, "content", width, min_words).select(F.xxhash64("h").alias("n"), "m", "sh", "old"), "sets", ["old"])
    history = History(df.sparkSession, threshold=threshold)
    history.append(sets.where("old").select("n", "m", "sh"))
    near = materialize(history.check(sets.where("not old").select("n", "m", "sh")), "near")

    gone = materialize(near.where("stored").select(F.col("x").alias("n")).distinct(), "gone")
    place = firsts.select("n", F.struct("batch", "id").alias("p"))
    both = near.where("not stored").join(place.withColumnsRenamed({"n": "x", "p": "px"}), "x").join(place.withColumnsRenamed({"n": "y", "p": "py"}), "y")
    first_x = F.col("px") < F.col("py")
    edges = both.select(F.when(first_x, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(first_x, F.col("x")).otherwise(F.col("y")).alias("y"))
    drop = lambda e, out: e.join(out.withColumnRenamed("n", "x"), "x", "left_anti").join(out.withColumnRenamed("n", "y"), "y", "left_anti")
    waiting = materialize(drop(edges, gone), "waiting")
    while not waiting.isEmpty():
        # Contents that wait for none are accepted; those that wait for an accepted one are near it.
        free = waiting.select(F.col("y").alias("n")).distinct().join(waiting.select(F.col("x").alias("n")), "n", "left_anti")
        near_now = materialize(waiting.join(free.withColumnRenamed("n", "y"), "y", "left_semi").select(F.col("x").alias("n")).distinct(), "near-now")
        left = materialize(drop(waiting, near_now), "waiting")
        gone = gone.unionByName(near_now)
        release(waiting)
        waiting = left
    gone_h = firsts.join(gone, "n", "left_semi").select("h", F.lit(True).alias("near"))
    first_ids = firsts.select("id", F.lit(True).alias("first"))
    judged = open_.join(first_ids, "id", "left").join(gone_h, "h", "left")
    verdict = F.when(F.col("old").isNotNull() | F.col("first").isNull(), "copy").when(F.col("near").isNotNull(), "near").otherwise("accepted")
    return (
        judged.select("id", "batch", verdict.alias("verdict"))
        .unionByName(late.join(known, "id", "left_semi").select("id", "batch", F.lit("known").alias("verdict")))
        .unionByName(late.where("h is null").select("id", "batch", F.lit("empty").alias("verdict")))
    )
