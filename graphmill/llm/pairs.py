"""Items that appear together: a pair table kept up to date by signed deltas.

The table holds, hash-bucketed on disk, the number of baskets of every pair and
of every item.  A change of baskets is turned into signed deltas (+1 for what a
basket holds now, -1 for what it held before); merging rewrites only the
buckets the deltas touch, and scores are recomputed from the merged counts.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.session import exists, materialize, new_path, remove

#: Items of a basket that are paired at once; larger baskets are paired block by block.
BLOCK = 128
#: Pairs a bucket should hold, the fewest buckets, and the most tasks that write them.
ROWS_A_BUCKET, FEWEST_BUCKETS, MOST_TASKS = 1_000_000, 16, 8192


def baskets(df: DataFrame, id_col: str, items_col: str) -> DataFrame:
    """``(items)``: the sorted distinct non-null items of every basket id that has any.

    An id delivered more than once is one basket with the items of all its
    deliveries.  Items differing in case or blanks are different items.
    """
    rows = df.select(F.col(id_col).alias("id"), F.array_compact(F.col(items_col)).alias("items")).where(F.size("items") > 0)
    return rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")).select("items")


def _pair_rows(b: DataFrame) -> DataFrame:
    """One row ``(a, b)`` with a < b for each two items of a basket, in blocks of bounded size."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / BLOCK).cast("int")), lambda i: F.slice(F.col("items"), i * BLOCK + 1, BLOCK))
    small = b.where((F.size("items") > 1) & (F.size("items") <= BLOCK)).select(F.explode("items").alias("a"), "items").select("a", F.explode(F.filter("items", lambda x: x > F.col("a"))).alias("b"))
    cut = b.where(F.size("items") > BLOCK).select(blocks.alias("blocks"))
    some = cut.select(F.posexplode("blocks").alias("i", "left"), "blocks").select("left", F.explode(F.expr("slice(blocks, i + 1, size(blocks))")).alias("right")).repartition(F.xxhash64("left", "right"))
    large = some.select(F.explode("left").alias("a"), "right").select("a", F.explode(F.filter("right", lambda x: x > F.col("a"))).alias("b"))
    return small.unionByName(large)


def deltas(b: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    """Signed deltas of the pairs ``(a, b, n)`` and of the items ``(a, n)``; item null counts baskets."""
    pairs = _pair_rows(b).groupBy("a", "b").agg((F.count(F.lit(1)) * sign).alias("n"))
    single = b.select(F.explode(F.array_append(F.col("items"), F.lit(None))).alias("a")).groupBy("a").agg((F.count(F.lit(1)) * sign).alias("n"))
    return pairs, single


class PairTable:
    """Persistent counts; ``apply`` merges a change, ``scores`` measures association.

    The folder holds, for pairs and for items, one Parquet folder a hash bucket,
    and a manifest of each version that says which folders count; a table is
    opened again by its path.  There are as many buckets as keep each near
    ``ROWS_A_BUCKET`` pairs, so a change rewrites few of them if it is small;
    their number is multiplied, and everything rewritten, when the table has
    outgrown them.  Folders that a change replaced stay until the next change,
    for readers of the version before.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        """``buckets`` is the number to begin with; without it the first change decides."""
        self.spark, self.buckets = spark, buckets
        self.path = path or new_path(spark, "pair-table")
        self.version, self.rows = 0, 0
        self.at: dict[str, dict[int, str]] = {"pairs": {}, "items": {}}
        self.stale: list[str] = []
        if exists(spark, f"{self.path}/manifest"):
            versions = [int(v) for v in self._list(f"{self.path}/manifest") if exists(spark, f"{self.path}/manifest/{v}/_SUCCESS")]
            known = json.loads(spark.read.text(f"{self.path}/manifest/{max(versions)}").first()[0])
            self.version, self.buckets, self.rows, self.stale = max(versions), known["buckets"], known["rows"], known["stale"]
            self.at = {kind: {int(k): p for k, p in known[kind].items()} for kind in self.at}

    def _bucket(self, *cols: str) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, only: list[int] | None = None) -> DataFrame:
        schema = "a string, b string, n bigint" if kind == "pairs" else "a string, n bigint"
        paths = [f"{self.path}/{p}" for k, p in self.at[kind].items() if only is None or k in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _merge(self, kind: str, delta: DataFrame, all_of_it: bool) -> list[str]:
        """Rewrite the buckets of ``delta``; returns the folders that no longer count."""
        keys = ["a", "b"] if kind == "pairs" else ["a"]
        out = f"{kind}/v{self.version}"
        if all_of_it:
            hit, merged = list(range(self.buckets)), delta
            if self.at[kind]:
                merged = delta.unionByName(self._read(kind)).groupBy(*keys).agg(F.sum("n").alias("n"))
        else:  # the buckets hit are few numbers, not data: at most ``buckets`` of them
            delta = delta.withColumn("bucket", self._bucket(*keys))
            delta.write.parquet(f"{self.path}/{out}-delta")
            delta = self.spark.read.schema(delta.schema).parquet(f"{self.path}/{out}-delta")
            hit = [r[0] for r in delta.select("bucket").distinct().collect()]
            merged = delta.select(*keys, "n").unionByName(self._read(kind, hit)).groupBy(*keys).agg(F.sum("n").alias("n"))
        merged = merged.where("n != 0").withColumn("bucket", self._bucket(*keys)).repartition(max(1, min(len(hit), MOST_TASKS)), "bucket")
        merged.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{out}")
        if not all_of_it:
            remove(self.spark, f"{self.path}/{out}-delta")
        written = {int(name.split("=")[1]): f"{out}/{name}" for name in self._list(f"{self.path}/{out}") if name.startswith("bucket=")}
        gone = [self.at[kind].pop(k) for k in (list(self.at[kind]) if all_of_it else hit) if k in self.at[kind]]
        self.at[kind].update(written)
        return gone

    def _list(self, path: str) -> list[str]:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return [s.getPath().getName() for s in jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(jpath)]

    def apply(self, after: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
        """Merge changed baskets: what they hold ``after`` the change and held ``before`` it.  Returns the items ``(a)`` of these baskets."""
        parts = [(materialize(b, "baskets"), sign) for b, sign in ((after, 1), (before, -1)) if b is not None]
        size = F.size("items").cast("bigint")
        self.rows += sum(b.agg(F.coalesce(F.sum(size * (size - 1) / 2), F.lit(0)).cast("bigint")).first()[0] for b, _ in parts)
        fresh = not self.at["items"] and not self.at["pairs"]
        need = max(FEWEST_BUCKETS, -(-self.rows // ROWS_A_BUCKET))
        grown = fresh or need > 4 * self.buckets
        if self.buckets is None or (grown and not fresh):
            self.buckets = need
        self.version += 1
        both = [deltas(b, sign) for b, sign in parts]
        sums = {kind: both[0][k] if len(both) == 1 else self._sum(kind, [p[k] for p in both]) for kind, k in (("pairs", 0), ("items", 1))}
        items = materialize(sums["items"], "changed-items")
        replaced = self._merge("pairs", sums["pairs"], grown) + self._merge("items", items, grown)
        old, self.stale = self.stale, replaced
        manifest = {"buckets": self.buckets, "rows": self.rows, "stale": self.stale, **self.at}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{self.version}")
        for folder in [*old, f"manifest/{self.version - 2}"]:
            remove(self.spark, f"{self.path}/{folder}")
        return items.where("a is not null").select("a")

    @staticmethod
    def _sum(kind: str, parts: list[DataFrame]) -> DataFrame:
        keys = ["a", "b"] if kind == "pairs" else ["a"]
        return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("n").alias("n"))

    def rescored(self, scores: DataFrame, changed: DataFrame, min_count: int = 1) -> DataFrame:
        """``scores`` of the version before, brought up to date: only pairs with a changed item are computed again.

        ``changed`` are the items that ``apply`` returned.  Of other pairs nothing
        but the number of baskets is new, a factor of their lift.
        """
        same = scores.join(changed, "a", "left_anti").join(changed.withColumnRenamed("a", "b"), "b", "left_anti")
        total = self._read("items").where("a is null").select(F.col("n").alias("total"))
        lift = F.col("n_ab") * F.col("total") / (F.col("n_a").cast("double") * F.col("n_b"))
        kept = same.crossJoin(F.broadcast(total)).select("a", "b", "n_ab", "n_a", "n_b", F.col("total").alias("n"), lift.alias("lift"), F.log2(lift).alias("pmi"))  # one row
        return kept.unionByName(self.scores(min_count, items=changed))

    def scores(self, min_count: int = 1, min_lift: float = 0.0, items: DataFrame | None = None) -> DataFrame:
        """``(a, b, n_ab, n_a, n_b, n, lift, pmi)`` of the pairs with n_ab >= min_count and lift >= min_lift.

        ``items`` (column ``a``) limits the result to pairs with an affected item.
        With ``min_lift`` > 0 items in more than n / min_lift baskets are left out
        before the join: n_ab <= min(n_a, n_b), so no pair of theirs can reach it.
        """
        singles = self._read("items")
        total = singles.where("a is null").select(F.col("n").alias("total"))
        known = singles.where("a is not null").crossJoin(F.broadcast(total))  # one row
        useful = known.where((F.col("n") >= min_count) & (F.col("n") * min_lift <= F.col("total")))
        pairs = self._read("pairs").where(F.col("n") >= min_count)
        if items is not None:
            some = items.select("a").distinct()
            pairs = pairs.join(some, "a", "left_semi").unionByName(pairs.join(some, "a", "left_anti").join(some.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b", "n"))
        joined = pairs.withColumnRenamed("n", "n_ab").join(useful.select("a", F.col("n").alias("n_a"), "total"), "a").join(useful.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b")
        lift = F.col("n_ab") * F.col("total") / (F.col("n_a").cast("double") * F.col("n_b"))
        out = joined.select("a", "b", "n_ab", "n_a", "n_b", F.col("total").alias("n"), lift.alias("lift"), F.log2(lift).alias("pmi"))
        # Whole numbers decide at the border: n_ab * n against min_lift * n_a * n_b.
        return out.where(F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
