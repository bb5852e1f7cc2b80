"""Keeping a graph up to date: change logs, upserts, deltas, conflicts, streams."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphmill.functions.measures import map_changes, map_hash
from graphmill.session import exists, listed


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last change of each key; deleted keys are dropped.

    ``log`` has ``operation``: insert, update, upsert or delete.  Of equal
    ``order`` values a delete is the later one.
    """
    w = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order], (F.col("operation") == "delete").desc())
    last = log.withColumn("_r", F.row_number().over(w)).where("_r = 1 and operation != 'delete'")
    return last.drop("_r", "operation")


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` put in place of those with the same key; the key must be unique in both."""
    return base.join(changes.select(*key), key, "left_anti").unionByName(changes.select(*base.columns))


def delete(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return base.join(keys.select(*key), key, "left_anti")


def delta(before: DataFrame, after: DataFrame, key: list[str], properties: str | None = None, content_hash: str | None = None) -> DataFrame:
    """``(key, change, …)``: added, removed, modified, by key and content hash.

    The hash is ``content_hash`` or that of the property map, whatever the
    order of its entries.  With ``properties`` the changed names are given too.
    """
    h = (lambda: F.col(content_hash)) if content_hash else (lambda: map_hash(properties))
    side = lambda df, n: df.select(*key, h().alias(f"{n}_hash"), *([F.col(properties).alias(f"{n}_map")] if properties else []), F.lit(True).alias(n))
    both = side(before, "was").join(side(after, "now"), key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was_hash").eqNullSafe(F.col("now_hash")), "modified")
    out = both.withColumn("change", change).where("change is not null")
    return out.select(*key, "change", *([map_changes("was_map", "now_map").alias("properties")] if properties else []))


def delta_statistics(d: DataFrame) -> DataFrame:
    return d.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified")])


def apply_delta(before: DataFrame, after: DataFrame, d: DataFrame, key: list[str], undo: bool = False) -> DataFrame:
    """``before`` with the delta applied, or ``after`` with it taken back."""
    base, other, gone = (after, before, "added") if undo else (before, after, "removed")
    touched = d.select(*key, "change")
    kept = base.join(touched.select(*key), key, "left_anti")
    return kept.unionByName(other.select(*base.columns).join(touched.where(F.col("change") != gone).select(*key), key, "left_semi"))


STRATEGIES = ("keep_existing", "keep_new", "merge", "latest", "most_confident")


def resolve(existing: DataFrame, new: DataFrame, key: list[str], values: list[str], strategy: str = "latest", time: str | None = None, confidence: str | None = None, custom: Callable | None = None) -> DataFrame:
    """One row a key of two versions of a table, each with unique keys.

    ``merge`` takes the new value where it is not null; ``custom`` is called
    with the column pair of each value and gives the column to keep.
    """
    pick = [*values, *([time] if time and time not in values else []), *([confidence] if confidence and confidence not in values else [])]
    a = existing.select(*key, F.struct(*pick).alias("_a"))
    b = new.select(*key, F.struct(*pick).alias("_b"))
    both = a.join(b, key, "full_outer")
    newer = {
        "keep_existing": F.col("_a").isNull(),
        "keep_new": F.col("_b").isNotNull(),
        "latest": F.col("_a").isNull() | (F.coalesce(F.col(f"_b.{time}") >= F.col(f"_a.{time}"), F.col("_b").isNotNull() & F.col(f"_a.{time}").isNull())) if time else None,
        "most_confident": F.col("_a").isNull() | F.coalesce(F.col(f"_b.{confidence}") > F.col(f"_a.{confidence}"), F.lit(False)) if confidence else None,
    }
    if custom:
        return both.select(*key, *[custom(F.col(f"_a.{v}"), F.col(f"_b.{v}")).alias(v) for v in pick])
    if strategy == "merge":
        return both.select(*key, *[F.coalesce(F.col(f"_b.{v}"), F.col(f"_a.{v}")).alias(v) for v in pick])
    rule = newer.get(strategy)
    if rule is None:
        raise ValueError(f"{strategy!r} is no strategy, or lacks its column; there are {', '.join(STRATEGIES)}")
    return both.select(*key, F.when(rule, F.col("_b")).otherwise(F.col("_a")).alias("x")).select(*key, "x.*")


def conflicts(existing: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``(key, fields)``: keys in both tables whose values differ, and in which columns."""
    a = existing.select(*key, *[F.col(v).alias(f"a_{v}") for v in values])
    b = new.select(*key, *[F.col(v).alias(f"b_{v}") for v in values])
    names = F.array_compact(F.array(*[F.when(~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")), F.lit(v)) for v in values]))
    return a.join(b, key).select(*key, names.alias("fields")).where(F.size("fields") > 0)


def consistency(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(problem, n)``: entities without an outgoing edge, edges without an end, entities without embedding."""
    ids = entities.select(F.col("id").alias("x")).distinct()
    orphan = ids.join(relations.select(F.col("source").alias("x")), "x", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("no outgoing edge").alias("problem"), "n")
    broken = relations.join(ids.withColumnRenamed("x", "source"), "source", "left_anti").unionByName(relations.join(ids.withColumnRenamed("x", "source"), "source", "left_semi").join(ids.withColumnRenamed("x", "target"), "target", "left_anti").select(*relations.columns)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge without an end").alias("problem"), "n")
    out = orphan.unionByName(broken)
    if "embedding" in entities.columns:
        out = out.unionByName(entities.agg(F.count_if(F.col("embedding").isNull()).alias("n")).select(F.lit("no embedding").alias("problem"), "n"))
    return out


def affected(edges: DataFrame, changed: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within ``hops`` of the changed ones: what cached results must be computed anew for."""
    from graphmill.operators.graph import reach

    return reach(edges, changed, hops)


# ---------------------------------------------------------------- streams


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; events more than ``late`` behind the newest are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def first_contents(stream: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once, the state of a key being kept for ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def run_available(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what the source holds now, batch by batch, and return; a later call goes on from there."""
    q = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def publish(changes: DataFrame, path: str) -> None:
    """Add changes to a log that others may follow; each call adds files and rewrites none."""
    changes.write.mode("append").parquet(f"{path}/log")


def subscribe(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log of ``publish`` as a stream: every subscriber gets every change once, from its own checkpoint."""
    return spark.readStream.schema(schema).parquet(f"{path}/log")


def upsert_sink(path: str, key: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that merges change batches into a table of hash buckets; a batch seen before is not merged twice.

    Each batch rewrites only the buckets its keys fall into, under
    ``path/data/<batch>``, and then notes in ``path/manifest/<batch>`` which
    folder holds each bucket; ``read_upserts`` follows the last note.  ``buckets``
    counts for a new table only.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = _batches(spark, path)
        if number in done:
            return
        before = _manifest(spark, path, max(done)) if done else {"buckets": buckets, "at": {}}
        bucket = F.pmod(F.xxhash64(*key), F.lit(before["buckets"])).cast("int")
        fresh = batch.withColumn("bucket", bucket)
        hit = {str(r[0]) for r in fresh.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
        old = [f"{path}/{p}" for b, p in before["at"].items() if b in hit]
        log = fresh
        if old:
            log = fresh.unionByName(spark.read.parquet(*old).withColumn("bucket", bucket).withColumn("operation", F.lit("upsert")), allowMissingColumns=True)
        merged = latest(log, ["bucket", *key], order)
        merged.repartition(max(1, len(hit)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{number}")
        written = {name.split("=")[1]: f"data/{number}/{name}" for name in listed(spark, f"{path}/data/{number}") if name.startswith("bucket=")}
        at = {b: p for b, p in before["at"].items() if b not in hit} | written
        note = json.dumps({"buckets": before["buckets"], "at": at})
        spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest/{number}")

    return sink


def _batches(spark: SparkSession, path: str) -> list[int]:
    return [int(n) for n in listed(spark, f"{path}/manifest") if exists(spark, f"{path}/manifest/{n}/_SUCCESS")]


def _manifest(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest/{number}").first()[0])


def read_upserts(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert_sink`` keeps, as of its last batch; an error if there is none yet."""
    paths = list(_manifest(spark, path, max(_batches(spark, path)))["at"].values())
    return spark.read.parquet(*[f"{path}/{p}" for p in paths])
