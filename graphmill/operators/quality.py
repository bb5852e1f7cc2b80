"""Roll-ups of quality and checks of the phases of a pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def result_statistics(results: DataFrame) -> DataFrame:
    """``(query_id, results, mean_score, least_score, most_score)`` of ranked lists."""
    return results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"), F.avg("score").alias("mean_score"), F.min("score").alias("least_score"), F.max("score").alias("most_score"))


def score_statistics(df: DataFrame, score: str = "score", least: float = 0.0) -> DataFrame:
    """``(total, above, mean, least, most, median)`` of a column of scores; the median is exact, between two values their mean."""
    s = F.col(score)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(s >= least).alias("above"), F.avg(s).alias("mean"), F.min(s).alias("least"), F.max(s).alias("most"), F.median(s).alias("median"))


def score_histogram(df: DataFrame, score: str = "score", bins: int = 10) -> DataFrame:
    """``(bin, start, n)`` over ``bins`` equal steps from the least to the greatest score; the last holds the greatest."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(step > 0, F.least(F.floor((F.col(score) - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0)
    counted = df.crossJoin(F.broadcast(ends)).select(at.cast("int").alias("bin"), F.col("lo"), step.alias("step")).groupBy("bin", "lo", "step").agg(F.count(F.lit(1)).alias("n"))  # one row
    return counted.select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("start"), "n")


def strategy_quality(runs: DataFrame, by: str, metric: str) -> DataFrame:
    """``(by, n, mean, deviation)`` of a metric."""
    return runs.groupBy(by).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("deviation"))


def compared(quality: DataFrame, by: str, baseline: str) -> DataFrame:
    """``(by, improvement, t, significant)``: change of the mean against one strategy in percent, Welch's t, and whether |t| exceeds 1.96."""
    base = quality.where(F.col(by) == baseline).select(F.col("n").alias("n0"), F.col("mean").alias("m0"), F.col("deviation").alias("d0"))
    both = quality.where(F.col(by) != baseline).crossJoin(F.broadcast(base))  # one row
    spread = F.sqrt(F.pow("deviation", 2) / F.col("n") + F.pow("d0", 2) / F.col("n0"))
    t = F.when(spread > 0, (F.col("mean") - F.col("m0")) / spread)
    gain = F.when(F.col("m0") != 0, 100 * (F.col("mean") - F.col("m0")) / F.col("m0"))
    return both.select(by, gain.alias("improvement"), t.alias("t"), F.coalesce(F.abs(t) > 1.96, F.lit(False)).alias("significant"))


def rolling(runs: DataFrame, order: list[str], metric: str, last: int = 10, by: list[str] | None = None) -> DataFrame:
    """``runs`` with ``rolling``: the mean of the last ``last`` values of each group up to each row."""
    w = W.partitionBy(*(by or [F.lit(1)])).orderBy(*order).rowsBetween(-(last - 1), 0)
    return runs.withColumn("rolling", F.avg(metric).over(w))


def stagnation(runs: DataFrame, order: str, metric: str, last: int = 5, least: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """``runs`` with ``slope``, the least-squares slope of the last ``last`` values over their places, and whether it is under ``least``."""
    keys = by or [F.lit(1)]
    placed = runs.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    w = W.partitionBy(*keys).orderBy("_i").rowsBetween(-(last - 1), 0)
    slope = F.regr_slope(F.col(metric), F.col("_i").cast("double")).over(w)
    return placed.withColumn("slope", slope).withColumn("stagnant", F.coalesce(F.col("slope") < least, F.lit(False))).drop("_i")


def scaled(df: DataFrame, column: str, how: str = "min_max", by: list[str] | None = None) -> DataFrame:
    """``df`` with ``scaled``: between 0 and 1 (``min_max``; equal values give 0), as share of the sum (``sum``) or of the greatest (``max``)."""
    w, c = W.partitionBy(*(by or [F.lit(1)])), F.col(column)
    low, high, total = F.min(c).over(w), F.max(c).over(w), F.sum(c).over(w)
    out = {"min_max": F.when(high > low, (c - low) / (high - low)), "sum": F.when(total != 0, c / total), "max": F.when(high > 0, c / high)}[how]
    return df.withColumn("scaled", F.coalesce(out, F.when(c.isNotNull(), 0.0)))


def thresholds(df: DataFrame, column: str, by: list[str], deviations: float = 3.0) -> DataFrame:
    """``(by, mean, limit)`` with limit = mean + ``deviations`` * deviation of the whole group."""
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), (F.avg(column) + deviations * F.stddev_pop(column)).alias("limit"))


def benchmark_summary(runs: DataFrame, by: list[str], column: str) -> DataFrame:
    """``(by, n, total, mean, least, most, p50, p95, p99)``; a percentile is the value at place floor(n p), by rank and not by a collected list."""
    ranked = runs.where(F.col(column).isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(column)) - 1)
    size = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    at = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    picks = [F.max(F.when(F.col("_r") == at(p), F.col(column))).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)]
    return ranked.join(size, by).groupBy(*by, "n").agg(F.sum(column).alias("total"), F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most"), *picks)


def alerts(watched: DataFrame, column: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """Rows whose value is out of bounds, with ``alert`` saying which."""
    c = F.col(column)
    kind = F.when(c < least, "low") if least is not None else F.lit(None).cast("string")
    kind = F.coalesce(kind, F.when(c > most, "high")) if most is not None else kind
    return watched.withColumn("alert", kind).where("alert is not null")


def _checks(phase: str, df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    one = df.agg(*[c.alias(n) for n, c in checks.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.col(n), F.lit(False)).alias("passed")) for n in checks])).alias("x")
    return one.select(F.lit(phase).alias("phase"), rows).select("phase", "x.name", "x.passed")


def phase_checks(documents: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(phase, name, passed)`` of a built graph, one aggregate a phase.

    documents(id, content), chunks(id, content), entities(id, name,
    confidence), relations(source, target, confidence).
    """
    filled = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    n = F.count(F.lit(1))
    sure = F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    doc_size = documents.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("whole"))
    covered = chunks.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("held")).crossJoin(F.broadcast(doc_size))  # one row each
    ids = entities.select(F.col("id").alias("x")).distinct()
    loose = relations.join(ids.withColumnRenamed("x", "source"), "source", "left_anti").select("source").unionByName(relations.join(ids.withColumnRenamed("x", "target"), "target", "left_anti").select("source"))
    parts = [
        _checks("documents", documents, {"documents_not_empty": n > 0, "contents_filled": F.count_if(~filled("content")) == 0}),
        _checks("chunks", chunks, {"chunks_created": n > 0, "no_empty_chunks": F.count_if(~filled("content")) == 0, "ids_unique": n == F.count_distinct("id")}),
        _checks("coverage", covered, {"content_coverage": F.max("held") >= 0.9 * F.max("whole")}),
        _checks("entities", entities, {"entities_found": n > 0, "names_filled": F.count_if(~filled("name")) == 0, "confidence_valid": F.count_if(~sure) == 0}),
        _checks("relations", relations, {"relations_found": n > 0, "no_self_relations": F.count_if(F.col("source") == F.col("target")) == 0, "relation_confidence_valid": F.count_if(~sure) == 0}),
        _checks("graph", loose, {"ends_known": n == 0}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def phase_summary(checks: DataFrame) -> DataFrame:
    """``(phase, result, checks, failed)``: PASS if all checks of a phase passed."""
    g = checks.groupBy("phase").agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"))
    return g.select("phase", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL").alias("result"), "checks", "failed")


# Pieces of text that a query must not hold, and the longest query in bytes.
FORBIDDEN = ("drop table", "drop database", "delete from", "insert into", "update set", "; --", "' or '1'='1", '" or "1"="1', "union select")
LONGEST_QUERY = 10_000


def sanitized(text: str | Column) -> Column:
    """Without control characters, but with line ends and tabs."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}]", "")


def query_fault(text: str | Column) -> Column:
    """Why a query is refused: ``empty``, ``too long`` or ``forbidden``; null if it is not."""
    t = F.col(text) if isinstance(text, str) else text
    low = F.lower(t)
    bad = F.exists(F.array(*[F.lit(p) for p in FORBIDDEN]), lambda p: F.contains(low, p))
    return F.when(F.coalesce(t, F.lit("")) == "", "empty").when(F.octet_length(t) > LONGEST_QUERY, "too long").when(bad, "forbidden")
