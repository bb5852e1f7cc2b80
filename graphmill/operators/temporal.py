"""Graphs over time: snapshots, evolution, churn, causal chains, windows, as-of joins.

Temporal edges have ``source, target, edge_type, timestamp, weight, start_time,
end_time`` in Unix seconds; an edge with start and end is active between them,
one without at its timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphmill.functions.measures import is_causal
from graphmill.session import materialize


def active(low: int | Column, high: int | Column) -> Column:
    """Whether an edge is active somewhere in the closed range [low, high]."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    spans = F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    return F.when(spans, (F.col("start_time") <= high) & (F.col("end_time") >= low)).otherwise(F.col("timestamp").between(low, high))


def snapshot(edges: DataFrame, low: int, high: int | None = None) -> DataFrame:
    return edges.where(active(low, low if high is None else high))


def node_lifetimes(edges: DataFrame) -> DataFrame:
    """``(node, first_seen, last_seen)`` by timestamp."""
    ends = edges.select(F.col("source").alias("node"), "timestamp").unionByName(edges.select(F.col("target").alias("node"), "timestamp"))
    return ends.groupBy("node").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def in_windows(edges: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """Edges with ``window_start`` of each window [t, t + step] they are active in, t from ``start`` to ``end``.

    The windows of an edge are computed from its own times, so nothing is
    joined; an edge on a border belongs to both windows.
    """
    spans = F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    a = F.when(spans, F.col("start_time")).otherwise(F.col("timestamp"))
    b = F.when(spans, F.col("end_time")).otherwise(F.col("timestamp"))
    last = (end - 1 - start) // step
    first_k = F.greatest(F.ceil((a - start - step) / step), F.lit(0)).cast("int")
    last_k = F.least(F.floor((b - start) / step), F.lit(last)).cast("int")
    ks = F.when(first_k <= last_k, F.sequence(first_k, last_k))
    return edges.select("*", F.explode(ks).alias("_k")).withColumn("window_start", F.lit(start).cast("bigint") + F.col("_k") * step).drop("_k")


def evolution(edges: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """``(window_start, nodes, edges, density)`` of each window."""
    w = in_windows(edges, start, end, step)
    m = w.groupBy("window_start").agg(F.count(F.lit(1)).alias("edges"))
    n = w.select("window_start", F.explode(F.array("source", "target")).alias("node")).groupBy("window_start").agg(F.count_distinct("node").alias("nodes"))
    both = m.join(n, "window_start")
    k = F.col("nodes")
    return both.select("window_start", "nodes", "edges", F.when(k > 1, 2 * F.col("edges") / (k * (k - 1))).otherwise(0.0).alias("density"))


def degree_over_time(edges: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """``(window_start, node, degree)``."""
    return in_windows(edges, start, end, step).select("window_start", F.explode(F.array("source", "target")).alias("node")).groupBy("window_start", "node").agg(F.count(F.lit(1)).alias("degree"))


def churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(node, change)``: added, removed or stable between the edges of two snapshots."""
    side = lambda df, name: df.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn(name, F.lit(True))
    both = side(before, "was").join(side(after, "now"), "node", "full_outer")
    return both.select("node", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("stable").alias("change"))


def top_growing(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """``(node, growth)``: (end - start) / start degree, or the end degree of new nodes."""
    deg = lambda df, name: df.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias(name))
    both = deg(before, "s").join(deg(after, "e"), "node", "full_outer").fillna(0, ["s", "e"])
    growth = F.when(F.col("s") > 0, (F.col("e") - F.col("s")) / F.col("s")).otherwise(F.col("e").cast("double"))
    return both.select("node", growth.alias("growth")).orderBy(F.desc("growth"), "node").limit(k)


def causal_chains(relations: DataFrame, cause: str, effect: str, most_edges: int, least: float = 0.0, in_order: bool = True) -> DataFrame:
    """``(path, edges, confidence, span)`` from ``cause`` to ``effect`` over causal relations.

    ``relations``: source, target, relation_type, confidence, temporal_type,
    start_time, causal_strength.  A step counts confidence * (0.5 + 0.5 *
    strength), without a strength 0.7 * confidence; steps multiply.  With
    ``in_order`` start times must not fall along the chain.
    """
    step = relations.where(is_causal("temporal_type", "causal_strength", "relation_type"))
    factor = F.col("confidence") * F.when(F.col("causal_strength").isNotNull(), 0.5 + 0.5 * F.col("causal_strength")).otherwise(0.7)
    step = materialize(step.select("source", "target", factor.alias("f"), "start_time"), "causal")
    open_ = step.where(F.col("source") == cause).select(F.array("source", "target").alias("path"), F.col("target").alias("node"), F.lit(1).alias("edges"), F.col("f").alias("confidence"), F.col("start_time").alias("t0"), F.col("start_time").alias("t1"))
    found = None
    for n in range(1, most_edges + 1):
        open_ = materialize(open_, "chains")
        done = open_.where(F.col("node") == effect)
        found = done if found is None else found.unionByName(done)
        if n == most_edges:
            break
        nxt = open_.where(F.col("node") != effect).join(step.withColumnsRenamed({"source": "node", "start_time": "t"}), "node")
        fine = ~F.array_contains("path", F.col("target"))
        if in_order:
            fine = fine & (F.col("t").isNull() | F.col("t1").isNull() | (F.col("t") >= F.col("t1")))
        open_ = nxt.where(fine).select(F.array_append("path", F.col("target")).alias("path"), F.col("target").alias("node"), (F.col("edges") + 1).alias("edges"), (F.col("confidence") * F.col("f")).alias("confidence"), F.coalesce("t0", "t").alias("t0"), F.coalesce("t", "t1").alias("t1"))
    return found.where(F.col("confidence") >= least).select("path", "edges", "confidence", (F.col("t1") - F.col("t0")).alias("span")).orderBy(F.desc("confidence"), "path")


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the last row of ``right`` at or before its time.

    Both sides are sorted once together by key and time; no pairs are made.
    """
    kinds = dict(left.dtypes) | dict(right.dtypes)
    l = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), *[F.lit(None).cast(kinds[v]).alias(f"_{v}") for v in values])
    r = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), *[F.col(v).alias(f"_{v}") for v in values])
    w = W.partitionBy(*by).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = F.last(F.when(F.col("_side") == 0, F.struct(*[F.col(f"_{v}").alias(v) for v in values])), True).over(w)
    return l.unionByName(r).withColumn("_last", held).where("_side = 1").select("_row.*", *[F.col(f"_last.{v}").alias(f"as_of_{v}") for v in values])


def sessions(events: DataFrame, by: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """``(by, session_start, session_end, events)``: runs of events less than ``gap`` apart."""
    s = events.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return s.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
