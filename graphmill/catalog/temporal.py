"""Temporal queries: events as edges from a user to an event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import measures
from graphmill.operators import temporal
from graphmill.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


#: First second, step and last second of the windows asked for.
START, STEP, STOP = 1_704_067_200, 86_400 * 7, 1_704_067_200 + 86_400 * 70


def edges(spark, sf):
    """Odd events last a day, even ones are points."""
    e = table(spark, sf, "events").where("ts is not null and user_id is not null and event_type is not null")
    t = F.unix_timestamp("ts")
    spans = F.col("event_id") % 2 == 1
    return e.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.col("event_type").alias("target"), t.alias("timestamp"), F.when(spans, t).alias("start_time"), F.when(spans, t + 86400).alias("end_time"))


_T = """t AS (SELECT event_id, 'u' || user_id AS source, event_type AS target, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL),
e AS (SELECT *, ts AS a, CASE WHEN event_id % 2 = 1 THEN ts + 86400 ELSE ts END AS b FROM t)"""
_A, _B = START + STEP, START + 2 * STEP


@query(f"WITH {_T} SELECT event_id, source, target FROM e WHERE a <= {_A} AND b >= {_A}")
def snapshot_at(spark, sf):
    return temporal.snapshot(edges(spark, sf), _A).select("event_id", "source", "target")


@query(f"""WITH {_T}, w AS (SELECT s AS t FROM generate_series({START}, {STOP - 1}, {STEP}) g(s)), j AS (SELECT t, source, target FROM w JOIN e ON a <= t + {STEP} AND b >= t),
n AS (SELECT t, count(DISTINCT node) AS nodes FROM (SELECT t, source AS node FROM j UNION ALL SELECT t, target FROM j) GROUP BY 1), m AS (SELECT t, count(*) AS edges FROM j GROUP BY 1)
SELECT t AS window_start, nodes, edges, round(2 * edges / (nodes * (nodes - 1)), 6) AS density FROM n JOIN m USING (t)""")
def evolution(spark, sf):
    return temporal.evolution(edges(spark, sf), START, STOP, STEP).withColumn("density", F.round("density", 6))


@query(f"""WITH {_T}, w AS (SELECT s AS t FROM generate_series({START}, {STOP - 1}, {STEP}) g(s)), j AS (SELECT t, source, target FROM w JOIN e ON a <= t + {STEP} AND b >= t)
SELECT t AS window_start, node, count(*) AS degree FROM (SELECT t, source AS node FROM j UNION ALL SELECT t, target FROM j) GROUP BY 1, 2""")
def degree_over_time(spark, sf):
    return temporal.degree_over_time(edges(spark, sf), START, STOP, STEP)


_CHURN = f"""p AS (SELECT DISTINCT node FROM (SELECT source AS node FROM e WHERE a <= {_A} AND b >= {START} UNION ALL SELECT target FROM e WHERE a <= {_A} AND b >= {START})),
q AS (SELECT DISTINCT node FROM (SELECT source AS node FROM e WHERE a <= {_B} AND b >= {_A} UNION ALL SELECT target FROM e WHERE a <= {_B} AND b >= {_A}))"""


@query(f"WITH {_T}, {_CHURN} SELECT coalesce(p.node, q.node) AS node, CASE WHEN p.node IS NULL THEN 'added' WHEN q.node IS NULL THEN 'removed' ELSE 'stable' END AS change FROM p FULL JOIN q ON p.node = q.node")
def node_churn(spark, sf):
    e = edges(spark, sf)
    return temporal.churn(temporal.snapshot(e, START, _A), temporal.snapshot(e, _A, _B))


@query(f"""WITH {_T}, s AS (SELECT node, count(*) AS s FROM (SELECT source AS node FROM e WHERE a <= {_A} AND b >= {START} UNION ALL SELECT target FROM e WHERE a <= {_A} AND b >= {START}) GROUP BY 1),
n AS (SELECT node, count(*) AS n FROM (SELECT source AS node FROM e WHERE a <= {_B} AND b >= {_A} UNION ALL SELECT target FROM e WHERE a <= {_B} AND b >= {_A}) GROUP BY 1)
SELECT coalesce(s.node, n.node) AS node, round(CASE WHEN coalesce(s, 0) > 0 THEN (coalesce(n, 0) - s) / s ELSE coalesce(n, 0) END, 6) AS growth FROM s FULL JOIN n ON s.node = n.node ORDER BY 2 DESC, 1 LIMIT 20""")
def top_growing(spark, sf):
    e = edges(spark, sf)
    return temporal.top_growing(temporal.snapshot(e, START, _A), temporal.snapshot(e, _A, _B), 20).withColumn("growth", F.round("growth", 6))


@query(f"WITH {_T} SELECT node, min(ts) AS first_seen, max(ts) AS last_seen FROM (SELECT source AS node, ts FROM e UNION ALL SELECT target, ts FROM e) GROUP BY 1")
def node_lifetimes(spark, sf):
    return temporal.node_lifetimes(edges(spark, sf))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def tumbling_windows(spark, sf):
    e = table(spark, sf, "events").where("ts is not null").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("""SELECT CAST(b - i * INTERVAL '30 minutes' AS TIMESTAMP) AS window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) AS b FROM events WHERE ts IS NOT NULL), generate_series(0, 3) g(i) GROUP BY 1""")
def sliding_windows(spark, sf):
    e = table(spark, sf, "events").where("ts is not null").groupBy(F.window("ts", "2 hours", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("w.start").alias("window_start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS fresh FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS events FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    return temporal.sessions(table(spark, sf, "events").where("ts is not null and user_id is not null"), "user_id", "ts")


@query("""SELECT l.event_id, r.value AS as_of_value FROM (SELECT * FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL) l
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' AND ts IS NOT NULL GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def as_of_join(spark, sf):
    e = table(spark, sf, "events").where("ts is not null")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return temporal.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "ts", ["value"]).select("event_id", "as_of_value")


@query("""SELECT 'A>B>C' AS path, 2 AS edges, 0.9 * 0.95 * 0.8 * 0.7 AS confidence, 50 AS span""")
def causal_chains(spark, sf):
    rows = [("A", "B", "caused", 0.9, "Caused", 100, 0.9), ("B", "C", "LED_TO", 0.8, None, 150, None), ("A", "C", "knows", 0.9, None, 120, None), ("C", "D", "enabled", 0.7, "Enabled", 90, 0.6)]
    r = spark.createDataFrame(rows, "source string, target string, relation_type string, confidence double, temporal_type string, start_time bigint, causal_strength double")
    return temporal.causal_chains(r, "A", "C", 3).select(F.array_join("path", ">").alias("path"), "edges", "confidence", "span")


_NOW = START + 86_400 * 365 * 40


@query(f"""WITH {_T}, y AS (SELECT event_id, floor(abs({_NOW} - floor((a + b) / 2)) / (365 * 24 * 3600)) AS y FROM e),
r AS (SELECT event_id, CASE WHEN y <= 10 THEN 0.3 WHEN y <= 50 THEN 0.3 * (1 - (y - 10) / 40) WHEN y <= 200 THEN 0.1 * (1 - (y - 50) / 150) ELSE 0.05 END AS r FROM y)
SELECT event_id, round(r, 6) AS relevance, round(0.8 * (1 + r + 0.15 + 0.2 * 0.9), 6) AS weight FROM r""")
def dynamic_weights(spark, sf):
    e = edges(spark, sf).withColumn("r", measures.temporal_relevance("timestamp", F.coalesce("end_time", "timestamp"), F.lit(_NOW)))
    return e.select("event_id", F.round("r", 6).alias("relevance"), F.round(measures.dynamic_weight(F.lit(0.8), None, F.col("r"), F.lit(1), F.lit(0.9)), 6).alias("weight"))


@query("""SELECT event_type, list_sort(list(value))[least(CAST(floor(count(value) * 0.95) AS INT), count(value) - 1) + 1] AS p95, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latency_histogram(spark, sf):
    """The value at floor(0.95 n) of each type, by rank instead of a collected list."""
    from pyspark.sql import Window as W

    e = table(spark, sf, "events").where("value is not null").select("event_type", "value")
    n = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    r = e.withColumn("r", F.row_number().over(W.partitionBy("event_type").orderBy("value"))).join(n, "event_type")
    return r.where(F.col("r") == F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1) + 1).select("event_type", F.col("value").alias("p95"), "n", "mean")
