"""Upserts, deltas, conflicts, validation and stream-like jobs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.session import new_path, table
from graphmill.sources.readers import duplicate_contents, validate
from graphmill.streaming import changes

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def snapshots(spark, sf):
    """Orders before and after a change: every fifth is missing after, every seventh is missing before, every third differs."""
    o = table(spark, sf, "orders")
    props = lambda price: F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("price"), F.round(price, 2).cast("string"))
    before = o.where("o_orderkey % 7 != 0").select("o_orderkey", props(F.col("o_totalprice")).alias("properties"))
    after = o.where("o_orderkey % 5 != 0").select("o_orderkey", props(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).alias("properties"))
    return before, after


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'added' WHEN o_orderkey % 5 = 0 THEN 'removed' ELSE 'modified' END AS change FROM orders
WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 5 = 0) AND (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0)""")
def delta_nodes(spark, sf):
    return changes.delta(*snapshots(spark, sf), ["o_orderkey"], "properties").select("o_orderkey", "change")


@query("""SELECT count(*) FILTER (o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0) AS added, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0) AS removed, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0) AS modified FROM orders""")
def delta_statistics(spark, sf):
    return changes.delta_statistics(changes.delta(*snapshots(spark, sf), ["o_orderkey"], "properties"))


@query("""WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT user_id, event_type, value FROM e WHERE r = 1 AND event_type <> 'error'""")
def upsert_latest(spark, sf):
    e = table(spark, sf, "events").where("user_id is not null and ts is not null")
    log = e.select("user_id", "event_type", "value", "ts", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"))
    return changes.latest(log, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE s_name END AS name, round(s_acctbal, 2) AS balance FROM supplier""")
def conflict_merge(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("balance"))
    new = s.where("k % 2 = 0").select("k", F.lit("new").alias("name"), F.lit(None).cast("double").alias("balance"))
    return changes.resolve(s, new, ["k"], ["name", "balance"], "merge")


@query("SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0")
def conflict_detect(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return changes.conflicts(s, s.where("k % 2 = 0").withColumn("name", F.lit("new")), ["k"], ["name"]).select("k")


@query("""WITH i AS (SELECT DISTINCT name FROM extracted_entities WHERE name IS NOT NULL), r AS (SELECT source, target FROM extracted_relationships)
SELECT 'no outgoing edge' AS problem, count(*) AS n FROM i WHERE name NOT IN (SELECT source FROM r WHERE source IS NOT NULL)
UNION ALL SELECT 'edge without an end', count(*) FROM r WHERE source IS NULL OR target IS NULL OR source NOT IN (SELECT name FROM i) OR target NOT IN (SELECT name FROM i)""")
def graph_consistency(spark, sf):
    e = table(spark, sf, "extracted_entities").where("name is not null").select(F.col("name").alias("id")).distinct()
    return changes.consistency(e, table(spark, sf, "extracted_relationships").select("source", "target"))


@query("""SELECT count(*) FILTER (trim(coalesce(id, '')) <> '' AND trim(coalesce(name, '')) <> '' AND trim(coalesce(entity_type, '')) <> '') AS valid,
count(*) FILTER (NOT (trim(coalesce(id, '')) <> '' AND trim(coalesce(name, '')) <> '' AND trim(coalesce(entity_type, '')) <> '')) AS rejected FROM extracted_entities""")
def import_validation(spark, sf):
    rows = table(spark, sf, "extracted_entities").select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), "entity_type")
    out = validate(rows)
    a = out.entities.agg(F.count(F.lit(1)).alias("valid"))
    return a.crossJoin(F.broadcast(out.rejects.agg(F.count(F.lit(1)).alias("rejected"))))  # one row each


@query("SELECT sha256(text) AS content_hash, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def duplicate_documents(spark, sf):
    return duplicate_contents(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def stream_counts(spark, sf):
    """All event files as a stream, merged batch by batch into a table of counts."""
    path = new_path(spark, "stream")
    source = spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parque[t]")  # a pattern, as the table may be one file or a folder

    def sink(batch, number):
        batch.where("ts is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/out/{number}")

    changes.run_available(source, sink, f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out/*").groupBy("event_type").agg(F.sum("n").alias("n"))
