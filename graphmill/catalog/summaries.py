"""Summaries, thresholds, indexes and parts of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.catalog.graph import _E, star
from graphmill.catalog.quality import _SENT, _SETS
from graphmill.catalog.text import _SECTIONS
from graphmill.functions import measures, text
from graphmill.operators import chunking, entities, graph, quality, retrieval, search
from graphmill.plans import questions
from graphmill.session import new_path, table
from graphmill.sources.readers import validate
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


def _events(spark, sf):
    return table(spark, sf, "events").where("value is not null")


_P = "list_sort(list(value))[CAST(least(floor(count(*) * {}), count(*) - 1) AS INT) + 1] AS p{}"


@query(f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, {_P.format(0.5, 50)}, {_P.format(0.95, 95)}, {_P.format(0.99, 99)} FROM events WHERE value IS NOT NULL GROUP BY 1")
def benchmark_summary(spark, sf):
    return quality.benchmark_summary(_events(spark, sf), ["event_type"], "value").withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL), s AS (SELECT event_id, regr_slope(value, i) OVER (PARTITION BY event_type ORDER BY i ROWS 4 PRECEDING) AS slope FROM p)
SELECT event_id, round(CASE WHEN NOT isnan(slope) THEN slope END, 5) AS slope, coalesce(NOT isnan(slope) AND slope < 0.01, false) AS stagnant FROM s""")
def stagnation(spark, sf):
    return quality.stagnation(_events(spark, sf), "event_id", "value", 5, 0.01, ["event_type"]).select("event_id", F.round("slope", 5).alias("slope"), "stagnant")


@query("""SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS spread, round(value / sum(value) OVER w, 9) AS share FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type)""")
def scaled_scores(spark, sf):
    e = quality.scaled(_events(spark, sf), "value", "min_max", ["event_type"]).withColumnRenamed("scaled", "spread")
    return quality.scaled(e, "value", "sum", ["event_type"]).select("event_id", F.round("spread", 6).alias("spread"), F.round("scaled", 9).alias("share"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(avg(value) + 3 * stddev_pop(value), 5) AS \"limit\" FROM events WHERE value IS NOT NULL GROUP BY 1")
def score_thresholds(spark, sf):
    return quality.thresholds(_events(spark, sf), "value", ["event_type"]).select("event_type", F.round("mean", 6).alias("mean"), F.round("limit", 5).alias("limit"))


_C = "p AS (SELECT 'S' || s_suppkey AS node, 'N' || s_nationkey AS community, 0.8 AS c, 'SUPPLIER' AS t FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'N' || n_nationkey, 0.9, 'NATION' FROM nation)"


@query(f"WITH {_C} SELECT community, count(*) AS members, round(avg(c), 6) AS confidence, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM p GROUP BY 1")
def community_statistics(spark, sf):
    """Each nation with its suppliers."""
    s = star(spark, sf).where("source like 'S%'").select(F.col("target").alias("community"), "confidence", F.lit("SUPPLIER").alias("t"))
    n = star(spark, sf).where("source like 'N%'").select(F.col("source").alias("community"), "confidence", F.lit("NATION").alias("t"))
    g = s.unionByName(n).groupBy("community").agg(F.count(F.lit(1)).alias("members"), F.round(F.avg("confidence"), 6).alias("confidence"), F.array_join(F.array_sort(F.collect_set("t")), ",").alias("types"))  # two types
    return g


_CHUNK_TEXT = "c AS (SELECT id, max(document_id) AS document_id, max(content) AS text FROM text_chunks WHERE content IS NOT NULL GROUP BY 1)"


@query(f"""WITH {_CHUNK_TEXT}, s AS (SELECT document_id, id, text, {_SETS.format(_SENT)} AS s FROM c), p AS (SELECT id, s, unnest(range(1, len(s))) AS i FROM s WHERE len(s) > 1),
k AS (SELECT id, avg(len(list_intersect(s[i], s[i + 1])) / len(list_distinct(list_concat(s[i], s[i + 1])))) AS k FROM p GROUP BY 1)
SELECT document_id, count(*) AS chunks, round(avg(coalesce(k, 1)), 6) AS coherence, round(avg(length(text)), 6) AS mean_size FROM s LEFT JOIN k ON k.id = s.id GROUP BY 1""")
def chunk_coherence(spark, sf):
    c = table(spark, sf, "text_chunks").where("content is not null").groupBy("id").agg(F.max("document_id").alias("document_id"), F.max("content").alias("content"))
    g = c.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(chunking.sentence_coherence("content")), 6).alias("coherence"), F.round(F.avg(F.length("content")), 6).alias("mean_size"))
    return g


@query(f"""WITH {_SECTIONS} SELECT id, count(*) AS headings, max(level) AS depth, count(*) FILTER (level = 1) AS chapters, count(*) FILTER (level = 2) AS sections, count(*) FILTER (level > 2) AS below FROM h GROUP BY 1""")
def structure_statistics(spark, sf):
    s = chunking.sections(table(spark, sf, "graph_documents").where("content is not null").groupBy("id").agg(F.max("content").alias("content")), "id", "content")
    at = lambda c: F.count_if(c)
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("headings"), F.max("level").alias("depth"), at(F.col("level") == 1).alias("chapters"), at(F.col("level") == 2).alias("sections"), at(F.col("level") > 2).alias("below"))


@query("SELECT DISTINCT source, target, relation_type FROM extracted_relationships WHERE source IS NOT NULL AND target IS NOT NULL AND relation_type IS NOT NULL")
def distinct_relations(spark, sf):
    return table(spark, sf, "extracted_relationships").where("source is not null and target is not null and relation_type is not null").select("source", "target", "relation_type").distinct()


_TOP = """m AS (SELECT DISTINCT id, entity_key, regexp_replace(chunk_id, '_[0-9]+$', '') AS document FROM extracted_entities WHERE entity_key IS NOT NULL), t AS (SELECT entity_key, min(entity_type) AS entity_type FROM extracted_entities WHERE entity_type IS NOT NULL GROUP BY 1),
g AS (SELECT entity_key AS cluster, count(DISTINCT document) AS documents, count(DISTINCT id) AS mentions FROM m GROUP BY 1), i AS (SELECT cluster, entity_type, documents, round((0.4 * (ln(documents) + 1) + 0.3 * (ln(mentions) + 1) + 0.3 * documents) / 3, 6) AS importance FROM g JOIN t ON t.entity_key = cluster WHERE documents > 1)"""


@query(f"WITH {_TOP} SELECT entity_type, cluster, importance, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY importance DESC, cluster) AS rank FROM i) WHERE rank <= 3")
def top_entities(spark, sf):
    """The most important entities of each type among those in several documents."""
    e = table(spark, sf, "extracted_entities").where("entity_key is not null")
    m = e.dropDuplicates(["id"]).select(F.col("entity_key").alias("cluster"), F.regexp_replace("chunk_id", "_[0-9]+$", "").alias("document"))
    t = e.where("entity_type is not null").groupBy(F.col("entity_key").alias("cluster")).agg(F.min("entity_type").alias("entity_type"))
    some = entities.importance(m).where("documents > 1").join(t, "cluster").withColumn("importance", F.round("importance", 6))
    return search.top_k(some, 3, ["entity_type"], [F.desc("importance"), F.asc("cluster")]).select("entity_type", "cluster", "importance", "rank")


def _mapped(spark, sf):
    return table(spark, sf, "extracted_entities").where("entity_key is not null and chunk_id is not null").select(F.col("entity_key").alias("entity_id"), F.col("chunk_id").alias("chunk"), "confidence")


@query("""WITH m AS (SELECT DISTINCT entity_key AS entity_id, chunk_id AS chunk FROM extracted_entities WHERE entity_key IS NOT NULL AND chunk_id IS NOT NULL) SELECT * FROM m WHERE entity_id NOT LIKE 'P%' AND NOT regexp_matches(chunk, '_0$')""")
def merged_index(spark, sf):
    """Two overlapping halves merged; persons and first chunks removed."""
    m = _mapped(spark, sf)
    return entities.merged_index(m.where("coalesce(confidence, 0) < 0.8"), m.where("coalesce(confidence, 1) >= 0.7"), m.where("entity_id like 'P%'"), m.where(F.col("chunk").rlike("_0$")))


@query("""WITH k AS (SELECT entity_key AS id, count(DISTINCT chunk_id) AS n FROM extracted_entities WHERE entity_key IS NOT NULL GROUP BY 1), r AS (SELECT id, n / 10.0 AS score FROM k WHERE n >= 5 UNION ALL SELECT 'NOWHERE', 1.0), c AS (SELECT id AS chunk, max(content) AS content FROM text_chunks GROUP BY 1),
m AS (SELECT DISTINCT entity_key AS id, chunk_id AS chunk, content FROM extracted_entities JOIN c ON c.chunk = chunk_id WHERE entity_key IS NOT NULL)
SELECT r.id, m.chunk, round(score, 6) AS score, length(coalesce(content, r.id)) AS size FROM r LEFT JOIN m ON m.id = r.id""")
def chunks_of_ranked(spark, sf):
    m = _mapped(spark, sf)
    r = table(spark, sf, "extracted_entities").where("entity_key is not null").groupBy(F.col("entity_key").alias("id")).agg((F.count_distinct("chunk_id") / 10.0).alias("score")).where("score >= 0.5")
    r = r.unionByName(spark.createDataFrame([("NOWHERE", 1.0)], "id string, score double"))
    c = table(spark, sf, "text_chunks").groupBy(F.col("id").alias("chunk")).agg(F.max("content").alias("content"))
    return retrieval.chunks_of_ranked(r, m, c).select("id", "chunk", F.round("score", 6).alias("score"), F.length("content").alias("size"))


@query("SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 2), ('d', 0), ('e', 3)) t(id, turn)")
def ordered_subqueries(spark, sf):
    parts = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    on = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("e", "c"), ("e", "d")], "id string, on string")
    return retrieval.in_order(parts, on)


@query("""SELECT * FROM (VALUES (1, 0, 'What is A'), (1, 1, 'how does it relate to B'), (2, 0, 'Find the archive'), (2, 1, 'list its letters'), (3, 0, 'one question')) t(question, part, text)""")
def decomposed_questions(spark, sf):
    asked = ("What is A and how does it relate to B?", "Find the archive, and then list its letters", "one question")
    rows = [(i, k, part) for i, q in enumerate(asked, 1) for k, part in enumerate(questions.decompose(q))]
    return spark.createDataFrame(rows, "question int, part int, text string")


@query("SELECT * FROM (VALUES ('  Old HARBOUR map ', 'old ancient harbour port haven map')) t(query, rewritten)")
def rewritten_queries(spark, sf):
    q = "  Old HARBOUR map "
    return spark.createDataFrame([(q, questions.rewrite(q, {"old": ["ancient"], "harbour": ["port", "haven"]}))], "query string, rewritten string")


@query("""SELECT * FROM (VALUES (1, '{"a": 1}'), (2, '{"b": {"c": 2}}'), (3, NULL), (4, '[1, 2]')) t(id, json)""")
def json_in_text(spark, sf):
    rows = [(1, 'Sure:\n```json\n{"a": 1}\n```\nDone.'), (2, 'It is {"b": {"c": 2}} I think'), (3, "no braces"), (4, "```\n[1, 2]\n```")]
    return spark.createDataFrame(rows, "id int, t string").select("id", text.json_in_markdown("t").alias("json"))


@query("SELECT source, target, relation_type FROM extracted_relationships WHERE regexp_matches(relation_type, '(?i)caused|led_to|resulted_in|enabled|triggered') GROUP BY ALL")
def causal_relations(spark, sf):
    r = table(spark, sf, "extracted_relationships").select("source", "target", "relation_type").distinct()
    return r.where(measures.is_causal(F.lit(None).cast("string"), F.lit(None).cast("double"), "relation_type"))


@query(f"""WITH {_E}, u AS (SELECT source AS a, target AS b FROM e UNION ALL SELECT target, source FROM e), d AS (SELECT a AS node, count(*) AS k FROM u GROUP BY 1), n AS (SELECT count(*) AS n FROM d),
one AS (SELECT a AS node, count(DISTINCT b) AS near FROM u GROUP BY 1), two AS (SELECT x.a AS node, count(DISTINCT y.b) AS far FROM u x JOIN u y ON x.b = y.a WHERE y.b <> x.a GROUP BY 1)
SELECT d.node, round(k / (n - 1), 6) AS centrality, near, coalesce(far, 0) AS far FROM n, d JOIN one USING (node) LEFT JOIN two USING (node)""")
def centrality_bundle(spark, sf):
    e = star(spark, sf)
    both = graph.oriented(e.select("source", "target")).distinct()
    near = both.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("near"))
    far = both.join(both.select(F.col("source").alias("target"), F.col("target").alias("next")), "target").where("next != source").groupBy(F.col("source").alias("node")).agg(F.count_distinct("next").alias("far"))
    return graph.degrees(e).select("node", F.round("centrality", 6).alias("centrality")).join(near, "node").join(far, "node", "left").fillna(0, ["far"])


@query("""SELECT 'valid' AS outcome, count(*) AS n FROM extracted_entities WHERE trim(coalesce(id, '')) <> '' AND trim(coalesce(name, '')) <> '' AND trim(coalesce(entity_type, '')) <> ''
UNION ALL SELECT 'rejected', count(*) FROM extracted_entities WHERE NOT (trim(coalesce(id, '')) <> '' AND trim(coalesce(name, '')) <> '' AND trim(coalesce(entity_type, '')) <> '')""")
def stream_import(spark, sf):
    """All entity files as a stream, validated batch by batch into a table of valid rows and one of rejects."""
    path = new_path(spark, "import")
    source = spark.readStream.schema(table(spark, sf, "extracted_entities").schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/extracted_entities.parque[t]")

    def sink(batch, number):
        out = validate(batch.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), "entity_type"))
        out.entities.write.mode("overwrite").parquet(f"{path}/valid/{number}")
        out.rejects.write.mode("overwrite").parquet(f"{path}/rejected/{number}")

    changes.run_available(source, sink, f"{path}/checkpoint")
    each = [spark.read.parquet(f"{path}/{k}/*").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("outcome"), "n") for k in ("valid", "rejected")]
    return each[0].unionByName(each[1])
