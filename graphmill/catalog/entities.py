"""Entities, mentions, relations and concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.catalog.graph import rank_steps
from graphmill.operators import entities
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


def mentions(spark, sf):
    """Mentions with a key, each id once."""
    e = table(spark, sf, "extracted_entities").where("entity_key is not null").dropDuplicates(["id"])
    return e.select("id", F.col("chunk_id").alias("chunk"), F.col("entity_key").alias("entity_id"), "name", "entity_type", F.col("confidence").cast("double").alias("confidence"), F.regexp_replace("chunk_id", "_[0-9]+$", "").alias("document"))


_MENTION = "m AS (SELECT DISTINCT ON (id) id, chunk_id, entity_key, name, entity_type, confidence::DOUBLE AS confidence, regexp_replace(chunk_id, '_[0-9]+$', '') AS document FROM extracted_entities WHERE entity_key IS NOT NULL ORDER BY id, extracted_at)"


@query("SELECT DISTINCT chunk_id, entity_key FROM extracted_entities WHERE chunk_id IS NOT NULL AND entity_key IS NOT NULL")
def mention_index(spark, sf):
    return table(spark, sf, "extracted_entities").where("chunk_id is not null and entity_key is not null").select("chunk_id", "entity_key").distinct()


@query("SELECT entity_key, count(DISTINCT chunk_id) AS chunks FROM extracted_entities WHERE entity_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT chunk_id) >= 5")
def common_entities(spark, sf):
    return table(spark, sf, "extracted_entities").where("entity_key is not null").groupBy("entity_key").agg(F.count_distinct("chunk_id").alias("chunks")).where("chunks >= 5")


@query("SELECT chunk_id, count(DISTINCT entity_key) AS entities FROM extracted_entities WHERE chunk_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT entity_key) >= 4")
def dense_chunks(spark, sf):
    return table(spark, sf, "extracted_entities").where("chunk_id is not null").groupBy("chunk_id").agg(F.count_distinct("entity_key").alias("entities")).where("entities >= 4")


@query("""WITH m AS (SELECT DISTINCT chunk_id, entity_key FROM extracted_entities WHERE chunk_id IS NOT NULL AND entity_key IS NOT NULL), d AS (SELECT entity_key, count(*) AS d FROM m GROUP BY 1),
p AS (SELECT x.entity_key AS a, y.entity_key AS b, count(*) AS n FROM m x JOIN m y ON x.chunk_id = y.chunk_id AND x.entity_key < y.entity_key GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a, b, n, round(n / (da.d + db.d - n), 6) AS jaccard FROM p JOIN d da ON da.entity_key = a JOIN d db ON db.entity_key = b""")
def cooccurrence(spark, sf):
    return entities.cooccurrence(table(spark, sf, "extracted_entities"), "entity_key", "chunk_id", 2).withColumn("jaccard", F.round("jaccard", 6))


@query("""WITH e AS (SELECT lower(name) AS n, entity_type, confidence::DOUBLE AS c, chunk_id FROM (SELECT DISTINCT * FROM extracted_entities) WHERE name IS NOT NULL AND entity_type IS NOT NULL)
SELECT n AS lower_name, entity_type, round(max(c), 6) AS confidence, count(DISTINCT chunk_id) AS chunks FROM e GROUP BY 1, 2""")
def entity_merge(spark, sf):
    m = table(spark, sf, "extracted_entities").where("name is not null and entity_type is not null").select(F.col("chunk_id").alias("chunk"), "name", "entity_type", F.col("confidence").cast("double").alias("confidence"))
    out = entities.merge_entities(m, [F.lower("name"), F.col("entity_type")])
    return out.select(F.lower("name").alias("lower_name"), "entity_type", F.round("confidence", 6).alias("confidence"), "chunks")


@query()
def extracted_mentions(spark, sf):
    return entities.extract_entities(table(spark, sf, "documents"), "doc_id", "text", 0.65)


def _told(rule) -> str:
    has = lambda words: " OR ".join(f"contains(content, '{w}')" for w in words)
    return "CASE " + " ".join(f"WHEN {has(words)} THEN '{name}'" for words, name in rule[:-1]) + f" ELSE '{rule[-1]}' END"


_KIND = "CASE " + " ".join(f"WHEN (s = '{x}' AND t = '{y}') OR (s = '{y}' AND t = '{x}') THEN {_told(rule)}" for (x, y), rule in entities.RELATION_RULES.items()) + " ELSE 'RELATED_TO' END"


@query(f"""WITH m AS (SELECT chunk_id, entity_key, min(entity_type) AS t FROM extracted_entities WHERE chunk_id IS NOT NULL AND entity_key IS NOT NULL GROUP BY 1, 2), c AS (SELECT id, max(content) AS content FROM text_chunks GROUP BY 1),
p AS (SELECT x.chunk_id, x.entity_key AS source, y.entity_key AS target, x.t AS s, y.t AS t FROM m x JOIN m y ON x.chunk_id = y.chunk_id AND x.entity_key < y.entity_key), k AS (SELECT source, target, {_KIND} AS relation_type FROM p LEFT JOIN c ON c.id = chunk_id)
SELECT source, target, relation_type, count(*) AS chunks, 0.5 AS confidence FROM k GROUP BY 1, 2, 3""")
def extracted_relations(spark, sf):
    c = table(spark, sf, "text_chunks").groupBy(F.col("id").alias("chunk")).agg(F.max("content").alias("content"))
    m = table(spark, sf, "extracted_entities").where("chunk_id is not null and entity_key is not null").select(F.col("chunk_id").alias("chunk"), F.col("entity_key").alias("entity_id"), "entity_type")
    return entities.relations_in_chunks(m, c)


@query()
def related_mentions(spark, sf):
    """Relations between the phrases found in the documents themselves."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), F.col("text").alias("content"))
    return entities.relations_in_chunks(entities.extract_entities(d, "chunk", "content", 0.65), d.where("content is not null"))


@query()
def rule_entities(spark, sf):
    rules = [("YEAR", r"\b1[5-9]\d\d\b|\b20\d\d\b", 0.9), ("IDENTIFIER", r"\b[a-z]+(?:_[a-z0-9]+)+\b", 0.85), ("NUMBER", r"\b\d+\b", 0.5)]
    return entities.rule_entities(table(spark, sf, "documents"), "doc_id", "text", rules)


@query()
def inferred_relations(spark, sf):
    m = entities.extract_entities(table(spark, sf, "graph_documents").dropDuplicates(["id"]), "id", "content").withColumnRenamed("id", "chunk")
    hot = m.groupBy("entity_id").count().orderBy(F.desc("count"), "entity_id").first()
    return entities.inferred_relations(m, hot[0] if hot else "", 0.0)


@query("""WITH RECURSIVE s AS (SELECT 'S' || s_suppkey AS id, s_name AS name, trim(regexp_replace(regexp_replace(lower(s_name), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS k FROM supplier),
p AS (SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.id <> y.id AND greatest(CASE WHEN levenshtein(x.k, y.k) > 2 THEN 0 ELSE 1 - levenshtein(x.k, y.k) / greatest(strlen(x.k), strlen(y.k)) END, jaro_winkler_similarity(x.k, y.k)) >= 0.97),
r AS (SELECT id AS node, id AS c FROM s UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.node), g AS (SELECT node AS id, min(c) AS cluster FROM r GROUP BY 1),
b AS (SELECT cluster, arg_max(s.id, (length(name), s.id)) AS canonical FROM g JOIN s ON s.id = g.id GROUP BY 1) SELECT g.id, cluster, canonical FROM g JOIN b USING (cluster)""")
def linked_entities(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("entity_type"), F.lit(0.9).alias("confidence"))
    return entities.linked_clusters(s, 0.97)


@query("""WITH m AS (SELECT DISTINCT regexp_replace(chunk_id, '_[0-9]+$', '') AS document, entity_key FROM extracted_entities WHERE chunk_id IS NOT NULL AND entity_key IS NOT NULL)
SELECT x.entity_key AS a, y.entity_key AS b, count(*) AS documents, round(least(0.7 + 0.1 * (count(*) - 1), 1.0), 6) AS confidence FROM m x JOIN m y ON x.document = y.document AND x.entity_key < y.entity_key GROUP BY 1, 2""")
def document_relations(spark, sf):
    m = mentions(spark, sf).select(F.col("entity_id").alias("cluster"), "document").distinct()
    return entities.across_documents(m).withColumn("confidence", F.round("confidence", 6))


@query("""WITH m AS (SELECT DISTINCT id, entity_key, regexp_replace(chunk_id, '_[0-9]+$', '') AS document FROM extracted_entities WHERE entity_key IS NOT NULL),
g AS (SELECT entity_key AS cluster, count(DISTINCT document) AS documents, count(DISTINCT id) AS mentions FROM m GROUP BY 1)
SELECT cluster, documents, mentions, round((0.4 * (ln(documents) + 1) + 0.3 * (ln(mentions) + 1) + 0.3 * documents) / 3, 6) AS importance FROM g WHERE documents > 0""")
def entity_importance(spark, sf):
    m = mentions(spark, sf).select(F.col("entity_id").alias("cluster"), "document")
    return entities.importance(m).where("documents > 0").withColumn("importance", F.round("importance", 6))


@query()
def text_concepts(spark, sf):
    return entities.concepts(table(spark, sf, "documents"), "doc_id", "text")


def _concept_graph(spark, sf):
    each = table(spark, sf, "text_chunks").select("id", F.explode("keywords").alias("k")).where("k is not null and trim(k) != ''").select("id", F.lower(F.trim("k")).alias("concept")).distinct()
    return each, entities.cooccurrence(each, "concept", "id", 2)


@query("""WITH c AS (SELECT DISTINCT id, lower(trim(k)) AS concept FROM (SELECT id, unnest(keywords) AS k FROM text_chunks) WHERE k IS NOT NULL AND trim(k) <> ''), d AS (SELECT concept, count(*) AS d FROM c GROUP BY 1),
p AS (SELECT x.concept AS a, y.concept AS b, count(*) AS n FROM c x JOIN c y ON x.id = y.id AND x.concept < y.concept GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a, b, n, round(n / (da.d + db.d - n), 6) AS jaccard FROM p JOIN d da ON da.concept = a JOIN d db ON db.concept = b""")
def concept_edges(spark, sf):
    return _concept_graph(spark, sf)[1].withColumn("jaccard", F.round("jaccard", 6))


_CONCEPTS = """c AS (SELECT DISTINCT id, lower(trim(k)) AS concept FROM (SELECT id, unnest(keywords) AS k FROM text_chunks) WHERE k IS NOT NULL AND trim(k) <> ''), d AS (SELECT concept, count(*) AS d FROM c GROUP BY 1),
pr AS (SELECT x.concept AS a, y.concept AS b, count(*) AS n FROM c x JOIN c y ON x.id = y.id AND x.concept < y.concept GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query(f"""WITH {_CONCEPTS}, e AS (SELECT a AS source, b AS target, n AS weight FROM pr UNION ALL SELECT b, a, n FROM pr), {rank_steps(5, "1.0::DOUBLE / (SELECT count(*) FROM a)")},
k AS (SELECT source, count(*) AS links FROM e GROUP BY 1), x AS (SELECT concept, d, coalesce(links, 0) / ((SELECT count(*) FROM d) - 1) AS degree, coalesce(s / (SELECT max(s) FROM r5), 0) AS rank, tanh(ln((SELECT count(DISTINCT id) FROM c) / d) / 5) AS rarity FROM d LEFT JOIN k ON k.source = concept LEFT JOIN r5 ON r5.n = concept)
SELECT concept, round(0.4 * degree + 0.4 * rank + 0.2 * rarity, 6) AS score, round(degree, 6) AS degree, round(rank, 6) AS rank, round(rarity, 6) AS rarity, d AS df FROM x WHERE 0.4 * degree + 0.4 * rank + 0.2 * rarity >= 0.1""")
def concept_ranking(spark, sf):
    r = entities.ranked_concepts(*_concept_graph(spark, sf), least=0.1, iterations=5)
    return r.select("concept", *[F.round(c, 6).alias(c) for c in ("score", "degree", "rank", "rarity")], "df")


def _rings(n: int) -> str:
    found, steps = "f0", ["f0 AS (SELECT 'record' AS concept, 0 AS depth UNION ALL SELECT 'chapter', 0)"]
    for i in range(1, n):
        steps.append(f"g{i} AS (SELECT l.other AS concept, {i} AS depth FROM f{i - 1} f JOIN l ON l.concept = f.concept AND f.depth = {i - 1} WHERE l.other NOT IN (SELECT concept FROM f{i - 1}) GROUP BY 1 ORDER BY sum(l.n) DESC, 1 LIMIT 5), f{i} AS (SELECT * FROM f{i - 1} UNION ALL SELECT * FROM g{i})")
    return ", ".join(steps)


@query(f"""WITH {_CONCEPTS}, l AS (SELECT a AS concept, b AS other, n FROM pr UNION ALL SELECT b, a, n FROM pr), {_rings(3)}, h AS (SELECT id, count(*) AS f, count(*) FILTER (depth = 1) AS l FROM c JOIN f2 ON f2.concept = c.concept GROUP BY 1)
SELECT id, round((ln(f) + 1) * (1 + 0.5 * l), 6) AS score FROM h ORDER BY (ln(f) + 1) * (1 + 0.5 * l) DESC, id LIMIT 50""")
def concept_search(spark, sf):
    return entities.deepening_search(*_concept_graph(spark, sf), start=["record", "chapter"]).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- inference


@query()
def cue_relations(spark, sf):
    from graphmill.operators import inference

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), F.col("text").alias("content"))
    m = entities.extract_entities(d, "chunk", "content", 0.65)
    return inference.relations_by_cues(m, d)


def _relations(spark, sf):
    r = table(spark, sf, "extracted_relationships").where("source is not null and target is not null and relation_type is not null")
    some = r.groupBy("source", "target", "relation_type").agg(F.min(F.unix_timestamp("extracted_at")).alias("start_time"), F.max(F.unix_timestamp("extracted_at")).alias("end_time"))
    return some.withColumn("rel_id", F.concat_ws("_", "source", "target", "relation_type"))


@query()
def relation_hierarchy(spark, sf):
    from graphmill.operators import inference

    return inference.relation_clusters(_relations(spark, sf)).select("level", "rel_id", "cluster", "size", "cohesion")


_W = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> ''))"


@query(f"""WITH {_CONCEPTS}, q AS (SELECT doc_id AS query_id, unnest({_W.format('title')}) AS w FROM documents WHERE title IS NOT NULL), k AS (SELECT concept, {_W.format('concept')} AS ws FROM d),
x AS (SELECT query_id, concept, count(*) / len(ws) AS score, 'exact' AS how FROM q JOIN k ON list_contains(ws, w) GROUP BY query_id, concept, ws),
z AS (SELECT query_id, concept, 1 - levenshtein(w, ws[1]) / greatest(strlen(w), strlen(ws[1])) AS score, 'fuzzy' AS how FROM q JOIN k ON len(ws) = 1 AND left(w, 1) = left(ws[1], 1) AND abs(length(w) - length(ws[1])) <= 2 AND w <> ws[1] WHERE length(w) > 3),
u AS (SELECT * FROM x WHERE score >= 0.7 UNION ALL SELECT * FROM z WHERE score >= 0.7) SELECT query_id, concept, round(max(score), 6) AS score, arg_max(how, (score, how)) AS how FROM u GROUP BY 1, 2""")
def concept_matching(spark, sf):
    from graphmill.operators import inference

    q = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query")).where("query is not null")
    return inference.concept_matches(q, _concept_graph(spark, sf)[0]).withColumn("score", F.round("score", 6))


@query()
def query_anchors(spark, sf):
    from graphmill.operators import inference

    e = table(spark, sf, "extracted_entities").where("name is not null").select(F.col("name").alias("id"), "name").distinct()
    r = table(spark, sf, "extracted_relationships").where("source is not null and target is not null")
    q = spark.createDataFrame([("q1", "society of machine reading"), ("q2", "karin henry")], "query_id string, query string")
    return inference.anchors(q, e, r, 5)
