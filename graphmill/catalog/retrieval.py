"""Structure filters, paths, fuzzy matching, communities, linking and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.catalog.graph import _E, star
from graphmill.operators import entities, graph, retrieval
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


def _chunks(spark, sf):
    return table(spark, sf, "text_chunks").groupBy("id").agg(F.max("chapter").alias("chapter"), F.max("content").alias("content"))


_CHUNK = "c AS (SELECT id, max(chapter) AS chapter, max(content) AS content FROM text_chunks GROUP BY 1)"


@query(f"""WITH {_CHUNK}, q AS (SELECT * FROM (VALUES ('q1', 'what happens in Part 1 of the book', 'part 1'), ('q2', 'the harbour', NULL)) t(query_id, query, ref))
SELECT query_id, id FROM c, q WHERE ref IS NULL OR contains(lower(chapter), ref)""")
def structure_filter(spark, sf):
    q = spark.createDataFrame([("q1", "what happens in Part 1 of the book"), ("q2", "the harbour")], "query_id string, query string")
    c = _chunks(spark, sf)
    results = c.select("id").crossJoin(F.broadcast(q.select("query_id"))).withColumn("score", F.lit(0.5))
    return retrieval.structure_filter(results, q, c).select("query_id", "id")


@query(f"WITH {_CHUNK} SELECT id, chapter FROM c WHERE contains(lower(chapter), 'and')")
def chapter_chunks(spark, sf):
    return retrieval.chunks_of(_chunks(spark, sf), "AND").select("id", "chapter")


def _named(spark, sf):
    """Nodes of the star with the names they have in the tables."""
    n, s, r = table(spark, sf, "nation"), table(spark, sf, "supplier"), table(spark, sf, "region")
    one = lambda df, a, k, name, kind: df.select(F.concat(F.lit(a), F.col(k).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("entity_type"))
    return one(n, "N", "n_nationkey", "n_name", "NATION").unionByName(one(s, "S", "s_suppkey", "s_name", "SUPPLIER")).unionByName(one(r, "R", "r_regionkey", "r_name", "REGION"))


_NAMED = "named AS (SELECT 'N' || n_nationkey AS id, n_name AS name, 'NATION' AS entity_type FROM nation UNION ALL SELECT 'S' || s_suppkey, s_name, 'SUPPLIER' FROM supplier UNION ALL SELECT 'R' || r_regionkey, r_name, 'REGION' FROM region)"


@query(f"""WITH {_E}, {_NAMED}, p AS (SELECT x.id AS a, x.name AS an, y.id AS b, y.name AS bn FROM named x, named y WHERE x.entity_type <> 'REGION' AND y.entity_type = 'REGION'),
d AS (SELECT a || '>' || b AS query_id, 'path_' || a || '_' || b AS id, 0.8 AS score FROM p JOIN e ON source = a AND target = b),
i AS (SELECT a || '>' || b AS query_id, 'path_' || a || '_' || e.target || '_' || b AS id, 0.6 * e.weight * f.weight AS score FROM p JOIN (SELECT * FROM e UNION ALL SELECT target, source, relation_type, weight FROM e) e ON e.source = a JOIN (SELECT * FROM e UNION ALL SELECT target, source, relation_type, weight FROM e) f ON f.source = b AND f.target = e.target)
SELECT query_id, id, round(score, 6) AS score FROM d UNION ALL SELECT query_id, id, round(score, 6) FROM i""")
def entity_paths(spark, sf):
    """From every nation and supplier to every region, edges taken both ways for common neighbours."""
    n, e = _named(spark, sf), star(spark, sf)
    a = n.where("entity_type != 'REGION'").select(F.col("id").alias("a"), F.col("name").alias("first"))
    b = F.broadcast(n.where("entity_type = 'REGION'").select(F.col("id").alias("b"), F.col("name").alias("second")))  # five regions
    pairs = a.crossJoin(b).select(F.concat_ws(">", "a", "b").alias("query_id"), "first", "second")
    return retrieval.entity_paths(pairs, n, graph.oriented(e.select("source", "target", "confidence"))).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {_E}, {_NAMED}, o AS (SELECT source AS id, count(*) AS o FROM e GROUP BY 1), s AS (SELECT entity_type AS query_id, named.id, length(name) / 100.0 + 0.1 * coalesce(o, 0) AS score FROM named LEFT JOIN o ON o.id = named.id)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3""")
def central_entities(spark, sf):
    sim = _named(spark, sf).select(F.col("entity_type").alias("query_id"), "id", (F.length("name") / 100.0).alias("score"))
    return retrieval.central_entities(sim, star(spark, sf), 3).withColumn("score", F.round("score", 6))


_Q = (("f1", "Middle East"), ("f2", "nation of Germany"), ("f3", "saudi  arabia"))
_QV = "q AS (SELECT query_id, query, list_filter(string_split_regex(lower(query), '\\s+'), lambda w: w <> '') AS words FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _Q) + ") t(query_id, query))"
_W = "list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> '')"
_LIKE = f"""(0.4 * len(list_intersect(list_distinct({_W.format('a')}), list_distinct({_W.format('b')}))) / greatest(len(list_distinct(list_concat({_W.format('a')}, {_W.format('b')}))), 1)
+ 0.4 * len(list_intersect(list_distinct({_W.format('a')}), list_distinct({_W.format('b')}))) / greatest(least(len(list_distinct({_W.format('a')})), len(list_distinct({_W.format('b')}))), 1)
+ 0.2 * (1 - levenshtein(lower(a), lower(b)) / greatest(strlen(lower(a)), strlen(lower(b)), 1)))"""


@query(f"""WITH {_E}, {_NAMED}, {_QV}, en AS (SELECT query_id, words, query AS a, name AS b, id, entity_type FROM named, q), x AS (SELECT *, {_LIKE} AS s FROM en),
f AS (SELECT query_id, id, CASE WHEN lower(a) = lower(b) THEN 1.0 ELSE s * 0.9 END AS score, CASE WHEN lower(a) = lower(b) THEN 'ExactEntity' ELSE 'PartialEntity' END AS match FROM x WHERE lower(a) = lower(b) OR s >= 0.6),
t AS (SELECT query_id, 'type_' || id AS id, 0.7 * len(list_filter(words, lambda w: w = lower(entity_type))) / len(words) AS score, 'SemanticEntity' AS match FROM x WHERE lower(a) <> lower(b) AND list_contains(words, lower(entity_type))),
ck AS (SELECT query_id, words, query AS a, title AS b, CAST(doc_id AS VARCHAR) AS id FROM documents, q WHERE title IS NOT NULL), cs AS (SELECT *, {_LIKE} AS s, len(list_filter(words, lambda w: list_contains({_W.format('b')}, w))) / len(words) AS h FROM ck),
n AS (SELECT query_id, f.id AS source, e.target, e.weight, row_number() OVER (PARTITION BY query_id, f.id ORDER BY e.weight DESC, e.target) AS r FROM f JOIN e ON e.source = f.id),
al AS (SELECT * FROM f UNION ALL SELECT * FROM t UNION ALL SELECT query_id, id, s, 'ChunkContent' FROM cs WHERE s >= 0.6 UNION ALL SELECT query_id, 'keywords_' || id, h, 'ChunkContent' FROM cs WHERE h >= 0.48
UNION ALL SELECT query_id, 'expanded_' || target, max(weight) * 0.6, 'RelatedConcept' FROM n WHERE r <= 5 AND weight * 0.6 >= 0.42 GROUP BY 1, 2)
SELECT query_id, id, round(score, 6) AS score, match, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM al) WHERE rank <= 10""")
def fuzzy_matches(spark, sf):
    q = spark.createDataFrame(list(_Q), "query_id string, query string")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("title").alias("content"))
    return retrieval.fuzzy_matches(q, _named(spark, sf), d, star(spark, sf)).withColumn("score", F.round("score", 6))


@query("""SELECT 0 AS level, 'R' || n_regionkey AS community, 'Entities: ' || string_agg(n_name, ', ' ORDER BY n_name) AS summary FROM nation
WHERE n_regionkey IN (SELECT n_regionkey FROM nation WHERE contains(lower(n_name), 'ation_1')) GROUP BY n_regionkey""")
def community_retrieval(spark, sf):
    n = table(spark, sf, "nation")
    label = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("community"))
    return retrieval.communities_about("ATION_1", label, _named(spark, sf))


_DUAL = (("d1", "letter archive"), ("d2", "private harbour policy of the guild"), ("d3", "of it"))


@query("SELECT * FROM (VALUES ('d1', 'letter archive'), ('d2', 'private harbour policy guild'), ('d3', '')) t(query_id, low)")
def two_level_keywords(spark, sf):
    q = spark.createDataFrame(list(_DUAL), "query_id string, query string")
    return retrieval.two_level_keywords(q).select("query_id", F.array_join("low", " ").alias("low"))


def _holding(df, id_col, text_col):
    """An index that scores the share of a query's words that a text holds as part of it."""

    def search(asked):
        from graphmill.functions.text import split_words

        words = split_words(F.lower("query"))
        both = df.select(F.col(id_col).alias("id"), F.lower(text_col).alias("t")).crossJoin(F.broadcast(asked.select("query_id", words.alias("w"))))  # a few queries
        return both.select("query_id", "id", (F.size(F.filter("w", lambda x: F.contains("t", x))) / F.size("w")).alias("score")).where("score > 0")

    return search


def _topics(prompts):
    """A model's stand-in: the last word is the topic, the others are particulars."""
    import json

    return [json.dumps({"high_level": p.split()[-1:], "low_level": p.split()[:-1]}) for p in prompts]


@query("""WITH k AS (SELECT * FROM (VALUES ('d1', ['archive'], ['letter']), ('d2', ['guild'], ['private', 'harbour', 'policy', 'of', 'the']), ('d3', ['it'], ['of'])) t(query_id, high, low)),
h AS (SELECT query_id, doc_id AS id, len(list_filter(high, lambda w: contains(lower(title), w))) / len(high) AS s FROM documents, k), l AS (SELECT query_id, doc_id AS id, len(list_filter(low, lambda w: contains(lower(text), w))) / len(low) AS s FROM documents, k),
u AS (SELECT query_id, id, 2 * r AS key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM h WHERE s > 0) WHERE r <= 10
UNION ALL SELECT query_id, id, 2 * r + 1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM l WHERE s > 0) WHERE r <= 10),
b AS (SELECT query_id, id, min(key) AS key FROM u GROUP BY 1, 2) SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key, id) AS rank FROM b) WHERE rank <= 10""")
def dual_retrieval(spark, sf):
    q = spark.createDataFrame(list(_DUAL), "query_id string, query string")
    d = table(spark, sf, "documents")
    keys = retrieval.two_level_keywords(q, _topics)
    return retrieval.two_level_search(keys, _holding(d, "doc_id", "title"), _holding(d, "doc_id", "text")).select("query_id", "id", "rank")


@query("SELECT doc_id AS id, 0.85 AS score FROM documents WHERE contains(lower(text), 'harbour')")
def memory_search(spark, sf):
    return retrieval.memory_search(table(spark, sf, "documents"), "Harbour", "doc_id", "text")


@query("""SELECT query_id, id, score, rank FROM (SELECT 'r' AS query_id, doc_id AS id, length(title) / 100.0 AS score, row_number() OVER (ORDER BY length(title) DESC, doc_id) AS rank FROM documents WHERE length(title) >= 20) WHERE rank <= 10""")
def reranked(spark, sf):
    d = table(spark, sf, "documents").where("title is not null")
    return retrieval.reranked(d.select(F.lit("r").alias("query_id"), F.col("doc_id").alias("id"), (F.length("title") / 100.0).alias("score")), 10, 0.2)


# ---------------------------------------------------------------- linking, merging, facts

_MEM = "m AS (SELECT DISTINCT ON (id) id, entity_key, name, entity_type, confidence::DOUBLE AS confidence FROM extracted_entities WHERE entity_key IS NOT NULL ORDER BY id, extracted_at)"


@query("""WITH m AS (SELECT entity_key AS group_id, name AS id, name, min(entity_type) AS entity_type, max(confidence::DOUBLE) AS confidence FROM extracted_entities WHERE entity_key IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2, 3),
w AS (SELECT *, lower(name) AS l, list_distinct(list_filter(string_split_regex(lower(name), '\\s+'), lambda x: x <> '')) AS ws FROM m),
p AS (SELECT x.group_id, avg(CASE WHEN x.l = y.l THEN 1.0 WHEN contains(x.l, y.l) OR contains(y.l, x.l) THEN 0.9 ELSE len(list_intersect(x.ws, y.ws)) / greatest(len(list_distinct(list_concat(x.ws, y.ws))), 1) END) AS k FROM w x JOIN w y ON x.group_id = y.group_id AND x.id < y.id GROUP BY 1),
g AS (SELECT group_id, count(*) AS members, count(DISTINCT coalesce(entity_type, '')) AS types, arg_max(name, (strlen(name), coalesce(confidence, 0), name)) AS name FROM m GROUP BY 1)
SELECT g.group_id, members, members > 1 AND types = 1 AND coalesce(k, 0) > 0.8 AS merge, round(CASE WHEN members > 1 AND types = 1 AND coalesce(k, 0) > 0.8 THEN k WHEN members < 2 OR types > 1 THEN 1 ELSE 1 - k END, 6) AS confidence,
CASE WHEN members > 1 AND types = 1 AND coalesce(k, 0) > 0.8 THEN name END AS name FROM g LEFT JOIN p ON p.group_id = g.group_id""")
def merge_decisions(spark, sf):
    """Spellings of one key as a group."""
    e = table(spark, sf, "extracted_entities").where("entity_key is not null and name is not null")
    m = e.groupBy(F.col("entity_key").alias("group_id"), "name").agg(F.min("entity_type").alias("entity_type"), F.max(F.col("confidence").cast("double")).alias("confidence"))
    return entities.merge_decisions(m.withColumn("id", F.col("name"))).withColumn("confidence", F.round("confidence", 6))


@query("""WITH e AS (SELECT DISTINCT name, entity_key FROM extracted_entities WHERE name IS NOT NULL AND entity_key IS NOT NULL), c AS (SELECT name, min(entity_key) AS cluster FROM e WHERE entity_key LIKE 'P%' GROUP BY 1),
n AS (SELECT DISTINCT name AS id, name FROM e), o AS (SELECT name, min(id) AS f FROM n GROUP BY 1)
SELECT n.id, coalesce(c.cluster, 'new_' || o.f) AS cluster, c.cluster IS NOT NULL AS known FROM n LEFT JOIN c ON c.name = n.name LEFT JOIN o ON o.name = n.name""")
def link_new_entities(spark, sf):
    e = table(spark, sf, "extracted_entities").where("name is not null and entity_key is not null").select("name", F.col("entity_key").alias("cluster")).distinct()
    return entities.link_new(e.select(F.col("name").alias("id"), "name").distinct(), e.where("cluster like 'P%'"))


@query("""WITH e AS (SELECT DISTINCT name AS id, lower(name) AS k, coalesce(entity_type, '') AS t FROM (SELECT name, min(entity_type) AS entity_type FROM extracted_entities WHERE name IS NOT NULL AND entity_type IS NOT NULL GROUP BY 1))
SELECT id, min(id) OVER (PARTITION BY k, t) AS cluster FROM e""")
def exactly_linked(spark, sf):
    e = table(spark, sf, "extracted_entities").where("name is not null and entity_type is not null").groupBy("name").agg(F.min("entity_type").alias("entity_type"))
    return entities.linked(e.withColumn("id", F.col("name")), "exact")


@query(f"WITH {_MEM} SELECT id FROM m WHERE confidence >= 0.3 AND strlen(name) >= 2 AND regexp_matches(name, '\\S')")
def entities_fit_for_use(spark, sf):
    e = table(spark, sf, "extracted_entities").where("entity_key is not null").select("id", "name", F.col("confidence").cast("double").alias("confidence")).dropDuplicates(["id"])
    return entities.fit_for_use(e).select("id")


_FACTS = """f AS (SELECT source AS subject, relation_type AS predicate, target AS object, 'in ' || year(extracted_at) AS marker, confidence::DOUBLE AS confidence, chunk_id AS chunk FROM (SELECT DISTINCT * FROM extracted_relationships) WHERE source IS NOT NULL AND target IS NOT NULL AND relation_type IS NOT NULL),
t AS (SELECT *, (CAST(regexp_extract(marker, '([0-9]{1,4})', 1) AS BIGINT) - 1970) * 365 * 86400 AS moment FROM f)"""
_KEY = "regexp_replace(replace(lower(trim({})), ' ', '_'), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def _facts(spark, sf):
    r = table(spark, sf, "extracted_relationships").distinct()
    return r.select(F.col("chunk_id").alias("chunk"), F.col("source").alias("subject"), F.col("relation_type").alias("predicate"), F.col("target").alias("object"), F.concat(F.lit("in "), F.year("extracted_at").cast("string")).alias("temporal_marker"), F.col("confidence").cast("double").alias("confidence"))


@query(f"""WITH {_FACTS}, n AS (SELECT subject AS name, confidence, moment FROM t UNION ALL SELECT object, confidence, moment FROM t), g AS (SELECT {_KEY.format('name')} AS id, min(name) AS name, max(confidence) AS confidence, min(moment) AS first_mentioned, max(moment) AS last_mentioned FROM n GROUP BY 1)
SELECT id, name, CASE WHEN regexp_matches(name, '^\\p{{Lu}}') THEN CASE WHEN regexp_matches(lower(name), '(ia|land|istan)$') THEN 'LOCATION' ELSE 'PERSON' END WHEN regexp_matches(name, '[0-9]') THEN 'DATE' ELSE 'CONCEPT' END AS entity_type,
round(confidence, 6) AS confidence, first_mentioned, last_mentioned FROM g""")
def fact_entities(spark, sf):
    return entities.facts_to_graph(_facts(spark, sf))[0].withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {_FACTS}, r AS (SELECT {_KEY.format('subject')} AS source, {_KEY.format('object')} AS target, upper(predicate) AS relation_type, lower(predicate) AS p, confidence, moment FROM t)
SELECT relation_type, count(*) AS n, min(moment) AS first_time, count(*) FILTER (moment IS NOT NULL AND (contains(p, 'caused') OR contains(p, 'led to'))) AS caused, count(*) FILTER (source = target) AS loops FROM r GROUP BY 1""")
def fact_relations(spark, sf):
    r = entities.facts_to_graph(_facts(spark, sf))[1]
    return r.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"), F.min("start_time").alias("first_time"), F.count_if(F.col("temporal_type") == "Caused").alias("caused"), F.count_if(F.col("source") == F.col("target")).alias("loops"))


@query(f"""WITH {_CHUNK}, t AS (SELECT DISTINCT source, relation_type, target, chunk_id FROM extracted_relationships)
SELECT CASE WHEN source IS NULL OR target IS NULL THEN 'no end' WHEN NOT contains(lower(coalesce(content, '')), lower(source)) THEN 'source not in text' WHEN NOT contains(lower(coalesce(content, '')), lower(target)) THEN 'target not in text' ELSE 'fine' END AS reason, count(*) AS n
FROM t LEFT JOIN c ON c.id = chunk_id GROUP BY 1""")
def validated_triples(spark, sf):
    t = table(spark, sf, "extracted_relationships").select("source", "relation_type", "target", F.col("chunk_id").alias("chunk")).distinct()
    out = entities.validated_triples(t, _chunks(spark, sf).select(F.col("id").alias("chunk"), "content"))
    return out.groupBy(F.coalesce("reason", F.lit("fine")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _updated_sql(rounds: int) -> str:
    """PageRank inside what lies within one hop of N1, scaled to what it held before."""
    steps = ["r0 AS (SELECT n, 1.0::DOUBLE / (SELECT count(*) FROM a) AS s FROM a)"]
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS (SELECT a.n, 0.15 / (SELECT count(*) FROM a) + 0.85 * (coalesce(g.s, 0) + (SELECT coalesce(sum(s), 0) FROM r{i} WHERE n NOT IN (SELECT source FROM o)) / (SELECT count(*) FROM a)) AS s
FROM a LEFT JOIN (SELECT target, sum(r.s * i.weight / o.t) AS s FROM i JOIN o ON o.source = i.source JOIN r{i} r ON r.n = i.source GROUP BY 1) g ON g.target = a.n)""")
    return f"""WITH {_E}, every AS (SELECT source AS n FROM e UNION SELECT target FROM e), a AS (SELECT 'N1' AS n UNION SELECT target FROM e WHERE source = 'N1' UNION SELECT source FROM e WHERE target = 'N1'),
i AS (SELECT DISTINCT * FROM e WHERE source IN (SELECT n FROM a) AND target IN (SELECT n FROM a)), o AS (SELECT source, sum(weight) AS t FROM i GROUP BY 1), {', '.join(steps)},
held AS (SELECT (SELECT count(*) FROM a) / (SELECT count(*) FROM every) AS h)
SELECT every.n AS node, round(CASE WHEN r{rounds}.n IS NULL THEN 1.0 / (SELECT count(*) FROM every) ELSE h * r{rounds}.s / (SELECT sum(s) FROM r{rounds}) END, 7) AS score FROM held, every LEFT JOIN r{rounds} ON r{rounds}.n = every.n"""


@query(_updated_sql(5))
def updated_pagerank(spark, sf):
    e = star(spark, sf)
    n = graph.oriented(e.select("source", "target")).select(F.col("source").alias("node")).distinct()
    even = n.crossJoin(F.broadcast(n.agg((1 / F.count(F.lit(1))).alias("score"))))  # one row
    return graph.updated_pagerank(e, even, spark.createDataFrame([("N1",)], "node string"), iterations=5, tolerance=0, hops=1).withColumn("score", F.round("score", 7))


_TREE = "tree AS (SELECT 'N' || n_nationkey AS node, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'R' || r_regionkey, NULL FROM region)"


def _tree(spark, sf):
    r = table(spark, sf, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"))
    return star(spark, sf).select(F.col("source").alias("node"), F.col("target").alias("parent")).unionByName(r)


@query(f"""WITH RECURSIVE {_TREE}, u AS (SELECT node, parent AS ancestor, 1 AS distance FROM tree WHERE parent IS NOT NULL UNION ALL SELECT u.node, t.parent, distance + 1 FROM u JOIN tree t ON t.node = u.ancestor WHERE t.parent IS NOT NULL) SELECT * FROM u""")
def tree_ancestors(spark, sf):
    t = _tree(spark, sf)
    return graph.ancestors(t, t)


@query(f"""WITH RECURSIVE {_TREE}, d AS (SELECT parent AS node, node AS descendant, 1 AS distance FROM tree WHERE parent IN ('R1', 'N3') UNION ALL SELECT d.node, t.node, distance + 1 FROM d JOIN tree t ON t.parent = d.descendant) SELECT * FROM d""")
def tree_descendants(spark, sf):
    return graph.descendants(_tree(spark, sf), spark.createDataFrame([("R1",), ("N3",)], "node string"))


@query("SELECT 'R' || r_regionkey AS node FROM region")
def tree_roots(spark, sf):
    return graph.roots(_tree(spark, sf))
