"""Graph queries on the star schema: regions, nations, suppliers and customers joined by their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.operators import graph
from graphmill.operators.components import connected_components
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


def star(spark, sf, customers: bool = False):
    """source, target, relation_type, confidence, weight."""
    n, s, c = table(spark, sf, "nation"), table(spark, sf, "supplier"), table(spark, sf, "customer")
    edge = lambda df, a, ak, b, bk, kind, conf: df.select(F.concat(F.lit(a), F.col(ak).cast("string")).alias("source"), F.concat(F.lit(b), F.col(bk).cast("string")).alias("target"), F.lit(kind).alias("relation_type"), F.lit(conf).alias("confidence"), F.lit(conf).alias("weight"))
    out = edge(n, "N", "n_nationkey", "R", "n_regionkey", "IN_REGION", 0.9).unionByName(edge(s, "S", "s_suppkey", "N", "s_nationkey", "IN_NATION", 0.8))
    return out.unionByName(edge(c, "C", "c_custkey", "N", "c_nationkey", "IN_NATION", 0.7)) if customers else out


_E = """e AS (SELECT 'N' || n_nationkey AS source, 'R' || n_regionkey AS target, 'IN_REGION' AS relation_type, 0.9 AS weight FROM nation
UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'IN_NATION', 0.8 FROM supplier)"""
_B = "b AS (SELECT source, target, weight FROM e UNION ALL SELECT target, source, weight FROM e)"


def seeds(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


@query(f"""WITH RECURSIVE {_E}, {_B}, r AS (SELECT 'R1' AS node, 0 AS distance UNION SELECT b.target, r.distance + 1 FROM r JOIN b ON b.source = r.node WHERE r.distance < 3)
SELECT node, min(distance) AS distance FROM r GROUP BY 1""")
def bfs_distances(spark, sf):
    return graph.reach(star(spark, sf), seeds(spark, "R1"), 3)


@query(f"""WITH RECURSIVE {_E}, {_B}, r AS (SELECT s AS node, 0 AS distance FROM (VALUES ('R0'), ('S1')) t(s) UNION SELECT b.target, r.distance + 1 FROM r JOIN b ON b.source = r.node WHERE r.distance < 2)
SELECT node, min(distance) AS distance FROM r GROUP BY 1""")
def multi_source_bfs(spark, sf):
    return graph.reach(star(spark, sf), seeds(spark, "R0", "S1"), 2)


@query(f"""WITH {_E}, n AS (SELECT 'N3' AS node UNION SELECT target FROM e WHERE source = 'N3' UNION SELECT source FROM e WHERE target = 'N3')
SELECT DISTINCT source, target, relation_type FROM e WHERE source IN (SELECT node FROM n) AND target IN (SELECT node FROM n)""")
def ego_network(spark, sf):
    return graph.focused_subgraph(star(spark, sf), seeds(spark, "N3"), 1)[1].select("source", "target", "relation_type").distinct()


@query(f"""WITH RECURSIVE {_E}, {_B}, p AS (SELECT ['R0', target] AS path, target AS node, 1 AS edges, weight FROM (SELECT DISTINCT * FROM b) WHERE source = 'R0'
UNION ALL SELECT list_append(path, b.target), b.target, edges + 1, p.weight + b.weight FROM p JOIN (SELECT DISTINCT * FROM b) b ON b.source = p.node WHERE edges < 4 AND NOT list_contains(path, b.target) AND p.node <> 'N0')
SELECT array_to_string(path, '>') AS path, edges, round(weight, 6) AS weight FROM p WHERE node = 'N0'""")
def simple_paths(spark, sf):
    p = graph.simple_paths(star(spark, sf), "R0", "N0", 4, "both")
    return p.select(F.array_join("path", ">").alias("path"), "edges", F.round("weight", 6).alias("weight"))


@query(f"""WITH RECURSIVE {_E}, {_B}, r AS (SELECT source AS node, source AS c FROM b UNION SELECT b.target, r.c FROM r JOIN b ON b.source = r.node)
SELECT node, min(c) AS component FROM r GROUP BY 1""")
def components(spark, sf):
    return connected_components(star(spark, sf), "source", "target")


@query(f"""WITH {_E}, d AS (SELECT node, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT source AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY 1)
SELECT node, out_degree + in_degree AS degree, out_degree, in_degree, round((out_degree + in_degree) / (count(*) OVER () - 1), 6) AS centrality FROM d""")
def degree(spark, sf):
    return graph.degrees(star(spark, sf)).withColumn("centrality", F.round("centrality", 6))


@query(f"""WITH {_E}, n AS (SELECT count(*) AS nodes FROM (SELECT source FROM e UNION SELECT target FROM e)), m AS (SELECT count(*) AS edges FROM e)
SELECT nodes, edges, round(2 * edges / (nodes * (nodes - 1)), 9) AS density, round(2 * edges / nodes, 6) AS average_degree FROM n, m""")
def density(spark, sf):
    return graph.shape(star(spark, sf)).select("nodes", "edges", F.round("density", 9).alias("density"), F.round("average_degree", 6).alias("average_degree"))


def mesh(spark, sf):
    """Nations joined where a customer of the one bought from a supplier of the other; weight counts the lines."""
    li, o = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.where("c_nationkey != s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").alias("source"), F.greatest("c_nationkey", "s_nationkey").alias("target")).agg(F.count(F.lit(1)).alias("lines")).select("source", "target", F.col("lines").cast("double").alias("weight"))


_M = """m AS (SELECT least(c_nationkey, s_nationkey) AS source, greatest(c_nationkey, s_nationkey) AS target, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
WHERE c_nationkey <> s_nationkey GROUP BY 1, 2), u AS (SELECT source AS a, target AS b, weight FROM m UNION ALL SELECT target, source, weight FROM m)"""


@query(f"""WITH {_M}, k AS (SELECT a, count(*) AS k FROM u GROUP BY 1), t AS (SELECT x.a, count(*) AS t FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN m ON m.source = x.b AND m.target = y.b GROUP BY 1)
SELECT k.a AS node, coalesce(t, 0) AS triangles, k AS neighbours FROM k LEFT JOIN t ON t.a = k.a""")
def triangle_counts(spark, sf):
    return graph.triangles(mesh(spark, sf))


@query(f"""WITH {_M}, k AS (SELECT a, count(*) AS k FROM u GROUP BY 1), t AS (SELECT x.a, count(*) AS t FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN m ON m.source = x.b AND m.target = y.b GROUP BY 1)
SELECT round(avg(2 * coalesce(t, 0) / (k * (k - 1))), 6) AS coefficient FROM k LEFT JOIN t ON t.a = k.a WHERE k >= 2""")
def clustering(spark, sf):
    return graph.clustering(mesh(spark, sf)).select(F.round("coefficient", 6).alias("coefficient"))


@query(f"""WITH RECURSIVE {_E}, {_B}, p AS (SELECT 'R0' AS node, 0.0::DOUBLE AS d, 0 AS n UNION ALL SELECT b.target, p.d + b.weight, n + 1 FROM p JOIN b ON b.source = p.node WHERE n < 4)
SELECT node, round(min(d), 6) AS distance FROM p GROUP BY 1""")
def shortest_paths(spark, sf):
    return graph.shortest_distances(star(spark, sf), seeds(spark, "R0")).select("node", F.round("distance", 6).alias("distance"))


@query(f"""WITH RECURSIVE {_E}, {_B}, s AS (SELECT 'R' || r_regionkey AS seed FROM region), p AS (SELECT seed, seed AS node, 0.0::DOUBLE AS d, 0 AS n FROM s UNION ALL SELECT seed, b.target, p.d + b.weight, n + 1 FROM p JOIN b ON b.source = p.node WHERE n < 4),
m AS (SELECT seed, node, min(d) AS d FROM p WHERE node <> seed GROUP BY 1, 2) SELECT seed AS node, round(count(*) / sum(d), 6) AS closeness FROM m GROUP BY 1""")
def closeness(spark, sf):
    r = table(spark, sf, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.closeness(star(spark, sf), r).select("node", F.round("closeness", 6).alias("closeness"))


def _doubled(rounds: int) -> str:
    """Least distances of all pairs by paths of 2, 4, 8 … edges."""
    steps = ["d0 AS (SELECT a, b, min(w) AS d FROM (SELECT a, b, 1.0 / weight + (least(a, b) * 37 + greatest(a, b) * 101) % 997 * 1e-7 AS w FROM u UNION ALL SELECT DISTINCT a, a, 0.0 FROM u) GROUP BY 1, 2)"]
    return ", ".join(steps + [f"d{i + 1} AS (SELECT x.a, y.b, min(x.d + y.d) AS d FROM d{i} x JOIN d{i} y ON x.b = y.a GROUP BY 1, 2)" for i in range(rounds)])


@query(f"""WITH {_M}, {_doubled(5)}, i AS (SELECT x.b AS node, count(*) AS k FROM d5 p JOIN d5 x ON x.a = p.a JOIN d5 y ON y.a = x.b AND y.b = p.b WHERE x.b <> p.a AND x.b <> p.b AND p.a <> p.b AND abs(x.d + y.d - p.d) < 1e-12 GROUP BY 1), n AS (SELECT count(DISTINCT a) AS n FROM u)
SELECT CAST(v.a AS VARCHAR) AS node, round(coalesce(k, 0) / greatest((n - 1) * (n - 2) / 2, 1), 6) AS betweenness FROM (SELECT DISTINCT a FROM u) v LEFT JOIN i ON i.node = v.a, n""")
def betweenness(spark, sf):
    """Lengths are 1 / lines and a trifle that differs from edge to edge, so that no two paths are equal."""
    length = 1 / F.col("weight") + (F.col("source") * 37 + F.col("target") * 101) % 997 * 1e-7
    e = mesh(spark, sf).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), length.alias("weight"))
    return graph.betweenness(e, e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node"))).distinct()).withColumn("betweenness", F.round("betweenness", 6))


@query(f"""WITH {_E}, a AS (SELECT source AS n FROM e UNION SELECT target FROM e), one AS (SELECT DISTINCT source AS n FROM e WHERE source LIKE 'S%' AND target = 'N1'),
two AS (SELECT target AS node FROM e JOIN one ON source = n UNION SELECT f.target FROM e JOIN one ON e.source = n JOIN e f ON f.source = e.target) SELECT node FROM two""")
def neighbours_k(spark, sf):
    e = star(spark, sf)
    return graph.neighbours(e, e.where("target = 'N1' and source like 'S%'").select(F.col("source").alias("node")), None, 2)


def rank_steps(rounds: int, reset: str, damping: float = 0.85) -> str:
    """``a`` (nodes), ``o`` (sums of weights) and ``r0`` … of the edges ``e`` (source, target, weight); ``reset`` speaks of a.n."""
    steps = ["a AS (SELECT source AS n FROM e UNION SELECT target FROM e), o AS (SELECT source, sum(weight) AS t FROM e GROUP BY 1), r0 AS (SELECT n, 1.0::DOUBLE / (SELECT count(*) FROM a) AS s FROM a)"]
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS (SELECT a.n, {1 - damping} * {reset} + {damping} * (coalesce(g.s, 0) + (SELECT coalesce(sum(s), 0) FROM r{i} WHERE n NOT IN (SELECT source FROM o)) / (SELECT count(*) FROM a)) AS s
FROM a LEFT JOIN (SELECT target, sum(r.s * e.weight / o.t) AS s FROM e JOIN o ON o.source = e.source JOIN r{i} r ON r.n = e.source GROUP BY 1) g ON g.target = a.n)""")
    return ", ".join(steps)


def _pagerank_sql(rounds: int, reset: str) -> str:
    steps = [f"r0 AS (SELECT n, 1.0::DOUBLE / (SELECT count(*) FROM a) AS s FROM a)"]
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS (SELECT a.n, 0.15 * {reset} + 0.85 * (coalesce(g.s, 0) + (SELECT coalesce(sum(s), 0) FROM r{i} WHERE n NOT IN (SELECT source FROM o)) / (SELECT count(*) FROM a)) AS s
FROM a LEFT JOIN (SELECT target, sum(r.s * e.weight / o.t) AS s FROM e JOIN o ON o.source = e.source JOIN r{i} r ON r.n = e.source GROUP BY 1) g ON g.target = a.n)""")
    return f"WITH {_E}, a AS (SELECT source AS n FROM e UNION SELECT target FROM e), o AS (SELECT source, sum(weight) AS t FROM e GROUP BY 1), {', '.join(steps)} SELECT n AS node, round(s / (SELECT sum(s) FROM r{rounds}), 7) AS score FROM r{rounds}"


@query(_pagerank_sql(5, "1.0::DOUBLE / (SELECT count(*) FROM a)"))
def pagerank(spark, sf):
    return graph.pagerank(star(spark, sf), iterations=5, tolerance=0).select("node", F.round("score", 7).alias("score"))


@query(_pagerank_sql(5, "CASE WHEN a.n = 'N1' THEN 1.0 ELSE 0.0 END"))
def personalised_pagerank(spark, sf):
    s = spark.createDataFrame([("N1", 1.0)], "node string, weight double")
    return graph.pagerank(star(spark, sf), s, iterations=5, tolerance=0, reset_base="zero").select("node", F.round("score", 7).alias("score"))


@query()
def communities(spark, sf):
    return graph.communities(mesh(spark, sf).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "weight"))


_PLACE = "p AS (SELECT 'N' || n_nationkey AS node, n_name AS name, 'NATION' AS t, 'R' || n_regionkey AS c FROM nation UNION ALL SELECT 'S' || s_suppkey, s_name, 'SUPPLIER', 'R' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"""WITH {_PLACE}, r AS (SELECT *, row_number() OVER (PARTITION BY c, t ORDER BY name, node) AS r FROM p), g AS (SELECT c, t, count(*) AS n, t || ': ' || string_agg(name, ', ' ORDER BY name) FILTER (r <= 5) || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END AS line FROM r GROUP BY 1, 2)
SELECT c AS community, CAST(sum(n) AS BIGINT) AS members, left(string_agg(line, '; ' ORDER BY t), 500) AS summary FROM g GROUP BY 1""")
def community_summaries(spark, sf):
    """The nations and suppliers of each region as a community."""
    steps = star(spark, sf).select("source", "target")
    nations = steps.where("target like 'R%'").select(F.col("source").alias("node"), F.col("target").alias("community"))
    label = nations.unionByName(steps.where("source like 'S%'").select(F.col("source").alias("s"), F.col("target").alias("node")).join(nations, "node").select(F.col("s").alias("node"), "community"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("NATION").alias("entity_type"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("entity_type"))
    return graph.community_summary(label, n.unionByName(s))


@query(f"""WITH {_E}, w AS (SELECT e.source, e.target, relation_type, weight FROM e) SELECT source, target, round(sum(weight), 6) AS weight FROM w GROUP BY 1, 2""")
def adjacency(spark, sf):
    return graph.adjacency(star(spark, sf)).select("source", "target", F.round("weight", 6).alias("weight"))


@query(f"""WITH c AS (SELECT DISTINCT id, e AS entity FROM (SELECT id, unnest(entities) AS e FROM text_chunks) WHERE e IS NOT NULL),
f AS (SELECT min(entity_key) AS s, max(entity_key) AS t, avg(confidence::DOUBLE) AS score FROM extracted_entities WHERE entity_key IS NOT NULL AND chunk_id IS NOT NULL AND confidence IS NOT NULL GROUP BY chunk_id HAVING min(entity_key) <> max(entity_key)),
k AS (SELECT entity, count(DISTINCT id) AS k FROM c GROUP BY 1), w AS (SELECT x.n AS node, avg(score / k) AS w FROM (SELECT s AS n, score FROM f UNION ALL SELECT t, score FROM f) x JOIN k ON k.entity = x.n GROUP BY 1 UNION ALL SELECT DISTINCT id, 0.5 * 0.05 FROM c),
seed AS (SELECT node, max(w) / (SELECT sum(w) FROM w) AS w FROM w GROUP BY 1), one AS (SELECT entity AS source, id AS target FROM c UNION ALL SELECT s, t FROM f), e AS (SELECT source, target, count(*) AS weight FROM (SELECT * FROM one UNION ALL SELECT target, source FROM one) GROUP BY 1, 2),
{rank_steps(5, "coalesce((SELECT w FROM seed WHERE node = a.n), 0)", 0.5)}
SELECT n AS node, round(s / (SELECT sum(s) FROM r5), 7) AS score FROM r5 WHERE n IN (SELECT id FROM c)""")
def passage_ranking(spark, sf):
    c = table(spark, sf, "text_chunks").select("id", F.explode("entities").alias("entity")).where("entity is not null").distinct()
    facts = table(spark, sf, "extracted_entities").where("entity_key is not null and chunk_id is not null and confidence is not null").groupBy("chunk_id").agg(F.min("entity_key").alias("subject"), F.max("entity_key").alias("object"), F.avg("confidence").alias("score")).where("subject != object").select("subject", "object", "score")
    sim = c.select(F.col("id").alias("passage")).distinct().withColumn("score", F.lit(0.5))
    return graph.passage_ranking(facts, c.select("entity", F.col("id").alias("passage")), sim, iterations=5).withColumn("score", F.round("score", 7))


@query()
def node_walks(spark, sf):
    return graph.random_walks(star(spark, sf), 5, 1, 0.5, 2.0).select("walk", F.array_join("path", ">").alias("path"))


def _layers(n: int) -> str:
    steps = []
    for i in range(n):
        steps.append(f"""m{i} AS (SELECT f.node, f.pos, CASE WHEN g.x IS NULL THEN f.x ELSE (f.x + g.x) / 2 END AS x FROM f{i} f LEFT JOIN (SELECT v.source AS node, pos, avg(x) AS x FROM v JOIN f{i} y ON y.node = v.target GROUP BY 1, 2) g ON g.node = f.node AND g.pos = f.pos),
f{i + 1} AS (SELECT node, pos, x / sqrt(sum(x * x) OVER (PARTITION BY node)) AS x FROM m{i})""")
    return ", ".join(steps)


@query(f"""WITH {_E}, v AS (SELECT DISTINCT source, target FROM (SELECT source, target FROM e UNION ALL SELECT target, source FROM e) WHERE source <> target), k AS (SELECT DISTINCT source AS node, CAST(substr(source, 2) AS INT) AS k FROM v),
f0 AS (SELECT node, pos, CAST(x[pos + 1] AS DOUBLE) AS x FROM (SELECT node, [length(node), k % 7, k % 11, 1] AS x FROM k), range(0, 4) t(pos)), {_layers(2)} SELECT node, pos, round(x, 6) AS value FROM f2""")
def neighbour_features(spark, sf):
    e = star(spark, sf)
    n = graph.oriented(e.select("source", "target")).select(F.col("source").alias("node")).distinct()
    k = F.substring("node", 2, 9).cast("int")
    f = n.select("node", F.array(*[x.cast("double") for x in (F.length("node"), k % 7, k % 11, F.lit(1))]).alias("vector"))
    return graph.neighbour_features(e, f).select("node", F.posexplode("vector").alias("pos", "x")).select("node", "pos", F.round("x", 6).alias("value"))
