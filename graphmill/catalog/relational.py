"""The graph algebra and plain relational operators on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.plans import questions
from graphmill.plans.query_op import EntityScan, Filter, Graph, Join, Limit, Neighbors, Union, cost, explain, optimize
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


def star_graph(spark, sf) -> Graph:
    node = lambda t, kind, key, name, extra: table(spark, sf, t).select(F.concat(F.lit(kind[0]), F.col(key).cast("string")).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(name).alias("name"), F.col(extra).cast("string").alias("nation"))
    n = node("nation", "NATION", "n_nationkey", "n_name", "n_nationkey")
    s, c = node("supplier", "SUPPLIER", "s_suppkey", "s_name", "s_nationkey"), node("customer", "CUSTOMER", "c_custkey", "c_name", "c_nationkey")
    rel = lambda df: df.select(F.col("entity_id").alias("source"), F.concat(F.lit("N"), F.col("nation")).alias("target"), F.lit("IN_NATION").alias("relation_type"))
    return Graph(n.unionByName(s).unionByName(c), rel(s).unionByName(rel(c)))


_G = """g AS (SELECT 'N' || n_nationkey AS entity_id, 'NATION' AS entity_type, n_name AS name, n_nationkey::VARCHAR AS nation FROM nation UNION ALL SELECT 'S' || s_suppkey, 'SUPPLIER', s_name, s_nationkey::VARCHAR FROM supplier
UNION ALL SELECT 'C' || c_custkey, 'CUSTOMER', c_name, c_nationkey::VARCHAR FROM customer)"""


@query(f"WITH {_G} SELECT * FROM g WHERE entity_type = 'SUPPLIER'")
def entity_scan(spark, sf):
    return star_graph(spark, sf).run(EntityScan("SUPPLIER"))


@query(f"WITH {_G} SELECT * FROM g WHERE entity_type = 'CUSTOMER' AND nation = '7'")
def graph_filter(spark, sf):
    return star_graph(spark, sf).run(Filter("nation", "7", EntityScan("CUSTOMER")))


@query(f"WITH {_G} SELECT * FROM g WHERE entity_type = 'CUSTOMER' AND nation = '7'")
def join_inner(spark, sf):
    return star_graph(spark, sf).run(Join(EntityScan("CUSTOMER"), Filter("nation", "7")))


@query(f"WITH {_G} SELECT * FROM g WHERE entity_type = 'SUPPLIER'")
def join_left(spark, sf):
    return star_graph(spark, sf).run(Join(EntityScan("SUPPLIER"), Filter("nation", "7"), "left"))


@query(f"WITH {_G} SELECT x.*, y.entity_id AS right_entity_id, y.entity_type AS right_entity_type, y.name AS right_name, y.nation AS right_nation FROM g x, g y WHERE x.entity_type = 'NATION' AND y.entity_type = 'NATION'")
def join_cross(spark, sf):
    return star_graph(spark, sf).run(Join(EntityScan("NATION"), EntityScan("NATION"), "cross"))


@query(f"WITH {_G} SELECT * FROM g WHERE entity_id IN (SELECT 'N' || nation FROM g WHERE entity_type = 'SUPPLIER')")
def graph_neighbours(spark, sf):
    return star_graph(spark, sf).run(Neighbors(EntityScan("SUPPLIER"), "IN_NATION", 2))


@query(f"WITH {_G} SELECT * FROM g WHERE entity_type = 'NATION' OR nation = '7'")
def graph_union(spark, sf):
    return star_graph(spark, sf).run(Union(EntityScan("NATION"), Filter("nation", "7")))


@query(f"WITH {_G} SELECT * FROM g WHERE entity_type = 'CUSTOMER' ORDER BY entity_id LIMIT 10")
def graph_limit(spark, sf):
    return star_graph(spark, sf).run(Limit(EntityScan("CUSTOMER"), 10))


@query()
def plan_costs(spark, sf):
    g = star_graph(spark, sf)
    stats, op = g.statistics(), Join(Join(EntityScan("CUSTOMER"), EntityScan("SUPPLIER")), EntityScan("NATION"))
    better = optimize(op, stats)
    return spark.createDataFrame([("given", *map(float, cost(op, stats)), explain(op, stats)), ("optimized", *map(float, cost(better, stats)), explain(better, stats))], "plan string, rows double, cost double, text string")


@query(f"WITH {_G} SELECT entity_type, nation, count(*) AS n FROM g GROUP BY ROLLUP (entity_type, nation)")
def rollup_statistics(spark, sf):
    return star_graph(spark, sf).entities.rollup("entity_type", "nation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_statistics(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (day), ())")
def grouping_sets(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"))
    return e.groupingSets([["event_type"], ["day"], []], "event_type", "day").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def difference(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").select("o_custkey"))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def intersection(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").intersect(table(spark, sf, "orders").select("o_custkey"))


@query("""WITH q AS (SELECT doc_id, coalesce(title, '') AS t FROM documents), l AS (SELECT doc_id, t, lower(t) AS low, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) AS n FROM q),
k AS (SELECT *, """ + " + ".join(f"contains(low, '{w}')::INT" for w in questions.BROAD) + " AS broad, " + " + ".join(f"contains(low, '{w}')::INT" for w in questions.SPECIFIC) + """ AS specific,
(length(low) - length(replace(low, '"', ''))) // 2 + len(regexp_extract_all(low, ' and ')) + len(regexp_extract_all(low, 'between')) AS marks FROM l),
s AS (SELECT doc_id, CASE WHEN broad + specific > 0 THEN (broad - specific) / (broad + specific) ELSE 0 END * 0.5 + CASE WHEN n BETWEEN 1 AND 3 THEN 0.5 WHEN n BETWEEN 4 AND 5 THEN 0.2 WHEN n BETWEEN 6 AND 7 THEN 0.0 WHEN n BETWEEN 8 AND 10 THEN -0.3 ELSE -0.5 END * 0.2
+ CASE WHEN marks = 0 THEN 0.3 WHEN marks = 1 THEN 0 WHEN marks = 2 THEN -0.4 ELSE -0.7 END * 0.3 AS score FROM k)
SELECT doc_id, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'VeryBroad' WHEN score >= 0.4 THEN 'Broad' WHEN score >= -0.2 THEN 'Medium' WHEN score >= -0.5 THEN 'Specific' ELSE 'VerySpecific' END AS complexity,
CASE WHEN score >= 0.7 THEN 3 WHEN score >= 0.4 THEN 2 WHEN score >= -0.2 THEN 1 ELSE 0 END AS level FROM s""")
def query_routing(spark, sf):
    cols = questions.complexity_level(F.coalesce("title", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", *[F.round(c, 6).alias(n) if n == "score" else c.alias(n) for n, c in cols.items()])


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, CASE """ + " ".join(f"WHEN list_has_any(w, {known!r}) THEN '{name}'" for name, known in questions.INTENTS) + " ELSE 'Detailed' END AS intent FROM w")
def query_intent(spark, sf):
    return table(spark, sf, "documents").select("doc_id", questions.intent(F.coalesce("text", F.lit(""))).alias("intent"))


_W = "list_filter(string_split_regex(lower(coalesce({}, '')), '\\s+'), lambda w: w <> '')"
_HAS = lambda known: "list_has_any(words, [" + ", ".join(f"'{w}'" for w in known) + "])"


@query(f"""WITH q AS (SELECT doc_id AS id, {_W.format('title')} AS words FROM documents), nw AS (SELECT DISTINCT name, unnest({_W.format('name')}) AS w FROM (SELECT DISTINCT name FROM extracted_entities WHERE name IS NOT NULL)),
h AS (SELECT id, list_sort(list(DISTINCT name)) AS names FROM (SELECT id, unnest(words) AS w FROM q) JOIN nw USING (w) WHERE length(w) > 2 GROUP BY 1), k AS (SELECT q.id, words, coalesce(names, []) AS names FROM q LEFT JOIN h ON h.id = q.id),
s AS (SELECT *, {_W.format("array_to_string(names, ' ')")} AS spoken FROM k), c AS (SELECT *, list_filter(words, lambda w: strlen(w) > 3 AND w NOT IN ({', '.join(repr(w) for w in questions.PLAIN_STOP_WORDS)}) AND NOT list_contains(spoken, w)) AS concepts FROM s)
SELECT id, CASE WHEN len(names) > 1 THEN 'Relationship' WHEN len(names) = 1 THEN 'EntityFocused' WHEN {_HAS(questions.ABSTRACT)} THEN 'Conceptual' WHEN {_HAS(questions.ASKING)} THEN 'Exploratory' ELSE 'Factual' END AS query_type,
CASE {' '.join(f"WHEN {_HAS(known)} THEN '{name}'" for name, known in questions.INTENTS)} ELSE 'Detailed' END AS intent, len(names) AS named, array_to_string(concepts, ' ') AS concepts, round(least(len(words) * 0.1 + len(names) * 0.3 + len(concepts) * 0.2, 1.0), 6) AS complexity FROM c""")
def query_analysis(spark, sf):
    q = table(spark, sf, "documents").select("doc_id", "title")
    names = table(spark, sf, "extracted_entities").select("name").where("name is not null").distinct()
    out = questions.analyse(q, "doc_id", "title", names)
    return out.select("id", "query_type", "intent", F.size("key_entities").alias("named"), F.array_join("concepts", " ").alias("concepts"), F.round("complexity", 6).alias("complexity"))


@query("""WITH l AS (SELECT s_name AS s, n_name AS t FROM supplier JOIN nation ON n_nationkey = s_nationkey), one AS (SELECT * FROM l WHERE s = (SELECT min(s) FROM l))
SELECT 'What is NATION_3?' AS question, 'Is' AS predicate, n_name || ' is a NATION' AS value, 0.9 AS confidence FROM nation WHERE contains(lower(n_name), 'nation_3')
UNION ALL SELECT 'How many suppliers?', 'Count', CAST(count(*) AS VARCHAR), 0.9 FROM supplier
UNION ALL SELECT 'Where is SUPPLIER?', 'Located', t, 0.7 FROM one
UNION ALL SELECT 'How is SUPPLIER related to NATION_?', 'Related', s || ' LOCATED_IN ' || t, 0.8 FROM one
UNION ALL SELECT 'What type does NATION_7 have?', 'Has', 'NATION', 0.9
UNION ALL SELECT 'Compare NATION_3 with NATION_4', 'Compare', n_name || ' is a NATION', 0.7 FROM nation WHERE contains(lower(n_name), 'nation_3') OR contains(lower(n_name), 'nation_4')
UNION ALL SELECT 'What caused NATION_5?', 'Caused', 'war caused NATION_5', 0.8 UNION ALL SELECT 'When was NATION_6 founded?', 'Happened', 'league founded_in NATION_6', 0.6""")
def logic_forms(spark, sf):
    """Questions parsed to logic forms and answered over the star graph."""
    g = star_graph(spark, sf)
    ents = g.entities.withColumn("confidence", F.lit(0.9))
    rel = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("source"), F.col("n_name").alias("target"), F.lit("LOCATED_IN").alias("relation_type"))
    first = rel.agg(F.min("source")).first()[0]
    rel = rel.unionByName(spark.createDataFrame([("war", "NATION_5", "caused"), ("league", "NATION_6", "founded_in")], "source string, target string, relation_type string"))
    out = None
    for text in ("What is NATION_3?", "How many suppliers?", "Where is SUPPLIER?", "How is SUPPLIER related to NATION_?", "What type does NATION_7 have?", "Compare NATION_3 with NATION_4", "What caused NATION_5?", "When was NATION_6 founded?"):
        form = questions.parse(text.replace("SUPPLIER", first))
        rows = questions.answer(form, ents, rel).select(F.lit(text).alias("question"), F.lit(form.predicate).alias("predicate"), "value", "confidence")
        out = rows if out is None else out.unionByName(rows)
    return out
