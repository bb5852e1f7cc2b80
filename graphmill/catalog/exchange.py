"""Readers, workspaces, vector tables, functions by name and deletions, on files written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.catalog.graph import star
from graphmill.catalog.retrieval import _NAMED, _named
from graphmill.operators import chunking, entities
from graphmill.session import new_path, table
from graphmill.sources import readers, workspace
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


_NATIONS = "SELECT 'N' || n_nationkey AS id, n_name AS name, 'NATION' AS entity_type, 'R' || n_regionkey AS target FROM nation"


def _nations(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("NATION").alias("type"), F.concat(F.lit("R"), "n_regionkey").alias("target"))


def _imported(got: readers.Imported):
    """Each valid entity with the target of its relation."""
    return got.entities.select("id", "name", "entity_type").join(got.relations.select(F.col("source").alias("id"), "target"), "id", "left")


def _flat(spark, sf):
    return _nations(spark, sf).select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("type").alias("entity_type"), F.col("id").alias("relationship_source"), F.col("target").alias("relationship_target"), F.lit("IN_REGION").alias("relationship_type"))


@query(_NATIONS)
def import_csv(spark, sf):
    path = new_path(spark, "csv")
    _flat(spark, sf).write.option("header", True).csv(path)
    return _imported(readers.read_import(spark, path, "csv"))


@query(_NATIONS)
def import_tsv(spark, sf):
    path = new_path(spark, "tsv")
    _flat(spark, sf).write.option("header", True).csv(path, sep="\t")
    return _imported(readers.read_import(spark, path, "tsv"))


@query(_NATIONS)
def import_json(spark, sf):
    """One document with all nations, a fixed table, as entities and relationships."""
    path = new_path(spark, "json")
    ent = F.collect_list(F.struct("id", "name", "type"))
    rel = F.collect_list(F.struct(F.col("id").alias("source"), "target", F.lit("IN_REGION").alias("relation_type")))
    _nations(spark, sf).agg(ent.alias("entities"), rel.alias("relationships")).write.json(path)
    return _imported(readers.read_import(spark, path, "json"))


@query(_NATIONS)
def import_jsonl(spark, sf):
    path = new_path(spark, "jsonl")
    n = _nations(spark, sf)
    lines = n.select(F.lit("entity").alias("kind"), "id", "name", "type").unionByName(n.select(F.lit("relationship").alias("kind"), F.col("id").alias("source"), "target", F.lit("IN_REGION").alias("relation_type")), allowMissingColumns=True)
    lines.write.json(path)
    return _imported(readers.read_import(spark, path, "jsonl"))


@query(_NATIONS)
def import_triples(spark, sf):
    path = new_path(spark, "rdf")
    about = F.concat(F.lit("<http://example.org/"), "id", F.lit(">"))
    said = F.array(F.concat_ws(" ", about, F.lit("a"), F.lit("<http://example.org/NATION>"), F.lit(".")), F.concat(about, F.lit(' <http://www.w3.org/2000/01/rdf-schema#label> "'), "name", F.lit('" .')), F.concat(about, F.lit(" <http://example.org/IN_REGION> <http://example.org/"), "target", F.lit("> .")))
    _nations(spark, sf).select(F.explode(said).alias("value")).write.text(path)
    got = readers.read_import(spark, path, "rdf")
    return _imported(got._replace(entities=got.entities.where("entity_type = 'NATION'")))


@query(_NATIONS)
def import_graphml(spark, sf):
    path = new_path(spark, "graphml")
    node = F.concat(F.lit('<node id="'), "id", F.lit('"><data key="name">'), "name", F.lit('</data><data key="type">'), "type", F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), "id", F.lit('" target="'), "target", F.lit('"><data key="relation">IN_REGION</data></edge>'))
    body = F.array_join(F.array_sort(F.collect_list(F.concat(node, edge))), "")  # 25 nations
    _nations(spark, sf).agg(F.concat(F.lit('<graphml><graph edgedefault="directed">'), body, F.lit("</graph></graphml>")).alias("value")).coalesce(1).write.text(path)
    return _imported(readers.read_import(spark, path, "graphml"))


@query("SELECT 'Text' AS document_type, sha256(r_name || chr(10)) AS content_hash, strlen(r_name) + 1 AS size_bytes FROM region")
def collection_load(spark, sf):
    """One text file a region, found again below the folder."""
    path = new_path(spark, "collection")
    table(spark, sf, "region").select(F.col("r_name").alias("value"), "r_regionkey").repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    return readers.read_collection(spark, path).where("size_bytes > 0 and path like '%.txt'").select("document_type", "content_hash", "size_bytes")


@query("SELECT id, name, entity_type FROM (WITH " + _NAMED + " SELECT * FROM named)")
def workspace_round_trip(spark, sf):
    """Saved twice as versions of a workspace in two codecs, the second rolled back, loaded, dropped from the list of names."""
    w = workspace.Workspaces(spark, new_path(spark, "workspaces"))
    tables = {"entities": _named(spark, sf), "relations": star(spark, sf)}
    w.save("stars", tables, "gzip")
    w.save("stars", {"entities": tables["entities"].limit(1), "relations": tables["relations"]}, "zstd")
    w.rollback("stars")
    w.save("other", {"entities": tables["entities"].limit(1)}, "lz4")
    w.delete("other")
    assert w.names() == ["stars"]
    return w.load("stars")["entities"]


@query("SELECT id, name, entity_type FROM (WITH " + _NAMED + " SELECT * FROM named)")
def json_round_trip(spark, sf):
    path = new_path(spark, "graph-json")
    workspace.save_json({"entities": _named(spark, sf), "relations": star(spark, sf)}, path)
    return workspace.load_json(spark, path, {"entities": "id string, name string, entity_type string"})["entities"]


_TABLE = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 3 <> 0)"


@query(f"""WITH {_TABLE} SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, v.id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.e), 12) DESC, v.id) AS rank FROM embeddings q, v WHERE q.vec_id % 20 = 0 AND q.embedding IS NOT NULL) WHERE rank <= 5""")
def vector_table(spark, sf):
    """A table to which a half is added in two batches, some rows twice, and from which every third is removed."""
    v = table(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    t = workspace.VectorTable(v.where("id % 2 = 0")).add(v.where("id % 4 = 1")).add(v.where("id % 2 = 1 or id % 8 = 0")).remove(v.where("id % 3 = 0"))
    return t.search(v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), 5).select("query_id", "id", "rank")


@query("SELECT count(*) AS vectors, count(*) FILTER (vec_id % 5 = 0) AS fifth FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 3 <> 0")
def vector_table_count(spark, sf):
    v = table(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    t = workspace.VectorTable(v).remove(v.where("id % 3 = 0"))
    return t.df.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("id") % 5 == 0).alias("fifth"))


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_suppkey % 4 <> 0")
def deletions(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return changes.delete(s, s.where("k % 4 = 0"), ["k"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 <> 0")
def applied_delta(spark, sf):
    from graphmill.catalog.maintenance import snapshots

    before, after = snapshots(spark, sf)
    d = changes.delta(before, after, ["o_orderkey"], "properties")
    now = changes.apply_delta(before, after, d, ["o_orderkey"])
    return now.select("o_orderkey").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("""WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT user_id, event_type, value FROM e WHERE r = 1 AND event_type <> 'error'""")
def stream_upserts(spark, sf):
    """All event files as a stream of changes into a bucketed table."""
    path = new_path(spark, "upserts")
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parque[t]")  # a pattern, as the table may be one file or a folder
    log = source.where("user_id is not null and ts is not null").select("user_id", "event_type", "value", "ts", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"))
    changes.run_available(log, changes.upsert_sink(f"{path}/table", ["user_id"], ["ts", "event_id"], 16), f"{path}/checkpoint")
    return changes.read_upserts(spark, f"{path}/table").select("user_id", "event_type", "value")


@query("SELECT subscriber, event_type, count(*) AS n FROM events, (VALUES ('one'), ('two')) s(subscriber) WHERE ts IS NOT NULL GROUP BY 1, 2")
def published_changes(spark, sf):
    """Events published in two calls and followed by two subscribers, one of them in two turns."""
    path = new_path(spark, "feed")
    e = table(spark, sf, "events").where("ts is not null").select("event_id", "event_type")

    def follow(who):
        sink = lambda batch, number: batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("subscriber", F.lit(who)).write.mode("overwrite").parquet(f"{path}/out/{who}-{number}")
        changes.run_available(changes.subscribe(spark, path, "event_id bigint, event_type string"), sink, f"{path}/checkpoint-{who}")

    changes.publish(e.where("event_id % 2 = 0"), path)
    follow("one")
    changes.publish(e.where("event_id % 2 = 1"), path)
    follow("one")
    follow("two")
    return spark.read.parquet(f"{path}/out/*").groupBy("subscriber", "event_type").agg(F.sum("n").alias("n"))


@query("""WITH m AS (SELECT n_name AS name FROM nation) SELECT lower(name) || '!' AS mention, name AS id FROM m""")
def best_match(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("NATION").alias("entity_type"))
    m = n.select(F.concat(F.lower("name"), F.lit("!")).alias("mention"), "entity_type")
    return entities.best_match(m, n.withColumn("id", F.col("name"))).select("mention", "id")


@query(f"WITH {_NAMED} SELECT id, name FROM named WHERE id IN ('N3', 'R1', 'S7')")
def entity_lookup(spark, sf):
    return _named(spark, sf).where(F.col("id").isin("N3", "R1", "S7")).select("id", "name")


def _functions(spark, sf):
    from graphmill.models import Functions

    rel = star(spark, sf)
    m = table(spark, sf, "extracted_entities").where("entity_key is not null and chunk_id is not null").select(F.col("chunk_id").alias("chunk"), F.col("entity_key").alias("entity_id")).distinct()
    return Functions({"entities": _named(spark, sf), "relations": rel, "mentions": m, "chunks": table(spark, sf, "text_chunks").groupBy("id").agg(F.max("content").alias("content"))})


@query(f"WITH {_NAMED} SELECT id, name, CASE WHEN lower(name) = 'nation_1' THEN 1.0 ELSE 0.8 END AS score FROM named WHERE contains(lower(name), 'nation_1') ORDER BY score DESC, id LIMIT 10")
def function_graph_search(spark, sf):
    return _functions(spark, sf).call("graph_search", name="Nation_1")


@query("""SELECT 'N3' AS node, 0 AS distance UNION ALL SELECT 'R' || n_regionkey, 1 FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'S' || s_suppkey, 1 FROM supplier WHERE s_nationkey = 3""")
def function_entity_expand(spark, sf):
    return _functions(spark, sf).call("entity_expand", entity="N3", depth=1)


@query("""SELECT 'S' || s_suppkey || '>N' || s_nationkey || '>R' || n_regionkey AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 1""")
def function_traverse(spark, sf):
    """From supplier 1 to the region of its nation."""
    f = _functions(spark, sf)
    r = f.tables["relations"]
    nation = r.where("source = 'S1'").first()["target"]
    region = r.where(F.col("source") == nation).first()["target"]
    return f.call("relationship_traverse", source="S1", target=region, hops=3).select(F.array_join("path", ">").alias("path"))


_HOT = "h AS (SELECT entity_key FROM extracted_entities WHERE entity_key IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT chunk_id) DESC, entity_key LIMIT 1)"


@query(f"WITH {_HOT} SELECT id, max(content) AS content FROM text_chunks WHERE id IN (SELECT chunk_id FROM extracted_entities WHERE entity_key = (SELECT entity_key FROM h)) GROUP BY 1")
def function_entity_context(spark, sf):
    f = _functions(spark, sf)
    hot = f.tables["mentions"].groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_id").first()[0]
    return f.call("get_entity_context", entity=hot)


@query("SELECT 'relationship_traverse' AS call, 'N1>N2' AS arguments UNION ALL SELECT 'relationship_traverse', 'N2>N1'")
def function_plan(spark, sf):
    """What is called for a question that names two nations."""
    f = _functions(spark, sf)
    f.tables["entities"] = f.tables["entities"].where("id in ('N1', 'N2', 'R0')").withColumn("name", F.translate("name", "_", "q"))
    rows = [(name, ">".join(str(v) for v in arguments.values())) for name, arguments in f.plan("How is NATIONq1 connected to NATIONq2?")]
    return spark.createDataFrame(rows, "call string, arguments string")


@query("""WITH t AS (SELECT n_nationkey AS node, 0 AS level, n_name AS summary FROM nation) SELECT node, round(1 + 2.0 + 0.5, 6) AS score FROM t WHERE contains(lower(summary), 'nation_1') ORDER BY node LIMIT 10""")
def tree_search(spark, sf):
    n = table(spark, sf, "nation").select(F.lit("d").alias("id"), F.lit(0).alias("level"), F.col("n_nationkey").alias("node"), F.col("n_name").alias("summary"))
    return chunking.tree_search(n, "nation_1").select("node", F.round("score", 6).alias("score"))


@query("SELECT source, target, relation_type FROM extracted_relationships WHERE source = (SELECT min(source) FROM extracted_relationships) AND target IS NOT NULL AND confidence >= 0.5 GROUP BY ALL")
def outgoing_relations(spark, sf):
    r = table(spark, sf, "extracted_relationships")
    first = r.agg(F.min("source")).first()[0]
    return r.where((F.col("source") == first) & F.col("target").isNotNull() & (F.col("confidence") >= 0.5)).select("source", "target", "relation_type").distinct()
