from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphmill.api import Engine
from graphmill.operators import chunking, entities
from graphmill.operators.temporal import as_of
from graphmill.sources import readers
from graphmill.sources.workspace import VectorTable, Workspaces
from graphmill.streaming import changes


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_and_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("entity_id,entity_name,entity_type,colour,relationship_source,relationship_target,relationship_type\n1,Zoë,PERSON,red,,,\n,Nobody,PERSON,,,,\n,,,,1,2,KNOWS\n,,,,1,,KNOWS\n")
    out = readers.read_import(spark, str(tmp_path / "a.csv"), "csv", readers.Mapping(attributes=("colour",)))
    assert [(r["id"], r["name"], r["attributes"]) for r in out.entities.collect()] == [("1", "Zoë", {"colour": "red"})]
    assert rows(out.relations.select("source", "target", "relation_type")) == [("1", "2", "KNOWS")]
    assert sorted(r["reason"] for r in out.rejects.collect()) == ["no id", "no target"]
    (tmp_path / "a.tsv").write_text("entity_id\tentity_name\tentity_type\n7\tX\tT\n")
    assert readers.read_import(spark, str(tmp_path / "a.tsv"), "tsv").entities.count() == 1


def test_json_and_graph_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"entities": [{"id": "1", "name": "A", "type": "T", "attributes": {"k": "v"}}, {"id": "", "name": "B", "type": "T"}], "relationships": [{"source": "1", "target": "2", "relation_type": "R"}]}')
    out = readers.read_import(spark, str(tmp_path / "a.json"), "json")
    assert (out.entities.count(), out.relations.count(), out.rejects.count()) == (1, 1, 1)
    (tmp_path / "a.jsonl").write_text('{"kind": "entity", "id": "1", "name": "A", "type": "T"}\n{"kind": "relationship", "source": "1", "target": "2", "relation_type": "R"}\n{"kind": "other"}\n')
    out = readers.read_import(spark, str(tmp_path / "a.jsonl"), "jsonl")
    assert (out.entities.count(), out.relations.count(), out.rejects.count()) == (1, 1, 1)
    (tmp_path / "a.nt").write_text('<http://x/p#Plato> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/Person> .\n<http://x/p#Plato> <http://www.w3.org/2000/01/rdf-schema#label> "Plato of Athens"@en .\n<http://x/p#Plato> <http://x/taught> <http://x/p#Aristotle> .\nnot a triple\n')
    out = readers.read_import(spark, str(tmp_path / "a.nt"), "rdf")
    assert rows(out.entities.select("id", "name", "entity_type")) == [("Aristotle", "Aristotle", "Resource"), ("Plato", "Plato of Athens", "Person")]
    assert rows(out.relations.select("source", "target", "relation_type")) == [("Plato", "Aristotle", "taught")]
    assert out.rejects.count() == 1
    (tmp_path / "a.graphml").write_text('<graphml><graph><node id="n1"><data key="name">A</data><data key="type">T</data></node><node id="n2"/><edge source="n1" target="n2"><data key="relation">R</data></edge></graph></graphml>')
    out = readers.read_import(spark, str(tmp_path / "a.graphml"), "graphml")
    assert rows(out.entities.select("id", "name", "entity_type")) == [("n1", "A", "T"), ("n2", "n2", "Node")]
    assert rows(out.relations.select("source", "target", "relation_type")) == [("n1", "n2", "R")]
    with pytest.raises(ValueError):
        readers.read_import(spark, "x", "xls")


def test_collection(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("# A")
    (tmp_path / "d/b.txt").write_text("# A")
    got = readers.read_collection(spark, str(tmp_path / "d"))
    assert sorted(r["document_type"] for r in got.collect()) == ["Markdown", "Text"]
    assert readers.duplicate_contents(got, "path", "content").first()["documents"] == 2


def test_workspaces(spark, tmp_path):
    w = Workspaces(spark, f"file://{tmp_path}")
    assert w.names() == []
    w.save("one", {"t": spark.range(3).toDF("id")})
    w.save("one", {"t": spark.range(5).toDF("id")}, "gzip")
    assert w.names() == ["one"] and w.load("one")["t"].count() == 5
    assert w.rollback("one") == 1 and w.load("one")["t"].count() == 3
    w.delete("one")
    with pytest.raises(FileNotFoundError):
        w.load("one")
    with pytest.raises(ValueError):
        w.save("../x", {})


def test_vector_table(spark):
    t = VectorTable(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<double>"))
    t = t.add(spark.createDataFrame([("b", [1.0, 1.0]), ("c", [-1.0, 0.0])], "id string, vector array<double>"))
    t = t.remove(spark.createDataFrame([("c",)], "id string"))
    q = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, query_vector array<double>")
    assert t.count() == 2 and t.search(q, 1).first()["id"] == "b"


def test_delta(spark):
    mk = lambda d: spark.createDataFrame(list(d.items()), "k string, p map<string,string>")
    a = mk({"n1": {"key": "v1"}, "n2": {"key": "v2"}, "n4": {"x": "1", "y": "2"}})
    b = mk({"n1": {"key": "v1"}, "n3": {"key": "v3"}, "n4": {"y": "3", "z": "1"}})
    d = changes.delta(a, b, ["k"], "p")
    got = {r["k"]: r["change"] for r in d.collect()}
    assert got == {"n2": "removed", "n3": "added", "n4": "modified"}
    props = {r["k"]: r["properties"].asDict() for r in d.collect()}["n4"]
    assert props == {"added": ["z"], "removed": ["x"], "changed": ["y"]}
    norm = lambda df: sorted((r["k"], sorted(r["p"].items())) for r in df.collect())
    assert norm(changes.apply_delta(a, b, d, ["k"])) == norm(b)
    assert norm(changes.apply_delta(a, b, d, ["k"], undo=True)) == norm(a)


def test_conflicts(spark):
    a = spark.createDataFrame([(1, "x", 5, 0.9), (2, "y", 5, 0.5)], "k int, v string, t int, c double")
    b = spark.createDataFrame([(1, None, 6, 0.1), (2, "z", 4, 0.7), (3, "n", 1, 0.2)], "k int, v string, t int, c double")
    get = lambda s, **kw: {r["k"]: r["v"] for r in changes.resolve(a, b, ["k"], ["v"], s, **kw).collect()}
    assert get("keep_existing") == {1: "x", 2: "y", 3: "n"}
    assert get("keep_new") == {1: None, 2: "z", 3: "n"}
    assert get("merge") == {1: "x", 2: "z", 3: "n"}
    assert get("latest", time="t") == {1: None, 2: "y", 3: "n"}
    assert get("most_confident", confidence="c") == {1: "x", 2: "z", 3: "n"}
    assert get("", custom=lambda x, y: F.concat_ws("+", x, y)) == {1: "x", 2: "y+z", 3: "n"}
    assert {r["k"]: r["fields"] for r in changes.conflicts(a, b, ["k"], ["v", "t"]).collect()} == {1: ["v", "t"], 2: ["v", "t"]}
    with pytest.raises(ValueError):
        get("coin")


def test_stream_upserts(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "k string, v bigint, n bigint, operation string"
    spark.createDataFrame([("a", 1, 1, "insert"), ("b", 1, 2, "insert")], schema).coalesce(1).write.parquet(f"{src}/1")
    sink = changes.upsert_sink(f"file://{out}", ["k"], ["n"])
    go = lambda: changes.run_available(spark.readStream.schema(schema).parquet(f"{src}/*"), sink, f"{tmp_path}/cp")
    go()
    spark.createDataFrame([("a", 2, 3, "update"), ("b", 1, 4, "delete"), ("c", 5, 5, "insert")], schema).coalesce(1).write.parquet(f"{src}/2")
    go()
    assert rows(changes.read_upserts(spark, f"file://{out}").select("k", "v")) == [("a", 2), ("c", 5)]


def test_as_of(spark):
    left = spark.createDataFrame([("u", 5), ("u", 1), ("w", 9)], "k string, t int")
    right = spark.createDataFrame([("u", 2, "a"), ("u", 5, "b"), ("u", 7, "c")], "k string, t int, v string")
    assert sorted((r["k"], r["t"], r["as_of_v"]) for r in as_of(left, right, ["k"], "t", "t", ["v"]).collect()) == [("u", 1, None), ("u", 5, "b"), ("w", 9, None)]


def test_chunks_cover_text(spark):
    text = "# One\n\nAlpha beta. " * 40 + "\n\n## Two\n\n" + "Wordswithoutend" * 100 + " tail é."
    for cut in (lambda t: chunking.window_cuts(t, 200, 40), lambda t: chunking.hierarchical_cuts(t, 200, 40, 1)):
        pieces = cut(text)
        assert pieces[0][1] == 0 and pieces[-1][2] == len(text)
        assert all(text[a:b] == c and b - a <= 200 for _, a, b, c in pieces)
        assert all(n[1] <= p[2] for p, n in zip(pieces, pieces[1:]))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "   ")], "id int, t string")
    assert {r["id"] for r in chunking.window_chunks(df, "id", "t", 200, 40).collect()} == {1}
    assert {r["title"]: r["level"] for r in chunking.sections(df, "id", "t").where("title = 'Two'").collect()} == {"Two": 2}
    assert len(chunking.summarize("One two three. Four five six seven. Eight.", 25)) <= 25
    tree = chunking.summary_tree(chunking.window_chunks(df, "id", "t", 200, 40), 5, 100)
    assert tree.where("parent is null").count() == 1


def test_entities(spark):
    text = "We met Karin Velikamont and Otto Berg at Torulostad Society of Machine Reading near Port Brufokong. Later Karin Velikamont left."
    m = entities.extract_entities(spark.createDataFrame([("c1", text), ("c2", None)], "id string, t string"), "id", "t")
    got = {(r["name"], r["entity_type"]) for r in m.collect()}
    assert ("Karin Velikamont", "PERSON") in got and ("Port Brufokong", "LOCATION") in got and any(t == "ORGANIZATION" for _, t in got)
    assert all(text[r["start_offset"] : r["end_offset"]] == r["name"] for r in m.collect())
    rel = entities.relations_in_chunks(m.withColumnRenamed("id", "chunk"))
    assert {r["relation_type"] for r in rel.collect()} >= {"KNOWS", "ASSOCIATED_WITH", "LOCATED_IN"}
    e = spark.createDataFrame([("1", "Velikamont Institute", "ORG", 0.9), ("2", "Velikamont Institut", "ORG", 0.5), ("3", "Other", "ORG", 0.5), ("4", None, "ORG", 0.1)], "id string, name string, entity_type string, confidence double")
    got = {r["id"]: r["canonical"] for r in entities.linked_clusters(e).collect()}
    assert got == {"1": "1", "2": "1", "3": "3", "4": "4"}


def test_engine(spark, tmp_path):
    e = Engine(spark, chunk_size=200, overlap=20, dimension=16)
    docs = [("d1", "Plato taught Aristotle in Athens Academy. The philosophy of Plato Aristides is old. " * 4), ("d2", "A river crosses the valley near Port Brufokong, said Otto Berg. " * 4), ("d3", None)]
    e.add_documents(spark.createDataFrame(docs, "id string, content string"))
    stats = {r["table"]: r["rows"] for r in e.statistics().collect()}
    assert stats["documents"] == 2 and stats["chunks"] >= 2 and stats["entities"] >= 1
    q = spark.createDataFrame([("q1", "river valley"), ("q2", "Otto Berg")], "query_id string, query string")
    assert e.search(q, 1).where("query_id = 'q1'").first()["id"].startswith("d2")
    assert e.ask(q, 3).count() == 2
    e.save(f"file://{tmp_path}", "w")
    again = Engine(spark)
    again.load(f"file://{tmp_path}", "w")
    assert again.tables["chunks"].count() == stats["chunks"]
