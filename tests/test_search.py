from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphmill.functions import measures, similarity, text, vector
from graphmill.operators import search
from graphmill.plans import questions
from graphmill.plans.query_op import EntityScan, Filter, Graph, Join, Limit, Neighbors, Union, cost, explain, optimize


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_bm25(spark):
    d = spark.createDataFrame([("doc1", "The quick brown fox jumps over the lazy dog"), ("doc2", "A fast brown animal leaps across a sleeping canine"), ("doc3", "The weather is nice today")], "id string, content string")
    q = spark.createDataFrame([("q", "brown fox")], "query_id string, query string")
    got = {r["id"]: r["score"] for r in search.bm25(d, q, "id", "content").collect()}
    assert got == pytest.approx({"doc1": 0.868616, "doc2": 0.271976}, abs=1e-5)
    assert search.bm25(d.limit(0), q, "id", "content").count() == 0
    assert one(spark, text.search_tokens(F.lit("The quick, brown fox!"))) == ["quick", "brown", "fox"]


def test_vectors(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, vector.cosine(a(1, 0), a(0, 1))) == 0.0
    assert one(spark, vector.cosine(a(1, 2), a(2, 4))) == pytest.approx(1.0)
    assert one(spark, vector.cosine(a(1, 2), a(1, 2, 3))) == 0.0
    assert one(spark, vector.cosine(a(0, 0), a(1, 2))) == 0.0
    assert one(spark, vector.euclidean(a(0, 0), a(3, 4))) == 5.0
    assert one(spark, vector.unit(a(3, 4))) == pytest.approx([0.6, 0.8])
    words = spark.createDataFrame([(["b", "a"],), (["a", "b"],), ([],), (None,)], "w array<string>")
    got = [r[0] for r in words.select(vector.hash_embedding("w", 8)).collect()]
    assert got[0] == pytest.approx(got[1]) and sum(x * x for x in got[0]) == pytest.approx(1.0) and got[2] == [0.0] * 8 == got[3]


def test_knn_ties_and_few(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0])], "id int, v array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<double>")
    assert [r["id"] for r in search.knn(v, q, 10, "id", "v").orderBy("rank").collect()] == [1, 2, 3]


def test_fusion(spark):
    mk = lambda rows: spark.createDataFrame([("q", i, s) for i, s in rows], "query_id string, id string, score double")
    a, b = mk([("x", 0.9), ("y", 0.5)]), mk([("y", 3.0), ("z", 1.0)])
    got = {r["id"]: r["score"] for r in search.fuse(a, b).collect()}
    assert got == pytest.approx({"x": 0.7 / 61, "y": 0.7 / 62 + 0.3 / 61, "z": 0.3 / 62})
    assert [r["id"] for r in search.merge_lists(a, b).orderBy("rank").collect()] == ["x", "y", "z"]
    assert [r["id"] for r in search.merge_lists(a, b, "low_first").orderBy("rank").collect()] == ["y", "z", "x"]


def test_diverse(spark):
    rows = [("q", "a", 0.5, ["e1"]), ("q", "b", 0.45, ["e1"]), ("q", "c", 0.4, ["e1"]), ("q", "d", 0.3, ["e2"])]
    r = spark.createDataFrame(rows, "query_id string, id string, score double, entities array<string>")
    assert [x["id"] for x in search.diverse(r, 3).collect()] == ["a", "b", "d"]


def test_measures(spark):
    assert one(spark, measures.f1(F.lit("a b c"), F.lit("a b d"))) == pytest.approx(2 / 3)
    assert one(spark, measures.bleu4(F.lit("a b c d e"), F.lit("a b c d e"))) == pytest.approx(1.0)
    assert one(spark, measures.bleu4(F.lit("a b"), F.lit("a b"))) == 0.0
    assert one(spark, measures.rouge_l(F.lit("a b c"), F.lit("a x c"))) == pytest.approx(2 / 3)
    assert one(spark, measures.dynamic_weight(F.lit(0.8), matches=F.lit(1))) == pytest.approx(0.92)
    assert one(spark, measures.dynamic_weight(F.lit(1.0), strength=F.lit(0.95))) == pytest.approx(1.19)
    year = 365 * 24 * 3600
    for years, want in ((5, 0.3), (20, 0.3 * 0.75), (100, 0.1 * (1 - 50 / 150)), (1000, 0.05)):
        assert one(spark, measures.temporal_relevance(F.lit(-years * year), F.lit(-years * year), F.lit(0))) == pytest.approx(want)
    assert one(spark, measures.floor_percentile(F.array(*map(F.lit, (5, 1, 4, 2, 3))), 0.5)) == 3


def test_similarity(spark):
    assert one(spark, similarity.jaro_winkler(F.lit("MARTHA"), F.lit("MARHTA"))) == pytest.approx(0.961111, abs=1e-6)
    assert one(spark, similarity.soundex_steady(F.lit("Babab"))) == "B000"
    assert one(spark, similarity.levenshtein_similarity(F.lit("kitten"), F.lit("sitting"), 2)) == 0.0
    assert one(spark, similarity.link_similarity(F.lit("Foo, Inc."), F.lit("foo inc"))) == 1.0


def test_text(spark):
    assert one(spark, text.roman_value(F.lit("MCMXCIV"))) == 1994
    assert one(spark, text.roman_value(F.lit("ABC"))) is None
    assert one(spark, text.fact_time(F.lit("in 399 BC"))) == (-399 - 1970) * 365 * 86400
    assert one(spark, text.json_in_markdown(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'
    assert one(spark, text.section_number(F.lit("2.1 Methods"))) == "2.1"
    assert one(spark, text.heading_level(F.lit("### x"))) == 3
    assert one(spark, text.detect_language(F.lit("año"))) == "es"
    assert one(spark, text.word_count(F.lit("  "))) == 0
    assert one(spark, text.html_headings(F.lit("<h1>A <b>b</b></h1><p>x</p><H2 class='c'>C</H2>"))) == ["A b", "C"]


def test_algebra(spark):
    ents = spark.createDataFrame([("a", "P", "x"), ("b", "P", "y"), ("c", "O", "x")], "entity_id string, entity_type string, k string")
    rel = spark.createDataFrame([("a", "c", "IN"), ("b", "c", "IN"), ("c", "b", "HAS")], "source string, target string, relation_type string")
    g = Graph(ents, rel)
    ids = lambda op: sorted(r["entity_id"] for r in g.run(op).collect())
    assert ids(EntityScan("P")) == ["a", "b"]
    assert ids(Filter("k", "x", EntityScan("P"))) == ["a"]
    assert ids(Join(EntityScan("P"), Filter("k", "x"))) == ["a"]
    assert ids(Neighbors(EntityScan("P"), "IN")) == ["c"]
    assert ids(Neighbors(Filter("k", "y"), None, 2)) == ["b", "c"]
    assert ids(Union(EntityScan("P"), Filter("k", "x"))) == ["a", "b", "c"]
    assert ids(Limit(Union(EntityScan("P"), EntityScan("O")), 2)) == ["a", "b"]
    assert g.run(Join(EntityScan("P"), EntityScan("O"), "cross")).count() == 2
    stats = {"entities": {"PERSON": 100, "ORGANIZATION": 50, "LOCATION": 30}, "total": 180, "average_degree": 1.56}
    assert cost(EntityScan("PERSON"), stats) == (100, 100.0)
    assert cost(Join(EntityScan("PERSON"), EntityScan("ORGANIZATION")), stats) == (70, 5150.0)
    chain = Join(Join(EntityScan("PERSON"), EntityScan("ORGANIZATION")), EntityScan("LOCATION"))
    assert cost(optimize(chain, stats), stats)[1] < cost(chain, stats)[1]
    assert optimize(Join(EntityScan("PERSON"), EntityScan("LOCATION"), "left"), stats).left == EntityScan("PERSON")
    assert "rows=70 cost=5150.0" in explain(Join(EntityScan("PERSON"), EntityScan("ORGANIZATION")), stats)


def test_questions(spark):
    q = spark.createDataFrame([("1", "Overview of the theory"), ("2", "Plato and Socrates compare"), ("3", "what happened"), ("4", None)], "id string, text string")
    names = spark.createDataFrame([("Plato",), ("Socrates",)], "name string")
    got = {r["id"]: (r["query_type"], r["intent"], r["key_entities"]) for r in questions.analyse(q, "id", "text", names).collect()}
    assert got["1"] == ("Conceptual", "Overview", [])
    assert got["2"] == ("Relationship", "Comparative", ["Plato", "Socrates"])
    assert got["3"][0] == "Exploratory"
    assert questions.branch_weights("Conceptual", "Overview") == (0.2, 0.2, 0.6)
    assert questions.parse("How is Plato related to Socrates?").arguments == ("Plato", "Socrates")
    assert questions.parse("nonsense") is None
    assert questions.decompose("Who was Plato and what did Socrates teach?") == ["Who was Plato", "what did Socrates teach"]
    assert questions.rewrite("Big Dog", {"dog": ["hound"]}) == "big dog hound"


def test_hashed_embeddings_of_whole_texts(spark, tmp_path):
    from graphmill.catalog.search import hashed_embeddings

    same = "word " * 20
    spark.createDataFrame([(1, same + "apple"), (2, same + "river stone")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["embedding"] for r in hashed_embeddings(spark, str(tmp_path)).collect()}
    assert got[1] != got[2]
