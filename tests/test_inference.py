from __future__ import annotations

import itertools

from graphmill import models
from graphmill.operators import inference


def test_relation_clusters_are_the_components_of_similar_pairs(spark):
    rows = [("r1", "A", "B", "KNOWS", 0, 10), ("r2", "A", "C", "KNOWS", 5, 15), ("r3", "A", "D", "LIKES", 12, 20), ("r4", "E", "F", "KNOWS", 100, 110), ("r5", "A", "G", "KNOWS", 50, 60), ("r6", "X", "Y", "OWNS", None, None), ("r7", "X", "Z", "HAS", 1, 2), ("r8", "Q", "B", "HAS", 8, 9)]
    df = spark.createDataFrame(rows, "rel_id string, source string, target string, relation_type string, start_time bigint, end_time bigint")

    def similarity(x, y):
        s = 0.5 * (x[3] == y[3]) + 0.3 * (x[1] == y[1] or x[2] == y[2])
        if None not in (x[4], x[5], y[4], y[5]) and min(x[5], y[5]) > max(x[4], y[4]):
            s += 0.2 * (min(x[5], y[5]) - max(x[4], y[4])) / (max(x[5], y[5]) - min(x[4], y[4]))
        return s

    def components(least):
        group = {r[0]: r[0] for r in rows}
        for x, y in itertools.combinations(rows, 2):
            if similarity(x, y) > least + 1e-9:
                a, b = group[x[0]], group[y[0]]
                group = {k: a if v == b else v for k, v in group.items()}
        return {frozenset(k for k in group if group[k] == g) for g in set(group.values())}

    got = {}
    for r in inference.relation_clusters(df).collect():
        got.setdefault((r["level"], r["cluster"]), set()).add(r["rel_id"])
    for level, least in enumerate((0.3, 0.5, 0.8)):
        assert {frozenset(v) for (lv, _), v in got.items() if lv == level} == components(least)
    pairs = {(r["a"], r["b"]): round(r["similarity"], 6) for r in inference.similar_relations(df).collect()}
    assert pairs[("r1", "r2")] == round(0.8 + 0.2 * 5 / 15, 6) and ("r6", "r7") not in pairs


def test_cues_and_matches(spark):
    text = "Karin Berg works for Torul Institute."
    m = spark.createDataFrame([("c", "P_k", "PERSON", 0, 10), ("c", "O_t", "ORGANIZATION", 21, 36)], "chunk string, entity_id string, entity_type string, start_offset bigint, end_offset bigint")
    c = spark.createDataFrame([("c", text)], "chunk string, content string")
    assert [tuple(r) for r in inference.relations_by_cues(m, c).collect()] == [("c", "P_k", "O_t", "WORKS_FOR", 0.8)]
    q = spark.createDataFrame([("q", "machine reading archve")], "query_id string, query string")
    k = spark.createDataFrame([("machine reading",), ("archive",), ("canal",)], "concept string")
    got = {r["concept"]: (round(r["score"], 3), r["how"]) for r in inference.concept_matches(q, k).collect()}
    assert got == {"machine reading": (1.0, "exact"), "archive": (0.857, "fuzzy")}


def test_tuned_weights(spark):
    e = spark.createDataFrame([("a", "b", "X", 1.0), ("b", "c", "Y", 1.0)], "source string, target string, relation_type string, weight double")
    seen = lambda df: {r["relation_type"]: r["weight"] for r in df.collect()}
    tuned, quality = inference.tuned_weights(e, lambda df: min(seen(df)["X"] / 2, 1.0), rounds=20)
    assert quality >= 0.95 and seen(tuned)["Y"] == 1.0


def test_models(spark):
    asked = spark.createDataFrame([("q1", "who founded Torul"), ("q2", "nothing known")], "query_id string, query string")
    results = spark.createDataFrame([("q1", "d1", 0.9, "Karin founded Torul."), ("q1", "d2", 0.8, "Rivers flow.")], "query_id string, id string, score double, content string")
    got = {r["query_id"]: r for r in models.checked(models.answers(asked, results)).collect()}
    assert got["q1"]["answer"] == "Karin founded Torul." and got["q1"]["accepted"]
    assert not got["q2"]["accepted"] and "no sources" in got["q2"]["problems"]
    chunks = spark.createDataFrame([("c1", "They met Karin Velikamont there."), ("c2", None)], "id string, content string")
    assert {r["name"] for r in models.gleaned(chunks, "id", "content", rounds=2).collect()} >= {"Karin Velikamont"}
    f = models.Functions({"entities": spark.createDataFrame([("P_k", "Karin")], "id string, name string"), "relations": spark.createDataFrame([("P_k", "O_t")], "source string, target string")}, 2)
    assert f.call("graph_search", name="kar").first()["id"] == "P_k"
    assert {r["node"] for r in f.call("entity_expand", entity="P_k", depth=1).collect()} == {"P_k", "O_t"}
    try:
        f.call("graph_search", name="x")
        raise AssertionError("the limit of calls was not kept")
    except RuntimeError:
        pass
