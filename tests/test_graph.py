from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphmill.operators import graph, temporal
from graphmill.operators.components import connected_components


@pytest.fixture(scope="module")
def square(spark):
    rows = [("A", "B", 1.0), ("A", "C", 1.0), ("B", "C", 1.0), ("B", "D", 1.0), ("C", "D", 1.0)]
    return spark.createDataFrame(rows, "source string, target string, weight double")


def as_dict(df, key="node", value=None):
    value = value or [c for c in df.columns if c != key][0]
    return {r[key]: r[value] for r in df.collect()}


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_shape(square):
    row = graph.shape(square).first()
    assert (row["nodes"], row["edges"]) == (4, 5)
    assert row["density"] == pytest.approx(0.833333, abs=1e-6)
    assert as_dict(graph.degrees(square), value="centrality") == pytest.approx({"A": 2 / 3, "B": 1.0, "C": 1.0, "D": 2 / 3})
    assert graph.clustering(square).first()[0] == pytest.approx(0.833333, abs=1e-6)
    assert graph.internal_edge_ratio(square).first()[0] == pytest.approx(1.25)


def test_paths(spark, square):
    d = graph.shortest_distances(square, nodes(spark, "A"))
    assert as_dict(d, "node", "distance") == {"A": 0.0, "B": 1.0, "C": 1.0, "D": 2.0}
    assert as_dict(graph.closeness(square, nodes(spark, "A", "B"))) == pytest.approx({"A": 0.75, "B": 1.0})
    between = as_dict(graph.betweenness(square, nodes(spark, "A", "B", "C", "D")))
    assert between["B"] + between["C"] > 0 and between["B"] >= between["A"]
    assert sorted(r["path"] for r in graph.simple_paths(square, "A", "D", 2, "both").collect()) == [["A", "B", "D"], ["A", "C", "D"]]


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("z", "z"), ("c", "a"), ("a", "b"), (None, "q"), ("q", None)], "src string, dst string")
    got = as_dict(connected_components(e))
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(e.limit(0)).count() == 0


def test_reach(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "D")], "source string, target string")
    assert as_dict(graph.reach(e, nodes(spark, "A"), 3)) == {"A": 0, "B": 1, "D": 1, "C": 2}
    assert {r["node"] for r in graph.focused_subgraph(e, nodes(spark, "A"), 1)[0].collect()} == {"A", "B", "D"}
    assert as_dict(graph.reach(e, nodes(spark, "C"), 3, "out")) == {"C": 0}


@pytest.mark.parametrize(
    ("base", "seed", "want"),
    [
        ("uniform", None, {"A": 0.197580, "B": 0.281551, "C": 0.520869}),
        ("zero", "A", {"A": 0.282045, "B": 0.251914, "C": 0.466041}),
        ("uniform", "A", {"A": 0.231366, "B": 0.269696, "C": 0.498938}),
    ],
)
def test_pagerank(spark, base, seed, want):
    e = spark.createDataFrame([("A", "B", 1.0), ("A", "C", 1.0), ("B", "C", 1.0)], "source string, target string, weight double")
    s = spark.createDataFrame([(seed, 1.0)], "node string, weight double") if seed else None
    got = as_dict(graph.pagerank(e, s, iterations=60, tolerance=1e-7, reset_base=base))
    assert got == pytest.approx(want, abs=2e-5)
    assert sum(got.values()) == pytest.approx(1.0)


def test_communities(spark):
    cliques = [(f"{g}{i}", f"{g}{j}") for g in "xy" for i in range(5) for j in range(i)] + [("x0", "y0")]
    e = spark.createDataFrame(cliques, "source string, target string")
    label = graph.communities(e)
    got = as_dict(label)
    assert len({got[f"x{i}"] for i in range(5)}) == 1 and len({got[f"y{i}"] for i in range(5)}) == 1 and got["x0"] != got["y0"]
    assert graph.modularity(e, label).first()[0] > 0.4


def test_temporal(spark):
    rows = [("A", "B", "knows", 100, 100, 200), ("B", "C", "knows", 150, 150, 250), ("A", "C", "knows", 200, 200, 300), ("D", "A", "met", 160, None, None)]
    e = spark.createDataFrame(rows, "source string, target string, edge_type string, timestamp bigint, start_time bigint, end_time bigint")
    assert temporal.snapshot(e, 150).count() == 2
    assert temporal.snapshot(e, 160).count() == 3
    assert temporal.snapshot(e, 100, 200).count() == 4
    w = {r["window_start"]: (r["nodes"], r["edges"]) for r in temporal.evolution(e, 100, 300, 100).collect()}
    assert w == {100: (4, 4), 200: (3, 3)}
    churn = as_dict(temporal.churn(temporal.snapshot(e, 100, 120), temporal.snapshot(e, 260, 300)))
    assert churn == {"A": "stable", "B": "removed", "C": "added"}


def test_causal_order(spark):
    rows = [("A", "B", "caused", 0.9, "Caused", 200, 0.8), ("B", "C", "led_to", 0.8, None, 100, None), ("B", "C", "likes", 0.8, None, 300, None)]
    r = spark.createDataFrame(rows, "source string, target string, relation_type string, confidence double, temporal_type string, start_time bigint, causal_strength double")
    assert temporal.causal_chains(r, "A", "C", 3).count() == 0
    one = temporal.causal_chains(r, "A", "C", 3, in_order=False).first()
    assert one["confidence"] == pytest.approx(0.9 * 0.9 * 0.8 * 0.7)


def test_walks_follow_edges(spark, square):
    edges = {(r["source"], r["target"]) for r in graph.oriented(square).collect()}
    walks = graph.random_walks(square, 6, 2, 0.25, 4.0).collect()
    assert len(walks) == 8
    assert all((a, b) in edges for w in walks for a, b in zip(w["path"], w["path"][1:]))
