from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphmill.llm import pairs, vectors
from graphmill.llm import queries as Q
from graphmill.llm.runs import pairs_in_runs
from graphmill.session import table

SF = "/root/testdata/sf0.01"


def exact(items, k, least):
    ids = sorted(items)
    m = np.stack([items[i] for i in ids]).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    out = set()
    for r, i in enumerate(ids):
        best = np.lexsort((np.arange(len(ids)), -np.round(s[r], 12)))[:k]
        out |= {(i, ids[j]) for j in best if s[r, j] >= least}
    return out


def test_recall_on_chunks(spark):
    rows = table(spark, SF, "text_chunks").select("id", "embedding").collect()
    items = {}
    for r in rows:
        e = r["embedding"]
        if e is not None and len(e) == 96 and not any(x is None or x != x for x in e) and any(e):
            items[r["id"]] = np.array(e, np.float32)
    want = {tuple(sorted(p)) for p in exact(items, 5, 0.8)}
    got = {tuple(r) for r in Q.p2_found(spark, SF).collect()}
    assert len(want & got) >= 0.95 * len(want)
    assert len(got - want) <= 0.02 * len(want)


def test_copies_ties_and_unusable(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=8)
    rows = [(f"c{i:03}", base.tolist()) for i in range(100)] + [(f"n{i}", (base + r.normal(size=8) * 0.05).tolist()) for i in range(5)]
    bad = [("null", None), ("short", [1.0]), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("hole", [1.0, None, *[1.0] * 6]), ("inf", [float("inf")] * 8), (None, base.tolist())]
    df = spark.createDataFrame(rows + rows[:3] + bad, "id string, embedding array<double>").withColumn("n", F.lit(1)).withColumn("h", F.lit(1)).withColumn("v", F.lit(1))
    got = vectors.nearest(df, 3, dim=8)
    near = {i: [x["neighbour"] for x in sorted(g, key=lambda x: x["rank"])] for i, g in itertools.groupby(sorted(got.collect(), key=lambda x: x["id"]), key=lambda x: x["id"])}
    assert near["c050"] == ["c000", "c001", "c002"] and near["c001"] == ["c000", "c002", "c003"]
    assert set(near) <= {i for i, _ in rows}
    assert near["n0"] == ["c000", "c001", "c002"] or set(near["n0"]) & {f"n{i}" for i in range(5)}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(f"v{i}", [1.0, float(i)]) for i in range(n)], "id string, embedding array<double>")
    assert vectors.nearest(df, 5, dim=2).count() == (2 if n == 2 else 0)


def test_runs_across_batches():
    key = np.repeat([1, 2, 3, 4], [3, 7, 1, 5])
    cols = [pa.array([*key, None]), pa.array(np.arange(17))]
    emit = lambda c, i, j: pa.RecordBatch.from_arrays([pa.array(c[1][i]), pa.array(c[1][j])], ["a", "b"])
    alone = lambda c: pa.RecordBatch.from_arrays([pa.array(np.full(len(c[1]), -1)), pa.array(c[1])], ["a", "b"])
    for limit in (10, 5, 2):
        length = {k: int((key == k).sum()) for k in key}
        want = {(a, b) for a in range(16) for b in range(a + 1, 16) if key[a] == key[b] and length[key[a]] <= limit} | {(-1, a) for a in range(16) if length[key[a]] > limit} | {(-1, 16)}
        for size in (1, 2, 5, 17):
            batches = [pa.RecordBatch.from_arrays([c[k : k + size] for c in cols], ["k", "n"]) for k in range(0, 17, size)]
            got = [t for b in pairs_in_runs(iter(batches), emit, alone, limit) for t in zip(*(c.to_pylist() for c in b.columns))]
            assert len(got) == len(set(got)) and set(got) == want


def test_a_crowd_is_indexed_again(spark, monkeypatch):
    """Vectors of one crowd are in lists beyond the limit until pivots from among them tell them apart."""
    monkeypatch.setattr(vectors, "LIMIT", 40)
    r = np.random.default_rng(8)
    centre = r.normal(size=16)
    items = {f"c{i:04}": centre + r.normal(size=16) * 0.2 for i in range(600)} | {f"o{i:04}": r.normal(size=16) for i in range(600)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in items.items()], "id string, embedding array<float>")
    got = {(x["id"], x["neighbour"]) for x in vectors.nearest(df, 5, dim=16, least=0.8, max_bits_apart=128).collect()}
    want = exact(items, 5, 0.8)
    assert len(got & want) >= 0.9 * len(want)


def test_footrule_leaves_candidates_out(spark):
    df = table(spark, SF, "text_chunks")
    nodes = vectors.usable(df).dropDuplicates(["v"]).withColumn("h", F.xxhash64("v")).withColumn("n", F.monotonically_increasing_id())
    from graphmill.session import materialize

    nodes = materialize(nodes, "nodes")
    size = nodes.count()
    some = [sum(c.count() for c in vectors._candidates(nodes, size, vectors.MAX_BITS_APART, cut, 1)) for cut in (vectors.MAX_FOOTRULE, 1000.0)]
    assert 0 < some[0] < some[1]


def frame(spark, baskets):
    return spark.createDataFrame([(str(i), b) for i, b in enumerate(baskets)], "id string, items array<string>").withColumn("a", F.lit("x")).withColumn("n", F.lit(3))


def counts(t):
    return {(r["a"], r["b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in t.scores().collect()}


def plain(baskets):
    sets = [s for s in ({x for x in b if x is not None} for b in baskets if b is not None) if s]
    one = lambda *x: sum(set(x) <= s for s in sets)
    items = sorted(set().union(*sets)) if sets else []
    return {(a, b): (one(a, b), one(a), one(b), len(sets)) for a, b in itertools.combinations(items, 2) if one(a, b)}


def test_pair_table_follows_changes(spark):
    r = np.random.default_rng(1)
    make = lambda n: [[str(x) for x in r.integers(0, 12, r.integers(0, 6))] for _ in range(n)]
    first = [*make(60), None, [], [None], ["1", "1", None, "2"], ["B", "b", " b"]]
    table_ = pairs.PairTable(spark, buckets=4)
    table_.apply(after=pairs.baskets(frame(spark, first), "id", "items"))
    assert counts(table_) == plain(first)
    gone, came = first[:10], make(5)
    table_.apply(after=pairs.baskets(frame(spark, came), "id", "items"), before=pairs.baskets(frame(spark, gone), "id", "items"))
    assert counts(table_) == plain(first[10:] + came)
    some = spark.createDataFrame([("3",), ("B",)], "a string")
    assert {(r["a"], r["b"]) for r in table_.scores(items=some).collect()} == {p for p in plain(first[10:] + came) if {"3", "B"} & set(p)}


def test_pair_table_is_opened_again(spark):
    """A new object on the path knows the counts, merges a change, rewrites the buckets it touches and drops what it replaced."""
    r = np.random.default_rng(2)
    first = [[str(x) for x in r.integers(0, 40, 5)] for _ in range(200)]
    t = pairs.PairTable(spark, buckets=64)
    t.apply(after=pairs.baskets(frame(spark, first), "id", "items"))
    before = t.scores().toPandas()
    again = pairs.PairTable(spark, t.path)
    assert again.buckets == 64 and counts(again) == plain(first)
    kept = dict(again.at["pairs"])
    changed = again.apply(after=pairs.baskets(frame(spark, [["1", "2"], ["new", "2"]]), "id", "items"), before=pairs.baskets(frame(spark, first[:1]), "id", "items"))
    want = plain(first[1:] + [["1", "2"], ["new", "2"]])
    assert counts(again) == want
    assert sum(kept[k] == p for k, p in again.at["pairs"].items() if k in kept) >= 40
    assert {x["a"] for x in changed.collect()} == {"1", "2", "new", *first[0]}
    up = again.rescored(spark.createDataFrame(before), changed)
    assert {(x["a"], x["b"]): (x["n_ab"], x["n_a"], x["n_b"], x["n"]) for x in up.collect()} == want
    third = pairs.PairTable(spark, t.path)
    third.apply(after=pairs.baskets(frame(spark, [["x", "y"]]), "id", "items"))
    assert counts(pairs.PairTable(spark, t.path)) == plain(first[1:] + [["1", "2"], ["new", "2"], ["x", "y"]])
    folders = set(third._list(f"{t.path}/pairs/v1"))
    assert not {p for k, p in kept.items() if k not in third.at["pairs"] or third.at["pairs"][k] != p} & {f"pairs/v1/{f}" for f in folders}


def test_buckets_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(pairs, "ROWS_A_BUCKET", 10)
    monkeypatch.setattr(pairs, "FEWEST_BUCKETS", 1)
    make = lambda k, n: [[f"i{k + j}", f"i{k + j + 1}", f"i{k + j + 2}"] for j in range(n)]
    t = pairs.PairTable(spark)
    t.apply(after=pairs.baskets(frame(spark, make(0, 5)), "id", "items"))
    assert t.buckets == 2
    t.apply(after=pairs.baskets(frame(spark, make(5, 60)), "id", "items"))
    assert t.buckets == 20 and counts(t) == plain(make(0, 65))


def test_large_basket_and_empty(spark):
    big = [[f"i{k:04}" for k in range(pairs.BLOCK * 2 + 5)], ["i0000", "i0300"]]
    t = pairs.PairTable(spark)
    t.apply(after=pairs.baskets(frame(spark, big), "id", "items"))
    assert counts(t) == plain(big)
    none = pairs.PairTable(spark)
    none.apply(after=pairs.baskets(frame(spark, big).limit(0), "id", "items"))
    assert none.scores().count() == 0


def test_lift_limit_leaves_frequent_items_out(spark):
    baskets = [["all", f"x{i % 20}", f"y{i % 20}"] for i in range(200)]
    t = pairs.PairTable(spark)
    t.apply(after=pairs.baskets(frame(spark, baskets), "id", "items"))
    want = {p for p, (ab, a, b, n) in plain(baskets).items() if ab >= 4 and ab * n >= 8 * a * b}
    assert {(r["a"], r["b"]) for r in t.scores(4, 8.0).collect()} == want and want
