from __future__ import annotations

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.functions import text
from graphmill.models import Functions, contextualised, synthesized
from graphmill.operators import baskets, chunking, entities, graph, quality, retrieval, search
from graphmill.operators.bloom import Bloom
from graphmill.streaming import changes


def test_bloom_never_denies_a_member(spark):
    keys = spark.range(0, 20_000, 2).withColumnRenamed("id", "k")
    b = Bloom.of(keys, "k")
    every = spark.range(0, 20_000).withColumnRenamed("id", "k").unionByName(spark.createDataFrame([(None,)], "k bigint"))
    got = {r[0] for r in b.admit(every.withColumn("x", F.lit(1)).select("x", "k"), "k").select("k").collect()}
    assert set(range(0, 20_000, 2)) <= got and None not in got and len(got) < 10_300
    none = Bloom.of(keys.limit(0), "k")
    assert none.admit(every, "k").count() == 0
    crowded = Bloom(10, 4, np.full(128, 255, np.uint8))
    assert crowded.contains(np.arange(-50, 50)).all()


def test_pairs_of_small_large_and_odd_baskets(spark):
    size = 2 * baskets.BLOCK + 37
    rows = [("big", f"i{k:04}") for k in range(size)] + [("small", x) for x in "abc"] + [("one", "a"), (None, "a"), ("small", None)]
    df = spark.createDataFrame(rows, "basket string, item string").withColumn("w", F.length("item"))
    got = [(r["basket"], r["a"], r["b"], r["w_a"], r["w_b"]) for r in baskets.pairs(df, "basket", "item", "w").collect()]
    want = {("big", f"i{a:04}", f"i{b:04}", 5, 5) for a, b in itertools.combinations(range(size), 2)} | {("small", a, b, 1, 1) for a, b in itertools.combinations("abc", 2)}
    assert len(got) == len(want) and set(got) == want
    assert baskets.pairs(df.limit(0), "basket", "item").count() == 0


def test_hot_words_do_not_lose_alike_names(spark):
    names = [f"University of {x}{y}stead" for x in ("Bra", "Dro", "Gul") for y in ("mi", "ko", "lu")] + ["University of Brakostead ", "Univresity of Gullustead", None]
    e = spark.createDataFrame([(f"e{i:02}", n, "ORG") for i, n in enumerate(names)], "id string, name string, entity_type string")
    free = {(r["a"], r["b"]) for r in entities.link_pairs(e, 0.95).collect()}
    tight = {(r["a"], r["b"]) for r in entities.link_pairs(e, 0.95, hot=3).collect()}
    assert tight == free and len(free) >= 2


def test_clusters_hold_all_alike_names(spark):
    # alike without a common word, sound or third letter; one type only; blank, missing and repeated names
    names = ["Supplier#000000001", "Supxlier#000000001", "supplier 000000001", "Anna Maria Berg", "Berg, Anna Maria", "Bregenz Valley Archive Society", "Bregenz Vallye Archive Society", "Otto", "Kim", "#", "!?", None, None]
    rows = [(i, n, "ORG", 0.5) for i, n in enumerate(names)] + [(100 + i, n, "P", 0.5) for i, n in enumerate(names)] + [(7, "Kim", "ORG", 0.5), (200, "Otto", None, 0.5)]
    e = spark.createDataFrame(rows, "id long, name string, entity_type string, confidence double")
    for least in (0.97, 0.85):
        x, y = (e.where("name is not null").select(F.col("id").alias(i), F.col("name").alias(n), "entity_type") for i, n in (("a", "na"), ("b", "nb")))
        pairs = x.join(y, "entity_type").select("a", "b", entities.link_similarity("na", "nb").alias("s")).where(F.col("s") >= least).collect()
        want = {r[0]: r[0] for r in rows}
        for _ in rows:
            for r in pairs:
                want[r["a"]] = want[r["b"]] = min(want[r["a"]], want[r["b"]])
        got = {(r["id"], r["cluster"]) for r in entities.linked_clusters(e, least).collect()}
        assert got == set(want.items()) and want[1] == 0 and want[8] == 7 and want[100] == 100


def test_alike_names_share_a_key():
    numbered = [f"supplier{i:09}" for i in range(0, 3000, 7)]
    odd = ["", "é", "à", "a b", "b a", "anna maria berg", "berg anna maria", "anna marie berg", "anan maria berg", "university of brakostead", "univresity of brakostead", "university of brakosteads"]
    for least, names in ((0.97, numbered + odd), (0.85, numbered[:40] + odd), (0.4, odd)):
        lengths = {len(n): max(len(m.encode()) for m in names if len(m) == len(n)) for n in names}
        keys = {n: entities.spelling_keys(n, lengths, {len(set(n.split())) for n in names}, least) for n in names}
        assert not [(a, b) for a, b in itertools.combinations(names, 2) if entities.alike(a, b, least) and not keys[a] & keys[b]]
    assert entities.alike("supplier000000001", "supplier000000010", 0.97) and not entities.alike("supplier000000001", "supplier000012345", 0.97)


def test_numbered_names_are_compared_with_few():
    names = [f"supplier{i:09}" for i in range(6000)]
    baskets_of = {}
    for n in names:
        for k in entities.spelling_keys(n, {17: 17}, {1}, 0.97):
            baskets_of[k] = baskets_of.get(k, 0) + 1
    assert sum(n * (n - 1) // 2 for n in baskets_of.values()) < 100 * len(names)  # all pairs: 3,000 a name


def test_strategies_of_linking(spark):
    rows = [("a", "Anna Berg", "P", [1.0, 0.0]), ("b", "anna berg", "P", [0.0, 1.0]), ("c", "Annna Berg", "P", [-1.0, 0.0]), ("d", "Zed", "P", [0.99, 0.01]), ("e", "Anna Berg", "ORG", [0.0, -1.0])]
    e = spark.createDataFrame(rows, "id string, name string, entity_type string, embedding array<double>").withColumn("confidence", F.lit(0.9))
    group = lambda how: {r["id"]: r["cluster"] for r in entities.linked(e, how).collect()}
    assert group("exact") == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    assert group("fuzzy")["c"] == group("fuzzy")["a"] and group("semantic")["d"] == "a" and group("semantic")["b"] == "b"
    assert {group("hybrid")[i] for i in "abcd"} == {"a"}
    with pytest.raises(ValueError):
        entities.linked(e, "guess")


def test_facts(spark):
    rows = [("c1", "Socrates", "taught", "Plato", "in 380 BC", 0.9), ("c1", "the war", "Caused", "Thailand", "in 1990", 0.5), ("c2", "Socrates", "knew", "item 7", None, 0.8), ("c2", None, "x", "y", None, 0.1)]
    f = spark.createDataFrame(rows, "chunk string, subject string, predicate string, object string, temporal_marker string, confidence double")
    ents, rel = entities.facts_to_graph(f)
    kind = {r["id"]: r["entity_type"] for r in ents.collect()}
    assert kind == {"socrates": "PERSON", "plato": "PERSON", "the_war": "CONCEPT", "thailand": "LOCATION", "item_7": "DATE"}
    by = {r["source"] + ">" + r["target"]: r for r in rel.collect()}
    assert by["socrates>plato"]["start_time"] < 0 and by["the_war>thailand"]["temporal_type"] == "Caused" and by["the_war>thailand"]["causal_strength"] == 0.5
    assert by["socrates>item_7"]["start_time"] is None


def test_triples_by_model(spark):
    t = spark.createDataFrame([("A", "r", "B", "c"), ("A", "r", None, "c"), ("A", "r", "Z", "gone")], "source string, relation_type string, target string, chunk string")
    c = spark.createDataFrame([("c", "a met b")], "chunk string, content string")
    assert sorted((r["reason"] or "") for r in entities.validated_triples(t, c).collect()) == ["", "no end", "source not in text"]
    no = entities.validated_triples(t, c, lambda ps: ["no"] * len(ps)).collect()
    assert not any(r["valid"] for r in no)


def test_relations_follow_the_text(spark):
    m = spark.createDataFrame([("c1", "p", "PERSON"), ("c1", "o", "ORGANIZATION"), ("c2", "p", "PERSON"), ("c2", "o", "ORGANIZATION"), ("c2", "q", "PERSON")], "chunk string, entity_id string, entity_type string")
    c = spark.createDataFrame([("c1", "p works for o"), ("c2", "CEO, married")], "chunk string, content string")
    got = {(r["source"], r["target"], r["relation_type"]) for r in entities.relations_in_chunks(m, c).collect()}
    assert got == {("o", "p", "WORKS_FOR"), ("o", "p", "LEADS"), ("p", "q", "MARRIED_TO"), ("o", "q", "LEADS")}
    assert {r["relation_type"] for r in entities.relations_in_chunks(m).collect()} == {"ASSOCIATED_WITH", "KNOWS"}


def test_sentence_ends_and_abbreviations(spark):
    t = "Dr. Berg met Mr. Oak. He paid 3.5 coins, e.g. two! Why?"
    assert spark.createDataFrame([(t,), (None,), ("",), ("A. Smith came.",)], "t string").select(chunking.sentence_ends("t")).collect() == [(3,), (0,), (0,), (1,)]
    assert chunking.end_before(t, 0, len(t) - 5) == t.index("two!") + 4
    assert chunking.end_before(t, 0, 5) is None and chunking.end_before("", 0, 0) is None


@pytest.mark.parametrize("name", sorted(chunking.STRATEGIES))
def test_chunks_are_slices_in_order(name):
    cut = chunking.STRATEGIES[name]
    texts = ["", " \n ", "one", "A b. " * 400, ("Para one here.\n\n" + "Long sentence of words. " * 60 + "\n\nShort.\n\n") * 3, "x" * 5000, "日本語。" * 50]
    for t in texts:
        out = cut(t)
        assert [c[0] for c in out] == list(range(len(out)))
        assert all(c[3] == t[c[1] : c[2]] and c[2] > c[1] for c in out)
        assert all(a[1] < b[1] for a, b in zip(out, out[1:]))
    assert cut("One sentence here. And a second one follows it, which is long enough to be kept by all.")


def test_sizes_are_kept():
    t = "\n\n".join(["tiny", "A sentence of some words here. " * 40, "small", "B sentence of words. " * 5])
    out = chunking.sized_cuts(t, 50, 300)
    assert all(c[2] - c[1] <= 300 for c in out[:-2]) and "small" in out[-2][3] and out[0][3].startswith("tiny")


def test_coherence_by_hand():
    a, b = {"x": 1}, {"y": 1}
    from collections import Counter

    v = [Counter(a), Counter(a), Counter(b), Counter(b)]
    score = chunking.Coherence(v, 0.7, 3)
    assert score(0, 1) == 1.0 and score(0, 2) == pytest.approx(1.0) and score(0, 4) == pytest.approx(2 / 3)
    wide = chunking.Coherence(v, 0.5, 5)
    assert wide(0, 4) == pytest.approx(0.5 * 2 / 3 + 0.5 * 2 / 5)
    cuts = chunking.coherent_cuts("Cats cats cats. Cats cats. Dogs dogs. Dogs dogs dogs.")
    assert [c[3] for c in cuts] == ["Cats cats cats. Cats cats. ", "Dogs dogs. Dogs dogs dogs."]


def test_word_classes(spark):
    row = spark.createDataFrame([("The quick Berlin trains slowly crossed 3 wonderful bridges .",)], "t string").select(text.tagged("t").alias("t"), text.noun_phrases("t").alias("p")).first()
    assert [x["tag"] for x in row["t"]] == ["Determiner", "Noun", "ProperNoun", "NounPlural", "Adverb", "VerbPast", "Number", "Adjective", "NounPlural", "Punctuation"]
    assert row["p"] == ["quick Berlin trains", "wonderful bridges"]


def test_updated_ranks_sum_to_one_and_keep_the_rest(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(12)], "source string, target string, weight double")
    old = graph.pagerank(e)
    new = e.unionByName(spark.createDataFrame([("x", "n0", 1.0)], "source string, target string, weight double"))
    got = {r["node"]: r["score"] for r in graph.updated_pagerank(new, old, spark.createDataFrame([("x",), ("n0",)], "node string"), hops=1).collect()}
    was = {r["node"]: r["score"] for r in old.collect()}
    assert got["n9"] == pytest.approx(was["n9"]) and got["n0"] != pytest.approx(was["n0"]) and set(got) == set(was) | {"x"}
    full = graph.updated_pagerank(new, old, spark.createDataFrame([("x",), ("n0",)], "node string"), most_changed=1)
    assert sum(r["score"] for r in full.collect()) == pytest.approx(1.0)


def test_rounds_that_run_out_are_errors(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(12)], "source string, target string, weight double")
    with pytest.raises(RuntimeError):
        graph.shortest_distances(chain, spark.createDataFrame([("n0",)], "node string"), max_rounds=3)
    with pytest.raises(RuntimeError):
        graph.ancestors(chain.select(F.col("source").alias("node"), F.col("target").alias("parent")), spark.createDataFrame([("n0",)], "node string"), 5)


def plain_choice(rows, k):
    rows = sorted(rows, key=lambda r: (-r[2], r[1]))
    chosen, seen = [], set()
    for i, (_, _, score, ents) in enumerate(rows):
        if len(chosen) == k:
            break
        if score > 0.8 or set(ents) - seen or len(chosen) < k / 2:
            chosen.append(i)
            seen |= set(ents)
    chosen += [i for i in range(len(rows)) if i not in chosen][: k - len(chosen)]
    return {rows[i][1] for i in chosen}


@pytest.mark.parametrize("k", [1, 4, 5, 30])
def test_diverse_choice_is_that_of_the_walk(spark, k):
    r = np.random.default_rng(k)
    rows = [("q", f"r{i:03}", float(np.round(r.random(), 2)), [f"e{x}" for x in r.integers(0, 9, r.integers(0, 3))]) for i in range(60)]
    df = spark.createDataFrame(rows, "query_id string, id string, score double, entities array<string>")
    assert {x["id"] for x in search.diverse(df, k).collect()} == plain_choice(rows, k)


def test_two_levels_with_a_model_and_without(spark):
    q = spark.createDataFrame([("a", "What themes does Alice mention"), ("b", "of it"), ("c", None)], "query_id string, query string")
    plain = {r["query_id"]: (r["high"], r["low"]) for r in retrieval.two_level_keywords(q).collect()}
    assert plain["a"] == ([], ["what", "themes", "does", "alice", "mention"]) and plain["b"] == ([], []) and plain["c"] == ([], [])
    model = lambda ps: ["Sure: " + json.dumps({"high_level": ["themes"], "low_level": ["Alice"]}) if "Alice" in p else "no json" for p in ps]
    told = {r["query_id"]: (r["high"], r["low"]) for r in retrieval.two_level_keywords(q, model).collect()}
    assert told["a"] == (["themes"], ["Alice"]) and told["b"] == ([], [])


def test_phase_checks_and_statistics_of_nothing(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    checks = quality.phase_checks(none("id string, content string"), none("id string, content string"), none("id string, name string, confidence double"), none("source string, target string, confidence double"))
    result = {r["phase"]: r["result"] for r in quality.phase_summary(checks).collect()}
    assert result["documents"] == "FAIL" and result["graph"] == "PASS"
    assert quality.score_histogram(none("score double")).count() == 0
    same = spark.createDataFrame([(2.0,), (2.0,)], "score double")
    assert [tuple(r) for r in quality.score_histogram(same).collect()] == [(0, 2.0, 2)]


def test_query_faults(spark):
    rows = spark.createDataFrame([("",), (None,), ("fine",), ("x'; DROP TABLE y",), ("a\x00b\tc\n",)], "t string")
    got = rows.select(quality.query_fault("t"), quality.sanitized("t")).collect()
    assert [r[0] for r in got] == ["empty", "empty", None, "forbidden", None] and got[4][1] == "ab\tc\n"


def test_bucketed_sink_rewrites_what_a_batch_touches(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sink = changes.upsert_sink(path, ["k"], ["n"], buckets=8)
    make = lambda rows: spark.createDataFrame(rows, "k string, n int, v string, operation string")
    sink(make([(f"k{i}", 0, "a", "upsert") for i in range(40)]), 0)
    before = changes._manifest(spark, path, 0)["at"]
    sink(make([("k1", 1, "b", "upsert"), ("k2", 1, "b", "delete")]), 1)
    sink(make([("k1", 9, "lost", "upsert")]), 1)  # seen before
    after = changes._manifest(spark, path, 1)["at"]
    assert sum(before[b] == after.get(b) for b in before) >= 6
    got = {r["k"]: r["v"] for r in changes.read_upserts(spark, path).collect()}
    assert got == {f"k{i}": "a" for i in range(40) if i not in (1, 2)} | {"k1": "b"}


def test_functions_are_planned(spark):
    e = spark.createDataFrame([("1", "Alice Berg", "P"), ("2", "Oak Society", "O")], "id string, name string, entity_type string")
    r = spark.createDataFrame([("1", "2", "MEMBER_OF")], "source string, target string, relation_type string")
    f = Functions({"entities": e, "relations": r, "mentions": spark.createDataFrame([("c", "1", 0)], "chunk string, entity_id string, start_offset int"), "chunks": spark.createDataFrame([("c", "text")], "id string, content string")})
    assert [c for c, _ in f.plan("How is Alice Berg tied to the Oak Society?")] == ["relationship_traverse"] * 2
    assert [c for c, _ in f.plan("Who is Alice Berg?")] == ["entity_expand", "get_entity_context", "infer_relationships"]
    assert [c for c, _ in f.plan("harbour")] == ["graph_search"] and f.plan("") == []
    assert sum(df.count() for _, df in f.run("How is Alice Berg tied to the Oak Society?")) == 1


def test_context_and_synthesis(spark):
    d = spark.createDataFrame([("d", "# A Title\nbody")], "id string, content string")
    c = spark.createDataFrame([("c", "d", "body"), ("x", "gone", "alone")], "id string, document_id string, content string")
    got = {r["id"]: r["content"] for r in contextualised(c, d).collect()}
    assert got["c"] == "From: A Title\n\nbody" and got["x"].endswith("alone")
    p = spark.createDataFrame([("q", 2, "two", 0.9), ("q", 1, "one", 0.2), ("q", 3, None, 0.1)], "query_id string, part int, answer string, confidence double")
    assert [synthesized(p, how).first()["answer"] for how in ("ordered", "best", "template")] == ["one two", "two", "1. one\n2. two"]
