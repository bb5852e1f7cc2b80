from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import dedup
from graphmill.llm import queries as Q
from graphmill.session import table

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 10 else frozenset()


def brute(docs):
    sets = {i: s for i, t in docs.items() if (s := shingles(t))}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def edited(base, seed, share=0.08):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"new{r.randrange(10**6)}" for w in base)


def found(spark, docs, **extra):
    df = spark.createDataFrame(list(docs.items()), "id string, content string")
    for c in ("h", "n", "m", "sh", "a", "b", "sign", "key"):
        df = df.withColumn(c, F.lit("x"))
    return {tuple(r) for r in dedup.id_pairs(*dedup.near_duplicates(df, **extra)).collect()}


def test_families_and_odd_texts(spark):
    docs = {f"f{f}-{i}": edited(words(80, f), i * 7 + f) for f in range(6) for i in range(6)}
    docs |= {"null": None, "empty": "", "blank": " \n ", "short": "one two three", "same1": "x y z " * 5, "same2": "x y z " * 5}
    docs |= {"long1": " ".join(words(30_000, 99)), "long2": " ".join(words(30_000, 99)[:29_000])}
    docs |= {"half": " ".join(words(80, 1)[:45]), "ten1": " ".join(words(10, 5)), "ten2": " ".join(words(10, 5)[:9] + ["odd"])}
    assert found(spark, docs) == brute(docs)


def test_hot_signatures_take_the_exact_way(spark):
    base = words(70, 3)
    docs = {f"d{i:03}": edited(base, i, 0.03) for i in range(dedup.LIMIT + 60)}
    docs |= {f"other{i}": " ".join(words(60, 1000 + i)) for i in range(20)}
    assert found(spark, docs) == brute(docs)


def test_template_that_is_all_a_pair_shares(spark):
    base = words(72, 4)
    docs = {f"t{i:03}": " ".join(base + words(30, 2000 + i)) for i in range(400)}
    docs |= {f"l{i:03}": " ".join(base[:40] + words(60, 5000 + i)) for i in range(150)}
    want = brute(docs)
    assert len(want) == 400 * 399 // 2
    assert found(spark, docs) == want


@pytest.mark.parametrize("n, own", [(600, 31), (1500, 31)])
def test_every_pair_of_a_template_is_found(spark, n, own):
    """What any two share is common to all; every pair is just above the threshold."""
    base = words(70, 4)
    docs = {f"t{i:04}": " ".join(base + words(own, 2000 + i)) for i in range(n)}
    some = [shingles(docs[f"t{i:04}"]) for i in (0, n // 2, n - 1)]
    assert all(0.5 <= len(a & b) / len(a | b) < 0.56 for a in some for b in some if a is not b)
    assert len(found(spark, docs)) == n * (n - 1) // 2


def test_template_below_the_threshold(spark):
    base = words(60, 4)
    docs = {f"t{i:04}": " ".join(base + words(70, 2000 + i)) for i in range(dedup.LIMIT + 200)} | {"twin": " ".join(base + words(70, 2000) + ["odd"])}
    assert found(spark, docs) == {("t0000", "twin")}


def test_too_few_signatures_take_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SLACK", -1000)
    dedup.fewest.cache_clear()
    try:
        docs = {f"f{f}-{i}": edited(words(80, f), i * 7 + f) for f in range(3) for i in range(4)}
        n = np.arange(64, 128)
        assert (dedup.fewest(7)[n] > n).all()
        sign, row, must = dedup.signatures(np.arange(80), np.array([0, 80]), np.zeros(1 << dedup.COUNT_BITS, np.int64))
        assert must[0] == 0 and not len(sign)
    finally:
        dedup.fewest.cache_clear()
    assert found(spark, docs) == brute(docs)


def test_sets_of_few_elements(spark):
    docs = {"one": "a " * 12, "two": "a " * 11 + "b"} | {f"c{k}{i}": " ".join((words(3, k) + words(i, 50 + k)) * 4) for k in range(60) for i in range(3)}
    assert found(spark, docs) == brute(docs)


def test_many_copies_are_a_star(spark):
    text = " ".join(words(30, 8))
    docs = {f"c{i:03}": text for i in range(dedup.ALL_PAIRS + 10)} | {"near": text + " more"}
    got = found(spark, docs)
    assert {("c000", f"c{i:03}") for i in range(1, dedup.ALL_PAIRS + 10)} | {("c000", "near")} == got


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "id string, content string")
    assert dedup.id_pairs(*dedup.near_duplicates(empty)).count() == 0
    t = " ".join(words(20, 1))
    twice = spark.createDataFrame([("a", t), ("a", t), ("b", t + " x"), (None, t)], "id string, content string")
    assert [tuple(r) for r in dedup.id_pairs(*dedup.near_duplicates(twice)).collect()] == [("a", "b")]


def test_groups(spark):
    rows = Q.p1_groups(spark, SF).collect()
    group = {r["id"]: r["group_id"] for r in rows}
    assert all(g == min(i for i in group if group[i] == g) for g in set(group.values()))
    assert all(group[r[0]] == group[r[1]] for r in Q.p1_found(spark, SF).collect())


def verdicts(docs, index):
    """Ids in order of batch and id, by the plain rule."""
    accepted, contents, cases = [], set(), set()
    for i, (text, batch) in sorted(docs.items(), key=lambda x: (x[1][1], x[0])):
        if text is None or not text.strip():
            continue
        proper = "hash_" + hashlib.sha256(text.encode()).hexdigest()[:16]
        s = shingles(text)
        near = any(s and t and 2 * len(s & t) >= len(s | t) for t in accepted)
        if batch >= 1 and (any(h == proper and d != i for h, d in index) or text in contents or near):
            cases.add(i)
        else:
            accepted.append(s)
            contents.add(text)
    return cases


def test_history(spark):
    docs = {f"h{i}": (edited(words(60, i), 1), 0) for i in range(8)}
    docs |= {f"n{i}": (edited(words(60, i % 10), i, 0.1), 1 + i % 3) for i in range(30)}
    # A chain: each is near the one before, not near the one before that.
    base = words(100, 77)
    docs |= {f"k{i}": (" ".join(base[i * 20 : i * 20 + 70]), 2) for i in range(2)}
    chain = words(200, 78)
    docs |= {f"z{i}": (" ".join(chain[i * 15 : i * 15 + 60]), 3) for i in range(9)}
    docs |= {"e1": (None, 1), "e2": ("  ", 1), "s1": ("tiny text", 1), "s2": ("tiny text", 2), "x1": ("indexed elsewhere", 1), "x2": ("indexed itself", 1)}
    proper = lambda t: "hash_" + hashlib.sha256(t.encode()).hexdigest()[:16]
    index = [(proper("indexed elsewhere"), "gone"), (proper("indexed itself"), "x2"), (None, "q"), (proper("  "), "w")]
    df = spark.createDataFrame([(i, t, b) for i, (t, b) in docs.items()] + [("n3", docs["n3"][0], 7), ("lost", "no batch at all", None)], "id string, content string, batch_no int")
    got = dedup.new_records(df, spark.createDataFrame(index, "content_hash string, document_id string"))
    verdict = {r["id"]: r["verdict"] for r in got.collect()}
    assert {i for i, v in verdict.items() if v in ("known", "copy", "near")} == verdicts(docs, index)
    assert verdict["x1"] == "known" and verdict["x2"] == "accepted" and verdict["s2"] == "copy" and verdict["e1"] == "empty" and "lost" not in verdict
    assert set(verdict) == {i for i, (_, b) in docs.items() if b >= 1}


def test_history_of_nothing(spark):
    docs = spark.createDataFrame([], "id string, content string, batch_no int")
    assert dedup.new_records(docs, spark.createDataFrame([], "content_hash string, document_id string")).count() == 0


def test_batches_of_the_table(spark):
    rows = table(spark, SF, "document_metadata").select("id", "content", "batch_no").collect()
    docs = {}
    for r in rows:
        if r["batch_no"] is not None and (r["id"] not in docs or r["batch_no"] < docs[r["id"]][1]):
            docs[r["id"]] = (r["content"], r["batch_no"])
    index = [tuple(r) for r in table(spark, SF, "document_index").select("content_hash", "document_id").collect()]
    assert {r["id"] for r in Q.p5_found(spark, SF).collect()} == verdicts(docs, index)


@pytest.mark.parametrize("m", [1, 2, 5, 8, 14, 30, 60, 64, 115, 127, 240, 500, 3000])
@pytest.mark.parametrize("ratio", [1.0, 1.3, 1.9])
def test_similar_sets_share_as_many_signatures_as_promised(m, ratio):
    """At similarity 0.5, whatever the order of elements and the sizes, and with any of the elements common."""
    r = np.random.default_rng(m)
    for k in range(30):
        n = max(m, int(m * ratio))
        c = -(-(m + n) // 3)  # c / (m + n - c) >= 0.5
        if c > m:
            continue
        union = r.integers(0, 2**62, size=m + n - c)
        a, b = union[:m], np.append(union[m - c : m], union[m:])
        counts = np.zeros(1 << dedup.COUNT_BITS, np.int64)
        np.add.at(counts, r.permutation(union)[: len(union) // 2] >> (64 - dedup.COUNT_BITS), k)
        sa, _, need_a = dedup.signatures(a, np.array([0, m]), counts)
        sb, _, need_b = dedup.signatures(b, np.array([0, n]), counts)
        assert len(sa) == len(set(sa.tolist()))
        assert len(np.intersect1d(sa, sb)) >= min(need_a[0], need_b[0]) >= 1


def as_sets(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "n bigint, content string")
    return dedup.shingle_sets(df)


def test_stored_history_is_opened_again(spark):
    texts = {i: edited(words(60, i % 9), i, 0.1) for i in range(45)}
    first, second, third = ({i: t for i, t in texts.items() if i % 3 == k} for k in range(3))
    h = dedup.History(spark)
    h.append(as_sets(spark, first))
    h.append(as_sets(spark, second))
    again = dedup.History(spark, h.path)
    assert again.ranges == h.ranges and (again.counts == h.counts).all()
    got = {(r["x"], r["y"], r["stored"]) for r in again.check(as_sets(spark, third)).collect()}
    want = {(int(a), int(b)) for a, b in brute({f"{i:03}": t for i, t in texts.items()})}
    assert {(x, y) for x, y, s in got if not s} == {p for p in want if set(p) <= set(third)}
    assert {(x, y) for x, y, s in got if s} == {(x, y) for x in third for y in texts if y not in third and tuple(sorted((x, y))) in want}
    assert dedup.History(spark).check(as_sets(spark, {})).count() == 0
    assert dedup.History(spark).check(as_sets(spark, first), within=False).count() == 0


def test_work_follows_the_batch(spark):
    """Twice as much history makes no more rows for the join, as few pivots of the batch are in it."""
    old = {i: " ".join(words(60, 10_000 + i)) for i in range(400)}
    batch = {5000 + i: edited(words(60, 10_000 + i), i, 0.1) for i in range(5)}
    sizes = []
    for some in ({i: t for i, t in old.items() if i < 200}, old):
        h = dedup.History(spark)
        h.append(as_sets(spark, some))
        keys = dedup.pivot_table(as_sets(spark, batch), h.counts, 0.5)
        sizes.append(h.admitted(keys).count())
        assert h.check(as_sets(spark, batch)).count() == 5
    assert sizes[1] <= 1.1 * sizes[0] < 400
