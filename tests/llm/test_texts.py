from __future__ import annotations

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphmill.llm import bpe, encoding, mix, split, terms
from graphmill.session import table

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- splitting


def greedy(b, limit=1500, floor=750, overlap=150):
    n, out, s = len(b), [], 0
    start = lambda p: b[p] & 0xC0 != 0x80
    kinds = (
        lambda p: b[p - 2 : p] == b"\n\n" and (p == n or b[p : p + 1] != b"\n"),
        lambda p: b[p - 1 : p] in (b" ", b"\n") and b[p - 2 : p - 1] in (b".", b"!", b"?"),
        lambda p: b[p - 1 : p] in (b" ", b"\n"),
    )
    while n - s > limit:
        e = next((max(c) for k in kinds if (c := [p for p in range(s + floor + 1, s + limit + 1) if k(p)])), None)
        e = e if e is not None else max(p for p in range(s, s + limit + 1) if start(p))
        out.append((s, e))
        s = next(p for p in range(e - overlap, n) if start(p))
    return [*out, (s, n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "end. ", "Ja!\n", "\n\n", "\n\n\n", "é", "日本語", "x" * 300, "\r\n\r\n", "? ", " "]), min_size=1, max_size=800))
def test_cuts_are_the_greedy_ones(parts):
    b = "".join(parts).encode()
    s, e = split.cut(b)
    assert list(zip(s.tolist(), e.tolist())) == greedy(b)


def test_split_documents(spark):
    rows = [("a", "é" * 2000), ("a", "é" * 2000), ("b", None), ("c", ""), ("d", "short"), ("e", "a" * 1500), ("f", "w. " * 200_000)]
    df = spark.createDataFrame(rows, "id string, content string").withColumn("s", F.lit(1)).withColumn("h", F.lit(1)).withColumn("document_id", F.lit("x"))
    got = split.split_documents(df).collect()
    assert {r["document_id"] for r in got} == {"a", "f"}
    assert sorted((r[1], r[2]) for r in got if r[0] == "a") == greedy(("é" * 2000).encode())
    assert max(r[2] for r in got if r[0] == "f") == 600_000
    assert split.split_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_documents(df, overlap=800)


# ---------------------------------------------------------------- tokenizer


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder()


ODD = ["a" * 3000, " " * 999 + "x", "<|endoftext|> it's they'RE don't", "\x00\x1c\x1f\x85 ​﻿", "日本語のテキスト👩‍🔬", "1234567890" * 50, "\r\n\t \n\n  a", "ééé ﷺ ’s", "aaab" * 400, "!?" * 700]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text, encoder, reference):
    assert encoder.encode(text) == reference(text)
    assert encoder.count(text) == len(reference(text))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    enc, dec = bpe.loaded(bpe.Encoder, bpe.VOCABULARY), bpe.loaded(bpe.Decoder, bpe.VOCABULARY)
    assert dec.decode(np.array(enc.encode(text), np.int64)).decode() == text


def test_whole_table(spark, reference):
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(table(spark, SF, "documents")).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    assert all(got[d["doc_id"]] == (reference(d["text"]) if d["text"] else []) for d in docs)


def test_null_empty_and_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "x")], "doc_id bigint, text string").withColumn("ids", F.lit(0))
    assert sorted((r["doc_id"], len(r["ids"])) for r in bpe.encode_texts(df).collect()) == [(1, 0), (2, 0), (2, 0), (3, 1)]
    assert bpe.encode_texts(df.limit(0)).count() == 0
    back = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode_ids(back).collect()} == {1: None, 2: ""}


# ---------------------------------------------------------------- terms


def tail(k, n, good, total):
    return sum(Fraction(math.comb(good, i) * math.comb(total - good, n - i), math.comb(total, n)) for i in range(k, min(n, good) + 1))


@pytest.mark.parametrize("case", [(1, 10, 5, 100), (3, 50, 40, 1000), (5, 5, 5, 50), (40, 100, 300, 900), (1, 1, 1, 1), (2, 30, 2, 60), (25, 60, 30, 61)])
def test_upper_tail(case):
    got = terms.log_upper_tail(*(np.array([x]) for x in case))[0]
    assert got == pytest.approx(math.log(tail(*case)), abs=1e-9)


def test_log_gamma():
    x = np.array([1.0, 1.5, 2.0, 7.3, 10.0, 1e3, 1e8])
    assert terms.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-11)


def test_enrichment_and_adjustment(spark):
    r = np.random.default_rng(0)
    docs = [(f"d{i}", " ".join(r.choice(["alpha", "beta", "gamma", "delta"], 30)) + (" rare" * 6 if i == 3 else "")) for i in range(12)] + [("n", None), ("e", ""), ("b", " \n")]
    df = spark.createDataFrame(docs + docs[:2], "id string, content string").withColumn("term", F.lit("z")).withColumn("tf", F.lit(9))
    rows = terms.enrichment(terms.content_terms(df)).collect()
    counts = {i: Counter(t.split()) for i, t in docs if t and t.strip()}
    total, good = sum(sum(c.values()) for c in counts.values()), sum(counts.values(), Counter())
    p = {(i, t): float(tail(k, sum(c.values()), good[t], total)) for i, c in counts.items() for t, k in c.items()}
    assert {(x["document_id"], x["term"]): x["score"] for x in rows} == pytest.approx({k: -math.log(v) for k, v in p.items()}, abs=1e-8)
    order, low = sorted(p.values(), reverse=True), 1.0
    q = {}
    for rank, v in zip(range(len(order), 0, -1), order):
        low = min(low, v * len(order) / rank)
        q[v] = min(q.get(v, 1.0), low)
    assert {(x["document_id"], x["term"]): x["q"] for x in rows} == pytest.approx({k: q[v] for k, v in p.items()}, abs=1e-8)
    assert max(rows, key=lambda x: x["score"])["term"] == "rare"
    assert terms.enrichment(terms.content_terms(df.limit(0))).count() == 0


def test_keywords(spark):
    rows = [("c1", "d", [" Big ", "big", None, ""]), ("c1", "d", ["big"]), ("c2", "d", ["BIG"]), ("c3", None, ["x"]), ("c4", "d", None)]
    df = spark.createDataFrame(rows, "id string, document_id string, keywords array<string>")
    assert [tuple(r) for r in terms.keyword_terms(df).collect()] == [("d", "big", 2)]
    assert terms.distinctive(terms.keyword_terms(df)).count() == 0


# ---------------------------------------------------------------- mixing


def test_shares_and_repeats(spark):
    r = np.random.default_rng(2)
    docs = [(i, "word " * int(r.integers(1, 60)), [" Wiki", "wiki", "BOOK", "faq"][i % 4] if i % 9 else None) for i in range(400)] + [(900, None, "faq"), (901, "", "faq"), (902, "long " * 200, "book")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("rank", F.lit(1)).withColumn("id", F.lit(1))
    goal = spark.createDataFrame([("m", "wiki", 0.5, 2), ("m", "book", 0.2, 3), ("m", "faq", 0.2, 4), ("m", "none", 0.1, 4), ("one", "faq", 1.0, 3)], "mix string, source string, target_share double, max_repeats int")
    sized = mix.sized(df)
    rate = mix.rates(sized, goal)
    got = mix.draw(sized, rate)
    rows = got.collect()
    assert all(1 <= x["copies"] <= {"wiki": 2, "book": 3, "faq": 4}[x["source"]] for x in rows)
    assert len({(x["mix"], x["doc_id"]) for x in rows}) == len(rows) and not {900, 901} & {x["doc_id"] for x in rows}
    share = {(x["mix"], x["source"]): (x["target_share"], x["actual_share"]) for x in mix.reached(rate, got).collect()}
    assert share["m", "none"] == (0.1, 0.0) and share["one", "faq"][1] == 1.0
    assert share["m", "wiki"][1] == pytest.approx(0.5 / 0.9, abs=0.08) and share["m", "faq"][1] == pytest.approx(0.2 / 0.9, abs=0.05)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix.draw(mix.sized(df), rate).collect()))
    assert {x["copies"] for x in rows if x["mix"] == "one"} == {3}
    assert mix.draw(mix.sized(df.limit(0)), mix.rates(mix.sized(df.limit(0)), goal)).count() == 0


def test_ranks_number_each_source(spark):
    ranks = {}
    for x in mix.sized(table(spark, SF, "documents")).collect():
        ranks.setdefault(x["source"], []).append((x["rank"], x["n_tokens"]))
    for got in ranks.values():
        got.sort()
        assert [k for k, _ in got] == list(range(1, len(got) + 1))
        assert [n for _, n in got] == sorted(n for _, n in got)


# ---------------------------------------------------------------- encodings

CLEAN = ["Könnte der Händler natürlich größer sein", "Le théâtre générale près de l’été « à part »", "письмо хранит словарь общий северный", "検索と地図を見つける。", "Ściężka główny późny łączy", "coût €5 — “très” bien", "część l’été"]


@pytest.fixture(scope="module")
def corpus(spark):
    bad = [
        (1, encoding.garble(CLEAN[0], ("cp1252",))), (2, encoding.garble(CLEAN[1], ("latin-1",))), (3, encoding.garble(CLEAN[3], ("mac_roman",))),
        (4, encoding.read_as(CLEAN[2].encode("cp1251"), "koi8-r")), (5, encoding.garble(CLEAN[1], ("cp1252", "cp1252"))), (6, CLEAN[0].encode("latin-1").decode("utf-8", "replace")),
        (7, "plain start, " + encoding.garble(CLEAN[5], ("cp437",))), (8, encoding.garble(CLEAN[2], ("cp1251",))), (9, encoding.read_as(CLEAN[4].encode("cp1250"), "cp1252")),
        (10, encoding.read_as(CLEAN[3].encode("euc_jp"), "latin-1")), (11, encoding.read_as(CLEAN[3].encode("shift_jis"), "cp1252")), (12, "czę¶ć"),
    ]
    good = [(100 + i, t) for i, t in enumerate(CLEAN * 4)] + [(200, None), (201, ""), (202, "caf&eacute; \\u00e9 %C3%A9"), (203, "ÂNGULO, ÓRGÃO"), (204, "हिन्दी مرحبا עברית 👩‍🔬"), (205, "x" * 100_000)]
    return spark.createDataFrame(bad + good + bad[:1], "doc_id bigint, text string").withColumn("unit", F.lit("a")).withColumn("id", F.lit(0)), bad


def test_garbled_texts_are_found(corpus):
    df, bad = corpus
    assert {r["id"] for r in encoding.Garbled(df).found().collect()} == {i for i, _ in bad}


def test_garbled_texts_are_restored(corpus):
    df, _ = corpus
    got = {r["id"]: r["text"] for r in encoding.Garbled(df).restored().collect()}
    want = {1: CLEAN[0], 2: CLEAN[1], 3: CLEAN[3], 4: CLEAN[2], 5: CLEAN[1], 7: "plain start, " + CLEAN[5], 8: CLEAN[2], 10: CLEAN[3], 12: "część"}
    assert {i: got[i] for i in want} == want
    assert "Händler" in got[6]


def test_copies_of_a_garbled_text_are_found(spark):
    clean = [(i, f"{CLEAN[0]} {i}") for i in range(2)]
    copies = [(10 + i, encoding.garble(CLEAN[0], ("cp1252",))) for i in range(5)]
    df = spark.createDataFrame(clean + copies, "doc_id bigint, text string")
    garbled = encoding.Garbled(df)
    assert {r["id"] for r in garbled.found().collect()} == {i for i, _ in copies}
    assert {r["text"] for r in garbled.restored().collect()} == {CLEAN[0]}


def test_nothing_garbled(spark):
    df = spark.createDataFrame([(1, "plain"), (2, None), (3, "schön schön")], "doc_id bigint, text string")
    assert encoding.Garbled(df).found().count() == 0
    assert encoding.Garbled(df.limit(0)).found().count() == 0
