from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from graphmill.llm import names

SAME = [
    ["Jacqueline Rogogaland", "JACQUELINE ROGOGALAND", "Jacqueline-Rogogaland", "Rogogaland, Jacqueline", "Dr. Jacqueline Rogogaland", "Jacqueline  Rogogaland", "J. Rogogaland", "Jacquelnie Rogogaland", "Jackie Rogogaland", "Jacqueline A. Rogogaland"],
    ["Sebastian Vazagarøw", "S. Vazagarøw", "Sebastian Vazagarow"],
    ["Tabitha Vazagarøw", "T.T. Vazagarøw", "Vazagarøw, T."],
    ["Robert Mikenholt", "Bob Mikenholt", "Rob Mikenholt", 'Robert "Bob" Mikenholt', "Rboert Mikenholt"],
    ["Kebeputh Society of Cultural Heritage", "Kebeputh Soc. of Cultural Heritage", "The Kebeputh Society of Cultural Heritage", "Cultural Heritage Society Kebeputh", "Kebeputh SCH"],
    ["Dukivulow Systems Corporation", "Dukivulow Systems Corp.", "DUKIVULOW SYSTEMS"],
    ["Port Krubregeton", "Krubregeton, Port", "PORT KRUBREGETON"],
    ["Kreteholm schema", "the Kreteholm schema", "Kreteholm's schema"],
]
APART = ["Mount Krubregeton", "Susan Dukivulow", "Julian Brefdort", "Jonas Brefdort", "Kreteholm paradox"]


@pytest.fixture(scope="module")
def table(spark):
    kinds = {0: "PERSON", 1: "PERSON", 2: "PERSON", 3: "PERSON", 4: "ORGANIZATION", 5: "ORGANIZATION", 6: "LOCATION", 7: "CONCEPT"}
    rows = [(n, kinds[k]) for k, group in enumerate(SAME) for n in group]
    rows += [("Mount Krubregeton", "LOCATION"), ("Susan Dukivulow", "PERSON"), ("Julian Brefdort", "PERSON"), ("Jonas Brefdort", "PERSON"), ("Kreteholm paradox", "CONCEPT"), (None, "PERSON"), ("", None), (" ", None), ("—", None)]
    # Enough other names for the common words to be common.
    stems = ["".join(x) for x in itertools.product(("Bra", "Dro", "Gul", "Nep"), ("tes", "vik", "zon", "lum"), ("ard", "eth"))]
    for w, kind in (("Jacqueline {}", "PERSON"), ("Sebastian {}", "PERSON"), ("Tabitha {}", "PERSON"), ("Julian {}", "PERSON"), ("Jonas {}", "PERSON"), ("Susan {}", "PERSON"), ("{} Society of Cultural Heritage", "ORGANIZATION"), ("{} Systems Corporation", "ORGANIZATION"), ("Port {}", "LOCATION"), ("Mount {}", "LOCATION"), ("{} schema", "CONCEPT"), ("{} paradox", "CONCEPT")):
        rows += [(w.format(f"{s}{kind[:2].lower()}{w[:2].lower().strip('{')}"), kind) for s in stems]
    return spark.createDataFrame(rows * 2, "name string, entity_type string").withColumn("stem", F.lit("q")).withColumn("token", F.lit("q"))


def test_spellings(spark, table):
    nick = spark.createDataFrame([("Robert", "Rob"), ("Robert", "Bob"), (None, "x"), ("y", None)], "given_name string, short_form string")
    got = {tuple(r) for r in names.variant_pairs(names.variants(table, nick)).collect()}
    want = {tuple(sorted(p)) for g in SAME for p in itertools.combinations(g, 2)}
    ours = {n for g in SAME for n in g} | set(APART)
    got = {p for p in got if set(p) & ours}
    assert got - want == set()
    assert len(got & want) >= 0.97 * len(want), sorted(want - got)


def test_no_names(spark, table):
    nick = spark.createDataFrame([], "given_name string, short_form string")
    assert names.variants(table.limit(0), nick).count() == 0


def test_within_one():
    assert all(names.within_one(a, b) for a, b in (("abcd", "abcd"), ("abcd", "acbd"), ("abcd", "abd"), ("abd", "abcd"), ("abcd", "abxd"), ("abcd", "abcde"), ("", "a")))
    assert not any(names.within_one(a, b) for a, b in (("abcd", "abdce"), ("abcd", "dbca"), ("ab", "abcd")))


def test_blocks_survive_one_wrong_letter():
    word = "rogogaland"
    for i in range(1, len(word)):
        for other in (word[:i] + word[i + 1 :], word[:i] + "t" + word[i + 1 :], word[:i] + "t" + word[i:], word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :] if i > 1 else word):
            assert names.blocks(word) & names.blocks(other), other


def test_close_stems_far_apart_in_a_long_block(spark):
    stems = ["".join(x) for x in itertools.product("b", "eio", "aeiou", "aeiou", "t", "aeiou", "r")]
    rows = [(s, "CONCEPT") for s in stems] + [("Xavier Baatoir", "PERSON"), ("Xavier Buatoir", "PERSON")]
    nick = spark.createDataFrame([], "given_name string, short_form string")
    got = {tuple(r) for r in names.variants(spark.createDataFrame(rows, "name string, entity_type string"), nick).collect()}
    assert got == {("Xavier Baatoir", "Xavier Buatoir")}


def test_groups_and_optional_short_forms(spark, table):
    nick = spark.createDataFrame([], "given_name string, short_form string")
    rows = names.variant_groups(names.variants(table, nick)).collect()
    group = {r["name"]: r["group_name"] for r in rows}
    assert group["Robert Mikenholt"] == group["Bob Mikenholt"] == min(n for n in group if group[n] == group["Bob Mikenholt"])
    assert all(r["links"] >= 1 for r in rows)
    none = {r["name"]: r["group_name"] for r in names.variant_groups(names.variants(table, nick, more_short_forms="")).collect()}
    assert none.get("Bob Mikenholt") != none["Robert Mikenholt"]
