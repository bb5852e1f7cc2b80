"""Entities, mentions and relations: extraction, merging, linking, co-occurrence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from math import ceil, comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.similarity import alike, jaccard, link_similarity
from graphmill.functions.text import CONCEPT_STOP_WORDS, entity_id, normalize_for_linking, split_words
from graphmill.operators import baskets
from graphmill.operators.chunking import per_row
from graphmill.operators.components import connected_components
from graphmill.session import materialize

# ---------------------------------------------------------------- extraction

# Words by which a capitalised phrase is told to be an organisation, a place or an event.
ORGANIZATION_WORDS = {"inc", "corp", "corporation", "company", "ltd", "limited", "university", "institute", "society", "academy", "foundation", "department", "laboratory", "bank", "group", "gesellschaft", "centre", "center"}
PLACE_WORDS = {"city", "river", "mount", "mountain", "lake", "port", "cape", "fort", "north", "south", "east", "west", "upper", "lower", "street", "island", "county", "valley"}
EVENT_WORDS = {"war", "battle", "conference", "festival", "revolution", "treaty", "summit", "symposium", "election"}
TITLE_WORDS = {"mr", "mrs", "ms", "dr", "prof", "sir"}
#: Confidence of an extracted entity by type.
CONFIDENCE = {"PERSON": 0.8, "ORGANIZATION": 0.85, "LOCATION": 0.75, "EVENT": 0.7, "CONCEPT": 0.6}

_PHRASE = re.compile(r"\b[A-ZÀ-ÖØ-Þ][\w'’-]*(?:\s+(?:(?:of|for|de)\s+)?[A-ZÀ-ÖØ-Þ][\w'’-]*)*")


def classify(phrase: str) -> str | None:
    words = [w.lower().strip(".") for w in phrase.split()]
    if any(w in ORGANIZATION_WORDS for w in words):
        return "ORGANIZATION"
    if words[0] in PLACE_WORDS and len(words) > 1:
        return "LOCATION"
    if any(w in EVENT_WORDS for w in words) and len(words) > 1:
        return "EVENT"
    if words[0] in TITLE_WORDS and len(words) > 1 or 2 <= len(words) <= 3 and all(w.isalpha() for w in words):
        return "PERSON"
    return "CONCEPT" if len(words[0]) > 3 and words[0] not in CONCEPT_STOP_WORDS else None


def find_entities(text: str) -> list[tuple]:
    """``(name, type, confidence, start, end)`` of capitalised phrases; a sentence's first single word does not count."""
    out = []
    for m in _PHRASE.finditer(text):
        name = m.group()
        single = " " not in name
        before = text[: m.start()].rstrip(" \t")
        if single and (not before or before[-1] in ".!?\n:#>-*"):
            continue
        kind = classify(name)
        if kind:
            out.append((name, kind, CONFIDENCE[kind], m.start(), m.end()))
    return out


def extract_entities(chunks: DataFrame, id_col: str, text_col: str, least: float = 0.0) -> DataFrame:
    """``(chunk, entity_id, name, entity_type, confidence, start_offset, end_offset)``, one row a mention."""
    raw = per_row(chunks, id_col, text_col, find_entities, "name string, entity_type string, confidence double, start_offset bigint, end_offset bigint")
    return raw.where(F.col("confidence") >= least).withColumn("entity_id", entity_id("entity_type", "name"))


def rule_entities(texts: DataFrame, id_col: str, text_col: str, rules: list[tuple[str, str, float]]) -> DataFrame:
    """``(id, name, entity_type, confidence, start_offset, end_offset)`` by ``(type, pattern, confidence)`` rules; of overlapping hits the first, then the surest stays."""
    compiled = [(t, re.compile(p), c) for t, p, c in rules]

    def find(text: str) -> list[tuple]:
        hits = sorted(((m.start(), -c, m.end(), t, m.group()) for t, p, c in compiled for m in p.finditer(text)))
        out, end = [], 0
        for start, c, stop, t, name in hits:
            if start >= end and stop > start:
                out.append((name, t, -c, start, stop))
                end = stop
        return out

    return per_row(texts, id_col, text_col, find, "name string, entity_type string, confidence double, start_offset bigint, end_offset bigint")


def merge_entities(mentions: DataFrame, by: list[Column]) -> DataFrame:
    """One row an entity: names that are equal under ``by`` become one, with the best confidence and the number of mentions."""
    keyed = mentions.select(*[c.alias(f"_k{i}") for i, c in enumerate(by)], "*")
    keys = [f"_k{i}" for i in range(len(by))]
    g = keyed.groupBy(*keys).agg(F.max_by("name", F.struct(F.length("name"), "confidence", "name")).alias("name"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("mentions"), F.count_distinct("chunk").alias("chunks"), F.min("entity_type").alias("entity_type"))
    return g.drop(*keys)


# The relation of two entities met in one chunk, by their types: words of the chunk that
# tell it, in order, and what holds without any of them.  Other types are RELATED_TO.
RELATION_RULES = {
    ("PERSON", "ORGANIZATION"): ((("works for", "employed by"), "WORKS_FOR"), (("founded", "CEO"), "LEADS"), "ASSOCIATED_WITH"),
    ("PERSON", "LOCATION"): ((("born in", "from"), "BORN_IN"), (("lives in", "based in"), "LOCATED_IN"), "ASSOCIATED_WITH"),
    ("ORGANIZATION", "LOCATION"): ((("headquartered", "based in"), "HEADQUARTERED_IN"), "LOCATED_IN"),
    ("PERSON", "PERSON"): ((("married", "spouse"), "MARRIED_TO"), (("colleague", "partner"), "COLLEAGUE_OF"), "KNOWS"),
}


def _pairs_in_baskets(mentions: DataFrame, item: str, basket: str) -> DataFrame:
    """``(basket, a, b)`` with a < b for items of one basket, in blocks of bounded size."""
    m = mentions.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()
    return baskets.pairs(m, "basket", "item")


def cooccurrence(mentions: DataFrame, item: str, basket: str, least: int = 1) -> DataFrame:
    """``(a, b, n, jaccard)``: baskets shared by two items, and those over the baskets of either.

    Items in fewer than ``least`` baskets cannot reach it and are left out before the join.
    """
    m = mentions.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()
    df = m.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    pairs = _pairs_in_baskets(m.join(df.select("item"), "item", "left_semi"), "item", "basket").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    both = pairs.join(df.withColumnsRenamed({"item": "a", "df": "da"}), "a").join(df.withColumnsRenamed({"item": "b", "df": "db"}), "b")
    return both.select("a", "b", "n", (F.col("n") / (F.col("da") + F.col("db") - F.col("n"))).alias("jaccard"))


def relations_in_chunks(mentions: DataFrame, chunks: DataFrame | None = None, confidence: float = 0.5) -> DataFrame:
    """``(source, target, relation_type, confidence, chunks)`` between every two entities of a chunk.

    The type follows from the types of both, whichever comes first, and from
    words of the chunk's text if ``chunks`` (chunk, content) is given; the
    smaller id is the source.
    """
    m = mentions.where("entity_id is not null").groupBy("chunk", "entity_id").agg(F.min("entity_type").alias("entity_type"))
    said = sorted({w for rule in RELATION_RULES.values() for step in rule if not isinstance(step, str) for w in step[0]})
    if chunks is not None:  # the words found go with the mentions, not the texts
        words = F.filter(F.array(*[F.lit(w) for w in said]), lambda w: F.contains("content", w))
        m = m.join(chunks.select("chunk", words.alias("said")), "chunk", "left")
    else:
        m = m.withColumn("said", F.array().cast("array<string>"))
    pair = baskets.pairs(m, "chunk", "entity_id", "entity_type", "said")
    kind = F.lit("RELATED_TO")
    for (s, t), rule in RELATION_RULES.items():
        fits = ((F.col("entity_type_a") == s) & (F.col("entity_type_b") == t)) | ((F.col("entity_type_a") == t) & (F.col("entity_type_b") == s))
        told = F.lit(rule[-1])
        for known, name in reversed(rule[:-1]):
            told = F.when(F.arrays_overlap("said_a", F.array(*[F.lit(w) for w in known])), name).otherwise(told)
        kind = F.when(fits, told).otherwise(kind)
    named = pair.select(F.col("basket").alias("chunk"), F.col("a").alias("source"), F.col("b").alias("target"), kind.alias("relation_type"))
    return named.groupBy("source", "target", "relation_type").agg(F.count(F.lit(1)).alias("chunks")).withColumn("confidence", F.lit(confidence))


def inferred_relations(mentions: DataFrame, target: str, least: float = 0.3, k: int = 10) -> DataFrame:
    """``(source, target, confidence, chunks)``: entities that share chunks with ``target``: 0.2 a shared chunk and up to 0.3 for nearness, over the target's chunks, at most 1."""
    t = mentions.where(F.col("entity_id") == target).groupBy("chunk").agg(F.min("start_offset").alias("t0"))
    n = t.agg(F.count(F.lit(1)).alias("n"))
    o = mentions.where(F.col("entity_id") != target).groupBy("chunk", "entity_id").agg(F.min("start_offset").alias("o0"))
    near = 0.3 * F.exp(-F.abs(F.col("o0") - F.col("t0")) / 100.0)
    g = o.join(t, "chunk").groupBy("entity_id").agg(F.sum(0.2 + near).alias("s"), F.count(F.lit(1)).alias("chunks")).crossJoin(F.broadcast(n))  # one row
    out = g.select(F.col("entity_id").alias("source"), F.lit(target).alias("target"), F.least(F.col("s") / F.col("n"), F.lit(1.0)).alias("confidence"), "chunks")
    return out.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "source").limit(k)


# ---------------------------------------------------------------- linking


def link_pairs(entities: DataFrame, least: float = 0.85, sound: bool = False, hot: int = 1000) -> DataFrame:
    """``(a, b, similarity)`` of entities of one type whose names are similar.

    Names are compared only if they share a word, or the Soundex code and the
    first three letters; both are equality joins.  A word in more than ``hot``
    names says too little: names that share it are compared if they share a
    second word with it, or begin or end with the same three letters.
    """
    e = entities.select("id", "name", "entity_type").where("name is not null")
    norm = normalize_for_linking("name")
    words = F.array_distinct(F.filter(F.split(norm, " "), lambda w: F.length(w) > 1))
    each = e.select("*", norm.alias("norm"), words.alias("words")).select("*", F.explode("words").alias("w"))
    many = each.groupBy("entity_type", "w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("entity_type", "w", F.lit(True).alias("hot"))
    ends = F.array(F.concat(F.lit("^"), F.substring("norm", 1, 3)), F.concat(F.lit("$"), F.substring("norm", -3, 3)))
    seconds = F.transform(F.array_union(F.array_remove("words", F.col("w")), ends), lambda x: F.concat_ws(" ", F.array_sort(F.array(F.col("w"), x))))
    by_word = each.join(many, ["entity_type", "w"], "left").select("id", "name", "entity_type", F.explode(F.when(F.col("hot"), seconds).otherwise(F.array("w"))).alias("key"))
    k = by_word.unionByName(e.select("*", F.concat(F.lit("="), F.soundex(norm), F.substring(norm, 1, 3)).alias("key")))
    b = k.select(F.col("id").alias("b"), F.col("name").alias("nb"), "entity_type", "key")
    pairs = k.withColumnsRenamed({"id": "a", "name": "na"}).join(b, ["entity_type", "key"]).where("a < b").select("a", "b", "na", "nb").distinct()
    return pairs.select("a", "b", link_similarity("na", "nb", sound).alias("similarity")).where(F.col("similarity") >= least)


#: Keys that a name has at most for partners of one length: parts in order, and sets of letters or words.
ORDERED, SETS = 200, 64
#: Names that a task keeps at once to pass over pairs that are connected already.
KEPT = 200_000
# Letters by their frequency in English, rare ones first; others are rarer.
_COMMON_LAST = {c: i for i, c in enumerate("zqxjkvbpgwyfmculdhrsnioate", 1)}


@lru_cache(maxsize=None)
def _shared(short: int, long: int, most_bytes: int, least: float) -> tuple[int | None, int | None]:
    """What names of two lengths have in common if they are alike: so many letters in one order, or so many letters in any."""
    jaro = (least - 0.4) / 0.6 - 1e-9  # with four common first letters

    def matched(swaps: int) -> int | None:
        return next((m for m in range(1, short + 1) if (m / short + m / long + (m - swaps) / m) / 3 >= jaro), None)

    unedited = max(long - min(2, int((1 - least) * most_bytes + 1e-9)), 0)
    ordered = min((m for m in (matched(0), unedited if unedited <= short else None) if m is not None), default=None)
    swapped = matched(1)
    if ordered is not None and (ordered == swapped or comb(long, ordered) > ORDERED):
        return None, ordered
    return ordered, swapped


def _subsets(items: list[str], common: int, most: int) -> Iterator[tuple]:
    """Keys of a list of which at least one is met in any list of up to ``most`` items that shares ``common`` with it.

    Both are in one order.  The first c shared items are among the first
    n - common + c of each, so sets of c of these are the keys; c is as large as ``SETS`` allows.
    """
    c = min(common, 1)
    while c < common and comb(most - common + c + 1, c + 1) <= SETS:
        c += 1
    return combinations(items[: len(items) - common + c], c)


def spelling_keys(name: str, lengths: dict[int, int], counts: set[int], least: float) -> set[str]:
    """Keys of a normalised name; two names whose ``link_similarity`` without Soundex is at least ``least`` (above 0) share one.

    Jaro-Winkler needs a number of matched letters that follows from both
    lengths; they come in one order unless more are matched and some swapped.
    Levenshtein leaves a part in order, Jaccard a number of words.  ``lengths``
    are those of all names with their most bytes, ``counts`` their numbers of words.
    """
    n, out = len(name), set()
    met = Counter()
    letters = []
    for c in name:
        letters.append((-met[c], _COMMON_LAST.get(c, 0), c))
        met[c] += 1
    letters = [f"{c}{k}" for k, _, c in sorted(letters)]
    for other in lengths:
        short, long = min(n, other), max(n, other)
        ordered, anyhow = _shared(short, long, max(lengths[n], lengths[other]), least)
        if ordered is not None:
            out |= {f"o{short},{long}:{''.join(part)}" for part in combinations(name, ordered)}
        if anyhow is not None:
            out |= {f"a{short},{long}:{''.join(part)}" for part in _subsets(letters, anyhow, long)}
    words = sorted(set(name.split()), key=lambda w: (-len(w), w))
    for other in counts:
        few, many = min(len(words), other), max(len(words), other)
        common = max(ceil(least / (1 + least) * (few + many) - 1e-9), 1)
        if common <= few:
            out |= {f"w{few},{many}:{' '.join(part)}" for part in _subsets(words, common, many)}
    return out


def spelling_links(entities: DataFrame, least: float = 0.85) -> DataFrame:
    """``(a, b)``: links that connect any two entities (id, name, entity_type) of one type whose names' ``link_similarity`` is at least ``least``, directly or by others.

    Equal names are linked to the smallest id of theirs, which stands for them.
    Different names are compared if they share one of the ``spelling_keys``;
    none alike are lost.  A task passes over pairs that it has connected.
    The lower ``least``, the more keys and pairs.
    """
    e = entities.where("name is not null and entity_type is not null").select("id", "entity_type", normalize_for_linking("name").alias("norm"))
    spelt = materialize(e.groupBy("entity_type", "norm").agg(F.min("id").alias("a")), "spellings")
    same = e.join(spelt, ["entity_type", "norm"]).where("a != id").select("a", F.col("id").alias("b"))
    lengths = {r["n"]: r["bytes"] for r in spelt.groupBy(F.length("norm").alias("n")).agg(F.max(F.octet_length("norm")).alias("bytes")).collect()}
    counts = {r["n"] for r in spelt.select(F.size(F.array_distinct(split_words("norm"))).alias("n")).distinct().collect()}

    def keys(name: str) -> list[tuple]:
        return [(int.from_bytes(blake2b(k.encode(), digest_size=8).digest(), "big", signed=True),) for k in spelling_keys(name, lengths, counts, least)]

    keyed = per_row(spelt.withColumn("x", F.struct("entity_type", "a", "norm")), "x", "norm", keys, "key bigint")
    held = materialize(keyed.select(F.struct("x.entity_type", "key").alias("basket"), "x.a", "x.norm"), "spelling-keys")
    pairs = baskets.pairs(held, "basket", "a", "norm").select("a", "b", "norm_a", "norm_b")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        for batch in batches:
            chosen = []
            for i, (a, b, x, y) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                p, q = top(a), top(b)
                if p != q and alike(x, y, least):
                    above[q] = p
                    chosen.append(i)
            if len(above) > KEPT:
                above.clear()
            yield batch.select(["a", "b"]).take(pa.array(chosen, pa.int64()))

    return same.unionByName(pairs.mapInArrow(connect, spelt.select("a", F.col("a").alias("b")).schema))


def linked_clusters(entities: DataFrame, least: float = 0.85) -> DataFrame:
    """``(id, cluster, canonical)``: connected spellings (``spelling_links``); canonical is the member of the highest confidence, then longest name."""
    links = materialize(spelling_links(entities, least), "spelling-links")
    parts = connected_components(links, "a", "b").withColumnRenamed("node", "id")
    rows = materialize(entities.join(parts, "id", "left").withColumn("cluster", F.coalesce("component", "id")), "clusters")
    best = rows.groupBy("cluster").agg(F.max_by("id", F.struct("confidence", F.length("name"), "id")).alias("canonical"))
    return rows.join(best, "cluster").select("id", "cluster", "canonical")


def linked(entities: DataFrame, strategy: str = "fuzzy", least: float = 0.85, least_cosine: float = 0.9) -> DataFrame:
    """``(id, cluster)`` of entities (id, name, entity_type, confidence and, where vectors count, embedding).

    ``exact``: one name without case, and type.  ``fuzzy``: connected by
    ``link_pairs``.  ``semantic``: connected by a cosine of at least
    ``least_cosine`` among the ten nearest.  ``hybrid``: connected by any of the three.
    """
    if strategy not in ("exact", "fuzzy", "semantic", "hybrid"):
        raise ValueError(f"{strategy!r} is no strategy of linking")
    edges = []
    if strategy in ("exact", "hybrid"):
        first = entities.groupBy(F.lower("name").alias("k"), "entity_type").agg(F.min("id").alias("a"))
        edges.append(entities.select("id", F.lower("name").alias("k"), "entity_type").join(first, ["k", "entity_type"]).where("id != a").select("a", F.col("id").alias("b")))
    if strategy in ("fuzzy", "hybrid"):
        edges.append(link_pairs(entities, least).select("a", "b"))
    if strategy == "semantic" or strategy == "hybrid" and "embedding" in entities.columns:
        from graphmill.operators.search import knn

        near = knn(entities, entities.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")), 11, "id", "embedding", least=least_cosine)
        edges.append(near.where("query_id != id").select(F.col("query_id").alias("a"), F.col("id").alias("b")))
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    parts = connected_components(every, "a", "b").withColumnRenamed("node", "id")
    return entities.select("id").distinct().join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def link_new(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(id, cluster, known)``: new entities (id, name) put into the cluster (cluster, name) of exactly their name, or one of their own.

    Of several clusters with a name the smallest counts; new entities of one name share a new cluster.
    """
    known = clusters.groupBy("name").agg(F.min("cluster").alias("cluster"))
    own = entities.groupBy("name").agg(F.min("id").alias("first"))
    both = entities.join(known, "name", "left").join(own, "name", "left")
    return both.select("id", F.coalesce("cluster", F.concat(F.lit("new_"), F.coalesce("first", "id"))).alias("cluster"), F.col("cluster").isNotNull().alias("known"))


def merge_decisions(members: DataFrame, least: float = 0.8) -> DataFrame:
    """``(group_id, members, merge, confidence, name)`` of groups of alike entities (group_id, id, name, entity_type, confidence).

    A group is merged if it has two members or more, all of one type, whose
    names are on average more than ``least`` alike (equal 1, one holding the
    other 0.9, else the share of common words).  Its name is the longest, of
    these the one of the highest confidence, then the first.
    """
    rows = members.where("name is not null").select("group_id", "id", "name", "entity_type", "confidence").dropDuplicates(["group_id", "id"])
    low = rows.withColumn("low", F.lower("name"))
    pair = baskets.pairs(low, "group_id", "id", "low")
    same, holds = F.col("low_a") == F.col("low_b"), F.contains("low_a", F.col("low_b")) | F.contains("low_b", F.col("low_a"))
    alike = F.when(same, 1.0).when(holds, 0.9).otherwise(jaccard("low_a", "low_b", 0.0))
    likeness = pair.groupBy(F.col("basket").alias("group_id")).agg(F.avg(alike).alias("likeness"))
    g = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.count_distinct(F.coalesce("entity_type", F.lit(""))).alias("types"), F.max_by("name", F.struct(F.octet_length("name"), F.coalesce("confidence", F.lit(0.0)), "name")).alias("name"))
    both = g.join(likeness, "group_id", "left")
    merge = (F.col("members") > 1) & (F.col("types") == 1) & (F.coalesce("likeness", F.lit(0.0)) > least)
    sure = F.when(merge, F.col("likeness")).when((F.col("members") < 2) | (F.col("types") > 1), 1.0).otherwise(1 - F.col("likeness"))
    return both.select("group_id", "members", merge.alias("merge"), sure.alias("confidence"), F.when(merge, F.col("name")).alias("name"))


def fit_for_use(entities: DataFrame, least: float = 0.3, shortest: int = 2) -> DataFrame:
    """Entities of some confidence whose name is not blank and has ``shortest`` bytes or more."""
    return entities.where((F.col("confidence") >= least) & (F.octet_length("name") >= shortest) & F.col("name").rlike(r"\S"))


# ---------------------------------------------------------------- index of mentions


def merged_index(one: DataFrame, other: DataFrame, gone_entities: DataFrame | None = None, gone_chunks: DataFrame | None = None) -> DataFrame:
    """``(entity_id, chunk)`` of two indexes, each mapping once, without those of removed entities (entity_id) or chunks (chunk)."""
    both = one.select("entity_id", "chunk").unionByName(other.select("entity_id", "chunk")).distinct()
    for gone, key in ((gone_entities, "entity_id"), (gone_chunks, "chunk")):
        if gone is not None:
            both = both.join(gone.select(key), key, "left_anti").select("entity_id", "chunk")
    return both


# ---------------------------------------------------------------- facts


def facts_to_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of atomic facts (chunk, subject, predicate, object, temporal_marker, confidence).

    entities(id, name, entity_type, confidence, first_mentioned, last_mentioned);
    relations(source, target, relation_type, confidence, chunk, start_time,
    end_time, temporal_type, causal_strength).  Ids are names in lower case with
    ``_`` for blanks; the type is guessed from the name's form.
    """
    from graphmill.functions.text import fact_time

    key = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), " ", "_"), r"[^\p{L}\p{N}_]", "")
    at = F.when(F.col("temporal_marker").isNotNull(), fact_time("temporal_marker"))
    f = facts.where("subject is not null and object is not null and predicate is not null").withColumn("at", at)
    low = F.lower("name")
    kind = F.when(F.col("name").rlike(r"^\p{Lu}"), F.when(low.rlike("(?:ia|land|istan)$"), "LOCATION").otherwise("PERSON")).when(F.col("name").rlike("[0-9]"), "DATE").otherwise("CONCEPT")
    ends = f.select(F.explode(F.array("subject", "object")).alias("name"), "confidence", "at").withColumn("id", key("name"))
    merged = ends.groupBy("id").agg(F.min("name").alias("name"), F.max("confidence").alias("confidence"), F.min("at").alias("first_mentioned"), F.max("at").alias("last_mentioned"))
    said = F.lower("predicate")
    caused = F.contains(said, F.lit("caused")) | F.contains(said, F.lit("led to"))
    enabled = F.contains(said, F.lit("enabled")) | F.contains(said, F.lit("allowed"))
    timed = F.col("at").isNotNull()
    relations = f.select(
        key("subject").alias("source"), key("object").alias("target"), F.upper("predicate").alias("relation_type"), "confidence", "chunk", F.col("at").alias("start_time"), F.col("at").alias("end_time"),
        F.when(timed & caused, "Caused").when(timed & enabled, "Enabled").alias("temporal_type"),
        F.when(timed & caused, F.col("confidence")).when(timed & enabled, F.col("confidence") * 0.6).alias("causal_strength"),
    )
    return merged.select("id", "name", kind.alias("entity_type"), "confidence", "first_mentioned", "last_mentioned"), relations


def validated_triples(triples: DataFrame, chunks: DataFrame, model=None) -> DataFrame:
    """``triples`` (source, relation_type, target, chunk) with ``valid`` and ``reason``.

    ``chunks``: chunk, content.  A model is asked about each triple and its text
    and answers yes or no; without one a triple is valid if the text holds both names.
    """
    both = triples.join(chunks.select("chunk", "content"), "chunk", "left")
    low = F.lower(F.coalesce("content", F.lit("")))
    holds = lambda c: F.contains(low, F.lower(F.coalesce(c, F.lit(""))))
    whole = F.col("source").isNotNull() & F.col("target").isNotNull()
    reason = F.when(~whole, "no end").when(~holds("source"), "source not in text").when(~holds("target"), "target not in text")
    if model is not None:
        from graphmill.models import generate

        prompt = F.concat_ws("\n", F.lit("Does the text say this? Answer yes or no."), F.concat_ws(" ", "source", "relation_type", "target"), F.col("content"))
        both = both.withColumn("_said", generate(prompt, model))
        reason = F.when(~whole, "no end").when(~F.lower(F.trim("_said")).startswith("yes"), "model says no")
    return both.select(*triples.columns, reason.isNull().alias("valid"), reason.alias("reason"))


def best_match(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(mention, id, similarity)``: the candidate most like each mention among those of its type that share a word."""
    word = lambda df, c: df.withColumn("w", F.explode(F.array_distinct(F.split(normalize_for_linking(c), " "))))
    pair = word(mentions.select("mention", "entity_type"), "mention").join(word(candidates.select("id", "name", "entity_type"), "name"), ["entity_type", "w"]).select("mention", "id", "name").distinct()
    scored = pair.withColumn("similarity", link_similarity("mention", "name"))
    return scored.groupBy("mention").agg(F.max_by("id", F.struct("similarity", "id")).alias("id"), F.max("similarity").alias("similarity"))


def across_documents(members: DataFrame) -> DataFrame:
    """``(a, b, documents, confidence)`` of clusters met in the same documents: 0.7 + 0.1 for each further one, at most 1."""
    pairs = _pairs_in_baskets(members, "cluster", "document").groupBy("a", "b").agg(F.count(F.lit(1)).alias("documents"))
    return pairs.withColumn("confidence", F.least(0.7 + 0.1 * (F.col("documents") - 1), F.lit(1.0)))


def importance(members: DataFrame) -> DataFrame:
    """``(cluster, documents, mentions, importance)``: (0.4 (ln df + 1) + 0.3 (ln mentions + 1) + 0.3 documents) / 3."""
    g = members.groupBy("cluster").agg(F.count_distinct("document").alias("documents"), F.count(F.lit(1)).alias("mentions"))
    score = (0.4 * (F.log(F.col("documents").cast("double")) + 1) + 0.3 * (F.log(F.col("mentions").cast("double")) + 1) + 0.3 * F.col("documents")) / 3
    return g.withColumn("importance", score)


# ---------------------------------------------------------------- concepts


def concepts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, concept)``: capitalised phrases, and words met twice or more among the twenty most frequent."""
    stop = set(CONCEPT_STOP_WORDS)

    def find(text: str) -> list[tuple]:
        from collections import Counter

        out = set()
        for m in _PHRASE.finditer(text):
            words = m.group().split()
            if len(m.group()) >= 3 and len(words) <= 5 and sum(w.lower() in stop for w in words) <= len(words) // 2:
                out.add(m.group())
        plain = [w.strip(".,;:!?()[]{}\"'“”«»—–-#>*`").lower() for w in text.split()]
        counts = Counter(w for w in plain if len(w) >= 3 and w not in stop)
        out |= {w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:20] if n >= 2}
        return [(c,) for c in sorted(out)]

    return per_row(texts, id_col, text_col, find, "concept string")


def ranked_concepts(each: DataFrame, edges: DataFrame, least: float = 0.1, iterations: int = 20) -> DataFrame:
    """``(concept, score, degree, rank, rarity, df)``: 0.4 degree share + 0.4 PageRank / best + 0.2 tanh(idf / 5)."""
    from graphmill.operators.graph import oriented, pagerank

    n = each.agg(F.count_distinct("id").alias("docs"))
    df = each.groupBy("concept").agg(F.count_distinct("id").alias("df"))
    steps = materialize(edges.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("n").cast("double").alias("weight")), "concept-edges")
    both = oriented(steps)
    pr = pagerank(both, iterations=iterations, tolerance=1e-6)
    best = pr.agg(F.max("score").alias("best"))
    deg = both.groupBy(F.col("source").alias("concept")).agg(F.count(F.lit(1)).alias("links"))
    total = df.agg(F.count(F.lit(1)).alias("nodes"))
    rows = df.join(deg, "concept", "left").join(pr.withColumnRenamed("node", "concept"), "concept", "left").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(best)).crossJoin(F.broadcast(total))  # one row each
    degree = F.when(F.col("nodes") > 1, F.coalesce("links", F.lit(0)) / (F.col("nodes") - 1)).otherwise(0.0)
    rank = F.coalesce(F.col("score") / F.col("best"), F.lit(0.0))
    rarity = F.tanh(F.log(F.col("docs") / F.col("df")) / 5)
    out = rows.select("concept", (0.4 * degree + 0.4 * rank + 0.2 * rarity).alias("score"), degree.alias("degree"), rank.alias("rank"), rarity.alias("rarity"), "df")
    return out.where(F.col("score") >= least)


def deepening_search(each: DataFrame, edges: DataFrame, start: list[str], depths: int = 3, per_depth: int = 5, most: int = 50) -> DataFrame:
    """``(id, score)``: texts that hold the start concepts or concepts linked to them, explored in up to ``depths`` rings.

    A text scores (ln f + 1)(1 + 0.5 l): f concepts of it found, l of them linked to a start concept.
    """
    spark = each.sparkSession
    ring = spark.createDataFrame([(c, 0) for c in start], "concept string, depth int")
    found = ring
    links = edges.select(F.col("a").alias("concept"), F.col("b").alias("other"), "n").unionByName(edges.select(F.col("b").alias("concept"), F.col("a").alias("other"), "n"))
    for d in range(1, depths):
        step = ring.join(links, "concept").groupBy(F.col("other").alias("concept")).agg(F.sum("n").alias("n")).join(found.select("concept"), "concept", "left_anti")
        ring = materialize(step.orderBy(F.desc("n"), "concept").limit(per_depth).select("concept", F.lit(d).alias("depth")), "ring")
        found = found.unionByName(ring)
    hit = each.join(F.broadcast(found), "concept")  # at most depths * per_depth concepts
    g = hit.groupBy("id").agg(F.count(F.lit(1)).alias("f"), F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("l"))
    return g.select("id", ((F.log(F.col("f").cast("double")) + 1) * (1 + 0.5 * F.col("l"))).alias("score")).orderBy(F.desc("score"), "id").limit(most)
