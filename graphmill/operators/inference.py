"""Relations by cue words, hierarchies of relations, concept anchors, weight tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphmill.functions.similarity import levenshtein_similarity
from graphmill.functions.text import split_words
from graphmill.operators.components import connected_components
from graphmill.operators.graph import pagerank
from graphmill.session import materialize

# Cue words between two entities of given types, the relation they show, and its confidence.
CUES = (
    ("PERSON", "ORGANIZATION", "works for|employed|joined|member of", "WORKS_FOR", 0.8),
    ("PERSON", "ORGANIZATION", "founded|established|created", "FOUNDED", 0.9),
    ("PERSON", "PERSON", "taught|teacher|mentor", "TAUGHT", 0.8),
    ("PERSON", "PERSON", "married|wife|husband", "MARRIED_TO", 0.9),
    ("PERSON", "PERSON", "met|wrote to|and", "KNOWS", 0.6),
    ("PERSON", "LOCATION", "born|lives|lived|from", "LIVES_IN", 0.8),
    ("ORGANIZATION", "LOCATION", "based|located|near|in ", "LOCATED_IN", 0.7),
)


def relations_by_cues(mentions: DataFrame, chunks: DataFrame, reach: int = 50) -> DataFrame:
    """``(chunk, source, target, relation_type, confidence)`` from the text between two mentions and ``reach`` characters past the second.

    ``mentions``: chunk, entity_id, entity_type, start_offset, end_offset;
    ``chunks``: chunk, content.  Only mentions at most 300 characters apart in
    one chunk are paired; the surest cue of a pair counts.
    """
    m = mentions.select("chunk", "entity_id", "entity_type", "start_offset", "end_offset")
    # Mentions are joined by the window of 300 characters they lie in and the one before, not by chunk alone.
    a = m.withColumnsRenamed({c: f"{c}_a" for c in m.columns[1:]}).withColumn("w", F.explode(F.array(F.floor(F.col("start_offset_a") / 300), F.floor(F.col("start_offset_a") / 300) + 1)))
    b = m.withColumnsRenamed({c: f"{c}_b" for c in m.columns[1:]}).withColumn("w", F.floor(F.col("start_offset_b") / 300))
    near = a.join(b, ["chunk", "w"]).where("start_offset_a < start_offset_b and start_offset_b - end_offset_a <= 300 and entity_id_a != entity_id_b").drop("w").distinct()
    text = near.join(chunks.select("chunk", "content"), "chunk").withColumn("between", F.lower(F.col("content").substr(F.col("start_offset_a").cast("int") + 1, (F.col("end_offset_b") - F.col("start_offset_a") + reach).cast("int")))).drop("content")

    def hit(x: str, y: str) -> Column:
        rules = [F.when((F.col(f"entity_type_{x}") == s) & (F.col(f"entity_type_{y}") == t) & F.col("between").rlike(p), F.struct(F.lit(c).alias("confidence"), F.lit(r).alias("relation_type"))) for s, t, p, r, c in CUES]
        return F.array_max(F.array_compact(F.array(*rules)))

    both = text.withColumn("ab", hit("a", "b")).withColumn("ba", hit("b", "a"))
    forward = both.where("ab is not null").select("chunk", F.col("entity_id_a").alias("source"), F.col("entity_id_b").alias("target"), F.col("ab.relation_type").alias("relation_type"), F.col("ab.confidence").alias("confidence"))
    back = both.where("ab is null and ba is not null").select("chunk", F.col("entity_id_b").alias("source"), F.col("entity_id_a").alias("target"), F.col("ba.relation_type").alias("relation_type"), F.col("ba.confidence").alias("confidence"))
    out = forward.unionByName(back)
    return out.groupBy("chunk", "source", "target", "relation_type").agg(F.max("confidence").alias("confidence"))


def similar_relations(relations: DataFrame, least: float = 0.3) -> DataFrame:
    """``(a, b, similarity)`` of relation ids: 0.5 for one type, 0.3 for a shared source or target, 0.2 * overlap of their times; above ``least``.

    ``relations``: rel_id, source, target, relation_type, start_time, end_time.
    Pairs that share an end are found by that end and grow with the square of
    its relations; pairs of one type alone score 0.5 and are not listed.  For
    groups use ``relation_clusters``, which makes no pairs.
    """
    r = relations.select("rel_id", "source", "target", "relation_type", "start_time", "end_time")
    side = lambda s: r.select(*[F.col(c).alias(f"{c}_{s}") for c in r.columns])
    a, b = side("a"), side("b")
    ends = a.join(b, F.col("source_a") == F.col("source_b")).unionByName(a.join(b, F.col("target_a") == F.col("target_b"))).where("rel_id_a < rel_id_b").distinct()
    low, high = F.greatest("start_time_a", "start_time_b"), F.least("end_time_a", "end_time_b")
    span = F.greatest("end_time_a", "end_time_b") - F.least("start_time_a", "start_time_b")
    known = F.col("start_time_a").isNotNull() & F.col("end_time_a").isNotNull() & F.col("start_time_b").isNotNull() & F.col("end_time_b").isNotNull()
    overlap = F.when(known & (high >= low), F.when(span > 0, (high - low) / span).otherwise(1.0)).otherwise(0.0)
    score = F.when(F.col("relation_type_a") == F.col("relation_type_b"), 0.5).otherwise(0.0) + 0.3 + 0.2 * overlap
    return ends.select(F.col("rel_id_a").alias("a"), F.col("rel_id_b").alias("b"), score.alias("similarity")).where(F.col("similarity") > least)


def relation_clusters(relations: DataFrame) -> DataFrame:
    """``(level, rel_id, cluster, size, cohesion)``: connected relations whose similarity exceeds 0.3, 0.5 and 0.8 at levels 0, 1 and 2.

    No pairs are made.  What the similarity can be tells who is connected:
    above 0.8 are relations of one type that share an end while their times
    overlap; above 0.5 those of one type that share an end; above 0.3 those of
    one type, or that share an end while their times overlap.  Groups of equals
    are joined through their first member, overlapping times by a sweep in
    order of their start.  Cohesion is 0.2 + 0.6 * the share of one type.
    """
    r = materialize(relations.select("rel_id", "source", "target", "relation_type", "start_time", "end_time").dropDuplicates(["rel_id"]), "relations")

    def through_first(*by: str) -> DataFrame:
        first = r.groupBy(*by).agg(F.min("rel_id").alias("a"))
        return r.join(first, list(by)).where("a != rel_id").select("a", F.col("rel_id").alias("b"))

    def while_overlapping(*by: str) -> DataFrame:
        timed = r.where("start_time is not null and end_time is not null")
        w = W.partitionBy(*by).orderBy("start_time", "rel_id")
        swept = timed.select("rel_id", "start_time", F.max("end_time").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("until"), F.lag("rel_id").over(w).alias("a"))
        return swept.where(F.col("start_time") <= F.col("until")).select("a", F.col("rel_id").alias("b"))

    def both(make, *more: str) -> DataFrame:
        return make("source", *more).unionByName(make("target", *more))

    levels = (through_first("relation_type").unionByName(both(while_overlapping)), both(through_first, "relation_type"), both(while_overlapping, "relation_type"))
    out = None
    for level, edges in enumerate(levels):
        parts = connected_components(edges, "a", "b").withColumnRenamed("node", "rel_id")
        rows = r.join(parts, "rel_id", "left").select(F.lit(level).alias("level"), "rel_id", "relation_type", F.coalesce("component", "rel_id").alias("cluster"))
        out = rows if out is None else out.unionByName(rows)
    out = materialize(out, "relation-clusters")
    kinds = out.groupBy("level", "cluster", "relation_type").agg(F.count(F.lit(1)).alias("k")).groupBy("level", "cluster").agg(F.sum("k").alias("size"), (0.2 + 0.6 * F.max("k") / F.sum("k")).alias("cohesion"))
    return out.drop("relation_type").join(kinds, ["level", "cluster"])


def concept_matches(queries: DataFrame, concepts: DataFrame, least: float = 0.7) -> DataFrame:
    """``(query_id, concept, score, how)``: ``exact`` words shared (share of the concept's words), else ``fuzzy`` (one minus edits / length, same first letter).

    ``queries``: query_id, query; ``concepts``: concept.  Exact matches join on
    words, fuzzy ones on the first letter and a length at most 2 apart.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(split_words(F.lower("query")))).alias("w"))
    c = concepts.select("concept").distinct().withColumn("words", F.array_distinct(split_words(F.lower("concept"))))
    exact = q.join(c.select("concept", F.size("words").alias("n"), F.explode("words").alias("w")), "w").groupBy("query_id", "concept", "n").agg((F.count(F.lit(1))).alias("k")).select("query_id", "concept", (F.col("k") / F.col("n")).alias("score"), F.lit("exact").alias("how"))
    one = c.where(F.size("words") == 1).select("concept", F.element_at("words", 1).alias("cw"))
    keyed = one.withColumn("key", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.concat(F.substring("cw", 1, 1), (F.length("cw") + d).cast("string")))))
    fuzzy = q.where(F.length("w") > 3).withColumn("key", F.concat(F.substring("w", 1, 1), F.length("w").cast("string"))).join(keyed, "key").where("w != cw").select("query_id", "concept", levenshtein_similarity("w", "cw").alias("score"), F.lit("fuzzy").alias("how"))
    both = exact.unionByName(fuzzy).where(F.col("score") >= least)
    return both.groupBy("query_id", "concept").agg(F.max(F.struct("score", "how")).alias("x")).select("query_id", "concept", "x.score", "x.how")


def anchors(queries: DataFrame, entities: DataFrame, relations: DataFrame, iterations: int = 20) -> DataFrame:
    """``(query_id, id, relevance)``: entities whose name holds a query word, by 0.4 * share of the words + 0.6 * PageRank / best."""
    rank = pagerank(relations.select("source", "target"), iterations=iterations)
    best = rank.agg(F.max("score").alias("best"))
    words = queries.select("query_id", F.array_distinct(split_words(F.lower("query"))).alias("ws")).select("query_id", F.size("ws").alias("n"), F.explode("ws").alias("w")).where("length(w) > 2")
    named = entities.select("id", F.explode(F.array_distinct(split_words(F.lower("name")))).alias("w"))
    hits = words.join(named, "w").groupBy("query_id", "id", "n").agg(F.count(F.lit(1)).alias("k"))
    r = hits.join(rank.withColumnRenamed("node", "id"), "id", "left").crossJoin(F.broadcast(best))  # one row
    return r.select("query_id", "id", (0.4 * F.col("k") / F.col("n") + 0.6 * F.coalesce(F.col("score") / F.col("best"), F.lit(0.0))).alias("relevance"))


def refined_queries(results: DataFrame, texts: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int = 5, terms: int = 3) -> DataFrame:
    """``(query_id, query)`` with the ``terms`` most frequent longer words of its ``k`` best results added (relevance feedback)."""
    from graphmill.functions.text import plain_tokens
    from graphmill.operators.search import ranked, top_k

    best = ranked(results.select("query_id", "id", "score"), k)
    words = best.join(texts.select(F.col(id_col).alias("id"), F.explode(plain_tokens(text_col)).alias("w")), "id").groupBy("query_id", "w").agg(F.count_distinct("id").alias("d"), F.count(F.lit(1)).alias("n"))
    have = queries.select("query_id", F.explode(split_words(F.lower("query"))).alias("w"))
    new = top_k(words.join(have, ["query_id", "w"], "left_anti"), terms, ["query_id"], [F.desc("d"), F.desc("n"), F.asc("w")])
    added = new.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("x"))  # at most ``terms`` of them
    return queries.join(added, "query_id", "left").select("query_id", F.concat_ws(" ", "query", F.array_join(F.transform(F.coalesce("x", F.array().cast("array<struct<rank:int,w:string>>")), lambda s: s["w"]), " ")).alias("query"))


def tuned_weights(edges: DataFrame, evaluate, rounds: int = 10, step: float = 0.1, target: float = 0.95) -> tuple[DataFrame, float]:
    """Edges with weights of each relation type raised or lowered while ``evaluate(edges)`` (a quality in [0, 1]) improves.

    Types are few; their factors are kept on the driver and tried one by one.
    Stops at ``target`` or when a whole round brings nothing.
    """
    kinds = sorted(r[0] for r in edges.select("relation_type").distinct().collect())
    factor = {k: 1.0 for k in kinds}

    def weighted(f: dict[str, float]) -> DataFrame:
        table = F.create_map(*[F.lit(x) for kv in f.items() for x in kv])
        return edges.withColumn("weight", F.col("weight") * table[F.col("relation_type")])

    best = evaluate(weighted(factor))
    for _ in range(rounds):
        before = best
        for kind in kinds:
            for change in (1 + step, 1 / (1 + step)):
                tried = factor | {kind: factor[kind] * change}
                quality = evaluate(weighted(tried))
                if quality > best:
                    best, factor = quality, tried
                    break
            if best >= target:
                return weighted(factor), best
        if best <= before:
            break
    return weighted(factor), best
