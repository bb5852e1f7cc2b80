"""Retrieval over graph, structure and communities; ranked lists have the columns of ``operators.search``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphmill.functions.similarity import text_similarity
from graphmill.functions.text import split_words
from graphmill.operators.search import merge_lists, ranked, small, top_k
from graphmill.session import materialize

# ---------------------------------------------------------------- structure


def structure_references(query: str | Column) -> Column:
    """``chapter 3``, ``section 2.1``, ``part iv``: the first of each kind that a query names, in lower case."""
    q = F.lower(F.col(query) if isinstance(query, str) else query)
    found = [F.regexp_extract(q, p, 0) for p in (r"chapter\s+(?:\d+|[ivxlcdm]+|\w+)", r"section\s+\d+\.?\d*", r"part\s+(?:\d+|[ivxlcdm]+)")]
    return F.filter(F.array(*found), lambda x: x != "")


def structure_filter(results: DataFrame, queries: DataFrame, chunks: DataFrame, parts: tuple[str, ...] = ("chapter",)) -> DataFrame:
    """``results`` (query_id, id, …) whose chunk lies in a chapter or section that the query names.

    Queries that name none keep all; results without a known chunk are kept.
    """
    q = queries.select("query_id", structure_references("query").alias("_refs"))
    meta = chunks.select(F.col("id"), F.array_compact(F.array(*[F.lower(c) for c in parts])).alias("_parts")).dropDuplicates(["id"])
    both = results.join(small(q), "query_id", "left").join(meta, "id", "left")
    holds = F.exists("_refs", lambda r: F.exists("_parts", lambda p: F.contains(p, r)))
    keep = F.coalesce(F.size("_refs"), F.lit(0)).isin(0, -1) | F.col("_parts").isNull() | holds
    return both.where(keep).select(*results.columns)


def chunks_of(chunks: DataFrame, name: str, column: str = "chapter") -> DataFrame:
    """Chunks whose chapter (or section) holds a name, whatever its case."""
    return chunks.where(F.contains(F.lower(column), F.lit(name.lower())))


# ---------------------------------------------------------------- graph


def entity_paths(pairs: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(query_id, id, score, entities)``: how two named entities are connected.

    ``pairs``: query_id, first, second (names, compared without case);
    ``relations``: source, target (ids), confidence.  An edge from the first to
    the second scores 0.8; a neighbour that both lead to 0.6 * both confidences.
    """
    named = entities.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("id", "name")).alias("e"))
    side = lambda col, n: named.select(F.col("key").alias(f"k{n}"), F.col("e").alias(f"e{n}"))
    ends = pairs.select("query_id", F.lower("first").alias("ka"), F.lower("second").alias("kb")).join(side("first", "a"), "ka").join(side("second", "b"), "kb")
    out = relations.groupBy("source", "target").agg(F.max("confidence").alias("c"))
    a = ends.join(out.withColumnsRenamed({"target": "via", "c": "ca"}), F.col("ea.id") == F.col("source")).drop("source")
    direct = a.where(F.col("via") == F.col("eb.id")).select("query_id", F.concat_ws("_", F.lit("path"), "ea.id", "eb.id").alias("id"), F.lit(0.8).alias("score"), F.array("ea.name", "eb.name").alias("entities"))
    b = a.join(out.select(F.col("source").alias("sb"), F.col("target").alias("via"), F.col("c").alias("cb")), "via").where(F.col("sb") == F.col("eb.id"))
    names = entities.groupBy(F.col("id").alias("via")).agg(F.min("name").alias("via_name"))
    joined = b.join(names, "via", "left")
    indirect = joined.select("query_id", F.concat_ws("_", F.lit("path"), "ea.id", "via", "eb.id").alias("id"), (0.6 * F.col("ca") * F.col("cb")).alias("score"), F.array("ea.name", F.coalesce("via_name", "via"), "eb.name").alias("entities"))
    return direct.unionByName(indirect)


def central_entities(similar: DataFrame, relations: DataFrame, k: int = 3) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` entities of the largest similarity (``query_id, id, score``) + 0.1 * out-edges."""
    out = relations.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    scored = similar.join(out, "id", "left").select("query_id", "id", (F.col("score") + 0.1 * F.coalesce("out", F.lit(0))).alias("score"))
    return ranked(scored, k)


def fuzzy_matches(queries: DataFrame, entities: DataFrame, chunks: DataFrame, relations: DataFrame, least: float = 0.6, k: int = 10, per_entity: int = 5) -> DataFrame:
    """``(query_id, id, score, match, rank)``: entities and chunks like a query, and what they lead to.

    An equal name scores 1, a similar one (0.4 Jaccard + 0.4 containment + 0.2
    Levenshtein, at least ``least``) 0.9 of it; a type that is a word of the
    query 0.7 * its share of the words.  Chunks score their similarity, and the
    share of the query's words they hold if it is at least 0.8 * ``least``.
    Neighbours of matched entities score 0.6 * confidence.  A query is compared
    with every name, as the score needs no word in common; queries are few and
    broadcast, up to the bound of ``search.small``.
    """
    q = small(queries.select("query_id", "query", F.lower("query").alias("low"), split_words(F.lower("query")).alias("words")))
    e = entities.select("id", "name", "entity_type").crossJoin(q)
    same = F.lower("name") == F.col("low")
    like = text_similarity("query", "name")
    exact = e.where(same).select("query_id", "id", F.lit(1.0).alias("score"), F.lit("ExactEntity").alias("match"))
    partial = e.where(~same).withColumn("s", like).where(F.col("s") >= least).select("query_id", "id", (F.col("s") * 0.9).alias("score"), F.lit("PartialEntity").alias("match"))
    share = F.size(F.filter("words", lambda w: w == F.lower("entity_type"))) / F.size("words")
    typed = e.where(~same & F.array_contains("words", F.lower("entity_type"))).select("query_id", F.concat(F.lit("type_"), "id").alias("id"), (share * 0.7).alias("score"), F.lit("SemanticEntity").alias("match"))
    c = chunks.select(F.col("id").cast("string").alias("id"), "content").where("content is not null").crossJoin(q)
    content = c.withColumn("s", text_similarity("query", "content")).where(F.col("s") >= least).select("query_id", "id", F.col("s").alias("score"), F.lit("ChunkContent").alias("match"))
    have = split_words(F.lower("content"))
    held = c.withColumn("s", F.size(F.filter("words", lambda w: F.array_contains(have, w))) / F.size("words")).where(F.col("s") >= 0.8 * least)
    keywords = held.select("query_id", F.concat(F.lit("keywords_"), "id").alias("id"), F.col("s").alias("score"), F.lit("ChunkContent").alias("match"))
    found = exact.unionByName(partial)
    step = found.select("query_id", F.col("id").alias("source")).join(relations.select("source", "target", "confidence"), "source")
    near = top_k(step, per_entity, ["query_id", "source"], [F.desc("confidence"), F.asc("target")]).where(F.col("confidence") * 0.6 >= 0.7 * least)
    expanded = near.groupBy("query_id", "target").agg(F.max("confidence").alias("c")).select("query_id", F.concat(F.lit("expanded_"), "target").alias("id"), (F.col("c") * 0.6).alias("score"), F.lit("RelatedConcept").alias("match"))
    every = found.unionByName(typed).unionByName(content).unionByName(keywords).unionByName(expanded)
    return ranked(every, k)


def communities_about(query: str, label: DataFrame, names: DataFrame, level: int = 0) -> DataFrame:
    """``(level, community, summary)`` of communities of which a member's name holds the whole query; without case.

    ``label``: node, community (and level, if there are several); ``names``: id, name.
    """
    some = label.where(F.col("level") == level) if "level" in label.columns else label
    m = some.join(names.select(F.col("id").alias("node"), "name"), "node")
    hit = m.where(F.contains(F.lower("name"), F.lit(query.lower()))).select("community").distinct()
    top = m.join(hit, "community", "left_semi").withColumn("_r", F.row_number().over(W.partitionBy("community").orderBy("name", "node"))).where("_r <= 20")
    listed = top.groupBy("community").agg(F.array_sort(F.collect_list("name")).alias("n"))  # at most 20 names
    return listed.select(F.lit(level).alias("level"), "community", F.concat(F.lit("Entities: "), F.array_join("n", ", ")).alias("summary"))


# ---------------------------------------------------------------- two levels


def two_level_keywords(queries: DataFrame, model: Callable[[list[str]], list[str]] | None = None, most: int = 20) -> DataFrame:
    """``(query_id, high, low)``: topics and particulars that a model names as JSON, or else the query's words.

    A model gets the query and answers ``{"high_level": […], "low_level": […]}``.
    Without one, or where its answer is no such JSON, empty, or longer than
    ``most`` words, the first ten words of more than three bytes are the low level.
    """
    words = F.slice(F.filter(split_words(F.lower("query")), lambda w: F.octet_length(w) > 3), 1, 10)
    none = F.array().cast("array<string>")
    if model is None:
        return queries.select("query_id", none.alias("high"), words.alias("low"))
    from graphmill.models import generate

    said = F.from_json(F.regexp_extract(generate(F.col("query"), model), r"(?s)\{.*\}", 0), "high_level array<string>, low_level array<string>")
    read = queries.withColumn("_x", said).withColumn("_h", F.coalesce("_x.high_level", none)).withColumn("_l", F.coalesce("_x.low_level", none))
    fine = (F.size("_h") + F.size("_l")).between(1, most)
    return read.select("query_id", F.when(fine, F.col("_h")).otherwise(none).alias("high"), F.when(fine, F.col("_l")).otherwise(words).alias("low"))


def two_level_search(keywords: DataFrame, high: Callable[[DataFrame], DataFrame], low: Callable[[DataFrame], DataFrame], k: int = 10, how: str = "interleave") -> DataFrame:
    """``(query_id, id, score, rank)``: topics looked up in one index and particulars in another, merged.

    ``high`` and ``low`` get ``query_id, query`` and give ``query_id, id, score``.
    """
    asked = lambda c: keywords.where(F.size(c) > 0).select("query_id", F.array_join(c, " ").alias("query"))
    lists = [ranked(search(asked(c)).select("query_id", "id", "score"), k).drop("rank") for search, c in ((high, "high"), (low, "low"))]
    return merge_lists(*lists, how=how).where(F.col("rank") <= k)


# ---------------------------------------------------------------- plain search and reranking


def memory_search(documents: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """``(id, score)``: 0.85 where the text holds the query, without case; what would score 0.1 is left out."""
    return documents.where(F.contains(F.lower(text_col), F.lit(query.lower()))).select(F.col(id_col).alias("id"), F.lit(0.85).alias("score"))


def reranked(results: DataFrame, k: int = 10, least: float = 0.0, model: Callable[[list[str], list[str]], list[float]] | None = None) -> DataFrame:
    """``results`` (query_id, query, id, content, score) with the score of a model of query and content; without one the score stays."""
    if model is not None:
        import pandas as pd

        @F.pandas_udf("double")
        def judge(q: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series(model(list(q), list(c)), dtype="float64")

        results = results.withColumn("score", judge("query", "content"))
    return ranked(results.where(F.col("score") >= least), k)


def chunks_of_ranked(ranked_entities: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(id, chunk, score, content)``: the chunks (chunk, content) that mention a ranked entity (id, score), by mentions (entity_id, chunk).

    An entity no chunk mentions keeps one row without chunk and its id as content.
    """
    m = mentions.select(F.col("entity_id").alias("id"), "chunk").distinct().join(chunks.select("chunk", "content"), "chunk")
    return ranked_entities.select("id", "score").join(m, "id", "left").select("id", "chunk", "score", F.coalesce("content", F.col("id").cast("string")).alias("content"))


def in_order(subqueries: DataFrame, depends: DataFrame, most: int = 50) -> DataFrame:
    """``(id, turn)``: parts of a question (id) by the turn in which they can be answered; ``depends`` has id and on.

    Parts that wait for each other in a circle are an error.
    """
    waits = depends.select("id", "on").distinct()
    turn = subqueries.select("id", F.lit(0).alias("turn"))
    for _ in range(most):
        later = waits.join(turn.select(F.col("id").alias("on"), (F.col("turn") + 1).alias("t")), "on").groupBy("id").agg(F.max("t").alias("t"))
        new = materialize(turn.join(later, "id", "left").select("id", F.greatest("turn", F.coalesce("t", F.lit(0))).alias("turn")), "turns")
        if new.exceptAll(turn).isEmpty():
            return new
        turn = new
    raise ValueError("parts of the question wait for each other")
