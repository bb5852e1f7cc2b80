"""Ranked retrieval: keyword, vector, fused and boosted lists.

A ranked list has the columns ``query_id, id, score`` and whatever else its
maker keeps.  Every ranking breaks ties by id, so results do not depend on the
partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from graphmill.functions.text import content_signature, keyword_tokens, plain_tokens, search_tokens
from graphmill.functions.vector import closeness, cosine
from graphmill.session import materialize

#: Largest number of queries that is broadcast to the documents; more are joined by shuffle.
FEW_QUERIES = 10_000


def small(df: DataFrame, rows: int = FEW_QUERIES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ---------------------------------------------------------------- keyword search


def postings(docs: DataFrame, id_col: str, text_col: str, tokens: Column | None = None) -> DataFrame:
    """``(id, length, term, n)``: how often each document holds each term, and how many tokens it has."""
    toks = tokens if tokens is not None else search_tokens(text_col)
    each = docs.select(F.col(id_col).alias("id"), toks.alias("t")).select("id", F.size("t").alias("length"), F.explode("t").alias("term"))
    return each.groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a document and term are one row


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, k1: float = 1.2, b: float = 0.75, tf: str = "relative") -> DataFrame:
    """``(query_id, id, score)`` of every document that holds a query term.

    ``queries`` has ``query_id, query``.  Texts are cut into tokens once, into a
    stored table of length and query terms of each document; lengths and counts
    come from it.  A term repeated in a query counts as often.  ``tf="raw"``
    uses counts, the default counts divided by the length.
    """
    terms = queries.select("query_id", F.explode(search_tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    few = terms.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES
    toks = docs.select(F.col(id_col).alias("id"), search_tokens(text_col).alias("t"))
    length = F.size("t").alias("length")
    if few:  # at most FEW_QUERIES terms
        known = [r[0] for r in terms.select("term").distinct().collect()]
        kept = F.filter("t", lambda w: w.isin(known)) if known else F.array().cast("array<string>")
        terms = F.broadcast(terms)
    else:
        kept = F.col("t")
    read = materialize(toks.select("id", length, kept.alias("t")), "tokens")
    whole = read.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    hits = read.select("id", "length", F.explode("t").alias("term"))
    if not few:
        hits = hits.join(terms.select("term").distinct(), "term", "left_semi")
    hits = hits.groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("n"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    freq = F.col("n") / F.col("length") if tf == "relative" else F.col("n").cast("double")
    joined = hits.join(df, "term").join(terms, "term").crossJoin(F.broadcast(whole))  # one row
    idf = F.log(F.col("docs") / F.col("df")) + 1
    part = F.col("times") * idf * (freq * (k1 + 1)) / (freq + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return joined.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def tfidf(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, term, tf, df, score)``: share of the document's tokens times ln(documents / df), at least 0."""
    post = postings(docs, id_col, text_col, keyword_tokens(text_col))
    n = docs.agg(F.count(F.lit(1)).alias("docs"))
    out = post.join(document_frequency(post), "term").crossJoin(F.broadcast(n))  # one row
    tf = F.col("n") / F.col("length")
    return out.select("id", "term", tf.alias("tf"), "df", F.greatest(tf * F.log(F.col("docs") / F.col("df")), F.lit(0.0)).alias("score"))


def frequent_words(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(id, term, n, rank)``: the ``k`` most frequent longer words of each document."""
    post = postings(docs, id_col, text_col, plain_tokens(text_col))
    return top_k(post.select("id", "term", "n"), k, ["id"], [F.desc("n"), F.asc("term")])


# ---------------------------------------------------------------- ranking


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1 in ``rank``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def ranked(df: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    return top_k(df, k, [by], [F.desc("score"), F.asc("id")])


def best_per_id(df: DataFrame) -> DataFrame:
    """One row per query and id, the one of the highest score."""
    rest = [c for c in df.columns if c not in ("query_id", "id", "score") and df.schema[c].dataType.typeName() not in ("map", "variant")]
    w = W.partitionBy("query_id", "id").orderBy(F.desc("score"), *rest)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_per_content(df: DataFrame, content_col: str) -> DataFrame:
    """One row per query and content signature, the one of the highest score."""
    w = W.partitionBy("query_id", "_s").orderBy(F.desc("score"), F.asc("id"))
    return df.withColumn("_s", content_signature(content_col)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_s")


# How much of the result one type may take.
TYPE_QUOTA = {"Entity": 3, "Chunk": 2, "HierarchicalSummary": 4, "Hybrid": 4, "GraphPath": 5}


def type_quota(df: DataFrame, k: int, type_col: str = "result_type") -> DataFrame:
    """At most k / 3 entities, k / 2 chunks, k / 4 summaries, k / 4 hybrids and k / 5 paths per query."""
    quota = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for t, d in TYPE_QUOTA.items() for x in (t, k // d)]), F.col(type_col)), F.lit(0))
    w = W.partitionBy("query_id", type_col).orderBy(F.desc("score"), F.asc("id"))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota).drop("_r")


def diverse(df: DataFrame, k: int) -> DataFrame:
    """Up to ``k`` rows per query chosen in order of score: those above 0.8, those that bring a new entity,
    and any while fewer than half are chosen; the best of the others fill up.

    A row left out has no entity that those before it lack, so a row brings a
    new one if it is the first of all rows to hold it.  That makes the choice
    an aggregate and two rankings, without walking any list.
    """
    order = [F.desc("score"), F.asc("id")]
    rows = df.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    first = rows.select("query_id", "_r", F.explode("entities").alias("e")).groupBy("query_id", "e").agg(F.min("_r").alias("_r")).select("query_id", "_r").distinct().withColumn("_new", F.lit(True))
    fine = (F.col("score") > 0.8) | F.col("_new").isNotNull() | (F.col("_r") <= -(-k // 2))
    marked = rows.join(first, ["query_id", "_r"], "left").withColumn("_fine", fine)
    return marked.withColumn("_k", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("_fine"), "_r"))).where(F.col("_k") <= k).select(*df.columns)


# ---------------------------------------------------------------- vectors


def _scores(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scores of all query rows (one a line) with all vector rows, rounded so that equal vectors tie."""
    if metric == "cosine":
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
        return np.round(np.divide(q @ v.T, size, out=np.zeros(size.shape), where=size > 0), 12)
    apart = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T, 0))
    return np.round(np.exp(-apart) if metric == "exp_euclidean" else -apart, 9 if metric == "euclidean" else 12)


def _best_of_batches(shared, k: int, metric: str, least: float | None, id_type: pa.DataType, query_type: pa.DataType):
    """Of every batch of vectors the rows that may be among the ``k`` best of a query, ties included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, by_size = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                part = part.filter(pa.compute.is_valid(part.column(1)))
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for n in np.unique(sizes):
                    if n not in by_size:
                        continue
                    rows = np.flatnonzero(sizes == n)
                    v = part.column(1).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), n)
                    v = np.nan_to_num(v)
                    which, q = by_size[n]
                    for i in range(0, len(q), 512):
                        s = _scores(metric, q[i : i + 512], v)
                        keep = s >= (-np.inf if least is None else least)
                        if s.shape[1] > k:
                            keep &= s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                        a, b = np.nonzero(keep)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(which[i + a])).cast(query_type), part.column(0).take(pa.array(rows[b])).cast(id_type), pa.array(s[a, b])], ["query_id", "id", "score"])

    return run


def _query_blocks(queries: DataFrame) -> Iterator[tuple[pa.Array, dict]]:
    """Query ids and matrices by vector length, ``FEW_QUERIES`` queries at a time."""
    q = queries.select("query_id", "query_vector").where("query_vector is not null")
    n = -(-q.count() // FEW_QUERIES)
    for block in range(n):
        mine = q if n == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block)
        got = mine.toArrow().combine_chunks()
        if not got.num_rows:
            continue
        names, lists = got.column(0).combine_chunks(), got.column(1).to_pylist()
        by_size: dict = {}
        for i, x in enumerate(lists):
            by_size.setdefault(len(x), []).append(i)
        yield names, {size: (np.array(at), np.nan_to_num(np.array([lists[i] for i in at], dtype=float).reshape(len(at), size))) for size, at in by_size.items()}


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, metric: str = "cosine", least: float | None = None) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` best vectors of each query vector, exactly.

    ``queries`` has ``query_id, query_vector``.  It is compared whole with
    every row: blocks of ``FEW_QUERIES`` queries are broadcast and multiplied
    with batches of vectors, and of each batch only the rows that may be among
    the best are shuffled.  Metrics: ``cosine``, ``exp_euclidean`` (exp of
    minus the distance) and ``euclidean`` (nearest first).  Null vectors and
    those of another length than the query's do not answer; ties go to the
    smaller id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    types = [pa.schema(to_arrow_schema(df.schema)).field(0).type for df in (queries.select("query_id"), rows.select("id"))]
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    out = spark.createDataFrame([], schema)
    for block in _query_blocks(queries):
        run = _best_of_batches(spark.sparkContext.broadcast(block), k, metric, least, types[1], types[0])
        out = out.unionByName(rows.mapInArrow(run, schema))
    return ranked(out, k)


def within(vectors: DataFrame, queries: DataFrame, least: float, id_col: str, vector_col: str, metric: str = "cosine") -> DataFrame:
    """``(query_id, id, score)``: all vectors at least that similar to a query vector."""
    q = small(queries.select("query_id", "query_vector"))
    sim = {"cosine": cosine, "exp_euclidean": closeness}[metric]("query_vector", vector_col)
    return vectors.join(q, F.size(vector_col) == F.size("query_vector")).select("query_id", F.col(id_col).alias("id"), sim.alias("score")).where(F.col("score") >= least)


def centroid(vectors: DataFrame, vector_col: str, by: list[str]) -> DataFrame:
    """``(…, pos, value)``: mean of each place over the vectors of a group."""
    return vectors.select(*by, F.posexplode(vector_col).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


# ---------------------------------------------------------------- fusion


def fuse(left: DataFrame, right: DataFrame, method: str = "rrf", left_weight: float = 0.7, right_weight: float = 0.3, k: float = 60.0, least: float = 0.0) -> DataFrame:
    """``(query_id, id, score, left_score, right_score)`` of two ranked lists.

    ``rrf``: weight / (k + rank) summed, rank from 1.  ``weighted``: scores
    divided by the list's best, weighted and summed.  ``combsum``: sum.
    ``max``: the larger.  An id missing from a list has 0 there.
    """
    w = W.partitionBy("query_id")

    def side(df: DataFrame, weight: float, name: str) -> DataFrame:
        if method == "rrf":
            part = weight / (k + F.row_number().over(w.orderBy(F.desc("score"), F.asc("id"))))
        elif method == "weighted":
            best = F.max("score").over(w)
            part = F.when(best > 0, weight * F.col("score") / best).otherwise(0.0)
        else:
            part = F.col("score")
        return df.select("query_id", "id", F.col("score").alias(f"{name}_score"), part.alias(f"{name}_part"))

    both = side(left, left_weight, "left").join(side(right, right_weight, "right"), ["query_id", "id"], "full_outer")
    a, b = F.coalesce("left_part", F.lit(0.0)), F.coalesce("right_part", F.lit(0.0))
    score = F.greatest(a, b) if method == "max" else a + b
    out = both.select("query_id", "id", score.alias("score"), F.coalesce("left_score", F.lit(0.0)).alias("left_score"), F.coalesce("right_score", F.lit(0.0)).alias("right_score"))
    return out.where(F.col("score") >= least)


def merge_lists(high: DataFrame, low: DataFrame, how: str = "interleave", high_weight: float = 0.6) -> DataFrame:
    """One list of two: ``interleave``, ``high_first``, ``low_first`` or ``weighted``; an id keeps its best place."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    sides = [df.select("query_id", "id", "score").withColumn("r", F.row_number().over(w)).withColumn("side", F.lit(s)) for s, df in enumerate((high, low))]
    both = sides[0].unionByName(sides[1])
    key = {
        "interleave": 2 * F.col("r") + F.col("side"),
        "high_first": F.col("side") * 1_000_000_000 + F.col("r"),
        "low_first": (1 - F.col("side")) * 1_000_000_000 + F.col("r"),
        "weighted": -F.col("score") * F.when(F.col("side") == 0, high_weight).otherwise(1 - high_weight),
    }[how]
    keyed = both.withColumn("key", key.cast("double"))
    best = keyed.groupBy("query_id", "id").agg(F.min(F.struct("key", "side", "score")).alias("x"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("x.key", "id"))
    return best.select("query_id", "id", F.col("x.score").alias("score"), place.alias("rank"))


def across_types(df: DataFrame, content_col: str = "content", type_col: str = "result_type") -> DataFrame:
    """New rows for contents (first 50 characters) found under several types: mean score + 0.2 for each further type, at most 1."""
    key = F.substring(F.coalesce(F.col(content_col), F.lit("")), 1, 50)
    g = df.groupBy("query_id", key.alias("content_key")).agg(F.avg("score").alias("mean"), F.count_distinct(type_col).alias("types"))
    return g.where("types > 1").select("query_id", F.concat(F.lit("fusion_"), F.substring("content_key", 1, 10)).alias("id"), "content_key", F.least(F.col("mean") + 0.2 * (F.col("types") - 1), F.lit(1.0)).alias("score"))


def boosted_by_metadata(df: DataFrame, words: list[str], keywords_col: str = "keywords", chapter_col: str = "chapter", section_col: str = "section") -> DataFrame:
    """Add 0.2 * share of the query words among the keywords, 0.15 if the chapter holds one, 0.1 if the section does; at most 1."""
    qs = F.array(*[F.lit(w.lower()) for w in words])
    share = F.size(F.array_intersect(F.transform(F.coalesce(F.col(keywords_col), F.array().cast("array<string>")), F.lower), qs)) / max(len(words), 1)
    holds = lambda c: F.exists(qs, lambda w: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), w))
    add = 0.2 * share + F.when(holds(chapter_col), 0.15).otherwise(0.0)
    if section_col in df.columns:
        add = add + F.when(holds(section_col), 0.1).otherwise(0.0)
    return df.withColumn("score", F.least(F.col("score") + add, F.lit(1.0)))


def substring_search(entities: DataFrame, query: str, id_col: str, name_col: str) -> DataFrame:
    """1.0 for an equal name, 0.8 for one that holds the query; case does not matter."""
    name, q = F.lower(F.col(name_col)), query.lower()
    return entities.where(F.contains(name, F.lit(q))).select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.when(name == q, 1.0).otherwise(0.8).alias("score"))


def explained(results: DataFrame, content_col: str, k: int = 5) -> DataFrame:
    """``(query_id, confidence, sources)``: clamp(0.7 * mean score + 0.3) and the best ``k`` sources with 200-character excerpts."""
    conf = results.groupBy("query_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * F.avg("score") + 0.3)).alias("confidence"))
    best = ranked(results, k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.substring(content_col, 1, 200).alias("excerpt")))).alias("sources"))
    return conf.join(best, "query_id")
