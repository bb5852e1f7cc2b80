"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphmill.llm.bpe import VOCABULARY, token_counts
from graphmill.session import materialize


def source_key(col: str):
    """Sources differing only in case or blanks are one source."""
    return F.lower(F.regexp_replace(F.col(col), r"(?U)^\s+|\s+\z", ""))


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str = VOCABULARY) -> DataFrame:
    """``(id, source, n_tokens, rank)`` of every document with tokens and a source.

    ``rank`` numbers the documents of a source from 1 in order of size.  It is
    found without one task per source: rows are range-partitioned by source and
    size, numbered inside their partition, and shifted by the number of rows of
    the source in the partitions before.  Ordering by size spreads the draws
    evenly over short and long documents.
    """
    counted = token_counts(df.select(F.col(id_col).alias("id"), source_key(source_col).alias("source"), F.col(text_col).alias("text")).where("source is not null and source != '' and text is not null and text != ''"), "id", "text", path)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = materialize(counted.where("n_tokens > 0"), "counted")  # range partitioning reads its input twice
    ranged = materialize(first.repartitionByRange(parts, "source", "n_tokens", "id").withColumn("part", F.spark_partition_id()), "sized")
    blocks = ranged.groupBy("source", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = blocks.select("source", "part", F.coalesce(F.sum("rows").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("part", "source").orderBy("n_tokens", "id")
    return ranged.withColumn("r", F.row_number().over(inside)).join(before, ["source", "part"]).select("id", "source", "n_tokens", (F.col("before") + F.col("r")).alias("rank"))


def rates(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """``(mix, source, target_share, max_repeats, available, rate)``: expected copies of each document of a source.

    The size of a mix is ``total_tokens``, or else the largest at which every
    source that has tokens can give its share within ``max_repeats``.  Shares
    of sources without tokens are spread over the others in proportion.
    """
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    want = targets.select("mix", source_key("source").alias("source"), "target_share", "max_repeats").groupBy("mix", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = want.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    w = W.partitionBy("mix")
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    share = F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(w))
    step = both.withColumn("share", share)
    size = F.lit(total_tokens) if total_tokens is not None else F.min(F.col("max_repeats") * F.col("available") / F.col("share")).over(w)
    step = step.withColumn("size", size)
    rate = F.coalesce(F.least(F.col("max_repeats").cast("double"), F.col("share") * F.col("size") / F.col("available")), F.lit(0.0))
    return step.select("mix", "source", "target_share", "max_repeats", "available", rate.alias("rate"))


def draw(docs: DataFrame, rate: DataFrame, seed: int = 42) -> DataFrame:
    """``(mix, source, doc_id, n_tokens, copies)``: one copy for every integer that the prefix sum crosses.

    Within a source all documents have the same expected copies, so the prefix
    sum is rank * rate.  One random offset a mix and source, from the seed, is
    added; each document is drawn with the probability its rate says.  As
    documents are in order of size, the tokens drawn differ from the wanted
    ones by no more than the longest document has.
    """
    unit = 1 << 30
    u = F.pmod(F.xxhash64(F.lit(seed), "mix", "source"), F.lit(unit)) / F.lit(float(unit))
    used = rate.where("rate > 0").select("mix", "source", "rate", "max_repeats", u.alias("u"))
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("u")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("u"))
    drawn = docs.join(F.broadcast(used), "source").withColumn("copies", crossed)  # as many rows as mix_targets
    return drawn.select("mix", "source", F.col("id").alias("doc_id"), "n_tokens", F.least("copies", "max_repeats").cast("int").alias("copies")).where("copies > 0")


def reached(rate: DataFrame, drawn: DataFrame) -> DataFrame:
    """``(mix, source, target_share, actual_share, tokens, documents, available)`` of every target, drawn or not."""
    got = drawn.groupBy("mix", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"))
    both = rate.join(got, ["mix", "source"], "left").fillna(0, ["tokens", "documents"])
    whole = F.sum("tokens").over(W.partitionBy("mix"))
    return both.select("mix", "source", "target_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("actual_share"), "tokens", "documents", "available")
