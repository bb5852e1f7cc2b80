"""How distinctive a term is of a record.

Two measures over the same counts: tf * ln(N / df) / ln(N), and hypergeometric
enrichment, the exact probability that a record of this length would hold the
term at least as often if its words were drawn from all words of the collection.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphmill.session import materialize

WORD = r"[\p{L}\p{N}]+"
_WORD = regex.compile(WORD)


def content_terms(df: DataFrame, id_col: str = "id", text_col: str = "content", min_chars: int = 3) -> DataFrame:
    """``(document_id, term, tf)``: words of at least ``min_chars`` characters, counted inside their row.

    Null and blank texts have no terms; an id delivered twice counts once (the
    larger count where deliveries differ).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids, sizes, terms, tfs = part.column(0), [], [], []
                for text in part.column(1).to_pylist():
                    count = Counter(w for w in (x.lower() for x in _WORD.findall(text)) if len(w) >= min_chars)
                    sizes.append(len(count))
                    terms.extend(count.keys())
                    tfs.extend(count.values())
                at_row = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                yield pa.RecordBatch.from_arrays([ids.take(at_row).cast(pa.string()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], ["document_id", "term", "tf"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(run, "document_id string, term string, tf bigint").groupBy("document_id", "term").agg(F.max("tf").alias("tf"))


def keyword_terms(df: DataFrame, id_col: str = "id", document_col: str = "document_id", keywords_col: str = "keywords") -> DataFrame:
    """``(document_id, term, tf)``: trimmed lower-case keywords, tf the chunk ids of the document with the term.

    Null and blank keywords are left out; repeats inside a chunk and chunks
    delivered twice count once.
    """
    clean = F.array_distinct(F.transform(F.col(keywords_col), lambda k: F.lower(F.regexp_replace(k, r"(?U)^\s+|\s+\z", ""))))
    rows = df.select(F.col(document_col).alias("document_id"), F.col(id_col).alias("id"), F.explode(clean).alias("term")).where("document_id is not null and term is not null and term != ''").distinct()
    return rows.groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def distinctive(terms: DataFrame, least: float = 3.0, min_df: int = 2) -> DataFrame:
    """Rows of ``terms`` with df >= min_df and tf * ln(N / df) / ln(N) >= least, with df and score.

    As ln(N / df) / ln(N) < 1 for df >= 2, only terms with tf > least can pass;
    document frequencies are joined to those alone.  Fewer than two documents
    give no rows.
    """
    terms = materialize(terms, "terms")  # read three times
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("most")).where((F.col("df") >= min_df) & (F.col("most") > least))
    n = terms.agg(F.count_distinct("document_id").alias("n"))
    scored = terms.where(F.col("tf") > least).join(df.select("term", "df"), "term").crossJoin(F.broadcast(n)).where("n > 1")  # n is one row
    score = F.col("tf") * F.log(F.col("n") / F.col("df")) / F.log(F.col("n").cast("double"))
    return scored.select("document_id", "term", "tf", "df", "n", score.alias("score")).where(F.col("score") >= least)


# Coefficients of the Stirling series of ln(gamma), 1/12, -1/360, 1/1260, -1/1680.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln(gamma(x)) for x >= 1, to about 1e-12: the series at x + 8, brought back by the recurrence."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    product = np.ones_like(x)
    small = x < 10
    for k in range(8):
        product = np.where(small, product * (x + k), product)
    shift = np.where(small, np.log(product), 0.0)
    y = np.where(small, x + 8, x)
    inverse = 1 / y
    series = inverse * (_STIRLING[0] + inverse**2 * (_STIRLING[1] + inverse**2 * (_STIRLING[2] + inverse**2 * _STIRLING[3])))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_upper_tail(k: np.ndarray, n: np.ndarray, good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """ln P(X >= k) for X hypergeometric: ``n`` words drawn from ``total``, of which ``good`` are the term.

    The first probability comes from log-gamma sums, the following ones from
    their ratios, until what is left cannot change the sum.
    """
    k, n, good, total = (np.asarray(v, np.float64) for v in (k, n, good, total))
    k = np.maximum(k, n + good - total)  # fewer cannot be drawn
    choose = lambda a, b: log_gamma(a + 1) - log_gamma(b + 1) - log_gamma(a - b + 1)
    first = choose(good, k) + choose(total - good, n - k) - choose(total, n)
    term, tail, i = np.ones_like(k), np.ones_like(k), k.copy()
    open_ = np.arange(len(k))
    last = np.minimum(n, good)
    while len(open_):
        a = i[open_]
        ratio = (good[open_] - a) * (n[open_] - a) / ((a + 1) * (total[open_] - good[open_] - n[open_] + a + 1))
        term[open_] *= np.maximum(ratio, 0)
        tail[open_] += term[open_]
        i[open_] += 1
        # Beyond the mode the terms fall faster than a geometric series of this ratio.
        rest = np.where(ratio < 1, term[open_] * ratio / np.where(ratio < 1, 1 - ratio, 1.0), np.inf)
        open_ = open_[(i[open_] < last[open_]) & (rest > 1e-15 * tail[open_])]
    return np.minimum(first + np.log(tail), 0.0)


def enrichment(terms: DataFrame) -> DataFrame:
    """``(document_id, term, tf, score, q)`` for every row of ``terms``.

    ``score`` is the negative natural logarithm of the hypergeometric upper-tail
    probability, ``q`` its Benjamini-Hochberg adjusted value over all rows.
    """
    terms = materialize(terms, "terms")  # read four times
    length = terms.groupBy("document_id").agg(F.sum("tf").alias("length"))
    good = terms.groupBy("term").agg(F.sum("tf").alias("good"))
    whole = terms.agg(F.sum("tf").alias("total"))
    joined = terms.join(good, "term").join(length, "document_id").crossJoin(F.broadcast(whole))  # one row

    @F.pandas_udf("double")
    def minus_log_p(tf: pd.Series, length: pd.Series, good: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(-log_upper_tail(tf.to_numpy(), length.to_numpy(), good.to_numpy(), total.to_numpy()))

    scored = joined.select("document_id", "term", "tf", minus_log_p("tf", "length", "good", "total").alias("score"))
    return adjust(scored, ["document_id", "term"])


def adjust(scored: DataFrame, tie: list[str]) -> DataFrame:
    """Add ``q``, the Benjamini-Hochberg value of ``score`` = -ln(p), without a global sort in one task.

    Rows are range-partitioned by score and ranked inside their partition; the
    sizes and smallest values of the partitions (one row each) give the rest.
    """
    parts = scored.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = scored.repartitionByRange(int(parts), F.desc("score"), *tie).withColumn("part", F.spark_partition_id())
    stored = materialize(ranged, "enrichment")
    sizes = stored.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("part", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("rows").over(W.partitionBy(F.lit(1))).alias("m"))
    inside = W.partitionBy("part").orderBy(F.desc("score"), *tie)
    ranked = stored.withColumn("r", F.row_number().over(inside)).join(F.broadcast(before), "part")  # one row a partition
    # ln of p * m / rank; the running minimum from the end makes it monotone.
    raw = ranked.withColumn("raw", -F.col("score") + F.log(F.col("m").cast("double")) - F.log((F.col("before") + F.col("r")).cast("double")))
    later = raw.groupBy("part").agg(F.min("raw").alias("least")).select("part", F.min("least").over(W.orderBy("part").rowsBetween(1, W.unboundedFollowing)).alias("later"))
    # From the end on, as a running minimum; a frame that ends with the partition would be read anew for each row.
    back = W.partitionBy("part").orderBy(F.asc("score"), *[F.desc(t) for t in tie])
    low = F.min("raw").over(back.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = raw.withColumn("low", low).join(F.broadcast(later), "part")
    return out.select(*scored.columns, F.least(F.lit(1.0), F.exp(F.least(F.col("low"), F.coalesce("later", "low")))).alias("q"))
