"""Pairs of items of one basket, in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that are held and paired at once.
BLOCK = 128


def pairs(rows: DataFrame, basket: str, item: str, *carried: str) -> DataFrame:
    """``(basket, a, b, …)``: each two different items of a basket once, a < b; carried columns come as ``name_a`` and ``name_b``.

    ``rows`` holds an item of a basket once.  Baskets of more than ``BLOCK``
    items are cut into blocks by a hash of the item; two blocks meet in a task
    of their own, so a hot basket is spread over all tasks and never collected.
    """
    x = rows.select(F.col(basket).alias("basket"), F.struct(F.col(item).alias("item"), *carried).alias("x")).where("basket is not null and x.item is not null")
    large = x.groupBy("basket").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK).select("basket", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    cut = x.join(large, "basket", "left").withColumn("block", F.pmod(F.xxhash64("x.item"), F.coalesce("blocks", F.lit(1))).cast("int"))
    held = cut.groupBy("basket", "blocks", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def named(left: Column, right: Column) -> list[Column]:
        return [left["item"].alias("a"), right["item"].alias("b"), *[c for n in carried for c in (left[n].alias(f"{n}_a"), right[n].alias(f"{n}_b"))]]

    p, q = F.col("p"), F.col("q")
    within = held.select("basket", "xs", F.posexplode("xs").alias("i", "p")).select("basket", "p", F.explode(F.expr("slice(xs, i + 2, size(xs))")).alias("q")).select("basket", *named(p, q))
    many = held.where("blocks is not null")
    left = many.where("block < blocks - 1").select("basket", "xs", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("other"))
    met = left.join(many.select("basket", F.col("block").alias("other"), F.col("xs").alias("ys")), ["basket", "other"])
    flat = met.select("basket", F.explode("xs").alias("p"), "ys").select("basket", "p", F.explode("ys").alias("q"))
    first = F.col("p.item") < F.col("q.item")
    across = flat.select("basket", F.when(first, p).otherwise(q).alias("p"), F.when(first, q).otherwise(p).alias("q")).select("basket", *named(p, q))
    return within.unionByName(across)
