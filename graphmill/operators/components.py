"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import materialize, release


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node with an edge; a component is named after its smallest node.

    Alternates large-star and small-star steps until no edge moves, which takes
    a number of rounds logarithmic in the size of the largest component.  Each
    step is an aggregate with map-side combining and a join, so a hub is never
    collected.  More rounds than ``max_rounds`` are an error.  Self-loops name their node as its own component; null ends are
    dropped; direction and repeats of edges do not matter.
    """
    all_edges = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    current = materialize(all_edges.where("u != v").distinct(), "cc")
    loops = all_edges.where("u = v").select(F.col("u").alias("node")).distinct()
    last = None
    for _ in range(max_rounds):
        stepped = materialize(_small_star(_large_star(current)), "cc")
        release(current)
        current, now = stepped, _checksum(stepped)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    named = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = named.select(F.col("component").alias("node"), "component").distinct()
    found = named.unionByName(roots)
    alone = loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
