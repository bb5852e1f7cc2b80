"""Traversal, paths, centrality, ranking and communities of an edge table.

Edges have ``source, target`` and, where weights matter, ``weight``.  Iterative
operators keep their state in tables of the shared folder, one per round, so no
plan grows with the rounds and no part of the graph is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphmill.operators.components import connected_components
from graphmill.session import materialize, release


def oriented(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Steps ``(source, target, …)`` that may be taken: ``out``, ``in`` or ``both``."""
    if direction == "out":
        return edges
    turned = {"source": F.col("target").alias("source"), "target": F.col("source").alias("target")}
    back = edges.select(*[turned.get(c, F.col(c)) for c in edges.columns])
    return back if direction == "in" else edges.unionByName(back)


def reach(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both", least_confidence: float | None = None, by_seed: bool = False) -> DataFrame:
    """``(node, distance)`` of all nodes at most ``hops`` steps from any seed; with ``by_seed`` also ``seed``.

    ``seeds`` has ``node``.  A node keeps its least distance.  Edges under
    ``least_confidence`` are not used.  Each round joins the frontier alone.
    """
    usable = edges if least_confidence is None else edges.where(F.col("confidence") >= least_confidence)
    steps = oriented(usable.select("source", "target"), direction).where("source != target").distinct()
    keys = ["seed", "node"] if by_seed else ["node"]
    start = seeds.select("node").where("node is not null").distinct()
    seen = start.select(*([F.col("node").alias("seed")] if by_seed else []), "node", F.lit(0).alias("distance"))
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(steps.withColumnRenamed("source", "node"), "node").select(*([F.col("seed")] if by_seed else []), F.col("target").alias("node")).distinct()
        frontier = materialize(step.join(seen.select(*keys), keys, "left_anti").withColumn("distance", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def ego_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``, each once."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "source"), "source", "left_semi").join(n.withColumnRenamed("node", "target"), "target", "left_semi").distinct()


def focused_subgraph(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` of the seeds with their distance, and the edges among them."""
    nodes = materialize(reach(edges, seeds, hops, direction), "ego")
    return nodes, ego_edges(edges, nodes)


def simple_paths(edges: DataFrame, start: str, end: str, most_edges: int, direction: str = "out", limit: int | None = None) -> DataFrame:
    """``(path, edges, weight)``: paths without a repeated node; weights add up (1 an edge without weights)."""
    weighted = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    steps = oriented(weighted.select("source", "target", "weight"), direction).where("source != target").distinct()
    open_ = steps.where(F.col("source") == start).select(F.array("source", "target").alias("path"), F.col("target").alias("node"), F.lit(1).alias("edges"), F.col("weight").cast("double").alias("weight"))
    found = None
    for n in range(1, most_edges + 1):
        open_ = materialize(open_, "paths")
        done = open_.where(F.col("node") == end).select("path", "edges", "weight")
        found = done if found is None else found.unionByName(done)
        if n < most_edges:
            ahead = open_.where(F.col("node") != end).join(steps.withColumnsRenamed({"source": "node", "weight": "w"}), "node")
            open_ = ahead.where(~F.array_contains("path", F.col("target"))).select(F.array_append("path", F.col("target")).alias("path"), F.col("target").alias("node"), (F.col("edges") + 1).alias("edges"), (F.col("weight") + F.col("w")).alias("weight"))
    return found if limit is None else found.orderBy("edges", "weight", "path").limit(limit)


def shortest_distances(edges: DataFrame, sources: DataFrame, direction: str = "both", max_rounds: int = 50) -> DataFrame:
    """``(seed, node, distance, previous)``: least weights from each source, by rounds of relaxation.

    Weights must not be negative.  Only nodes whose distance fell in the last
    round are expanded in the next.  Paths of ``max_rounds`` edges or more are an error.
    """
    steps = oriented(edges.select("source", "target", F.col("weight").cast("double").alias("weight")), direction).groupBy("source", "target").agg(F.min("weight").alias("weight"))
    best = sources.select(F.col("node").alias("seed"), "node", F.lit(0.0).alias("distance"), F.lit(None).cast("string").alias("previous")).distinct()
    changed = best = materialize(best, "distances")
    for _ in range(max_rounds):
        tried = changed.join(steps.withColumnRenamed("source", "node"), "node").select("seed", F.col("target").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.col("node").cast("string").alias("previous"))
        least = tried.groupBy("seed", "node").agg(F.min(F.struct("distance", "previous")).alias("x")).select("seed", "node", "x.distance", "x.previous")
        old = best.select("seed", "node", F.col("distance").alias("old"), F.col("previous").alias("before"))
        both = least.join(old, ["seed", "node"], "full_outer")
        better = F.col("old").isNull() | (F.col("distance") < F.col("old") - 1e-12)
        now = materialize(both.select("seed", "node", F.when(better, F.col("distance")).otherwise(F.col("old")).alias("distance"), F.when(better, F.col("previous")).otherwise(F.col("before")).alias("previous"), F.coalesce(better, F.lit(False)).alias("changed")), "distances")
        best = now.drop("changed")
        changed = now.where("changed").drop("changed")
        if changed.isEmpty():
            break
    else:
        raise RuntimeError(f"distances are not settled after {max_rounds} rounds")
    return best


def neighbours(edges: DataFrame, nodes: DataFrame, relation: str | None = None, hops: int = 1) -> DataFrame:
    """Nodes reached from ``nodes`` by 1 to ``hops`` outgoing edges of one type; the start nodes themselves count only if reached."""
    some = edges if relation is None else edges.where(F.col("relation_type") == relation)
    steps = some.select("source", "target").distinct()
    front, out = nodes.select("node").distinct(), None
    for _ in range(hops):
        front = front.join(steps.withColumnRenamed("source", "node"), "node").select(F.col("target").alias("node")).distinct()
        out = front if out is None else out.unionByName(front)
    return out.distinct()


# ---------------------------------------------------------------- trees


def ancestors(tree: DataFrame, nodes: DataFrame, most: int = 100) -> DataFrame:
    """``(node, ancestor, distance)`` in a tree ``(node, parent)``; deeper trees than ``most`` are an error."""
    up = tree.where("parent is not null").select("node", "parent").distinct()
    ring = materialize(nodes.select("node").distinct().join(up, "node").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "ancestors")
    out = ring
    for n in range(2, most + 1):
        ring = materialize(ring.join(up.select(F.col("node").alias("ancestor"), F.col("parent").alias("next")), "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(n).alias("distance")), "ancestors")
        if ring.isEmpty():
            return out
        out = out.unionByName(ring)
    raise RuntimeError(f"the tree is deeper than {most}")


def descendants(tree: DataFrame, nodes: DataFrame, most: int = 100) -> DataFrame:
    """``(node, descendant, distance)``."""
    turned = tree.where("parent is not null").select(F.col("parent").alias("node"), F.col("node").alias("parent"))
    return ancestors(turned, nodes, most).withColumnRenamed("ancestor", "descendant")


def roots(tree: DataFrame) -> DataFrame:
    return tree.where("parent is null").select("node").distinct()


# ---------------------------------------------------------------- shape


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree, out_degree, in_degree, centrality)``; parallel edges count, centrality is degree / (nodes - 1)."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")).withColumn("degree", F.col("out_degree") + F.col("in_degree"))
    n = d.agg(F.count(F.lit(1)).alias("nodes"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", "out_degree", "in_degree", F.when(F.col("nodes") > 1, F.col("degree") / (F.col("nodes") - 1)).otherwise(0.0).alias("centrality"))  # one row


def shape(edges: DataFrame) -> DataFrame:
    """``(nodes, edges, density, average_degree)`` of the undirected graph."""
    nodes = oriented(edges.select("source", "target")).select(F.col("source").alias("node")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    n, e = F.col("nodes"), F.col("edges")
    return nodes.crossJoin(F.broadcast(m)).select("nodes", "edges", F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(n > 0, 2 * e / n).otherwise(0.0).alias("average_degree"))  # one row


def undirected(edges: DataFrame) -> DataFrame:
    """``(a, b, weight)`` with a < b; weights of parallel edges add up."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    return edges.where("source != target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(w).alias("weight"))


def triangles(edges: DataFrame) -> DataFrame:
    """``(node, triangles, neighbours)``, counted at each corner.

    Each edge is owned by its end of smaller degree, so a hub joins only with
    the few nodes above it.
    """
    e = undirected(edges).select("a", "b")
    deg = e.select(F.col("a").alias("n")).unionByName(e.select(F.col("b").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    ranked = e.join(deg.withColumnsRenamed({"n": "a", "d": "da"}), "a").join(deg.withColumnsRenamed({"n": "b", "d": "db"}), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    own = materialize(ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")), "owned")
    wedge = own.join(own.select("u", F.col("v").alias("w")), "u").where("v < w")
    closed = wedge.join(own.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("w")), ["v", "w"])
    corners = closed.select(F.explode(F.array("u", "v", "w")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("triangles"))
    return deg.join(corners, "n", "left").select(F.col("n").alias("node"), F.coalesce("triangles", F.lit(0)).alias("triangles"), F.col("d").alias("neighbours"))


def clustering(edges: DataFrame) -> DataFrame:
    """``(coefficient)``: mean over nodes of two or more neighbours of closed pairs / pairs."""
    t = triangles(edges).where("neighbours >= 2")
    return t.agg(F.coalesce(F.avg(2 * F.col("triangles") / (F.col("neighbours") * (F.col("neighbours") - 1))), F.lit(0.0)).alias("coefficient"))


def closeness(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """``(node, closeness)``: reached nodes / sum of their distances, of the nodes asked."""
    d = shortest_distances(edges, nodes, direction)
    return d.where("seed != node").groupBy(F.col("seed").alias("node")).agg((F.count(F.lit(1)) / F.sum("distance")).alias("closeness"))


def betweenness(edges: DataFrame, nodes: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, betweenness)``: how often a node lies inside the shortest path kept for each ordered pair, / ((n-1)(n-2)/2).

    Grows with the square of the nodes asked; of equal paths the one by the
    smaller previous node counts.
    """
    d = materialize(shortest_distances(edges, nodes, "both", max_rounds), "all-pairs")
    n = d.select("node").distinct().count()
    walk = d.where("previous is not null and previous != seed").select("seed", F.col("previous").alias("at"))
    counts = None
    links = d.select("seed", F.col("node").cast("string").alias("at"), "previous")
    for _ in range(max_rounds):
        walk = materialize(walk, "walk")
        if walk.isEmpty():
            break
        step = walk.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
        counts = step if counts is None else counts.unionByName(step)
        walk = walk.join(links, ["seed", "at"]).where("previous is not null and previous != seed").select("seed", F.col("previous").alias("at"))
    else:
        raise RuntimeError(f"paths are longer than {max_rounds} edges")
    scale = max((n - 1) * (n - 2) / 2, 1)
    all_nodes = d.select(F.col("node").cast("string").alias("node")).distinct()
    if counts is None:
        return all_nodes.select("node", F.lit(0.0).alias("betweenness"))
    total = counts.groupBy(F.col("at").alias("node")).agg((F.sum("n") / scale).alias("betweenness"))
    return all_nodes.join(total, "node", "left").fillna(0.0, ["betweenness"])


def internal_edge_ratio(edges: DataFrame) -> DataFrame:
    """``(ratio)``: edge ends that stay inside a connected component / (2 * nodes)."""
    parts = connected_components(edges, "source", "target")
    n = parts.agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg((2 * F.count(F.lit(1))).alias("ends"))
    return n.crossJoin(F.broadcast(m)).select((F.col("ends") / (2 * F.col("nodes"))).alias("ratio"))  # one row


# ---------------------------------------------------------------- ranking


def adjacency(edges: DataFrame, weight_col: str = "confidence") -> DataFrame:
    """``(source, target, weight)``: weights of parallel edges add up."""
    return edges.groupBy("source", "target").agg(F.sum(F.col(weight_col).cast("double")).alias("weight"))


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, reset_base: str = "uniform", nodes: DataFrame | None = None) -> DataFrame:
    """``(node, score)`` that add up to 1.

    A step sends each node's score along its out-edges in proportion to their
    weights; nodes without out-edges spread theirs over all.  ``seeds``
    (``node, weight``) get their weight as reset probability, the others 1 / n
    or, with ``reset_base="zero"``, 0.  Stops when no score moves by
    ``tolerance``; a tolerance of 0 runs all ``iterations``.
    """
    w = edges.select("source", "target", (F.col("weight") if "weight" in edges.columns else F.lit(1.0)).cast("double").alias("weight"))
    out = w.groupBy("source").agg(F.sum("weight").alias("total"))
    share = materialize(w.join(out, "source").where("total > 0").select("source", "target", (F.col("weight") / F.col("total")).alias("share")).groupBy("source", "target").agg(F.sum("share").alias("share")), "shares")
    all_nodes = w.select(F.col("source").alias("node")).unionByName(w.select(F.col("target").alias("node")))
    if nodes is not None:
        all_nodes = all_nodes.unionByName(nodes.select("node"))
    base = all_nodes.distinct().join(share.select(F.col("source").alias("node"), F.lit(True).alias("sends")).distinct(), "node", "left")
    base = materialize(base, "nodes")
    n = base.count()
    if n == 0:
        return base.select("node", F.lit(0.0).alias("score"))
    reset = F.lit(1.0 / n if reset_base == "uniform" or seeds is None else 0.0)
    if seeds is not None:
        s = seeds.groupBy("node").agg(F.max(F.col("weight").cast("double")).alias("seed_weight"))
        base = base.join(s, "node", "left").withColumn("reset", F.coalesce("seed_weight", reset)).drop("seed_weight")
    else:
        base = base.withColumn("reset", reset)
    # One table a round holds all that the next needs; one aggregate over it gives the lost score, the sum and the largest move.
    rank = materialize(base.select("node", "sends", "reset", F.lit(1.0 / n).alias("score"), F.lit(0.0).alias("old")), "rank")
    watched = [F.sum(F.when(F.col("sends").isNull(), F.col("score"))).alias("lost"), F.sum("score").alias("total"), F.max(F.abs(F.col("score") - F.col("old"))).alias("moved")]
    seen = rank.agg(*watched).first()
    for _ in range(iterations):
        got = share.join(rank.select(F.col("node").alias("source"), "score"), "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        score = (1 - damping) * F.col("reset") + damping * (F.coalesce("got", F.lit(0.0)) + (seen["lost"] or 0.0) / n)
        new = materialize(rank.join(got, "node", "left").select("node", "sends", "reset", score.alias("score"), F.col("score").alias("old")), "rank")
        release(rank)
        rank, seen = new, new.agg(*watched).first()
        if tolerance > 0 and seen["moved"] < tolerance:
            break
    return rank.select("node", (F.col("score") / (seen["total"] or 1.0)).alias("score"))


def updated_pagerank(edges: DataFrame, scores: DataFrame, changed: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, hops: int = 2, most_changed: int | None = None) -> DataFrame:
    """``(node, score)`` after a change: only nodes within ``hops`` of the ``changed`` ones are computed again, from their old scores.

    Among the affected nodes scores flow along the edges they have with each
    other; what the others hold stays, and the affected share what they held
    together before, new nodes 1 / n each.  With more than ``most_changed``
    changed nodes all is computed anew.
    """
    if most_changed is not None and changed.limit(most_changed + 1).count() > most_changed:
        return pagerank(edges, damping=damping, iterations=iterations, tolerance=tolerance)
    near = materialize(reach(edges, changed, hops).select("node"), "affected")
    nodes = oriented(edges.select("source", "target")).select(F.col("source").alias("node")).unionByName(scores.select("node")).distinct()
    n = nodes.count()
    before = materialize(nodes.join(scores, "node", "left").select("node", F.coalesce("score", F.lit(1.0 / max(n, 1))).alias("score")), "scores")
    held = before.join(near, "node", "left_semi").agg(F.sum("score")).first()[0] or 0.0
    inner = pagerank(ego_edges(edges, near), damping=damping, iterations=iterations, tolerance=tolerance, nodes=near)
    fresh = near.join(inner, "node", "left").select("node", (F.coalesce("score", F.lit(0.0)) * held).alias("score"))
    return before.join(near, "node", "left_anti").unionByName(fresh)


def combine_scores(lists: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """``(node, score)``: weighted sum of several ``(node, score)`` tables; a missing score is 0."""
    parts = [df.select("node", (F.col("score") * weight).alias("score")) for df, weight in lists.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("node").agg(F.sum("score").alias("score"))


def passage_ranking(facts: DataFrame, passages: DataFrame, similar: DataFrame, damping: float = 0.5, passage_weight: float = 0.05, iterations: int = 30) -> DataFrame:
    """``(node, score)`` of passages by personalised PageRank from the entities of retrieved facts.

    ``facts``: subject, object, score.  ``passages``: entity, passage.
    ``similar``: passage, score.  An entity's seed weight is the mean of fact
    score / number of its passages; a passage's is 0.05 * its similarity.
    """
    per = passages.groupBy("entity").agg(F.count_distinct("passage").alias("k"))
    ent = facts.select(F.explode(F.array("subject", "object")).alias("entity"), "score").join(per, "entity").groupBy(F.col("entity").alias("node")).agg(F.avg(F.col("score") / F.col("k")).alias("weight"))
    seeds = ent.unionByName(similar.select(F.col("passage").alias("node"), (F.col("score") * passage_weight).alias("weight")))
    total = seeds.agg(F.sum("weight")).first()[0] or 1.0
    edges = oriented(passages.select(F.col("entity").alias("source"), F.col("passage").alias("target")).unionByName(facts.select(F.col("subject").alias("source"), F.col("object").alias("target"))))
    rank = pagerank(edges, seeds.select("node", (F.col("weight") / total).alias("weight")), damping, iterations, 1e-6, "zero")
    return rank.join(passages.select(F.col("passage").alias("node")).distinct(), "node", "left_semi")


# ---------------------------------------------------------------- communities


def communities(edges: DataFrame, rounds: int = 10, resolution: float = 1.0) -> DataFrame:
    """``(node, community)`` by local moving and a split of disconnected parts.

    In each round half of the nodes, chosen by hash, move to the neighbouring
    community of the largest modularity gain; taking halves in turn keeps two
    nodes from swapping for ever.  Ties go to the smaller community.
    """
    e = materialize(undirected(edges), "undirected")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    k = materialize(both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k")), "strengths")
    m2 = k.agg(F.sum("k")).first()[0] or 1.0
    label = materialize(k.select("node", F.col("node").alias("community")), "labels")
    still = 0
    for r in range(2 * rounds):
        size = label.join(k, "node").groupBy("community").agg(F.sum("k").alias("total"))
        links = both.join(label.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("weight").alias("w"))
        own = label.select("node", F.col("community").alias("own"))
        all_own = own.select("node", F.col("own").alias("community"), F.lit(0.0).alias("w"))
        cand = links.unionByName(all_own).groupBy("node", "community").agg(F.max("w").alias("w"))
        scored = cand.join(size, "community").join(k, "node").join(own, "node")
        rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.col("w") - resolution * F.col("k") * rest / m2
        best = scored.groupBy("node").agg(F.min(F.struct((-F.round(gain, 9)).alias("g"), (F.col("community") != F.col("own")).alias("moves"), "community")).alias("x"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
        new = materialize(own.join(best, "node").select("node", F.when(turn, F.col("x.community")).otherwise(F.col("own")).alias("community"), (turn & (F.col("x.community") != F.col("own"))).alias("moved")), "labels")
        moved = new.where("moved").count()
        label = new.select("node", "community")
        still = 0 if moved else still + 1
        if still == 2:
            break
    inside = e.join(label.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(label.withColumnsRenamed({"node": "b", "community": "cb"}), "b").where("ca = cb").select("a", "b")
    parts = connected_components(inside, "a", "b")
    return label.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """``(modularity)`` of a partition ``(node, community)``."""
    e = undirected(edges)
    two_m = e.agg((2 * F.sum("weight")).alias("m2"))
    l1, l2 = label.withColumnsRenamed({"node": "a", "community": "ca"}), label.withColumnsRenamed({"node": "b", "community": "cb"})
    tagged = e.join(l1, "a").join(l2, "b")
    inner = tagged.where("ca = cb").groupBy(F.col("ca").alias("c")).agg((2 * F.sum("weight")).alias("inner"))
    ends = tagged.select(F.col("ca").alias("c"), "weight").unionByName(tagged.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("total"))
    q = ends.join(inner, "c", "left").crossJoin(F.broadcast(two_m))  # one row
    return q.agg(F.sum(F.coalesce("inner", F.lit(0.0)) / F.col("m2") - F.pow(F.col("total") / F.col("m2"), 2)).alias("modularity"))


def community_summary(label: DataFrame, names: DataFrame, per_type: int = 5, most: int = 500) -> DataFrame:
    """``(community, members, summary)``: up to five names of each type, ``and n more``, cut to ``most`` characters."""
    joined = label.join(names.select(F.col("id").alias("node"), "name", "entity_type"), "node")
    r = joined.withColumn("r", F.row_number().over(W.partitionBy("community", "entity_type").orderBy("name", "node")))
    by = r.groupBy("community", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= per_type, F.col("name")))).alias("top"))
    more = F.when(F.col("n") > per_type, F.concat(F.lit(" and "), (F.col("n") - per_type).cast("string"), F.lit(" more"))).otherwise("")
    line = F.concat("entity_type", F.lit(": "), F.array_join("top", ", "), more)
    g = by.select("community", "n", F.struct("entity_type", line.alias("line")).alias("s")).groupBy("community").agg(F.sum("n").alias("members"), F.array_sort(F.collect_list("s")).alias("lines"))
    return g.select("community", "members", F.substring(F.array_join(F.transform("lines", lambda x: x["line"]), "; "), 1, most).alias("summary"))


# ---------------------------------------------------------------- embeddings


def random_walks(edges: DataFrame, length: int = 10, per_node: int = 2, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """``(walk, path)``: biased walks; a step back weighs 1 / p, one to a neighbour of the last node 1, any other 1 / q.

    All walks advance together, one join a step: of the candidates of a walk
    the one with the largest weighted random key is taken, which draws in
    proportion to the weights.
    """
    e = oriented(edges.select("source", "target")).where("source != target").distinct()
    steps = materialize(e, "steps")
    near = steps.select(F.col("source").alias("before"), F.col("target").alias("next"), F.lit(True).alias("near"))
    walks = steps.select(F.col("source").alias("node")).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1)))).select(F.concat_ws("#", F.col("node").cast("string"), "i").alias("walk"), F.array(F.col("node")).alias("path"), F.col("node"), F.lit(None).cast(steps.schema["source"].dataType).alias("before"))
    for n in range(1, length):
        cand = walks.join(steps.select(F.col("source").alias("node"), F.col("target").alias("next")), "node").join(near, ["before", "next"], "left")
        weight = F.when(F.col("next") == F.col("before"), 1.0 / p).when(F.col("before").isNull() | F.col("near"), 1.0).otherwise(1.0 / q)
        unit = (F.pmod(F.xxhash64(F.lit(seed), F.lit(n), "walk", "next"), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
        pick = cand.groupBy("walk").agg(F.max_by(F.struct("path", "node", "next"), F.struct(F.log(unit) / weight, "next")).alias("x"))
        walks = materialize(pick.select("walk", F.array_append("x.path", F.col("x.next")).alias("path"), F.col("x.next").alias("node"), F.col("x.node").alias("before")), "walks")
    return walks.select("walk", "path")


def node_vectors(edges: DataFrame, size: int = 32, seed: int = 42, partitions: int | None = None, **walk) -> DataFrame:
    """``(node, vector)`` trained on random walks by skip-gram, in ``partitions`` tasks (the session's shuffle partitions) whose models are averaged.

    The model, nodes * ``size`` floats, is held by the driver and each task, as the library does it.
    """
    from pyspark.ml.feature import Word2Vec

    walks = random_walks(edges, seed=seed, **walk).select(F.transform("path", lambda x: x.cast("string")).alias("path"))
    model = Word2Vec(vectorSize=size, minCount=1, seed=seed, inputCol="path", outputCol="v", numPartitions=partitions or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), maxIter=1).fit(walks)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("vector"))


def neighbour_features(edges: DataFrame, features: DataFrame, layers: int = 2, how: str = "mean") -> DataFrame:
    """``(node, vector)``: each layer averages (or takes the largest of) the neighbours' places and joins them to the own ones, halved and scaled to length 1."""
    from graphmill.functions.vector import unit

    steps = oriented(edges.select("source", "target")).where("source != target").distinct()
    state = features.select("node", "vector")
    agg = {"mean": F.avg, "max": F.max}[how]
    for _ in range(layers):
        spread = steps.join(state.withColumnsRenamed({"node": "target", "vector": "v"}), "target").select(F.col("source").alias("node"), F.posexplode("v").alias("pos", "x"))
        near = spread.groupBy("node", "pos").agg(agg("x").alias("x")).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("near"))
        mixed = state.join(near, "node", "left").select("node", unit(F.when(F.col("near").isNull(), F.col("vector")).otherwise(F.zip_with("vector", "near", lambda a, b: (a + b) / 2))).alias("vector"))
        state = materialize(mixed, "layer")
    return state
