"""A small algebra over a property graph, compiled to DataFrames, with a cost model and EXPLAIN.

``entities`` has ``entity_id, entity_type`` and properties; ``relationships``
has ``source, target, relation_type``.  Every operation yields entity rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.operators.graph import neighbours


@dataclass(frozen=True)
class EntityScan:
    entity_type: str


@dataclass(frozen=True)
class Filter:
    property: str
    value: object
    source: object = None


@dataclass(frozen=True)
class Join:
    left: object
    right: object
    kind: str = "inner"  # inner: in both; left: the left side; cross: all pairs


@dataclass(frozen=True)
class Neighbors:
    source: object
    relation_type: str | None = None
    max_hops: int = 1


@dataclass(frozen=True)
class Union:
    left: object
    right: object


@dataclass(frozen=True)
class Limit:
    source: object
    count: int


class Graph:
    def __init__(self, entities: DataFrame, relationships: DataFrame) -> None:
        self.entities, self.relationships = entities, relationships

    def run(self, op) -> DataFrame:
        """The rows of an operation; Catalyst pushes filters and columns to the sources."""
        if isinstance(op, EntityScan):
            return self.entities.where(F.col("entity_type") == op.entity_type)
        if isinstance(op, Filter):
            return (self.run(op.source) if op.source else self.entities).where(F.col(op.property) == F.lit(op.value))
        if isinstance(op, Join):
            left, right = self.run(op.left), self.run(op.right)
            if op.kind == "inner":
                return left.join(right.select("entity_id"), "entity_id", "left_semi")
            if op.kind == "left":
                return left
            return left.crossJoin(right.select([F.col(c).alias(f"right_{c}") for c in right.columns]))  # asked for by the user
        if isinstance(op, Neighbors):
            start = self.run(op.source).select(F.col("entity_id").alias("node"))
            hit = neighbours(self.relationships, start, op.relation_type, op.max_hops)
            return self.entities.join(hit.withColumnRenamed("node", "entity_id"), "entity_id", "left_semi")
        if isinstance(op, Union):
            return self.run(op.left).unionByName(self.run(op.right)).dropDuplicates(["entity_id"])
        if isinstance(op, Limit):
            return self.run(op.source).orderBy("entity_id").limit(op.count)
        raise TypeError(f"no such operation: {op!r}")

    def statistics(self) -> dict:
        """Numbers of entities and relationships by type, and the average degree 2E / N."""
        by = {r[0]: r[1] for r in self.entities.groupBy("entity_type").count().collect()}  # as many rows as types
        rel = {r[0]: r[1] for r in self.relationships.groupBy("relation_type").count().collect()}
        n, e = sum(by.values()), sum(rel.values())
        return {"entities": by, "relationships": rel, "total": n, "average_degree": 2 * e / n if n else 0.0}


def cost(op, stats: dict) -> tuple[int, float]:
    """Estimated rows and cost of an operation."""
    if isinstance(op, EntityScan):
        n = stats["entities"].get(op.entity_type, 0)
        return n, float(n)
    if isinstance(op, Filter):
        return int(stats["total"] * 0.1), float(stats["total"])
    if isinstance(op, Join):
        (n, c), (m, d) = cost(op.left, stats), cost(op.right, stats)
        rows = {"inner": int(sqrt(n * m)), "left": n, "cross": n * m}[op.kind]
        return rows, c + d + n * m
    if isinstance(op, Neighbors):
        n, c = cost(op.source, stats)
        rows = int(min(n * stats["average_degree"] ** op.max_hops, stats["total"]))
        return rows, c + rows
    if isinstance(op, Union):
        (n, c), (m, d) = cost(op.left, stats), cost(op.right, stats)
        return (n + m) * 9 // 10, c + d
    n, c = cost(op.source, stats)
    return min(op.count, n), c


def optimize(op, stats: dict):
    """Put the smaller side of an inner join first; order chains of inner joins from the cheapest pair on."""
    if isinstance(op, Join):
        if op.kind != "inner":
            return Join(optimize(op.left, stats), optimize(op.right, stats), op.kind)
        rest = sorted((optimize(x, stats) for x in _chain(op)), key=lambda x: cost(x, stats)[0])
        out = rest.pop(0)
        while rest:
            nxt = min(rest, key=lambda x: cost(Join(out, x), stats)[1])
            rest.remove(nxt)
            out = Join(out, nxt)
        return out
    if isinstance(op, Neighbors):
        return Neighbors(optimize(op.source, stats), op.relation_type, op.max_hops)
    if isinstance(op, Union):
        return Union(optimize(op.left, stats), optimize(op.right, stats))
    if isinstance(op, Limit):
        return Limit(optimize(op.source, stats), op.count)
    if isinstance(op, Filter) and op.source:
        return Filter(op.property, op.value, optimize(op.source, stats))
    return op


def _chain(op) -> list:
    return [*_chain(op.left), *_chain(op.right)] if isinstance(op, Join) and op.kind == "inner" else [op]


def explain(op, stats: dict, depth: int = 0) -> str:
    """One line an operation with its estimated rows and cost."""
    n, c = cost(op, stats)
    own = ", ".join(f"{k}={v!r}" for k, v in vars(op).items() if not hasattr(v, "__dataclass_fields__") and v is not None)
    lines = [f"{'  ' * depth}{type(op).__name__}({own}) rows={n} cost={c:.1f}"]
    lines += [explain(v, stats, depth + 1) for v in vars(op).values() if hasattr(v, "__dataclass_fields__")]
    return "\n".join(lines)
