"""Graphs of tables, fields and relations: neighbourhoods, components, orders, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.rows import materialise


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) edges in both directions, each once."""
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def within(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(node, distance): nodes at most ``hops`` undirected steps from the start nodes (node)."""
    if not 0 <= hops <= 32:
        raise ValueError("hops are 0 to 32")
    steps = both_ways(edges)
    reached = starts.select("node").distinct().withColumn("distance", F.lit(0))
    front = reached
    for k in range(1, hops + 1):
        new = front.select(F.col("node").alias("a")).join(steps, "a").select(F.col("b").alias("node")).distinct()
        front = new.join(reached, "node", "left_anti").withColumn("distance", F.lit(k))
        reached = materialise(reached.unionByName(front)) if k % 4 == 0 else reached.unionByName(front)
    return reached.groupBy("node").agg(F.min("distance").alias("distance"))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node of each weak component; isolated nodes are their own.

    Labels shrink to the least of a node and its neighbours, and then jump to
    their label's label, so that long chains settle in few rounds.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    labels = materialise(nodes.select("node").unionAll(ends).distinct().withColumn("label", F.col("node")))
    steps = materialise(both_ways(edges).where("a != b"))
    for _ in range(rounds):
        heard = steps.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(heard, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "heard").alias("least"))
        # a node that saw a smaller label tells it to the node its own label names
        told = near.where("least < label").groupBy(F.col("label").alias("root")).agg(F.min("least").alias("told"))
        near = near.join(told, F.col("node") == F.col("root"), "left").select("node", "label", F.least("least", "told").alias("least"))
        near = materialise(near)
        jump = near.join(near.select(F.col("node").alias("l"), F.col("least").alias("further")), F.col("least") == F.col("l"))
        new = materialise(jump.select("node", F.least("least", "further").alias("label"), (F.col("label") != F.least("least", "further")).alias("changed")))
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on no edge."""
    return nodes.join(edges.select(F.explode(F.array("a", "b")).alias("node")), "node", "left_anti")


def type_pairs(edges: DataFrame, types: DataFrame) -> DataFrame:
    """(source_type, target_type, n): edges by the types of their ends; types: (node, type)."""
    a = types.select(F.col("node").alias("a"), F.col("type").alias("source_type"))
    b = types.select(F.col("node").alias("b"), F.col("type").alias("target_type"))
    return edges.join(a, "a").join(b, "b").groupBy("source_type", "target_type").agg(F.count("*").alias("n"))


def table_order(needs: dict[str, set[str]]) -> tuple[list[str], list[str]]:
    """(tables, those they refer to first; tables on or behind a cycle).  A catalogue, so on the driver."""
    left, order = {t: {x for x in n if x in needs and x != t} for t, n in needs.items()}, []
    while ready := sorted(t for t, n in left.items() if not n):
        order += ready
        left = {t: n - set(ready) for t, n in left.items() if t not in ready}
    return order, sorted(left)


def cyclic(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Nodes (node) that lie on a directed cycle or between two: what is left when sources and sinks are peeled off."""
    now = materialise(edges.select("a", "b").distinct())
    n = now.count()
    for _ in range(rounds):
        inner = now.join(now.select(F.col("b").alias("x")).distinct(), F.col("a") == F.col("x"), "left_semi")
        now = materialise(inner.join(inner.select(F.col("a").alias("x")).distinct(), F.col("b") == F.col("x"), "left_semi"))
        n, before = now.count(), n
        if n in (0, before):
            return now.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    raise RuntimeError(f"peeling did not end in {rounds} rounds")
