"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the component's smallest node.

    A round hangs every larger neighbour of a node, then every smaller one, on the
    smallest; the number of rounds grows with the logarithm of the size.  Smallest
    neighbours are aggregated and written before they are joined, so the edges of
    a hub can be split over tasks.  Self edges and repeats are allowed; null ends
    are not edges.  Raises if ``rounds`` do not suffice: no link is given up.
    """
    oriented = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = Cut(edges.where("a != b").select(oriented.alias("e")).select("e.*").distinct())
    state = _state(now.df)
    for _ in range(rounds):
        both = now.df.unionAll(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = Cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = Cut(both.where("b > a").join(least.df, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least2 = Cut(large.df.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.df.join(least2.df, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = Cut(moved.unionAll(least2.df.select("a", F.col("m").alias("b"))).distinct())
        for x in (now, least, large, least2):
            x.drop()
        now, before, state = small, state, _state(small.df)
        if state == before:
            roots = now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
