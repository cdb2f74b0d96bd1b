"""Observed fact tuples, configuration pairs, and examples of links.

Only tuples that stand in rows are ever emitted; no coordinates are combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import all_of, ranked_by


def _complete(columns: Sequence[str]) -> Column:
    return all_of([F.coalesce(F.length(F.trim(F.col(f"`{c}`").cast("string"))) > 0, F.lit(False)) for c in columns])


def _with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """Totals over all rows beside each: one aggregated row, joined, instead of a window over everything."""
    return df.join(F.broadcast(df.agg(*(c.alias(k) for k, c in totals.items()))))


def observed_tuples(df: DataFrame, coordinates: Sequence[str], value: str, row: str = "__row", limit: int | None = None) -> DataFrame:
    """Each observed (coordinates, value) with its rows, first and last row, and how many
    values its coordinates have; in MD5 order, with the totals that a limit would hide."""
    fields = [*coordinates, value]
    seen = df.where(_complete(fields)).groupBy(*coordinates, F.col(f"`{value}`").alias("observation_value"))
    seen = seen.agg(F.count("*").alias("source_row_count"), F.min(row).alias("source_row_min"), F.max(row).alias("source_row_max"))
    values = seen.groupBy(*coordinates).agg(F.count("*").alias("distinct_value_count"))
    out = _with_totals(seen.join(values, list(coordinates)), all_observed_tuples=F.count("*"), all_complete_rows=F.sum("source_row_count"))
    if limit is None:
        return out
    return out.orderBy(ranked_by(*(F.col(f"`{c}`") for c in coordinates), F.col("observation_value")), "observation_value").limit(limit)


def estimated_tuples(df: DataFrame, coordinates: Sequence[str], value: str) -> DataFrame:
    """One row: about how many tuples there are; decides between all of them and seeds."""
    fields = [*coordinates, value]
    return df.where(_complete(fields)).agg(F.approx_count_distinct(F.struct(*fields)).alias("estimated_tuples"))


#: Seeds up to which their list is broadcast.
MOST_SEEDS = 10_000


def seeded_tuples(df: DataFrame, coordinates: Sequence[str], value: str, limit: int, row: str = "__row") -> DataFrame:
    """``limit`` tuples taken in MD5 order, each verified against every row at its coordinates.

    distinct_value_count is 1, or 2 where the coordinates hold another value too.
    """
    fields = [*coordinates, value]
    rank = ranked_by(*(F.col(f"`{c}`") for c in fields))
    distinct = df.where(_complete(fields)).select(*coordinates, F.col(f"`{value}`").alias("observation_value"), rank.alias("__rank")).distinct()
    seeds = distinct.orderBy("__rank").limit(limit).drop("__rank")  # a seed list of a given length
    few = F.broadcast if limit <= MOST_SEEDS else (lambda x: x)
    there = df.where(_complete([value])).join(few(seeds.select(*coordinates).distinct()), list(coordinates), "left_semi")
    grouped = there.groupBy(*coordinates, F.col(f"`{value}`").alias("observation_value"))
    grouped = grouped.agg(F.count("*").alias("source_row_count"), F.min(row).alias("source_row_min"), F.max(row).alias("source_row_max"))
    values = grouped.groupBy(*coordinates).agg(F.when(F.min("observation_value") == F.max("observation_value"), 1).otherwise(2).alias("distinct_value_count"))
    return grouped.join(few(seeds), [*coordinates, "observation_value"], "left_semi").join(values, list(coordinates))


def configuration_pairs(df: DataFrame, left: str, right: str, extra: Sequence[str] = (), row: str = "__row", limit: int | None = None) -> DataFrame:
    """Distinct (left, right, extra) with rows and the first row as witness; most frequent first, with totals."""
    keys = [left, right, *extra]
    found = df.where(_complete([left, right])).groupBy(*keys).agg(F.count("*").alias("rows"), F.min(row).alias("witness_row"))
    out = _with_totals(found, all_pairs=F.count("*"), all_rows=F.sum("rows"))
    return out if limit is None else out.orderBy(F.desc("rows"), *keys).limit(limit)


def resolve_endpoint(pairs: DataFrame, endpoint: str, target: DataFrame, key: str, target_row: str = "__row", scope: dict[str, str] | None = None) -> DataFrame:
    """Adds <endpoint>_status (blank, missing_scope, missing, ambiguous, accepted) and <endpoint>_row."""
    scope = scope or {}
    keys = target.where(_complete([key, *scope])).groupBy(F.col(f"`{key}`").cast("string").alias("__k"), *(F.col(f"`{t}`").cast("string").alias(f"__s{i}") for i, t in enumerate(scope)))
    keys = keys.agg(F.count("*").alias("__n"), F.min(target_row).alias("__row"))
    on = F.col(f"`{endpoint}`").cast("string") == F.col("__k")
    for i, s in enumerate(scope.values()):
        on = on & (F.col(f"`{s}`").cast("string") == F.col(f"__s{i}"))
    status = (
        F.when(~_complete([endpoint]), "blank").when(~_complete(list(scope.values())), "missing_scope")
        .when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous").otherwise("accepted")
    )
    out = pairs.join(keys, on, "left").withColumn(f"{endpoint}_status", status)
    return out.withColumn(f"{endpoint}_row", F.when(F.col(f"{endpoint}_status") == "accepted", F.col("__row"))).drop("__k", "__n", "__row", *(f"__s{i}" for i in range(len(scope))))


def one_per_target(links: DataFrame, n: int) -> DataFrame:
    """The first n links in rounds: the first source of each target, then the second, and so on.

    No round after the n-th is reached, so a target with very many sources sends n
    of each partition to its task at most.
    """
    turn = Window.partitionBy("target_row").orderBy("source_row")
    return links.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= n).orderBy("turn", "target_row").limit(n)


def adjacency(links: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(direction, seed, neighbour): links read forward and in reverse, for seed rows if given."""
    forward = links.select(F.lit("forward").alias("direction"), F.col("source_row").alias("seed"), F.col("target_row").alias("neighbour"))
    reverse = links.select(F.lit("reverse").alias("direction"), F.col("target_row").alias("seed"), F.col("source_row").alias("neighbour"))
    both = forward.unionByName(reverse)
    return both if seeds is None else both.join(seeds, ["direction", "seed"], "left_semi")


def neighbours(adjacent: DataFrame, per_seed: int) -> DataFrame:
    """The first neighbours of each seed, and how many it has in all; counted by partial aggregation, not in a window."""
    key = ["direction", "seed"]
    counts = adjacent.groupBy(*key).agg(F.count("*").alias("neighbours"))
    ranked = adjacent.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("neighbour")))
    return ranked.where(F.col("place") <= per_seed).join(counts, key).select(*key, "neighbour", "neighbours", "place")


def type_alignment(pairs: DataFrame) -> DataFrame:
    """(record, type) where a record has one type; records with conflicting types go."""
    return pairs.groupBy("record").agg(F.collect_set("type").alias("types")).where(F.size("types") == 1).select("record", F.element_at("types", 1).alias("type"))


def two_paths(rows: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(row, left_row, right_row) of rows that two checked references lead out of."""
    left = first.select(F.col("source_row").alias("row"), F.col("target_row").alias("left_row"))
    right = second.select(F.col("source_row").alias("row"), F.col("target_row").alias("right_row"))
    return rows.select("row").join(left, "row").join(right, "row")


#: Above about so many tuples, seeds are verified instead of all tuples grouped.
MOST_TUPLES = 50_000


def fact_candidates(df: DataFrame, coordinates: Sequence[str], values: Sequence[str], limit: int, row: str = "__row", most: int | None = MOST_TUPLES) -> tuple[DataFrame, dict]:
    """Tuples of several value columns, an equal share of ``limit`` each, and how each column was covered.

    A column with about ``most`` tuples at most is grouped whole and reports what
    its share leaves out; beyond that, seeds are taken, and what they leave out is
    unknown.  Without ``most`` all columns are grouped whole.  Never more coordinates than rows hold.
    """
    if limit < 1 or not values:
        raise ValueError("there is a value column and a limit of one at least")
    out, report = None, {}
    for k, value in enumerate(values):
        share = limit // len(values) + (k < limit % len(values))
        estimate = None if most is None else estimated_tuples(df, coordinates, value).first()["estimated_tuples"]
        exact = most is None or estimate <= most
        found = observed_tuples(df, coordinates, value, row, share) if exact else seeded_tuples(df, coordinates, value, share, row)
        report[value] = {"method": "exact" if exact else "seeded", "estimated_tuples": estimate, "share": share}
        part = found.select(F.lit(value).alias("value_column"), *coordinates, "observation_value", "source_row_count", "source_row_min", "source_row_max", F.col("distinct_value_count").cast("long").alias("distinct_value_count"))
        out = part if out is None else out.unionAll(part)
    return out, report


def witnesses(links: DataFrame, n: int) -> DataFrame:
    """The first n links, each target once before any twice, beside the number of targets there are.

    Targets are counted apart by partial aggregation; no window runs over all links.
    """
    turn = Window.partitionBy("target_row").orderBy("source_row")
    first = links.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= n).orderBy("turn", "source_row", "target_row").limit(n)
    return first.join(F.broadcast(links.agg(F.count_distinct("target_row").alias("targets"))))  # one row
