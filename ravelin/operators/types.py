"""Pairs of definitions: equal ones, and ones with a common generalisation; formulas bound to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import parsed
from ..functions.text import folded
from ..sources.rows import materialise
from .graphs import cyclic
from .recall import narrow


def equivalent_pairs(types: DataFrame, key: Sequence[str], id_col: str = "id", chain: bool = True) -> DataFrame:
    """(left, right) of types with equal keys, left < right, each paired with the key's least.

    That is membership in a class, a row a type however large the class is.  Without ``chain`` a class is
    written out as all its pairs, which is for small classes only: one task holds the ids of a key.
    """
    if chain:
        least = types.where(F.col(f"`{id_col}`").isNotNull()).groupBy(*key).agg(F.min(id_col).alias("left")).withColumnsRenamed({k: f"__{n}" for n, k in enumerate(key)})
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__{n}")) for n, k in enumerate(key)]
        return types.join(least, same).where(F.col(f"`{id_col}`") != F.col("left")).select("left", F.col(f"`{id_col}`").alias("right")).distinct()
    groups = types.groupBy(*key).agg(F.array_sort(F.collect_set(id_col)).alias("ids")).where(F.size("ids") > 1)
    rows = groups.select("ids", F.posexplode("ids").alias("i", "left"))
    return rows.select("left", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("right"))


def canonical(types: DataFrame, key: Sequence[str], id_col: str = "id") -> DataFrame:
    """(id, canonical_id): the least id of equal keys."""
    least = types.groupBy(*key).agg(F.min(id_col).alias("canonical_id"))
    return types.select(id_col, *key).join(least, list(key)).select(id_col, "canonical_id")


def generalisations(types: DataFrame, within: Sequence[str], term_col: str, id_col: str = "id", fanout: int = 32, least: int = 2) -> DataFrame:
    """(left, right, shared_terms) of types in one group that share ``least`` terms and more; widely held terms do not count."""
    terms = types.select(*within, F.col(id_col).alias("id"), F.explode(F.array_distinct(F.col(term_col))).alias("term")).distinct()
    held = narrow(terms, [*within, "term"], fanout).groupBy(*within, "term").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    rows = held.select("ids", F.posexplode("ids").alias("i", "left"))
    pairs = rows.select("left", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("right"))
    return pairs.groupBy("left", "right").agg(F.count("*").alias("shared_terms")).where(F.col("shared_terms") >= least)


def bind_formulas(formulas: DataFrame, names: DataFrame) -> DataFrame:
    """A row per symbol of each formula: id, symbol, role, candidates, target_id, status.

    formulas: (id, formula); names: (id, name), names and aliases of definitions,
    compared folded.  A symbol is bound by exactly one other definition.
    """
    rows = formulas.select("id", parsed("formula").alias("p")).where("p.status = 'parsed'")
    each = rows.select("id", F.explode("p.symbols").alias("s")).select("id", "s.symbol", "s.role", folded("s.symbol").alias("name")).distinct()
    known = names.select(F.col("id").alias("target"), folded("name").alias("name")).distinct()
    found = each.join(known, "name", "left").groupBy("id", "symbol", "role").agg(
        F.array_sort(F.collect_set(F.when(F.col("target") != F.col("id"), F.col("target")))).alias("candidates"), F.bool_or(F.coalesce(F.col("target") == F.col("id"), F.lit(False))).alias("itself")
    )
    status = F.when(F.size("candidates") == 1, "bound").when(F.size("candidates") > 1, "ambiguous_definition").when(F.col("itself"), "self_reference").otherwise("no_definition")
    return found.select("id", "symbol", "role", "candidates", F.when(F.size("candidates") == 1, F.col("candidates")[0]).alias("target_id"), status.alias("status"))


def calculation_status(bound: DataFrame) -> DataFrame:
    """(id, status): accepted where every symbol is bound and no dependency runs in a circle."""
    bound = materialise(bound)
    per = bound.groupBy("id").agg(F.bool_and(F.col("status") == "bound").alias("all_bound"))
    edges = bound.join(per.where("all_bound"), "id").select(F.col("id").alias("a"), F.col("target_id").alias("b"))
    round_ = cyclic(edges).withColumn("circular", F.lit(True)).withColumnRenamed("node", "id")
    status = F.when(~F.col("all_bound"), "unresolved_operands").when(F.col("circular"), "cyclic_dependency").otherwise("accepted")
    return per.join(round_, "id", "left").select("id", status.alias("status"))


def retracted(earlier: DataFrame, bound: DataFrame) -> DataFrame:
    """Earlier dependencies (id, target_id) that the formulas as they are now no longer make."""
    now = bound.where("status = 'bound'").select("id", "target_id").distinct()
    return earlier.select("id", "target_id").distinct().join(now, ["id", "target_id"], "left_anti")
