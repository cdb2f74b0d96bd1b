"""Packets of evidence for decisions made elsewhere, and what is left to decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import json_leaf, join_usable


def all_or_nothing(df: DataFrame, limit: int) -> DataFrame:
    """All rows where there are at most ``limit``, else none: a cut list is never taken for a whole one."""
    n = df.limit(limit + 1).agg(F.count("*").alias("__n")).where(F.col("__n") <= limit)
    return df.join(F.broadcast(n)).drop("__n")


def joint_examples(links: DataFrame, bad: DataFrame, pairs: int = 2) -> DataFrame:
    """(kind, source_row, target_row): matched pairs of distinct targets, the first source of each, and one counterexample.

    bad: (row_number, reason).
    """
    first = links.groupBy("target_row").agg(F.min("source_row").alias("source_row")).orderBy("source_row", "target_row").limit(pairs)
    good = first.select(F.lit("matched").alias("kind"), "source_row", "target_row")
    return good.unionByName(bad.orderBy("row_number").limit(1).select(F.col("reason").alias("kind"), F.col("row_number").alias("source_row"), F.lit(None).cast("long").alias("target_row")))


def packets(items: DataFrame, key: str, rank: str, most_bytes: int, fields: Sequence[str]) -> DataFrame:
    """(key, items, n_items, n_omitted, bytes): each key's items in rank order, as many as fit in so many bytes of JSON.

    The first item is the seed; a key whose seed alone is too long has no packet.
    Trimming is from the end and is counted.
    """
    body = F.struct(rank, *fields)
    counts = items.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    sized = items.withColumn("__b", F.octet_length(F.to_json(body)) + 1)
    grain = Window.partitionBy(key)
    # an item takes 2 bytes at least: more than half as many as the bytes cannot fit, and go before the exchange
    sized = sized.withColumn("__place", F.row_number().over(grain.orderBy(rank))).where(F.col("__place") <= most_bytes // 2 + 1)
    run = sized.withColumn("__sum", F.sum("__b").over(grain.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)) + 1)
    fits = F.col("__sum") <= most_bytes
    out = run.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(fits, body))).alias("items"), F.count_if(fits).alias("n_items"), F.coalesce(F.max(F.when(fits, F.col("__sum"))), F.lit(0)).alias("bytes"),
    )
    out = out.where("n_items > 0").join(counts, F.col(key).eqNullSafe(F.col("__key")))
    return out.select(key, "items", "n_items", (F.col("__n") - F.col("n_items")).alias("n_omitted"), "bytes")


def distinct_packets(found: DataFrame, key: str) -> DataFrame:
    """Packets with the same items once: the least key stands for them, the others are kept as its sources."""
    same = found.groupBy(F.sha2(F.to_json("items"), 256).alias("digest")).agg(F.array_sort(F.collect_set(key)).alias("sources"))
    return same.select("digest", F.element_at("sources", 1).alias(key), "sources")


def open_tasks(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks (task_id, evidence) whose evidence is not what they were last tried with (task_id, digest)."""
    now = tasks.withColumn("digest", F.sha2(F.to_json(F.struct("evidence")), 256))
    return now.join(done.select("task_id", "digest"), ["task_id", "digest"], "left_anti")


def member_paths(terms: DataFrame, path: Sequence[str], members: DataFrame, dimensions: DataFrame) -> DataFrame:
    """From a term's JSON leaf to a member code, and from the member's text to the one dimension it names.

    terms: (term_id, attributes); members: (member_row, code, text); dimensions:
    (dimension_id, name).  A code of several members, or a text that names several
    dimensions, is ambiguous and gives no path: status says which.
    """
    leaf = terms.select("term_id", json_leaf(F.col("attributes"), path).alias("code")).where(join_usable(F.col("code")))
    codes = members.groupBy("code").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    items = F.transform(F.split(F.lower("text"), "[;,|]"), lambda x: F.trim(x))
    named = dimensions.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("dimension_id").alias("dimension_id"), F.count_distinct("dimension_id").alias("d"))
    one = leaf.join(codes, "code", "left")
    hits = one.where("n = 1").select("term_id", F.explode(items).alias("name")).join(named, "name").groupBy("term_id").agg(F.min("dimension_id").alias("dimension_id"), F.sum("d").alias("dims"), F.count_distinct("dimension_id").alias("kinds"))
    out = one.join(hits, "term_id", "left")
    status = (
        F.when(F.col("n").isNull(), "member_missing").when(F.col("n") > 1, "member_ambiguous").when(F.col("dims").isNull(), "dimension_missing")
        .when((F.col("kinds") > 1) | (F.col("dims") > F.col("kinds")), "dimension_ambiguous").otherwise("unique")
    )
    return out.select("term_id", "code", status.alias("status"), F.when(status == "unique", F.col("dimension_id")).alias("dimension_id"))


def value_sources(literals: DataFrame, rows: DataFrame, columns: Sequence[str], row: str = "__row", per_literal: int = 5) -> DataFrame:
    """(literal, column, row): rows where a whole cell is the literal, the first few of each, with how many there are."""
    cells = rows.select(F.col(row).alias("row"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("literal")) for c in columns))).alias("c")).select("row", "c.*")
    found = cells.join(literals.select("literal").where("literal != ''").distinct(), "literal")
    counts = found.groupBy("literal", "column").agg(F.count("*").alias("of"))
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("literal", "column").orderBy("row"))).where(F.col("place") <= per_literal)
    return first.join(counts, ["literal", "column"])


def slot_targets(bindings: DataFrame, names: DataFrame) -> DataFrame:
    """(binding_id, slot, status, target_id): slot values that equal the whole label or alias of one type.

    bindings: (binding_id, slot, value); names: (id, name).
    """
    known = names.groupBy("name").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"))
    out = bindings.join(known, bindings["value"] == known["name"], "left")
    status = F.when(F.col("n").isNull(), "no_target").when(F.col("n") > 1, "ambiguous_target").otherwise("bound")
    return out.select("binding_id", "slot", status.alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("target_id"))


def located(witnesses: DataFrame, rows: DataFrame) -> DataFrame:
    """(record_id, row) of witnessed record ids; row is null where no source row has the id.  rows: (record_id, row)."""
    return witnesses.select("record_id").distinct().join(rows.groupBy("record_id").agg(F.min("row").alias("row")), "record_id", "left")


def sample_groups(rows: DataFrame, fields: Sequence[str], n: int, row: str = "__row") -> DataFrame:
    """Distinct observed values of the fields together, the first n by first row, with the number of rows of each."""
    return rows.groupBy(*fields).agg(F.count("*").alias("rows"), F.min(row).alias("first_row")).orderBy("first_row").limit(n)


def instance_coverage(instances: DataFrame, types: DataFrame, assertions: DataFrame) -> DataFrame:
    """(kind, n): instances by kind, types without any, instances no assertion names.

    instances: (id, type, kind); types: (id); assertions: (subject, object).
    """
    kinds = instances.groupBy(F.col("kind").alias("kind")).agg(F.count("*").alias("n"))
    bare = types.join(instances.select(F.col("type").alias("id")), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("types_without_instances").alias("kind"), "n")
    named = assertions.select(F.explode(F.array("subject", "object")).alias("id"))
    alone = instances.join(named, "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("instances_without_assertions").alias("kind"), "n")
    return kinds.unionAll(bare).unionAll(alone)


def proven(bound: DataFrame) -> DataFrame:
    """Bound slots (binding_id, slot, status, target_id) with a proof: a digest that only the same binding gives again."""
    return bound.where("status = 'bound'").withColumn("proof", F.sha2(F.to_json(F.struct("binding_id", "slot", "target_id")), 256))


def still_proven(earlier: DataFrame, now: DataFrame) -> DataFrame:
    """Earlier proven slots with ``holds``: whether the bindings made now prove them again."""
    again = proven(now).select("proof").distinct().withColumn("holds", F.lit(True))
    return earlier.join(again, "proof", "left").withColumn("holds", F.coalesce("holds", F.lit(False)))
