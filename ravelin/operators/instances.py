"""Instances: facts with types, definitions that share one, and previews of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import decimal_of
from .cards import signature


def fact_instances(rows: DataFrame, tuples: DataFrame, coordinates: Sequence[str], value: str, residual: Sequence[str], type_id: str, row: str = "__row", most: int = 1000) -> DataFrame:
    """Tuples (coordinates, observation_value, source_row_count, source_row_min, source_row_max, distinct_value_count) as typed facts.

    Every tuple is read again from the rows.  ``reason`` is null for an accepted
    fact, else: ambiguous_coordinates, non_numeric_value, too_many_rows,
    rows_changed, or residual_fields_vary: a further column that differs within
    the tuple means that its grain is not understood.
    """
    again = rows.groupBy(*coordinates, F.col(f"`{value}`").alias("observation_value")).agg(
        F.count("*").alias("__n"), F.min(row).alias("__lo"), F.max(row).alias("__hi"),
        *(F.count_distinct(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0"))).alias(f"__d{k}") for k, c in enumerate(residual)),
    )
    varies = F.lit(False)
    for k in range(len(residual)):
        varies = varies | (F.col(f"__d{k}") > 1)
    reason = (
        F.when(F.col("distinct_value_count") != 1, "ambiguous_coordinates").when(decimal_of(F.col("observation_value")).isNull(), "non_numeric_value")
        .when(F.col("source_row_count") > most, "too_many_rows")
        .when(F.col("__n").isNull() | (F.col("__n") != F.col("source_row_count")) | (F.col("__lo") != F.col("source_row_min")) | (F.col("__hi") != F.col("source_row_max")), "rows_changed")
        .when(varies, "residual_fields_vary")
    )
    out = tuples.join(again, [*coordinates, "observation_value"], "left").withColumn("reason", reason)
    key = F.sha2(F.to_json(F.struct(F.lit(type_id).alias("type"), *coordinates, "observation_value")), 256)
    return out.select(F.concat(F.lit("fact:"), F.substring(key, 1, 24)).alias("id"), F.lit(type_id).alias("type"), *coordinates, "observation_value", "source_row_count", "reason")


def fact_assertions(facts: DataFrame, attribute: str) -> DataFrame:
    """(id, subject, attribute, literal) of the accepted facts."""
    rows = facts.where("reason IS NULL")
    key = F.sha2(F.concat_ws("|", "id", F.lit(attribute), "observation_value"), 256)
    return rows.select(F.concat(F.lit("value:"), F.substring(key, 1, 24)).alias("id"), F.col("id").alias("subject"), F.lit(attribute).alias("attribute"), F.col("observation_value").alias("literal"))


def memberships(rows: DataFrame, templates: DataFrame, meaning: Sequence[str], references: Sequence[str] = (), row: str = "__row") -> DataFrame:
    """Rows that have the full meaning of an accepted template row: row, type_id, template_id, variant.

    templates: (template_id, type_id, meaning, references).  Meanings are compared
    whole and raw, nulls with nulls.  Rows whose templates disagree on the type are
    left out; of several templates the least counts; ``variant`` says that the
    references differ, which proves no relation.
    """
    same = lambda columns: F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns)), {"ignoreNullFields": "false"})
    known = templates.select("template_id", "type_id", same(meaning).alias("m"), (same(references) if references else F.lit("")).alias("tr"))
    least = known.groupBy("m").agg(F.count_distinct("type_id").alias("types"), F.min(F.struct("template_id", "type_id", "tr")).alias("t")).where("types = 1")
    own = rows.select(F.col(row).alias("row"), same(meaning).alias("m"), (same(references) if references else F.lit("")).alias("rr"))
    return own.join(least, "m").select("row", "t.type_id", "t.template_id", (F.col("rr") != F.col("t.tr")).alias("variant"))


def conflicting_alignments(alignments: DataFrame) -> DataFrame:
    """Records (record_id) aligned exactly with several concepts."""
    return alignments.groupBy("record_id").agg(F.count_distinct("concept_id").alias("n")).where("n > 1").select("record_id")


def replay(found: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Witnessed pairs (source_row, target_row) that the checked links still lead to, each row to one target."""
    still = found.join(pairs, ["source_row", "target_row"], "left_semi")
    return still.join(rows.select(F.col("row").alias("source_row")), "source_row", "left_semi")


def preview(objects: DataFrame, per: Sequence[str], n: int = 3, order: str = "id") -> DataFrame:
    """The first n objects of each kind, with how many there are."""
    counts = objects.groupBy(*per).agg(F.count("*").alias("of"))
    first = objects.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(order))).where(F.col("place") <= n)
    return first.join(counts, list(per))


def attributes(objects: DataFrame, values: DataFrame, n: int = 8) -> DataFrame:
    """Each object with its first n attributes by name: (id, attributes, n_attributes)."""
    # the filter on the rank lets each task keep n of a subject before the exchange; all are counted apart
    first = values.withColumn("place", F.row_number().over(Window.partitionBy("subject").orderBy("attribute", "literal"))).where(F.col("place") <= n)
    listed = first.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("place", "attribute", "literal"))).alias("a"))
    kept = values.groupBy("subject").agg(F.count("*").alias("n_attributes")).join(listed, "subject")
    out = objects.select("id").join(kept, F.col("id") == F.col("subject"), "left")
    return out.select("id", F.coalesce(F.transform("a", lambda x: F.concat_ws("=", x["attribute"], x["literal"])), F.array().cast("array<string>")).alias("attributes"), F.coalesce("n_attributes", F.lit(0)).alias("n_attributes"))


def objects(typed: DataFrame, table: str) -> DataFrame:
    """(id, type, row): an instance for each row (row, type_id) of one type; rows with several types get none."""
    one = typed.groupBy("row").agg(F.min("type_id").alias("type"), F.count_distinct("type_id").alias("n")).where("n = 1")
    return one.select(F.concat(F.lit(f"{table}:"), F.col("row").cast("string")).alias("id"), "type", "row")


def edges(links: DataFrame, sources: DataFrame, targets: DataFrame, predicate: str) -> DataFrame:
    """(subject, predicate, object, source_type, target_type) of links whose two rows are instances; never type by type."""
    a = sources.select(F.col("row").alias("source_row"), F.col("id").alias("subject"), F.col("type").alias("source_type"))
    b = targets.select(F.col("row").alias("target_row"), F.col("id").alias("object"), F.col("type").alias("target_type"))
    return links.join(a, "source_row").join(b, "target_row").select("subject", F.lit(predicate).alias("predicate"), "object", "source_type", "target_type")


def slot_assertions(bound: DataFrame, table: str) -> DataFrame:
    """(subject, attribute, literal) of the slots of template bindings (row, slots)."""
    return bound.select(F.concat(F.lit(f"{table}:"), F.col("row").cast("string")).alias("subject"), F.explode("slots").alias("attribute", "literal"))


def replayed_memberships(found: DataFrame, rows: DataFrame, meaning: Sequence[str], row: str = "__row") -> DataFrame:
    """Memberships (row, type_id, template_row, fingerprint) read again: with ``reason``, null where they hold.

    The fingerprint is ``cards.signature`` of the meaning when the membership was made; both the row
    and the row that stands for the type must still have it.
    """
    now = rows.select(F.col(row).alias("row"), signature(meaning).alias("now"))
    there = now.select(F.col("row").alias("template_row"), F.col("now").alias("template_now"))
    both = found.join(now, "row", "left").join(there, "template_row", "left")
    reason = (
        F.when(F.col("now").isNull(), "row_gone").when(F.col("template_now").isNull(), "template_gone")
        .when(F.col("now") != F.col("fingerprint"), "row_changed").when(F.col("template_now") != F.col("fingerprint"), "template_changed")
    )
    return both.select(*found.columns, reason.alias("reason"))
