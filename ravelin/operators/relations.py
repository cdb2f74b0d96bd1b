"""Relation plans over rows: every reference ends matched, missing, ambiguous, unknown or empty."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Condition, compiled
from ..functions.formulas import symbols_of
from ..functions.values import all_of, json_leaf, ratio
from ..sources.rows import materialise
from .reference import Reference, links

MODES = ("identifier", "members", "formula", "text")


@dataclass(frozen=True)
class RelationPlan:
    """source_field of source rows -> target_field, within equal ``scope`` columns (source -> target).

    Modes: identifier, one value; members, a JSON array of strings or a list split
    at ``delimiter``; formula, the symbols of an expression; text, a decision made
    elsewhere and given with the call.  ``most`` bounds the references of one row;
    a row beyond it is unresolved as a whole.
    """

    plan_id: str
    predicate: str
    source_field: str
    target_field: str
    mode: str = "identifier"
    selector: Condition | None = None
    scope: dict[str, str] = field(default_factory=dict)
    context: tuple[str, ...] = ()
    transform: str = "identity"
    path: tuple[str, ...] = ()
    delimiter: str | None = None
    most: int = 100
    source_row: str = "__row"
    target_row: str = "__row"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.transform != "identity" and (self.mode != "identifier" or self.path):
            raise ValueError("a transform needs a plain identifier")


def _references(plan: RelationPlan, value: Column) -> Column:
    """The references a value makes; null where it cannot be read."""
    if plan.mode == "formula":
        return symbols_of(value)
    if plan.mode != "members":
        return F.array(value)
    listed = F.from_json(value, "array<string>")
    sound = F.schema_of_variant(F.try_parse_json(value)) == "ARRAY<STRING>"
    empty = F.regexp_replace(value, r"\s", "") == "[]"
    # re.escape escapes sign by sign, so that no delimiter can end the quotation
    split = F.split(value, F.lit(re.escape(plan.delimiter))) if plan.delimiter else F.array(value)
    return F.when(F.ltrim(value).startswith("["), F.when(empty, F.array().cast("array<string>")).when(F.coalesce(sound, F.lit(False)), listed)).otherwise(split)


def outcomes(source: DataFrame, target: DataFrame, plan: RelationPlan, decisions: DataFrame | None = None, witnesses: DataFrame | None = None) -> DataFrame:
    """A row per reference: source_row, item, outcome, target_row.

    Outcomes: not_applicable, condition_unknown, empty_reference, unsupported_value,
    scope_unknown, missing_target, ambiguous_identity, missing_or_ambiguous_target
    (through a transform), undecided (text without a decision),
    witness_target_mismatch, matched.  ``decisions`` (source_row, target_row) decide
    text; ``witnesses`` (source_row, target_row) restrict rows and pairs.
    """
    raw = F.col(f"`{plan.source_field}`").cast("string")
    value = F.when(raw != "", json_leaf(raw, plan.path) if plan.path else raw)
    scopes = {f"s{k}": (s, t) for k, (s, t) in enumerate(sorted(plan.scope.items()))}
    needed = [*plan.scope, *plan.context]
    known = all_of([F.coalesce(F.col(f"`{c}`").cast("string") != "", F.lit(False)) for c in needed])
    rows = source.select(
        F.col(f"`{plan.source_row}`").alias("source_row"), compiled(plan.selector).alias("chosen"), raw.alias("raw"), value.alias("value"), known.alias("known"),
        *(F.col(f"`{s}`").cast("string").alias(k) for k, (s, _) in scopes.items()),
    )
    if witnesses is not None:
        rows = rows.join(witnesses.select("source_row").distinct(), "source_row", "left_semi")
    early = (
        F.when(F.col("chosen").isNull(), "condition_unknown").when(~F.col("chosen"), "not_applicable")
        .when(F.coalesce(F.col("raw"), F.lit("")) == "", "empty_reference").when(F.col("value").isNull(), "unsupported_value" if plan.path else "empty_reference")
        .when(~F.col("known"), "scope_unknown")
    )
    rows = rows.withColumn("early", early)
    done = rows.where("early IS NOT NULL").select("source_row", F.lit(None).cast("string").alias("item"), F.col("early").alias("outcome"), F.lit(None).cast("long").alias("target_row"))
    open_rows = rows.where("early IS NULL")
    if plan.transform != "identity":
        ref = Reference(plan.source_field, plan.target_field, plan.selector, {t: s for s, t in plan.scope.items()}, plan.transform, source_row=plan.source_row, target_row=plan.target_row)
        found = links(source, target, ref)
        out = open_rows.join(found, "source_row", "left").select("source_row", F.col("value").alias("item"), F.when(F.col("target_row").isNull(), "missing_or_ambiguous_target").otherwise("matched").alias("outcome"), "target_row")
    elif plan.mode == "text":
        given = decisions if decisions is not None else source.sparkSession.createDataFrame([], "source_row long, target_row long")
        out = open_rows.join(given, "source_row", "left").select("source_row", F.col("value").alias("item"), F.when(F.col("target_row").isNull(), "undecided").otherwise("matched").alias("outcome"), "target_row")
    else:
        items = open_rows.withColumn("items", _references(plan, F.col("value")))
        readable = F.coalesce(F.size("items") <= plan.most, F.lit(False))
        bad = items.where(~readable | F.col("items").isNull()).select("source_row", F.col("value").alias("item"), F.lit("unsupported_value").alias("outcome"), F.lit(None).cast("long").alias("target_row"))
        each = items.where(readable).select("source_row", F.explode("items").alias("item"), *scopes)
        complete = all_of([F.col(f"`{t}`").isNotNull() for _, t in scopes.values()]) & F.coalesce(F.col(f"`{plan.target_field}`").cast("string") != "", F.lit(False))
        keys = target.where(complete).groupBy(F.col(f"`{plan.target_field}`").cast("string").alias("item"), *(F.col(f"`{t}`").cast("string").alias(k) for k, (_, t) in scopes.items()))
        keys = keys.agg(F.count("*").alias("n"), F.min(plan.target_row).alias("first"))
        joined = each.join(materialise(keys), ["item", *scopes], "left")  # written: a hot item can be split, few keys broadcast
        outcome = F.when(F.col("n").isNull(), "missing_target").when(F.col("n") > 1, "ambiguous_identity").otherwise("matched")
        out = joined.select("source_row", "item", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("first")).alias("target_row")).unionByName(bad)
    if witnesses is not None:
        allowed = witnesses.select("source_row", "target_row").distinct().withColumn("allowed", F.lit(True))
        out = out.join(allowed, ["source_row", "target_row"], "left")
        off = (F.col("outcome") == "matched") & F.col("allowed").isNull()
        outcome = F.when(off, "witness_target_mismatch").otherwise(F.col("outcome"))
        out = out.select("source_row", "item", outcome.alias("outcome"), F.when(~off, F.col("target_row")).alias("target_row"))
    return done.unionByName(out)


def assertions(found: DataFrame, plan: RelationPlan) -> DataFrame:
    """(id, subject, predicate, object, plan_id) of the matched pairs; the same edge of one plan is one."""
    edges = found.where("outcome = 'matched'").select("source_row", "target_row").distinct()
    key = F.sha2(F.to_json(F.struct(F.lit(plan.plan_id).alias("p"), F.col("source_row").alias("s"), F.lit(plan.predicate).alias("r"), F.col("target_row").alias("t"))), 256)
    return edges.select(key.alias("id"), F.col("source_row").alias("subject"), F.lit(plan.predicate).alias("predicate"), F.col("target_row").alias("object"), F.lit(plan.plan_id).alias("plan_id"))


def allowed_members(found: DataFrame) -> DataFrame:
    """(source_row, members, complete): the set of targets a row allows."""
    rows = found.where(F.col("outcome").isin("matched", "missing_target", "ambiguous_identity", "witness_target_mismatch"))
    return rows.groupBy("source_row").agg(F.array_sort(F.collect_set("target_row")).alias("members"), F.bool_and(F.col("outcome") == "matched").alias("complete"))


def coverage(found: DataFrame) -> DataFrame:
    """One row: rows examined, chosen, unknown and matched; references and matched ones; the share of rows matched."""
    # a row's references are counted first, so that rows are not counted by their references
    per_row = found.groupBy("source_row").agg(
        F.count_if(~F.col("outcome").isin("not_applicable", "condition_unknown", "empty_reference", "unsupported_value", "scope_unknown")).alias("refs"),
        F.count_if(F.col("outcome") == "matched").alias("hits"),
        F.bool_or(F.col("outcome") == "not_applicable").alias("away"),
        F.bool_or(F.col("outcome") == "condition_unknown").alias("unknown"),
        F.bool_or(F.col("outcome") == "empty_reference").alias("empty"),
    )
    chosen = ~F.col("away") & ~F.col("unknown")
    return per_row.agg(
        F.count("*").alias("examined"), F.count_if(chosen).alias("selector_true"), F.count_if("unknown").alias("selector_unknown"),
        F.count_if(chosen & ~F.col("empty")).alias("applicable_records"), F.count_if(F.col("hits") > 0).alias("matched_records"),
        F.coalesce(F.sum("refs"), F.lit(0)).alias("references"), F.coalesce(F.sum("hits"), F.lit(0)).alias("matched_references"),
    ).withColumn("matched_record_ratio", ratio(F.col("matched_records"), F.col("applicable_records")))


def merge_items(items: DataFrame, order: str = "seq", union: Sequence[str] = ("evidence_ids", "plan_ids")) -> DataFrame:
    """One row per (kind, id): the first body, and the union of the id lists, sorted."""
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in union if c in items.columns]
    return items.groupBy("kind", "id").agg(F.min_by("body", order).alias("body"), *sets)


def integrity(objects: DataFrame, assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(problem, n): subjects, objects and evidence that assertions name and nothing defines; literal xor object."""
    ids, known = objects.select("id"), evidence.select("id")

    def missing(problem: str, rows: DataFrame, column: str, there: DataFrame) -> DataFrame:
        gone = rows.where(F.col(column).isNotNull()).join(there.withColumnRenamed("id", "__id"), F.col(column) == F.col("__id"), "left_anti")
        return gone.agg(F.count("*").alias("n")).select(F.lit(problem).alias("problem"), "n")

    cited = assertions.select("id", F.explode("evidence_ids").alias("e"))
    both = assertions.where(F.col("object").isNull() == F.col("literal").isNull()).agg(F.count("*").alias("n")).select(F.lit("literal_xor_object").alias("problem"), "n")
    out = missing("dangling_subject", assertions, "subject", ids)
    return out.unionAll(missing("dangling_object", assertions, "object", ids)).unionAll(missing("dangling_evidence", cited, "e", known)).unionAll(both)
