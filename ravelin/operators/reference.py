"""Exact checks of a reference from one field to another, over all rows.

Source rows are first counted by (value, scopes, selected) and target rows by
(value, scopes), both with partial aggregation.  Only distinct keys are joined,
so a key with a third of all rows is one row in the join, and no count is
multiplied by repeated targets.  0, 1 and more target rows stay apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Condition, compiled
from ..functions.text import TRANSFORMS, folded_items, folded_value
from ..functions.values import all_of, identity_usable, join_usable, json_leaf, ratio, selected
from ..sources.rows import materialise

COUNTS = (
    "source_rows selector_true selector_false selector_unknown null_references empty_references whitespace_references missing_scope "
    "eligible_references matched_references unique_matches ambiguous_matches missing_in_input outside_eligible_references outside_matched_references"
).split()


@dataclass(frozen=True)
class Reference:
    """source.field -> target.field, read where ``selector`` holds, within equal ``scope`` columns
    (target column -> source column), through an allowed ``transform`` or, in the source, a JSON path."""

    source_field: str
    target_field: str
    selector: dict | Condition | None = None
    scope: dict[str, str] = field(default_factory=dict)
    transform: str = "identity"
    path: tuple[str, ...] = ()
    source_row: str = "__row"
    target_row: str = "__row"

    def __post_init__(self):
        if self.transform not in TRANSFORMS:
            raise ValueError(f"unknown transform {self.transform!r}")

    @property
    def scopes(self) -> list[str]:
        return [f"scope_{k}" for k in range(len(self.scope))]

    def chosen(self) -> Column:
        return compiled(self.selector) if isinstance(self.selector, Condition) else selected(self.selector)

    def source_rows(self, source: DataFrame) -> DataFrame:
        """(row, ref, selected, scope_k) of every source row."""
        ref = F.col(f"`{self.source_field}`").cast("string")
        if self.path:
            ref = json_leaf(ref, self.path)
        scopes = [F.col(f"`{s}`").cast("string").alias(k) for k, (_, s) in zip(self.scopes, sorted(self.scope.items()))]
        return source.select(F.col(f"`{self.source_row}`").alias("row"), ref.alias("ref"), self.chosen().alias("selected"), *scopes)

    def target_keys(self, target: DataFrame) -> DataFrame:
        """(ref, scope_k, multiplicity, target_row) of every complete target key."""
        scopes = [F.col(f"`{t}`").cast("string").alias(k) for k, (t, _) in zip(self.scopes, sorted(self.scope.items()))]
        rows = target.select(F.col(f"`{self.target_field}`").cast("string").alias("ref"), F.col(f"`{self.target_row}`").alias("row"), *scopes)
        complete = all_of([join_usable(F.col(c)) for c in ("ref", *self.scopes)])
        return rows.where(complete).groupBy("ref", *self.scopes).agg(F.count("*").alias("multiplicity"), F.min("row").alias("target_row"))

    def _tokens(self, side: str) -> Column:
        ref = F.col("ref")
        if self.transform == "identity":
            return F.array(F.when(identity_usable(ref), ref))
        return folded_items(ref) if self.transform in (f"{side}_alias_items", "both_alias_items") else folded_value(ref)

    def _token_rows(self, keys: DataFrame, side: str) -> DataFrame:
        return keys.withColumn("key", F.explode(self._tokens(side))).where(F.coalesce(F.col("key") != "", F.lit(False)))

    def token_keys(self, target: DataFrame) -> DataFrame:
        """(key, scope_k, multiplicity, target_row): target rows by the tokens they answer to."""
        tokens = self._token_rows(self.target_keys(target), "target")
        return tokens.groupBy("key", *self.scopes).agg(F.sum("multiplicity").alias("multiplicity"), F.min("target_row").alias("target_row"))

    @property
    def direct(self) -> bool:
        return self.transform == "identity" and not self.path

    def matched(self, source_keys: DataFrame, target: DataFrame) -> DataFrame:
        """Distinct source keys with multiplicity (null: missing; 2 stands for ambiguity through tokens) and target_row."""
        if self.direct:
            return source_keys.join(self.target_keys(target), ["ref", *self.scopes], "left")
        usable = source_keys.where(all_of([join_usable(F.col(c)) for c in ("ref", *self.scopes)]))
        tokens = self._token_rows(usable.select("ref", *self.scopes).distinct(), "source").join(self.token_keys(target), ["key", *self.scopes])
        found = tokens.groupBy("ref", *self.scopes).agg(
            F.when(F.max("multiplicity") > 1, F.lit(2)).otherwise(F.least(F.count_distinct("target_row"), F.lit(2))).cast("long").alias("multiplicity"),
            F.min("target_row").alias("target_row"),
        )
        return source_keys.join(found, ["ref", *self.scopes], "left")

    def usable(self) -> tuple[Column, Column]:
        return join_usable(F.col("ref")), all_of([join_usable(F.col(s)) for s in self.scopes])


def _tests(usable: Column, scoped: Column, chosen: Column | None = None) -> dict[str, Column]:
    """What each count counts, over keys with their multiplicity, ``chosen`` or, where it is not given, ``selected``."""
    chosen = F.col("selected") if chosen is None else chosen
    yes, no = F.coalesce(chosen, F.lit(False)), F.coalesce(~chosen, F.lit(False))
    hit, eligible = F.coalesce(F.col("multiplicity") > 0, F.lit(False)), usable & scoped
    one, more = F.coalesce(F.col("multiplicity") == 1, F.lit(False)), F.coalesce(F.col("multiplicity") > 1, F.lit(False))
    tests = dict(zip(COUNTS, (
        F.lit(True), yes, no, chosen.isNull(), yes & F.col("ref").isNull(), yes & (F.col("ref") == ""),
        yes & (F.col("ref") != "") & ~usable, yes & usable & ~scoped, yes & eligible, yes & eligible & hit, yes & eligible & one,
        yes & eligible & more, yes & eligible & F.col("multiplicity").isNull(), no & eligible, no & eligible & hit,
    )))
    return tests | {"distinct_eligible_keys": yes & eligible, "distinct_keys_matched": yes & eligible & hit}


def _ratios() -> dict[str, Column]:
    return {
        "distinct_key_inclusion_ratio": ratio(F.col("distinct_keys_matched"), F.col("distinct_eligible_keys")),
        "whole_column_distinct_value_inclusion_ratio": ratio(F.col("distinct_source_values_in_target"), F.col("distinct_source_values")),
        "reference_hit_ratio": ratio(F.col("matched_references"), F.col("eligible_references")),
        "unique_match_ratio": ratio(F.col("unique_matches"), F.col("eligible_references")),
        "ambiguous_match_ratio": ratio(F.col("ambiguous_matches"), F.col("eligible_references")),
        "missing_in_input_ratio": ratio(F.col("missing_in_input"), F.col("eligible_references")),
    }


def check(source: DataFrame, target: DataFrame, ref: Reference) -> DataFrame:
    """One row: the fifteen counts, distinct keys, whole-column inclusion, target statistics, ratios."""
    usable, scoped = ref.usable()
    grouped = ref.source_rows(source).groupBy("ref", "selected", *ref.scopes).agg(F.count("*").alias("n"))
    joined = ref.matched(grouped, target)
    tests = _tests(usable, scoped)
    hit = F.coalesce(F.col("multiplicity") > 0, F.lit(False))
    # keys are summed up by value first, so that values are counted in the same pass
    size = lambda k: F.lit(1) if k.startswith("distinct") else F.col("n")
    sums = [F.coalesce(F.sum(F.when(t, size(k))), F.lit(0)).alias(k) for k, t in tests.items()]
    total = [F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in tests]
    keys = ref.target_keys(target) if ref.direct else ref.token_keys(target)
    stats = [
        F.count("*").alias("target_distinct_keys"),
        F.count_if(F.col("multiplicity") > 1).alias("target_duplicate_key_groups"),
        F.coalesce(F.max("multiplicity"), F.lit(0)).alias("target_max_multiplicity"),
    ]
    complete = F.coalesce(F.sum("multiplicity"), F.lit(0)).alias("target_rows_with_complete_key")
    if ref.direct:
        there = hit
        if ref.scopes:  # a value may stand in the target under another scope
            known = ref.target_keys(target).select("ref").distinct().withColumn("there", F.lit(True))
            joined, there = joined.join(known, "ref", "left"), F.col("there").isNotNull()
        values = joined.groupBy("ref").agg(*sums, F.bool_or(usable).alias("usable"), F.bool_or(there).alias("there"))
        counts = values.agg(*total, F.count_if("usable").alias("distinct_source_values"), F.count_if(F.col("usable") & F.col("there")).alias("distinct_source_values_in_target"))
        parts = [counts, keys.agg(*stats, complete)]
    else:
        known = ref.token_keys(target).select("key").distinct().withColumn("there", F.lit(True))
        values = ref._token_rows(grouped.where(usable).select("ref").distinct(), "source").join(known, "key", "left").groupBy("ref").agg(F.max("there").alias("there"))
        whole = values.agg(F.count("*").alias("distinct_source_values"), F.count("there").alias("distinct_source_values_in_target"))
        parts = [joined.agg(*sums), whole, keys.agg(*stats), ref.target_keys(target).agg(complete)]
    names = [*COUNTS, "distinct_eligible_keys", "distinct_keys_matched", "distinct_source_values", "distinct_source_values_in_target", "target_rows_with_complete_key", "target_distinct_keys", "target_duplicate_key_groups", "target_max_multiplicity"]
    one_row = _beside(parts).select(*names)
    return one_row.withColumns(_ratios())


def _beside(parts: Sequence[DataFrame]) -> DataFrame:
    """One row out of several one-row frames: a union, summed up."""
    names = [c for p in parts for c in p.columns]
    rows = None
    for p in parts:
        filled = p.select(*(F.col(c).cast("long") if c in p.columns else F.lit(None).cast("long").alias(c) for c in names))
        rows = filled if rows is None else rows.unionAll(filled)
    return rows.agg(*(F.max(c).alias(c) for c in names))


def _row_matches(source: DataFrame, target: DataFrame, ref: Reference) -> DataFrame:
    """Eligible, selected source rows with the multiplicity of their key, null where it has no target.

    Keys are written first: then few ones are broadcast, by their size, and many
    meet the rows in a join whose hot keys can be split.
    """
    usable, scoped = ref.usable()
    rows = ref.source_rows(source).where(F.col("selected") & usable & scoped)
    keys = ref.target_keys(target) if ref.direct else ref.matched(rows.select("ref", *ref.scopes).distinct(), target).where("multiplicity IS NOT NULL")
    return rows.join(materialise(keys), ["ref", *ref.scopes], "left")


def links(source: DataFrame, target: DataFrame, ref: Reference) -> DataFrame:
    """(source_row, target_row) of selected rows with exactly one target."""
    return _row_matches(source, target, ref).where("multiplicity = 1").select(F.col("row").alias("source_row"), "target_row")


def counterexamples(source: DataFrame, target: DataFrame, ref: Reference, n: int = 5) -> DataFrame:
    """The first n selected, eligible rows with no target or more than one."""
    reason = F.when(F.col("multiplicity").isNull(), "missing_in_input").otherwise("ambiguous_target")
    bad = _row_matches(source, target, ref).where("multiplicity IS NULL OR multiplicity > 1")
    return bad.select(F.col("row").alias("row_number"), reason.alias("reason")).orderBy("row_number").limit(n)


def included(source: DataFrame, target: DataFrame, source_field: str, target_field: str) -> DataFrame:
    """Distinct source values that stand in the target (a semi join)."""
    values = lambda df, c: df.select(F.col(f"`{c}`").cast("string").alias("value")).where(join_usable(F.col("value"))).distinct()
    return values(source, source_field).join(values(target, target_field), "value", "left_semi")


def dangling(source: DataFrame, target: DataFrame, source_field: str, target_field: str) -> DataFrame:
    """Source rows whose usable value has no target (an anti join)."""
    known = target.select(F.col(f"`{target_field}`").alias("__k")).distinct()  # a hot key is one row before the exchange
    return source.where(join_usable(F.col(f"`{source_field}`").cast("string"))).join(known, F.col(f"`{source_field}`") == F.col("__k"), "left_anti")


def check_many(frames: dict[str, DataFrame], asked: Sequence[tuple[str, str, str, Reference]]) -> DataFrame:
    """``check`` for many direct references at once: a row for each (id, source table, target table, reference).

    Source rows, by reference and by whether they are selected, and target rows of one value
    are counted side by side in one grouping.  References with scopes have another one, by
    value and scopes.  Every table is read once for each of these; equal targets are counted once.
    """
    if any(not ref.direct for *_, ref in asked):
        raise ValueError("references through transforms or paths are checked one by one")
    plain = _counted(frames, asked, False)
    scoped = [a for a in asked if a[-1].scope]
    counts = plain if not scoped else plain.unionAll(_counted(frames, scoped, True))
    zero = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts.columns if c != "id"]
    return counts.groupBy("id").agg(*zero).withColumns(_ratios())


def _counted(frames: dict[str, DataFrame], asked: Sequence[tuple[str, str, str, Reference]], scoped: bool) -> DataFrame:
    """A row of counts for each reference: by values and scopes, or else by values alone, where one with scopes has no counts but those of its whole column."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    array = lambda xs: F.array(*xs).cast("array<string>")
    specs: dict[tuple, int] = {}
    # the target of each reference, by its number, and its place among those that share it
    to = [specs.setdefault((t, ref.target_field, tuple(sorted(ref.scope)) if scoped else ()), len(specs)) for _, _, t, ref in asked]
    places = [to[:n].count(spec) for n, spec in enumerate(to)]
    scopes = ["scopes"] if scoped else []
    each: dict[str, list[Column]] = {}

    def row(t: str, spec: int, place: int, field_: str, chosen: Column, scope: Sequence[str]) -> None:
        by = [array(map(text, scope)).alias(k) for k in scopes]
        each.setdefault(t, []).append(F.struct(F.lit(spec).alias("spec"), F.lit(place).alias("place"), text(field_).alias("ref"), chosen.alias("selected"), *by))

    for (_, s, _, ref), spec, place in zip(asked, to, places):
        row(s, spec, place, ref.source_field, ref.chosen(), [x for _, x in sorted(ref.scope.items())])
    for (t, c, scope), spec in specs.items():
        row(t, spec, -1, c, F.lit(None).cast("boolean"), scope)
    rows = [frames[t].select(F.explode(F.array(*xs)).alias("x")).select("x.*") for t, xs in each.items()]
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionAll(parts[1]), *parts[2:]])
    whole = F.forall("scopes", lambda x: F.coalesce(F.trim(x) != "", F.lit(False))) if scoped else F.lit(True)
    usable = join_usable(F.col("ref"))
    # source and target rows of one value are counted side by side, so nothing is joined
    number = {"yes": F.col("selected"), "no": ~F.col("selected"), "unknown": F.col("selected").isNull()}
    side = [F.count_if((F.col("place") == p) & x).alias(f"{k}_{p}") for p in range(max(places) + 1) for k, x in number.items()]
    met = union(rows).where((F.col("place") >= 0) | (usable & whole)).groupBy("spec", "ref", *scopes).agg(F.count_if(F.col("place") == -1).alias("m"), *side)
    sides = [F.struct(F.lit(p).alias("place"), *(F.col(f"{k}_{p}").alias(k) for k in number)) for p in range(max(places) + 1)]
    sides.append(F.struct(F.lit(-1).alias("place"), *(F.lit(0).cast("long").alias(k) for k in number)))
    # values alike in all that a test asks are added up first, so that tests, which are long, run on a few rows
    alike = F.when(F.col("ref") == "", "").when(F.col("ref").isNotNull(), "some").alias("ref")
    kinds = met.select("spec", alike, usable.alias("usable"), whole.alias("whole"), "m", F.explode(F.array(*sides)).alias("x")).select("spec", "ref", "usable", "whole", "m", "x.*")
    kinds = kinds.where((F.col("yes") + F.col("no") + F.col("unknown") > 0) | ((F.col("place") == -1) & (F.col("m") > 0))).withColumn("multiplicity", F.when(F.col("m") > 0, F.least("m", F.lit(2))))
    kinds = kinds.groupBy("spec", "place", "ref", "usable", "whole", "multiplicity").agg(*(F.sum(k).alias(k) for k in number), F.count_if(F.col("yes") > 0).alias("some"), F.count("*").alias("values"), F.sum("m").alias("targets"), F.max("m").alias("most"))
    kinds = materialise(kinds)  # a few rows a reference
    # what a count adds up where its test holds, the rows being taken as selected, not selected, or neither
    total = {}
    for k, chosen in (("yes", F.lit(True)), ("no", F.lit(False)), ("unknown", F.lit(None).cast("boolean"))):
        for c, test in _tests(F.col("usable"), F.col("whole"), chosen).items():
            # a key is one, however its rows are selected
            size = (F.col("some") if k == "yes" else F.lit(0)) if c.startswith("distinct") else F.col(k)
            total[c] = total.get(c, F.lit(0)) + F.when(test, size).otherwise(0)
    inside = F.col("usable") & F.coalesce(F.col("multiplicity") > 0, F.lit(False))
    of_values = {"distinct_source_values": F.col("usable"), "distinct_source_values_in_target": inside}
    counts = kinds.where("place >= 0").groupBy("spec", "place").agg(*(F.sum(x).alias(c) for c, x in total.items()), *(F.sum(F.when(x, F.col("values")).otherwise(0)).alias(c) for c, x in of_values.items()))
    several = F.sum(F.when(F.col("multiplicity") > 1, F.col("values")).otherwise(0))
    stats = kinds.where("place = -1").groupBy("spec").agg(F.sum("targets").alias("target_rows_with_complete_key"), F.sum("values").alias("target_distinct_keys"), several.alias("target_duplicate_key_groups"), F.max("most").alias("target_max_multiplicity"))
    # one with scopes has its whole column from the counts by values, and all else from those by scopes
    told = [F.struct(F.lit(i).alias("id"), F.lit(spec).alias("spec"), F.lit(place).alias("place"), F.lit(scoped or not ref.scope).alias("own")) for (i, *_, ref), spec, place in zip(asked, to, places)]
    known = frames[asked[0][1]].sparkSession.range(1).select(F.inline(F.array(*told)))
    out = known.join(counts, ["spec", "place"]).join(stats, "spec", "left")
    names = [*total, *of_values, *(c for c in stats.columns if c != "spec")]
    return out.select("id", *((F.lit(None).cast("long") if scoped else F.col(c)).alias(c) if c in of_values else F.when(F.col("own"), F.col(c)).alias(c) for c in names))
