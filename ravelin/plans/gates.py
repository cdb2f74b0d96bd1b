"""Gates: what a decision made elsewhere must prove before it counts.

Decisions are an input table, keyed by the packet of evidence they were made on.
A gate joins them with that evidence and lists every reason against each; a
decision is accepted when the list is empty.  Nothing is repaired or guessed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import parse, symbols_of
from ..functions.templates import Ambiguous, match_record
from ..functions.text import folded

#: The roots that types and relations descend from.
ROOTS = ("GeneralObject", "Measure", "Metric", "Dimension", "Term")
RELATION_ROOTS = ("contains", "depends_on", "related_to", "points_to", "has")
SLOT = re.compile(r"\{([^{}]*)\}")


def judged(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Adds ``errors``, the names of the reasons that hold (an unknown one does), and ``accepted``."""
    errors = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in reasons.items())))
    return rows.withColumn("errors", errors).withColumn("accepted", F.size("errors") == 0)


def plain_label(label: Column) -> Column:
    """A label without one annotation in brackets at its end."""
    return F.trim(F.regexp_replace(label, r"\s*[\(\[（【][^\(\)\[\]（）【】]*[\)\]）】]\s*$", ""))


def concepts(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Decisions (decision_id, root, label, record_ids, quote, scope) on records' fields.

    evidence: (record_id, role, value, truncated).  A concept needs a known root,
    records that are all in evidence and none cut short, a label that is a name or
    alias of one, one unit and one formula at most, a quote that is a whole
    description or formula, and scope values that stand in its records.
    """
    cited = decisions.select("decision_id", F.explode("record_ids").alias("record_id")).distinct()
    fields = cited.join(evidence, "record_id", "left")
    value = lambda *roles: F.collect_set(F.when(F.col("role").isin(*roles), F.col("value")))
    seen = fields.groupBy("decision_id").agg(
        F.count_if(F.col("role").isNull()).alias("unknown_records"), F.count_if("truncated").alias("cut"),
        value("name", "alias").alias("names"), value("unit").alias("units"), value("formula").alias("formulas"),
        value("description", "formula").alias("texts"), value("scope").alias("scopes"),
    )
    scopes = F.map_values(F.coalesce("scope", F.create_map().cast("map<string,string>")))
    return judged(decisions.join(seen, "decision_id", "left"), {
        "unknown_root": ~F.col("root").isin(*ROOTS),
        "no_record": F.size("record_ids") < 1,
        "record_not_in_evidence": F.coalesce("unknown_records", F.lit(0)) > 0,
        "truncated_record": F.coalesce("cut", F.lit(0)) > 0,
        "label_not_a_source_name": ~(F.array_contains("names", F.col("label")) | F.array_contains("names", plain_label(F.col("label")))),
        "several_units": F.size("units") > 1,
        "several_formulas": F.size("formulas") > 1,
        "quote_is_no_whole_field": ~F.array_contains("texts", F.col("quote")),
        "scope_value_not_in_records": F.size(F.array_except(scopes, F.col("scopes"))) > 0,
    }).drop("unknown_records", "cut", "names", "units", "formulas", "texts", "scopes")


def record_relations(decisions: DataFrame, rules: DataFrame, pairs: DataFrame, source_texts: DataFrame, target_texts: DataFrame, snapshot_id: str) -> DataFrame:
    """Decisions (decision_id, rule_id, predicate, source_row, target_row, source_quote, target_quote).

    rules: (rule_id, status, snapshot_id, eligible, uniques, ambiguous, missing, numeric_only,
    declared).  pairs: (rule_id, source_row, target_row), the checked ones.  texts:
    (row, texts), fields outside the key.  The rule must be checked on this
    snapshot with counts that add up, the pair be one of its pairs, both quotes
    stand in their rows, and numbers alone never make a relation.
    """
    linked = pairs.select("rule_id", "source_row", "target_row").distinct().withColumn("paired", F.lit(True))
    source = source_texts.select(F.col("row").alias("source_row"), F.col("texts").alias("source_texts"))
    target = target_texts.select(F.col("row").alias("target_row"), F.col("texts").alias("target_texts"))
    rows = decisions.join(rules, "rule_id", "left").join(linked, ["rule_id", "source_row", "target_row"], "left").join(source, "source_row", "left").join(target, "target_row", "left")
    quoted = lambda quote, texts: (F.col(quote) != "") & F.exists(texts, lambda t: F.contains(t, F.col(quote)))
    return judged(rows, {
        "rule_not_checked": ~F.col("status").isin("checked_technical", "observed_subset"),
        "other_snapshot": F.col("snapshot_id") != snapshot_id,
        "counts_do_not_add_up": F.col("uniques") + F.col("ambiguous") + F.col("missing") != F.col("eligible"),
        "unknown_predicate": ~F.col("predicate").isin(*RELATION_ROOTS),
        "pair_not_checked": F.col("paired").isNull(),
        "source_quote_not_found": ~quoted("source_quote", "source_texts"),
        "target_quote_not_found": ~quoted("target_quote", "target_texts"),
        "numbers_prove_nothing": F.col("numeric_only") & ~F.col("declared"),
    }).select(*decisions.columns, "errors", "accepted")


def dependencies(decisions: DataFrame) -> DataFrame:
    """Decisions (decision_id, formula, target_name): the name is a symbol of the formula, not a part of its text."""
    symbols = F.transform(symbols_of("formula"), lambda s: s)
    rows = decisions.withColumn("symbols", symbols)
    return judged(rows, {"formula_not_parsed": F.col("symbols").isNull(), "target_is_no_symbol": ~F.array_contains("symbols", F.col("target_name"))}).drop("symbols")


def clauses(decisions: DataFrame) -> DataFrame:
    """Decisions (decision_id, text, subject, cue, object): the text has the whole positive clause 'subject cue object'."""
    clause = F.concat(folded("subject"), F.lit(" "), folded("cue"), F.lit(" "), folded("object"))
    text = folded("text")
    negated = F.rlike(text, F.lit(r"(?<!\w)(?:not|never|no|without|cannot|不|非|无|未)(?!\w)"))
    return judged(decisions, {"clause_not_found": ~F.contains(text, clause), "negated": negated, "blank_part": (F.trim("subject") == "") | (F.trim("cue") == "") | (F.trim("object") == "")})


def generalisations(children: DataFrame) -> DataFrame:
    """Children (parent_id, type_id, root, unit, record_id, text, term): a row for each proposed parent.

    Two children and more, of one root other than Measure and one unit, from
    distinct records, whose texts are equal once each loses its own term.
    """
    rest = folded(F.replace("text", F.col("term"), F.lit(" ")))
    rows = children.withColumn("rest", rest).groupBy("parent_id").agg(
        F.count_distinct("type_id").alias("types"), F.count_distinct("record_id").alias("records"), F.count_distinct("term").alias("terms"),
        F.collect_set("root").alias("roots"), F.count_distinct(F.coalesce("unit", F.lit(""))).alias("units"), F.collect_set("rest").alias("rests"),
        F.bool_and(F.contains("text", F.col("term")) & (F.col("term") != "")).alias("said"),
    )
    return judged(rows, {
        "fewer_than_two_children": F.col("types") < 2, "repeated_record": F.col("records") < F.col("types"), "terms_not_distinct": F.col("terms") < F.col("types"),
        "several_roots": F.size("roots") != 1, "measures_do_not_generalise": F.array_contains("roots", "Measure"), "several_units": F.col("units") > 1,
        "term_not_in_text": ~F.col("said"), "texts_differ": F.size("rests") != 1,
    }).select("parent_id", "errors", "accepted")


def equivalences(pairs: DataFrame, types: DataFrame) -> DataFrame:
    """Pairs (left, right) of types (id, record_id, description, formula): equal whole description and formula, different records."""
    left, right = (types.select(*(F.col(c).alias(f"{side}_{c}") for c in types.columns)) for side in ("l", "r"))
    rows = pairs.join(left, F.col("left") == F.col("l_id")).join(right, F.col("right") == F.col("r_id"))
    key = lambda c: F.regexp_replace(folded(F.coalesce(c, F.lit(""))), r"[\s\p{P}]+", "")
    formula = lambda c: F.regexp_replace(F.regexp_replace(folded(F.coalesce(c, F.lit(""))), r"\s+", ""), r"^[\w.]+=(?!=)", "")
    return judged(rows, {
        "descriptions_differ": key(F.col("l_description")) != key(F.col("r_description")), "no_description": key(F.col("l_description")) == "",
        "formulas_differ": formula(F.col("l_formula")) != formula(F.col("r_formula")), "same_record": F.col("l_record_id") == F.col("r_record_id"),
    }).select("left", "right", "errors", "accepted", F.least("left", "right").alias("canonical_id"))


def template_errors(template: dict, witnesses: list[dict[str, str]], protected: frozenset[str] = frozenset()) -> list[str]:
    """What speaks against a template {fields: {column: text with {slots}}, slots: [names], invariants}.

    A template is one small object, checked on the driver with its few witnesses.
    """
    found = [s for text in template["fields"].values() for s in SLOT.findall(text)]
    errors = []
    if any(not re.fullmatch(r"[a-z][a-z0-9_]*", s) for s in found):
        errors.append("slot_not_snake_case")
    if set(found) != set(template["slots"]):
        errors.append("slots_not_as_declared")
    if any(SLOT.search(text) for c, text in template["fields"].items() if c in protected):
        errors.append("slot_in_protected_field")
    bound = []
    for w in witnesses:
        try:
            m = match_record(template["fields"], w) if all(w.get(c) == v for c, v in template.get("invariants", {}).items()) else None
        except Ambiguous:
            errors.append("adjacent_slots")
            break
        if m is None:
            errors.append("witness_does_not_match")
            break
        bound.append(m)
    if not errors and any(len({b[s] for b in bound}) < 2 for s in template["slots"]):
        errors.append("slot_does_not_vary")
    return errors


def plan_errors(types: list[dict], relations: list[dict], fields: dict[str, set[str]], evidence: set[str]) -> list[str]:
    """What is wrong with a plan: unknown roots, cycles, unknown endpoints, fields and evidence, narrowed ranges.

    types: {id, parent, evidence_ids}; relations: {id, parent, domain, range, source_table,
    source_column, target_table, target_column, scope, evidence_ids}.
    """
    errors, parent = [], {t["id"]: t["parent"] for t in types}

    def root(x: str) -> str | None:
        seen = set()
        while x in parent:
            if x in seen:
                return None
            seen.add(x)
            x = parent[x]
        return x if x in ROOTS else None

    def below(x: str, top: str) -> bool:
        while x != top and x in parent:
            x = parent[x]
        return x == top

    if len(parent) < len(types):
        errors.append("type defined twice")
    errors += [f"type {t['id']}: no known root" for t in types if root(t["id"]) is None]
    for r in relations:
        if r["parent"] not in RELATION_ROOTS:
            errors.append(f"relation {r['id']}: unknown root {r['parent']}")
        for side in ("domain", "range"):
            if r[side] not in parent and r[side] not in ROOTS:
                errors.append(f"relation {r['id']}: unknown {side}")
            elif side in (of := r.get("narrows", {})) and not below(r[side], of[side]):
                errors.append(f"relation {r['id']}: {side} is wider than its parent's")
        for t, c in ((r["source_table"], r["source_column"]), (r["target_table"], r["target_column"]), *((r["source_table"], s) for s in r.get("scope", {})), *((r["target_table"], x) for x in r.get("scope", {}).values())):
            if c not in fields.get(t, ()):
                errors.append(f"relation {r['id']}: no field {t}.{c}")
        if len(set(r.get("scope", {}).values())) < len(r.get("scope", {})):
            errors.append(f"relation {r['id']}: target bound twice")
    for item in (*types, *relations):
        if not item.get("evidence_ids") or not set(item["evidence_ids"]) <= evidence:
            errors.append(f"{item['id']}: evidence missing")
    return errors


def merge_delta(core: dict, delta: dict, table: str) -> dict:
    """Core with what a delta adds to one table: nothing is deleted, nothing overwritten, conflicts are errors."""
    errors, out = [], {k: dict(core.get(k, {})) for k in ("types", "relations", "attributes")}
    errors += [f"relation {i} does not start in {table}" for i, r in delta.get("relations", {}).items() if r["source_table"] != table]
    errors += [f"attribute {i} is of another table" for i, a in delta.get("attributes", {}).items() if a["table"] != table]
    for kind, items in out.items():
        for i, item in delta.get(kind, {}).items():
            if i in items and items[i] != item:
                errors.append(f"conflict in {kind}: {i}")
            items[i] = item
    if errors:
        raise ValueError("; ".join(errors))
    return out


def formula_signature(text: str) -> str | None:
    """Equal for formulas of one tree, whatever their spacing and the name they are assigned to."""
    return parse(text)["signature"]


#: What tells a row about a service from one that defines a quantity, and a category from a tenant.
SERVICE = r"https?://|\b(?:GET|POST|PUT|DELETE|PATCH)\b|(?:^|[^\w/])/(?:api|v\d)/|(?i:\b(?:endpoint|interface|service)\b)"
CATEGORY, NO_CATEGORY = r"(?i)\b(?:category|classification|class|kind)\b|类别|分类", r"(?i)\b(?:tenant|version|scope|namespace)\b|租户|版本"


def quantity_subjects(rows: DataFrame, text: str) -> DataFrame:
    """A row about a service (an address with a method, a purpose) does not define a quantity: reason or null."""
    t = F.coalesce(F.col(text), F.lit(""))
    return rows.withColumn("reason", F.when(F.trim(t) == "", "no_definition").when(t.rlike(SERVICE), "service_row"))


def classification_columns(columns: DataFrame) -> DataFrame:
    """Columns (table, column, comment) whose comment says that they classify, and not that they scope."""
    c = F.coalesce(F.col("comment"), F.lit(""))
    return columns.withColumn("classifies", c.rlike(CATEGORY) & ~c.rlike(NO_CATEGORY))


def fact_schemas(decisions: DataFrame, columns: DataFrame) -> DataFrame:
    """Decisions (decision_id, table, column, object, quantity, unit, quote, identity) on value columns.

    columns: (table, column, declaration, constants), constants being the columns'
    values that hold on all rows.  The quote is the whole declaration, object and
    quantity differ and stand in it, every identity clause is constant, the unit is said.
    """
    d = decisions.join(columns, ["table", "column"], "left")
    inside = lambda c: F.contains(F.lower("declaration"), F.lower(c)) & (F.trim(c) != "")
    return judged(d, {
        "column_unknown": F.col("declaration").isNull(), "quote_is_no_declaration": F.col("quote") != F.col("declaration"), "object_is_the_quantity": F.lower("object") == F.lower("quantity"),
        "object_not_declared": ~inside("object"), "quantity_not_declared": ~inside("quantity"), "unit_not_said": F.trim(F.coalesce("unit", F.lit(""))) == "",
        "identity_not_constant": F.size(F.array_except("identity", "constants")) > 0,
    }).select("decision_id", "errors", "accepted")


def relation_id(root: str, source: str, target: str, parameters: dict[str, str] | None = None) -> str:
    """The id of a directed relation: equal for equal root, ends and parameters."""
    import hashlib
    import json

    if root not in RELATION_ROOTS:
        raise ValueError(f"unknown relation root {root!r}")
    return "relation:" + hashlib.sha256(json.dumps([root, source, target, parameters or {}], sort_keys=True).encode()).hexdigest()[:24]


def resolved(exact: DataFrame, matched: DataFrame) -> DataFrame:
    """(record_id, type_id, scope, types, scopes): what a record is, by exact alignments (record_id, type_id, scope)
    where it has any, else by those that templates matched."""
    both = exact.withColumn("tier", F.lit(0)).unionByName(matched.withColumn("tier", F.lit(1)))
    per = both.groupBy("record_id", "tier").agg(F.min("type_id").alias("type_id"), F.min("scope").alias("scope"), F.count_distinct("type_id").alias("types"), F.count_distinct("scope").alias("scopes"))
    best = per.groupBy("record_id").agg(F.min_by(F.struct("type_id", "scope", "types", "scopes"), "tier").alias("r"))
    return best.select("record_id", "r.*")


def business_relations(pairs: DataFrame, types: DataFrame) -> DataFrame:
    """Checked pairs (pair_id, predicate, source_record, target_record) made relations of types, with errors.

    types: what ``resolved`` gives.  Both ends are of one type and one scope, two known scopes agree, and the ends differ.
    """
    end = lambda side: types.select(F.col("record_id").alias(f"{side}_record"), F.col("type_id").alias(f"{side}_type"), F.struct("scope", "types", "scopes").alias(side))
    rows = pairs.join(end("source"), "source_record", "left").join(end("target"), "target_record", "left")
    return judged(rows, {
        "unknown_predicate": ~F.col("predicate").isin(*RELATION_ROOTS),
        "source_has_no_type": F.col("source").isNull(), "target_has_no_type": F.col("target").isNull(),
        "source_has_several_types": F.coalesce("source.types", F.lit(1)) > 1, "target_has_several_types": F.coalesce("target.types", F.lit(1)) > 1,
        "several_scopes": F.greatest(F.coalesce("source.scopes", F.lit(0)), F.coalesce("target.scopes", F.lit(0))) > 1,
        "scopes_differ": F.coalesce(F.col("source.scope") != F.col("target.scope"), F.lit(False)),
        "one_type_at_both_ends": F.coalesce(F.col("source_type") == F.col("target_type"), F.lit(False)),
    }).select("pair_id", "predicate", "source_type", "target_type", "errors", "accepted")


#: What says that a field refers, that it does not, and that something defines.
REFERS = r"(?i)\b(?:refers? to|reference to|references|foreign key|points? to|looks? up)\b|引用|关联|外键|指向"
REFERS_NOT = r"(?i)\b(?:not|no|never|without)\b(?:\s+\w+){0,3}\s+(?:refer|reference|references|foreign key|point)\b|不引用|不关联|非外键|不指向"
DEFINES = r"(?i)\b(?:definitions?|defines?|describes?|glossary|dictionary)\b|定义|释义|说明|口径|术语|字典|词典"


def definition_references(decisions: DataFrame) -> DataFrame:
    """Decisions that a record refers to the definition in another, on what is declared and said of both.

    decisions: (decision_id, rule_status, paired, source_declaration, target_declaration, target_table_declaration,
    source_texts, target_names, target_texts).  The rule is checked and the pair is one of its pairs; the source's
    key, or a text of it that names the target, speaks of a reference and nothing denies it; the target's table or
    a text of the target defines; and the target's key does not itself refer elsewhere.
    """
    d = decisions
    says = lambda c, pattern: F.coalesce(F.col(c), F.lit("")).rlike(pattern)
    names_it = lambda t: t.rlike(REFERS) & ~t.rlike(REFERS_NOT) & F.exists("target_names", lambda n: (F.trim(n) != "") & F.contains(t, n))
    own_text = F.coalesce(F.exists("target_texts", lambda t: t.rlike(DEFINES) & ~t.rlike(REFERS)), F.lit(False))
    denied = says("source_declaration", REFERS_NOT)
    intended = says("source_declaration", REFERS) | F.coalesce(F.exists("source_texts", names_it), F.lit(False))
    table_defines = says("target_table_declaration", DEFINES) & ~says("target_table_declaration", REFERS)
    return judged(d, {
        "rule_not_checked": ~F.col("rule_status").isin("checked_technical", "observed_subset"), "pair_not_checked": ~F.col("paired"),
        "reference_denied": denied, "reference_not_said": ~intended,
        "target_refers_elsewhere": says("target_declaration", REFERS) & ~(table_defines & own_text), "target_defines_nothing": ~(table_defines | own_text),
    }).select("decision_id", "errors", "accepted")
