import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ravelin import cli
from ravelin.operators import packets
from ravelin.operators.reference import Reference, check, links
from ravelin.plans import budgets, discovery, gates, roles
from ravelin.sources import catalog, demo, external, sinks, snapshot
from ravelin.streaming import checks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("demo") / "d"
    demo.write(str(root))
    return root


@pytest.fixture(scope="module")
def snap(spark, folder):
    return snapshot.from_files(spark, str(folder))


def test_import_keeps_values_and_order(snap):
    got = [tuple(r) for r in snap.frames["harbour.calls"].orderBy("__row").select("__row", "call_id", "stage", "berth").collect()]
    assert got[5] == (6, "6", None, "1") and got[6] == (7, "7", "moored", "") and [r[0] for r in got] == list(range(1, 11))
    assert snap.tables["harbour.calls"].pk == ["call_id"] and len(snap.files) == 2


def test_the_known_links_are_found(snap):
    ref = Reference("berth", "berth_no", {"stage": "moored"}, {"port": "port"})
    found = links(snap.frames["harbour.calls"], snap.frames["harbour.berths"], ref)
    assert sorted(map(tuple, found.collect())) == demo.LINKS
    c = check(snap.frames["harbour.calls"], snap.frames["harbour.berths"], ref).first()
    assert (c["selector_unknown"], c["ambiguous_matches"], c["missing_in_input"], c["empty_references"]) == (1, 1, 1, 1)


def test_the_formula_demo_binds_as_known(spark, tmp_path):
    from ravelin.operators import types

    demo.write(str(tmp_path / "d"), scenario="formula")
    frames = snapshot.from_files(spark, str(tmp_path / "d")).frames
    names = frames["harbour.terms"].select(F.concat(F.lit("t"), "term_id").alias("id"), "name")
    bound = types.bind_formulas(frames["harbour.dues"].select("due_id", F.col("rule").alias("formula")).withColumnRenamed("due_id", "id"), names)
    assert sorted((r["id"], r["symbol"], r["target_id"] and r["target_id"][1:]) for r in bound.collect()) == sorted(demo.BINDINGS)


def test_numbers_that_coincide_mean_nothing(spark, tmp_path):
    demo.write(str(tmp_path / "d"), scenario="unrelated")
    found = discovery.discover(snapshot.from_files(spark, str(tmp_path / "d")))
    assert all(r["meaning"] == "unresolved" for r in found["rules"])
    with pytest.raises(ValueError):
        demo.tables("other", 1)


def test_snapshot_id_follows_contents(spark, snap, folder, tmp_path):
    assert snapshot.from_files(spark, str(folder)).id == snap.id
    demo.write(str(tmp_path / "other"), 11)
    assert snapshot.from_files(spark, str(tmp_path / "other")).id != snap.id


def test_quoted_cells_and_newlines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿a,b\r\n"x\n,y",""\r\n 001 ,\r\n"say ""hi""",z\r\n', encoding="utf-8")
    assert [tuple(r) for r in snapshot.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("x\n,y", ""), (" 001 ", None), ('say "hi"', "z")]


def test_import_is_strict(spark, tmp_path):
    with pytest.raises(ValueError, match="duplicate"):
        snapshot.load_yaml("a: 1\na: 2\n")
    demo.write(str(tmp_path / "d"))
    with pytest.raises(ValueError, match="do not exist"):
        snapshot.from_files(spark, str(tmp_path / "d"), ["harbour.calls.nope"])
    (tmp_path / "d/data/berths.csv").write_text("berth_no,label\n")
    with pytest.raises(ValueError, match="header"):
        snapshot.from_files(spark, str(tmp_path / "d"))


def test_record_ids_tell_equal_keys_apart(spark):
    df = spark.createDataFrame([(1, "k"), (2, "k"), (3, None)], "__row long, a string")
    ids = [r[0] for r in df.select(snapshot.record_id("t", ["a"], "s")).collect()]
    assert len(set(ids)) == 3 and all(i.startswith("t:") and len(i) == 26 for i in ids)


def test_discovery_end_to_end(spark, tmp_path):
    demo.write(str(tmp_path / "d"), 40)
    keys = {"foreign_keys": [{"table_schema": "harbour", "table_name": "calls", "column_name": "berth", "referenced_schema": "harbour", "referenced_table": "berths", "referenced_column": "berth_no"}]}
    (tmp_path / "d/schema/foreign_keys/calls.yaml").write_text(json.dumps(keys))
    found = discovery.discover(snapshot.from_files(spark, str(tmp_path / "d")))
    rule = next(r for r in found["rules"] if (r["source"], r["target"]) == (("harbour.calls", "berth"), ("harbour.berths", "berth_no")))
    assert {"declared_fk", "value_overlap"} <= set(rule["channels"]) and rule["meaning"] == "unresolved"
    assert rule["status"] == "observed_subset" and found["status"] == "complete" and found["coverage"]["queued_by_budget"] == 0
    few = discovery.discover(snapshot.from_files(spark, str(tmp_path / "d")), budget=1)
    assert few["status"] == "partial" and few["rules"][0]["channels"][0] == "declared_fk"


def test_discovery_finds_selector_and_scope_by_itself(snap):
    found = discovery.discover(snap)
    mine = [r for r in found["rules"] if (r["source"], r["target"]) == (("harbour.calls", "berth"), ("harbour.berths", "berth_no"))]
    assert {(tuple(r["selector"].items()), tuple(r["scope"].items())) for r in mine} >= {((), ()), ((), (("port", "port"),)), ((("stage", "moored"),), ()), ((("stage", "moored"),), (("port", "port"),))}
    best = next(r for r in mine if r["selector"] and r["scope"])
    assert {"branch", "scope", "value_overlap"} <= set(best["channels"]) and best["checks"]["unique_matches"] == len(demo.LINKS)
    assert found["purposes"].keys() == snap.tables.keys()


def test_discovery_looks_into_json_and_aliases(spark):
    docs = [(i, json.dumps({"to": {"plant": f"p{i % 3}"}, "n": i}), "x") for i in range(1, 9)]
    plants = [(1, "p0", "Rose", "rosa; dog-rose"), (2, "p1", "Oak", "quercus"), (3, "p2", "Elm", "ulmus")]
    sales = [(1, "ROSA"), (2, "oak tree"), (3, "Quercus")]
    frames = {"notes": spark.createDataFrame(docs, "__row long, body string, kind string"), "plants": spark.createDataFrame(plants, "__row long, code string, name string, aliases string"), "sales": spark.createDataFrame(sales, "__row long, item_name string")}
    tables = {t: roles.Table(t, [roles.Column(c) for c in f.columns if c != "__row"]) for t, f in frames.items()}
    found = discovery.discover(snapshot.Snapshot("s", frames, tables, {}))
    rules = {(r["source"], r["target"], r["path"], r["transform"]): r for r in found["rules"]}
    assert rules[("notes", "body"), ("plants", "code"), ("to", "plant"), "identity"]["status"] == "checked_technical"
    assert rules[("sales", "item_name"), ("plants", "aliases"), (), "target_alias_items"]["checks"]["unique_matches"] == 2


def test_coincident_numbers_stay_unresolved(spark):
    frames = {t: spark.createDataFrame([(i, str(i)) for i in range(1, 4)], "__row long, code string") for t in ("left", "right")}
    s = snapshot.Snapshot("s", frames, {t: roles.Table(t, [roles.Column("code", "text")]) for t in frames}, {})
    found = discovery.propose(s, discovery.profiled(s))
    assert all(c.numeric_only for c in found.candidates) and {r["meaning"] for r in discovery.rules(s, found)[0]} == {"unresolved"}
    assert discovery.run_status({"checked": 2}, 2) == "failed"


def test_a_failing_check_is_kept(spark):
    frames = {"a": spark.createDataFrame([(1, "x")], "__row long, id string"), "b": spark.createDataFrame([(1, "x")], "__row long, id string")}
    s = snapshot.Snapshot("s", frames, {t: roles.Table(t, [roles.Column("id")]) for t in frames}, {})
    bad = discovery.Candidate(("a", "gone"), ("b", "id"), ("metadata",))
    out, coverage = discovery.rules(s, discovery.Found([bad]))
    assert out[0]["status"] == "check_error" and coverage["status"] == {"check_error": 1}


def test_roles():
    t = roles.Table("s.sales_fact", [roles.Column("id"), roles.Column("fruit_code", "text"), roles.Column("period", "text"), roles.Column("profit_amount", "numeric(18,2)"), roles.Column("created_at", "timestamp"), roles.Column("api_key"), roles.Column("note", usable=0, rows=5)], ["id"])
    got = {c.name: roles.column_role(c, t)[0] for c in t.columns}
    assert got == {"id": "technical_identifier", "fruit_code": "technical_identifier", "period": "unknown", "profit_amount": "unknown", "created_at": "audit_time", "api_key": "sensitive", "note": "empty"}
    assert roles.row_purpose(t)[0] == "business_fact"
    d = roles.Table("metric", [roles.Column("metric_code"), roles.Column("metric_name"), roles.Column("definition"), roles.Column("formula_type"), roles.Column("synonym_text")])
    assert roles.row_purpose(d)[0] == "definition_data" and roles.field_roles(d) == {"reference": ["metric_code"], "name": ["metric_name"], "description": ["definition"], "scope": ["formula_type"], "alias": ["synonym_text"]}
    assert roles.row_purpose(roles.Table("x", [roles.Column("payload")]))[0] == "unresolved"
    assert roles.row_purpose(roles.Table("combo_rule", [roles.Column("main_code"), roles.Column("sub_code")]))[0] == "configuration_data"
    assert [roles.literal_type(x) for x in ("bigint", "numeric(3,1)", "timestamp", "date", "bool", "text")] == ["integer", "decimal", "datetime", "date", "boolean", "string"]
    assert roles.candidate_grains(t)["declared_primary_key"] == ["id"]


def test_budgets_are_fair():
    items = [("a", "x", k) for k in range(5)] + [("a", "y", 9), ("b", "z", 7)]
    order = budgets.fair_sources(items, lambda i: i[:2], lambda i: (i[2],))
    assert order[:4] == [("a", "x", 0), ("b", "z", 7), ("a", "y", 9), ("a", "x", 1)] and sorted(order) == sorted(items)
    taken, queued = budgets.within_budget(order, 3, lambda i: i[2] == 4, lambda i: i[0], 2, lambda i: i[2] == 3)
    assert {i[2] for i in taken} == {3, 4, 7} and len(taken) + len(queued) == len(items)
    assert budgets.weighted_turns([list(range(6)), "ab", "c"]) == [0, 1, 2, 3, "a", "b", "c", 4, 5]
    assert budgets.seed_shares({"a": 100, "b": 4, "c": 1}, 12) == {"a": 9, "b": 2, "c": 1}
    assert budgets.fair_branches([(1, "p", "t"), (1, "p", "u"), (1, "q", "t"), (2, "p", "t")], lambda i: i[0], lambda i: i[1], lambda i: i[2]) == [(1, "p", "t"), (2, "p", "t"), (1, "q", "t"), (1, "p", "u")]


def errors(df, key="decision_id"):
    return {r[key]: set(r["errors"]) for r in df.collect()}


def test_concept_gate(spark):
    evidence = spark.createDataFrame([("r1", "name", "Net sales", False), ("r1", "description", "Sales less returns", False), ("r1", "unit", "CNY", False), ("r2", "name", "Net sales", True), ("r3", "unit", "USD", False), ("r3", "name", "x", False)], "record_id string, role string, value string, truncated boolean")
    d = [(1, "Metric", "Net sales (group)", ["r1"], "Sales less returns", {}), (2, "Thing", "Sales", ["r1"], "returns", {"ns": "n"}), (3, "Metric", "Net sales", ["r1", "r2", "r3", "r9"], "Sales less returns", None), (4, "Metric", "Net sales", [], "q", {})]
    got = errors(gates.concepts(spark.createDataFrame(d, "decision_id int, root string, label string, record_ids array<string>, quote string, scope map<string,string>"), evidence))
    assert got[1] == set() and got[2] == {"unknown_root", "label_not_a_source_name", "quote_is_no_whole_field", "scope_value_not_in_records"}
    assert got[3] == {"record_not_in_evidence", "truncated_record", "several_units"} and "no_record" in got[4]


def test_other_gates(spark):
    d = spark.createDataFrame([(1, "net = gross - tax", "gross"), (2, "grossnet - tax", "gross"), (3, "all of it", "all")], "decision_id int, formula string, target_name string")
    assert errors(gates.dependencies(d)) == {1: set(), 2: {"target_is_no_symbol"}, 3: {"formula_not_parsed", "target_is_no_symbol"}}
    d = spark.createDataFrame([(1, "Here Region contains  City.", "region", "contains", "city"), (2, "Region does not contain city", "region", "contain", "city"), (3, "region contains city", "", "contains", "city")], "decision_id int, text string, subject string, cue string, object string")
    got = errors(gates.clauses(d))
    assert got[1] == set() and "negated" in got[2] and "blank_part" in got[3]
    c = [("p", "a", "Metric", "CNY", "r1", "Income from north stores", "north"), ("p", "b", "Metric", "CNY", "r2", "Income from south stores", "south"), ("q", "a", "Measure", "CNY", "r1", "x one", "one"), ("q", "b", "Measure", "USD", "r1", "y two", "three")]
    got = errors(gates.generalisations(spark.createDataFrame(c, "parent_id string, type_id string, root string, unit string, record_id string, text string, term string")), "parent_id")
    assert got["p"] == set() and got["q"] == {"repeated_record", "measures_do_not_generalise", "several_units", "term_not_in_text", "texts_differ"}
    t = spark.createDataFrame([("a", "r1", "Sales, less returns", "n = x-y"), ("b", "r2", "sales less  returns.", "x - y"), ("c", "r2", "other", None)], "id string, record_id string, description string, formula string")
    got = {(r["left"], r["right"]): (set(r["errors"]), r["canonical_id"]) for r in gates.equivalences(spark.createDataFrame([("a", "b"), ("b", "c")], "left string, right string"), t).collect()}
    assert got == {("a", "b"): (set(), "a"), ("b", "c"): ({"descriptions_differ", "formulas_differ", "same_record"}, "b")}


def test_template_and_plan_errors():
    good = {"fields": {"name": "sales of {product}"}, "slots": ["product"]}
    w = [{"name": "sales of a"}, {"name": "sales of b"}]
    assert gates.template_errors(good, w) == [] and gates.template_errors(good, w[:1]) == ["slot_does_not_vary"]
    assert gates.template_errors({"fields": {"name": "{A}{b}"}, "slots": ["b"]}, w)[:2] == ["slot_not_snake_case", "slots_not_as_declared"]
    assert gates.template_errors(good, [*w, {"name": "x"}], frozenset({"name"})) == ["slot_in_protected_field", "witness_does_not_match"]
    r = {"id": "r", "parent": "points_to", "domain": "t", "range": "Term", "source_table": "a", "source_column": "x", "target_table": "b", "target_column": "y", "evidence_ids": ["e"]}
    types = [{"id": "t", "parent": "Metric", "evidence_ids": ["e"]}]
    fields = {"a": {"x"}, "b": {"y"}}
    assert gates.plan_errors(types, [r], fields, {"e"}) == []
    assert len(gates.plan_errors([{"id": "t", "parent": "u", "evidence_ids": []}, {"id": "u", "parent": "t", "evidence_ids": ["e"]}], [r | {"parent": "eats", "target_column": "z", "scope": {"x": "y", "q": "y"}}], fields, {"e"})) == 7
    core = {"types": {"t": 1}}
    assert gates.merge_delta(core, {"types": {"u": 2}}, "a")["types"] == {"t": 1, "u": 2} and core == {"types": {"t": 1}}
    with pytest.raises(ValueError, match="conflict"):
        gates.merge_delta(core, {"types": {"t": 2}}, "a")


def test_sink_and_stages(spark, tmp_path):
    sink = sinks.Sink(spark, str(tmp_path / "items"))
    a = spark.createDataFrame([("1", "old", ["e1"]), ("2", "x", [])], "id string, label string, evidence_ids array<string>")
    sink.put("object", a, 1)
    sink.put("object", a.limit(1).withColumns({"label": F.lit("new"), "evidence_ids": F.array(F.lit("e2"))}), 2)
    sink.put("assertion", a.select("id"), 3)
    assert dict(map(tuple, sink.count().collect())) == {"object": 2, "assertion": 2}
    first = sink.items().where("kind = 'object' AND id = '1'").first()
    assert json.loads(first["body"])["label"] == "old" and first["evidence_ids"] == ["e1", "e2"]
    sink.export(str(tmp_path / "out"), 1)
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    made = []
    stage = lambda contract: sinks.Stages(spark, str(tmp_path / "stages"), contract).run("s", lambda: made.append(1) or spark.range(3))
    assert [stage(c).count() for c in ({"v": 1}, {"v": 1}, {"v": 2})] == [3, 3, 3] and len(made) == 2


def test_external_cards(spark, tmp_path):
    body = {"definitions": [{"entityName": "Café", "description": "a place for coffee", "extendsEntity": "Shop"}, {"other": 1}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.cdm.json").write_bytes(json.dumps(body, ensure_ascii=False).encode("cp1252"))
    (tmp_path / "in/b.cdm.json").write_text("{broken")
    (tmp_path / "in/c.json").write_text("{}")
    cards = external.entity_cards(spark, str(tmp_path / "in"))
    got = {r["label"]: (r["parents"], r["encoding"], r["error"]) for r in cards.collect()}
    assert got == {"Café": (["Shop"], "cp1252", None), None: ([], None, "JSONDecodeError")}
    found = external.search(cards, spark.createDataFrame([(1, "coffee shop")], "query_id long, text string")).collect()
    assert [r["doc_id"].endswith("#Café") for r in found] == [True]


def test_catalog(spark, snap):
    p = catalog.proposals(snap.tables)
    assert len(p) == 4 and catalog.missing_proposals(p, p[:-1]) == [(p[-1]["entityUrn"], p[-1]["aspectName"])]
    assert [catalog.generic_type(t) for t in ("int[]", "BIGINT", "varchar(3)", "timestamptz", "date", "bytea", "boolean")] == ["ArrayType", "NumberType", "StringType", "TimeType", "DateType", "BytesType", "BooleanType"]
    nodes, edges = catalog.graph(spark, snap.tables)
    assert nodes.count() == 10 and edges.count() == 8
    assert sum(len(m["attributes"]) for m in catalog.direct_mapping(snap.tables)) == 8


def test_streaming_checks(spark, sf, tmp_path):
    orders, customer = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/customer.parquet")
    for k in range(3):
        orders.where(F.col("o_orderkey") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ref = Reference("o_custkey", "c_custkey", {"o_orderstatus": "F"}, source_row="o_orderkey", target_row="c_custkey")
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = checks.checked(stream, lambda: customer, ref, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    counts = spark.read.parquet(str(tmp_path / "out"))
    total, whole = checks.totals(counts).first().asDict(), check(orders, customer, ref).first().asDict()
    assert counts.count() == 3 and total["unique_matches"] == whole["unique_matches"] > 0 and total["source_rows"] == whole["source_rows"]
    assert checks.first_seen(spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parque[t]"), "ts", ["user_id"]).isStreaming


def test_command_line(tmp_path, spark, capsys):
    assert cli.main(["make-demo", str(tmp_path / "d"), "--rows", "16"]) == 0
    assert cli.main(["export-catalog", str(tmp_path / "d"), str(tmp_path / "c.json")]) == 0 and len(json.loads((tmp_path / "c.json").read_text())) == 4
    assert cli.main(["discover", str(tmp_path / "d"), "--output", str(tmp_path / "r.json")]) == 0
    assert Counter(r["status"] for r in json.loads((tmp_path / "r.json").read_text())["rules"])


def test_fact_schema_and_classification_gates(spark):
    columns = spark.createDataFrame([("t", "profit", "Profit of fruit, CNY", ["fruit"]), ("t", "kind", "category of the fruit", []), ("t", "v", "version category", [])], "table string, column string, declaration string, constants array<string>")
    d = [(1, "t", "profit", "fruit", "profit", "CNY", "Profit of fruit, CNY", ["fruit"]), (2, "t", "profit", "profit", "Profit", "", "Profit", ["north"]), (3, "t", "nope", "a", "b", "c", "d", [])]
    got = errors(gates.fact_schemas(spark.createDataFrame(d, "decision_id int, table string, column string, object string, quantity string, unit string, quote string, identity array<string>"), columns))
    assert got[1] == set() and got[2] == {"quote_is_no_declaration", "object_is_the_quantity", "unit_not_said", "identity_not_constant"} and "column_unknown" in got[3]
    kinds = gates.classification_columns(columns.withColumnRenamed("declaration", "comment"))
    assert [r["column"] for r in kinds.where("classifies").collect()] == ["kind"]
    assert gates.relation_id("has", "a", "b") != gates.relation_id("has", "b", "a")
    with pytest.raises(ValueError):
        gates.relation_id("eats", "a", "b")


def test_packets(spark):
    items = spark.createDataFrame([("k", 1, "x" * 10), ("k", 2, "y"), ("k", 3, "z" * 50), ("big", 1, "q" * 100)], "key string, rank int, body string")
    found = packets.packets(items, "key", "rank", 70, ["body"])
    assert [(r["key"], [i["rank"] for i in r["items"]], r["n_omitted"]) for r in found.collect()] == [("k", [1, 2], 1)]
    again = packets.packets(items.unionAll(items.where("key = 'k'").withColumn("key", F.lit("a"))), "key", "rank", 70, ["body"])
    assert [(r["key"], r["sources"]) for r in packets.distinct_packets(again, "key").collect()] == [("a", ["a", "k"])]
    rows = spark.createDataFrame([("r1", 1), ("r2", 2)], "record_id string, row long")
    assert {tuple(r) for r in packets.located(spark.createDataFrame([("r1",), ("r9",)], "record_id string"), rows).collect()} == {("r1", 1), ("r9", None)}


def test_proposals_from_elsewhere_are_checked_too(snap):
    c = discovery.Candidate(("harbour.calls", "berth"), ("harbour.berths", "berth_no"), (), (("stage", "moored"),), (("port", "port"),))
    t = discovery.Candidate(("harbour.calls", "remark"), ("harbour.berths", "label"), (), transform="both_alias_items")
    out, coverage = discovery.rules(snap, discovery.Found([]), proposed=[c, c, t])
    assert len(out) == coverage["checked"] == 2 and {r["channels"] for r in out} == {("proposed",)}
    got = {r["transform"]: r["checks"]["unique_matches"] for r in out}
    assert got == {"identity": 4, "both_alias_items": 0}


def test_fact_candidates_say_how_they_were_found(spark):
    from ravelin.operators import facts

    df = spark.createDataFrame([(i, str(i % 3), str(i), "7") for i in range(30)], "__row long, k string, v string, w string")
    found, report = facts.fact_candidates(df, ["k"], ["v", "w"], 5, most=10)
    assert {k: r["method"] for k, r in report.items()} == {"v": "seeded", "w": "exact"}
    assert Counter(r["value_column"] for r in found.collect()) == {"v": 3, "w": 2}


def test_sensitive_columns_and_roles_by_comment():
    hidden = ["email", "contactPhone", "mobile", "id_card", "db_dsn", "access_key", "auth_header", "user_password"]
    shown = ["title", "mailbox_count", "key", "card"]
    assert all(roles.sensitive(roles.Column(c)) for c in hidden) and not any(roles.sensitive(roles.Column(c)) for c in shown)
    assert roles.sensitive(roles.Column("c1", comment="用户手机号")) and not roles.sensitive(roles.Column("c1", comment="用户名称"))
    t = roles.Table("t", [roles.Column("c1", comment="指标名称"), roles.Column("c2", comment="指标的定义"), roles.Column("c3", comment="关联指标"), roles.Column("amount", "decimal"), roles.Column("title", comment="计算公式"), roles.Column("day", "date"), roles.Column("email"), roles.Column("x")])
    assert roles.context_roles(t) == {"c1": "name", "c2": "description", "c3": "reference", "amount": "quantity", "title": "name", "day": "time", "x": "unknown"}
    assert roles.role_conflicts(t) == {"title": ("name", "formula")} and roles.row_purpose(t)[0] == "definition_data"


def test_parquet_snapshots_keep_numbers_and_follow_contents(spark, tmp_path):
    rows = [(1, 1.239, [1, None]), (2, 0.001, None), (3, None, [])]
    ids = []
    for name, data in (("a", rows), ("b", rows[::-1]), ("c", [(1, 1.24, [1, None]), *rows[1:]])):
        spark.createDataFrame(data, "k long, x double, l array<int>").write.parquet(str(tmp_path / name / "t.parquet"))
        ids.append(snapshot.from_parquet(spark, str(tmp_path / name), {"t": ["k"]}))
    got = [tuple(r) for r in ids[0].frames["t"].orderBy("__row").collect()]
    assert [(r[0], r[1], r[3]) for r in got] == [(1, "1", "[1,null]"), (2, "2", None), (3, "3", "[]")] and [r[2] and float(r[2]) for r in got] == [1.239, 0.001, None]
    assert ids[0].id == ids[1].id != ids[2].id
    assert snapshot.from_parquet(spark, str(tmp_path / "a"), {"t": ["k"]}, places=2).frames["t"].where("k = '1'").first()["x"] == "1.24"


def test_large_files_are_hashed_by_their_splits(spark, tmp_path):
    for name, text in (("a", "x\ny\n" * 500), ("b", "x\ny\n" * 500), ("c", "y\nx\n" * 500)):
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in "abc"]
    small, large = (sorted(snapshot.file_hashes(spark, paths, w).items()) for w in (snapshot.WHOLE, 10))
    for (_, a), (_, b), (_, c) in (small, large):
        assert a == b != c
    assert snapshot.read_csv(spark, paths[0], quoted_newlines=False).count() == 999


def test_no_private_folder_on_a_cluster(monkeypatch):
    from ravelin.sources import rows

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        rows.shared_dir(Session())


def test_a_list_read_up_to_some_bytes_drops_what_is_cut(tmp_path):
    from ravelin.sources.snapshot import sequence_prefix

    path = tmp_path / "x.yaml"
    path.write_text("- a: 1\n  b: 2\n- a: 3\n- a: 4\n")
    assert sequence_prefix(str(path), 9) == ([{"a": 1, "b": 2}, {"a": 3}, {"a": 4}], True)
    assert sequence_prefix(str(path), 2) == ([{"a": 1, "b": 2}, {"a": 3}], False)
    assert sequence_prefix(str(path), 9, 20) == ([{"a": 1, "b": 2}], False) and sequence_prefix(str(path), 9, 3) == ([], False)
    path.write_text("a: 1")
    with pytest.raises(ValueError):
        sequence_prefix(str(path), 9)


def test_a_configuration_says_what_it_does_not_know(tmp_path):
    from ravelin.plans.config import load

    path = tmp_path / "run.yaml"
    path.write_text("folder: data\noutput: out.json\nprofile: declared\n")
    c = load(str(path))
    assert (c.folder, c.output, c.limits) == (str(tmp_path / "data"), str(tmp_path / "out.json"), {"per_source": 0, "looks": 0})
    for bad in ("folder: d\nfolders: e\n", "output: x\n", "folder: d\nprofile: wild\n", "folder: d\nlimits: {looks: -1}\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            load(str(path))


def test_progress_tells_failures_too():
    import io
    import json

    from ravelin.plans.progress import stage

    out = io.StringIO()
    with stage("a", out) as notes:
        notes["rows"] = 3
    with pytest.raises(KeyError), stage("b", out):
        raise KeyError("x")
    said = [json.loads(line) for line in out.getvalue().splitlines()]
    assert [(x["stage"], x["event"]) for x in said] == [("a", "begin"), ("a", "done"), ("b", "begin"), ("b", "failed")] and said[1]["rows"] == 3


def test_seeds_beyond_the_broadcast_bound_are_the_same(spark, monkeypatch):
    from ravelin.operators import facts

    df = spark.createDataFrame([(k, str(k % 4), str(k % 7)) for k in range(60)], "__row int, c string, v string")
    take = lambda: sorted(map(tuple, facts.seeded_tuples(df, ["c"], "v", 9).collect()))
    small = take()
    monkeypatch.setattr(facts, "MOST_SEEDS", 1)
    assert take() == small and len(small) == 9


def test_a_long_list_of_queries_is_refused(spark, monkeypatch):
    from ravelin.operators import retrieval

    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 4)
    with pytest.raises(ValueError):
        retrieval.nearest(vectors, vectors, 2)


def test_a_table_may_refer_to_itself_by_keys(spark):
    from pyspark.sql import functions as F

    from ravelin.plans.discovery import discover
    from ravelin.plans.roles import Column, Table
    from ravelin.sources.snapshot import Snapshot

    df = spark.range(1, 9).select(F.col("id").alias("__row"), F.concat(F.lit("n"), "id").alias("node_key"), F.concat(F.lit("n"), (F.col("id") / 2).cast("int")).alias("above_ref"), F.concat(F.lit("n"), "id").alias("shown"))
    snapshot = Snapshot("s", {"tree": df}, {"tree": Table("tree", [Column("node_key"), Column("above_ref"), Column("shown")])}, {})
    found = {(r["source"][1], r["target"][1]): r["checks"]["unique_matches"] for r in discover(snapshot, looks=0)["rules"]}
    assert found[("above_ref", "node_key")] == 7 and not any("shown" in pair for pair in found)
