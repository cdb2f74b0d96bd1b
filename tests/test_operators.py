import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ravelin.functions.conditions import Condition
from ravelin.operators import cards, facts, graphs, instances, profile, recall, reference, relations, retrieval, types
from ravelin.sources import rows as R


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def linked(spark):
    """Records and entries: two linked, one missing, one ambiguous, unknown, empty and blank references."""
    entries = spark.createDataFrame([(1, "A", "n"), (2, "A", "s"), (3, "B", "n"), (4, "D", "n"), (5, "D", "n"), (6, None, "n"), (7, "E", None), (8, " ", "n")], "__row long, code string, ns string")
    records = spark.createDataFrame(
        [(1, "n", "l", "A"), (2, "s", "l", "A"), (3, "n", "u", "B"), (4, "n", "l", "Z"), (5, "n", None, "A"), (6, "n", "l", "D"), (7, "n", "l", ""), (8, "n", "l", "B"), (9, None, "l", "A"), (10, "n", "l", None), (11, "n", "l", "  "), (12, "n", "l", "a")],
        "__row long, ns string, kind string, ref string",
    )
    return records, entries


REF = reference.Reference("ref", "code", {"kind": "l"}, {"ns": "ns"})


def test_reference_check(linked):
    c = reference.check(*linked, REF).first().asDict()
    assert {k: c[k] for k in reference.COUNTS} == {
        "source_rows": 12, "selector_true": 10, "selector_false": 1, "selector_unknown": 1, "null_references": 1, "empty_references": 1, "whitespace_references": 1, "missing_scope": 1,
        "eligible_references": 6, "matched_references": 4, "unique_matches": 3, "ambiguous_matches": 1, "missing_in_input": 2, "outside_eligible_references": 1, "outside_matched_references": 1,
    }
    assert (c["distinct_eligible_keys"], c["distinct_keys_matched"], c["distinct_source_values"], c["distinct_source_values_in_target"]) == (6, 4, 5, 3)
    assert (c["target_rows_with_complete_key"], c["target_distinct_keys"], c["target_duplicate_key_groups"], c["target_max_multiplicity"]) == (5, 4, 1, 2)
    assert c["unique_match_ratio"] == 0.5
    assert rows(reference.links(*linked, REF).orderBy("source_row")) == [(1, 1), (2, 2), (8, 3)]
    assert rows(reference.counterexamples(*linked, REF)) == [(4, "missing_in_input"), (6, "ambiguous_target"), (12, "missing_in_input")]


def test_check_does_not_depend_on_the_order_of_rows(linked, spark):
    shuffled = [df.repartition(5).orderBy(F.rand(k)) for k, df in enumerate(linked)]
    assert reference.check(*shuffled, REF).first() == reference.check(*linked, REF).first()


def test_transformed_identity_equals_the_direct_path(linked):
    """A JSON path makes the token path run; over the same values it must count the same."""
    records, entries = linked
    wrapped = records.withColumn("ref", F.to_json(F.struct(F.col("ref").alias("r"))))
    a, b = reference.check(records, entries, REF).first().asDict(), reference.check(wrapped, entries, reference.Reference("ref", "code", {"kind": "l"}, {"ns": "ns"}, path=("r",))).first().asDict()
    assert {k for k in a if a[k] != b[k]} == set()


def test_alias_tokens_of_one_row_count_once(spark):
    target = spark.createDataFrame([(1, "Net; net ;NET"), (2, "gross,Brutto"), (3, "brutto")], "__row long, names string")
    source = spark.createDataFrame([(1, "ＮＥＴ"), (2, "gross"), (3, "Brutto"), (4, "x"), (5, " ")], "__row long, v string")
    ref = reference.Reference("v", "names", transform="target_alias_items")
    c = reference.check(source, target, ref).first()
    assert (c["unique_matches"], c["ambiguous_matches"], c["missing_in_input"], c["eligible_references"]) == (2, 1, 1, 4)
    assert rows(reference.links(source, target, ref).orderBy("source_row")) == [(1, 1), (2, 2)]
    with pytest.raises(ValueError):
        reference.Reference("v", "names", transform="lower")


def test_nothing_to_divide_by_is_null(spark):
    empty = spark.createDataFrame([], "__row long, a string")
    c = reference.check(empty, empty, reference.Reference("a", "a")).first().asDict()
    assert all(v is None for k, v in c.items() if k.endswith("ratio")) and c["source_rows"] == 0 and c["target_max_multiplicity"] == 0


def test_profile_of_awkward_values(spark):
    cells = [None, "", " ", "　", "007", "+1.5", "{}", " [1]", "é😀", "x" * 65, "123e4567-e89b-12d3-a456-426614174000", "5\n"]
    p = profile.profile(spark.createDataFrame([(c,) for c in cells], "c string")).first().asDict()
    expected = dict(row_count=12, null_count=1, empty_count=1, whitespace_only_count=2, usable_count=8, non_null=11, min_chars_usable=2, max_chars_usable=65, min_bytes_usable=2, max_bytes_usable=65, numeric_shape_count=2, leading_zero_shape_count=1, uuid_shape_count=1, json_start_count=2, short_text_count=7)
    assert {k: p[k] for k in expected} == expected
    many = spark.range(3).select(*(F.lit(str(k)).alias(f"c{k}") for k in range(70)))
    assert profile.profile(many, approximate=False).count() == 70


def test_joint_distinct_skips_blanks(spark):
    df = spark.createDataFrame([("1", "2"), ("1", "2"), ("12", ""), ("1", None), ("", "12")], "a string, b string")
    assert rows(profile.joint_distinct(df, {"ab": ["a", "b"], "a": ["a"]})) == [("ab", 2, 1, 1, 3, False), ("a", 4, 2, 2, 1, False)]


def test_row_numbers_and_lookup(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("id").cast("string")).alias("v"))
    numbered = R.number_rows(df.repartition(7), ["k"])
    assert rows(numbered.select("k", "__row").orderBy("k")) == [(k, k + 1) for k in range(1000)]
    assert sorted(r[0] for r in rows(R.rows_at(numbered, [3, 1, 3]).select("k"))) == [0, 2]
    with pytest.raises(ValueError):
        R.rows_at(numbered, [0])
    assert R.lookup(numbered, ["v"]).count() == 666


def test_shared_values_and_fanout(spark):
    words = spark.createDataFrame([(f, v) for f, vs in {"a": "123x", "b": "12y", "c": "1x", "d": "1"}.items() for v in vs], "field string, value string")
    assert sorted(rows(recall.shared_values(words, 3))) == [("a", "b", 1, True), ("a", "c", 1, False)]
    assert rows(recall.widely_held(words, 3)) == [(1,)]


def test_json_leaves_do_not_enter_lists(spark):
    df = spark.createDataFrame([('{"a": {"b": "x", "c": 1}, "d": "y", "e": ["z"], "f": {"g": {"h": "w"}}}',), ("bad",), (None,)], "j string")
    assert sorted(rows(recall.json_leaves(df, "j"))) == [(["a", "b"], "x"), (["d"], "y"), (["f", "g", "h"], "w")]


def test_alias_pairs(spark):
    v = spark.createDataFrame([("p", "names", "Apple; Pear"), ("q", "label", "APPLE"), ("q", "label", "apple"), ("q", "other", "pear"), ("p", "x", "apple")], "table string, field string, value string")
    found = {(r["left"], r["right"]): (r["shared_keys"], r["collision_keys"]) for r in recall.alias_pairs(v).collect()}
    assert found == {("p.names", "q.label"): (1, 1), ("p.names", "q.other"): (1, 0), ("p.x", "q.label"): (1, 1)}


def test_fact_tuples(spark):
    df = spark.createDataFrame([(1, "a", "r", "5"), (2, "a", "r", "5"), (3, "a", "r", "6"), (4, "b", "r", "7"), (5, "b", None, "7"), (6, "b", "r", " ")], "__row long, f string, g string, v string")
    found = {(r["f"], r["observation_value"]): (r["source_row_count"], r["source_row_min"], r["source_row_max"], r["distinct_value_count"], r["all_observed_tuples"], r["all_complete_rows"]) for r in facts.observed_tuples(df, ["f", "g"], "v").collect()}
    assert found == {("a", "5"): (2, 1, 2, 2, 3, 4), ("a", "6"): (1, 3, 3, 2, 3, 4), ("b", "7"): (1, 4, 4, 1, 3, 4)}
    limited = rows(facts.observed_tuples(df.repartition(3), ["f", "g"], "v", limit=2))
    assert limited == rows(facts.observed_tuples(df, ["f", "g"], "v", limit=2)) and limited[0][-2:] == (3, 4)
    seeded = facts.seeded_tuples(df, ["f", "g"], "v", 10)
    assert {(r["f"], r["observation_value"], r["distinct_value_count"]) for r in seeded.collect()} == {("a", "5", 2), ("a", "6", 2), ("b", "7", 1)}


def test_endpoints(spark):
    pairs = spark.createDataFrame([("x", "n"), ("y", "n"), ("z", "n"), ("", "n"), ("x", None)], "p string, s string")
    target = spark.createDataFrame([(1, "x", "n"), (2, "y", "n"), (3, "y", "n"), (4, "x", "m")], "__row long, k string, t string")
    found = Counter(rows(facts.resolve_endpoint(pairs, "p", target, "k", scope={"t": "s"}).select("p_status", "p_row")))
    assert found == Counter([("accepted", 1), ("ambiguous", None), ("missing", None), ("blank", None), ("missing_scope", None)])


def plan(**more):
    return relations.RelationPlan("p", "points_to", "ref", "code", **more)


def test_relation_outcomes(linked):
    found = relations.outcomes(*linked, plan(selector=Condition("eq", "kind", "l"), scope={"ns": "ns"}))
    got = {r["source_row"]: (r["outcome"], r["target_row"]) for r in found.collect()}
    assert got == {
        1: ("matched", 1), 2: ("matched", 2), 3: ("not_applicable", None), 4: ("missing_target", None), 5: ("condition_unknown", None), 6: ("ambiguous_identity", None), 7: ("empty_reference", None),
        8: ("matched", 3), 9: ("scope_unknown", None), 10: ("empty_reference", None), 11: ("missing_target", None), 12: ("missing_target", None),
    }
    c = relations.coverage(found).first()
    assert (c["examined"], c["selector_true"], c["selector_unknown"], c["matched_records"]) == (12, 10, 1, 3)
    assert relations.assertions(found, plan()).count() == 3


def test_members_and_formulas(spark, linked):
    _, entries = linked
    src = spark.createDataFrame([(1, '["A","B","Q"]'), (2, "[]"), (3, "[1]"), (4, "{}"), (5, '["B"]')], "__row long, ref string")
    found = relations.outcomes(src, entries, plan(mode="members"))
    assert Counter((r["source_row"], r["outcome"]) for r in found.collect()) == Counter([(1, "ambiguous_identity"), (1, "matched"), (1, "missing_target"), (3, "unsupported_value"), (4, "missing_target"), (5, "matched")])
    src = spark.createDataFrame([(1, "B + sum(E) / 5%"), (2, "B + f(B)"), (3, "B - B")], "__row long, ref string")
    found = relations.outcomes(src, entries, plan(mode="formula"))
    assert sorted((r["source_row"], r["item"] if r["outcome"] == "matched" else r["outcome"]) for r in found.collect()) == [(1, "B"), (1, "E"), (2, "unsupported_value"), (3, "B")]
    with pytest.raises(ValueError):
        plan(mode="members", transform="source_alias_items")


def test_too_many_references(spark, linked):
    src = spark.createDataFrame([(1, ",".join("B" * 4))], "__row long, ref string")
    assert rows(relations.outcomes(src, linked[1], plan(mode="members", delimiter=",", most=3)).select("outcome")) == [("unsupported_value",)]


def test_merge_and_integrity(spark):
    items = spark.createDataFrame([("a", "1", "old", ["e2", "e1"], 1), ("a", "1", "new", ["e3"], 2), ("b", "1", "x", [], 1)], "kind string, id string, body string, evidence_ids array<string>, seq int")
    assert sorted(rows(relations.merge_items(items))) == [("a", "1", "old", ["e1", "e2", "e3"]), ("b", "1", "x", [])]
    objects, evidence = spark.createDataFrame([("o",)], "id string"), spark.createDataFrame([("e",)], "id string")
    made = spark.createDataFrame([("1", "o", "o", None, ["e"]), ("2", "x", None, "v", ["f"]), ("3", "o", "y", "v", [])], "id string, subject string, object string, literal string, evidence_ids array<string>")
    assert dict(rows(relations.integrity(objects, made, evidence))) == {"dangling_subject": 1, "dangling_object": 1, "dangling_evidence": 1, "literal_xor_object": 1}


def test_cards_patterns_and_pages(spark):
    made = cards.build_cards(spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "x", ""), (4, "y", "u")], "__row long, name string, unit string"), "t", ["name", "unit"], ["name"], ["unit"])
    assert sorted((r["occurrences"], r["first_row"]) for r in made.collect()) == [(1, 3), (1, 4), (2, 1)]
    p = {r["cards"]: (r["records"], r["reference_variants"]) for r in cards.patterns(made).collect()}
    assert p == {2: (3, 2), 1: (1, 1)}
    many = spark.createDataFrame([(f"p{i:02}", t, "c", i + 1, 1, 1) for t, n in (("a", 7), ("b", 3), ("c", 1)) for i in range(n)], "pattern_id string, table_name string, representative string, cards long, records long, reference_variants long")
    order, before = [], 0
    for page in range(4):
        got = cards.pattern_page(many.repartition(3), 3, page).collect()
        for r in got:
            assert r["cards_before"] == before
            before += r["cards"]
        order += [(r["table_name"], r["pattern_id"]) for r in got]
    assert order == [("a", "p00"), ("b", "p00"), ("c", "p00"), ("a", "p01"), ("b", "p01"), ("a", "p02"), ("b", "p02"), ("a", "p03"), ("a", "p04"), ("a", "p05"), ("a", "p06")]


def test_quotas():
    q = cards.table_quotas({"a": 100, "b": 10, "c": 0, "d": 5}, {"a": 1, "b": 3, "c": 9, "d": 0}, 40)
    assert q == {"a": 30, "b": 10, "c": 0, "d": 0}
    assert cards.table_quotas({"a": 5, "b": 5}, {"a": 1, "b": 2}, 1) == {"a": 0, "b": 1}


def test_bm25_ranks_and_exact_names_come_first(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple apple tart"), (3, "pear"), (4, None), (5, "apple pie")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Apple pie"), (2, "zzz")], "query_id long, text string")
    found = retrieval.bm25(q, docs, 3)
    got = [(r["doc_id"], r["rank"]) for r in found.orderBy("rank").collect()]
    assert got == [(1, 1), (5, 2), (2, 3)]
    han = retrieval.bm25(spark.createDataFrame([(1, "水果")], "query_id long, text string"), spark.createDataFrame([(1, "水果销售"), (2, "果水")], "doc_id long, text string"), 5, native=False)
    assert [r["doc_id"] for r in han.collect()] == [1]
    first = retrieval.exact_first(q.select("query_id", F.lower("text").alias("name")), spark.createDataFrame([(3, "apple pie")], "doc_id long, name string"), found.select("query_id", "doc_id", "score"), 2)
    assert [(r["doc_id"], r["exact"]) for r in first.orderBy("rank").collect()] == [(3, True), (1, False)]


def test_fusion_and_cosine(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id long, doc_id long, rank int")
    assert [r["doc_id"] for r in retrieval.fuse([a, b], 5).orderBy("rank").collect()] == [11, 10]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, [1.0])], "vec_id long, embedding array<float>")
    assert [(r["doc_id"], round(r["score"], 3)) for r in retrieval.nearest(v.where("vec_id = 1"), v, 5).orderBy("rank").collect()] == [(2, 1.0), (4, 0.707)]


def test_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(80)]
    df = spark.createDataFrame(edges, "a long, b long")
    label = {n: n for e in edges for n in e} | {999: 999}
    for _ in range(500):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    nodes = spark.createDataFrame([(n,) for n in label], "node long")
    assert dict(rows(graphs.components(nodes, df))) == label
    assert rows(graphs.isolated(nodes, df)) == [(999,)]
    assert dict(rows(graphs.within(df, spark.createDataFrame([(340,)], "node long"), 6))) == {340 + k: abs(k) for k in range(-6, 7)}
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1), (6, 6)], "a long, b long")
    assert {r[0] for r in rows(graphs.cyclic(loop))} == {1, 2, 3, 6}
    assert graphs.table_order({"a": {"b"}, "b": set(), "c": {"d"}, "d": {"c"}, "e": {"a", "b"}}) == (["b", "a", "e"], ["c", "d"])


def test_type_pairs_and_formulas(spark):
    t = spark.createDataFrame([(3, "x"), (1, "x"), (2, "x"), (9, "y")], "id long, k string")
    assert sorted(rows(types.equivalent_pairs(t, ["k"], chain=False))) == [(1, 2), (1, 3), (2, 3)] and sorted(rows(types.equivalent_pairs(t, ["k"]))) == [(1, 2), (1, 3)]
    assert dict(rows(types.canonical(t, ["k"]))) == {1: 1, 2: 1, 3: 1, 9: 9}
    f = spark.createDataFrame([(1, "b + c"), (2, "a"), (3, "a*2"), (4, "d+nope"), (5, "dup")], "id long, formula string")
    n = spark.createDataFrame([(1, "A"), (2, "B"), (3, "c"), (4, "D"), (6, "dup"), (7, "DUP")], "id long, name string")
    bound = types.bind_formulas(f, n)
    assert {(r["id"], r["symbol"]): r["status"] for r in bound.collect()} == {(1, "b"): "bound", (1, "c"): "bound", (2, "a"): "bound", (3, "a"): "bound", (4, "d"): "self_reference", (4, "nope"): "no_definition", (5, "dup"): "ambiguous_definition"}
    assert dict(rows(types.calculation_status(bound))) == {1: "cyclic_dependency", 2: "cyclic_dependency", 3: "cyclic_dependency", 4: "unresolved_operands", 5: "unresolved_operands"}


def test_memberships_compare_whole_meanings(spark):
    df = spark.createDataFrame([(1, "a", None, "r1"), (2, "a", None, "r2"), (3, "a", "", "r1"), (4, "b", "u", "r1")], "__row long, name string, unit string, ref string")
    made = spark.createDataFrame([("t1", "T", "a", None, "r1"), ("t2", "T", "b", "u", "r1"), ("t3", "U", "b", "u", "r1")], "template_id string, type_id string, name string, unit string, ref string")
    assert sorted(rows(instances.memberships(df, made, ["name", "unit"], ["ref"]))) == [(1, "T", "t1", False), (2, "T", "t1", True)]


def test_facts_are_read_again(spark):
    df = spark.createDataFrame([(1, "a", "5", "x"), (2, "a", "5", "y"), (3, "b", "nan", "x"), (4, "c", "7", "x"), (5, "d", "1", "x"), (6, "d", "2", "x")], "__row long, f string, v string, w string")
    seen = facts.observed_tuples(df, ["f"], "v").withColumn("source_row_max", F.when(F.col("f") == "e", 0).otherwise(F.col("source_row_max")))
    found = {(r["f"], r["observation_value"]): r["reason"] for r in instances.fact_instances(df, seen, ["f"], "v", ["w"], "T").collect()}
    assert found == {("a", "5"): "residual_fields_vary", ("b", "nan"): "non_numeric_value", ("c", "7"): None, ("d", "1"): "ambiguous_coordinates", ("d", "2"): "ambiguous_coordinates"}
    assert set(r["reason"] for r in instances.fact_instances(df.where("__row != 4"), seen, ["f"], "v", [], "T").where("f = 'c'").collect()) == {"rows_changed"}
    assert instances.fact_assertions(instances.fact_instances(df, seen, ["f"], "v", ["w"], "T"), "amount").count() == 1
