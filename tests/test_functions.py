import json

import pytest
from pyspark.sql import functions as F

from ravelin.functions import formulas, lexical, names, templates, text, units, values
from ravelin.functions.conditions import Condition


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "profile", "join", "identity"),
    [(None, False, False, False), ("", False, False, False), ("  ", False, False, False), ("\t\n", False, True, False), (" ", False, True, False), ("　", False, True, False), (" ", True, True, False), ("​", True, True, True), (" x ", True, True, True), ("0", True, True, True)],
)
def test_three_notions_of_blank(spark, value, profile, join, identity):
    v = F.col("v")
    assert (one(spark, values.profile_usable(v), value), one(spark, values.join_usable(v), value), one(spark, values.identity_usable(v), value)) == (profile, join, identity)


def test_full_match_is_not_fooled_by_a_newline(spark):
    assert [one(spark, values.full_match(F.col("v"), values.SHAPES["numeric"]), v) for v in ("12", "12\n", "+1.5", "1.", "１", "-")] == [True, False, True, False, False, False]


@pytest.mark.parametrize(("value", "leaf"), [('{"a": {"b": "x"}}', "x"), ('{"a": {"b": 1}}', None), ('{"a": {"b": true}}', None), ('{"a": {"b": ["x"]}}', None), ('{"a": "x"}', None), ("{bad", None), (None, None), ('{"a": {"b": ""}}', ""), ('{"a": {"b": null}}', None)])
def test_json_leaf_is_a_string_or_nothing(spark, value, leaf):
    assert one(spark, values.json_leaf(F.col("v"), ["a", "b"]), value) == leaf


def test_json_paths_are_checked():
    for path in ([], [""], ["a"] * 17, [1]):
        with pytest.raises(ValueError):
            values.json_leaf(F.lit(""), path)


def evaluate(condition, row):
    """Three-valued logic, read plainly."""
    if condition.op in ("and", "or"):
        found = [evaluate(c, row) for c in condition.children]
        decisive = condition.op == "or"
        return decisive if decisive in found else None if None in found else not decisive
    v = row.get(condition.field)
    if v in (None, ""):
        return None
    if condition.op == "eq":
        return v == condition.value
    if condition.op == "in":
        return v in condition.values
    try:
        return float(condition.values[0]) <= float(v) <= float(condition.values[1]) if v.lower() not in ("nan", "inf") else None
    except ValueError:
        return None


def test_conditions_against_a_plain_reading(spark):
    cells = [None, "", "a", "5", "5.50", "x5", "nan", "-3"]
    rows = [{"p": p, "q": q} for p in cells for q in cells]
    df = spark.createDataFrame([(r["p"], r["q"]) for r in rows], "p string, q string").coalesce(1)
    leaves = [Condition("eq", "p", "a"), Condition("in", "q", values=("5", "a")), Condition("in", "q"), Condition("range", "p", values=("-3", "5.5"))]
    trees = leaves + [Condition(op, children=(a, b)) for op in ("and", "or") for a in leaves for b in leaves] + [Condition("and", children=(Condition("or", children=tuple(leaves)), leaves[0]))]
    found = df.select(*(t.column().alias(f"c{k}") for k, t in enumerate(trees))).collect()
    for row, r in zip(found, rows):
        assert list(row) == [evaluate(t, r) for t in trees], r
    assert trees[-1].fields() == {"p", "q"}


@pytest.mark.parametrize("bad", [dict(op="eq", field="a"), dict(op="and"), dict(op="range", field="a", values=("2", "1")), dict(op="range", field="a", values=("x", "1")), dict(op="range", field="a", values=("0", "inf")), dict(op="in", field="a", value="x"), dict(op="like", field="a", value="x"), dict(op="or", field="a", children=(Condition("eq", "a", "b"),))])
def test_bad_conditions(bad):
    with pytest.raises(ValueError):
        Condition(**bad)


def test_text_keys(spark):
    assert text.fold("  Ａ　Straße\t x ") == "a strasse x"
    assert text.forms("A; b，C、 ;A", True) == ["a", "a; b,c、 ;a", "b", "c"]
    assert text.forms("A;b", False) == ["a;b"] and text.forms(" ", True) == []
    assert text.search_terms("水果销售 abc_1 甲") == sorted(["水果", "果销", "销售", "水果销", "果销售", "abc_1", "甲"])
    assert text.name_cues("Net Sales") == ["=net sales", "wnet", "wsales"]
    assert one(spark, text.folded_items(F.col("v")), None) is None


def test_identifiers():
    assert names.tokens("custKey_ID2") == ("cust", "key", "id", "2")
    assert names.stem("customer_id") == "customer" == names.stem("customerCode")
    assert names.refers(("orders", "customer_id"), ("customers", "id"))
    assert names.refers(("a.orders", "customer_id"), ("a.visits", "customer_code"))
    assert names.refers(("a", "ref"), ("b.catalog", "code"), "points to catalog.code")
    assert not names.refers(("a", "ref"), ("b.catalog", "code"), "points to mycatalog.codes")
    assert not names.refers(("a", "name"), ("b", "name")) and not names.refers(("a", "id"), ("a", "id"))


def test_formulas():
    text = "利润 = (X − Y) / X * 5%"
    p = formulas.parse(text)
    assert p["status"] == "parsed" and p["assignment"] == "利润"
    assert [(s["symbol"], s["path"], s["role"]) for s in p["symbols"]] == [("X", "/0/0/0", "minuend"), ("Y", "/0/0/1", "subtrahend"), ("X", "/0/1", "denominator")]
    assert [text.encode()[s["start"] : s["end"]].decode() for s in p["symbols"]] == ["X", "Y", "X"]
    tree = lambda x: json.loads(formulas.parse(x)["tree"])
    n = lambda x: {"number": x}
    op = lambda name, *of: {"op": name, "of": list(of)}
    assert tree("5%") == tree("5 / 100") == op("over", n(5), n(100)) and tree("5 % 3") == op("modulo", n(5), n(3))
    assert tree("1 - 2 - 3") == op("minus", op("minus", n(1), n(2)), n(3)) and tree("2 ^ 3 ** 2") == op("power", n(2), op("power", n(3), n(2)))
    assert tree("-2 ^ 2 * 3") == op("times", op("negated", op("power", n(2), n(2))), n(3)) and tree("2^-1") == op("power", n(2), op("negated", n(1)))
    assert tree("avg(1, .5e1)") == tree("MEAN(1, 5.0)") == {"call": "mean", "of": [n(1), n(5.0)]} and tree("count(1)")["call"] == "count"
    assert formulas.parse("a=X-Y")["signature"] == formulas.parse("b = X  -  (Y)")["signature"] != formulas.parse("Y-X")["signature"]
    bad = {"": "empty", None: "empty", " ": "empty", "a==b": "comparison", "a=b=c": "comparison", "=b": "name_missing", "X + mystery(Y)": "unknown_function", "sum of all": "operand_unexpected", "__import__('os')": "unknown_character", "a[0]": "unknown_character", "x" * 40_000: "too_long", "+".join(["a"] * 2000): "too_many_parts", "sum()": "operand_missing", "(a": "bracket_left_open", "a +": "operand_missing", "(" * 500 + "a": "nested_too_deep", "5x": "unknown_character", "a)": "operand_unexpected"}
    assert {x: formulas.parse(x)["reason"] for x in bad} == bad


def test_templates():
    assert templates.match_text("sales of {a} in {b}", "sales of x.* in y", {}) == {"a": "x.*", "b": "y"}
    assert templates.match_text("{a}-{a}", "q-q", {}) == {"a": "q"} and templates.match_text("{a}-{a}", "q-r", {}) is None
    assert templates.match_text("{a}!", "x" * 257 + "!", {}) is None and templates.match_text("a.b", "axb", {}) is None
    with pytest.raises(templates.Ambiguous):
        templates.match_record({"t": "{a}{b}"}, {"t": "xy"})
    assert templates.match_record({"t": "{a}{b}", "u": "is {a}"}, {"t": "xy", "u": "is x"}) == {"a": "x", "b": "y"}
    assert templates.match_record({"t": "{a}"}, {"t": None}) is None
    assert templates.match_text("{a} of {b} of {c}", "x of y of z of w", {}) == {"a": "x", "b": "y", "c": "z of w"}
    assert templates.match_text("{a}x{a}", "axxab", {}) is None and templates.match_text("{a}x{a}", "axxax", {}) == {"a": "ax"} and templates.match_text("{a}x{a}", "axxax" + "x" + "axxax", {}) == {"a": "axxax"}
    assert templates.match_text("no slot", "no slot", {"k": "v"}) == {"k": "v"} and templates.match_text("{a}", "", {}) is None and templates.match_text("{k}{a}", "vw", {"k": "v"}) == {"k": "v", "a": "w"}
    assert templates.match_text("{A} {a}", "{A} b", {}) == {"a": "b"} and templates.match_text("{a}{a}b", "ccb", {}) == {"a": "c"}


def test_bindings_need_one_type(spark):
    rows = spark.createDataFrame([(1, "sales of x", "k"), (2, "other", "k"), (3, "sales of y", "z"), (4, None, None)], "id int, t string, kind string")
    a = {"template_id": "a", "type_id": "T", "rank": 2, "fields": {"t": "sales of {p}"}}
    b = {"template_id": "b", "type_id": "T", "rank": 1, "fields": {"t": "sales {q}"}, "invariants": {"kind": "k"}}
    found = {r["id"]: (r["template_id"], r["slots"]) for r in templates.bind(rows, [a, b]).collect()}
    assert found == {1: ("b", {"q": "of x"}), 3: ("a", {"p": "y"})}
    assert {r["id"] for r in templates.bind(rows, [a, b | {"type_id": "U"}]).collect()} == {3}


def test_units_and_lexical():
    assert [units.unit(x) for x in ("千瓦时", "千瓦·时", "kW·h", "kWh", "m²", "平方米", "square metres", "元/千瓦时", "tons", "毫米", "N·m", "m·s^-1", "kg per m3", "M W", "℃", "摄氏度", "吨每天", " ")] == ["kWh", "kWh", "kWh", "kWh", "m2", "m2", "m2", "CNY/kWh", "t", "mm", "N·m", "m·s-1", "kg/m3", "MW", "°C", "°C", "t/d", ""]
    assert units.unit("公斤 / 立方米") == "kg/m3" and units.unit("MW") != units.unit("mW") and units.unit(None) == ""
    assert lexical.is_member('["A b", "c"]', "a  B") and lexical.is_member("x; Foo，y", "foo")
    assert not lexical.is_member("not foo; x", "foo") and not lexical.is_member("foobar", "foo") and not lexical.is_member("", "")
    assert lexical.class_of("A fee is a kind of income, monthly.") == "income" and lexical.class_of("It is a not thing") is None
    assert [lexical.fragment_kind(x) for x in ("+", "sales", "a + b", "sum of sales", " ", "3")] == ["operator", "operand", "formula", "text", "blank", "operand"]


def test_ranking_does_not_depend_on_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int")
    a = [r["x"] for r in df.orderBy(values.ranked_by(F.col("x"))).collect()]
    assert a == [r["x"] for r in df.orderBy(F.desc("y")).orderBy(values.ranked_by(F.col("x"))).collect()]
    assert one(spark, values.ratio(F.lit(1), F.lit(0)), "x") is None
    assert one(spark, values.decimal_of(F.col("v")), "NaN") is None
