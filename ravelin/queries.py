"""The registered queries over the driver tables, each with the SQL it must equal."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.conditions import Condition
from .functions.values import json_leaf
from .functions.lexical import member_of
from .functions.templates import bind
from .functions.units import canonical_unit
from .operators import cards, facts, graphs, instances, packets, profile, recall, reference, relations, retrieval, types
from .plans import gates
from .sources.rows import lookup, materialise, number_rows, rows_at, scratch
from .streaming import checks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def usable_sql(c: str) -> str:
    return f"({c} IS NOT NULL AND {c} <> '' AND trim({c}) <> '')"


# --- profiles ---------------------------------------------------------------


def profile_sql(name: str, columns: dict[str, str]) -> str:
    chars = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"
    parts = []
    for label, expr in columns.items():
        use = f"(c IS NOT NULL AND length(trim(c, {chars})) > 0)"
        parts.append(f"""SELECT '{label}' AS "column", count(*) AS row_count, count(*) FILTER (WHERE c IS NULL) AS null_count, count(*) FILTER (WHERE c = '') AS empty_count,
            count(*) FILTER (WHERE c <> '' AND NOT {use}) AS whitespace_only_count, count(*) FILTER (WHERE {use}) AS usable_count, count(c) AS non_null,
            min(length(c)) FILTER (WHERE {use})::INT AS min_chars_usable, max(length(c)) FILTER (WHERE {use})::INT AS max_chars_usable,
            min(strlen(c)) FILTER (WHERE {use})::INT AS min_bytes_usable, max(strlen(c)) FILTER (WHERE {use})::INT AS max_bytes_usable,
            count(*) FILTER (WHERE {use} AND regexp_full_match(c, '[+-]?[0-9]+(\\.[0-9]+)?')) AS numeric_shape_count,
            count(*) FILTER (WHERE {use} AND regexp_full_match(c, '0[0-9]+')) AS leading_zero_shape_count,
            count(*) FILTER (WHERE {use} AND regexp_full_match(c, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}')) AS uuid_shape_count,
            count(*) FILTER (WHERE {use} AND left(ltrim(c, {chars}), 1) IN ('{{', '[')) AS json_start_count,
            count(*) FILTER (WHERE {use} AND length(c) <= 64) AS short_text_count FROM (SELECT {expr} AS c FROM {name})""")
    return " UNION ALL ".join(parts)


@query(profile_sql("orders", {"o_orderkey": "o_orderkey::VARCHAR", "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "o_orderdate": "o_orderdate::VARCHAR"}))
def profile_orders(spark, d):
    return profile.profile(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"], approximate=False)


@query(profile_sql("events", {"props": "props", "event_type": "event_type"}))
def profile_events_props(spark, d):
    return profile.profile(table(spark, d, "events"), ["props", "event_type"], approximate=False)


@query(profile_sql("documents", {"text": "text", "lang": "lang"}))
def profile_documents(spark, d):
    return profile.profile(table(spark, d, "documents"), ["text", "lang"], approximate=False)


@query()
def approx_distinct_users(spark, d):
    return profile.profile(table(spark, d, "events"), ["user_id", "event_type"]).select("column", "approx_distinct", "approx_distinct_usable")


@query("""SELECT (SELECT list_sort(list(DISTINCT o_orderpriority)) FROM orders WHERE o_orderkey <= 2048)[1:16] AS distinct_sample,
          (SELECT count(*) FROM orders) <= 2048 AND (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderkey <= 2048) <= 16 AS sample_exhaustive""")
def distinct_sample_priority(spark, d):
    return profile.distinct_sample(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


def _joint_sql(name: str, sets: dict[str, tuple[str, ...]]) -> str:
    parts = []
    for label, cs in sets.items():
        use = " AND ".join(f"({c}::VARCHAR IS NOT NULL AND length(trim({c}::VARCHAR)) > 0)" for c in cs)
        parts.append(f"SELECT '{label}' AS label, count(*) FILTER (WHERE {use}) AS complete_rows, count(DISTINCT ({', '.join(f'{c}::VARCHAR' for c in cs)}, 0)) FILTER (WHERE {use}) AS distinct_tuples, count(*) AS n FROM {name}")
    return f"SELECT label, complete_rows, distinct_tuples, complete_rows - distinct_tuples AS duplicate_rows, n - complete_rows AS blank_or_null_rows, complete_rows > 0 AND complete_rows = distinct_tuples AS unique_in_input FROM ({' UNION ALL '.join(parts)})"


_JOINT = {"order_line": ("l_orderkey", "l_linenumber"), "order_part": ("l_orderkey", "l_partkey", "l_suppkey"), "order": ("l_orderkey",)}


@query(_joint_sql("lineitem", _JOINT))
def joint_distinct_lineitem(spark, d):
    return profile.joint_distinct(table(spark, d, "lineitem"), _JOINT)


@query("""SELECT count(*) AS rows, count(*) AS nonblank, count(DISTINCT c) = 1 AS constant, CASE WHEN count(DISTINCT c) = 1 THEN min(c) END AS value
          FROM (SELECT CASE WHEN l_tax >= 0 THEN 'USD' END AS c FROM lineitem)""")
def constant_column(spark, d):
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_tax") >= 0, "USD").alias("currency"))
    return profile.constant_column(rows, "currency")


@query("SELECT l_returnflag AS unit, count(*) AS rows, min(l_orderkey) AS first_row FROM lineitem GROUP BY 1 ORDER BY unit LIMIT 3")
def single_unit(spark, d):
    return profile.single_unit(table(spark, d, "lineitem"), "l_returnflag", "l_orderkey")


@query("SELECT value FROM (SELECT DISTINCT p_name AS value FROM part WHERE trim(p_name) <> '' AND length(p_name) <= 96) ORDER BY md5(value), value LIMIT 129")
def hash_sample(spark, d):
    return profile.hash_sample(table(spark, d, "part"), "p_name", 128, 96)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT 1 + k * ((SELECT count(*) FROM customer) - 1) // 9 FROM range(10) t(k))")
def even_sample(spark, d):
    customer = table(spark, d, "customer")
    return profile.even_sample(customer, customer.count(), 10, "c_custkey").select("c_custkey", "c_name")


# --- rows -------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS __row FROM orders")
def row_numbers(spark, d):
    return number_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("__row").cast("long").alias("__row"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 7, 149)")
def rows_by_position(spark, d):
    return rows_at(table(spark, d, "customer").select("c_custkey", "c_name"), [7, 3, 5, 3, 149], "c_custkey")


@query("SELECT o_custkey, min(o_orderkey) AS first_row, least(count(*), 2)::INT AS matches FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey")
def point_lookup(spark, d):
    return lookup(table(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "first_row", F.col("matches").cast("int").alias("matches"))


# --- reference checks -------------------------------------------------------


def check_sql(source: str, target: str, source_key: str, target_key: str, selector: str = "TRUE", scope: tuple[tuple[str, str], ...] = ()) -> str:
    """scope: (target column, source column) pairs."""
    ks = [f"s{k}" for k in range(len(scope))]
    src = "".join(f", {s}::VARCHAR AS {k}" for k, (_, s) in zip(ks, scope))
    tgt = "".join(f", {t}::VARCHAR AS {k}" for k, (t, _) in zip(ks, scope))
    names = "".join(f", {k}" for k in ks)
    scoped = " AND ".join(usable_sql(k) for k in ks) or "TRUE"
    use = usable_sql("ref")
    on = "s.ref = t.ref" + "".join(f" AND s.{k} = t.{k}" for k in ks)
    f = lambda name, cond: f"count(*) FILTER (WHERE {cond}) AS {name}"
    el = "sel IS TRUE AND u AND su"
    r = lambda name, a, b: f"CASE WHEN {b} <> 0 THEN {a}::DOUBLE / {b}::DOUBLE END AS {name}"
    return f"""
    WITH s AS (SELECT {source_key}::VARCHAR AS ref, ({selector}) AS sel {src} FROM {source}),
    t AS (SELECT ref {names}, count(*) AS m FROM (SELECT {target_key}::VARCHAR AS ref {tgt} FROM {target}) WHERE {use} AND {scoped} GROUP BY ref {names}),
    j AS (SELECT s.*, t.m, coalesce({use.replace('ref', 's.ref')}, FALSE) AS u, coalesce({' AND '.join(usable_sql('s.' + k) for k in ks) or 'TRUE'}, FALSE) AS su FROM s LEFT JOIN t ON {on}),
    a AS (SELECT count(*) AS source_rows, {f('selector_true', 'sel IS TRUE')}, {f('selector_false', 'sel IS FALSE')}, {f('selector_unknown', 'sel IS NULL')},
      {f('null_references', 'sel IS TRUE AND ref IS NULL')}, {f('empty_references', "sel IS TRUE AND ref = ''")}, {f('whitespace_references', "sel IS TRUE AND ref <> '' AND trim(ref) = ''")},
      {f('missing_scope', 'sel IS TRUE AND u AND NOT su')}, {f('eligible_references', el)}, {f('matched_references', el + ' AND m > 0')}, {f('unique_matches', el + ' AND m = 1')},
      {f('ambiguous_matches', el + ' AND m > 1')}, {f('missing_in_input', el + ' AND m IS NULL')}, {f('outside_eligible_references', 'sel IS FALSE AND u AND su')},
      {f('outside_matched_references', 'sel IS FALSE AND u AND su AND m > 0')} FROM j),
    k AS (SELECT count(*) AS distinct_eligible_keys, {f('distinct_keys_matched', 'm > 0')} FROM (SELECT DISTINCT ref {names}, m FROM j WHERE {el})),
    w AS (SELECT count(*) AS distinct_source_values, {f('distinct_source_values_in_target', 'hit')} FROM (SELECT DISTINCT ref, EXISTS (SELECT 1 FROM t WHERE t.ref = s.ref) AS hit FROM s WHERE {use})),
    x AS (SELECT coalesce(sum(m), 0)::BIGINT AS target_rows_with_complete_key, count(*) AS target_distinct_keys, {f('target_duplicate_key_groups', 'm > 1')}, coalesce(max(m), 0) AS target_max_multiplicity FROM t)
    SELECT *, {r('distinct_key_inclusion_ratio', 'distinct_keys_matched', 'distinct_eligible_keys')}, {r('whole_column_distinct_value_inclusion_ratio', 'distinct_source_values_in_target', 'distinct_source_values')},
      {r('reference_hit_ratio', 'matched_references', 'eligible_references')}, {r('unique_match_ratio', 'unique_matches', 'eligible_references')},
      {r('ambiguous_match_ratio', 'ambiguous_matches', 'eligible_references')}, {r('missing_in_input_ratio', 'missing_in_input', 'eligible_references')}
    FROM a, k, w, x"""


@query(check_sql("orders", "customer", "o_custkey", "c_custkey"))
def ref_check_orders_customer(spark, d):
    return reference.check(table(spark, d, "orders"), table(spark, d, "customer"), reference.Reference("o_custkey", "c_custkey", source_row="o_orderkey", target_row="c_custkey"))


@query(check_sql("customer", "orders", "c_custkey", "o_custkey"))
def ref_check_reverse(spark, d):
    return reference.check(table(spark, d, "customer"), table(spark, d, "orders"), reference.Reference("c_custkey", "o_custkey", source_row="c_custkey", target_row="o_orderkey"))


@query(check_sql("orders", "customer", "o_custkey", "c_custkey", "o_orderstatus = 'F'"))
def ref_check_selector(spark, d):
    return reference.check(table(spark, d, "orders"), table(spark, d, "customer"), reference.Reference("o_custkey", "c_custkey", {"o_orderstatus": "F"}, source_row="o_orderkey", target_row="c_custkey"))


@query(check_sql("supplier", "customer", "s_nationkey", "c_nationkey", "NULL::BOOLEAN"))
def ref_check_unknown_selector(spark, d):
    return reference.check(table(spark, d, "supplier"), table(spark, d, "customer"), reference.Reference("s_nationkey", "c_nationkey", {"s_name": None}, source_row="s_suppkey", target_row="c_custkey"))


@query(check_sql("lineitem", "lineitem", "l_orderkey", "l_orderkey", "l_returnflag = 'R'", (("l_linenumber", "l_linenumber"),)))
def ref_check_scoped(spark, d):
    lines = table(spark, d, "lineitem")
    return reference.check(lines, lines, reference.Reference("l_orderkey", "l_orderkey", {"l_returnflag": "R"}, {"l_linenumber": "l_linenumber"}, source_row="l_orderkey", target_row="l_orderkey"))


@query(check_sql("customer", "events", "c_custkey", "user_id"))
def ref_check_ambiguous(spark, d):
    return reference.check(table(spark, d, "customer"), table(spark, d, "events"), reference.Reference("c_custkey", "user_id", source_row="c_custkey", target_row="event_id"))


_MANY = [
    ("a", "orders", "customer", "o_custkey", "c_custkey", {}, {}), ("b", "events", "customer", "user_id", "c_custkey", {"event_type": "click"}, {}), ("c", "lineitem", "part", "l_partkey", "p_partkey", {}, {}),
    ("d", "lineitem", "supplier", "l_suppkey", "s_suppkey", {"l_returnflag": "R"}, {}), ("e", "lineitem", "lineitem", "l_orderkey", "l_orderkey", {}, {"l_linenumber": "l_linenumber"}), ("f", "customer", "orders", "c_custkey", "o_custkey", {}, {}),
]


@query(" UNION ALL ".join(f"SELECT '{i}' AS id, * FROM ({check_sql(s, t, f, g, ' AND '.join(f'{c} = {v!r}' for c, v in sel.items()) or 'TRUE', tuple(scope.items()))})" for i, s, t, f, g, sel, scope in _MANY))
def ref_check_many(spark, d):
    frames = {t: table(spark, d, t) for t in {t for _, *ends, _, _, _, _ in _MANY for t in ends}}
    return reference.check_many(frames, [(i, s, t, reference.Reference(f, g, sel, scope)) for i, s, t, f, g, sel, scope in _MANY])


@query("""SELECT coalesce(sum(m), 0)::BIGINT AS target_rows, count(*) AS target_distinct_keys, count(*) FILTER (WHERE m > 1) AS target_duplicate_key_groups, coalesce(max(m), 0) AS target_max_multiplicity
          FROM (SELECT count(*) AS m FROM events WHERE user_id IS NOT NULL GROUP BY user_id)""")
def ref_target_stats(spark, d):
    keys = reference.Reference("x", "user_id", target_row="event_id").target_keys(table(spark, d, "events"))
    return keys.agg(F.coalesce(F.sum("multiplicity"), F.lit(0)).alias("target_rows"), F.count("*").alias("target_distinct_keys"), F.count_if(F.col("multiplicity") > 1).alias("target_duplicate_key_groups"), F.coalesce(F.max("multiplicity"), F.lit(0)).alias("target_max_multiplicity"))


@query("""SELECT c_custkey AS row_number, CASE WHEN m IS NULL THEN 'missing_in_input' ELSE 'ambiguous_target' END AS reason
          FROM customer LEFT JOIN (SELECT user_id, count(*) AS m FROM events GROUP BY 1) ON c_custkey = user_id WHERE m IS NULL OR m > 1 ORDER BY 1 LIMIT 50""")
def ref_counterexamples(spark, d):
    return reference.counterexamples(table(spark, d, "customer"), table(spark, d, "events"), reference.Reference("c_custkey", "user_id", source_row="c_custkey", target_row="event_id"), 50)


@query("SELECT s.o_orderkey AS source_row, t.n AS target_row FROM orders s JOIN (SELECT c_custkey, min(c_custkey) AS n FROM customer GROUP BY 1 HAVING count(*) = 1) t ON s.o_custkey = t.c_custkey WHERE s.o_orderstatus = 'O'")
def unique_links(spark, d):
    return reference.links(table(spark, d, "orders"), table(spark, d, "customer"), reference.Reference("o_custkey", "c_custkey", {"o_orderstatus": "O"}, source_row="o_orderkey", target_row="c_custkey"))


@query("SELECT DISTINCT o_custkey::VARCHAR AS value FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def semi_inclusion(spark, d):
    return reference.included(table(spark, d, "orders"), table(spark, d, "events"), "o_custkey", "user_id")


@query("SELECT doc_id, n_chars FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_dangling(spark, d):
    return reference.dangling(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "doc_id").select("doc_id", "n_chars")


#: Parts as lists of aliases: name, brand and type, separated.
def _aliases() -> Column:
    return F.concat_ws("; ", "p_name", F.upper("p_name"), F.concat(F.col("p_brand"), F.lit(" "), F.col("p_partkey").cast("string")))


@query("""WITH src AS (SELECT p_partkey AS row, upper(p_brand) || ' ' || p_partkey AS ref FROM part),
          tgt AS (SELECT p_partkey AS row, lower(trim(unnest(string_split(concat_ws('; ', p_name, upper(p_name), p_brand || ' ' || p_partkey), ';')))) AS key FROM part
                  UNION SELECT p_partkey, lower(concat_ws('; ', p_name, upper(p_name), p_brand || ' ' || p_partkey)) FROM part)
          SELECT src.row AS source_row, min(tgt.row) AS target_row FROM src JOIN tgt ON lower(src.ref) = tgt.key GROUP BY src.row HAVING count(DISTINCT tgt.row) = 1""")
def alias_items(spark, d):
    part = table(spark, d, "part")
    source = part.select("p_partkey", F.concat(F.upper("p_brand"), F.lit(" "), F.col("p_partkey").cast("string")).alias("ref"))
    target = part.select("p_partkey", _aliases().alias("aliases"))
    return reference.links(source, target, reference.Reference("ref", "aliases", transform="target_alias_items", source_row="p_partkey", target_row="p_partkey"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS leaf, NULL::VARCHAR AS numeric_leaf FROM events""")
def json_path_reference(spark, d):
    events = table(spark, d, "events")
    built = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.struct(F.col("event_type").alias("kind")).alias("a")))).when(F.col("event_id") % 3 == 1, F.lit("{not json")).otherwise(F.col("props"))
    return events.select("event_id", json_leaf(built, ["a", "kind"]).alias("leaf"), json_leaf(F.col("props"), ["k"]).alias("numeric_leaf"))


# --- recall -----------------------------------------------------------------

_FIELDS = [("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("customer", "c_mktsegment"), ("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"), ("nation", "n_nationkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("part", "p_partkey")]
_DICT_SQL = " UNION ".join(f"SELECT '{t}.{c}' AS field, {c}::VARCHAR AS value FROM {t} WHERE {usable_sql(f'{c}::VARCHAR')}" for t, c in _FIELDS)


def _dictionary(spark, d) -> DataFrame:
    return recall.dictionary({t: table(spark, d, t) for t in {t for t, _ in _FIELDS}}, _FIELDS)


@query(_DICT_SQL)
def value_dictionary(spark, d):
    return _dictionary(spark, d)


@query(f"""WITH x AS ({_DICT_SQL}), u AS (SELECT value FROM x GROUP BY value HAVING count(*) BETWEEN 2 AND 6)
           SELECT a.field AS "left", b.field AS "right", count(*) AS common_values, bool_and(regexp_full_match(a.value, '[+-]?[0-9]+(\\.[0-9]+)?')) AS numeric_only
           FROM u JOIN x a USING (value) JOIN x b USING (value) WHERE a.field < b.field GROUP BY ALL""")
def value_overlap_pairs(spark, d):
    return recall.shared_values(_dictionary(spark, d), 6)


@query(f"SELECT count(*) AS high_fanout_values FROM (SELECT value FROM ({_DICT_SQL}) GROUP BY value HAVING count(*) > 6)")
def high_fanout_values(spark, d):
    return recall.widely_held(_dictionary(spark, d), 6)


def branches_sql(source: str, ref: str, disc: str, target: str, key: str) -> str:
    return f"""
    WITH k AS (SELECT {key}::VARCHAR AS ref, count(*) AS m FROM {target} WHERE {usable_sql(f'{key}::VARCHAR')} GROUP BY 1),
    b AS (SELECT s.{disc}::VARCHAR AS literal, count(*) AS branch_rows, count(k.ref) AS branch_matches, count(*) FILTER (WHERE m = 1) AS branch_unique
          FROM {source} s LEFT JOIN k ON s.{ref}::VARCHAR = k.ref WHERE {usable_sql(f's.{ref}::VARCHAR')} GROUP BY 1),
    o AS (SELECT *, (sum(branch_rows) OVER () - branch_rows)::BIGINT AS outside_rows, (sum(branch_matches) OVER () - branch_matches)::BIGINT AS outside_matches FROM b)
    SELECT *, coalesce(branch_matches > 0 AND outside_rows > 0 AND branch_matches * outside_rows > outside_matches * branch_rows AND {usable_sql('literal')}, FALSE) AS improves FROM o"""


@query(branches_sql("events", "user_id", "event_type", "orders", "o_custkey"))
def conditioned_branches(spark, d):
    return recall.branches(table(spark, d, "events"), table(spark, d, "orders"), "user_id", "o_custkey", "event_type")


@query("""WITH k AS (SELECT c_nationkey::VARCHAR AS ref, c_mktsegment AS literal, count(*) AS m FROM customer GROUP BY ALL),
          s AS (SELECT s_nationkey::VARCHAR AS ref, CASE s_suppkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS literal FROM supplier),
          b AS (SELECT s.literal, count(*) AS branch_rows, count(k.ref) AS branch_matches, count(*) FILTER (WHERE m = 1) AS branch_unique FROM s LEFT JOIN k ON s.ref = k.ref AND s.literal = k.literal GROUP BY 1)
          SELECT *, (sum(branch_rows) OVER () - branch_rows)::BIGINT AS outside_rows, (sum(branch_matches) OVER () - branch_matches)::BIGINT AS outside_matches,
                 branch_matches > 0 AND sum(branch_rows) OVER () > branch_rows AND branch_matches * (sum(branch_rows) OVER () - branch_rows) > (sum(branch_matches) OVER () - branch_matches) * branch_rows AS improves FROM b""")
def scoped_branches(spark, d):
    source = table(spark, d, "supplier").withColumn("segment", F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY"))
    return recall.branches(source, table(spark, d, "customer"), "s_nationkey", "c_nationkey", "segment", "c_mktsegment")


@query("""WITH n AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(id), '[a-z]{3,}'))) AS cue FROM (SELECT DISTINCT p_name AS id FROM part)), h AS (SELECT cue FROM n GROUP BY cue HAVING count(*) BETWEEN 2 AND 16)
          SELECT a.id AS "left", b.id AS "right", list_sort(list(a.cue)) AS cues, count(*) AS n_cues FROM h JOIN n a USING (cue) JOIN n b USING (cue) WHERE a.id < b.id GROUP BY a.id, b.id""")
def name_cue_pairs(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct()
    return recall.cue_pairs(names, native=True)


@query("""WITH v AS (SELECT DISTINCT 'part' AS t, 'part.p_type' AS name, p_type AS value, p_type AS whole FROM part UNION SELECT 'catalog', 'catalog.aliases', p_brand || '; ' || lower(p_type), NULL FROM part UNION SELECT 'nation', 'nation.n_name', n_name, n_name FROM nation),
          k AS (SELECT t, name, value, lower(value) AS key FROM v UNION SELECT t, name, value, lower(trim(unnest(string_split(value, ';')))) FROM v),
          s AS (SELECT key, t, name, count(DISTINCT value) AS n FROM k GROUP BY ALL), p AS (SELECT a.key, a.name AS l, b.name AS r, a.n > 1 OR b.n > 1 AS c FROM s a JOIN s b ON a.key = b.key AND a.name < b.name AND a.t <> b.t)
          SELECT l AS "left", r AS "right", count(*) AS shared_keys, (SELECT count(DISTINCT value) FROM k WHERE name = l AND key IN (SELECT key FROM p q WHERE q.l = p.l AND q.r = p.r))::INT AS left_values,
                 (SELECT count(DISTINCT value) FROM k WHERE name = r AND key IN (SELECT key FROM p q WHERE q.l = p.l AND q.r = p.r))::INT AS right_values, count(*) FILTER (WHERE c) AS collision_keys FROM p GROUP BY l, r""")
def alias_field_pairs(spark, d):
    part = table(spark, d, "part")
    field = lambda df, t, c, v: df.select(F.lit(t).alias("table"), F.lit(c).alias("field"), v.alias("value")).distinct()
    values = field(part, "part", "p_type", F.col("p_type")).unionAll(field(part, "catalog", "aliases", F.concat_ws("; ", "p_brand", F.lower("p_type"))))
    return recall.alias_pairs(values.unionAll(field(table(spark, d, "nation"), "nation", "n_name", F.col("n_name"))))


# --- facts and configuration ------------------------------------------------

_FACT = "l_returnflag, l_linestatus, l_shipdate"


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("string").alias("l_shipdate"), F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("quantity"))


_FACT_SQL = f"""WITH o AS (SELECT l_returnflag, l_linestatus, l_shipdate::VARCHAR AS l_shipdate, l_quantity::DECIMAL(18,2)::VARCHAR AS observation_value, count(*) AS source_row_count, min(l_orderkey) AS source_row_min, max(l_orderkey) AS source_row_max
                FROM lineitem WHERE l_shipdate IS NOT NULL AND l_quantity IS NOT NULL AND trim(l_returnflag) <> '' AND trim(l_linestatus) <> '' GROUP BY ALL),
                c AS (SELECT *, count(*) OVER (PARTITION BY {_FACT}) AS distinct_value_count, count(*) OVER () AS all_observed_tuples, (sum(source_row_count) OVER ())::BIGINT AS all_complete_rows FROM o)"""
_COORDS = ["l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"{_FACT_SQL} SELECT * FROM c ORDER BY md5(concat_ws(chr(31), {_FACT}, observation_value)), observation_value LIMIT 200")
def fact_tuples(spark, d):
    return facts.observed_tuples(_lines(spark, d), _COORDS, "quantity", "l_orderkey", 200)


@query(f"{_FACT_SQL} SELECT {_FACT}, observation_value, source_row_count, distinct_value_count FROM c WHERE distinct_value_count > 1")
def fact_conflicts(spark, d):
    return facts.observed_tuples(_lines(spark, d), _COORDS, "quantity", "l_orderkey").where("distinct_value_count > 1").select(*_COORDS, "observation_value", "source_row_count", "distinct_value_count")


@query()
def fact_tuple_estimate(spark, d):
    return facts.estimated_tuples(_lines(spark, d), _COORDS, "quantity")


@query(f"""{_FACT_SQL} SELECT {_FACT}, observation_value, source_row_count, source_row_min, source_row_max, least(distinct_value_count, 2)::INT AS distinct_value_count
           FROM c ORDER BY md5(concat_ws(chr(31), {_FACT}, observation_value)) LIMIT 100""")
def seeded_facts(spark, d):
    return facts.seeded_tuples(_lines(spark, d), _COORDS, "quantity", 100, "l_orderkey")


@query("""WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS rows, min(c_custkey) AS witness_row FROM customer WHERE c_nationkey IS NOT NULL AND trim(c_mktsegment) <> '' GROUP BY 1, 2)
          SELECT *, count(*) OVER () AS all_pairs, (sum(rows) OVER ())::BIGINT AS all_rows FROM g ORDER BY rows DESC, c_nationkey, c_mktsegment LIMIT 40""")
def config_pairs(spark, d):
    return facts.configuration_pairs(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", row="c_custkey", limit=40)


@query("""WITH g AS (SELECT l_suppkey, l_partkey, count(*) AS rows, min(l_orderkey) AS witness_row FROM lineitem GROUP BY 1, 2)
          SELECT l_suppkey, l_partkey, rows, witness_row, CASE WHEN s.n IS NULL THEN 'missing' WHEN s.n > 1 THEN 'ambiguous' ELSE 'accepted' END AS l_suppkey_status, CASE WHEN s.n = 1 THEN s.r END AS l_suppkey_row,
                 CASE WHEN p.n IS NULL THEN 'missing' WHEN p.n > 1 THEN 'ambiguous' ELSE 'accepted' END AS l_partkey_status, CASE WHEN p.n = 1 THEN p.r END AS l_partkey_row
          FROM g LEFT JOIN (SELECT s_suppkey, count(*) AS n, min(s_suppkey) AS r FROM supplier GROUP BY 1) s ON l_suppkey = s_suppkey LEFT JOIN (SELECT p_size AS k, count(*) AS n, min(p_partkey) AS r FROM part GROUP BY 1) p ON l_partkey = p.k""")
def config_endpoints(spark, d):
    pairs = facts.configuration_pairs(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", row="l_orderkey").drop("all_pairs", "all_rows")
    pairs = facts.resolve_endpoint(pairs, "l_suppkey", table(spark, d, "supplier"), "s_suppkey", "s_suppkey")
    return facts.resolve_endpoint(pairs, "l_partkey", table(spark, d, "part"), "p_size", "p_partkey")


def _order_links(spark, d) -> DataFrame:
    return reference.links(table(spark, d, "orders"), table(spark, d, "customer"), reference.Reference("o_custkey", "c_custkey", source_row="o_orderkey", target_row="c_custkey"))


_LINKS = "SELECT o_orderkey AS source_row, o_custkey AS target_row FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT source_row, target_row, turn FROM (SELECT *, row_number() OVER (PARTITION BY target_row ORDER BY source_row)::INT AS turn FROM ({_LINKS})) ORDER BY turn, target_row LIMIT 300")
def round_robin_examples(spark, d):
    return facts.one_per_target(_order_links(spark, d), 300)


@query(f"""WITH l AS ({_LINKS}), a AS (SELECT 'forward' AS direction, source_row AS seed, target_row AS neighbour FROM l UNION ALL SELECT 'reverse', target_row, source_row FROM l)
           SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY direction, seed) AS neighbours, row_number() OVER (PARTITION BY direction, seed ORDER BY neighbour)::INT AS place FROM a) WHERE place <= 3""")
def adjacency_ranked(spark, d):
    return facts.neighbours(facts.adjacency(_order_links(spark, d)), 3)


@query("SELECT record, min(type) AS type FROM (SELECT o_custkey AS record, o_orderstatus AS type FROM orders) GROUP BY record HAVING count(DISTINCT type) = 1")
def type_alignment(spark, d):
    return facts.type_alignment(table(spark, d, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderstatus").alias("type")))


@query("""SELECT r.e AS row, c.c_custkey AS left_row, n.n_nationkey AS right_row FROM (SELECT event_id AS e, user_id, user_id % 30 AS k FROM events) r
          JOIN customer c ON c.c_custkey = r.user_id JOIN nation n ON n.n_nationkey = r.k""")
def two_path_join(spark, d):
    events = table(spark, d, "events").withColumn("k", F.col("user_id") % 30)
    first = reference.links(events, table(spark, d, "customer"), reference.Reference("user_id", "c_custkey", source_row="event_id", target_row="c_custkey"))
    second = reference.links(events, table(spark, d, "nation"), reference.Reference("k", "n_nationkey", source_row="event_id", target_row="n_nationkey"))
    return facts.two_paths(events.select(F.col("event_id").alias("row")), first, second)


# --- relations --------------------------------------------------------------


def _outcome_sql(select: str) -> str:
    return f"""WITH k AS (SELECT p_size::VARCHAR AS item, count(*) AS n, min(p_partkey) AS r FROM part GROUP BY 1),
    o AS (SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS item, CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'not_applicable' END AS early FROM lineitem),
    f AS (SELECT o.*, CASE WHEN early IS NOT NULL THEN early WHEN k.n IS NULL THEN 'missing_target' WHEN k.n > 1 THEN 'ambiguous_identity' ELSE 'matched' END AS outcome FROM o LEFT JOIN k ON o.item = k.item) {select}"""


@query(_outcome_sql("SELECT outcome, count(*) AS n, count(DISTINCT l_orderkey) AS records FROM f GROUP BY outcome"))
def relation_identifier(spark, d):
    plan = relations.RelationPlan("size", "related_to", "l_partkey", "p_size", selector=Condition("eq", "l_returnflag", "R"), source_row="l_orderkey", target_row="p_partkey")
    found = relations.outcomes(table(spark, d, "lineitem"), table(spark, d, "part"), plan)
    return found.groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("source_row").alias("records"))


def _members(spark, d) -> DataFrame:
    listed = F.concat_ws(",", F.col("o_custkey").cast("string"), (F.col("o_custkey") + 1).cast("string"), (F.col("o_orderkey") % 3000).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", listed.alias("members"))


@query("""WITH m AS (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1, o_orderkey % 3000]) AS k FROM orders)
          SELECT o_orderkey AS source_row, k::VARCHAR AS item, CASE WHEN c_custkey IS NULL THEN 'missing_target' ELSE 'matched' END AS outcome, c_custkey AS target_row FROM m LEFT JOIN customer ON k = c_custkey""")
def relation_members(spark, d):
    plan = relations.RelationPlan("members", "contains", "members", "c_custkey", "members", delimiter=",", source_row="o_orderkey", target_row="c_custkey")
    return relations.outcomes(_members(spark, d), table(spark, d, "customer"), plan)


@query("""WITH m AS (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1, o_orderkey % 3000]) AS k FROM orders)
          SELECT o_orderkey AS source_row, list_sort(list_distinct(list(c_custkey) FILTER (c_custkey IS NOT NULL))) AS members, bool_and(c_custkey IS NOT NULL) AS complete FROM m LEFT JOIN customer ON k = c_custkey GROUP BY 1""")
def allowed_members(spark, d):
    plan = relations.RelationPlan("members", "contains", "members", "c_custkey", "members", delimiter=",", source_row="o_orderkey", target_row="c_custkey")
    return relations.allowed_members(relations.outcomes(_members(spark, d), table(spark, d, "customer"), plan))


@query("""WITH m AS (SELECT s_suppkey, unnest(['n' || s_nationkey, 'n' || (s_nationkey + 1)]) AS k FROM supplier)
          SELECT s_suppkey AS source_row, k AS item, CASE WHEN n_nationkey IS NULL THEN 'missing_target' ELSE 'matched' END AS outcome, n_nationkey::BIGINT AS target_row FROM (SELECT DISTINCT * FROM m) LEFT JOIN nation ON k = 'n' || n_nationkey""")
def relation_formula(spark, d):
    source = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("sum(n"), "s_nationkey", F.lit(") / (n"), F.col("s_nationkey") + 1, F.lit(" + 5%)")).alias("formula"))
    target = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.concat(F.lit("n"), "n_nationkey").alias("symbol"))
    return relations.outcomes(source, target, relations.RelationPlan("formula", "depends_on", "formula", "symbol", "formula", source_row="s_suppkey", target_row="n_nationkey"))


@query("""WITH f AS (SELECT o_orderkey AS r, CASE WHEN o_orderstatus = 'P' THEN 'not_applicable' WHEN c_custkey IS NULL THEN 'missing' ELSE 'matched' END AS o FROM orders LEFT JOIN customer ON o_custkey + 300 = c_custkey)
          SELECT count(*) AS examined, count(*) FILTER (WHERE o <> 'not_applicable') AS selector_true, 0::BIGINT AS selector_unknown, count(*) FILTER (WHERE o <> 'not_applicable') AS applicable_records, count(*) FILTER (WHERE o = 'matched') AS matched_records,
                 count(*) FILTER (WHERE o <> 'not_applicable') AS "references", count(*) FILTER (WHERE o = 'matched') AS matched_references,
                 (count(*) FILTER (WHERE o = 'matched'))::DOUBLE / (count(*) FILTER (WHERE o <> 'not_applicable'))::DOUBLE AS matched_record_ratio FROM f""")
def extraction_coverage(spark, d):
    source = table(spark, d, "orders").withColumn("other", F.col("o_custkey") + 300)
    plan = relations.RelationPlan("other", "related_to", "other", "c_custkey", selector=Condition("in", "o_orderstatus", values=("F", "O")), source_row="o_orderkey", target_row="c_custkey")
    return relations.coverage(relations.outcomes(source, table(spark, d, "customer"), plan))


@query("""SELECT o_orderkey AS source_row, CASE WHEN o_orderpriority = '1-URGENT' THEN 'witness_target_mismatch' ELSE 'matched' END AS outcome, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS target_row
          FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""")
def witness_restriction(spark, d):
    orders = table(spark, d, "orders")
    pairs = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source_row"), F.when(F.col("o_orderpriority") == "1-URGENT", -1).otherwise(F.col("o_custkey")).alias("target_row"))
    plan = relations.RelationPlan("customer", "related_to", "o_custkey", "c_custkey", source_row="o_orderkey", target_row="c_custkey")
    return relations.outcomes(orders, table(spark, d, "customer"), plan, witnesses=pairs).select("source_row", "outcome", "target_row")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice::DECIMAL(18,2) BETWEEN 1000 AND 200000.5 THEN TRUE WHEN o_orderstatus = 'F' THEN FALSE ELSE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 5 <> 0 END AS chosen,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 7 = 1 END AS unknown FROM orders""")
def three_valued_condition(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
        (F.col("o_orderkey") % 5 != 0).cast("string").alias("flag"), F.when(F.col("o_orderkey") % 14 == 0, "").when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 7).cast("string")).alias("maybe"),
    )
    f, other = Condition("eq", "o_orderstatus", "F"), Condition("in", "o_orderstatus", values=("O", "P"))
    chosen = Condition("or", children=(
        Condition("and", children=(f, Condition("range", "price", values=("1000", "200000.5")))),
        Condition("and", children=(other, Condition("in", "o_orderpriority", values=("1-URGENT", "2-HIGH")), Condition("eq", "flag", "true"))),
    ))
    return rows.select("o_orderkey", chosen.column().alias("chosen"), Condition("eq", "maybe", "1").column().alias("unknown"))


@query("""WITH i AS (SELECT 'assertion' AS kind, o_custkey::VARCHAR AS id, o_orderkey AS seq, o_orderpriority AS body, o_orderstatus AS e, o_orderpriority AS p FROM orders)
          SELECT kind, id, arg_min(body, seq) AS body, list_sort(list_distinct(list(e))) AS evidence_ids, list_sort(list_distinct(list(p))) AS plan_ids FROM i GROUP BY kind, id""")
def merge_evidence(spark, d):
    items = table(spark, d, "orders").select(F.lit("assertion").alias("kind"), F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("body"), F.array("o_orderstatus").alias("evidence_ids"), F.array("o_orderpriority").alias("plan_ids"))
    return relations.merge_items(items)


@query("""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN -o_custkey ELSE o_custkey END AS subject, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey + 700 END AS object, CASE WHEN o_orderkey % 8 = 0 THEN o_orderpriority END AS literal FROM orders)
          SELECT 'dangling_subject' AS problem, count(*) AS n FROM a WHERE subject NOT IN (SELECT c_custkey FROM customer)
          UNION ALL SELECT 'dangling_object', count(*) FROM a WHERE object IS NOT NULL AND object NOT IN (SELECT c_custkey FROM customer)
          UNION ALL SELECT 'dangling_evidence', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) + (SELECT count(*) FROM orders WHERE o_orderpriority NOT IN ('F', 'O'))
          UNION ALL SELECT 'literal_xor_object', count(*) FROM a WHERE (object IS NULL) = (literal IS NULL)""")
def integrity_report(spark, d):
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        key.alias("id"), F.when(key % 9 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("subject"), F.when(key % 4 != 0, F.col("o_custkey") + 700).alias("object"),
        F.when(key % 8 == 0, F.col("o_orderpriority")).alias("literal"), F.array("o_orderstatus", "o_orderpriority").alias("evidence_ids"),
    )
    evidence = spark.createDataFrame([("F",), ("O",)], "id string")
    return relations.integrity(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), rows, evidence)


# --- cards and retrieval ----------------------------------------------------


@query("SELECT md5(coalesce(text, '')) AS key, count(*) AS occurrences, min(doc_id) AS first_row FROM documents GROUP BY 1")
def card_dedup(spark, d):
    made = cards.build_cards(table(spark, d, "documents"), "documents", ["text"], ["text"], row="doc_id")
    return made.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), "occurrences", "first_row")


def _cards(spark, d) -> DataFrame:
    """Documents as cards: a pattern is a language and a source; the length's last digit tells variants."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.concat(F.lit("card:"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("card_id"), F.concat_ws("/", "lang", "source").alias("pattern_id"), F.col("lang").alias("table_name"),
        (F.col("n_chars") % 10).cast("string").alias("reference_signature"), F.lit("definition").alias("kind"), F.lit(1).cast("long").alias("occurrences"), F.col("doc_id").alias("first_row"),
    )


_CARDS = "SELECT 'card:' || lpad(doc_id::VARCHAR, 10, '0') AS card_id, lang || '/' || source AS pattern_id, lang AS table_name, (n_chars % 10)::VARCHAR AS rs, doc_id FROM documents"


@query(f"""WITH g AS (SELECT pattern_id, table_name, min(card_id) AS representative, count(*) AS cards, count(*) AS records, count(DISTINCT rs) AS reference_variants FROM ({_CARDS}) GROUP BY 1, 2),
           r AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY pattern_id)::INT AS table_rank FROM g),
           o AS (SELECT *, row_number() OVER (ORDER BY table_rank, table_name, pattern_id) AS global_rank, coalesce(sum(cards) OVER (ORDER BY table_rank, table_name, pattern_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cards_before FROM r)
           SELECT * FROM o WHERE global_rank BETWEEN 21 AND 40""")
def pattern_paging(spark, d):
    return cards.pattern_page(cards.patterns(_cards(spark, d)), 20, 1)


@query(f"SELECT card_id, table_name, place FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY card_id)::INT AS place FROM ({_CARDS})) WHERE place BETWEEN 6 AND 10")
def card_seeds(spark, d):
    return cards.seeds(_cards(spark, d), 5, 1).select("card_id", "table_name", "place")


@query(f"""WITH q(table_name, q) AS (VALUES ('en', 40), ('fr', 20), ('de', 10)) SELECT table_name, count(*) FILTER (WHERE k <= coalesce(q, 0)) AS kept, count(*) FILTER (WHERE NOT k <= coalesce(q, 0)) AS omitted
           FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY doc_id, card_id) AS k FROM ({_CARDS})) LEFT JOIN q USING (table_name) GROUP BY 1""")
def card_quota(spark, d):
    found = cards.within_quota(_cards(spark, d), {"en": 40, "fr": 20, "de": 10})
    return found.groupBy("table_name").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("omitted"))


@query("""WITH b AS (SELECT doc_id AS record, CASE WHEN toxic = 1 THEN 1 ELSE 0 END | CASE WHEN quality = 1 THEN 2 ELSE 0 END AS m FROM labels),
          l AS (SELECT doc_id AS record, 4 AS m FROM documents WHERE lang = 'en'),
          g AS (SELECT record, bit_or(m) AS m FROM (SELECT * FROM b UNION ALL SELECT * FROM l) GROUP BY 1), r AS (SELECT d.doc_id, coalesce(m, 0) AS m FROM documents d LEFT JOIN g ON doc_id = record)
          SELECT count(*) AS records, count(*) FILTER (WHERE m & 1 <> 0) AS toxic, count(*) FILTER (WHERE m & 2 <> 0) AS quality, count(*) FILTER (WHERE m & 4 <> 0) AS english, count(*) FILTER (WHERE m <> 0) AS covered, count(*) FILTER (WHERE bit_count(m) > 1) AS overlapping FROM r""")
def coverage_bitmask(spark, d):
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents")
    record = F.col("doc_id").alias("record")
    return cards.coverage({"toxic": labels.where("toxic = 1").select(record), "quality": labels.where("quality = 1").select(record), "english": docs.where("lang = 'en'").select(record)}, docs.select(record))


_BM25 = f"""
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS ts FROM documents),
    q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS term FROM benchmark),
    s AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t),
    w AS (SELECT doc_id, len(ts) AS length, unnest(ts) AS term FROM t),
    f AS (SELECT doc_id, term, length, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    x AS (SELECT doc_id, f.term, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({retrieval.K1}::DOUBLE + 1) / (tf + {retrieval.K1}::DOUBLE * (1 - {retrieval.B}::DOUBLE + {retrieval.B}::DOUBLE * length / mean)) * 1e6)::BIGINT AS w FROM f JOIN df USING (term), s),
    g AS (SELECT query_id, doc_id, sum(w)::BIGINT AS w FROM q JOIN x USING (term) GROUP BY ALL),
    b AS (SELECT query_id, doc_id, w::DOUBLE / 1e6::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, doc_id)::INT AS rank FROM g)"""


def _bm25(spark, d, k: int) -> DataFrame:
    return retrieval.bm25(table(spark, d, "benchmark"), table(spark, d, "documents"), k, "item_id")


@query(f"{_BM25} SELECT * FROM b WHERE rank <= 10")
def bm25_search(spark, d):
    return _bm25(spark, d, 10)


@query(f"""{_BM25}, a AS (SELECT query_id, doc_id, score, FALSE AS exact FROM b WHERE rank <= 20),
           e AS (SELECT query_id, doc_id, max(score) AS score, bool_or(exact) AS exact FROM (SELECT * FROM a UNION ALL SELECT item_id, item_id + 3, 0, TRUE FROM benchmark) GROUP BY ALL),
           o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, score DESC, doc_id)::INT AS rank FROM e) SELECT * FROM o WHERE rank <= 5""")
def exact_name_first(spark, d):
    bench = table(spark, d, "benchmark")
    name = F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name")
    return retrieval.exact_first(bench.select(F.col("item_id").alias("query_id"), name), bench.select((F.col("item_id") + 3).alias("doc_id"), name), _bm25(spark, d, 20), 5)


_COSINE = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, e, list_inner_product(e, e) AS nn FROM v),
    p AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_inner_product(q.e, c.e) / (sqrt(q.nn) * sqrt(c.nn)), 9) AS score FROM n q JOIN n c ON q.vec_id <> c.vec_id),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM p)"""


def _nearest(spark, d, k: int) -> DataFrame:
    return retrieval.neighbours(table(spark, d, "embeddings"), k)


@query(f"{_COSINE} SELECT query_id, doc_id, rank FROM c WHERE rank <= 10")
def cosine_topk(spark, d):
    return _nearest(spark, d, 10).select("query_id", "doc_id", "rank")


@query(f"""{_COSINE}, {_BM25.strip()[5:]}, r AS (SELECT query_id, doc_id, rank FROM c WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM b WHERE rank <= 20),
           z AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM r GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM z)
           SELECT query_id, doc_id, score, rank FROM o WHERE rank <= 10""")
def rrf_fusion(spark, d):
    return retrieval.fuse([_nearest(spark, d, 20), _bm25(spark, d, 20)], 10)


# --- types and graphs -------------------------------------------------------


@query("SELECT a.p_partkey AS \"left\", b.p_partkey AS \"right\" FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def type_equivalence_pairs(spark, d):
    return types.equivalent_pairs(table(spark, d, "part"), ["p_brand", "p_type", "p_size"], "p_partkey", chain=False)


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS canonical_id FROM part")
def equivalence_canonical(spark, d):
    return types.canonical(table(spark, d, "part"), ["p_brand", "p_type", "p_size"], "p_partkey")


@query("""WITH t AS (SELECT p_brand, p_partkey AS id, unnest(list_distinct(string_split(p_name, ' '))) AS term FROM part), h AS (SELECT p_brand, term FROM t GROUP BY ALL HAVING count(*) BETWEEN 2 AND 32)
          SELECT a.id AS "left", b.id AS "right", count(*) AS shared_terms FROM h JOIN t a USING (p_brand, term) JOIN t b USING (p_brand, term) WHERE a.id < b.id GROUP BY a.id, b.id HAVING count(*) >= 1""")
def generalisation_overlap(spark, d):
    parts = table(spark, d, "part").withColumn("terms", F.split("p_name", " "))
    return types.generalisations(parts, ["p_brand"], "terms", "p_partkey", least=1)


#: References between the driver tables.
SCHEMA_EDGES = (("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("events", "customer"), ("labels", "documents"))
_NODES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "pages", "benchmark", "conversations")
_EDGE_SQL = f"edges(a, b) AS (VALUES {', '.join(f'{e}' for e in SCHEMA_EDGES)}), nodes(node) AS (VALUES {', '.join(f'({n!r})' for n in _NODES)}), e AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges)"


def _schema_graph(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([(n,) for n in _NODES], "node string"), spark.createDataFrame(list(SCHEMA_EDGES), "a string, b string")


@query(f"WITH RECURSIVE {_EDGE_SQL}, r(node, distance) AS (SELECT 'customer', 0 UNION SELECT e.b, distance + 1 FROM r JOIN e ON r.node = e.a WHERE distance < 2) SELECT node, min(distance)::INT AS distance FROM r GROUP BY node")
def graph_neighbors(spark, d):
    _, edges = _schema_graph(spark)
    return graphs.within(edges, spark.createDataFrame([("customer",)], "node string"), 2)


@query(f"WITH RECURSIVE {_EDGE_SQL}, r(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a) SELECT node, min(other) AS component FROM r GROUP BY node")
def components(spark, d):
    return graphs.components(*_schema_graph(spark))


@query("""WITH RECURSIVE e AS (SELECT doc_id AS a, doc_id + 7 AS b FROM documents WHERE lang = 'en' AND doc_id + 7 IN (SELECT doc_id FROM documents)), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
          r(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, s.b FROM r JOIN s ON r.other = s.a) SELECT node, min(other) AS component FROM r GROUP BY node""")
def components_chains(spark, d):
    docs = table(spark, d, "documents")
    nodes = docs.select(F.col("doc_id").alias("node"))
    edges = docs.where("lang = 'en'").select(F.col("doc_id").alias("node")).select(F.col("node").alias("a"), (F.col("node") + 7).alias("b")).join(nodes.select(F.col("node").alias("b")), "b")
    return graphs.components(nodes, edges.select("a", "b"))


@query(f"WITH {_EDGE_SQL} SELECT node FROM nodes WHERE node NOT IN (SELECT a FROM e)")
def isolated_nodes(spark, d):
    return graphs.isolated(*_schema_graph(spark))


@query("SELECT c_mktsegment AS source_type, n_name AS target_type, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def type_pair_counts(spark, d):
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    edges = customer.select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"))
    kinds = customer.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("type")).unionAll(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("type")))
    return graphs.type_pairs(edges, kinds)


def _metrics(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nations as metrics: each the sum of the next one and a constant; every fifth refers on into a circle of two."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    nxt = F.when(F.col("id").isin(20, 21), 41 - F.col("id")).when(F.col("id") == 5, F.col("id")).otherwise(F.col("id") + 1)
    return n.select("id", F.concat(F.lit("total = m"), nxt.cast("string"), F.lit(" * (1 + 5%)")).alias("formula")), n.select("id", F.concat(F.lit("M"), F.col("id").cast("string")).alias("name"))


@query("""SELECT n_nationkey::BIGINT AS id, 'm' || k AS symbol, 'factor' AS role, CASE WHEN k < 25 AND k <> n_nationkey THEN k::BIGINT END AS target_id, CASE WHEN k = n_nationkey THEN 'self_reference' WHEN k > 24 THEN 'no_definition' ELSE 'bound' END AS status
          FROM (SELECT n_nationkey, CASE WHEN n_nationkey IN (20, 21) THEN 41 - n_nationkey WHEN n_nationkey = 5 THEN 5 ELSE n_nationkey + 1 END AS k FROM nation)""")
def formula_bindings(spark, d):
    return types.bind_formulas(*_metrics(spark, d)).drop("candidates")


@query("""SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey IN (5, 24) THEN 'unresolved_operands' WHEN n_nationkey IN (20, 21) THEN 'cyclic_dependency' ELSE 'accepted' END AS status FROM nation""")
def calculation_status(spark, d):
    return types.calculation_status(types.bind_formulas(*_metrics(spark, d)))


# --- decisions, instances, streams ------------------------------------------


@query("""WITH o AS (SELECT l_suppkey % 40 AS s, l_returnflag AS f, (l_linenumber * 10)::VARCHAR AS observation_value, count(*) AS source_row_count, count(DISTINCT l_linestatus) AS k FROM lineitem GROUP BY ALL),
          c AS (SELECT *, count(*) OVER (PARTITION BY s, f) AS n FROM o)
          SELECT s::BIGINT AS s, f, observation_value, source_row_count, CASE WHEN n <> 1 THEN 'ambiguous_coordinates' WHEN source_row_count > 40 THEN 'too_many_rows' WHEN k > 1 THEN 'residual_fields_vary' END AS reason FROM c""")
def fact_instances(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("s"), F.col("l_returnflag").alias("f"), (F.col("l_linenumber") * 10).cast("string").alias("v"), "l_linestatus", "l_orderkey")
    seen = facts.observed_tuples(rows, ["s", "f"], "v", "l_orderkey")
    found = instances.fact_instances(rows, seen, ["s", "f"], "v", ["l_linestatus"], "type:quantity", "l_orderkey", most=40)
    return found.select("s", "f", "observation_value", "source_row_count", "reason")


@query("""WITH t AS (SELECT p_brand, p_type, 'template:' || lpad(p_partkey::VARCHAR, 8, '0') AS template_id, 'type:' || (p_partkey % 7) AS type_id, p_size AS ts FROM part WHERE p_size <= 5),
          g AS (SELECT p_brand, p_type, min(template_id) AS template_id, arg_min(type_id, template_id) AS type_id, arg_min(ts, template_id) AS ts FROM t GROUP BY 1, 2 HAVING count(DISTINCT type_id) = 1)
          SELECT p_partkey AS row, type_id, template_id, p_size <> ts AS variant FROM part JOIN g USING (p_brand, p_type)""")
def definition_memberships(spark, d):
    part = table(spark, d, "part")
    made = part.where("p_size <= 5").withColumns({"template_id": F.concat(F.lit("template:"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")), "type_id": F.concat(F.lit("type:"), F.col("p_partkey") % 7)})
    return instances.memberships(part, made, ["p_brand", "p_type"], ["p_size"], "p_partkey")


@query("SELECT c_custkey AS id, c_mktsegment, c_nationkey, \"of\", place FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS \"of\", row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey)::INT AS place FROM customer) WHERE place <= 3")
def instance_preview(spark, d):
    return instances.preview(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"])


@query("""WITH v AS (SELECT o_custkey AS subject, o_orderstatus AS attribute, o_orderkey::VARCHAR AS literal FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY attribute, literal) AS place FROM v)
          SELECT c_custkey AS id, coalesce(list(attribute || '=' || literal ORDER BY place) FILTER (place <= 4), []) AS attributes, count(place) AS n_attributes FROM customer LEFT JOIN r ON c_custkey = subject GROUP BY c_custkey""")
def attribute_preview(spark, d):
    values = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("attribute"), F.col("o_orderkey").cast("string").alias("literal"))
    found = instances.attributes(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), values, 4)
    return found.withColumn("attributes", F.coalesce("attributes", F.array().cast("array<string>")))


@query("""SELECT p_partkey AS decision_id, list_filter([CASE WHEN p_size % 5 = 0 THEN 'unknown_root' END, CASE WHEN gone THEN 'record_not_in_evidence' END, CASE WHEN p_partkey % 7 = 0 AND NOT gone THEN 'truncated_record' END,
          CASE WHEN p_partkey % 3 = 0 THEN 'label_not_a_source_name' END, CASE WHEN p_partkey % 4 = 0 OR gone THEN 'quote_is_no_whole_field' END, CASE WHEN gone THEN 'scope_value_not_in_records' END], lambda x: x IS NOT NULL) AS errors
          FROM (SELECT *, p_partkey % 6 = 0 AND p_partkey <> 0 AS gone FROM part)""")
def concept_gate(spark, d):
    part = table(spark, d, "part")
    key = F.col("p_partkey")
    decisions = part.select(
        key.alias("decision_id"), F.when(F.col("p_size") % 5 == 0, "Thing").otherwise("Metric").alias("root"), F.when(key % 3 == 0, F.concat("p_name", F.lit(" x"))).otherwise(F.concat("p_name", F.lit(" (part)"))).alias("label"),
        F.array(F.when(key % 6 == 0, -key).otherwise(key).cast("string")).alias("record_ids"), F.when(key % 4 == 0, F.lit("a part")).otherwise(F.col("p_type")).alias("quote"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("scope"),
    )
    field = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("value"))
    evidence = part.select(key.cast("string").alias("record_id"), (key % 7 == 0).alias("truncated"), F.explode(F.array(field("name", "p_name"), field("description", "p_type"), field("scope", "p_brand"))).alias("f")).select("record_id", "f.role", "f.value", "truncated")
    return gates.concepts(decisions, evidence).select("decision_id", "errors")


@query("""SELECT o_orderkey AS decision_id, list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'rule_not_checked' END, CASE WHEN o_orderkey % 3 = 0 AND o_custkey <> 0 THEN 'pair_not_checked' END, CASE WHEN o_orderkey % 4 = 0 THEN 'source_quote_not_found' END,
          CASE WHEN o_orderkey % 3 = 0 AND o_custkey <> 0 THEN 'target_quote_not_found' END, CASE WHEN o_orderkey % 5 = 1 THEN 'numbers_prove_nothing' END], lambda x: x IS NOT NULL) AS errors FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NOT NULL""")
def relation_gate(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    key = F.col("o_orderkey")
    rules = spark.createDataFrame([(str(k), "unresolved" if k == 0 else "checked_technical", "s", 10, 8, 1, 1, k == 1, False) for k in range(5)], "rule_id string, status string, snapshot_id string, eligible int, uniques int, ambiguous int, missing int, numeric_only boolean, declared boolean")
    decisions = orders.select(
        key.alias("decision_id"), (key % 5).cast("string").alias("rule_id"), F.lit("related_to").alias("predicate"), key.alias("source_row"), F.when(key % 3 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("target_row"),
        F.when(key % 4 == 0, "nothing").otherwise(F.substring("o_orderpriority", 1, 4)).alias("source_quote"), F.lit("Customer").alias("target_quote"),
    )
    pairs = orders.select((key % 5).cast("string").alias("rule_id"), key.alias("source_row"), F.col("o_custkey").alias("target_row"))
    found = gates.record_relations(decisions, rules, pairs, orders.select(key.alias("row"), F.array("o_orderpriority").alias("texts")), customer.select(F.col("c_custkey").alias("row"), F.array(F.concat(F.lit("Customer "), F.col("c_name"))).alias("texts")), "s")
    return found.select("decision_id", "errors")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'projection:a' ELSE 'projection:b' END AS template_id, p_brand AS product, p_size::VARCHAR AS size FROM part WHERE p_size % 10 <> 3""")
def template_bindings(spark, d):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("sales of "), "p_brand", F.lit(" in size "), size)).when(F.col("p_size") % 10 != 3, F.concat("p_brand", F.lit(": returns, size "), size)).otherwise("something else")
    rows = table(spark, d, "part").select("p_partkey", text.alias("text"), F.concat(F.lit("size "), size).alias("note"))
    made = [
        {"template_id": "projection:a", "type_id": "t1", "rank": 1, "fields": {"text": "sales of {product} in size {size}", "note": "size {size}"}},
        {"template_id": "projection:b", "type_id": "t2", "rank": 1, "fields": {"text": "{product}: returns, size {size}", "note": "size {size}"}},
    ]
    return bind(rows, made).select("p_partkey", "template_id", F.col("slots")["product"].alias("product"), F.col("slots")["size"].alias("size"))


@query("SELECT DISTINCT p_type, CASE WHEN p_type LIKE '%A%' THEN 'kg/m2' ELSE 'MW' END AS unit FROM part")
def unit_spellings(spark, d):
    spelling = F.when(F.col("p_type").contains("A"), "千克 / 平方米").otherwise(" M W")
    return table(spark, d, "part").select("p_type", spelling.alias("u")).distinct().select("p_type", canonical_unit("u").alias("unit"))


@query("SELECT p_partkey, p_size % 3 = 0 AS member FROM part")
def member_lists(spark, d):
    listed = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("other; "), F.upper("p_name"), F.lit(", more"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("not "), F.col("p_name"))).otherwise(F.concat("p_name", F.lit(" extended")))
    return table(spark, d, "part").select("p_partkey", member_of(listed, F.col("p_name")).alias("member"))


@query("""SELECT o_orderkey AS source_row, CASE WHEN o_orderstatus = 'F' THEN 'matched' ELSE 'undecided' END AS outcome, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS target_row FROM orders""")
def relation_text_decisions(spark, d):
    orders = table(spark, d, "orders")
    decided = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source_row"), F.col("o_custkey").alias("target_row")).distinct()
    plan = relations.RelationPlan("text", "related_to", "o_orderpriority", "c_name", "text", source_row="o_orderkey", target_row="c_custkey")
    return relations.outcomes(orders, table(spark, d, "customer"), plan, decided).select("source_row", "outcome", "target_row")


@query("""WITH l AS (SELECT DISTINCT event_type AS value FROM events) SELECT 'a.kind' AS path, 'events.event_type' AS field, count(*) AS shared FROM l WHERE trim(value) <> ''""")
def json_references(spark, d):
    events = table(spark, d, "events")
    built = events.select(F.to_json(F.struct(F.struct(F.col("event_type").alias("kind"), F.lit(1).alias("n")).alias("a"), F.lit("zzz").alias("b"))).alias("j"))
    targets = recall.dictionary({"events": events}, [("events", "event_type")])
    return recall.json_references(built, "j", targets)


@query("""WITH s AS (SELECT CASE event_id % 3 WHEN 0 THEN 'to_customer' WHEN 1 THEN 'supplier link' ELSE 'nothing' END AS literal FROM events), g AS (SELECT literal, count(*) AS rows FROM s GROUP BY 1)
          SELECT literal, rows, CASE literal WHEN 'supplier link' THEN 'supplier' ELSE 'customer' END AS "table" FROM g WHERE literal <> 'nothing'""")
def hinted_branches(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "to_customer").when(F.col("event_id") % 3 == 1, "supplier link").otherwise("nothing")
    return recall.hinted_branches(table(spark, d, "events").select(kind.alias("kind")), "kind", ["customer", "supplier", "orders"])


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS row_count, count(*) FILTER (WHERE event_type IS NULL) AS null_count, count(*) FILTER (WHERE trim(event_type) <> '') AS usable_count, 0::BIGINT AS numeric_count FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def stream_profile(spark, d):
    """A stream over the event files, run until what is there is read; the last state of each window counts."""
    path = f"{d}/events.parquet"
    # as a pattern: a stream takes a plain path for a folder
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    name = uuid4().hex
    where = f"{scratch(spark)}/stream-{name}"
    profile_ = checks.windowed_profile(stream, "ts", "event_type")
    run = profile_.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{where}/out")).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{where}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
          s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
          SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS row_count FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    found = checks.sessions(table(spark, d, "events"), "ts", "user_id")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


# --- packets ----------------------------------------------------------------


@query("""WITH b AS (SELECT c_custkey AS s, count(*) AS m, min(event_id) AS t FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY 1), g AS (SELECT * FROM b WHERE t IS NOT NULL AND m = 1 ORDER BY s, t LIMIT 2)
          SELECT 'matched' AS kind, s AS source_row, t AS target_row FROM g UNION ALL SELECT CASE WHEN t IS NULL THEN 'missing_in_input' ELSE 'ambiguous_target' END, s, NULL FROM (SELECT * FROM b WHERE t IS NULL OR m > 1 ORDER BY s LIMIT 1)""")
def joint_examples(spark, d):
    ends = table(spark, d, "customer"), table(spark, d, "events")
    ref = reference.Reference("c_custkey", "user_id", source_row="c_custkey", target_row="event_id")
    return packets.joint_examples(reference.links(*ends, ref), reference.counterexamples(*ends, ref, 1))


@query("SELECT n_nationkey, n_name FROM nation")
def all_or_nothing(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    return packets.all_or_nothing(nation, 25).unionAll(packets.all_or_nothing(nation, 24))


@query("""WITH i AS (SELECT o_custkey, o_orderkey AS rank, o_orderpriority AS p, length('{"rank":' || o_orderkey || ',"p":"' || o_orderpriority || '"}') + 1 AS b FROM orders), r AS (SELECT *, 1 + sum(b) OVER (PARTITION BY o_custkey ORDER BY rank ROWS UNBOUNDED PRECEDING) AS s FROM i)
          SELECT o_custkey, count(*) FILTER (WHERE s <= 200) AS n_items, count(*) FILTER (WHERE s > 200) AS n_omitted, max(s) FILTER (WHERE s <= 200)::BIGINT AS bytes FROM r GROUP BY 1 HAVING n_items > 0""")
def evidence_packets(spark, d):
    items = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("rank"), F.col("o_orderpriority").alias("p"))
    return packets.packets(items, "o_custkey", "rank", 200, ["p"]).drop("items")


@query("SELECT o_orderkey AS task_id FROM orders WHERE o_orderstatus <> 'F'")
def open_tasks(spark, d):
    orders = table(spark, d, "orders")
    tasks = orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("evidence"))
    before = orders.where("o_orderstatus != 'O'").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "P", "changed").otherwise(F.col("o_orderpriority")).alias("evidence"))
    done = before.select("task_id", F.sha2(F.to_json(F.struct("evidence")), 256).alias("digest"))
    return packets.open_tasks(tasks, done).select("task_id")


@query("""WITH t AS (SELECT event_id, event_id % 9 AS k FROM events WHERE event_id % 2 = 0)
          SELECT event_id AS term_id, 'c' || k AS code, CASE WHEN k = 8 THEN 'member_missing' WHEN k = 7 THEN 'member_ambiguous' WHEN k = 6 THEN 'dimension_missing' WHEN k = 5 THEN 'dimension_ambiguous' ELSE 'unique' END AS status,
                 CASE WHEN k < 5 THEN k END AS dimension_id FROM t""")
def dimension_member_paths(spark, d):
    k = F.col("event_id") % 9
    terms = table(spark, d, "events").select(F.col("event_id").alias("term_id"), F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("c"), k).alias("member")))).otherwise(F.to_json(F.struct(k.alias("member")))).alias("attributes"))
    members = spark.createDataFrame([(i, f"c{i}", f"x; Axis {i}") for i in range(5)] + [(5, "c5", "axis 1, AXIS 2"), (6, "c6", "nothing"), (7, "c7", "Axis 1"), (8, "c7", "Axis 2")], "member_row int, code string, text string")
    dimensions = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("dimension_id"), F.concat(F.lit("axis "), "r_regionkey").alias("name"))
    return packets.member_paths(terms, ["member"], members, dimensions)


@query("""WITH c AS (SELECT o_orderkey AS row, unnest(['o_orderpriority', 'o_orderstatus']) AS "column", unnest([o_orderpriority, o_orderstatus]) AS literal FROM orders)
          SELECT * FROM (SELECT literal, row, "column", count(*) OVER (PARTITION BY literal, "column") AS "of", row_number() OVER (PARTITION BY literal, "column" ORDER BY row)::INT AS place FROM c WHERE literal IN ('P', '1-URGENT')) WHERE place <= 5""")
def observed_value_sources(spark, d):
    literals = spark.createDataFrame([("P",), ("1-URGENT",), ("URGENT",), ("",)], "literal string")
    return packets.value_sources(literals, table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey")


@query("""WITH n AS (SELECT p_name AS name, min(p_partkey) AS id, count(DISTINCT p_partkey) AS k FROM part GROUP BY 1)
          SELECT s_suppkey AS binding_id, 'product' AS slot, CASE WHEN k IS NULL THEN 'no_target' WHEN k > 1 THEN 'ambiguous_target' ELSE 'bound' END AS status, CASE WHEN k = 1 THEN id END AS target_id
          FROM supplier LEFT JOIN part ON p_partkey = s_suppkey * 3 LEFT JOIN n ON name = p_name""")
def slot_bindings(spark, d):
    part = table(spark, d, "part")
    values = table(spark, d, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey") * 3, "left").select(F.col("s_suppkey").alias("binding_id"), F.lit("product").alias("slot"), F.col("p_name").alias("value"))
    return packets.slot_targets(values, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS rows, min(l_orderkey * 10 + l_linenumber) AS first_row FROM lineitem GROUP BY 1, 2 ORDER BY first_row LIMIT 20")
def fact_sample_groups(spark, d):
    rows = table(spark, d, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return packets.sample_groups(rows, ["l_returnflag", "l_linestatus"], 20, "row")


@query("""SELECT c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'types_without_instances', (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer))
          UNION ALL SELECT 'instances_without_assertions', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT user_id FROM events))""")
def instance_coverage(spark, d):
    made = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("type"), F.col("c_mktsegment").alias("kind"))
    named = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_custkey").alias("object")).unionAll(table(spark, d, "events").select("user_id", "user_id"))
    return packets.instance_coverage(made, table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), named)


@query(f"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || ' GET https://x/api/v1' ELSE text END AS t FROM conversations)
           SELECT conv_id, turn, CASE WHEN trim(coalesce(t, '')) = '' THEN 'no_definition' WHEN regexp_matches(t, '{gates.SERVICE}') THEN 'service_row' END AS reason FROM c""")
def quantity_subject_guard(spark, d):
    said = table(spark, d, "conversations").withColumn("said", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" GET https://x/api/v1"))).otherwise(F.col("text")))
    return gates.quantity_subjects(said, "said").select("conv_id", "turn", "reason")


@query("""SELECT o_orderstatus AS source_type, c_mktsegment AS target_type, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def instance_edges(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    sources = instances.objects(orders.select(F.col("o_orderkey").alias("row"), F.col("o_orderstatus").alias("type_id")), "orders")
    targets = instances.objects(customer.select(F.col("c_custkey").alias("row"), F.col("c_mktsegment").alias("type_id")), "customer")
    found = instances.edges(_order_links(spark, d), sources, targets, "related_to")
    return found.groupBy("source_type", "target_type").agg(F.count("*").alias("n"))


_HASHED = """w_{t} AS (SELECT id, term, md5(term) AS h FROM (SELECT {i} AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS term FROM {t})),
    n_{t} AS (SELECT id, (('0x' || h[1:6])::BIGINT % 256)::INT AS bucket, sum(CASE WHEN h[7] < '8' THEN 1 ELSE -1 END)::BIGINT AS n FROM w_{t} GROUP BY ALL HAVING n <> 0),
    v_{t} AS (SELECT id, bucket, n / sqrt(sum((n * n)::DOUBLE) OVER (PARTITION BY id)) AS weight FROM n_{t})"""


@query(f"""{_BM25}, {_HASHED.format(t='documents', i='doc_id')}, {_HASHED.format(t='benchmark', i='item_id')},
           s AS (SELECT query_id, doc_id, sum(round(q.weight * d.weight * 1e9)::BIGINT)::BIGINT AS t FROM b JOIN v_documents d ON d.id = doc_id JOIN v_benchmark q ON q.id = query_id AND q.bucket = d.bucket WHERE rank <= 20 GROUP BY ALL)
           SELECT * FROM (SELECT query_id, doc_id, t::DOUBLE / 1e9::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 10""".replace("s AS (SELECT query_id", "sc AS (SELECT query_id").replace("FROM s) WHERE", "FROM sc) WHERE"))
def snippet_rerank(spark, d):
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    found = materialise(_bm25(spark, d, 20).select("query_id", "doc_id"))  # only what was found needs a vector
    return retrieval.rerank(found, retrieval.hashed_weights(bench, "item_id", "text"), retrieval.hashed_weights(retrieval.named(docs, found), "doc_id", "text"), 10)
