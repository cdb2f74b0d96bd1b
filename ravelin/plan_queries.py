"""Registered queries over catalogues, files, plans and gates, each with the SQL it must equal.

Rules that run on a catalogue have small fixtures; their SQL lists the rows expected.
"""

from __future__ import annotations

import json
import re
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.conditions import Condition
from .functions.formulas import parse, parsed
from .functions.lexical import class_named, fragment_kinds
from .functions.names import plausible, refers, tokens
from .functions.text import cues_of, terms_of
from .operators import cards, facts, graphs, instances, packets, profile, recall, reference, relations, retrieval, types
from .plans import budgets, config, discovery, gates
from .plans.roles import Column, Table, column_role, context_roles, literal_type, row_purpose
from .queries import _DICT_SQL, _LINKS, SCHEMA_EDGES, _aliases, _dictionary, _metrics, _order_links, query, table
from .sources import catalog, external
from .sources.rows import scratch
from .sources.sinks import Sink, Stages
from .sources.snapshot import Snapshot, from_files, from_parquet, sequence_prefix


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """SQL for rows given one by one; columns: 'name type, ...' in SQL types."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(lit, v)) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper()

    named = [c.strip().split(" ", 1) for c in columns.split(",")]
    quoted = ", ".join(f'"{c}"' for c, _ in named)
    typed = ", ".join(f'"{c}"::{t} AS "{c}"' for c, t in named)
    return f"SELECT {typed} FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({quoted})"


def folder(spark: SparkSession) -> Path:
    """A new folder in shared storage, for files that a query writes and reads again."""
    out = Path(re.sub(r"^file:/+", "/", scratch(spark))) / f"files-{uuid4().hex}"
    out.mkdir(parents=True)
    return out


# --- a catalogue ------------------------------------------------------------

CATALOGUE = {
    t.name: t
    for t in (
        Table("shop.invoice", [
            Column("invoice_id", "integer"), Column("customer_ref", "text"), Column("total_amount", "numeric(12,2)"), Column("issued_on", "date"), Column("created_at", "timestamp"), Column("updated_by", "text"),
            Column("contact_email", "text"), Column("note", "text", "联系电话"), Column("remark", "text"), Column("spare", "text", usable=0, rows=10), Column("currency", "text"),
        ], ["invoice_id"], [("customer_ref", "shop.customer", "id")], "invoices of customers with amounts"),
        Table("shop.metric_rule", [Column("rule_id", "integer"), Column("metric_code", "text"), Column("target_code", "text"), Column("mode", "text")], ["rule_id"], [], "rules that map a metric to a target"),
        Table("shop.glossary", [Column("term_id", "integer"), Column("title", "text"), Column("definition", "text"), Column("formula_type", "text"), Column("synonyms", "text"), Column("kpi", "text", "Calculated as revenue / cost"), Column("owner", "text", "refers to a person")], ["term_id"], [], "terms and their meaning"),
        Table("shop.customer", [Column("id", "integer"), Column("payload", "jsonb")], ["id"], [], "customers that invoices go to"),
    )
}


@query(rows_sql("table VARCHAR, column VARCHAR, role VARCHAR, joins BOOLEAN, part VARCHAR", [
    ("shop.invoice", "invoice_id", "technical_identifier", True, "identity"), ("shop.invoice", "customer_ref", "technical_identifier", True, "reference"), ("shop.invoice", "total_amount", "unknown", True, "quantity"),
    ("shop.invoice", "issued_on", "unknown", True, "time"), ("shop.invoice", "created_at", "audit_time", False, "audit_time"), ("shop.invoice", "updated_by", "audit_metadata", False, "audit_metadata"),
    ("shop.invoice", "contact_email", "sensitive", False, None), ("shop.invoice", "note", "sensitive", False, None), ("shop.invoice", "remark", "semantic", True, "description"), ("shop.invoice", "spare", "empty", False, None),
    ("shop.invoice", "currency", "semantic", True, "unit"), ("shop.metric_rule", "rule_id", "technical_identifier", True, "identity"), ("shop.metric_rule", "metric_code", "technical_identifier", True, "reference"),
    ("shop.metric_rule", "target_code", "technical_identifier", True, "reference"), ("shop.metric_rule", "mode", "semantic", True, "scope"), ("shop.glossary", "term_id", "technical_identifier", True, "identity"),
    ("shop.glossary", "title", "semantic", True, "name"), ("shop.glossary", "definition", "semantic", True, "description"), ("shop.glossary", "formula_type", "semantic", True, "scope"), ("shop.glossary", "synonyms", "semantic", True, "alias"),
    ("shop.glossary", "kpi", "semantic", True, "formula"), ("shop.glossary", "owner", "semantic", True, "reference"), ("shop.customer", "id", "technical_identifier", True, "identity"), ("shop.customer", "payload", "unknown", True, "unknown"),
]))
def column_roles(spark, d):
    rows = [(t.name, c.name, *column_role(c, t)[::2], context_roles(t).get(c.name)) for t in CATALOGUE.values() for c in t.columns]
    return spark.createDataFrame(rows, "table string, column string, role string, joins boolean, part string")


@query(rows_sql("table VARCHAR, purpose VARCHAR", [("shop.invoice", "business_fact"), ("shop.metric_rule", "configuration_data"), ("shop.glossary", "definition_data"), ("shop.customer", "unresolved")]))
def table_purposes(spark, d):
    return spark.createDataFrame([(t.name, row_purpose(t)[0]) for t in CATALOGUE.values()], "table string, purpose string")


_NAMED = [("invoice", "customer_ref", ""), ("customer", "id", ""), ("customer", "customer_id", ""), ("customer", "name", ""), ("visit", "place", "see customer.name")]


@query(f"""WITH f AS ({rows_sql("t VARCHAR, c VARCHAR", [f[:2] for f in _NAMED])})
           SELECT a.t || '.' || a.c AS source, b.t || '.' || b.c AS target, coalesce(a.t || '.' || a.c || '>' || b.t || '.' || b.c IN ('invoice.customer_ref>customer.id', 'invoice.customer_ref>customer.customer_id', 'invoice.customer_ref>customer.name',
                  'customer.customer_id>invoice.customer_ref', 'visit.place>customer.name'), FALSE) AS named, a.t <> b.t OR (a.c <> 'name' AND b.c <> 'name') AS plausible FROM f a, f b WHERE (a.t, a.c) <> (b.t, b.c)""")
def metadata_pairs(spark, d):
    rows = [(f"{a[0]}.{a[1]}", f"{b[0]}.{b[1]}", refers(a[:2], b[:2], a[2]), plausible(a[:2], b[:2], a[2])) for a in _NAMED for b in _NAMED if a != b]
    return spark.createDataFrame(rows, "source string, target string, named boolean, plausible boolean")


@query(rows_sql("name VARCHAR, tokens VARCHAR[]", [("customerID", ["customer", "id"]), ("HTTPServerName", ["http", "server", "name"]), ("order_no2", ["order", "no", "2"]), ("指标_code", ["指标", "code"]), ("__", [])]))
def identifier_tokens(spark, d):
    return spark.createDataFrame([(n, list(tokens(n))) for n in ("customerID", "HTTPServerName", "order_no2", "指标_code", "__")], "name string, tokens array<string>")


@query(rows_sql("native VARCHAR, literal VARCHAR, generic VARCHAR", [
    ("integer", "integer", "NumberType"), ("bigint", "integer", "NumberType"), ("numeric(12,2)", "decimal", "NumberType"), ("double precision", "decimal", "NumberType"), ("boolean", "boolean", "BooleanType"), ("date", "date", "DateType"),
    ("timestamp without time zone", "datetime", "TimeType"), ("text", "string", "StringType"), ("bytea", "string", "BytesType"), ("text[]", "string", "ArrayType"), ("uuid", "string", "StringType"),
]))
def declared_types(spark, d):
    kinds = ("integer", "bigint", "numeric(12,2)", "double precision", "boolean", "date", "timestamp without time zone", "text", "bytea", "text[]", "uuid")
    return spark.createDataFrame([(k, literal_type(k), catalog.generic_type(k)) for k in kinds], "native string, literal string, generic string")


@query(f"""WITH c AS ({rows_sql("t VARCHAR, c VARCHAR", [(t.name, c.name) for t in CATALOGUE.values() for c in t.columns])})
           SELECT t AS "table", 'source_record_type:' || t AS type, 'column:' || t || '.' || c AS attribute, c AS "column" FROM c""")
def direct_mapping(spark, d):
    rows = [(m["table"], m["type"], a, c) for m in catalog.direct_mapping(CATALOGUE) for a, c in m["attributes"].items()]
    return spark.createDataFrame(rows, "table string, type string, attribute string, column string")


@query(f"""WITH t(t, n, key) AS (VALUES {', '.join(f"('{t.name}', {len(t.columns)}, '{t.pk[0]}')" for t in CATALOGUE.values())})
           SELECT 'urn:li:dataset:(urn:li:dataPlatform:postgres,' || t || ',PROD)' AS urn, a.aspect, CASE WHEN a.aspect = 'schemaMetadata' THEN n END::INT AS fields, CASE WHEN a.aspect = 'schemaMetadata' THEN key END AS key,
                  t = 'shop.customer' OR (t = 'shop.glossary' AND a.aspect = 'datasetProperties') AS missing FROM t, (VALUES ('datasetProperties'), ('schemaMetadata')) a(aspect)""")
def catalog_proposals(spark, d):
    written = catalog.proposals(CATALOGUE)
    read = [p | ({"aspect": {}} if "glossary" in p["entityUrn"] and p["aspectName"] == "datasetProperties" else {}) for p in written if "shop.customer" not in p["entityUrn"]]
    gone = set(catalog.missing_proposals(written, read))
    rows = [(p["entityUrn"], p["aspectName"], len(p["aspect"]["fields"]) if "fields" in p["aspect"] else None, next(iter(p["aspect"].get("primaryKeys", [])), None), (p["entityUrn"], p["aspectName"]) in gone) for p in written]
    return spark.createDataFrame(rows, "urn string, aspect string, fields int, key string, missing boolean")


@query(f"""WITH c AS ({rows_sql("t VARCHAR, c VARCHAR", [(t.name, c.name) for t in CATALOGUE.values() for c in t.columns])})
           SELECT t AS a, t || '.' || c AS b, 'has_field' AS type FROM c UNION ALL SELECT 'shop.invoice.customer_ref', 'shop.customer.id', 'declared_fk'""")
def catalog_edges(spark, d):
    return catalog.graph(spark, CATALOGUE)[1]


@query(rows_sql("query_id VARCHAR, doc_id VARCHAR", [("shop.customer", "shop.invoice"), ("shop.invoice", "shop.customer"), ("shop.glossary", "shop.customer"), ("shop.metric_rule", "shop.invoice")]))
def similar_tables(spark, d):
    said = {t: Table(t, [Column(w, "text") for w in words.split()]) for t, words in {"shop.invoice": "amount customer total due number", "shop.customer": "customer phone_note amount term", "shop.glossary": "meaning term", "shop.metric_rule": "due number"}.items()}
    return catalog.similar_tables(spark, said, ["shop.invoice", "shop.customer"], 1).select("query_id", "doc_id")


@query(rows_sql("condition VARCHAR, fields VARCHAR[]", [("one", ["a"]), ("nested", ["a", "b", "c"])]))
def condition_fields(spark, d):
    nested = Condition("or", children=(Condition("and", children=(Condition("eq", "a", "1"), Condition("in", "b", values=("x", "y")))), Condition("range", "c", values=("0", "1.5"))))
    return spark.createDataFrame([("one", sorted(Condition("eq", "a", "1").fields())), ("nested", sorted(nested.fields()))], "condition string, fields array<string>")


# --- files ------------------------------------------------------------------


def _nation_files(spark, d) -> Path:
    """nation as CSV with declared columns; its note is absent, empty, or holds quotes and a comma."""
    root = folder(spark)
    (root / "schema/tables").mkdir(parents=True)
    (root / "data").mkdir()
    columns = ["n_nationkey", "n_name", "n_regionkey", "note"]
    (root / "schema/tables/nation.yaml").write_text(json.dumps({"table_schema": "geo", "table_name": "nation", "columns": [{"column_name": c, "data_type": "text"} for c in columns]}))
    notes = {0: "", 1: '""'}
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()
    lines = [",".join(columns)] + [f"{r.n_nationkey},{r.n_name},{r.n_regionkey},{notes.get(r.n_nationkey % 3, f'''"say ""{r.n_nationkey}"", twice"''')}" for r in rows]
    (root / "data/nation.csv").write_text("\n".join(lines) + "\n")
    return root


@query("""SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'say "' || n_nationkey || '", twice' END AS note, row_number() OVER (ORDER BY n_nationkey) AS row FROM nation""")
def snapshot_import(spark, d):
    return from_files(spark, str(_nation_files(spark, d))).frames["geo.nation"].withColumnRenamed("__row", "row").withColumn("row", F.col("row").cast("long"))


@query("""SELECT 'data/nation.csv' AS file, sha256('n_nationkey,n_name,n_regionkey,note' || chr(10) || string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey || ',' ||
          CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '""' ELSE '"say ""' || n_nationkey || '"", twice"' END || chr(10), '' ORDER BY n_nationkey)) AS digest FROM nation""")
def snapshot_hashes(spark, d):
    return spark.createDataFrame(sorted(from_files(spark, str(_nation_files(spark, d))).files.items()), "file string, digest string")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer ORDER BY c_custkey LIMIT 3")
def context_projection(spark, d):
    frame = from_parquet(spark, d, {"customer": ["c_custkey"]}).frames["customer"].select("__row", F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("phone"), F.col("c_nationkey").alias("n"))
    named = Table("customer", [Column("id"), Column("name"), Column("phone"), Column("n", comment="card password")])
    return Snapshot("s", {"customer": frame}, {"customer": named}, {}).context()["customer"]


@query("SELECT n_name AS name, FALSE AS whole FROM nation ORDER BY n_nationkey LIMIT 10")
def sequence_prefixes(spark, d):
    path = folder(spark) / "nations.yaml"
    path.write_text("".join(f"- name: {json.dumps(r.n_name)}\n" for r in table(spark, d, "nation").orderBy("n_nationkey").collect()))
    items, whole = sequence_prefix(str(path), 10)
    return spark.createDataFrame([(i["name"], whole) for i in items], "name string, whole boolean")


@query(rows_sql("profile VARCHAR, budget INT, exclude VARCHAR[], limits VARCHAR[]", [("values", 7, ["a.b.c"], ["fanout=8", "looks=0"])]))
def run_configuration(spark, d):
    path = folder(spark) / "run.yaml"
    path.write_text("folder: data\nprofile: values\nbudget: 7\nexclude: [a.b.c]\nlimits: {fanout: 8}\n")
    c = config.load(str(path))
    return spark.createDataFrame([(c.profile, c.budget, list(c.exclude), [f"{k}={v}" for k, v in sorted(c.limits.items())])], "profile string, budget int, exclude array<string>, limits array<string>")


@query("""SELECT r_name AS label, 'the region ' || r_name AS definition, CASE WHEN r_regionkey > 0 THEN ['Place'] ELSE [] END AS parents, NULL::VARCHAR AS error FROM region UNION ALL SELECT NULL, NULL, [], 'JSONDecodeError'""")
def entity_cards(spark, d):
    root = folder(spark)
    found = [{"entityName": r.r_name, "description": f"the region {r.r_name}"} | ({"extendsEntity": "Place"} if r.r_regionkey > 0 else {}) for r in table(spark, d, "region").collect()]
    (root / "a.cdm.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"definitions": [*found, {"note": "no entity"}]}).encode())
    (root / "b.cdm.json").write_text("{broken")
    return external.entity_cards(spark, str(root)).select("label", "definition", "parents", "error")


@query("""SELECT 'customer' AS kind, c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN ['e1', 'e2'] ELSE ['e1'] END AS evidence_ids FROM customer UNION ALL SELECT 'region', r_regionkey::VARCHAR, r_name, [] FROM region""")
def result_sink(spark, d):
    sink, customer = Sink(spark, f"{scratch(spark)}/sink-{uuid4().hex}"), table(spark, d, "customer")
    rows = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(F.lit("e1")).alias("evidence_ids"))
    sink.put("customer", rows)
    sink.put("customer", customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("later").alias("name"), F.array(F.lit("e2"), F.lit("e1")).alias("evidence_ids")), 1)
    sink.put("region", table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    return sink.items().select("kind", "id", F.get_json_object("body", "$.name").alias("name"), "evidence_ids")


@query("SELECT 'customer' AS kind, count(*) AS n, TRUE AS fits, TRUE AS counted FROM customer UNION ALL SELECT 'region', count(*), TRUE, TRUE FROM region")
def sink_shards(spark, d):
    at = f"{scratch(spark)}/sink-{uuid4().hex}"
    sink = Sink(spark, at)
    sink.put("customer", table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"))
    sink.put("region", table(spark, d, "region").select(F.col("r_regionkey").alias("id"), "r_name"))
    sink.export(f"{at}-json", 100)
    shards = spark.read.json(f"{at}-json").groupBy("kind", F.input_file_name().alias("file")).agg(F.count("*").alias("m"))
    found = shards.groupBy("kind").agg(F.sum("m").alias("n"), (F.max("m") <= 100).alias("fits"))
    return found.join(sink.count(), "kind").select("kind", "n", "fits", (F.col("n") == F.col("count")).alias("counted"))


@query("SELECT 'first' AS run, (SELECT count(*) FROM region) AS n UNION ALL SELECT 'again', (SELECT count(*) FROM region) UNION ALL SELECT 'other contract', (SELECT count(*) FROM nation)")
def stages_resumed(spark, d):
    at = f"{scratch(spark)}/stages-{uuid4().hex}"
    first = Stages(spark, at, {"snapshot": "s", "version": 1}).run("rows", lambda: table(spark, d, "region"))
    again = Stages(spark, at, {"snapshot": "s", "version": 1}).run("rows", lambda: table(spark, d, "nation"))
    other = Stages(spark, at, {"snapshot": "t", "version": 1}).run("rows", lambda: table(spark, d, "nation"))
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("run"), "n")
    return n("first", first).unionAll(n("again", again)).unionAll(n("other contract", other))


# --- values -----------------------------------------------------------------


@query(f"""WITH c AS (SELECT 'day' AS "column", strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders UNION ALL SELECT 'quarter', year(o_orderdate) || 'Q' || quarter(o_orderdate) FROM orders UNION ALL SELECT 'priority', o_orderpriority FROM orders
           UNION ALL SELECT 'half', CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) || '年' || month(o_orderdate) || '月' ELSE 'open' END FROM orders),
           s AS (SELECT "column", count(*) FILTER (WHERE trim(v) <> '') AS usable, count(*) FILTER (WHERE regexp_full_match(v, '{profile.TEMPORAL}')) AS temporal_values FROM c GROUP BY 1)
           SELECT *, usable > 0 AND temporal_values * 100 >= usable * 80 AS temporal FROM s""")
def temporal_columns(spark, d):
    day, text = F.col("o_orderdate"), lambda c: c.cast("string")
    month = F.concat(text(F.year(day)), F.lit("年"), text(F.month(day)), F.lit("月"))
    rows = table(spark, d, "orders").select(
        F.date_format(day, "yyyy-MM-dd").alias("day"), F.concat(text(F.year(day)), F.lit("Q"), text(F.quarter(day))).alias("quarter"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 2 == 0, month).otherwise("open").alias("half")
    )
    return profile.temporal_columns(rows, ["day", "quarter", "priority", "half"])


_KEYS = "CASE WHEN p_size % 2 = 0 THEN p_brand || '|' || p_size ELSE p_brand END AS a, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_size + 1 || '|' || p_type END AS b"


@query(f"SELECT count(DISTINCT (a, b)) AS tuple_keys, count(DISTINCT a || '|' || b) AS joined_keys, count(DISTINCT (a, b)) = count(DISTINCT a || '|' || b) AS joining_is_safe FROM (SELECT {_KEYS} FROM part) WHERE a IS NOT NULL AND b IS NOT NULL")
def key_probe(spark, d):
    size = F.col("p_size")
    a = F.when(size % 2 == 0, F.concat("p_brand", F.lit("|"), size.cast("string"))).otherwise(F.col("p_brand"))
    b = F.when(size % 2 == 0, F.col("p_type")).otherwise(F.concat((size + 1).cast("string"), F.lit("|"), F.col("p_type")))
    return profile.key_probe(table(spark, d, "part").select(a.alias("a"), b.alias("b")), ["a", "b"])


@query("SELECT count(*) FILTER (WHERE v = '007') AS raw_matches, count(*) FILTER (WHERE try_cast(v AS BIGINT) = 7) AS number_matches FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN '00' || p_size WHEN 1 THEN p_size::VARCHAR ELSE 'no ' || p_size END AS v FROM part)")
def code_probe(spark, d):
    size, third = F.col("p_size"), F.col("p_partkey") % 3
    v = F.when(third == 0, F.concat(F.lit("00"), size.cast("string"))).when(third == 1, size.cast("string")).otherwise(F.concat(F.lit("no "), size.cast("string")))
    return profile.code_probe(table(spark, d, "part").select(v.alias("v")), "v", "007")


@query("SELECT p_partkey AS row, coalesce(CASE WHEN p_size % 4 <> 0 THEN p_name END, p_brand) AS name FROM part ORDER BY md5(name), row LIMIT 40")
def named_sample(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_name")).otherwise(F.lit(" ")).alias("title"), F.col("p_brand").alias("label"))
    return profile.named_sample(rows, ["title", "label"], 40, "p_partkey")


@query("SELECT item_id, list_sort(list_distinct(list_concat(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9_]+'), ['指标', '标口', '口径', '指标口', '标口径', '率']))) AS terms FROM benchmark")
def search_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", terms_of(F.concat("text", F.lit(" 指标口径 率"))).alias("terms"))


@query("SELECT p_partkey, list_sort(list_distinct(list_concat(['=' || lower(p_name) || ' 指标口', 'g指标', 'g标口'], list_transform(regexp_extract_all(lower(p_name), '[a-z]{3,}'), lambda x: 'w' || x)))) AS cues FROM part")
def name_cues(spark, d):
    return table(spark, d, "part").select("p_partkey", cues_of(F.concat(F.upper("p_name"), F.lit("  指标口"))).alias("cues"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN NULL ELSE p_brand END AS class FROM part")
def class_clauses(spark, d):
    size = F.col("p_size")
    text = F.when(size % 3 == 0, F.concat(F.lit("It is a kind of "), F.col("p_type"), F.lit(". It sells."))).when(size % 3 == 1, F.concat(F.lit("It is a not "), F.col("p_type"))).otherwise(F.concat(F.lit("它属于"), F.col("p_brand"), F.lit("。")))
    return table(spark, d, "part").select("p_partkey", class_named(text).alias("class"))


@query(rows_sql("value VARCHAR, kind VARCHAR", [("+", "operator"), ("SUM", "operator"), (" revenue ", "operand"), ("revenue / cost", "formula"), ("12.5", "operand"), ("", "blank"), ("see the note, above", "text")]))
def formula_fragments(spark, d):
    return spark.createDataFrame([(v,) for v in ("+", "SUM", " revenue ", "revenue / cost", "12.5", "", "see the note, above")], "value string").select("value", fragment_kinds("value").alias("kind"))


@query("""WITH f AS (SELECT n_nationkey AS k, 'm' || n_nationkey || ' = gain' || n_nationkey || ' / (cost + 5%)' AS formula FROM nation)
          SELECT k, 'gain' || k AS symbol, '/0' AS path, 'numerator' AS role, (strpos(formula, 'gain') - 1)::INT AS start, (strpos(formula, 'gain') - 1 + 4 + length(k::VARCHAR))::INT AS "end" FROM f
          UNION ALL SELECT k, 'cost', '/1/0', 'addend', (strpos(formula, 'cost') - 1)::INT, (strpos(formula, 'cost') + 3)::INT FROM f""")
def formula_symbols(spark, d):
    k = F.col("n_nationkey").cast("string")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), parsed(F.concat(F.lit("m"), k, F.lit(" = gain"), k, F.lit(" / (cost + 5%)"))).alias("p"))
    return rows.select("k", F.explode("p.symbols").alias("s")).select("k", "s.*")


_FORMULAS = ("total = price * count", "mean(x)", "x ^ 2", "a % b", "x == y", "", "price per item and more, see below", "a +", "(a + b")


@query(rows_sql("formula VARCHAR, status VARCHAR, assignment VARCHAR", [
    ("total = price * count", "parsed", "total"), ("mean(x)", "parsed", None), ("x ^ 2", "parsed", None), ("a % b", "parsed", None), ("x == y", "unresolved", None), ("", "unresolved", None),
    ("price per item and more, see below", "unresolved", None), ("a +", "unresolved", None), ("(a + b", "unresolved", None),
]))
def formula_statuses(spark, d):
    return spark.createDataFrame([(f, parse(f)["status"], parse(f)["assignment"]) for f in _FORMULAS], "formula string, status string, assignment string")


@query("SELECT n_nationkey AS k, n_nationkey % 2 = 0 AS equal FROM nation")
def formula_keys(spark, d):
    k = F.col("n_nationkey").cast("string")
    other = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("(a*"), k, F.lit(")+b"))).otherwise(F.concat(F.lit("a * ("), k, F.lit(" + b)")))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), parsed(F.concat(F.lit("total = a * "), k, F.lit(" + b"))).alias("p"), parsed(other).alias("q"))
    return rows.select("k", (F.col("p.signature") == F.col("q.signature")).alias("equal"))


@query("SELECT n_nationkey AS k, n_nationkey % 3 = 1 AS tells FROM nation")
def meaning_in_json(spark, d):
    k = F.col("n_nationkey")
    wrapped = F.when(k % 3 == 0, F.to_json(F.struct(F.col("n_name").alias("created_term"), F.lit("x").alias("status")))).when(k % 3 == 1, F.to_json(F.struct(F.lit("x").alias("status"), F.col("n_name").alias("unit_definition"))))
    empty = F.when(k % 2 == 0, '{"alias": [], "term": null, "formula": ""}').otherwise('{"alias": ["cut')
    return table(spark, d, "nation").select(k.alias("k"), cards.tells_meaning(F.coalesce(wrapped, empty)).alias("tells"))


# --- references, recall and retrieval ---------------------------------------


@query(f"""WITH l AS ({_LINKS}), r AS (SELECT *, row_number() OVER (PARTITION BY target_row ORDER BY source_row)::INT AS turn FROM l)
           SELECT *, (SELECT count(DISTINCT target_row) FROM l) AS targets FROM r ORDER BY turn, source_row, target_row LIMIT 50""")
def witnessed_targets(spark, d):
    return facts.witnesses(_order_links(spark, d), 50)


@query(f"""WITH d AS ({_DICT_SQL}), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY md5(value), value) AS pos FROM d) WHERE pos <= 60)
           SELECT a.field AS "left", b.field AS "right", count(*) AS common_values, bool_and(regexp_full_match(a.value, '[+-]?[0-9]+(\\.[0-9]+)?')) AS numeric_only FROM s a JOIN s b ON a.value = b.value AND a.field < b.field GROUP BY ALL""")
def sampled_value_pairs(spark, d):
    return recall.shared_values(recall.sampled(_dictionary(spark, d), 60))


@query("""WITH src AS (SELECT p_partkey AS row, CASE WHEN p_size % 5 = 0 THEN 'nothing' ELSE upper(p_brand) || ' ' || p_partkey END AS ref FROM part),
          tgt AS (SELECT p_partkey AS row, lower(trim(unnest(string_split(concat_ws('; ', p_name, upper(p_name), p_brand || ' ' || p_partkey), ';')))) AS key FROM part
                  UNION SELECT p_partkey, lower(concat_ws('; ', p_name, upper(p_name), p_brand || ' ' || p_partkey)) FROM part),
          m AS (SELECT src.row, min(tgt.row) AS t FROM src JOIN tgt ON lower(src.ref) = tgt.key GROUP BY src.row HAVING count(DISTINCT tgt.row) = 1)
          SELECT src.row AS source_row, ref AS item, CASE WHEN t IS NULL THEN 'missing_or_ambiguous_target' ELSE 'matched' END AS outcome, t AS target_row FROM src LEFT JOIN m USING (row)""")
def relation_transformed(spark, d):
    part = table(spark, d, "part")
    ref = F.when(F.col("p_size") % 5 == 0, "nothing").otherwise(F.concat(F.upper("p_brand"), F.lit(" "), F.col("p_partkey").cast("string")))
    plan = relations.RelationPlan("p", "points_to", "ref", "aliases", transform="target_alias_items", source_row="p_partkey", target_row="p_partkey")
    return relations.outcomes(part.select("p_partkey", ref.alias("ref")), part.select("p_partkey", _aliases().alias("aliases")), plan)


@query("SELECT DISTINCT o_orderkey AS source_row, o_custkey AS target_row FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0")
def replayed_pairs(spark, d):
    orders, key = table(spark, d, "orders"), F.col("o_orderkey")
    found = orders.select(key.alias("source_row"), F.when(key % 4 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("target_row"))
    return instances.replay(found, orders.where(key % 5 != 0).select(key.alias("row")), _order_links(spark, d))


@query("SELECT count(*) AS rows, min(p_partkey) AS first_row FROM part GROUP BY p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END")
def card_rows(spark, d):
    rows = table(spark, d, "part").withColumn("kind", F.when(F.col("p_size") % 2 == 0, F.col("p_type")))
    return cards.card_sources(rows, ["p_brand", "kind"], "p_partkey").groupBy("card_id").agg(F.count("*").alias("rows"), F.min("row").alias("first_row")).drop("card_id")


@query("SELECT DISTINCT 'c' || o_custkey * 2 AS record_id, c_custkey AS row FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2")
def located_witnesses(spark, d):
    name = lambda c: F.concat(F.lit("c"), c.cast("string")).alias("record_id")
    return packets.located(table(spark, d, "orders").select(name(F.col("o_custkey") * 2)), table(spark, d, "customer").select(name(F.col("c_custkey")), F.col("c_custkey").alias("row")))


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source IN (SELECT min(source) FROM documents UNION SELECT max(source) FROM documents) AND doc_id % 3 <> 2 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def card_search_filters(spark, d):
    docs = table(spark, d, "documents")
    ends = docs.agg(F.min("source").alias("a"), F.max("source").alias("b")).first()
    scope = F.when(F.col("doc_id") % 3 == 1, "mine").when(F.col("doc_id") % 3 == 2, "other")
    made = docs.select("doc_id", F.col("lang").alias("kind"), F.col("source").alias("table_name"), F.lit("Term").alias("root"), scope.alias("scope"))
    return retrieval.among(made, kinds=["en", "de"], tables=[ends["a"], ends["b"]], roots=["Term"], scope="mine", without=table(spark, d, "labels")).select("doc_id")


# --- replay -----------------------------------------------------------------


@query("""WITH f AS (SELECT p_partkey AS row, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS template_row FROM part)
          SELECT row, CASE WHEN row % 10 = 1 THEN 'row_gone' WHEN template_row % 10 = 1 THEN 'template_gone' WHEN row % 10 = 0 THEN 'row_changed' WHEN template_row % 10 = 0 THEN 'template_changed' END AS reason FROM f""")
def replayed_memberships(spark, d):
    part, meaning = table(spark, d, "part"), ["p_brand", "p_type"]
    least = types.canonical(part, meaning, "p_partkey").withColumnRenamed("canonical_id", "template_row")
    found = part.select("p_partkey", cards.signature(meaning).alias("fingerprint")).join(least, "p_partkey").select(F.col("p_partkey").alias("row"), F.lit("t").alias("type_id"), "template_row", "fingerprint")
    now = part.where("p_partkey % 10 != 1").withColumn("p_type", F.when(F.col("p_partkey") % 10 == 0, "changed").otherwise(F.col("p_type")))
    return instances.replayed_memberships(found, now, meaning, "p_partkey").select("row", "reason")


@query(rows_sql("id BIGINT, target_id BIGINT", [(5, 6), (21, 22), (24, 25)]))
def retracted_dependencies(spark, d):
    formulas, names = _metrics(spark, d)
    earlier = formulas.select("id", (F.col("id") + 1).alias("target_id"))
    return types.retracted(earlier, types.bind_formulas(formulas, names))


@query("SELECT p_partkey AS binding_id, p_partkey AS target_id, p_partkey % 2 <> 0 AS holds FROM part WHERE p_size % 3 <> 0")
def proven_slots(spark, d):
    part, name = table(spark, d, "part"), F.concat_ws(" ", "p_name", "p_partkey")
    slots = part.select(F.col("p_partkey").alias("binding_id"), F.lit("product").alias("slot"), F.when(F.col("p_size") % 3 == 0, "nothing").otherwise(name).alias("value"))
    bound = packets.slot_targets(slots, part.select(F.col("p_partkey").alias("id"), name.alias("name")))
    now = bound.withColumn("target_id", F.when(F.col("binding_id") % 2 == 0, F.col("target_id") + 1).otherwise(F.col("target_id")))
    return packets.still_proven(packets.proven(bound), now).select("binding_id", "target_id", "holds")


# --- gates ------------------------------------------------------------------


@query("SELECT p_partkey AS decision_id, CASE p_size % 4 WHEN 0 THEN [] WHEN 1 THEN ['clause_not_found'] WHEN 2 THEN ['negated'] ELSE ['blank_part'] END::VARCHAR[] AS errors FROM part")
def clause_gate(spark, d):
    size, said = F.col("p_size") % 4, F.concat(F.col("p_brand"), F.lit(" contains "), F.col("p_type"))
    text = F.when(size == 1, F.concat("p_brand", F.lit(" contains other things"))).when(size == 2, F.concat(F.lit("it is not so that "), said)).otherwise(F.concat(F.lit("Here  "), said, F.lit(".")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("decision_id"), text.alias("text"), F.when(size == 3, " ").otherwise(F.col("p_brand")).alias("subject"), F.lit("contains").alias("cue"), F.col("p_type").alias("object"))
    return gates.clauses(rows).select("decision_id", "errors")


@query("SELECT p_partkey AS decision_id, CASE WHEN p_size % 5 = 0 THEN ['formula_not_parsed', 'target_is_no_symbol'] WHEN p_size % 2 = 1 THEN ['target_is_no_symbol'] ELSE [] END::VARCHAR[] AS errors FROM part")
def dependency_gate(spark, d):
    size = F.col("p_size")
    formula = F.when(size % 5 == 0, "as agreed, see below").otherwise(F.concat(F.lit("f = item"), size.cast("string"), F.lit(" * rate")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("decision_id"), formula.alias("formula"), F.when(size % 2 == 1, "item").otherwise(F.concat(F.lit("item"), size.cast("string"))).alias("target_name"))
    return gates.dependencies(rows).select("decision_id", "errors")


@query(rows_sql("parent_id VARCHAR, errors VARCHAR[]", [
    ("good", []), ("alone", ["fewer_than_two_children"]), ("measures", ["measures_do_not_generalise"]), ("units", ["several_units"]), ("texts", ["texts_differ"]), ("same record", ["repeated_record"]),
]))
def generalisation_gate(spark, d):
    child = lambda parent, k, term, root="Metric", unit="t", record=None, text="load of {} ships": (parent, f"{parent}{k}", root, unit, record or f"{parent}-r{k}", text.format(term), term)
    rows = [
        child("good", 1, "dry"), child("good", 2, "wet"), child("alone", 1, "dry"), child("measures", 1, "dry", "Measure"), child("measures", 2, "wet", "Measure"), child("units", 1, "dry"), child("units", 2, "wet", unit="kg"),
        child("texts", 1, "dry"), child("texts", 2, "wet", text="speed of {} ships"), child("same record", 1, "dry", record="r"), child("same record", 2, "wet", record="r"),
    ]
    return gates.generalisations(spark.createDataFrame(rows, "parent_id string, type_id string, root string, unit string, record_id string, text string, term string")).select("parent_id", "errors")


@query(rows_sql("left VARCHAR, right VARCHAR, errors VARCHAR[], canonical_id VARCHAR", [
    ("a", "b", [], "a"), ("c", "a", ["descriptions_differ"], "a"), ("a", "d", ["formulas_differ"], "a"), ("a", "e", ["same_record"], "a"), ("g", "f", ["no_description"], "f"),
]))
def equivalence_gate(spark, d):
    made = [("a", "r1", "Load, of ships", "x = p*q"), ("b", "r2", "load of ships.", "p * q"), ("c", "r3", "speed of ships", "p*q"), ("d", "r4", "load of ships", "p+q"), ("e", "r1", "load of ships", "p*q"), ("f", "r6", "", None), ("g", "r7", None, "")]
    pairs = [("a", "b"), ("c", "a"), ("a", "d"), ("a", "e"), ("g", "f")]
    return gates.equivalences(spark.createDataFrame(pairs, "left string, right string"), spark.createDataFrame(made, "id string, record_id string, description string, formula string")).drop("accepted")


@query(rows_sql("decision_id VARCHAR, errors VARCHAR[]", [
    ("good", []), ("unknown", ["column_unknown", "quote_is_no_declaration", "object_not_declared", "quantity_not_declared", "identity_not_constant"]), ("quote", ["quote_is_no_declaration"]), ("same", ["object_is_the_quantity"]), ("unit", ["unit_not_said"]), ("identity", ["identity_not_constant"]),
]))
def fact_schema_gate(spark, d):
    said = "daily load of a berth in tonnes"
    made = lambda i, column="load", obj="berth", quantity="load", unit="t", quote=said, identity=("Ostend",): (i, "calls", column, obj, quantity, unit, quote, list(identity))
    rows = [made("good"), made("unknown", column="none", identity=()), made("quote", quote="daily load"), made("same", obj="Load"), made("unit", unit=" "), made("identity", identity=("Bergen",))]
    decisions = spark.createDataFrame(rows, "decision_id string, table string, column string, object string, quantity string, unit string, quote string, identity array<string>")
    return gates.fact_schemas(decisions, spark.createDataFrame([("calls", "load", said, ["Ostend"])], "table string, column string, declaration string, constants array<string>")).select("decision_id", "errors")


@query(rows_sql("column VARCHAR, classifies BOOLEAN", [("a", True), ("b", False), ("c", True), ("d", False), ("e", False)]))
def classification_columns(spark, d):
    rows = [("t", "a", "category of the part"), ("t", "b", "category of the tenant"), ("t", "c", "指标分类"), ("t", "d", "classification version"), ("t", "e", None)]
    return gates.classification_columns(spark.createDataFrame(rows, "table string, column string, comment string")).select("column", "classifies")


_TEMPLATES = {
    "good": ({"fields": {"text": "load of {kind}"}, "slots": ["kind"]}, ()), "case": ({"fields": {"text": "load of {Kind}"}, "slots": ["Kind"]}, ()), "undeclared": ({"fields": {"text": "load of {kind}"}, "slots": []}, ()),
    "protected": ({"fields": {"text": "load of {kind}"}, "slots": ["kind"]}, ("text",)), "no match": ({"fields": {"text": "speed of {kind}"}, "slots": ["kind"]}, ()), "fixed": ({"fields": {"text": "load of {kind}", "note": "{same}"}, "slots": ["kind", "same"]}, ()),
}


@query(rows_sql("template VARCHAR, errors VARCHAR[]", [("good", []), ("case", ["slot_not_snake_case", "witness_does_not_match"]), ("undeclared", ["slots_not_as_declared"]), ("protected", ["slot_in_protected_field"]), ("no match", ["witness_does_not_match"]), ("fixed", ["slot_does_not_vary"])]))
def template_gate(spark, d):
    seen = [{"text": "load of ships", "note": "n"}, {"text": "load of trains", "note": "n"}]
    return spark.createDataFrame([(name, gates.template_errors(t, seen, frozenset(p))) for name, (t, p) in _TEMPLATES.items()], "template string, errors array<string>")


@query(rows_sql("error VARCHAR", [("type b: no known root",), ("relation r2: unknown root likes",), ("relation r2: unknown range",), ("relation r2: no field calls.none",), ("relation r3: range is wider than its parent's",), ("r3: evidence missing",)]))
def plan_gate(spark, d):
    made = [{"id": "a", "parent": "Term", "evidence_ids": ["e"]}, {"id": "a1", "parent": "a", "evidence_ids": ["e"]}, {"id": "b", "parent": "b", "evidence_ids": ["e"]}]
    base = {"parent": "has", "domain": "a", "range": "a1", "source_table": "calls", "source_column": "berth", "target_table": "berths", "target_column": "no", "evidence_ids": ["e"]}
    linked = [base | {"id": "r1"}, base | {"id": "r2", "parent": "likes", "range": "z", "source_column": "none"}, base | {"id": "r3", "range": "a", "narrows": {"range": "a1"}, "evidence_ids": []}]
    return spark.createDataFrame([(e,) for e in gates.plan_errors(made, linked, {"calls": {"berth"}, "berths": {"no"}}, {"e"})], "error string")


@query(rows_sql("case VARCHAR, outcome VARCHAR", [("adds", "a b"), ("same again", "a"), ("overwrites", "conflict in types: a"), ("foreign", "relation r does not start in calls")]))
def delta_merge(spark, d):
    core = {"types": {"a": {"root": "Term"}}}
    deltas = {"adds": {"types": {"b": {"root": "Metric"}}}, "same again": {"types": {"a": {"root": "Term"}}}, "overwrites": {"types": {"a": {"root": "Metric"}}}, "foreign": {"relations": {"r": {"source_table": "berths"}}}}

    def outcome(delta) -> str:
        try:
            return " ".join(sorted(gates.merge_delta(core, delta, "calls")["types"]))
        except ValueError as e:
            return str(e)

    return spark.createDataFrame([(name, outcome(x)) for name, x in deltas.items()], "case string, outcome string")


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 2 = 0 AS e, o_orderkey % 3 <> 0 AS m, o_orderstatus, o_orderpriority FROM orders), j AS (SELECT *, c_custkey IS NOT NULL AND c % 5 <> 0 AS t FROM o LEFT JOIN customer ON c_custkey = c)
          SELECT k AS pair_id, CASE WHEN e THEN o_orderstatus WHEN m THEN o_orderpriority END AS source_type, CASE WHEN t THEN c_mktsegment END AS target_type,
                 list_filter([CASE WHEN k % 7 = 0 THEN 'unknown_predicate' END, CASE WHEN NOT e AND NOT m THEN 'source_has_no_type' END, CASE WHEN NOT t THEN 'target_has_no_type' END, CASE WHEN NOT e AND m AND t AND c % 2 <> c % 3 THEN 'scopes_differ' END], lambda x: x IS NOT NULL) AS errors FROM j""")
def business_relation_gate(spark, d):
    orders, customer, key = table(spark, d, "orders"), table(spark, d, "customer"), F.col("o_orderkey")
    name = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    exact = orders.where(key % 2 == 0).select(name("o", key).alias("record_id"), F.col("o_orderstatus").alias("type_id"), F.lit(None).cast("string").alias("scope"))
    exact = exact.unionAll(customer.where("c_custkey % 5 != 0").select(name("c", F.col("c_custkey")), "c_mktsegment", (F.col("c_custkey") % 3).cast("string")))
    matched = orders.where(key % 3 != 0).select(name("o", key).alias("record_id"), F.col("o_orderpriority").alias("type_id"), (F.col("o_custkey") % 2).cast("string").alias("scope"))
    pairs = orders.select(key.alias("pair_id"), F.when(key % 7 == 0, "likes").otherwise("related_to").alias("predicate"), name("o", key).alias("source_record"), name("c", F.col("o_custkey")).alias("target_record"))
    return gates.business_relations(pairs, gates.resolved(exact, matched)).select("pair_id", "source_type", "target_type", "errors")


@query(rows_sql("decision_id VARCHAR, errors VARCHAR[]", [
    ("declared", []), ("by text", []), ("unchecked", ["rule_not_checked", "pair_not_checked"]), ("denied", ["reference_denied"]), ("unsaid", ["reference_not_said"]), ("elsewhere", ["target_refers_elsewhere"]), ("own key", []), ("no definition", ["target_defines_nothing"]),
]))
def definition_reference_gate(spark, d):
    def made(i, status="checked_technical", paired=True, source="refers to the term", target="number of the term", of="glossary of terms", texts=("a load",), defined=("the load is what a ship takes",)):
        return i, status, paired, source, target, of, list(texts), ["tonnage"], list(defined)

    rows = [
        made("declared"), made("by text", source="term number", texts=("this refers to tonnage",)), made("unchecked", status="unresolved", paired=False), made("denied", source="does not refer to a term, references none"),
        made("unsaid", source="a number"), made("elsewhere", target="foreign key of the norm"), made("own key", target="refers to its own row", defined=("definition: what a ship takes",)), made("no definition", of="list of rows"),
    ]
    schema = "decision_id string, rule_status string, paired boolean, source_declaration string, target_declaration string, target_table_declaration string, source_texts array<string>, target_names array<string>, target_texts array<string>"
    return gates.definition_references(spark.createDataFrame(rows, schema)).select("decision_id", "errors")


@query("""SELECT n_nationkey AS k, 'relation:' || substr(sha256('["contains", "region:' || n_regionkey || '", "nation:' || n_nationkey || '", {}]'), 1, 24) AS id FROM nation""")
def relation_names(spark, d):
    rows = [(r.n_nationkey, gates.relation_id("contains", f"region:{r.n_regionkey}", f"nation:{r.n_nationkey}")) for r in table(spark, d, "nation").collect()]
    return spark.createDataFrame(rows, "k int, id string")


# --- budgets ----------------------------------------------------------------


def _placed(spark, items: list[int]) -> DataFrame:
    return spark.createDataFrame([(k, at) for at, k in enumerate(items, 1)], "k int, place int")


_ITEMS = "i AS (SELECT k::INT AS k, 't' || k % 3 AS t, 'f' || k % 5 AS f, 'b' || k // 7 % 2 AS b, 'x' || k // 5 % 3 AS x FROM range(60) r(k))"
_SOURCE = lambda k: (f"t{k % 3}", f"f{k % 5}")


@query(f"""WITH {_ITEMS}, a AS (SELECT *, row_number() OVER (PARTITION BY t, f ORDER BY k DESC) AS p FROM i), b AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p, f) AS q FROM a)
           SELECT k, row_number() OVER (ORDER BY q, t)::INT AS place FROM b""")
def fair_source_order(spark, d):
    return _placed(spark, budgets.fair_sources(range(60), _SOURCE, lambda k: (-k,)))


@query(f"""WITH {_ITEMS}, a AS (SELECT *, row_number() OVER (PARTITION BY t, f, b, x ORDER BY k) AS p FROM i), c AS (SELECT *, row_number() OVER (PARTITION BY t, f, b ORDER BY p, x) AS q FROM a),
           e AS (SELECT *, row_number() OVER (PARTITION BY t, f ORDER BY q, b) AS r FROM c) SELECT k, row_number() OVER (ORDER BY r, t, f)::INT AS place FROM e""")
def fair_branch_order(spark, d):
    return _placed(spark, budgets.fair_branches(range(60), _SOURCE, lambda k: f"b{k // 7 % 2}", lambda k: f"x{k // 5 % 3}"))


@query("""WITH i AS (SELECT k::INT AS k, k % 10 = 9 AS c FROM range(60) r(k)), a AS (SELECT k FROM i WHERE c ORDER BY k LIMIT 4), b AS (SELECT k FROM i WHERE k NOT IN (SELECT k FROM a) ORDER BY k LIMIT 8)
          SELECT k, row_number() OVER (ORDER BY k)::INT AS place FROM (FROM a UNION ALL FROM b)""")
def budget_split(spark, d):
    return _placed(spark, budgets.within_budget(range(60), 12, lambda k: k % 10 == 9, lambda k: "t", 60)[0])


@query("WITH i AS (SELECT k::INT AS k, CASE WHEN k < 20 THEN 0 WHEN k < 25 THEN 1 ELSE 2 END AS tier FROM range(60) r(k)), p AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY k) - 1 AS pos FROM i) SELECT k, row_number() OVER (ORDER BY pos // [4, 2, 1][tier + 1], tier, pos)::INT AS place FROM p")
def weighted_turn_order(spark, d):
    return _placed(spark, budgets.weighted_turns([range(20), range(20, 25), range(25, 60)]))


@query("""WITH g AS (SELECT 'n' || c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT g, floor(sqrt(n * 10000)) / k AS w FROM g, range(2, 100000) r(k) WHERE k <= n),
          m AS (SELECT g FROM s ORDER BY w DESC, g DESC LIMIT (SELECT 60 - count(*) FROM g)) SELECT g, n, (1 + (SELECT count(*) FROM m WHERE m.g = g.g))::INT AS seeds FROM g""")
def seed_shares(spark, d):
    sizes = {f"n{r.c_nationkey}": r["count"] for r in table(spark, d, "customer").groupBy("c_nationkey").count().collect()}
    share = budgets.seed_shares(sizes, 60)
    return spark.createDataFrame([(g, n, share[g]) for g, n in sizes.items()], "g string, n long, seeds int")


@query(f"""WITH {_ITEMS}, v AS (SELECT *, k % 2 AS tier, row_number() OVER (PARTITION BY k % 2, t, f, x ORDER BY k) AS variant, min(k) OVER (PARTITION BY k % 2, t, f, x) AS head FROM i), h AS (SELECT DISTINCT tier, t, f, x, head FROM v),
           a AS (SELECT *, row_number() OVER (PARTITION BY tier, t, f ORDER BY head) AS p FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY tier, t ORDER BY p, f) AS q FROM a),
           c AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY q, t) AS o FROM b) SELECT k, row_number() OVER (ORDER BY tier, variant, o)::INT AS place FROM v JOIN c USING (tier, t, f, x)""")
def family_order(spark, d):
    return _placed(spark, budgets.families_in_turn(range(60), lambda k: (k % 2,), lambda k: (_SOURCE(k), k // 5 % 3), _SOURCE, lambda k: (k,)))


@query(f"""WITH {_ITEMS}, a AS (SELECT *, row_number() OVER (PARTITION BY t, f, x ORDER BY k DESC) AS p, max(k) OVER (PARTITION BY t, f, x) AS best FROM i), b AS (SELECT *, row_number() OVER (PARTITION BY t, f ORDER BY p, best DESC) AS q FROM a),
           c AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY q, f) AS r FROM b) SELECT k, row_number() OVER (ORDER BY r, t)::INT AS place FROM c""")
def alias_order(spark, d):
    return _placed(spark, budgets.targets_in_turn(range(60), _SOURCE, lambda k: k // 5 % 3, lambda k: (-k,)))


@query("""WITH RECURSIVE e(a, b) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in SCHEMA_EDGES) + """), n AS (SELECT a AS t FROM e UNION SELECT b FROM e), p(t, u) AS (SELECT a, b FROM e UNION SELECT p.t, e.b FROM p JOIN e ON p.u = e.a)
          SELECT t, TRUE AS after_all FROM n""")
def table_order(spark, d):
    needs: dict[str, set[str]] = {}
    for a, b in SCHEMA_EDGES:
        needs.setdefault(a, set()).add(b)
        needs.setdefault(b, set())
    order, _ = graphs.table_order(needs)
    return spark.createDataFrame([(t, all(order.index(b) < order.index(t) for b in needs[t])) for t in order], "t string, after_all boolean")


# --- discovery --------------------------------------------------------------

_SMALL = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "supplier": ["s_suppkey", "s_name", "s_nationkey"]}
_CELLS = "c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{t}.{f}' AS f, {f}::VARCHAR AS v FROM {t}" for t, fields in _SMALL.items() for f in fields) + ")"


def _found_rules(spark, found: dict) -> DataFrame:
    row = lambda r: (".".join(r["source"]), ".".join(r["target"]), next((f"{k}={v}" for k, v in r["selector"].items()), None), r["status"], r["checks"]["eligible_references"], r["checks"]["unique_matches"])
    return spark.createDataFrame([row(r) for r in found["rules"]], "source string, target string, selector string, status string, eligible long, uniques long")


@query(f"""WITH {_CELLS}, k AS (SELECT t, f, v, count(*) AS n FROM c WHERE v IS NOT NULL AND trim(v) <> '' GROUP BY ALL), p AS (SELECT a.f AS source, b.f AS target FROM k a JOIN k b ON a.v = b.v AND a.t <> b.t GROUP BY ALL),
           m AS (SELECT source, target, sum(a.n)::BIGINT AS eligible, coalesce(sum(a.n) FILTER (WHERE b.n = 1), 0)::BIGINT AS uniques FROM p JOIN k a ON a.f = source LEFT JOIN k b ON b.f = target AND b.v = a.v GROUP BY ALL)
           SELECT source, target, NULL::VARCHAR AS selector, CASE WHEN uniques = 0 THEN 'unresolved' WHEN uniques = eligible THEN 'checked_technical' ELSE 'observed_subset' END AS status, eligible, uniques FROM m""")
def discovered_rules(spark, d):
    whole = from_parquet(spark, d, {t: f[:1] for t, f in _SMALL.items()})
    small = Snapshot(whole.id, {t: whole.frames[t].select("__row", *f) for t, f in _SMALL.items()}, {t: Table(t, [Column(c) for c in f]) for t, f in _SMALL.items()}, {})
    return _found_rules(spark, discovery.discover(small, budget=1000, looks=0))


@query("""WITH k AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS l, (SELECT count(*) FROM supplier) AS s)
          SELECT 'links.ref' AS source, 'customer.code' AS target, NULL::VARCHAR AS selector, 'observed_subset' AS status, l + s AS eligible, l AS uniques FROM k UNION ALL SELECT 'links.ref', 'supplier.code', NULL, 'observed_subset', l + s, s FROM k
          UNION ALL SELECT 'links.ref', 'customer.code', 'kind=customer', 'checked_technical', l, l FROM k UNION ALL SELECT 'links.ref', 'supplier.code', 'kind=supplier', 'checked_technical', s, s FROM k
          UNION ALL SELECT 'customer.code', 'links.ref', NULL, 'observed_subset', c, l FROM k UNION ALL SELECT 'supplier.code', 'links.ref', NULL, 'checked_technical', s, s FROM k
          UNION ALL SELECT 'customer.code', 'supplier.code', NULL, 'unresolved', c, 0 FROM k UNION ALL SELECT 'supplier.code', 'customer.code', NULL, 'unresolved', s, 0 FROM k""")
def discovered_selectors(spark, d):
    code = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("__row"), code("C", "c_custkey").alias("code"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("__row"), code("S", "s_suppkey").alias("code"))
    named = lambda df, kind: df.select("__row", F.lit(kind).alias("kind"), F.col("code").alias("ref"))
    links = named(customer.where("__row % 3 = 0"), "customer").unionAll(named(supplier.withColumn("__row", -F.col("__row") - 1), "supplier"))
    frames = {"links": links, "customer": customer, "supplier": supplier}
    snapshot = Snapshot("s", frames, {t: Table(t, [Column(c) for c in df.columns if c != "__row"]) for t, df in frames.items()}, {})
    return _found_rules(spark, discovery.discover(snapshot, budget=1000))


@query(rows_sql("case VARCHAR, status VARCHAR", [
    ("no eligible row", "unresolved"), ("none unique", "unresolved"), ("some", "observed_subset"), ("all", "checked_technical"), ("run whole", "complete"), ("run cut", "partial"), ("run with an error", "partial"), ("run of errors", "failed"),
]))
def statuses(spark, d):
    rule = lambda n, u: discovery.rule_status({"eligible_references": n, "unique_matches": u})
    rows = [("no eligible row", rule(0, 0)), ("none unique", rule(5, 0)), ("some", rule(5, 3)), ("all", rule(5, 5))]
    rows += [("run whole", discovery.run_status({"checked": 3, "queued_by_budget": 0})), ("run cut", discovery.run_status({"checked": 3, "branch_queued": 2})), ("run with an error", discovery.run_status({"checked": 3}, 1)), ("run of errors", discovery.run_status({"checked": 3}, 3))]
    return spark.createDataFrame(rows, "case string, status string")


_SHARE = lambda v, c: f"""SELECT * FROM (SELECT '{v}' AS value_column, *, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS distinct_value_count FROM (SELECT l_returnflag, l_linestatus, {c}::DECIMAL(18,2)::VARCHAR AS observation_value,
    count(*) AS source_row_count, min(l_orderkey) AS source_row_min, max(l_orderkey) AS source_row_max FROM lineitem WHERE {c} IS NOT NULL AND trim(l_returnflag) <> '' AND trim(l_linestatus) <> '' GROUP BY ALL))
    ORDER BY md5(concat_ws(chr(31), l_returnflag, l_linestatus, observation_value)), observation_value LIMIT 100"""  # noqa: E731


@query(f"SELECT * FROM ({_SHARE('quantity', 'l_quantity')}) UNION ALL SELECT * FROM ({_SHARE('price', 'l_extendedprice')})")
def fact_candidates(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("price"))
    return facts.fact_candidates(lines, ["l_returnflag", "l_linestatus"], ["quantity", "price"], 200, "l_orderkey", most=None)[0]
