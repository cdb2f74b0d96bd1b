"""The catalogue as data: proposals for metadata stores, nodes and edges for graphs and viewers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.retrieval import hashed_weights, rerank
from ..plans.roles import Table, column_role, sensitive

#: Generic types by the native type's beginning; arrays come before what they are arrays of.
GENERIC_TYPES = (
    (r".*\[\]$|array\b", "ArrayType"), (r"bool", "BooleanType"), (r"(?:small|big|tiny)?int|integer|numeric|decimal|real|float|double|money|(?:big)?serial", "NumberType"),
    (r"date\b", "DateType"), (r"time", "TimeType"), (r"bytea|blob|(?:var)?binary", "BytesType"),
)


def generic_type(native: str) -> str:
    name = native.strip().lower()
    return next((generic for pattern, generic in GENERIC_TYPES if re.match(pattern, name)), "StringType")


def proposals(tables: dict[str, Table], platform: str = "postgres", environment: str = "PROD") -> list[dict]:
    """Two aspects of each table, properties and schema, as upserts; in order, so that runs agree."""
    out = []
    for name, table in sorted(tables.items()):
        urn = f"urn:li:dataset:(urn:li:dataPlatform:{platform},{name},{environment})"
        fields = [{"fieldPath": c.name, "nativeDataType": c.type, "type": generic_type(c.type), "description": c.comment, "isPartOfKey": c.name in table.pk} for c in table.columns]
        for aspect, body in (("datasetProperties", {"name": name, "description": table.comment}), ("schemaMetadata", {"schemaName": name, "fields": fields, "primaryKeys": table.pk})):
            out.append({"entityType": "dataset", "entityUrn": urn, "changeType": "UPSERT", "aspectName": aspect, "aspect": body})
    return out


def missing_proposals(written: list[dict], read: list[dict]) -> list[tuple[str, str]]:
    """(entity, aspect) that a store does not hold as written."""
    there = {(p["entityUrn"], p["aspectName"]): p["aspect"] for p in read}
    return sorted((p["entityUrn"], p["aspectName"]) for p in written if there.get((p["entityUrn"], p["aspectName"])) != p["aspect"])


def graph(spark: SparkSession, tables: dict[str, Table]) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind, role) of tables and fields, and edges (a, b, type): has_field, declared_fk."""
    nodes, edges = [], []
    for t, table in sorted(tables.items()):
        nodes.append((t, "table", None))
        for c in table.columns:
            nodes.append((f"{t}.{c.name}", "field", column_role(c, table)[0]))
            edges.append((t, f"{t}.{c.name}", "has_field"))
        edges += [(f"{t}.{c}", f"{to}.{k}", "declared_fk") for c, to, k in table.foreign_keys]
    return spark.createDataFrame(nodes, "node string, kind string, role string"), spark.createDataFrame(edges, "a string, b string, type string")


def direct_mapping(tables: dict[str, Table]) -> list[dict]:
    """Every table a record type, every column an attribute of it: nothing of the source is lost."""
    return [{"table": t, "type": f"source_record_type:{t}", "attributes": {f"column:{t}.{c.name}": c.name for c in table.columns}} for t, table in sorted(tables.items())]


def similar_tables(spark: SparkSession, tables: dict[str, Table], accepted: list[str], k: int = 5, native: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): for each table the k accepted ones described most alike.  It is context, not a relation."""
    said = lambda t: " ".join([t.name, t.comment, *(c.comment or c.name for c in t.columns if not sensitive(c))])
    texts = spark.createDataFrame([(n, said(t)) for n, t in sorted(tables.items())], "id string, text string")
    weights = hashed_weights(texts, "id", "text", native=native)
    pairs = [(q, a) for q in sorted(tables) for a in sorted(set(accepted)) if a != q]
    return rerank(spark.createDataFrame(pairs, "query_id string, doc_id string"), weights, weights, k)
