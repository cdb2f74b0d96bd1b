"""Reference cards from published models: entity files in JSON, and RDF where its library is there."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import bm25, fuse

CARD = "uri string, label string, definition string, parents array<string>, aliases array<string>, encoding string, error string"


def decode(raw: bytes) -> tuple[str, str]:
    """Text as UTF-8 (a BOM goes), else as Windows-1252."""
    try:
        return raw.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError:
        return raw.decode("cp1252"), "cp1252"


def _entities(files):
    for batch in files:
        rows = []
        for path, raw in zip(batch["path"], batch["content"]):
            try:
                text, encoding = decode(raw)
                for d in json.loads(text).get("definitions", []):
                    if d.get("entityName"):
                        parent = d.get("extendsEntity")
                        rows.append((f"{path}#{d['entityName']}", d["entityName"], d.get("description") or "", [str(parent)] if parent else [], [], encoding, None))
            except Exception as e:  # noqa: BLE001  a file that cannot be read is a row that says so
                rows.append((path, None, None, [], [], None, type(e).__name__))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CARD.split(", ")])


def entity_cards(spark: SparkSession, folder: str) -> DataFrame:
    """A card per entity of *.cdm.json files; unreadable files give a row with ``error``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cdm.json").load(folder)
    return files.select("path", "content").mapInPandas(_entities, CARD)


def rdf_cards(spark: SparkSession, path: str) -> DataFrame:
    """A card per class and property of an RDF file; needs rdflib."""
    try:
        import rdflib
        from rdflib import OWL, RDF, RDFS, SKOS
    except ImportError as e:
        raise RuntimeError("RDF needs the rdflib package") from e
    graph = rdflib.Graph().parse(path)
    nodes = {n for kind in (OWL.Class, RDFS.Class, OWL.ObjectProperty, OWL.DatatypeProperty, RDF.Property) for n in graph.subjects(RDF.type, kind) if isinstance(n, rdflib.URIRef)}
    rows = []
    for n in sorted(nodes):
        every = lambda *kinds: [str(x) for k in kinds for x in graph.objects(n, k)]  # noqa: B023, E731
        labels = every(RDFS.label, SKOS.prefLabel) or [str(n).rsplit("#", 1)[-1].rsplit("/", 1)[-1]]
        rows.append((str(n), labels[0], "\n".join(every(RDFS.comment, SKOS.definition)), every(RDFS.subClassOf), labels[1:] + every(SKOS.altLabel), "utf-8", None))
    return spark.createDataFrame(rows, CARD)


def search(cards: DataFrame, queries: DataFrame, k: int = 5, vectors: DataFrame | None = None) -> DataFrame:
    """Cards for queries (query_id, text): BM25 over labels, aliases and definitions, fused with a vector list if given."""
    text = F.concat_ws(" ", "label", F.array_join("aliases", " "), "definition")
    lexical = bm25(queries, cards.where("error IS NULL").select(F.col("uri").alias("doc_id"), text.alias("text")), 4 * k, native=False)
    return fuse([lexical] if vectors is None else [lexical, vectors], k)
