"""Snapshots: tables read losslessly as strings, with row numbers, hashes and a catalogue."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.roles import Column as Field
from ..plans.roles import Table, sensitive
from .rows import ROW, materialise, number_rows

#: Stands for an unquoted empty cell while a file is read; no text file holds it.
NULL = "\u0000N"


@dataclass
class Snapshot:
    id: str
    frames: dict[str, DataFrame]
    tables: dict[str, Table]
    files: dict[str, str]

    def context(self, rows: int = 3) -> dict[str, DataFrame]:
        """The first rows of each table without sensitive columns."""
        return {t: self.frames[t].where(F.col(ROW) <= rows).select([c.name for c in table.columns if not sensitive(c)]) for t, table in self.tables.items()}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def snapshot_id(files: dict[str, str]) -> str:
    return hashlib.sha256(canonical(files).encode()).hexdigest()


#: Bytes of a file that is hashed in one piece.
WHOLE = 1 << 28


def file_hashes(spark: SparkSession, paths: Sequence[str], whole: int = WHOLE) -> dict[str, str]:
    """A digest of each file, read by Spark: SHA-256 of its bytes, or, beyond ``whole`` bytes, of its length
    and of the digests of the lines of each of its splits, put in order, so that no task holds a large file."""
    if not paths:
        return {}
    files = spark.read.format("binaryFile").load(list(paths))
    sizes = {r["path"]: r["length"] for r in files.select("path", "length").collect()}
    found = {r["path"]: r["h"] for r in files.where(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("h")).collect()}
    for path in sorted(sizes.keys() - found.keys()):
        lines = spark.read.text(path).select("value", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
        # a line counts by its words and its place in its split; sums are the same in any order
        own = [F.xxhash64(F.lit(k), "value", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))) for k in range(4)]
        digest = lines.groupBy("file_block_start").agg(F.count("*").alias("n"), *(F.sum(h.cast("decimal(38,0)")).alias(f"s{k}") for k, h in enumerate(own)))
        found[path] = hashlib.sha256(canonical([sizes[path], sorted([str(x) for x in r] for r in digest.collect())]).encode()).hexdigest()  # a row a split
    return found


def read_csv(spark: SparkSession, path: str, quoted_newlines: bool = True) -> DataFrame:
    """All columns as strings; an unquoted empty cell is null, a quoted one ''.  A BOM is dropped.

    Where no cell holds a line break, ``quoted_newlines=False`` lets a file be read by many tasks.
    """
    options = {"header": True, "inferSchema": False, "multiLine": quoted_newlines, "nullValue": NULL, "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "encoding": "UTF-8"}
    df = spark.read.options(**{k: str(v) for k, v in options.items()}).csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def in_file_order(df: DataFrame) -> DataFrame:
    """Row numbers from 1 in file order, counted by partition: no task sees all rows."""
    marked = df.withColumn("__at", F.monotonically_increasing_id())
    return number_rows(marked, ["__at"]).drop("__at")



def load_yaml(text: str) -> object:
    """YAML by the safe loader; a key written twice is an error."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        out = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=deep)
            if key in out:
                raise ValueError(f"duplicate key {key!r}, line {k.start_mark.line + 1}")
            out[key] = loader.construct_object(v, deep=True)
        return out

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return yaml.load(text, Loader)


def sequence_prefix(path: str, limit: int, most_bytes: int = 8 << 20) -> tuple[list, bool]:
    """(items, whole): the first items of a YAML file that is a list, read up to so many bytes.

    An item that the bytes cut off is left out; ``whole`` says that nothing was.
    """
    with open(path, "rb") as f:
        raw = f.read(most_bytes + 1)
    cut = len(raw) > most_bytes
    text = raw[:most_bytes].decode("utf-8-sig", errors="ignore")
    if cut:
        text = text[: max((m.start() for m in re.finditer(r"^- ", text, re.MULTILINE)), default=0)]
    items = load_yaml(text) or []
    if not isinstance(items, list):
        raise ValueError(f"{path}: not a list")
    return items[:limit], not cut and len(items) <= limit


_PK = re.compile(r"primary\s+key\s*\(([^)]*)\)", re.IGNORECASE)


def primary_key(constraint: str) -> list[str]:
    """Columns of a PRIMARY KEY (...) constraint text."""
    found = _PK.search(constraint)
    return [c.strip().strip('"`') for c in found[1].split(",")] if found else []


def from_files(spark: SparkSession, root: str, exclude: Sequence[str] = (), quoted_newlines: bool = True) -> Snapshot:
    """Import schema/tables/*.yaml with constraints and foreign keys, and data/[schema/]table.csv."""
    base = Path(root)
    named: dict[str, Table] = {}
    keys = {}
    for path in sorted(base.glob("schema/constraints/*.yaml")):
        for c in (load_yaml(path.read_text()) or {}).get("constraints", []):
            keys.setdefault(f"{c['table_schema']}.{c['table_name']}", []).extend(primary_key(c.get("constraint_definition", "")))
    links = {}
    for path in sorted(base.glob("schema/foreign_keys/*.yaml")):
        for k in (load_yaml(path.read_text()) or {}).get("foreign_keys", []):
            links.setdefault(f"{k['table_schema']}.{k['table_name']}", []).append((k["column_name"], f"{k['referenced_schema']}.{k['referenced_table']}", k["referenced_column"]))
    for path in sorted(base.glob("schema/tables/*.yaml")):
        info = load_yaml(path.read_text())
        name = f"{info['table_schema']}.{info['table_name']}"
        columns = [Field(c["column_name"], c.get("data_type") or "", c.get("column_comment") or "") for c in info["columns"]]
        names = [c.name for c in columns]
        if len(set(names)) < len(names) or any(n.startswith("__") for n in names):
            raise ValueError(f"{name}: repeated or reserved column names")
        named[name] = Table(name, columns, keys.get(name, []), links.get(name, []), info.get("table_comment") or "")
    unknown = set(exclude) - {f"{t}.{c.name}" for t, table in named.items() for c in table.columns}
    if unknown:
        raise ValueError(f"excluded columns that do not exist: {sorted(unknown)}")
    bare = [t.split(".", 1)[1] for t in named]
    paths = {}
    for t in named:
        schema, short = t.split(".", 1)
        inner, outer = base / "data" / schema / f"{short}.csv", base / "data" / f"{short}.csv"
        if not inner.exists() and bare.count(short) > 1:
            raise ValueError(f"{short} is in several schemas: put its file in data/{schema}/")
        paths[t] = str(inner if inner.exists() else outer)
    frames = {}
    for t, path in paths.items():
        df = read_csv(spark, path, quoted_newlines)
        if set(df.columns) != {c.name for c in named[t].columns} or len(df.columns) != len(named[t].columns):
            raise ValueError(f"{t}: the header is not the declared columns")
        frames[t] = materialise(in_file_order(df))
    hashes = file_hashes(spark, list(paths.values()))
    files = {str(Path(re.sub(r"^file:/+", "/", p)).relative_to(base.resolve())): h for p, h in hashes.items()}
    return Snapshot(snapshot_id(files), frames, named, files)


def content_digest(df: DataFrame) -> str:
    """A digest of a table's schema and rows in any order; repeats count."""
    names = [F.col(f"`{c}`") for c in df.columns]
    sums = df.agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(k), *names).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4))).first()
    return hashlib.sha256(canonical([df.schema.simpleString(), *map(str, sums)]).encode()).hexdigest()


def from_parquet(spark: SparkSession, folder: str, tables: dict[str, list[str]], places: int | None = None) -> Snapshot:
    """Parquet tables as strings, with rows numbered by the given key columns.

    Numbers are written as Spark writes them, the shortest text that reads back the same; ``places``
    rounds doubles and floats to so many first, for comparison with systems that write them otherwise.
    Lists, structs and maps are written as JSON.  The id is that of names, schemas and contents.
    """
    frames, named, files = {}, {}, {}
    for t, order in tables.items():
        df = spark.read.parquet(f"{folder}/{t}.parquet")

        def text(c: str, kind: str) -> Column:
            x = F.col(f"`{c}`")
            if kind.startswith(("array", "struct", "map")):
                return F.to_json(x, {"ignoreNullFields": "false"})
            return (x.cast(f"decimal(38,{places})") if places is not None and kind in ("double", "float") else x).cast("string")

        frames[t] = number_rows(df, order).select(ROW, *(text(c, kind).alias(c) for c, kind in df.dtypes))
        named[t] = Table(t, [Field(c, kind) for c, kind in df.dtypes])
        files[t] = content_digest(frames[t].drop(ROW))
    return Snapshot(snapshot_id(files), frames, named, files)


def record_id(table: str, key: Sequence[str], snapshot: str, row: str = ROW) -> Column:
    """table:digest of the key (null if incomplete), row number and snapshot; rows with equal keys differ."""
    complete = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"`{c}`").cast("string") != "", F.lit(False)) for c in key], F.lit(bool(key)))
    values = F.when(complete, F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in key)))) if key else F.lit(None).cast("string")
    body = F.to_json(F.struct(values.alias("key"), F.col(row).alias("row"), F.lit(snapshot).alias("snapshot")), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{table}:"), F.substring(F.sha2(body, 256), 1, 24))
