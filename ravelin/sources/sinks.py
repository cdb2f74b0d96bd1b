"""Results: appended by kind, merged by id, exported in shards, and resumed from."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import merge_items

SCHEMA = "kind string, id string, body string, evidence_ids array<string>, plan_ids array<string>, seq long"


@dataclass
class Sink:
    """A folder of result rows; ``put`` appends, and reading merges rows of one (kind, id)."""

    spark: SparkSession
    path: str

    def put(self, kind: str, items: DataFrame, seq: int = 0) -> None:
        """items: id, any columns, and evidence_ids and plan_ids if there are any."""
        ids = {c: (F.col(c) if c in items.columns else F.array().cast("array<string>")).alias(c) for c in ("evidence_ids", "plan_ids")}
        body = F.to_json(F.struct(*(c for c in items.columns if c not in ids)))
        rows = items.select(F.col("id").cast("string").alias("id"), body.alias("body"), *ids.values(), F.lit(seq).cast("long").alias("seq"))
        rows.withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind").parquet(self.path)

    def items(self) -> DataFrame:
        return merge_items(self.spark.read.schema(SCHEMA).parquet(self.path))

    def count(self) -> DataFrame:
        return self.items().groupBy("kind").count()

    def export(self, to: str, per_file: int = 5000) -> None:
        """JSON shards of ``per_file`` rows at most, by kind, in order of id."""
        self.items().repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").write.option("maxRecordsPerFile", per_file).partitionBy("kind").json(to)


@dataclass
class Stages:
    """Outputs of stages under a contract (snapshot, version, parameters): reused only where it is the same."""

    spark: SparkSession
    path: str
    contract: dict

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def run(self, name: str, make) -> DataFrame:
        """The stage's frame, made and written unless a complete one of this contract is there."""
        key = json.dumps(self.contract | {"stage": name}, sort_keys=True)
        digest = self.spark.range(1).select(F.sha2(F.lit(key), 256).alias("h")).first()["h"][:24]
        folder = f"{name}-{digest}"
        fs, done = self._fs(f"{folder}/_SUCCESS")
        if not fs.exists(done):
            make().write.mode("overwrite").parquet(f"{self.path}/{folder}")
        return self.spark.read.parquet(f"{self.path}/{folder}")
