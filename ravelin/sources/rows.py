"""Row numbers and shared-storage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROW = "__row"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where none is configured, a private one of a local session, else an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="ravelin-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_made: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """This application's own folder in shared storage; it goes when the application ends."""
    context = spark.sparkContext
    where = f"{shared_dir(spark)}/ravelin-{context.applicationId}"
    if where not in _made:
        path = context._jvm.org.apache.hadoop.fs.Path(where)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _made.add(where)
    return where


def materialise(df: DataFrame) -> DataFrame:
    """Write to shared storage and read again: a plan without lineage that survives lost executors."""
    path = f"{scratch(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: list[str], name: str = ROW) -> DataFrame:
    """Number rows from 1 in the order of columns that tell rows apart, nulls last.

    Rows are sorted in ranges, each range starts at the count of those before it;
    no task sees all rows.  Which of two rows with equal keys comes first is not
    defined, and parquet files give no other order.
    """
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in order]
    ranges = materialise(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    counts = ranges.groupBy("__range").agg(F.count("*").alias("n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range: as many as there are shuffle partitions
    starts = F.broadcast(counts.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return ranges.withColumn("__within", within).join(starts, "__range").withColumn(name, F.col("__start") + F.col("__within")).drop("__range", "__within", "__start")


def rows_at(df: DataFrame, numbers: list[int], name: str = ROW) -> DataFrame:
    """The rows of given numbers, each once."""
    if any(type(n) is not int or n < 1 for n in numbers):
        raise ValueError("row numbers are integers from 1")
    wanted = df.sparkSession.createDataFrame([(n,) for n in sorted(set(numbers))], f"{name} long")
    return df.join(wanted, name, "left_semi")


def lookup(df: DataFrame, keys: list[str], name: str = ROW) -> DataFrame:
    """For every complete key: how many rows have it (2 stands for more) and the first one's number."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(f"`{k}`").isNotNull() & (F.col(f"`{k}`").cast("string") != "")
    found = df.where(complete).groupBy(*keys).agg(F.count("*").alias("rows"), F.min(name).alias("first_row"))
    return found.withColumn("matches", F.least("rows", F.lit(2))).drop("rows")
