"""Profiles and reference checks over streams of rows.

Windows are on event time; a watermark says how late a row may come, and what
comes later is dropped by it.  References are checked batch by batch against a
target read anew for each, with counts that add up over batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.values import profile_usable
from ..operators.reference import Reference, check


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """A watermark needs a timestamp with a time zone; a time without one is read in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_profile(stream: DataFrame, time: str, column: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, row_count, null_count, usable_count, numeric_count) of each tumbling window."""
    v = F.col(f"`{column}`").cast("string")
    grouped = _timed(stream, time, late).groupBy(F.window(time, window).alias("w"))
    counts = grouped.agg(F.count("*").alias("row_count"), F.count_if(v.isNull()).alias("null_count"), F.count_if(profile_usable(v)).alias("usable_count"), F.count_if(v.rlike(r"\A[+-]?[0-9]+(\.[0-9]+)?\z")).alias("numeric_count"))
    return counts.select(F.col("w.start").alias("start"), "row_count", "null_count", "usable_count", "numeric_count")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, row_count) of each key's sessions."""
    grouped = _timed(stream, time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("row_count"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "row_count")


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows without repeats of a key within the watermark; older keys leave the state."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark(keys)


def checked(stream: DataFrame, target: Callable[[], DataFrame], ref: Reference, out: str) -> DataStreamWriter:
    """Appends one row of counts for each batch to ``out``; a batch run again replaces its own row."""

    def batch(rows: DataFrame, number: int) -> None:
        check(rows, target(), ref).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    return stream.writeStream.foreachBatch(batch)


def totals(counts: DataFrame) -> DataFrame:
    """The counts of all batches in one row; distinct counts do not add up and are left out."""
    adding = [c for c in counts.columns if not c.startswith("distinct") and not c.startswith("target") and not c.endswith("ratio") and c not in ("batch", "part", "whole_column")]
    return counts.agg(*(F.sum(c).alias(c) for c in adding))
