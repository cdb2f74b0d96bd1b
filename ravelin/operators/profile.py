"""Column profiles, joint distinct counts, constants and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import PROFILE_SPACE, SHAPES, full_match, profile_usable, ranked_by

#: Columns that one aggregation measures; it bounds the generated code.
TOGETHER = 32
SAMPLE_ROWS, SAMPLE_VALUES, SHORT = 2048, 16, 64


def measures(value: Column, approximate: bool = True) -> dict[str, Column]:
    """The statistics of one column of strings, by name."""
    usable = profile_usable(value)
    when = F.when(usable, value)
    out = {
        "null_count": F.count_if(value.isNull()),
        "empty_count": F.count_if(value == ""),
        "whitespace_only_count": F.count_if((value != "") & ~usable),
        "usable_count": F.count_if(usable),
        "non_null": F.count(value),
        "min_chars_usable": F.min(F.length(when)),
        "max_chars_usable": F.max(F.length(when)),
        "min_bytes_usable": F.min(F.octet_length(when)),
        "max_bytes_usable": F.max(F.octet_length(when)),
        **{f"{k}_shape_count": F.count_if(usable & full_match(value, p)) for k, p in SHAPES.items()},
        "json_start_count": F.count_if(usable & F.left(F.ltrim(value, F.lit(PROFILE_SPACE)), F.lit(1)).isin("{", "[")),
        "short_text_count": F.count_if(usable & (F.length(value) <= SHORT)),
    }
    if approximate:
        out |= {"approx_distinct": F.approx_count_distinct(value), "approx_distinct_usable": F.approx_count_distinct(when)}
    return out


def profile(df: DataFrame, columns: Sequence[str] | None = None, *, approximate: bool = True) -> DataFrame:
    """A row per column: column, row_count and its statistics.

    Up to TOGETHER columns are measured in one pass, with partial aggregation and
    no exchange of rows.  Values are profiled as strings; nothing is trimmed.
    """
    columns = list(columns or df.columns)
    out = None
    for at in range(0, len(columns), TOGETHER):
        group = columns[at : at + TOGETHER]
        structs = [
            F.struct(F.lit(c).alias("column"), F.count("*").alias("row_count"), *(m.alias(k) for k, m in measures(F.col(f"`{c}`").cast("string"), approximate).items()))
            for c in group
        ]
        part = df.agg(F.array(*structs).alias("p")).select(F.explode("p").alias("p")).select("p.*")
        out = part if out is None else out.unionAll(part)
    return out


def distinct_sample(df: DataFrame, column: str, row: str = "__row") -> DataFrame:
    """One row: up to SAMPLE_VALUES sorted values among the first SAMPLE_ROWS rows, and whether that is all."""
    first = df.agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(F.when(F.col(row) <= SAMPLE_ROWS, F.col(f"`{column}`")))).alias("v"))
    return first.select(
        F.slice("v", 1, SAMPLE_VALUES).alias("distinct_sample"),
        ((F.col("rows") <= SAMPLE_ROWS) & (F.size("v") <= SAMPLE_VALUES)).alias("sample_exhaustive"),
    )


def joint_distinct(df: DataFrame, sets: dict[str, Sequence[str]]) -> DataFrame:
    """For each labelled set of columns: complete rows, distinct tuples, duplicates, uniqueness.

    Each set is aggregated by itself: one statement over several distinct sets
    would make as many copies of every row.
    """
    out = None
    for label, columns in sets.items():
        values = [F.col(f"`{c}`").cast("string") for c in columns]
        complete = F.lit(True)
        for v in values:
            complete = complete & F.coalesce(F.length(F.trim(v)) > 0, F.lit(False))
        tuples = df.groupBy(F.when(complete, F.struct(*(v.alias(f"c{k}") for k, v in enumerate(values)))).alias("t")).agg(F.count("*").alias("n"))
        counted = tuples.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("n"))), F.lit(0)).alias("complete_rows"),
            F.count_if(F.col("t").isNotNull()).alias("distinct_tuples"),
        )
        part = counted.select(
            F.lit(label).alias("label"), "complete_rows", "distinct_tuples",
            (F.col("complete_rows") - F.col("distinct_tuples")).alias("duplicate_rows"),
            (F.col("rows") - F.col("complete_rows")).alias("blank_or_null_rows"),
            ((F.col("complete_rows") > 0) & (F.col("complete_rows") == F.col("distinct_tuples"))).alias("unique_in_input"),
        )
        out = part if out is None else out.unionAll(part)
    return out


def constant_column(df: DataFrame, column: str, longest: int = 256) -> DataFrame:
    """One row: is every value of the column nonblank and the same, and which is it?"""
    v = F.col(f"`{column}`").cast("string")
    stats = df.agg(F.count("*").alias("rows"), F.count_if(profile_usable(v)).alias("nonblank"), F.min(v).alias("least"), F.max(v).alias("most"))
    constant = (F.col("rows") > 0) & (F.col("rows") == F.col("nonblank")) & (F.col("least") == F.col("most")) & (F.length("least") <= longest)
    constant = F.coalesce(constant, F.lit(False))
    return stats.select("rows", "nonblank", constant.alias("constant"), F.when(constant, F.col("least")).alias("value"))


def single_unit(df: DataFrame, column: str, row: str = "__row") -> DataFrame:
    """Up to three values of a unit column with their rows; one value, on all rows, makes a unit."""
    v = F.col(f"`{column}`").cast("string")
    found = df.groupBy(v.alias("unit")).agg(F.count("*").alias("rows"), F.min(row).alias("first_row"))
    return found.orderBy(F.col("unit").asc_nulls_last()).limit(3)


def hash_sample(df: DataFrame, column: str, n: int, longest: int | None = None) -> DataFrame:
    """Up to n + 1 distinct values in MD5 order: the last says that there are more."""
    v = F.col(f"`{column}`").cast("string")
    usable = F.coalesce(F.trim(v) != "", F.lit(False))
    if longest:
        usable = usable & (F.length(v) <= longest)
    values = df.where(usable).select(v.alias("value")).distinct()
    return values.orderBy(ranked_by(F.col("value")), "value").limit(n + 1)


def even_sample(df: DataFrame, rows: int, n: int, row: str = "__row") -> DataFrame:
    """n rows spread evenly over the row numbers 1 to ``rows``."""
    if n < 1:
        raise ValueError("a sample has a row at least")
    at = sorted({1 + k * max(0, rows - 1) // max(1, n - 1) for k in range(min(n, rows))})
    return df.where(F.col(row).isin(at))


def named_sample(df: DataFrame, names: Sequence[str], n: int, row: str = "__row") -> DataFrame:
    """Up to n rows with a name, (row, name), in MD5 order of the first of their names that is not blank."""
    name = F.coalesce(*(F.when(F.trim(c) != "", c) for c in (F.col(f"`{x}`").cast("string") for x in names)))
    return df.select(F.col(row).alias("row"), name.alias("name")).where("name IS NOT NULL").orderBy(ranked_by(F.col("name")), "row").limit(n)


#: A year, a day, a month or a quarter written as text.
TEMPORAL = r"(?:19|20)[0-9]{2}(?:[-/][0-9]{1,2}(?:[-/][0-9]{1,2})?|[Qq][1-4]|年(?:[0-9]{1,2}月|第?[一二三四1-4]季度)?)?"
#: Share of usable values, in per cent, that must be of that shape.
TEMPORAL_SHARE = 80


def temporal_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, usable, temporal_values, temporal): do the values of a column say when?  One pass, no exchange of rows."""
    tests = {c: F.trim(F.col(f"`{c}`").cast("string")) for c in columns}
    found = df.agg(*(F.struct(F.count_if(v != "").alias("u"), F.count_if(full_match(v, TEMPORAL)).alias("t")).alias(f"c{k}") for k, v in enumerate(tests.values())))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{k}.u").alias("usable"), F.col(f"c{k}.t").alias("temporal_values")) for k, c in enumerate(columns))))
    out = found.select(rows.alias("r")).select("r.*")
    return out.withColumn("temporal", (F.col("usable") > 0) & (F.col("temporal_values") * 100 >= F.col("usable") * TEMPORAL_SHARE))


def key_probe(df: DataFrame, columns: Sequence[str], separator: str = "|") -> DataFrame:
    """One row: distinct keys as tuples, as joined text, and whether joining them makes different keys equal."""
    there = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    text = F.concat_ws(separator, *(F.col(f"`{c}`").cast("string") for c in columns))
    out = there.agg(F.count_distinct(F.struct(*columns)).alias("tuple_keys"), F.count_distinct(text).alias("joined_keys"))
    return out.withColumn("joining_is_safe", F.col("tuple_keys") == F.col("joined_keys"))


def code_probe(df: DataFrame, column: str, value: str) -> DataFrame:
    """One row: rows whose cell is the value, and rows whose cell is the same number: 1 is not 001."""
    v = F.col(f"`{column}`").cast("string")
    return df.agg(F.count_if(v == value).alias("raw_matches"), F.count_if(F.expr(f"try_cast(`{column}` AS decimal(38,0))") == F.lit(value).try_cast("decimal(38,0)")).alias("number_matches"))
