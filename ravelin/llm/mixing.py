"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected ``target / source_size`` times.  The
documents of a source are put in order of size, their expected copies summed
from the left, one offset added, and a document emitted once for each integer
boundary its stretch crosses.  Ordering by size keeps the words taken within
about one longest document of the target.

Expected copies are whole numbers of 1/UNIT, so the sums are exact and the same
on every run.  Running sums go over ranges of rows: rows are dealt by (source,
size, id) into ranges, written, counted, and each range starts at the sum of the
ranges before it, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Cut, cut, words_of

#: Sources in code-point order, nulls last, take these weights in turn.
WEIGHTS = (3, 1, 2)
#: The mix has SHARE_NUM / SHARE_DEN of all words; no source is repeated more than REPEAT times.
SHARE_NUM, SHARE_DEN, REPEAT = 3, 2, 2
#: Expected copies are counted in parts of this.
UNIT = 100_000_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (src, source_size): the target of each source.

    Sharing the words by weight, stopping sources at REPEAT times their size and
    sharing the excess again ends where a source has min(REPEAT * size, level *
    weight).  In order of REPEAT * size / weight the stopped sources come first,
    so one running sum finds the level.  There is a row a source here, no text.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(place) - 1) % len(WEIGHTS) + 1).cast("int"))
    ratio = F.col("cap").cast("double") / F.col("w").cast("double")
    order, whole = Window.orderBy(ratio, F.col("source").asc_nulls_last()), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumns({"w": w.cast("decimal(9,0)"), "cap": (F.col("source_size") * REPEAT).cast("decimal(27,0)")})
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("left", F.sum("source_size").over(whole) * SHARE_NUM - F.col("cap_before") * SHARE_DEN)
        # stopped while level * weight >= cap, with level = left / SHARE_DEN / w_left
        .withColumn("stopped", F.col("left") * F.col("w") >= F.col("cap") * F.col("w_left") * SHARE_DEN)
        .withColumn("level", F.min_by(F.struct("left", "w_left"), F.when(~F.col("stopped"), ratio)).over(whole))
    )
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(
        (F.col("w") * F.col("level.left")).cast("double") / (F.col("level.w_left") * SHARE_DEN).cast("double")
    )
    return ranked.select("src", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def offset_units(seed: str) -> Column:
    """The one random offset of a source, 0 to UNIT - 1: fixed by seed and source."""
    part = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 7), 16, 10)
    return F.floor(part.cast("long") * UNIT / F.lit(float(1 << 28))).cast("long")


def copies(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per input row: rid, doc_id, size, source_size, target, copies.

    A null or empty text has size 0 and takes no words; a null source is a source
    of its own, the last; repeated rows are each sampled; a very long text counts whole;
    an empty table gives no rows.  ``rid`` is the row's place in the scan of ``docs``.
    """
    return _copies(docs.select(F.monotonically_increasing_id().alias("rid"), *(F.col(f"`{c}`").alias(n) for n, c in (("doc_id", id_col), ("text", text_col), ("source", source_col)))), seed)


def _copies(rows: DataFrame, seed: str) -> DataFrame:
    slim = rows.select(
        "rid",
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.size(words_of(F.col("text"))).cast("long").alias("size"),
        F.xxhash64("text").alias("tie"),
    ).withColumn("src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    slim = cut(slim)
    ranges = cut(slim.repartitionByRange("src", "size", "doc_id", "tie", "rid").withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("src", "range").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("source").alias("source"))
    counts = cut(counts)
    targets = source_targets(counts.groupBy("src").agg(F.sum("words").alias("source_size"), F.first("source").alias("source")))
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    each = F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT))).cast("long")
    # a row for each range and source in it: as many as ranges and sources together, at most
    starts = cut(
        counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(targets, "src")
        .select("src", "range", "start", "source_size", "target", F.when(F.col("source_size") > 0, F.least(each, F.lit(REPEAT * UNIT))).otherwise(0).alias("each"), offset_units(seed).alias("offset"))
    )
    within = Window.partitionBy("range", "src").orderBy("size", "doc_id", "tie", "rid")
    rows = ranges.withColumn("place", F.row_number().over(within)).join(starts, ["src", "range"])
    ahead = (F.col("start") + F.col("place") - 1) * F.col("each") + F.col("offset")
    crossed = F.floor((ahead + F.col("each")).cast("decimal(19,0)") / UNIT) - F.floor(ahead.cast("decimal(19,0)") / UNIT)
    return rows.select("rid", "doc_id", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents, with the columns of ``docs``: each row as often as its copies."""
    # written once, so that both readings mean one row by a number
    stored = Cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("doc")), codec="zstd").df
    taken = _copies(stored.select("rid", *(F.col(f"doc.`{c}`").alias(n) for n, c in (("doc_id", id_col), ("text", text_col), ("source", source_col)))), seed)
    rows = stored.join(taken.select("rid", "copies").where("copies > 0"), "rid")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def oracle(seed: str = "mix") -> str:
    weights = f"[{', '.join(map(str, WEIGHTS))}]"
    return f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
    a AS (SELECT *, {weights}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::HUGEINT AS w, {REPEAT} * source_size AS cap FROM s),
    b AS (SELECT *, cap::DOUBLE / w::DOUBLE AS ratio FROM a),
    c AS (SELECT *, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left, {SHARE_NUM} * sum(source_size) OVER () - {SHARE_DEN} * coalesce(sum(cap) OVER o, 0) AS rest
          FROM b WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e AS (SELECT *, rest * w >= cap * w_left * {SHARE_DEN} AS stopped FROM c),
    l AS (SELECT rest AS lr, w_left AS lw FROM e WHERE NOT stopped ORDER BY ratio LIMIT 1),
    t AS (SELECT source, source_size::BIGINT AS source_size, coalesce(CASE WHEN stopped THEN cap::DOUBLE ELSE (w * lr)::DOUBLE / (lw * {SHARE_DEN})::DOUBLE END, 0) AS target FROM e LEFT JOIN l ON true),
    u AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size::DOUBLE * {UNIT}.0::DOUBLE)::BIGINT, {REPEAT * UNIT}) ELSE 0 END AS step,
                 floor(('0x' || left(md5('{seed}:' || coalesce(source, '')), 7))::BIGINT::DOUBLE * {UNIT} / {1 << 28}.0::DOUBLE)::BIGINT AS start FROM t),
    r AS (SELECT d.*, u.source_size, u.target, u.step, u.start, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS place FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
    SELECT doc_id, size, source_size, target, size * ((place * step + start) // {UNIT} - ((place - 1) * step + start) // {UNIT}) AS taken FROM r"""
