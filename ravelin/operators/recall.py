"""Recall of fields that may refer to each other: by values, branches, names, paths and aliases.

Recall only proposes.  Whatever it skips it counts, and an exact check decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cues_of, folded_items
from ..functions.values import SHAPES, full_match, join_usable, ranked_by


def dictionary(tables: dict[str, DataFrame], fields: Sequence[tuple[str, str]], longest: int = 96) -> DataFrame:
    """(field, value): the distinct usable values of each field up to ``longest`` characters.

    Each table is read once for all its fields; duplicates go before anything is
    exchanged.
    """
    out = None
    for table in dict.fromkeys(t for t, _ in fields):
        pairs = [F.struct(F.lit(f"{table}.{c}").alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for t, c in fields if t == table]
        part = tables[table].select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
        out = part if out is None else out.unionAll(part)
    return out.where(join_usable(F.col("value")) & (F.length("value") <= longest)).distinct()


def oversized(table: DataFrame, fields: Sequence[str], longest: int = 96) -> DataFrame:
    """(field, n): distinct usable values left out of the dictionary for their length."""
    pairs = [F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in fields]
    long = table.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where(join_usable(F.col("value")) & (F.length("value") > longest))
    return long.distinct().groupBy("field").agg(F.count("*").alias("n"))


def shared_values(words: DataFrame, fanout: int = 32) -> DataFrame:
    """(left, right, common_values, numeric_only) of fields that share values, left < right.

    A value is grouped with its holders instead of joined with itself, so it is
    exchanged once; values held by more than ``fanout`` fields give no pairs.
    """
    held = words.groupBy("value").agg(F.array_sort(F.collect_set("field")).alias("holders")).where(F.size("holders").between(2, fanout))
    pairs = held.select("value", "holders", F.posexplode("holders").alias("i", "left"))
    pairs = pairs.select("value", "left", F.explode(F.slice("holders", F.col("i") + 2, F.size("holders"))).alias("right"))
    return pairs.groupBy("left", "right").agg(F.count("*").alias("common_values"), F.bool_and(full_match(F.col("value"), SHAPES["numeric"])).alias("numeric_only"))


def sampled(words: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` values of each field of a dictionary, in MD5 order, with how many the field has.

    Each task keeps n of a field before the exchange.
    """
    sizes = words.groupBy("field").agg(F.count("*").alias("of"))
    order = Window.partitionBy("field").orderBy(ranked_by(F.col("value")), "value")
    return words.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= n).drop("__at").join(sizes, "field")


def narrow(rows: DataFrame, key: Sequence[str], fanout: int) -> DataFrame:
    """Rows whose key stands in 2 to ``fanout`` of them.

    Keys are counted with partial aggregation first and the rows of all others dropped, so that no
    task gathers a key that is then thrown away for its size.
    """
    counted = rows.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n").between(2, fanout)).drop("__n")
    return rows.join(counted, list(key), "left_semi")


def widely_held(words: DataFrame, fanout: int = 32) -> DataFrame:
    """One row: the number of values that more than ``fanout`` fields hold."""
    return words.groupBy("value").agg(F.count_distinct("field").alias("n")).where(F.col("n") > fanout).agg(F.count("*").alias("high_fanout_values"))


def branches(source: DataFrame, target: DataFrame, source_field: str, target_field: str, discriminator: str, scope: str | None = None) -> DataFrame:
    """For each literal of a discriminator: rows, matches and unique matches inside and outside it.

    ``improves`` says that the branch hits more often than the rest.  With
    ``scope``, a target column, keys are (value, scope) and the discriminator is
    compared with it.
    """
    ref, disc = F.col(f"`{source_field}`").cast("string"), F.col(f"`{discriminator}`").cast("string")
    rows = source.select(ref.alias("ref"), disc.alias("literal")).where(join_usable(F.col("ref"))).groupBy("ref", "literal").agg(F.count("*").alias("n"))
    keys = target.select(F.col(f"`{target_field}`").cast("string").alias("ref"), *([F.col(f"`{scope}`").cast("string").alias("literal")] if scope else []))
    keys = keys.where(join_usable(F.col("ref")) & (join_usable(F.col("literal")) if scope else F.lit(True)))
    on = ["ref", "literal"] if scope else ["ref"]
    joined = rows.join(keys.groupBy(*on).agg(F.count("*").alias("m")), on, "left")
    found = joined.groupBy("literal").agg(
        F.sum("n").alias("branch_rows"),
        F.coalesce(F.sum(F.when(F.col("m") > 0, F.col("n"))), F.lit(0)).alias("branch_matches"),
        F.coalesce(F.sum(F.when(F.col("m") == 1, F.col("n"))), F.lit(0)).alias("branch_unique"),
    )
    whole = found.agg(F.sum("branch_rows").alias("rows"), F.sum("branch_matches").alias("matches"))
    # a discriminator has few literals; the totals are one row
    out = found.join(F.broadcast(whole)).withColumns({"outside_rows": F.col("rows") - F.col("branch_rows"), "outside_matches": F.col("matches") - F.col("branch_matches")})
    better = F.col("branch_matches") * F.col("outside_rows") > F.col("outside_matches") * F.col("branch_rows")
    improves = (F.col("branch_matches") > 0) & (F.col("outside_rows") > 0) & better & join_usable(F.col("literal"))
    return out.select("literal", "branch_rows", "branch_matches", "branch_unique", "outside_rows", "outside_matches", F.coalesce(improves, F.lit(False)).alias("improves"))


def json_leaves(df: DataFrame, column: str, depth: int = 4) -> DataFrame:
    """(path, value) of the string leaves of JSON objects in a column; lists are not entered."""
    level = df.select(F.array().cast("array<string>").alias("path"), F.try_parse_json(F.col(f"`{column}`").cast("string")).alias("v"))
    out = None
    for _ in range(min(depth, 16)):
        level = level.where("schema_of_variant(v) LIKE 'OBJECT%'").selectExpr("path", "v")
        level = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer())).toDF("path", "v", "pos", "key", "child")
        level = level.where("key IS NOT NULL").select(F.concat("path", F.array("key")).alias("path"), F.col("child").alias("v"))
        leaves = level.where("schema_of_variant(v) = 'STRING'").select("path", F.variant_get("v", "$", "string").alias("value"))
        out = leaves if out is None else out.unionAll(leaves)
    return out


def alias_pairs(values: DataFrame, fanout: int = 8) -> DataFrame:
    """Field pairs of different tables that share a folded value or alias item.

    values: (table, field, value).  Reports shared keys, raw values matched on each
    side, and keys under which a side has several raw values (collisions).
    """
    names = F.concat_ws(".", "table", "field")
    keys = values.select("table", names.alias("name"), "value", F.explode(folded_items("value")).alias("key")).distinct()
    sides = keys.groupBy("key", "table", "name").agg(F.collect_set("value").alias("raws"))
    # a key's holders are fields of the catalogue: few, however many rows have it
    held = sides.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("name", "table", "raws"))).alias("h")).where(F.size("h").between(2, fanout))
    pairs = held.select("key", "h", F.posexplode("h").alias("i", "a"))
    pairs = pairs.select("key", "a", F.explode(F.slice("h", F.col("i") + 2, F.size("h"))).alias("b")).where("a.table != b.table")
    return pairs.groupBy(F.col("a.name").alias("left"), F.col("b.name").alias("right")).agg(
        F.count("*").alias("shared_keys"),
        F.size(F.array_distinct(F.flatten(F.collect_list("a.raws")))).alias("left_values"),
        F.size(F.array_distinct(F.flatten(F.collect_list("b.raws")))).alias("right_values"),
        F.count_if((F.size("a.raws") > 1) | (F.size("b.raws") > 1)).alias("collision_keys"),
    )


def cue_pairs(names: DataFrame, fanout: int = 16, native: bool = False) -> DataFrame:
    """(left, right, cues, n_cues) of records whose names share a cue held by at most ``fanout`` records.

    names: (id, name).  ``native`` cues are the words of three ASCII letters and
    more; otherwise also the folded name and Han 2-grams.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("([a-z]{3,})"), F.lit(1)))
    cues = names.select("id", F.explode(words if native else cues_of("name")).alias("cue")).distinct()
    held = narrow(cues, ["cue"], fanout).groupBy("cue").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = held.select("cue", "ids", F.posexplode("ids").alias("i", "left"))
    pairs = pairs.select("cue", "left", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("right"))
    return pairs.groupBy("left", "right").agg(F.array_sort(F.collect_set("cue")).alias("cues"), F.count("*").alias("n_cues"))


def json_references(source: DataFrame, column: str, targets: DataFrame, depth: int = 4) -> DataFrame:
    """(path, field, shared): targets' fields that hold a string found at a path of JSON objects in a column.

    targets: a dictionary (field, value).
    """
    leaves = json_leaves(source, column, depth).select(F.array_join("path", ".").alias("path"), "value").where(join_usable(F.col("value"))).distinct()
    return leaves.join(targets, "value").groupBy("path", "field").agg(F.count("*").alias("shared"))


def hinted_branches(source: DataFrame, discriminator: str, tables: Sequence[str], most: int = 64) -> DataFrame:
    """(literal, rows, table): literals of a discriminator whose words name a table; ``most`` literals at most.

    Words are letters and digits, a plural's last s left out.
    """
    literals = source.where(join_usable(F.col(f"`{discriminator}`").cast("string"))).groupBy(F.col(f"`{discriminator}`").cast("string").alias("literal")).agg(F.count("*").alias("rows"))
    literals = literals.orderBy(F.desc("rows"), "literal").limit(most)
    words = F.transform(F.regexp_extract_all(F.lower("literal"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.regexp_replace(w, "s$", ""))
    named = F.array([F.struct(F.lit(t).alias("table"), F.lit(t.rsplit(".", 1)[-1].lower().removesuffix("s")).alias("word")) for t in tables])
    return literals.withColumn("t", F.explode(named)).where(F.array_contains(words, F.col("t.word"))).select("literal", "rows", "t.table")
