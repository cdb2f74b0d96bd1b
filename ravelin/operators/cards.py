"""Definition cards: rows with one meaning made one card, cards grouped to patterns."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def signature(columns: Sequence[str]) -> Column:
    """An id of the values of columns, nulls told from empty strings."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns)), {"ignoreNullFields": "false"}), 256)


def build_cards(rows: DataFrame, table: str, meaning: Sequence[str], pattern: Sequence[str], references: Sequence[str] = (), kind: str = "definition", row: str = "__row") -> DataFrame:
    """A card per distinct values of ``meaning``: occurrences and the first row that has them.

    Cards with equal ``pattern`` columns share a pattern; ``references`` tell its variants.
    """
    found = rows.groupBy(*meaning).agg(F.count("*").alias("occurrences"), F.min(row).alias("first_row"))
    return found.select(
        F.concat(F.lit("card:"), F.substring(signature(meaning), 1, 24)).alias("card_id"),
        F.concat(F.lit("pattern:"), F.substring(signature(pattern), 1, 24)).alias("pattern_id"),
        signature(references).alias("reference_signature") if references else F.lit("").alias("reference_signature"),
        F.lit(table).alias("table_name"), F.lit(kind).alias("kind"), *meaning, "occurrences", "first_row",
    )


def card_sources(rows: DataFrame, meaning: Sequence[str], row: str = "__row") -> DataFrame:
    """(card_id, row): every row behind every card."""
    return rows.select(F.concat(F.lit("card:"), F.substring(signature(meaning), 1, 24)).alias("card_id"), F.col(row).alias("row"))


def table_quotas(rows: dict[str, int], weights: dict[str, int], total: int) -> dict[str, int]:
    """Share a number of cards over tables: one each, the rest by weight, never beyond a table's rows.

    The level at which ``level * weight`` cards a table use up the total, tables stopping at
    their rows, is found exactly; each takes the whole part, and cards left over go to the largest
    fractions.  Ties go to heavier tables, then by name; where not even one each is to be had, so do the cards.
    """
    able = sorted((t for t, n in rows.items() if n > 0 and weights.get(t, 0) > 0), key=lambda t: (-weights[t], t))
    if total <= len(able):
        return {t: int(t in able[: max(0, total)]) for t in rows}
    left, heavy = Fraction(total - len(able)), sum(weights[t] for t in able)
    share: dict[str, Fraction] = {}
    # those that the level reaches first are the ones with least room for their weight
    for t in sorted(able, key=lambda t: Fraction(rows[t] - 1, weights[t])):
        share[t] = min(Fraction(rows[t] - 1), left * weights[t] / heavy)
        left, heavy = left - share[t], heavy - weights[t]
    whole = {t: int(x) for t, x in share.items()}
    spare = min(total - len(able), sum(rows[t] - 1 for t in able)) - sum(whole.values())
    extra = sorted(able, key=lambda t: (whole[t] - share[t], -weights[t], t))[:spare]
    return {t: 1 + whole[t] + (t in extra) if t in share else 0 for t in rows}


def within_quota(cards: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Cards with ``kept``: the first of each table, by first row, up to its quota; the rest are reported, not lost."""
    most = max(quotas.values(), default=0)
    if most < 1:
        return cards.withColumn("kept", F.lit(False))
    allowed = F.create_map([F.lit(x) for kv in quotas.items() for x in kv])
    place = F.row_number().over(Window.partitionBy("table_name").orderBy("first_row", "card_id"))
    # no rank beyond the largest quota is needed, so Spark drops the rest before it exchanges
    first = cards.withColumn("place", place).where(F.col("place") <= most).where(F.col("place") <= allowed[F.col("table_name")])
    return cards.join(first.select("table_name", "card_id", F.lit(True).alias("kept")), ["table_name", "card_id"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def patterns(cards: DataFrame, kind: str | None = None) -> DataFrame:
    """A row per pattern: representative card, cards, records and reference variants."""
    cards = cards if kind is None else cards.where(F.col("kind") == kind)
    return cards.groupBy("pattern_id", "table_name").agg(
        F.min("card_id").alias("representative"), F.count("*").alias("cards"),
        F.sum("occurrences").alias("records"), F.count_distinct("reference_signature").alias("reference_variants"),
    )


def pattern_page(found: DataFrame, limit: int, page: int = 0) -> DataFrame:
    """A page of patterns, tables taken in turn, with the cards that stand before each.

    The order over all is that of (rank in the table, table, pattern).  A pattern
    of the page has no rank above the page's end, so Spark drops all others of a
    table before it exchanges, and one task sums a row for each of those ranks.
    """
    if not 0 < limit <= 10_000 or page < 0:
        raise ValueError("a page has 1 to 10000 patterns and a number from 0")
    ranked = found.withColumn("table_rank", F.row_number().over(Window.partitionBy("table_name").orderBy("pattern_id")))
    ranked = ranked.where(F.col("table_rank") <= (page + 1) * limit)
    order = ["table_rank", "table_name", "pattern_id"]
    sums = ranked.groupBy("table_rank").agg(F.sum("cards").alias("n"), F.count("*").alias("m"))
    before = Window.orderBy("table_rank").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("table_rank", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cards_before"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("patterns_before"))
    inside = Window.partitionBy("table_rank").orderBy("table_name", "pattern_id")
    out = ranked.join(sums, "table_rank").withColumns({
        "global_rank": F.col("patterns_before") + F.row_number().over(inside),
        "cards_before": F.col("cards_before") + F.coalesce(F.sum("cards").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    at = page * limit
    return out.where(F.col("global_rank").between(at + 1, at + limit)).drop("patterns_before").orderBy(*order)


def seeds(cards: DataFrame, per_table: int, window: int = 0, limit: int | None = None) -> DataFrame:
    """One window of each table's cards, tables in turn."""
    place = F.row_number().over(Window.partitionBy("table_name").orderBy("card_id"))
    out = cards.withColumn("place", place).where(F.col("place").between(window * per_table + 1, (window + 1) * per_table))
    out = out.orderBy("place", "table_name")
    return out if limit is None else out.limit(limit)


def coverage(channels: dict[str, DataFrame], records: DataFrame) -> DataFrame:
    """One row: records covered by each channel of (record), by any, and by several, through a bitmask."""
    bits = None
    for k, df in enumerate(channels.values()):
        part = df.select("record", F.lit(1 << k).alias("bit"))
        bits = part if bits is None else bits.unionAll(part)
    mask = bits.groupBy("record").agg(F.bit_or("bit").alias("mask"))
    joined = records.select("record").distinct().join(mask, "record", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    return joined.agg(
        F.count("*").alias("records"),
        *(F.count_if(F.col("mask").bitwiseAND(1 << k) != 0).alias(name) for k, name in enumerate(channels)),
        F.count_if(F.col("mask") != 0).alias("covered"),
        F.count_if(F.bit_count("mask") > 1).alias("overlapping"),
    )


#: Words of keys under which a JSON object says what something means, and of keys that only administer it.
MEANING_KEYS = r"(?:^|_)(?:meaning|definition|description|alias|aliases|synonym|synonyms|term|concept|formula|expression|reference|ref|code)(?:_|$)|词义|释义|同义|别名|定义|引用"
ADMINISTRATIVE_KEYS = r"^(?:language|locale|status|record|source|system|owner|created|updated|schema)(?:_|$)"


def tells_meaning(value: Column) -> Column:
    """Is the value a JSON object with something under a key that speaks of meaning?"""
    json = F.try_parse_json(value)
    object_ = F.coalesce(F.schema_of_variant(json).startswith("OBJECT"), F.lit(False))
    entries = F.map_entries(F.from_json(F.to_json(json), "map<string,string>"))
    speaks = lambda e: F.lower(e["key"]).rlike(MEANING_KEYS) & ~F.lower(e["key"]).rlike(ADMINISTRATIVE_KEYS) & ~F.coalesce(e["value"], F.lit("")).isin("", "[]", "{}")
    return object_ & F.coalesce(F.exists(entries, speaks), F.lit(False))
