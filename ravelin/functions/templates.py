"""Texts as templates with named slots, e.g. ``sales of {product} in {region}``."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECE = re.compile(r"\{([a-z][a-z0-9_]*)\}|((?:(?!\{[a-z][a-z0-9_]*\}).)+)", re.DOTALL)
LONGEST = 256


class Ambiguous(ValueError):
    """Two slots meet with nothing between them and neither is known."""


@lru_cache(maxsize=4096)
def pieces(template: str) -> tuple[tuple[str, bool], ...]:
    """(name, True) of slots and (literal, False) of what stands between them."""
    return tuple((m[1], True) if m[1] else (m[2], False) for m in _PIECE.finditer(template))


def undecided(template: str, known: dict[str, str]) -> bool:
    """Do two different slots that nothing fills meet, each for the first time?"""
    met: set[str] = set()
    last_open = False
    for text, is_slot in pieces(template):
        is_open = is_slot and text not in known and text not in met
        if is_open and last_open:
            return True
        met |= {text} if is_open else set()
        # a slot that is to repeat an open one before it says as little of where that ends
        last_open = is_open or is_slot and last_open and text not in known
    return False


def match_text(template: str, text: str, known: dict[str, str]) -> dict[str, str] | None:
    """Known slots and those the text fills, or None; of several ways the one whose first slots are shortest.

    Literals and slots' values are compared as they stand.  The text is walked piece by piece; an
    open slot ends where the literal after it stands next, and is made longer only where the rest does not fit.
    """
    if undecided(template, known):
        raise Ambiguous("adjacent unbound slots")
    parts = pieces(template)

    def fits(k: int, at: int, filled: dict[str, str]) -> dict[str, str] | None:
        while k < len(parts):
            name, is_slot = parts[k]
            given = filled.get(name) if is_slot else name
            if given is None:
                break
            if not text.startswith(given, at):
                return None
            k, at = k + 1, at + len(given)
        if k == len(parts):
            return filled if at == len(text) else None
        after = "" if k + 1 == len(parts) or parts[k + 1][1] else parts[k + 1][0]
        if k + 1 == len(parts):
            return filled | {name: text[at:]} if 1 <= len(text) - at <= LONGEST else None
        end = at
        while (end := text.find(after, end + 1)) >= 0 and end - at <= LONGEST:
            if (found := fits(k + 1, end, filled | {name: text[at:end]})) is not None:
                return found
            if end >= len(text):
                break
        return None

    return fits(0, 0, dict(known))


def match_record(templates: dict[str, str], record: dict[str, str | None], known: dict[str, str] | None = None) -> dict[str, str] | None:
    """Slots that fit all of a record's templated fields at once, or None.

    A field in which open slots meet is left until others have filled one of them; if
    none does, Ambiguous is raised instead of a guess made.
    """
    if any(record.get(column) is None for column in templates):
        return None
    filled, left = dict(known or {}), list(templates)
    while left:
        column = next((c for c in left if not undecided(templates[c], filled)), None)
        if column is None:
            raise Ambiguous("adjacent unbound slots")
        left.remove(column)
        found = match_text(templates[column], record[column], filled)
        if found is None:
            return None
        filled = found
    return filled


def slots(templates: dict[str, str], known: dict[str, str] | None = None) -> Column:
    """A map of slots for each row, null where the row does not fit; the templates travel with the function."""
    columns = list(templates)

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def match(record: pd.DataFrame) -> pd.Series:
        def one(values):
            try:
                return match_record(templates, dict(zip(columns, (None if pd.isna(v) else v for v in values))), known)
            except Ambiguous:
                return None

        return pd.Series([one(v) for v in record.itertuples(index=False)], dtype=object)

    return match(F.struct(*(F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(columns))))


def bind(rows, templates: list[dict]):
    """Rows that some template binds: adds template_id, type_id and slots.

    templates: {template_id, type_id, rank, invariants: {column: value}, fields:
    {column: template}}.  All matching templates must agree on one type; then the
    best-ranked binds.  Rows that match none, or several types, are left out.
    """
    options = []
    for t in templates:
        fits = F.lit(True)
        for c, v in t.get("invariants", {}).items():
            fits = fits & F.coalesce(F.col(f"`{c}`") == v, F.lit(False))
        found = slots(t["fields"])
        options.append(F.when(fits & found.isNotNull(), F.struct(F.lit(t["rank"]).alias("rank"), F.lit(t["template_id"]).alias("template_id"), F.lit(t["type_id"]).alias("type_id"), F.map_entries(found).alias("slots"))))
    matched = rows.withColumn("__m", F.array_compact(F.array(*options)))
    matched = matched.where((F.size("__m") > 0) & (F.size(F.array_distinct(F.transform("__m", lambda x: x["type_id"]))) == 1))
    best = matched.withColumn("__b", F.array_min("__m"))
    return best.select(*rows.columns, F.col("__b.template_id").alias("template_id"), F.col("__b.type_id").alias("type_id"), F.map_from_entries("__b.slots").alias("slots"))
