"""Column expressions over raw string values.

Nothing here changes a value: ``001`` stays different from ``1``.  Trimming only
asks whether something is blank, and three notions of blank are kept apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters a profile counts as white space (ASCII white space, NBSP, ideographic space).
PROFILE_SPACE = " \t\n\x0b\x0c\r\u00a0\u3000"
#: Characters Python's str.strip removes.
STRIP_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Shapes of a whole value.
SHAPES = {
    "numeric": r"[+-]?[0-9]+(\.[0-9]+)?",
    "leading_zero": r"0[0-9]+",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
}
#: Joins the parts of an ordering key; it does not occur in ordinary values.
UNIT_SEPARATOR = "\x1f"


def full_match(value: Column, pattern: str) -> Column:
    """The whole value matches; unlike ``^...$`` not before a trailing newline."""
    return value.rlike(rf"\A(?:{pattern})\z")


def trimmed(value: Column, chars: str = " ") -> Column:
    return F.btrim(value, F.lit(chars))


def profile_usable(value: Column) -> Column:
    """Not null and not blank by a profile's white space."""
    return value.isNotNull() & (F.length(trimmed(value, PROFILE_SPACE)) > 0)


def join_usable(value: Column) -> Column:
    """Can take part in a reference check: not null, not empty, not only spaces. Never null."""
    return F.coalesce(F.trim(value) != "", F.lit(False))


def identity_usable(value: Column) -> Column:
    """Is a token of its own: something is left when all Unicode white space goes."""
    return F.coalesce(trimmed(value, STRIP_SPACE) != "", F.lit(False))


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def selected(selector: dict[str, str | None] | None) -> Column:
    """AND of column = literal in three-valued logic: null where that is unknown."""
    return all_of([F.col(f"`{c}`") == F.lit(v).cast("string") for c, v in (selector or {}).items()])


def json_leaf(value: Column, path: Sequence[str]) -> Column:
    """The string at an object-key path of JSON text.

    Null for invalid JSON, containers, numbers, booleans and missing keys: only
    a string is a reference.
    """
    if not 0 < len(path) <= 16 or any(not isinstance(k, str) or not k for k in path):
        raise ValueError("a path is 1 to 16 nonempty keys")
    steps = "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in path)
    leaf = F.try_variant_get(F.try_parse_json(value), "$" + steps, "variant")
    return F.when(F.schema_of_variant(leaf) == "STRING", F.variant_get(leaf, "$", "string"))


def ranked_by(*columns: Column) -> Column:
    """An order that does not depend on the order of rows: MD5 of the joined values."""
    return F.md5(F.concat_ws(UNIT_SEPARATOR, *columns))


def ratio(part: Column, whole: Column) -> Column:
    """Null, not zero, where there is nothing to divide by."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def decimal_of(value: Column, scale: int = 18) -> Column:
    """A finite decimal, or null."""
    return value.try_cast(f"decimal(38,{scale})")
