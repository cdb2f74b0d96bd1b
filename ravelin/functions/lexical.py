"""What a text says: whole members of lists, classes of things, fragments of formulas."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .formulas import parse
from .text import ALIAS_SEPARATORS, fold

#: Words that turn a statement round, and words of a class statement.
NEGATIONS = ("not", "no", "never", "without", "except", "excluding", "不", "非", "无", "未", "除")
CLASS_CUES = (r"is a kind of", r"is a type of", r"is an?", r"是一种", r"属于")
#: What stands alone in a cell that holds a part of a formula.
OPERATORS = frozenset("+ - * / ( ) = < > <= >= == != % and or not sum avg min max abs count".split())


def is_member(text: str | None, name: str | None) -> bool:
    """Is the name a whole item of the text, read as a JSON list or split at separators, and not denied there?"""
    if not text or not name or not fold(name):
        return False
    try:
        items = json.loads(text)
    except ValueError:
        items = None
    if not (isinstance(items, list) and all(isinstance(x, str) for x in items)):
        items = re.split(f"[{ALIAS_SEPARATORS}\n]", text)
    return any(fold(x) == fold(name) and not any(fold(x).startswith(n + " ") for n in NEGATIONS) for x in items)


def class_of(text: str | None) -> str | None:
    """The class a definition names: 'X is a kind of Y.' gives Y; none where it is denied."""
    found = re.search(rf"(?:{'|'.join(CLASS_CUES)})\s*([^.,;。，；\n]+)", text or "", re.IGNORECASE)
    if not found or re.match(rf"(?:{'|'.join(NEGATIONS)})\b", found[1].strip(), re.IGNORECASE):
        return None
    return found[1].strip() or None


def fragment_kind(value: str | None) -> str:
    """operator, operand, formula or text: what a cell in a column of formulas holds."""
    text = (value or "").strip()
    if not text:
        return "blank"
    if text.lower() in OPERATORS:
        return "operator"
    parsed = parse(text)
    if parsed["status"] != "parsed":
        return "text"
    return "formula" if '"of"' in parsed["tree"] else "operand"


@F.pandas_udf(T.BooleanType())
def member_of(texts: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([is_member(t, n) for t, n in zip(texts, names)], dtype=bool)


@F.pandas_udf(T.StringType())
def class_named(texts: pd.Series) -> pd.Series:
    return texts.map(class_of)


@F.pandas_udf(T.StringType())
def fragment_kinds(values: pd.Series) -> pd.Series:
    return values.map(fragment_kind)
