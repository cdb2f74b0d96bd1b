"""Arrow functions for what no built-in expression can say: Unicode folding, keys, terms."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate the items of an alias list.
ALIAS_SEPARATORS = ";,\uff1b\uff0c\u3001|"
#: What equality between two fields may be read through.
TRANSFORMS = ("identity", "nfkc_whitespace_casefold", "source_alias_items", "target_alias_items", "both_alias_items")
_SPLIT = re.compile(f"[{ALIAS_SEPARATORS}]")
_HAN = re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff]+")
_WORD = re.compile(r"[a-z0-9_]+")
STRINGS = T.ArrayType(T.StringType())


def fold(value: str) -> str:
    """NFKC, white space made one space, case folded."""
    return " ".join(unicodedata.normalize("NFKC", value).split()).casefold()


def forms(value: str, items: bool) -> list[str]:
    """The folded value and, with ``items``, the folded items of the list it may be; distinct, sorted."""
    parts = [value, *(_SPLIT.split(value) if items and _SPLIT.search(value) else [])]
    return sorted({f for f in map(fold, parts) if f})


def search_terms(value: str) -> list[str]:
    """Terms of an index: runs of Han characters as 2- and 3-grams (one alone as itself), words of ASCII."""
    text = unicodedata.normalize("NFKC", value).casefold()
    found = set(_WORD.findall(text))
    for run in _HAN.findall(text):
        found.update(run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1))
        if len(run) == 1:
            found.add(run)
    return sorted(found)


def name_cues(value: str) -> list[str]:
    """What two names may share: the folded name, its Han 2-grams, its words of three letters and more."""
    text = fold(value)
    found = {"=" + text} if text else set()
    for run in _HAN.findall(text):
        found.update("g" + run[i : i + 2] for i in range(len(run) - 1))
    found.update("w" + w for w in re.findall(r"[a-z]{3,}", text))
    return sorted(found)


def _each(values: pd.Series, make) -> pd.Series:
    return values.map(lambda v: None if v is None else make(v))


@F.pandas_udf(T.StringType())
def folded(values: pd.Series) -> pd.Series:
    return _each(values, fold)


@F.pandas_udf(STRINGS)
def folded_value(values: pd.Series) -> pd.Series:
    return _each(values, lambda v: forms(v, False))


@F.pandas_udf(STRINGS)
def folded_items(values: pd.Series) -> pd.Series:
    return _each(values, lambda v: forms(v, True))


@F.pandas_udf(STRINGS)
def terms_of(values: pd.Series) -> pd.Series:
    return _each(values, search_terms)


@F.pandas_udf(STRINGS)
def cues_of(values: pd.Series) -> pd.Series:
    return _each(values, name_cues)
