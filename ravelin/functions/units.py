"""Names of units: expressions of one unit are one, different units stay different (MW is not mW).

A unit is a quotient of products of factors.  A factor is a symbol, or a word made of an
optional power word, an optional prefix word and a base word, with an optional power
behind it.  Symbols are taken as they stand, since case tells SI symbols apart; white space
says nothing.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of units and their symbols.
BASES = {"克": "g", "米": "m", "秒": "s", "分钟": "min", "小时": "h", "时": "h", "天": "d", "升": "L", "瓦": "W", "伏": "V", "安": "A", "帕": "Pa", "焦": "J", "吨": "t", "度": "°", "摄氏度": "°C", "人民币": "CNY", "元": "CNY", "美元": "USD", "欧元": "EUR", "日元": "JPY", "英镑": "GBP", "tonne": "t", "ton": "t", "metre": "m", "meter": "m", "gram": "g", "litre": "L", "liter": "L", "hour": "h", "second": "s", "watt": "W"}
#: Words of prefixes and their symbols.
PREFIXES = {"千": "k", "兆": "M", "毫": "m", "微": "µ", "厘": "c", "分": "d", "kilo": "k", "mega": "M", "milli": "m", "micro": "µ", "centi": "c"}
#: Words of powers.
POWERS = {"平方": 2, "立方": 3, "square": 2, "cubic": 3}
#: Words that name a prefixed unit without saying so.
WHOLE = {"公斤": "kg", "公里": "km"}
_OVER, _TIMES, _SPACE = re.compile(r"/|每|(?<=\s)per(?=\s)"), re.compile(r"[·*⋅∙×]"), re.compile(r"\s+")
_POWER = re.compile(r"\^?(-?\d+)\Z")


def _factor(word: str) -> tuple[str, int]:
    """(symbol, power) of one factor."""
    m = _POWER.search(word)
    power = int(m[1]) if m and m.start() else 1
    name = word[: m.start()] if m and m.start() else word
    if name in WHOLE:
        return WHOLE[name], power
    for text, own in POWERS.items():
        if name.startswith(text) and name != text:
            inner, more = _factor(name[len(text) :])
            return inner, own * power * more
    single = name[:-1] if name.endswith("s") and name[:-1] in BASES else name
    if single in BASES:
        return BASES[single], power
    for text, sign in PREFIXES.items():
        rest = single[len(text) :]
        base = BASES.get(rest) or BASES.get(rest.removesuffix("s"))
        if single.startswith(text) and base:
            return sign + base, power
    return name, power


def _runs_of_words(word: str) -> list[str]:
    """A word of several unit words in a row, as 千瓦时, cut into them; else itself."""
    if word in BASES or word in WHOLE or word.isascii():
        return [word]
    heads = sorted([*BASES, *(p + b for p in PREFIXES for b in BASES)], key=len, reverse=True)
    for head in heads:
        if word.startswith(head) and word != head and (rest := _runs_of_words(word[len(head) :])) and all(r in heads for r in rest):
            return [head, *rest]
    return [word]


def _written(factors: list[tuple[str, int]]) -> str:
    """kWh is written without a sign between, as it is by custom; other products with a dot."""
    shown = [s if p == 1 else f"{s}{p}" for s, p in factors]
    if len(shown) == 2 and shown[1] == "h" and shown[0].endswith(("W", "A")):
        return "".join(shown)
    return "·".join(shown)


def unit(value: str | None) -> str:
    """The canonical spelling; '' where there is none.  Case counts, as it does in SI symbols."""
    text = unicodedata.normalize("NFKC", value or "").replace("μ", "µ").strip()
    sides = []
    for part in _OVER.split(text):
        words = [w for w in _TIMES.split(_SPACE.sub("", part)) if w]
        sides.append(_written([_factor(x) for w in words for x in _runs_of_words(w)]))
    return "/".join(sides) if any(sides) else ""


@F.pandas_udf(T.StringType())
def canonical_unit(values: pd.Series) -> pd.Series:
    return values.map(unit)
