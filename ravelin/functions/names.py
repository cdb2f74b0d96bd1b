"""Names of fields and tables: tokens, stems, and what a name may refer to."""

from __future__ import annotations

import re

#: Words of an identifier that say that it identifies, not what.
GENERIC = frozenset("id code key uuid ref fk no num number name pk".split())
#: Words of fields that hold keys, and of fields that hold names.
KEYS, NAMES = frozenset("id key code ref field".split()), frozenset("name alias synonym".split())
_WORDS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_a-zA-Z]+")


def tokens(name: str) -> tuple[str, ...]:
    """Words of a snake_case or camelCase identifier, in lower case."""
    return tuple(w.lower() for w in _WORDS.findall(name))


def stem(name: str) -> str:
    """What an identifier is about: its words without the generic ones."""
    return "_".join(w for w in tokens(name) if w not in GENERIC)


def singular(name: str) -> str:
    return name[:-1] if name.endswith("s") and not name.endswith("ss") else name


def refers(source: tuple[str, str], target: tuple[str, str], comment: str = "") -> bool:
    """May the field ``source`` (table, column) refer to ``target``, by names and its comment?

    Equal identifiers; equal stems of two identifying fields; a stem that names
    the target's table with a generic target column; or a comment that writes the
    target as table.column.
    """
    if source == target:
        return False
    (st, sc), (tt, tc) = source, target
    table = tt.rsplit(".", 1)[-1]
    if re.search(rf"(?<![\w.]){re.escape(table)}\.{re.escape(tc)}(?!\w)", comment, re.IGNORECASE):
        return True
    if st == tt:
        return False
    a, b = tokens(sc), tokens(tc)
    identifying = bool(set(a) & GENERIC - {"name"})
    if sc.lower() == tc.lower():
        return identifying
    own = stem(sc)
    if not own or not identifying:
        return False
    if own == stem(tc) and set(b) & GENERIC - {"name"}:
        return True
    named = {table.lower(), singular(table.lower())}
    return own in named and len(b) == 1 and b[0] in GENERIC


def plausible(source: tuple[str, str], target: tuple[str, str], comment: str = "") -> bool:
    """May values that two fields share mean a reference?  Between tables always; within one, by their names only."""
    a, b = set(tokens(source[1])), set(tokens(target[1]))
    alike = any(a & words and b & words for words in (KEYS, NAMES))
    return source != target and (source[0] != target[0] or alike or refers(source, target, comment))
