"""What columns and tables are for, told from a catalogue and profiles: rules, no data scan.

A catalogue is small, so this runs on the driver.  Every answer carries its reason,
and what no rule settles stays ``unknown`` or ``unresolved``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.names import tokens

#: Words of names by the role they tell.
SENSITIVE = frozenset("password passwd pwd secret token credential credentials account_name connection_url private_key access_key api_key auth_header authorization dsn ssn id_card passport email mail phone mobile telephone tel bank_card card_no".split())
SENSITIVE_SAID = ("password", "secret", "credential", "access key", "private key", "e-mail", "email", "phone number", "密码", "口令", "密钥", "凭证", "凭据", "令牌", "身份证", "手机", "电话", "邮箱", "银行卡", "连接串", "隐私", "敏感")
AUDIT_TIME = frozenset("created updated modified deleted inserted gmt".split())
AUDIT_BY = frozenset("creator updater modifier operator".split())
IDENTIFYING = frozenset("id code key uuid no num ref pk fk".split())
FIELD_WORDS = {
    "alias": frozenset("alias aliases synonym synonyms".split()),
    "name": frozenset("name title label".split()),
    "description": frozenset("description desc definition comment remark meaning".split()),
    "formula": frozenset("formula expression calculation calc".split()),
    "unit": frozenset("unit uom currency".split()),
    "scope": frozenset("namespace scope tenant domain category type kind mode".split()),
}
#: What a comment says of a column, by field role; the name goes first.
FIELD_SAID = {
    "alias": ("alias", "synonym", "also known as", "别名", "同义词", "简称"),
    "formula": ("formula", "calculated as", "公式", "计算方式"),
    "description": ("description", "definition of", "meaning of", "定义", "描述", "说明", "口径"),
    "unit": ("unit of", "currency", "单位", "币种"),
    "scope": ("namespace", "tenant", "belongs to the", "命名空间", "租户", "所属", "类型", "类别"),
    "name": ("name of", "display name", "名称", "标题"),
}
#: What a comment says of a column that refers to another table.
REFERS_SAID = ("refers to", "reference to", "foreign key", "identifier of", "关联", "外键", "引用", "编码", "标识")
TIME_WORDS = frozenset("date time day month year quarter period week ts timestamp".split())
NUMERIC_TYPE = re.compile(r"\b(?:int|integer|bigint|smallint|tinyint|numeric|decimal|double|float|real|number|long)\b", re.IGNORECASE)
TEMPORAL_TYPE = re.compile(r"\b(?:date|time|timestamp|datetime)\b", re.IGNORECASE)
CONFIGURATION = frozenset("config configuration setting settings param parameter rule rules mapping dict dictionary".split())


@dataclass
class Column:
    name: str
    type: str = ""
    comment: str = ""
    usable: int | None = None
    rows: int | None = None
    numeric: int | None = None


@dataclass
class Table:
    name: str
    columns: list[Column]
    pk: list[str] = field(default_factory=list)
    foreign_keys: list[tuple[str, str, str]] = field(default_factory=list)
    comment: str = ""


def literal_type(declared: str) -> str:
    """string, integer, decimal, boolean, date or datetime for a declared SQL type."""
    kind = declared.lower()
    for pattern, name in ((r"bool", "boolean"), (r"timestamp|datetime", "datetime"), (r"\bdate\b", "date"), (r"\b(?:big|small|tiny)?int|integer|long", "integer"), (r"num|dec|double|float|real", "decimal")):
        if re.search(pattern, kind):
            return name
    return "string"


def sensitive(column: Column) -> bool:
    """Does a column's name or comment say that its values are not to be shown?"""
    words = tokens(column.name)
    pairs = {"_".join(p) for p in zip(words, words[1:])}
    return bool((set(words) | pairs) & SENSITIVE) or any(w in column.comment.lower() for w in SENSITIVE_SAID)


def column_role(column: Column, table: Table, excluded: frozenset[str] = frozenset()) -> tuple[str, str, bool]:
    """(role, reason, may take part in joins)."""
    words = set(tokens(column.name))
    if column.name in excluded:
        return "sensitive", "excluded by configuration", False
    if sensitive(column):
        return "sensitive", "name or comment", False
    if column.rows and column.usable == 0:
        return "empty", "no usable value in a full scan", False
    if words & AUDIT_TIME and (words & TIME_WORDS or words & {"at", "on"} or TEMPORAL_TYPE.search(column.type)):
        return "audit_time", "name", False
    if words & AUDIT_BY or words & AUDIT_TIME and "by" in words:
        return "audit_metadata", "name", False
    if column.name in table.pk or any(column.name == c for c, _, _ in table.foreign_keys) or words & IDENTIFYING:
        return "technical_identifier", "key or name", True
    if any(words & known for known in FIELD_WORDS.values()) or column.comment:
        return "semantic", "name or comment", True
    return "unknown", "no rule applies", True


def said_role(comment: str) -> str | None:
    """The field role that a comment tells, if it tells one: of several the one said first."""
    text = comment.casefold()
    places = [(at, role) for role, said in FIELD_SAID.items() for word in said if (at := text.find(word)) >= 0]
    return min(places)[1] if places else None


def role_conflicts(table: Table) -> dict[str, tuple[str, str]]:
    """Columns whose name and comment tell different field roles: (by name, by comment)."""
    by_name = {c: role for role, columns in field_roles(Table(table.name, [Column(c.name, c.type) for c in table.columns], table.pk)).items() for c in columns}
    said = {c.name: said_role(c.comment) for c in table.columns if not sensitive(c)}
    return {c: (by_name[c], r) for c, r in said.items() if r and by_name.get(c) not in (None, r, "reference", "identity")}


def context_roles(table: Table) -> dict[str, str]:
    """What each column that may be shown is in a record: identity, reference, time, quantity, a field role, or unknown."""
    by_field = {c: role for role, columns in field_roles(table).items() for c in columns}
    out = {}
    for c in table.columns:
        role, _, _ = column_role(c, table)
        if role in ("sensitive", "empty"):
            continue
        if role in ("audit_time", "audit_metadata"):
            out[c.name] = role
        elif c.name in by_field:
            out[c.name] = by_field[c.name]
        elif any(w in c.comment.casefold() for w in REFERS_SAID):
            out[c.name] = "reference"
        else:
            out[c.name] = "time" if is_temporal(c) else "quantity" if is_numeric(c) else "unknown"
    return out


def field_roles(table: Table) -> dict[str, list[str]]:
    """Columns by field role, by their names, else by their comments; an identifying suffix makes a column a reference,
    whatever else its name says."""
    out: dict[str, list[str]] = {}
    for c in table.columns:
        if sensitive(c):
            continue
        words = tokens(c.name)
        role = next((r for r, known in FIELD_WORDS.items() if set(words) & known), None) or said_role(c.comment)
        if words and words[-1] in IDENTIFYING or c.name in table.pk:
            role = "identity" if c.name in table.pk else "reference"
        elif role == "formula" and words[-1] in ("type", "mode", "kind"):
            role = "scope"
        if role:
            out.setdefault(role, []).append(c.name)
    return out


def is_numeric(c: Column) -> bool:
    return bool(NUMERIC_TYPE.search(c.type)) or bool(c.usable and c.numeric is not None and c.numeric >= 0.9 * c.usable)


def is_temporal(c: Column) -> bool:
    return bool(TEMPORAL_TYPE.search(c.type)) or bool(set(tokens(c.name)) & TIME_WORDS)


def row_purpose(table: Table) -> tuple[str, dict[str, list[str]]]:
    """(business_fact, definition_data, configuration_data or unresolved, the columns that speak for it)."""
    roles = field_roles(table)
    plain = [c for c in table.columns if column_role(c, table)[0] in ("semantic", "unknown")]
    values = [c.name for c in plain if is_numeric(c) and not is_temporal(c)]
    times = [c.name for c in table.columns if is_temporal(c) and column_role(c, table)[0] != "audit_time"]
    dimensions = roles.get("reference", [])
    found = {"numeric_business_value": values, "business_time": times, "dimension_coordinate": dimensions, "definition": roles.get("description", []) + roles.get("formula", [])}
    fact, definition = bool(values and dimensions and times), bool(found["definition"] and roles.get("name"))
    if fact and not definition:
        return "business_fact", found
    if definition and not fact:
        return "definition_data", found
    if not fact and set(tokens(table.name.rsplit(".", 1)[-1])) & CONFIGURATION and len(dimensions) >= 2:
        return "configuration_data", found
    return "unresolved", found


def candidate_grains(table: Table, most: int = 4) -> dict[str, list[str]]:
    """A few sets of columns that may tell rows apart; never all subsets."""
    roles, (purpose, found) = field_roles(table), row_purpose(table)
    sets = {"declared_primary_key": table.pk}
    sets |= {f"reference_{c}": [c] for c in roles.get("reference", [])[:2]}
    if roles.get("name"):
        sets |= {"name": roles["name"][:1], "name_and_scope": roles["name"][:1] + roles.get("scope", [])[:2]}
    if purpose == "business_fact":
        sets["observation"] = found["dimension_coordinate"][:2] + found["business_time"][:1]
    out: dict[str, list[str]] = {}
    for label, columns in sets.items():
        columns = list(dict.fromkeys(columns))[:most]
        if columns and columns not in out.values():
            out[label] = columns
    return out
