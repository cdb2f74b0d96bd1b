"""Small snapshots written as files, with what is to be found in them known by hand.

``linked``: a ship's call names a berth by its number, which is one only within a port, and only
once the ship is moored.  ``unrelated``: two tables number their rows alike and mean nothing by it.
``formula``: dues are computed from terms that a list defines.
"""

from __future__ import annotations

import json
from pathlib import Path

BERTHS = [("1", "Ostend", "ferry quay"), ("2", "Ostend", "coal pier"), ("1", "Bergen", "north wall"), ("3", "Bergen", "slip"), ("3", "Bergen", "slip, widened"), ("4", "Bergen", "dry dock")]
#: Port, stage and berth of ten calls, which further ones repeat: a found berth, one in the other port, one not moored, a missing and
#: a doubled berth, no stage, an empty reference, and three more.
CALLS = [("Ostend", "moored", "2"), ("Bergen", "moored", "1"), ("Bergen", "sailing", "H2"), ("Ostend", "moored", "9"), ("Bergen", "moored", "3"), ("Ostend", None, "1"), ("Ostend", "moored", ""), ("Bergen", "moored", "4"), ("Ostend", "moored", "1"), ("Ostend", "sailing", "K1")]
#: (call, berth) of the first ten calls, by row.
LINKS = [(1, 2), (2, 3), (8, 6), (9, 1)]
TERMS = [("1", "tonnage"), ("2", "rate"), ("3", "days"), ("4", "rebate")]
DUES = [("1", "light dues", "tonnage * rate"), ("2", "quay dues", "dues = tonnage * rate * days * (1 - 5%)"), ("3", "pilotage", "rate + surcharge"), ("4", "by agreement", "as agreed with the harbour master")]
#: (due, symbol, term) by id; None where no term is defined.  The last rule is no formula.
BINDINGS = [("1", "tonnage", "1"), ("1", "rate", "2"), ("2", "tonnage", "1"), ("2", "rate", "2"), ("2", "days", "3"), ("3", "rate", "2"), ("3", "surcharge", None)]
SCENARIOS = ("linked", "unrelated", "formula")


def tables(scenario: str, rows: int) -> dict[str, tuple[list[str], list[tuple], str | None]]:
    """Of each table its columns, rows and key."""
    if scenario == "linked":
        calls = [(str(k + 1), *CALLS[k % len(CALLS)], f"call {k + 1}") for k in range(rows)]
        return {"berths": (["berth_no", "port", "label"], BERTHS, None), "calls": (["call_id", "port", "stage", "berth", "remark"], calls, "call_id")}
    if scenario == "unrelated":
        return {
            "gauges": (["gauge_no", "height"], [(str(k), f"{k * 7 % 40} cm") for k in range(1, rows + 1)], "gauge_no"),
            "crews": (["crew_no", "flag"], [(str(k), "red" if k % 2 else "blue") for k in range(1, rows + 1)], "crew_no"),
        }
    if scenario == "formula":
        return {"terms": (["term_id", "name"], TERMS, "term_id"), "dues": (["due_id", "title", "rule"], DUES, "due_id")}
    raise ValueError(f"scenarios are {', '.join(SCENARIOS)}")


def _cell(value: str | None) -> str:
    """A null is nothing and an empty string is quoted."""
    if value is None:
        return ""
    return '"' + value.replace('"', '""') + '"' if value == "" or any(c in value for c in ',"\r\n') else value


def write(root: str, rows: int = len(CALLS), scenario: str = "linked") -> None:
    """schema/ and data/ of a scenario's tables in the schema harbour; the size of the list tables is fixed."""
    if rows < 1:
        raise ValueError("a demo has a row at least")
    made, base = tables(scenario, rows), Path(root)
    for part in ("schema/tables", "schema/constraints", "schema/foreign_keys", "data"):
        (base / part).mkdir(parents=True)
    for name, (columns, values, key) in made.items():
        own = {"table_schema": "harbour", "table_name": name}
        described = own | {"columns": [{"column_name": c, "data_type": "text", "column_comment": ""} for c in columns]}
        (base / "schema/tables" / f"{name}.yaml").write_text(json.dumps(described))
        keys = {"constraints": [own | {"constraint_definition": f"PRIMARY KEY ({key})"}] if key else []}
        (base / "schema/constraints" / f"{name}.yaml").write_text(json.dumps(keys))
        lines = [",".join(columns), *(",".join(map(_cell, row)) for row in values)]
        (base / "data" / f"{name}.csv").write_bytes("".join(line + "\r\n" for line in lines).encode())
