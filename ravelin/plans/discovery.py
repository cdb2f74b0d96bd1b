"""From a snapshot to checked references and rules.

Candidates come from declarations, names, shared values, branches of a discriminator,
equal scopes, strings inside JSON, and aliases; each is then checked exactly over all
rows.  Tables, fields and branches take turns for a budget, of which a third is kept for conditioned
candidates.  Every budget reports what it left out, and no declared reference is ever left out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import plausible, refers
from ..operators.profile import profile
from ..operators.recall import alias_pairs, branches, dictionary, hinted_branches, json_references, shared_values
from ..operators.reference import Reference, check, check_many
from ..sources.rows import materialise
from ..sources.snapshot import Snapshot
from .budgets import fair_branches, families_in_turn, targets_in_turn, weighted_turns, within_budget
from .roles import Column, Table, column_role, field_roles, row_purpose

AWAY = ("sensitive", "empty", "audit_time", "audit_metadata")


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Candidate:
    source: tuple[str, str]
    target: tuple[str, str]
    channels: tuple[str, ...]
    selector: tuple[tuple[str, str], ...] = ()
    scope: tuple[tuple[str, str], ...] = ()
    shared: int = 0
    numeric_only: bool = False
    transform: str = "identity"
    path: tuple[str, ...] = ()

    @property
    def conditioned(self) -> bool:
        return bool(self.selector or self.scope)

    def id(self, snapshot_id: str) -> str:
        return digest([self.source, self.target, self.selector, self.scope, self.transform, *([self.path] if self.path else []), snapshot_id])[:24]


@dataclass
class Found:
    candidates: list[Candidate]
    coverage: dict = field(default_factory=dict)


def profiled(snapshot: Snapshot) -> dict[str, Table]:
    """The catalogue with each column's usable and numeric counts."""
    out = {}
    for name, table in snapshot.tables.items():
        stats = {r["column"]: r for r in profile(snapshot.frames[name], [c.name for c in table.columns], approximate=False).collect()}
        columns = [replace(c, usable=stats[c.name]["usable_count"], rows=stats[c.name]["row_count"], numeric=stats[c.name]["numeric_shape_count"]) for c in table.columns]
        out[name] = replace(table, columns=columns)
    return out


def propose(snapshot: Snapshot, tables: dict[str, Table], *, most: int = 2000, per_source: int = 20, longest: int = 96, fanout: int = 32, looks: int = 12, literals: int = 64, depth: int = 16) -> Found:
    """Candidates from declared keys, names and comments, values that fields share, and what these lead to."""
    fields = [(t, c.name) for t, table in sorted(tables.items()) for c in table.columns if column_role(c, table)[0] not in AWAY]
    comments = {(t, c.name): c.comment for t, table in tables.items() for c in table.columns}
    channels: dict[tuple, set[str]] = {}
    declared = set()
    for t, table in tables.items():
        for column, to, key in table.foreign_keys:
            if to in tables:
                declared.add(((t, column), (to, key)))
                channels.setdefault(((t, column), (to, key)), set()).add("declared_fk")
    pk = {(t, c) for t, table in tables.items() for c in table.pk}
    queued = {"metadata": 0, "value_overlap": 0}

    def admit(source: tuple, targets: list[tuple], channel: str) -> None:
        for target in targets[:per_source]:
            channels.setdefault((source, target), set()).add(channel)
        queued[channel] += max(0, len(targets) - per_source)

    for source in fields:
        named = [target for target in fields if refers(source, target, comments[source])]
        admit(source, sorted(named, key=lambda f: (f not in pk, f)), "metadata")
    words = dictionary(snapshot.frames, fields, longest)
    shared: dict[tuple, tuple[int, bool]] = {}
    at = {f"{t}.{c}": (t, c) for t, c in fields}
    for r in shared_values(words, fanout).collect():  # a row per pair of fields of the catalogue
        for a, b in ((r["left"], r["right"]), (r["right"], r["left"])):
            if plausible(at[a], at[b], comments[at[a]]):
                shared[at[a], at[b]] = r["common_values"], r["numeric_only"]
    for source in fields:
        targets = sorted((b for a, b in shared if a == source), key=lambda b: (-shared[source, b][0], b not in pk, b))
        admit(source, targets, "value_overlap")
    ranked = sorted(channels, key=lambda p: (p not in declared, "metadata" not in channels[p], shared.get(p, (0, False))[1], -shared.get(p, (0, False))[0], p))
    kept = ranked[:most] + [p for p in ranked[most:] if p in declared]
    found = [Candidate(s, t, tuple(sorted(channels[s, t])), shared=shared.get((s, t), (0, False))[0], numeric_only=shared.get((s, t), (0, False))[1]) for s, t in kept]
    words = materialise(words)
    sizes = {at[r["field"]]: (r["n"], r["objects"]) for r in words.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.ltrim("value").startswith("{")).alias("objects")).collect()}  # a row a field
    usable = {(t, c.name): c.usable or 0 for t, table in tables.items() for c in table.columns}
    # a discriminator has few values, and each in two rows or more on average
    kinds = [f for f in fields if 2 <= sizes.get(f, (0, 0))[0] <= min(literals, usable[f] // 2)]
    for more, left in (
        _conditioned(snapshot, found, kinds, shared, looks),
        _in_json(snapshot, [f for f, (n, objects) in sizes.items() if 2 * objects > n], words, at, per_source, depth),
        _aliased(snapshot, tables, at, per_source),
    ):
        found += more
        queued |= left
    return Found(found, {"fields": len(fields), "candidates": len(found), "queued_by_budget": len(ranked) - len(kept), **{f"{k}_queued": n for k, n in queued.items()}})


def scopes_of(c: Candidate, shared: dict[tuple, tuple[int, bool]]) -> list[tuple[str, str]]:
    """(target column, source column) pairs of one name and with values in common, beside the fields themselves."""
    pairs = [(n, s, t) for (s, t), (n, _) in shared.items() if (s[0], t[0]) == (c.source[0], c.target[0]) and s[1].lower() == t[1].lower() and s != c.source and t != c.target]
    return [(t[1], s[1]) for _, s, t in sorted(pairs, key=lambda p: (-p[0], p[1:]))]


def _conditioned(snapshot: Snapshot, base: list[Candidate], kinds: list, shared: dict, looks: int) -> tuple[list[Candidate], dict[str, int]]:
    """Candidates with a scope of one name, with a selector whose branch hits more often than the rest, and with both.

    ``looks`` pairs of a candidate and a discriminator are looked at, sources, discriminators and target tables
    taking turns.  A literal that names the target's table is a selector too.
    """
    out, asked = [], []
    for c in base:
        if not c.shared:
            continue
        scope = scopes_of(c, shared)[:1]
        if scope:
            out.append(replace(c, scope=tuple(scope), channels=(*c.channels, "scope")))
        asked += [(c, scope, f) for f in kinds if f[0] == c.source[0] and f != c.source and f[1] not in [s for _, s in scope]]
    # fields that share only numbers share them by chance more often: the others go first
    asked = weighted_turns([fair_branches([a for a in asked if a[0].numeric_only == n], lambda a: a[0].source, lambda a: a[2], lambda a: a[0].target[0]) for n in (False, True)])
    for c, scope, kind in asked[:looks]:
        source, target = snapshot.frames[c.source[0]], snapshot.frames[c.target[0]]
        found = branches(source, target, c.source[1], c.target[1], kind[1]).where("improves").orderBy(F.desc("branch_matches"), "literal")
        named = {r["literal"] for r in hinted_branches(source, kind[1], [c.target[0]]).collect()}
        chosen = list(dict.fromkeys([r["literal"] for r in found.collect()] + sorted(named)))
        for literal in chosen:
            selected = replace(c, selector=((kind[1], literal),), channels=(*c.channels, "named_branch" if literal in named else "branch"))
            out += [selected] + ([replace(selected, scope=tuple(scope), channels=(*selected.channels, "scope"))] if scope else [])
    return out, {"branch": max(0, len(asked) - looks)}


def _in_json(snapshot: Snapshot, columns: list[tuple[str, str]], words: DataFrame, at: dict, per_source: int, depth: int) -> tuple[list[Candidate], dict[str, int]]:
    """References that the strings at a path of a JSON column make."""
    out, left = [], 0
    for t, column in sorted(columns):
        rows = json_references(snapshot.frames[t], column, words, depth).collect()  # a row a path and field
        mine = sorted((r for r in rows if at[r["field"]] != (t, column)), key=lambda r: (-r["shared"], r["path"], r["field"]))
        out += [Candidate((t, column), at[r["field"]], ("json_path",), shared=r["shared"], path=tuple(r["path"].split("."))) for r in mine[:per_source]]
        left += max(0, len(mine) - per_source)
    return out, {"json_path": left}


def _aliased(snapshot: Snapshot, tables: dict[str, Table], at: dict, per_source: int) -> tuple[list[Candidate], dict[str, int]]:
    """References through names and lists of aliases: columns that the roles say hold either, read folded."""
    values, lists = None, set()
    for t, table in sorted(tables.items()):
        roles = field_roles(table)
        lists |= {(t, c) for c in roles.get("alias", [])}
        for c in [*roles.get("alias", []), *roles.get("name", [])]:
            if (t, c) in at.values():
                part = snapshot.frames[t].select(F.lit(t).alias("table"), F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")).where("value IS NOT NULL").distinct()
                values = part if values is None else values.unionAll(part)
    if not lists or values is None:
        return [], {"alias": 0}
    pairs = sorted(((-r["shared_keys"], at[r["left"]], at[r["right"]]) for r in alias_pairs(values).collect()))  # a row a pair of fields
    # the side that lists aliases answers to them
    found = [Candidate(a, b, ("alias",), shared=-n, transform="target_alias_items" if a not in lists else "both_alias_items") for n, x, y in pairs for a, b in ((x, y), (y, x)) if b in lists]
    found = targets_in_turn(found, lambda c: c.source, lambda c: c.target[0], lambda c: (-c.shared, c.target, c.transform))
    return found[:per_source], {"alias": max(0, len(found) - per_source)}


def reference(c: Candidate) -> Reference:
    return Reference(c.source[1], c.target[1], dict(c.selector), dict(c.scope), c.transform, c.path)


def check_candidate(snapshot: Snapshot, c: Candidate) -> DataFrame:
    return check(snapshot.frames[c.source[0]], snapshot.frames[c.target[0]], reference(c))


#: Candidates checked in one job.
TOGETHER = 32


def checked(snapshot: Snapshot, candidates: list[Candidate]) -> list[dict | Exception]:
    """Counts of each candidate, many to a job; where a job fails, each by itself, so that one bad one costs only itself."""
    out: list[dict | Exception] = []
    for at in range(0, len(candidates), TOGETHER):
        group = candidates[at : at + TOGETHER]
        try:
            if not all(reference(c).direct for c in group):
                raise ValueError("checked one by one")
            asked = [(str(k), c.source[0], c.target[0], reference(c)) for k, c in enumerate(group)]
            found = {r["id"]: r.asDict() for r in check_many(snapshot.frames, asked).collect()}
            # a table without rows gives no row of counts
            out += [{k: v for k, v in found[i].items() if k != "id"} if (i := str(k)) in found else check_candidate(snapshot, c).first().asDict() for k, c in enumerate(group)]
        except Exception:  # noqa: BLE001
            for c in group:
                try:
                    out.append(check_candidate(snapshot, c).first().asDict())
                except Exception as e:  # noqa: BLE001  kept with its candidate
                    out.append(e)
    return out


def rule_status(counts: dict) -> str:
    """checked_technical where every eligible row has one target, observed_subset where some have, else unresolved."""
    if not counts["eligible_references"] or not counts["unique_matches"]:
        return "unresolved"
    return "checked_technical" if counts["unique_matches"] == counts["eligible_references"] else "observed_subset"


def rules(snapshot: Snapshot, found: Found, budget: int = 50, proposed: Sequence[Candidate] = ()) -> tuple[list[dict], dict]:
    """Checked candidates as rules, declared and named ones first; an error is kept with its candidate.

    ``proposed`` are candidates that were thought of elsewhere, with selectors,
    scopes or transforms; they are checked like the others, after declared ones,
    and once each.
    """
    known = {c.id(snapshot.id): c for c in [*found.candidates, *(replace(c, channels=("proposed",)) for c in proposed)]}
    rank = lambda c: ("declared_fk" not in c.channels, "proposed" not in c.channels, "metadata" not in c.channels, c.numeric_only, -c.shared, c.source, c.target, c.selector, c.scope, c.transform, c.path)
    first = lambda c: "declared_fk" in c.channels and not c.conditioned or "proposed" in c.channels
    family = lambda c: (c.source, c.target, c.scope)
    # a family's variants are its selectors; every family has a turn before any has two
    order = sorted(filter(first, known.values()), key=rank) + families_in_turn([c for c in known.values() if not first(c)], lambda c: ("metadata" not in c.channels, c.numeric_only), family, lambda c: c.source, rank)
    taken, left = within_budget(order, budget, lambda c: c.conditioned, lambda c: c.source[0], budget, lambda c: "declared_fk" in c.channels and not c.conditioned)
    out = []
    for c, counts in zip(taken, checked(snapshot, taken)):
        base = {"rule_id": "rule:" + c.id(snapshot.id), "source": c.source, "target": c.target, "channels": c.channels, "selector": dict(c.selector), "scope": dict(c.scope), "transform": c.transform, "path": c.path, "meaning": "unresolved"}
        out.append(base | ({"status": "check_error", "error": str(counts)[:500]} if isinstance(counts, Exception) else {"status": rule_status(counts), "checks": counts}))
    status = {s: sum(r["status"] == s for r in out) for s in {r["status"] for r in out}}
    return out, {"checked": len(out), "queued_by_budget": len(left), "status": status}


def run_status(coverage: dict, errors: int = 0) -> str:
    """complete, partial where a budget left something out, failed where nothing was checked."""
    if errors and errors == coverage.get("checked"):
        return "failed"
    return "partial" if errors or any(v for k, v in coverage.items() if k.endswith("queued") or k.startswith("queued")) else "complete"


def discover(snapshot: Snapshot, *, budget: int = 50, proposed: Sequence[Candidate] = (), **limits: int) -> dict:
    """The whole run: profile, propose, check, and say how far it came."""
    tables = profiled(snapshot)
    found = propose(snapshot, tables, **limits)
    checked, coverage = rules(snapshot, found, budget, proposed)
    coverage = found.coverage | coverage | {"queued_by_budget": found.coverage["queued_by_budget"] + coverage["queued_by_budget"]}
    purposes = {t: row_purpose(table)[0] for t, table in tables.items()}
    return {"snapshot_id": snapshot.id, "purposes": purposes, "rules": checked, "coverage": coverage, "status": run_status(coverage, coverage["status"].get("check_error", 0))}
