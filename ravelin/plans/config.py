"""A run as a file: where the data is, what is left out, and the limits, under one of a few profiles."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from ..sources.snapshot import load_yaml

#: What a run looks for, by name; each goes beyond the one before.
PROFILES = {"declared": {"per_source": 0, "looks": 0}, "values": {"looks": 0}, "full": {}}


@dataclass(frozen=True)
class Config:
    """Limits are those of ``discovery.propose``; ``folder`` and ``output`` are relative to the file."""

    folder: str
    output: str = "-"
    profile: str = "full"
    budget: int = 50
    exclude: tuple[str, ...] = ()
    quoted_newlines: bool = True
    limits: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        if self.profile not in PROFILES:
            raise ValueError(f"profiles are {', '.join(PROFILES)}")
        if self.budget < 0 or any(type(n) is not int or n < 0 for n in self.limits.values()):
            raise ValueError("limits are integers from 0")

    def as_dict(self) -> dict:
        return asdict(self)


def load(path: str) -> Config:
    """A configuration from a YAML file; a key that is not known is an error."""
    read = load_yaml(Path(path).read_text()) or {}
    unknown = set(read) - {f.name for f in fields(Config)}
    if unknown or "folder" not in read:
        raise ValueError(f"unknown: {sorted(unknown)}" if unknown else "folder is missing")
    base = Path(path).resolve().parent
    place = lambda p: p if p == "-" else str(base / p)
    limits = PROFILES.get(read.get("profile", "full"), {}) | (read.get("limits") or {})
    return Config(**(read | {"folder": place(read["folder"]), "output": place(read.get("output", "-")), "exclude": tuple(read.get("exclude") or ()), "limits": limits}))
