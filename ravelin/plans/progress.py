"""Says on stderr what a run is doing, one JSON object a line."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TextIO


@contextmanager
def stage(name: str, out: TextIO | None = sys.stderr) -> Iterator[dict]:
    """Reports begin and end of a stage with its seconds; what is put into the dict goes along.  ``out`` None: silence."""
    notes: dict = {}
    began, status = time.monotonic(), "failed"

    def say(**what) -> None:
        if out is not None:
            print(json.dumps({"stage": name, **what}, ensure_ascii=False, default=str), file=out, flush=True)

    say(event="begin")
    try:
        yield notes
        status = "done"
    finally:
        say(event=status, seconds=round(time.monotonic() - began, 3), **notes)
