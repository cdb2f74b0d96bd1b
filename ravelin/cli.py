"""Command line: discover references in a folder, by a configuration, write a demo, export a catalogue."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ravelin", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    d = commands.add_parser("discover", help="check references between the tables of a folder")
    d.add_argument("folder")
    d.add_argument("--output", default="-")
    d.add_argument("--budget", type=int, default=50)
    d.add_argument("--exclude", action="append", default=[], help="schema.table.column that is never read into results")
    b = commands.add_parser("build", help="the run that a configuration file describes")
    b.add_argument("config")
    m = commands.add_parser("make-demo", help="write a small folder to try")
    m.add_argument("folder")
    m.add_argument("--rows", type=int, default=10)
    m.add_argument("--scenario", default="linked", choices=("linked", "unrelated", "formula"))
    e = commands.add_parser("export-catalog", help="write a folder's catalogue as metadata proposals")
    e.add_argument("folder")
    e.add_argument("output")
    a = parser.parse_args(args)
    if a.command == "make-demo":
        from .sources.demo import write

        write(a.folder, a.rows, a.scenario)
        return 0
    from pyspark.sql import SparkSession

    from .plans.config import Config, load
    from .plans.progress import stage
    from .sources.snapshot import from_files

    config = load(a.config) if a.command == "build" else Config(a.folder, a.output, budget=getattr(a, "budget", 50), exclude=tuple(getattr(a, "exclude", [])))
    spark = SparkSession.builder.appName("ravelin").getOrCreate()
    with stage("import") as notes:
        snapshot = from_files(spark, config.folder, config.exclude, config.quoted_newlines)
        notes["tables"] = len(snapshot.tables)
    if a.command == "export-catalog":
        from .sources.catalog import proposals

        Path(a.output).write_text(json.dumps(proposals(snapshot.tables), ensure_ascii=False, indent=1))
        return 0
    from .plans.discovery import discover

    with stage("discover") as notes:
        found = discover(snapshot, budget=config.budget, **config.limits)
        notes |= {"status": found["status"], "rules": len(found["rules"])}
    text = json.dumps(found, ensure_ascii=False, indent=1, default=str)
    Path(config.output).write_text(text) if config.output != "-" else print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
