"""Command line: ``python -m tickloom.cli COMMAND ...``; ``-h`` lists the commands and each one's arguments."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tickloom.functions.columns import instrument_key
from tickloom.plans import catalog, cycle, profiles, triage
from tickloom.plans.cards import evaluate_card
from tickloom.plans.views import Lane, TickLane
from tickloom.session import local_session
from tickloom.sources import logs, ticks

#: Each command's arguments and what it does.
COMMANDS = {
    "cycle": (("data", "root"), "a cycle over the test tables"),
    "ticks": (("ticks", "root", "years"), "a cycle over tick tables"),
    "triage": (("root", "summary"), "triage of a stored scoreboard"),
    "labels": (("ticks", "root", "year"), "forward labels of a year"),
    "daily": (("ticks", "years"), "daily tables of the dates that they lack"),
    "universe": (("path",), "a universe sidecar's status, or its bootstrap"),
    "recent": (("root",), "the factors that were materialised last"),
    "status": (("root",), "experiments by status and each log's newest row"),
    "query": (("name", "data"), "a query of the catalogue"),
    "card": (("file",), "the card gate"),
    "submission": (("file",), "the check of a submission (JSON)"),
}
OPTIONS = {
    "cycle": (("--config", ""), ("--labels", ""), ("--notes", "")),
    "ticks": (("--config", ""), ("--universe", ""), ("--labels", ""), ("--notes", "")),
    "triage": (("--labels", ""), ("--notes", "")),
    "labels": (("--universe", ""), ("--notes", "")),
    "universe": (("--source", ""), ("--column", "source_file")),
}
FLAGS = {"cycle": ("--no-reuse",), "ticks": ("--no-reuse", "--no-fill"), "universe": ("--force",), "daily": ("--force",)}


def _years(text: str) -> list[int]:
    return [int(y) for y in text.split(",")]


def _universe(spark: SparkSession, path: str):
    """A universe sidecar's rows; an error where a path was given and nothing is there, since results would carry a filter that was not applied."""
    if not path:
        return None
    if not ticks.universe_status(spark, path)["ready"]:
        raise FileNotFoundError(f"no universe at {path}: make it by the universe command")
    return spark.read.parquet(path)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tickloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (arguments, text) in COMMANDS.items():
        command = commands.add_parser(name, help=text)
        for argument in arguments:
            command.add_argument(argument)
        for option, default in OPTIONS.get(name, ()):
            command.add_argument(option, default=default)
        for flag in FLAGS.get(name, ()):
            command.add_argument(flag, action="store_true")
    o = parser.parse_args(argv)
    show = lambda value: print(json.dumps(value, indent=2, default=str))
    if o.command == "card":
        with open(o.file, encoding="utf-8") as f:
            result = evaluate_card(f.read())
        show({"decision": result.decision, "reasons": result.reasons})
        return int(result.decision == "fail")
    if o.command == "submission":
        errors = profiles.submission_errors(logs.read_json(o.file))
        show({"errors": errors})
        return int(bool(errors))
    spark = SparkSession.getActiveSession() or local_session()
    if o.command == "query":
        catalog.queries()[o.name](spark, o.data).show(50, truncate=False)
    elif o.command in ("cycle", "ticks"):
        config = cycle.CycleConfig.of(spark, logs.read_toml(o.config, spark)) if o.config else cycle.CycleConfig()
        if o.command == "cycle":
            lane: Lane = Lane(spark, o.data, **config.options())
        else:
            lane = TickLane(spark, o.ticks, _years(o.years), _universe(spark, o.universe), not o.no_fill, **config.options())
        out = cycle.run(spark, lane.sf_dir, o.root, lane=lane, config=config, reuse=not o.no_reuse, labels_path=o.labels or None, notes=o.notes)
        print(out["report"])
        show({k: v for k, v in out.items() if k != "report"})
    elif o.command == "triage":
        show(triage.run(spark, o.root, o.summary, o.labels or None, o.notes))
    elif o.command == "labels":
        show(cycle.export_labels(TickLane(spark, o.ticks, _years(o.year), _universe(spark, o.universe)), o.root, int(o.year), o.notes))
    elif o.command == "daily":
        for table, (source, columns) in ticks.MADE_OF.items():
            days = ticks.partition_dates(spark, o.ticks, source, _years(o.years))
            held = set() if o.force else set(ticks.partition_dates(spark, o.ticks, table, _years(o.years)))
            if due := [d for d in days if d not in held]:
                ticks.write_daily(spark, o.ticks, table, ticks.load(spark, o.ticks, source, due, list(columns)), o.force)
            show({"table": table, "built": due, "skipped": sorted(held & set(days))})
    elif o.command == "universe":
        if o.source:
            found = spark.read.parquet(o.source)
            if "instrument_key" not in found.columns:
                found = found.withColumn("instrument_key", instrument_key(o.column))
            show(ticks.write_universe(spark, found, o.path, o.force))
        else:
            show(ticks.universe_status(spark, o.path))
    elif o.command == "recent":
        show(cycle.recent(spark, o.root))
    else:
        show(cycle.status(spark, o.root))
    return 0


if __name__ == "__main__":
    sys.exit(main())
