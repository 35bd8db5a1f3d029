"""What the jobs share: configuration files, command lines and logging."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

T = TypeVar("T")
log = logging.getLogger("larkspine.jobs")


def settings(kind: type[T], path: str | Path) -> T:
    """A job's settings from a JSON file on the driver's machine; unknown names are refused."""
    given = json.loads(Path(path).read_text("utf-8"))
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return kind(**given)


def command_line(description: str, paths: dict[str, str], job: Callable, kind: type, config: Path, argv: list[str] | None = None) -> None:
    """Parses paths and the configuration, creates a session, runs ``job(spark, settings=..., **paths)`` and stops the session."""
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(description=description)
    for name, text in paths.items():
        parser.add_argument(f"--{name.replace('_', '-')}", required=True, help=text)
    parser.add_argument("--config", default=str(config), help="settings in JSON")
    given = vars(parser.parse_args(argv))
    chosen = settings(kind, given.pop("config"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        job(spark, settings=chosen, **given)
    finally:
        spark.stop()
