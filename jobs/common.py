"""What the jobs share: their config files, their sessions and log lines."""

from __future__ import annotations

import json
import logging
import os
from argparse import ArgumentParser, Namespace
from collections.abc import Callable

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
log = logging.getLogger("jobs")


def settings(name: str, path: str | None = None) -> dict:
    """The job's own config file, with the entries of the file at `path` in place of its own. Unknown entries are an error."""
    with open(f"{HERE}/{name}.json") as f:
        own = json.load(f)
    if path:
        with open(path) as f:
            given = json.load(f)
        if unknown := set(given) - set(own):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        own |= given
    return own


def command_line(name: str, about: str, paths: dict[str, str], run: Callable[[SparkSession, Namespace, dict], None]) -> None:
    """Reads the arguments, makes a session, runs the job and stops the session."""
    parser = ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for k, what in paths.items():
        parser.add_argument(f"--{k}", required=True, help=what)
    parser.add_argument("--config", help=f"JSON file of settings in place of those of jobs/{name}.json")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, args, settings(name, args.config))
    finally:
        spark.stop()
