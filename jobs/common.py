"""What the jobs share: configuration files, the command line, the log, and a folder for a registered query's run."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import sys
import typing
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from fnatlas.session import shared_dir

T = typing.TypeVar("T")


def log(job: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{job}")


def configured(kind: type[T], values: dict) -> T:
    """A configuration from plain values; a name that the job doesn't know is an error, not silently left out."""
    names = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - names):
        raise ValueError(f"unknown settings: {', '.join(unknown)}; known are {', '.join(sorted(names))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def command_line(kind: type[T], run: Callable[[SparkSession, T], dict], doc: str, argv: list[str] | None = None) -> int:
    """Reads the configuration file and what the command line sets besides, starts a session, runs, logs, and stops it."""
    p = argparse.ArgumentParser(description=doc)
    p.add_argument("--config", help="a JSON file with settings")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting, as JSON or plain text; goes before the file's")
    a = p.parse_args(argv)
    values: dict = {}
    if a.config:
        with open(a.config) as f:
            values = json.load(f)
    for one in a.set:
        name, _, text = one.partition("=")
        try:
            values[name] = json.loads(text)
        except ValueError:
            values[name] = text
    config = configured(kind, values)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s", stream=sys.stderr)
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        print(json.dumps(run(spark, config), sort_keys=True))
    finally:
        spark.stop()
    return 0


def new_folder(spark: SparkSession, job: str) -> str:
    """A new, uniquely named folder under the shared one; its files stay."""
    return f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
