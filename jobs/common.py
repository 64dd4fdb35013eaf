"""What the jobs share: their settings and their log."""

from __future__ import annotations

import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession


def settings(name: str, path: str | None = None) -> dict:
    """A job's own settings file, with what another one gives instead."""
    with open(Path(__file__).with_name(f"{name}.json")) as f:
        found = json.load(f)
    if path:
        with open(path) as f:
            given = json.load(f)
        if unknown := set(given) - set(found):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        found |= given
    return found


def log(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
