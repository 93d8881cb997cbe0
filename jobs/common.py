"""What the jobs share: config files, logs, scoped settings."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

log = logging.getLogger("junctura.jobs")
CONF = os.path.join(os.path.dirname(os.path.abspath(__file__)), "conf")


def config(path: str, defaults: dict, spark: SparkSession | None = None) -> dict:
    """The settings of a JSON file over `defaults`; names that no default has are errors.

    A bare name is one of the files in jobs/conf; other paths are read through Spark, so they
    may be remote.
    """
    if os.sep not in path:
        with open(os.path.join(CONF, path)) as f:
            told = json.load(f)
    else:
        told = json.loads((spark or SparkSession.active()).read.text(path, wholetext=True).first().value)
    if unknown := set(told) - set(defaults):
        raise ValueError(f"{path} has settings that the job does not know: {sorted(unknown)}")
    return defaults | told


@contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Session settings for a while; `__` in names stands for a dot."""
    names = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def observed(seen: Observation, rows: DataFrame, *aggregates) -> dict:
    """What was observed while `rows` were written.  Where no rows came out, adaptive execution drops the node that observes, and they are counted anew."""
    try:
        return seen.get
    except Py4JJavaError:
        return rows.agg(*aggregates).first().asDict()


def main_logging() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
