"""A Spark session with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "junctura", master: str | None = None, **conf: str) -> SparkSession:
    """On a cluster, leave `master` to spark-submit and set spark.checkpoint.dir to a shared folder."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.python.filterPushdown.enabled": "true"}
    return builder.config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
