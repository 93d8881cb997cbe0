"""Tables between stages, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or f"{tempfile.gettempdir()}/junctura-checkpoints").rstrip("/")


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table and read it back, which cuts its lineage and keeps plans short."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark))


def resumed(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that an earlier run finished at `path`; else it is made, in place of what a broken run left, and read back."""
    if not finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
