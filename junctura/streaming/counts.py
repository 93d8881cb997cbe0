"""Junction counts over arriving reads, as an extension: the batch operators on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.reads import READS, junction_counts


def stream_reads(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of reads as they arrive in a folder."""
    return spark.readStream.schema(READS).parquet(path)


def stream_counts(reads: DataFrame, min_anchor: int = 6, min_mapq: int = 0) -> DataFrame:
    """The running counts of junction_counts(); write with output mode "complete" or "update"."""
    return junction_counts(reads, min_anchor, min_mapq)
