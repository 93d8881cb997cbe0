"""The corpus pipeline: toxic, repeated and leaked documents go, then sources are mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from junctura.llm.common import read, stash
from junctura.llm.decontam import drop_leaks
from junctura.llm.exact import drop_exact
from junctura.llm.mixing import mix
from junctura.llm.neardup import drop_near
from junctura.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go.  Null and empty texts stay, all stay without labels of both classes; empty tables stay empty; extra columns are carried."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays, the longest, then the smallest doc_id; null counts as empty, rows without a doc_id stay; extra columns are carried."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, at 80 percent; texts without words and rows without a doc_id stay; extra columns are carried."""
    return drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts stay, all stay if the benchmark is empty; extra columns are carried."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target has it; null texts have no words, null sources are one source; an empty table stays empty."""
    return mix(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stash(docs, f"stage-{name}")
    return docs


#: Toxicity, near duplicates and alignments are beyond SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
