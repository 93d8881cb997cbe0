"""Junction counts that are kept up to date as files of aligned reads arrive.

    spark-submit jobs/junction_ledger.py --reads s3a://lab/reads --out s3a://lab/junctions --checkpoint s3a://lab/junctions-mark

Each run takes the files that no earlier run took (a file stream with the trigger availableNow;
its checkpoint is the mark) and ends.  A batch of files becomes one partial aggregate,

    parts/sample_idx=S/batch_id=B      counts of the batch,
    rejected/batch_id=B                records without a place or with a CIGAR that is none,

and the samples that it brought are published anew from their parts:

    counts/sample_idx=S                counts of all batches.

All are overwritten by partition, and a batch that is repeated after a failure has the files that
it had before, so any run can be started again.  Work and shuffle grow with the new reads and the
counts of their samples, not with what was counted before.  A file is told by its path: the
same records under another name count again.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, main_logging, observed
from junctura.operators.reads import JUNCTION, READS, junction_counts
from junctura.session import session

#: `schema` and `columns` (SQL by name; none: as they are) make reads of the files; see jobs/conf.
DEFAULTS = {"schema": READS, "columns": {}, "min_anchor": 6, "min_mapq": 0, "n_only": False, "files_per_batch": 1000}
COUNTS = "chrom string, start bigint, end bigint, strand string, counts bigint, mapq_sum double, mapq_sq_sum double, nh_sum double, n bigint, max_anchor bigint, sample_idx int"
PLACED = r"coalesce(sample_idx is not null and chrom is not null and pos is not null and flag is not null and cigar rlike '^([*]|([0-9]+[MIDNSHP=X])+)$', false)"


def _partition_overwrite(rows: DataFrame, path: str, *keys: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def take_batch(reads: DataFrame, batch_id: int, out: str, conf: dict) -> None:
    """Count one batch and publish its samples; doing it again changes nothing.

    Unmapped records may lack a place; other records without sample, flag, place or a proper CIGAR are set apart.
    """
    spark = reads.sparkSession
    unmapped = F.coalesce(F.col("flag").bitwiseAND(F.lit(4)) != 0, F.lit(False))
    good = unmapped | F.expr(PLACED)
    seen = Observation(f"batch {batch_id}")
    figures = [F.count("*").alias("read"), F.count_if(~good).alias("rejected")]
    rows = reads.observe(seen, *figures)
    counts = junction_counts(rows.filter(good & ~unmapped), conf["min_anchor"], conf["min_mapq"], conf["n_only"])
    _partition_overwrite(counts.withColumn("batch_id", F.lit(batch_id)), f"{out}/parts", "sample_idx", "batch_id")
    told = observed(seen, reads, *figures)
    if told["rejected"]:
        _partition_overwrite(reads.filter(~good).withColumn("batch_id", F.lit(batch_id)), f"{out}/rejected", "batch_id")

    parts = read_parts(spark, out)
    brought = parts.filter(F.col("batch_id") == batch_id).select("sample_idx").distinct()
    merged = parts.join(brought, "sample_idx", "left_semi").groupBy(*JUNCTION, "sample_idx").agg(
        *(F.sum(c).alias(c) for c in ("counts", "mapq_sum", "mapq_sq_sum", "nh_sum", "n")), F.max("max_anchor").alias("max_anchor")
    )
    published, figures = Observation(f"published {batch_id}"), [F.count("*").alias("rows"), F.coalesce(F.sum("counts"), F.lit(0)).alias("reads")]
    _partition_overwrite(merged.observe(published, *figures), f"{out}/counts", "sample_idx")
    made = observed(published, merged, *figures)
    log.info("batch %d: read %d records, rejected %d; published %d rows of %d junction reads", batch_id, told["read"], told["rejected"], made["rows"], made["reads"])


def read_parts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{COUNTS}, batch_id bigint").parquet(f"{out}/parts")


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """The published counts."""
    return spark.read.schema(COUNTS).parquet(f"{out}/counts")


def run(spark: SparkSession, reads: str, out: str, checkpoint: str, conf: dict | None = None) -> int:
    """Take the files in `reads` that are new since the checkpoint; the number of batches they made."""
    conf = DEFAULTS | (conf or {})
    stream = spark.readStream.schema(conf["schema"]).option("maxFilesPerTrigger", conf["files_per_batch"]).parquet(reads)
    if conf["columns"]:
        stream = stream.select(*(F.expr(sql).alias(name) for name, sql in conf["columns"].items()))
    types = {f.name: f.dataType for f in spark.createDataFrame([], READS).schema}
    stream = stream.select(*(F.col(name).cast(t) for name, t in types.items()))
    taken: list[int] = []

    def take(batch: DataFrame, batch_id: int) -> None:
        take_batch(batch, batch_id, out, conf)
        taken.append(batch_id)

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d new batches of %s", out, len(taken), reads)
    return len(taken)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--reads", required=True, help="folder of Parquet files of reads")
    parser.add_argument("--out", required=True)
    parser.add_argument("--checkpoint", required=True, help="folder of the mark; one for each --out")
    parser.add_argument("--config", default="junction_ledger.json", help="a name in jobs/conf, or a path")
    told = parser.parse_args(args)
    main_logging()
    spark = session("junction-ledger")
    try:
        run(spark, told.reads, told.out, told.checkpoint, config(told.config, DEFAULTS, spark))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
