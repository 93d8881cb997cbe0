"""Junctions: keys, annotation, per-sample vectors, recurrence, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["chrom", "start", "end", "strand"]
WEIGHTS = {"annotation": 0.25, "motif": 0.25, "recurrence": 0.20, "anchor": 0.15, "mapq": 0.15}


def donor() -> Column:
    return F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start"))


def acceptor() -> Column:
    return F.when(F.col("strand") == "-", F.col("start")).otherwise(F.col("end") - 1)


def key_string() -> Column:
    return F.format_string("%s:%d-%d:%s", "chrom", F.col("start").cast("bigint"), F.col("end").cast("bigint"), "strand")


def parse_key(column: str) -> Column:
    """struct<chrom,start,end,strand> of "chrom:start-end:strand"; null where it has no such form."""
    parts = F.regexp_extract(F.col(column), r"^([^:]*):(-?\d+)-(-?\d+)(?::(.*))?$", 1)
    get = lambda i: F.regexp_extract(F.col(column), r"^([^:]*):(-?\d+)-(-?\d+)(?::(.*))?$", i)
    return F.when(F.col(column).rlike(r"^[^:]*:-?\d+-(-?\d+)(:.*)?$"), F.struct(parts.alias("chrom"), get(2).cast("bigint").alias("start"), get(3).cast("bigint").alias("end"), get(4).alias("strand")))


def known_junctions(exons: DataFrame) -> DataFrame:
    """Distinct introns between consecutive exons of (transcript_id, chrom, strand, start, end)."""
    w = Window.partitionBy("gene_id", "transcript_id").orderBy("start", "end")
    gaps = exons.select("chrom", "strand", F.col("end").alias("s"), F.lead("start").over(w).alias("e")).filter("e > s")
    return gaps.select("chrom", F.col("s").alias("start"), F.col("e").alias("end"), "strand").distinct()


def annotate(junctions: DataFrame, known: DataFrame) -> DataFrame:
    """Adds is_annotated: whether the four keys are among the known ones."""
    marked = known.select(*KEY).distinct().withColumn("is_annotated", F.lit(True))
    return junctions.join(marked, KEY, "left").withColumn("is_annotated", F.coalesce("is_annotated", F.lit(False)))


def per_sample(counts: DataFrame) -> DataFrame:
    """Junction by sample: count, weighted count (count over mean NH), mean mapq and mean NH."""
    mean_nh = F.when(F.col("n") > 0, F.col("nh_sum") / F.col("n")).otherwise(1.0)
    return counts.withColumns({
        "mean_nh": mean_nh,
        "weighted": F.col("counts") / mean_nh,
        "mapq_mean": F.when(F.col("n") > 0, F.col("mapq_sum") / F.col("n")).otherwise(0.0),
    })


def vectors(counts: DataFrame, n_samples: int) -> DataFrame:
    """A row a junction with zero-filled arrays over samples 0..n-1, detection and recurrence."""
    spot = F.map_from_entries(F.collect_list(F.struct("sample_idx", F.struct("counts", "weighted", "mapq_mean", "mean_nh").alias("v"))))
    rows = per_sample(counts).groupBy(*KEY).agg(spot.alias("m"), F.max("max_anchor").alias("max_anchor"), F.count_if(F.col("counts") > 0).alias("n_samples_detected"))
    fill = lambda field, zero: F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)), lambda i: F.coalesce(F.element_at("m", i)[field], F.lit(zero)))
    return rows.withColumns({
        "sample_counts": fill("counts", 0),
        "sample_weighted": fill("weighted", 0.0),
        "sample_mapq": fill("mapq_mean", 0.0),
        "sample_nh": fill("mean_nh", 0.0),
        "recurrence": F.col("n_samples_detected") / F.lit(n_samples),
    }).drop("m")


def with_enough_reads(counts: DataFrame, min_reads: int) -> DataFrame:
    """Junctions whose counts over all samples reach min_reads; a chromosome with one such junction drops out."""
    totals = counts.groupBy(*KEY).agg(F.sum("counts").alias("total")).filter(F.col("total") >= min_reads)
    several = totals.groupBy("chrom").agg(F.count("*").alias("k")).filter("k >= 2").select("chrom")
    return counts.join(totals.select(*KEY), KEY, "left_semi").join(several, "chrom", "left_semi")


def confidence(evidence: DataFrame, n_samples: int, **weights: float) -> DataFrame:
    """Adds the five component scores and their weighted sum.

    Needs is_annotated, motif_score, recurrence, max_anchor and mapq_total, the sum of the
    samples' mean mapq; its mean is over all samples, those without the junction included.
    """
    weights = WEIGHTS | weights
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError(f"weights sum to {sum(weights.values())}, not 1")
    scores = {
        "annotation_score": F.when(F.col("is_annotated"), 1.0).otherwise(0.0),
        "motif_score_scaled": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("motif_score") - 0.2) / 0.8)),
        "recurrence_score": F.col("recurrence"),
        "anchor_score": F.least(F.lit(1.0), F.col("max_anchor") / 20.0),
        "mapq_score": F.least(F.lit(1.0), F.col("mapq_total") / F.lit(n_samples) / 60.0),
    }
    scored = evidence.withColumns(scores)
    return scored.withColumn("composite_score", sum((F.col(c) * w for c, w in zip(scores, weights.values())), F.lit(0.0)))


def confident(scored: DataFrame, least: float = 0.5) -> DataFrame:
    return scored.filter(F.col("composite_score") >= least)
