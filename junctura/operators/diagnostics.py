"""Quality figures of a module and its confidence tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds and wording of the tiers.
HIGH = (
    ("mean_mapq >= 20", "mean_mapq >= 20"),
    ("frac_high_mapq >= 0.8", "frac_high_mapq >= 0.8"),
    ("min_group_total_reads >= 30", "min_group_reads >= 30"),
    ("effective_n_min >= 10", "effective_n >= 10"),
    ("mean_junction_confidence >= 0.7", "mean_junction_confidence >= 0.7"),
    ("bootstrap_cv < 0.3", "bootstrap_cv < 0.3"),
)
PRIOR_DOMINANCE = 0.1


def bootstrap_cv(boot: DataFrame) -> DataFrame:
    """(module_id, bootstrap_cv): median over junctions and samples of sd over mean, 0 where the mean is 0.01 or less."""
    n = F.size("replicates")
    mean = F.aggregate("replicates", F.lit(0.0), lambda a, x: a + x) / n
    sd = F.sqrt(F.aggregate(F.transform("replicates", lambda x: (x - F.col("m")) * (x - F.col("m"))), F.lit(0.0), lambda a, x: a + x) / (n - 1))
    cv = boot.withColumn("m", mean).select("module_id", F.when((n > 1) & (F.col("m") > 0.01), sd / F.col("m")).otherwise(0.0).alias("cv"))
    return cv.groupBy("module_id").agg(F.median("cv").alias("bootstrap_cv"))


def quality(cells: DataFrame) -> DataFrame:
    """Per module: mapq over non-empty cells, multi-mapped share, smallest sample totals, confidence, annotation."""
    seen = F.when(F.col("mapq") > 0, F.col("mapq"))
    by_cell = cells.groupBy("module_id").agg(
        F.coalesce(F.avg(seen), F.lit(0.0)).alias("mean_mapq"),
        F.coalesce(F.median(seen), F.lit(0.0)).alias("median_mapq"),
        F.coalesce(F.count_if(F.col("mapq") >= 20) / F.nullif(F.count(seen), F.lit(0)), F.lit(0.0)).alias("frac_high_mapq"),
        F.when(F.sum("count") > 0, 1 - F.sum("weighted") / F.sum("count")).otherwise(0.0).alias("frac_multi_mapped"),
    )
    totals = cells.groupBy("module_id", "sample_idx").agg(F.sum("count").alias("t"), F.sum("weighted").alias("w"))
    least = totals.groupBy("module_id").agg(F.min("t").cast("double").alias("min_group_total_reads"), F.min("w").alias("effective_n_min"))
    each = cells.groupBy("module_id", "j_idx").agg(F.max("composite_score").alias("c"), F.bool_or("is_annotated").alias("a"))
    junctions = each.groupBy("module_id").agg(
        F.avg("c").alias("mean_junction_confidence"),
        F.min("c").alias("min_junction_confidence"),
        (F.count_if("a") / F.count("*")).alias("frac_annotated_junctions"),
        (~F.bool_and("a")).alias("has_novel_junctions"),
        F.bool_or(F.col("c") < 0.3).alias("has_low_confidence_junction"),
    )
    return by_cell.join(least, "module_id").join(junctions, "module_id")


def tier() -> tuple[Column, Column]:
    """Tier and reason from the columns of quality(), bootstrap_cv and the two convergence flags."""
    both = F.col("null_converged") & F.col("full_converged")
    no_reads, weak = F.col("min_group_total_reads") == 0, F.col("min_junction_confidence") < 0.3
    failed = F.array_compact(F.array(*(F.when(~F.expr(rule), name) for rule, name in HIGH)))
    n = F.size(failed)
    steps = [
        (~both & no_reads, "FAIL", F.lit("Zero reads in one group")),
        (~both & weak, "FAIL", F.lit("All junctions have confidence < 0.3")),
        (weak, "FAIL", F.lit("All junctions have very low confidence")),
        (no_reads, "FAIL", F.lit("Zero reads in one group")),
        (~both, "LOW", F.lit("Model convergence failed")),
        (F.col("min_group_total_reads") < 10, "LOW", F.lit("Insufficient reads in one group (< 10)")),
        (F.col("bootstrap_cv") > 0.5, "LOW", F.lit("High bootstrap variability (CV > 0.5)")),
        (n == 0, "HIGH", F.lit("All quality criteria met")),
        (n <= 2, "MEDIUM", F.concat(F.lit("Failed criteria: "), F.array_join(failed, ", "))),
    ]
    grade, reason = F, F
    for test, label, why in steps:
        grade, reason = grade.when(test, label), reason.when(test, why)
    return grade.otherwise("LOW"), reason.otherwise(F.format_string("Failed %d quality criteria", n))


def diagnose(figures: DataFrame) -> DataFrame:
    grade, reason = tier()
    issue = ~(F.col("null_converged") & F.col("full_converged"))
    return figures.withColumns({"has_convergence_issue": issue, "prior_dominance": F.lit(PRIOR_DOMINANCE), "confidence_tier": grade, "reason": reason})


def tier_counts(diagnosed: DataFrame) -> DataFrame:
    return diagnosed.groupBy("confidence_tier").agg(F.count("*").alias("n"))
