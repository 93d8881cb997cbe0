"""Result tables as they are written: results, junction details, summary."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import written

# The header lines that other programs read.
RESULTS = [
    "module_id", "gene_id", "gene_name", "chrom", "strand", "event_type", "n_junctions", "max_abs_delta_psi", "psi_group1_max_effect_junction", "psi_group2_max_effect_junction", "log_likelihood_null", "log_likelihood_full", "degrees_of_freedom", "p_value", "fdr", "confidence_tier",
    "null_converged", "full_converged", "mean_mapq", "frac_high_mapq", "min_group_total_reads", "effective_n_min", "mean_junction_confidence", "bootstrap_cv", "has_novel_junctions", "has_convergence_issue", "reason",
]
DETAILS = ["junction_id", "chrom", "start", "end", "strand", "gene_id", "gene_name", "is_annotated", "motif", "motif_score", "confidence_score", "nmd_class", "nmd_confidence", "n_productive_paths", "n_unproductive_paths", "total_reads", "mean_mapq", "cross_sample_recurrence", "sample_counts"]


def number(pattern: str, c: Column) -> Column:
    """C-style formatting, exact in the last digit.

    format_string rounds half up on the shortest decimal form, which differs from C on ties; these
    tables have a row a module or junction, so formatting on Arrow batches costs little.
    """

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else pattern % v for v in values.to_pylist()], pa.string())

    return text(c.cast("double"))


def boolean(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def largest_index(deltas: str = "delta_psi") -> Column:
    """0-based place of the largest magnitude in an array, the first of equals."""
    size = F.transform(deltas, lambda x: F.abs(x))
    return F.array_position(size, F.array_max(size)) - 1


def at_largest(values: str, deltas: str = "delta_psi") -> Column:
    return F.coalesce(F.try_element_at(F.col(values), (largest_index(deltas) + 1).cast("int")), F.lit(0.0))


def results_table(diff: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """The 27 columns, formatted; usage is that of the junction that changes most."""
    own = [c for c in diagnostics.columns if c == "module_id" or c not in diff.columns]
    joined = diff.join(diagnostics.select(own), "module_id")
    six, e = "%.6f", "%.6e"
    formats = {"max_abs_delta_psi": six, "log_likelihood_null": six, "log_likelihood_full": six, "p_value": e, "fdr": e, "mean_mapq": "%.2f", "frac_high_mapq": "%.4f", "min_group_total_reads": "%.1f", "effective_n_min": "%.2f", "mean_junction_confidence": "%.4f", "bootstrap_cv": "%.4f"}
    flags = {"null_converged", "full_converged", "has_novel_junctions", "has_convergence_issue"}
    out = []
    for c in RESULTS:
        if c.endswith("_max_effect_junction"):
            value = number(six, at_largest(c.removesuffix("_max_effect_junction")))
        elif c in formats:
            value = number(formats[c], F.col(c).cast("double"))
        else:
            value = boolean(F.col(c)) if c in flags else F.col(c).cast("string")
        out.append(value.alias(c))
    return joined.select(out)


def junction_details(evidence: DataFrame, nmd: DataFrame | None = None) -> DataFrame:
    """The 19 columns of (junction key, gene, annotation, motif, score, sample_counts); NA where nothing is known.

    cross_sample_recurrence is here the number of samples with reads.
    """
    key = ["chrom", "start", "end", "strand"]
    if nmd is None:
        evidence = evidence.withColumns({c: F.lit(None).cast(t) for c, t in (("classification", "string"), ("confidence", "double"), ("n_productive_paths", "bigint"), ("n_unproductive_paths", "bigint"))})
    else:
        evidence = evidence.join(nmd.select(*key, "classification", "confidence", "n_productive_paths", "n_unproductive_paths").dropDuplicates(key), key, "left")
    na = lambda c: F.coalesce(c.cast("string"), F.lit("NA"))
    nan = lambda c: F.coalesce(c.cast("double"), F.lit(float("nan")))
    values = [
        F.format_string("%s:%d-%d:%s", "chrom", F.col("start").cast("bigint"), F.col("end").cast("bigint"), "strand"), F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("strand"), na(F.col("gene_id")), na(F.col("gene_name")),
        boolean(F.coalesce("is_annotated", F.lit(False))), na(F.col("motif")), number("%.4f", nan(F.col("motif_score"))), number("%.4f", nan(F.col("composite_score"))), na(F.col("classification")),
        F.when(F.isnan(nan(F.col("confidence"))), "NA").otherwise(number("%.4f", F.col("confidence"))), na(F.col("n_productive_paths")), na(F.col("n_unproductive_paths")),
        number("%.1f", F.coalesce("total_reads", F.lit(0)).cast("double")), number("%.2f", nan(F.col("mean_mapq"))), F.size(F.filter("sample_counts", lambda c: c > 0)).cast("string"), F.array_join(F.col("sample_counts").cast("array<string>"), ","),
    ]
    return evidence.select(*(v.alias(n) for n, v in zip(DETAILS, values)))


def summary_table(diff: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(ord, Metric, Value): totals, types, significance, tiers, means and convergence, in the order written."""
    row = lambda o, m, v: F.struct(F.lit(o).alias("ord"), m.alias("Metric"), v.cast("string").alias("Value"))
    totals = diff.agg(F.array(row(0, F.lit("Total events"), F.count("*")), row(2, F.lit("Significant (FDR < 0.05)"), F.count_if(F.col("fdr") < 0.05)), row(3, F.lit("Significant (FDR < 0.01)"), F.count_if(F.col("fdr") < 0.01))).alias("r"))
    types = diff.groupBy("event_type").agg(F.count("*").alias("n")).select(F.array(row(1, F.col("event_type"), F.col("n"))).alias("r"))
    tiers = diagnostics.groupBy("confidence_tier").agg(F.count("*").alias("n")).select(F.array(row(4, F.concat(F.lit("Confidence "), "confidence_tier"), F.col("n"))).alias("r"))
    of = lambda c: F.concat(F.count_if(c).cast("string"), F.lit("/"), F.count("*").cast("string"))
    names = ("mean_mapq", "mean_junction_confidence", "bootstrap_cv")
    figures = diagnostics.agg(*(F.avg(c).alias(c) for c in names), of("null_converged").alias("null"), of("full_converged").alias("full"))
    means = figures.select(F.array(
        row(5, F.lit("Mean MAPQ (average)"), number("%.2f", F.col(names[0]))), row(6, F.lit("Mean junction confidence (average)"), number("%.4f", F.col(names[1]))), row(7, F.lit("Mean bootstrap CV (average)"), number("%.4f", F.col(names[2]))),
        row(8, F.lit("Null model converged"), F.col("null")), row(9, F.lit("Full model converged"), F.col("full")),
    ).alias("r"))
    return totals.unionByName(types).unionByName(tiers).unionByName(means).select(F.explode("r").alias("x")).select("x.*").orderBy("ord", "Metric")


def numbered(table: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the place of each row in the order of a distinct key, from 0, without a task that holds all rows.

    Rows are dealt over ranges of the key and written, so that a range stays what it is; a row's
    number is its place within its range and the rows of the ranges before, of which there are a
    few thousand.
    """
    ranged = written(table.repartitionByRange(F.col(key).asc_nulls_first()).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("__range", "n")).alias("r"))
    before = F.transform("r", lambda x: F.struct(x["__range"], F.aggregate(F.filter("r", lambda y: y["__range"] < x["__range"]), F.lit(0).cast("bigint"), lambda total, y: total + y["n"])))
    offsets = counts.select(F.map_from_entries(before).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(key).asc_nulls_first())) - 1
    placed = ranged.withColumn("__own", own).crossJoin(F.broadcast(offsets))
    return placed.withColumn(name, F.element_at("__before", F.col("__range")) + F.col("__own")).drop("__range", "__own", "__before")


def write_tsv(table: DataFrame, path: str, header: bool = True, order: list[str] | None = None) -> None:
    """One folder of tab-separated text.

    With `order`, parts are ranges of these columns, in order, each with the header that Spark's
    reader expects of every part; small tables come to one part.  Without, a single part, for
    tables of a row a tool or metric.
    """
    rows = table.coalesce(1) if order is None else table.orderBy(*order)
    rows.write.mode("overwrite").option("sep", "\t").option("quote", "\u0000").option("emptyValue", "").option("header", header).csv(path)


def save_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_stage(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_evidence(evidence: DataFrame, path: str) -> None:
    """Junction evidence with its per-sample arrays, as Parquet."""
    evidence.withColumn("junction_id", F.format_string("%s:%d-%d:%s", "chrom", "start", "end", "strand")).write.mode("overwrite").parquet(path)
