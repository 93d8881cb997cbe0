"""Significant modules in the formats of other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import at_largest, number, numbered


def _parsed(diff: DataFrame) -> DataFrame:
    """Adds the module's index in output order, and starts and ends of its junctions as arrays."""
    inner = lambda i: F.transform(F.filter("junction_coords", lambda c: c.rlike(r"^[^:]*:\d+-\d+(:|$)")), lambda c: F.regexp_extract(c, r"^[^:]*:(\d+)-(\d+)", i).cast("bigint"))
    return numbered(diff, "module_id", "idx").withColumns({"starts": inner(1), "ends": inner(2)}).withColumns({"lo": F.array_min("starts"), "hi": F.array_max("ends")})


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def rmats_format(diff: DataFrame, threshold: float = 0.05) -> DataFrame:
    """22 columns; counts are usage times 1000, cut; ids keep the index before filtering."""
    rows = _parsed(diff).filter((F.col("fdr") <= threshold) & (F.size("junction_coords") >= 2) & (F.size("starts") > 0))
    count = lambda c: (c * 1000).cast("bigint")
    inc = lambda c: F.when(F.col("n_junctions") > 1, count(_sum(F.slice(c, 1, F.greatest(F.col("n_junctions") - 1, F.lit(0)))))).otherwise(0)
    skip = lambda c: count(F.element_at(c, -1))
    span = F.col("hi") - F.col("lo")
    return rows.select(
        F.format_string("EVENT_%06d", "idx").alias("ID"), F.col("gene_id").alias("GeneID"), F.col("gene_name").alias("GeneName"), F.col("chrom").alias("chr"), "strand", F.col("lo").alias("exonStart_0base"), F.col("hi").alias("exonEnd"), F.col("lo").alias("upstreamES"), F.col("starts")[0].alias("upstreamEE"),
        F.when(F.size("ends") > 1, F.element_at("ends", -1)).otherwise(F.col("hi")).alias("downstreamES"), F.col("hi").alias("downstreamEE"), inc("psi_group1").alias("IC_SAMPLE_1"), skip("psi_group1").alias("SC_SAMPLE_1"), inc("psi_group2").alias("IC_SAMPLE_2"), skip("psi_group2").alias("SC_SAMPLE_2"),
        span.alias("IncFormLen"), F.greatest(F.lit(1), span).alias("SkipFormLen"), number("%.6e", F.col("p_value")).alias("PValue"), number("%.6e", F.col("fdr")).alias("FDR"), number("%.4f", at_largest("psi_group1")).alias("IncLevel1"), number("%.4f", at_largest("psi_group2")).alias("IncLevel2"), number("%.4f", F.col("max_abs_delta_psi")).alias("IncLevelDifference"),
    )


def leafcutter_format(diff: DataFrame, threshold: float = 0.05) -> DataFrame:
    rows = _parsed(diff).filter(F.col("fdr") <= threshold)
    return rows.select(
        F.format_string("cluster_%06d", "idx").alias("cluster"), F.col("gene_id").alias("gene"), F.col("chrom").alias("chr"), F.coalesce("lo", F.lit(0)).alias("start"), F.coalesce("hi", F.lit(0)).alias("end"), "n_junctions", F.array_join("junction_coords", ",").alias("exon_coords"),
        number("%.4f", at_largest("psi_group1")).alias("mean_psi_group1"), number("%.4f", at_largest("psi_group2")).alias("mean_psi_group2"), number("%.4f", F.col("max_abs_delta_psi")).alias("delta_psi"), number("%.4f", F.when(F.col("p_value") > 0, F.log10("p_value")).otherwise(-300.0)).alias("log_pval"), number("%.6e", F.col("fdr")).alias("fdr"),
    )


def change_probability() -> Column:
    """0.95 if some interval excludes 0, else 0.5 if some difference exceeds 0.1."""
    zipped = F.arrays_zip("delta_psi", "delta_psi_ci_low", "delta_psi_ci_high")
    sure = F.exists(zipped, lambda x: (x["delta_psi_ci_low"] > 0) | (x["delta_psi_ci_high"] < 0))
    return F.when(sure, 0.95).when(F.exists("delta_psi", lambda d: F.abs(d) > 0.1), 0.5).otherwise(0.0)


def majiq_format(diff: DataFrame) -> DataFrame:
    """(module_id, json): one document a module."""
    mean = _sum(F.col("delta_psi")) / F.size("delta_psi")
    doc = F.struct(F.col("module_id").alias("lsv_id"), "gene_id", "gene_name", "chrom", "strand", F.col("junction_coords").alias("junctions"), mean.alias("mean_delta_psi"), change_probability().alias("probability_of_change"), "fdr")
    return diff.select("module_id", F.to_json(doc).alias("json"))


def psi_documents(shares: DataFrame, boot: DataFrame) -> DataFrame:
    """(module_id, json) with usage and bounds as junction by sample matrices."""
    cells = shares.join(boot.select("module_id", "j_idx", "sample_idx", "ci_low", "ci_high"), ["module_id", "j_idx", "sample_idx"])
    rows = cells.groupBy("module_id", "j_idx").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "psi", "ci_low", "ci_high"))).alias("s"))
    matrices = rows.groupBy("module_id").agg(F.sort_array(F.collect_list(F.struct("j_idx", "s"))).alias("j"))
    take = lambda f: F.transform("j", lambda r: F.transform(r["s"], lambda x: x[f]))
    doc = F.struct(F.col("module_id").alias("lsv_id"), F.size(F.col("j")[0]["s"]).alias("n_samples"), F.size("j").alias("n_junctions"), take("psi").alias("psi_matrix"), take("ci_low").alias("ci_low"), take("ci_high").alias("ci_high"))
    return matrices.select("module_id", F.to_json(doc).alias("json"))


def bed_format(diff: DataFrame, threshold: float = 0.05) -> DataFrame:
    """A line a junction; the score is the difference times 1000, at most 1000."""
    rows = diff.filter(F.col("fdr") <= threshold).select("module_id", F.posexplode(F.arrays_zip("junction_coords", "delta_psi")).alias("j", "x"))
    part = lambda i: F.regexp_extract("x.junction_coords", r"^([^:]*):([^-:]*)-([^-:]*):([^:]*)", i)
    rows = rows.filter(F.col("x.junction_coords").rlike(r"^[^:]*:[^-:]*-[^-:]*:"))
    return rows.select(part(1).alias("chrom"), part(2).cast("bigint").alias("start"), part(3).cast("bigint").alias("end"), F.format_string("%s_%d", "module_id", "j").alias("name"), F.least(F.lit(1000), (F.abs("x.delta_psi") * 1000).cast("bigint")).alias("score"), part(4).alias("strand"))


def gtf_format(diff: DataFrame, threshold: float = 0.05, source: str = "junctura") -> DataFrame:
    """A feature a module, 1-based and closed."""
    rows = _parsed(diff).filter((F.col("fdr") <= threshold) & (F.size("starts") > 0))
    attributes = F.format_string('gene_id "%s"; gene_name "%s"; module_id "%s"; event_type "%s"; delta_psi "%s"; fdr "%s"', "gene_id", "gene_name", "module_id", "event_type", number("%.4f", F.col("max_abs_delta_psi")), number("%.6e", F.col("fdr")))
    return rows.select("chrom", F.lit(source).alias("source"), F.concat(F.lit("differential_event_"), "event_type").alias("feature"), (F.col("lo") + 1).alias("start"), F.col("hi").alias("end"), F.least(F.lit(1000), (-F.log10(F.col("fdr") + 1e-300)).cast("bigint")).alias("score"), "strand", F.lit(".").alias("frame"), attributes.alias("attributes"))
