"""Comparison of tools by gene, and evaluation against a truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import gene_key

#: Published accuracy of other tools (tool, TPR, FDR, F-score).
PUBLISHED = (
    ("rMATS-turbo", 0.612, 0.038, 0.732), ("LeafCutter", 0.648, 0.067, 0.752), ("MAJIQ", 0.589, 0.041, 0.711), ("SUPPA2", 0.523, 0.089, 0.643), ("DEXSeq", 0.567, 0.122, 0.658),
    ("JunctionSeq", 0.534, 0.105, 0.638), ("Whippet", 0.498, 0.078, 0.612), ("SplAdder", 0.476, 0.118, 0.582), ("ASGAL", 0.412, 0.143, 0.521), ("MntJULiP", 0.589, 0.092, 0.687),
    ("PSI-Sigma", 0.612, 0.058, 0.713), ("VAST-tools", 0.487, 0.095, 0.598), ("Spladder", 0.467, 0.121, 0.572), ("DARTS", 0.521, 0.067, 0.638), ("BRIE2", 0.398, 0.087, 0.512),
    ("Cufflinks", 0.343, 0.156, 0.443), ("DSGseq", 0.412, 0.134, 0.521), ("FineSplice", 0.467, 0.098, 0.587), ("diffSplice", 0.398, 0.143, 0.498), ("ASpli", 0.434, 0.112, 0.553), ("rMATS", 0.598, 0.043, 0.717),
)


def best_per_gene(results: DataFrame) -> DataFrame:
    """Per normalised gene the first non-null of each column in order of FDR."""
    w = Window.partitionBy("gene").orderBy(F.col("fdr").asc_nulls_last(), "event_type", "delta_psi").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = results.withColumn("gene", gene_key(F.col("gene_id")))
    first = lambda c: F.first(c, ignorenulls=True).over(w).alias(c)
    return rows.select("gene", first("significant"), first("delta_psi"), first("fdr")).distinct()


def match_by_gene(own: DataFrame, other: DataFrame, tool: str) -> DataFrame:
    """Full outer join of the best events; genes that one side lacks are not significant there."""
    name = lambda df, t: df.select(F.col("gene").alias("gene_id"), *(F.col(c).alias(f"{t}_{c}") for c in ("significant", "delta_psi", "fdr")))
    joined = name(best_per_gene(own), "own").join(name(best_per_gene(other), tool), "gene_id", "full_outer")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    joined = joined.withColumns({"own_significant": flag("own_significant"), f"{tool}_significant": flag(f"{tool}_significant")})
    return joined.withColumn("concordant", F.col("own_significant") & F.col(f"{tool}_significant"))


def significant_genes(results: DataFrame) -> DataFrame:
    return results.filter("significant").select("tool", gene_key(F.col("gene_id")).alias("gene")).distinct()


def concordance(results: DataFrame, own: str = "own") -> DataFrame:
    """Per other tool: its significant genes, shared and unshared ones, and the Jaccard index.

    `results` holds all tools' rows; one pass over genes with flags gives all figures.
    """
    genes = significant_genes(results)
    mine = genes.filter(F.col("tool") == own).select("gene", F.lit(1).alias("mine"))
    tools = results.select("tool").distinct().filter(F.col("tool") != own)
    total = mine.agg(F.count("*").alias("n_own"))
    each = genes.filter(F.col("tool") != own).join(mine, "gene", "left").groupBy("tool").agg(F.count("*").alias("n_significant"), F.count("mine").alias("shared"))
    out = tools.join(each, "tool", "left").fillna(0).crossJoin(F.broadcast(total))
    union = F.col("n_own") + F.col("n_significant") - F.col("shared")
    return out.select("tool", "n_significant", "shared", (F.col("n_own") - F.col("shared")).alias("own_only"), (F.col("n_significant") - F.col("shared")).alias("tool_only"), F.when(union > 0, F.col("shared") / union).otherwise(0.0).alias("jaccard"))


def exclusive_intersections(results: DataFrame, most: int | None = None) -> DataFrame:
    """How many genes are significant in exactly each combination of tools; the largest first."""
    combos = significant_genes(results).groupBy("gene").agg(F.array_join(F.sort_array(F.collect_set("tool")), "&").alias("tools"))
    counted = combos.groupBy("tools").agg(F.count("*").alias("n"))
    return counted if most is None else counted.orderBy(F.col("n").desc(), "tools").limit(most)


def jaccard_matrix(results: DataFrame) -> DataFrame:
    genes = significant_genes(results)
    sizes = genes.groupBy("tool").agg(F.count("*").alias("n"))
    a, b = genes.select(F.col("tool").alias("tool_a"), "gene"), genes.select(F.col("tool").alias("tool_b"), "gene")
    shared = a.join(b, "gene").groupBy("tool_a", "tool_b").agg(F.count("*").alias("shared"))
    left, right = sizes.select(F.col("tool").alias("tool_a"), F.col("n").alias("n_a")), sizes.select(F.col("tool").alias("tool_b"), F.col("n").alias("n_b"))
    every = left.crossJoin(F.broadcast(right)).join(shared, ["tool_a", "tool_b"], "left").fillna(0, ["shared"])
    return every.select("tool_a", "tool_b", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def in_all_tools(results: DataFrame) -> DataFrame:
    n = results.select(F.count_distinct("tool").alias("tools"))
    return significant_genes(results).groupBy("gene").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).filter("k = tools").select("gene")


def delta_correlation(matched: DataFrame, tool: str) -> DataFrame:
    """Pearson's r of differences over concordant genes, 0 where either does not vary."""
    x, y = F.col("own_delta_psi"), F.col(f"{tool}_delta_psi")
    figures = matched.filter("concordant").agg(F.corr(x, y).alias("r"), F.stddev_pop(x).alias("a"), F.stddev_pop(y).alias("b"), F.count("*").alias("n"))
    return figures.select("n", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("r")).otherwise(0.0).alias("r"))


def accuracy(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tpr, fdr = ratio(tp, tp + fn), ratio(fp, tp + fp)
    precision = 1 - fdr
    return {"tp": tp, "fp": fp, "fn": fn, "tpr": tpr, "fdr": fdr, "f_score": ratio(2 * precision * tpr, precision + tpr)}


def evaluate(results: DataFrame, truth: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(level, tp, fp, fn, tpr, fdr, f_score) by gene, by (gene, type) and within each type."""
    called = results.filter(F.col("fdr") < threshold).select(gene_key(F.col("gene_id")).alias("gene"), "event_type")
    real = truth.filter("is_differential").select(gene_key(F.col("gene_id")).alias("gene"), "event_type")

    def flags(keys: list[str]) -> DataFrame:
        a, b = called.select(*keys).distinct().withColumn("c", F.lit(1)), real.select(*keys).distinct().withColumn("t", F.lit(1))
        return a.join(b, keys, "full_outer")

    def counted(df: DataFrame, level: Column) -> DataFrame:
        c, t = F.col("c").isNotNull(), F.col("t").isNotNull()
        return df.groupBy(level.alias("level")).agg(F.count_if(c & t).alias("tp"), F.count_if(c & ~t).alias("fp"), F.count_if(~c & t).alias("fn"))

    events = flags(["gene", "event_type"])
    kinds = [k for k in ("SE", "A3SS", "A5SS", "MXE", "RI")]
    levels = called.sparkSession.createDataFrame([(x,) for x in ("gene", "event", *kinds)], "level string")
    counts = reduce(DataFrame.unionByName, [counted(flags(["gene"]), F.lit("gene")), counted(events, F.lit("event")), counted(events.filter(F.col("event_type").isin(kinds)), F.col("event_type"))])
    joined = levels.join(counts, "level", "left").fillna(0)
    return joined.select("level", *(c.alias(n) for n, c in accuracy(F.col("tp"), F.col("fp"), F.col("fn")).items()))


def rank_tools(metrics: DataFrame, published: DataFrame | None = None, own: str = "own") -> DataFrame:
    """Published tools and ours by F-score; rows of `published` (tool, tpr, fdr, fscore) override and add."""
    spark = metrics.sparkSession
    table = spark.createDataFrame(PUBLISHED, "tool string, tpr double, fdr double, f_score double")
    if published is not None:
        extra = published.select("tool", *(F.col(c).cast("double").alias(n) for c, n in (("tpr", "tpr"), ("fdr", "fdr"), ("fscore", "f_score"))))
        table = table.join(extra, "tool", "left_anti").unionByName(extra)
    ours = metrics.filter("level = 'gene'").select(F.lit(own).alias("tool"), "tpr", "fdr", "f_score")
    return table.unionByName(ours).withColumn("rank", F.row_number().over(Window.orderBy(F.col("f_score").desc(), "tool")))
