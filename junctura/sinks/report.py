"""Datasets of the reports, and one plain HTML page made of them."""

from __future__ import annotations

import html
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .drawings import scatter
from .tables import at_largest, boolean, number

TIERS = ("HIGH", "MEDIUM", "LOW", "FAIL")


def volcano(diff: DataFrame) -> DataFrame:
    """(module_id, delta, significance): signed difference of the top junction against -log10 FDR."""
    return diff.select("module_id", at_largest("delta_psi").alias("delta"), (-F.log10(F.greatest("fdr", F.lit(1e-300)))).alias("significance"))


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, from, to, n): equal bins between the bounds, the last one closed; NaN and null take no part."""
    values = df.select(F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    lo = F.lit(low) if low is not None else F.min("x")
    hi = F.lit(high) if high is not None else F.max("x")
    bounds = values.agg(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    bounds = bounds.select("lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    inside = values.crossJoin(F.broadcast(bounds)).filter("x between lo and hi").select(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    every = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    counted = inside.groupBy("bin").agg(F.count("*").alias("n"))
    return every.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("from"), (F.col("lo") + (F.col("bin") + 1) * width).alias("to"), F.coalesce("n", F.lit(0)).alias("n"))


def type_shares(diff: DataFrame) -> DataFrame:
    total = diff.agg(F.count("*").alias("t"))
    return diff.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("fdr") < 0.05).alias("n_significant")).crossJoin(F.broadcast(total)).select("event_type", "n", "n_significant", (F.col("n") / F.col("t")).alias("share"))


def tier_table(diagnosed: DataFrame) -> DataFrame:
    """Tiers in fixed order, also those without modules."""
    order = diagnosed.sparkSession.createDataFrame(list(enumerate(TIERS)), "ord int, confidence_tier string")
    return order.join(diagnosed.groupBy("confidence_tier").agg(F.count("*").alias("n")), "confidence_tier", "left").fillna(0).orderBy("ord")


def convergence(diagnosed: DataFrame) -> DataFrame:
    percent = lambda c: F.when(F.count("*") > 0, 100.0 * F.count_if(c) / F.count("*")).otherwise(0.0)
    return diagnosed.agg(percent(F.col("null_converged")).alias("null_percent"), percent(F.col("full_converged")).alias("full_percent"), percent(F.col("null_converged") & F.col("full_converged")).alias("both_percent"))


def junction_discovery(evidence: DataFrame) -> DataFrame:
    return evidence.agg(F.count("*").alias("n"), F.count_if("is_annotated").alias("n_annotated"), F.count_if(~F.col("is_annotated")).alias("n_novel"))


def motif_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("motif").agg(F.count("*").alias("n"))


def top_events(diff: DataFrame, diagnosed: DataFrame, n: int = 20, threshold: float = 0.05) -> DataFrame:
    """The n most significant modules with their tier."""
    best = diff.filter(F.col("fdr") < threshold).orderBy("fdr", "module_id").limit(n)
    return best.join(diagnosed.select("module_id", "confidence_tier"), "module_id", "left").withColumn("confidence_tier", F.coalesce("confidence_tier", F.lit("NA"))).orderBy("fdr", "module_id")


def overview(diff: DataFrame, diagnosed: DataFrame) -> DataFrame:
    return diff.join(diagnosed.select("module_id", "mean_mapq"), "module_id", "left").agg(F.count("*").alias("n_tested"), F.avg("mean_mapq").alias("mean_mapq"), F.count_if(F.col("fdr") < 0.05).alias("n_significant"), (100.0 * F.count_if(F.col("fdr") < 0.05) / F.nullif(F.count("*"), F.lit(0))).alias("percent_significant"))


def sheet_results(diff: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """Rows of the workbook's first sheet."""
    joined = diff.join(diagnosed.select("module_id", "confidence_tier"), "module_id", "left")
    colour: Column = F.when(F.col("fdr") < 0.05, "green").when(F.col("fdr") < 0.1, "yellow").otherwise("")
    return joined.select("module_id", "gene_id", "gene_name", "chrom", "strand", "event_type", "n_junctions", "max_abs_delta_psi", "log_likelihood_null", "log_likelihood_full", "degrees_of_freedom", "p_value", "fdr", F.coalesce("confidence_tier", F.lit("NA")).alias("confidence_tier"), colour.alias("fill"))


def arc_heights(junctions: DataFrame, n: str = "n") -> DataFrame:
    """Adds height, log1p of the count over that of the largest."""
    top = junctions.agg(F.max(n).alias("__top"))
    return junctions.crossJoin(F.broadcast(top)).withColumn("height", F.when(F.col("__top") > 0, F.log1p(n) / F.log1p("__top")).otherwise(0.0)).drop("__top")


def group_coverage(coverage: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean depth of a group's samples at each position; samples without reads there count as 0."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("k"))
    return coverage.join(F.broadcast(groups), "sample_idx").groupBy("label", "pos").agg(F.sum("depth").alias("d")).join(F.broadcast(sizes), "label").select("label", "pos", (F.col("d") / F.col("k")).alias("depth"))


def group_junctions(junctions: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts summed over a group and divided by its size, cut to whole numbers; zeros drop out."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("k"))
    summed = junctions.join(F.broadcast(groups), "sample_idx").groupBy("label", "start", "end").agg(F.sum("n").alias("s")).join(F.broadcast(sizes), "label")
    return summed.select("label", "start", "end", F.expr("s div k").alias("n")).filter("n > 0")


def html_table(df: DataFrame) -> str:
    """All rows of a summary, which has a row a type, tier or class."""
    rows = df.collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(f'{v:.4g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def html_bars(df: DataFrame, label: str, value: str) -> str:
    """Bars of all rows of a summary as inline SVG."""
    rows = [(str(r[label]), float(r[value])) for r in df.collect()]
    top = max([v for _, v in rows], default=0) or 1
    bars = "".join(f'<text x="0" y="{18 * k + 13}">{html.escape(n)}</text><rect x="160" y="{18 * k}" width="{400 * v / top:.1f}" height="14"/>' for k, (n, v) in enumerate(rows))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="600" height="{18 * len(rows) + 4}" font-size="12" fill="steelblue">{bars}</svg>'


def volcano_places(diff: DataFrame, cells: int = 120, threshold: float = 0.05) -> list[tuple[float, float, bool]]:
    """Points (x, y, marked) of the volcano.  Modules that fall on the same of cells by cells places are one point, so a page stays small and shows all."""
    points = volcano(diff).filter("delta is not null and significance is not null and not isnan(delta) and not isnan(significance)").withColumn("y", F.least("significance", F.lit(300.0)))
    bounds = points.agg(F.max(F.abs("delta")).alias("x"), F.max("y").alias("y")).first()
    if bounds.x is None:
        return []
    grid = lambda c, top: F.round(F.col(c) / ((top or 1.0) / cells)) * ((top or 1.0) / cells)
    marked = F.col("significance") > -math.log10(threshold)
    places = points.select(grid("delta", bounds.x).alias("x"), grid("y", bounds.y).alias("y"), marked.alias("m")).distinct()
    return sorted((r.x, r.y, r.m) for r in places.collect())


def volcano_chart(diff: DataFrame, cells: int = 120, threshold: float = 0.05) -> str:
    """The volcano as SVG."""
    return scatter(volcano_places(diff, cells, threshold), "difference in usage", "-log10 FDR", [-math.log10(threshold)])


def html_report(diff: DataFrame, diagnosed: DataFrame, evidence: DataFrame | None = None, het: DataFrame | None = None, nmd: DataFrame | None = None) -> str:
    """Sections on data, junctions, modules, tests, diagnostics and, where given, heterogeneity and consequences."""
    sections = [("Data", html_table(overview(diff, diagnosed)))]
    if evidence is not None:
        sections.append(("Junctions", html_table(junction_discovery(evidence)) + html_bars(motif_counts(evidence), "motif", "n")))
    sections.append(("Modules", html_table(type_shares(diff))))
    sections.append(("Differential usage", volcano_chart(diff) + html_bars(histogram(diff, "max_abs_delta_psi", 30, 0.0, 1.0), "from", "n") + html_bars(histogram(diff, "fdr", 30, 0.0, 1.0), "from", "n") + html_table(top_events(diff, diagnosed).select("module_id", "gene_name", "event_type", "max_abs_delta_psi", "fdr", "confidence_tier"))))
    sections.append(("Diagnostics", html_table(convergence(diagnosed)) + html_bars(tier_table(diagnosed), "confidence_tier", "n") + html_bars(histogram(diagnosed, "mean_mapq", 20), "from", "n")))
    if het is not None:
        sections.append(("Heterogeneity", html_bars(histogram(het, "heterogeneity_index", 20), "from", "n")))
    if nmd is not None:
        sections.append(("Coding consequences", html_table(nmd.groupBy("classification").agg(F.count("*").alias("n")))))
    body = "".join(f"<h2>{name}</h2>{content}" for name, content in sections)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Junction usage report</title></head><body><h1>Junction usage report</h1>{body}</body></html>'


def sheet_junctions(evidence: DataFrame) -> DataFrame:
    """Rows of the workbook's sheet on junctions."""
    total = F.aggregate(F.col("sample_counts").cast("array<bigint>"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return evidence.select(
        F.format_string("%s:%d-%d:%s", "chrom", F.col("start").cast("bigint"), F.col("end").cast("bigint"), "strand").alias("junction_id"), "chrom", "start", "end", "strand", boolean(F.col("is_annotated")).alias("is_annotated"), "motif", number("%.4f", F.col("motif_score")).alias("motif_score"),
        number("%.4f", F.coalesce("composite_score", F.lit(0.0))).alias("confidence_score"), total.alias("total_reads"), "n_samples_detected", number("%.4f", F.col("recurrence")).alias("cross_sample_recurrence"),
    )


def sheet_summary(diff: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """(ord, section, label, value) of the workbook's summary; quality is over modules with any mapq."""
    row = lambda o, s, m, v: F.struct(F.lit(o).alias("ord"), F.lit(s).alias("section"), m.alias("label"), v.cast("string").alias("value"))
    sig = lambda t: F.count_if(F.col("fdr") < t)
    of = lambda c: F.concat(F.count_if(c).cast("string"), F.lit("/"), F.count("*").cast("string"))
    figures = diff.agg(F.count("*").alias("n"), sig(0.05).alias("s5"), sig(0.01).alias("s1"), of("null_converged").alias("null"), of("full_converged").alias("full"), of("null_refit_used").alias("refit"))
    rate = F.when(F.col("n") > 0, F.concat(number("%.1f", F.col("s5") / F.col("n") * 100), F.lit("%"))).otherwise("0%")
    tested = figures.select(F.array(
        row(0, "Significance", F.lit("Total modules tested"), F.col("n")), row(1, "Significance", F.lit("Significant (FDR < 0.05)"), F.col("s5")), row(2, "Significance", F.lit("Significant (FDR < 0.01)"), F.col("s1")), row(3, "Significance", F.lit("Significance rate (FDR < 0.05)"), rate),
        row(5, "Convergence", F.lit("Null model converged"), F.col("null")), row(6, "Convergence", F.lit("Full model converged"), F.col("full")), row(7, "Convergence", F.lit("Null-refit applied"), F.col("refit")),
    ).alias("r"))
    types = diff.groupBy("event_type").agg(F.count("*").alias("n")).select(F.array(row(4, "Event Types", F.col("event_type"), F.col("n"))).alias("r"))
    tiers = diagnosed.groupBy("confidence_tier").agg(F.count("*").alias("n")).select(F.array(row(8, "Confidence Tiers", F.col("confidence_tier"), F.col("n"))).alias("r"))
    quality = diagnosed.filter("mean_mapq > 0").agg(F.avg("mean_mapq").alias("a"), F.median("mean_mapq").alias("m")).filter("a is not null")
    quality = quality.select(F.array(row(9, "Quality Metrics", F.lit("Mean MAPQ (across events)"), number("%.1f", F.col("a"))), row(10, "Quality Metrics", F.lit("Median MAPQ (across events)"), number("%.1f", F.col("m")))).alias("r"))
    return tested.unionByName(types).unionByName(tiers).unionByName(quality).select(F.explode("r").alias("x")).select("x.*").orderBy("ord", "label")


def title_rows(spark, samples: dict | None = None, parameters: dict | None = None) -> DataFrame:
    """(section, key, value) of a report's first page."""
    rows = [(s, str(k), str(v)) for s, d in (("Samples", samples or {}), ("Parameters", parameters or {})) for k, v in d.items()]
    return spark.createDataFrame(rows, "section string, key string, value string")
