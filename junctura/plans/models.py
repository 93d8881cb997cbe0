"""Queries on usage, tests, diagnostics and their models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import dirichlet
from ..functions.special import chi2_sf
from ..operators import diagnostics as D
from ..operators import differential as T
from ..operators import events as E
from ..operators import fdr
from ..operators import modules as M
from ..operators import psi as P
from ..pipeline import Settings, analyse
from . import base as B

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _groups(spark):
    return T.label_frame(spark, B.LABELS)


@query("psi_point_estimate", f"WITH {B.EVIDENCE_SQL} SELECT module_id, j_idx, sample_idx, round(psi, 9) AS psi FROM psi")
def psi_estimate(spark, sf):
    return P.with_psi(B.evidence(spark, sf)).select("module_id", "j_idx", "sample_idx", F.round("psi", 9).alias("psi"))


_MEANS = "mn AS (SELECT module_id, j_idx, avg(psi) FILTER (label = 0) AS g1, avg(psi) FILTER (label = 1) AS g2 FROM psi GROUP BY ALL)"


@query("psi_group_difference", f"WITH {B.EVIDENCE_SQL}, {_MEANS} SELECT module_id, j_idx, round(g1, 9) AS psi_group1, round(g2, 9) AS psi_group2, round(g2 - g1, 9) AS delta_psi FROM mn")
def group_difference(spark, sf):
    rows = P.group_means(P.with_psi(B.evidence(spark, sf)), _groups(spark))
    return rows.select("module_id", "j_idx", *(F.round(c, 9).alias(c) for c in ("psi_group1", "psi_group2", "delta_psi")))


@query("psi_top_junction", f"WITH {B.EVIDENCE_SQL}, {_MEANS}, r AS (SELECT module_id, j_idx, round(abs(g2 - g1), 9) AS d, row_number() OVER (PARTITION BY module_id ORDER BY round(abs(g2 - g1), 9) DESC, j_idx) AS k FROM mn) SELECT module_id, j_idx, d AS max_abs_delta_psi FROM r WHERE k = 1")
def top_junction(spark, sf):
    return P.top_junction(group_difference(spark, sf)).select("module_id", "j_idx", "max_abs_delta_psi")


_BOOT = "bt AS (SELECT module_id, j_idx, sample_idx, label, b, ('0x' || substr(md5(module_id || ':' || j_idx || ':' || sample_idx || ':' || b), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x FROM ev, range(20) t(b))"


def _fixed_replicates(spark, sf):
    """Replicates that SQL can make too: uniform numbers from a digest."""
    u = lambda b: F.conv(F.substring(F.md5(F.concat_ws(":", "module_id", F.col("j_idx"), F.col("sample_idx"), b)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return B.evidence(spark, sf).select("module_id", "j_idx", "sample_idx", F.transform(F.sequence(F.lit(0), F.lit(19)), u).alias("replicates"))


@query("bootstrap_interval", f"WITH {B.EVIDENCE_SQL}, {_BOOT} SELECT module_id, j_idx, sample_idx, round(quantile_cont(x, 0.025), 9) AS ci_low, round(quantile_cont(x, 0.975), 9) AS ci_high, round(avg(x), 9) AS boot_mean, round(stddev_pop(x), 9) AS boot_sd FROM bt GROUP BY ALL")
def bootstrap_interval(spark, sf):
    """Replicates that are known, through the function that summarises drawn ones."""

    def run(frames):
        for df in frames:
            drawn = np.array(df["replicates"].to_list()).T
            low, high = P.intervals(drawn)
            yield df[["module_id", "j_idx", "sample_idx"]].assign(ci_low=low.round(9), ci_high=high.round(9), boot_mean=drawn.mean(0).round(9), boot_sd=drawn.std(0).round(9))

    rows = _fixed_replicates(spark, sf).select("module_id", "j_idx", "sample_idx", "replicates")
    return rows.mapInPandas(run, "module_id string, j_idx int, sample_idx int, ci_low double, ci_high double, boot_mean double, boot_sd double")


@query("bootstrap_delta_interval", f"WITH {B.EVIDENCE_SQL}, {_BOOT}, d AS (SELECT module_id, j_idx, b, avg(x) FILTER (label = 1) - avg(x) FILTER (label = 0) AS d FROM bt GROUP BY ALL) SELECT module_id, j_idx, round(quantile_cont(d, 0.025), 9) AS delta_psi_ci_low, round(quantile_cont(d, 0.975), 9) AS delta_psi_ci_high FROM d GROUP BY ALL")
def bootstrap_delta(spark, sf):
    rows = P.delta_intervals(_fixed_replicates(spark, sf), _groups(spark))
    return rows.select("module_id", "j_idx", *(F.round(c, 9).alias(c) for c in ("delta_psi_ci_low", "delta_psi_ci_high")))


@query("bootstrap_cv", f"WITH {B.EVIDENCE_SQL}, {_BOOT}, c AS (SELECT module_id, j_idx, sample_idx, CASE WHEN avg(x) > 0.01 THEN stddev_samp(x) / avg(x) ELSE 0 END AS cv FROM bt GROUP BY ALL) SELECT module_id, round(quantile_cont(cv, 0.5), 9) AS bootstrap_cv FROM c GROUP BY module_id")
def cv(spark, sf):
    return D.bootstrap_cv(_fixed_replicates(spark, sf)).withColumn("bootstrap_cv", F.round("bootstrap_cv", 9))


@query("bootstrap_multinomial")
def bootstrap_multinomial(spark, sf):
    """Multinomial replicates from seeded streams; tested against fixed draws."""
    return P.bootstrap(B.evidence(spark, sf)).drop("replicates")


@query("beta_posterior", f"WITH {B.EVIDENCE_SQL}, t AS (SELECT *, sum(count) OVER (PARTITION BY module_id, sample_idx) AS total FROM ev), p AS (SELECT module_id, j_idx, sample_idx, count + 0.5::DOUBLE AS a, total - count + 0.5::DOUBLE AS b FROM t) SELECT module_id, j_idx, sample_idx, round(a / (a + b), 9) AS psi, round(4 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) AS width FROM p")
def beta(spark, sf):
    from pyspark.sql import Window

    rows = B.evidence(spark, sf).withColumn("total", F.sum("count").over(Window.partitionBy("module_id", "sample_idx")))
    mean, width = P.beta_posterior(F.col("count"), F.col("total"))
    return rows.select("module_id", "j_idx", "sample_idx", F.round(mean, 9).alias("psi"), F.round(width, 9).alias("width"))


@query(
    "fdr_benjamini_hochberg",
    """WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 211 = 0 THEN 'NaN'::DOUBLE ELSE round(l_discount * l_tax, 6) END AS p_value FROM lineitem),
r AS (SELECT *, CASE WHEN isnan(p_value) THEN NULL ELSE p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, l_orderkey, l_linenumber) END AS raw, row_number() OVER (ORDER BY p_value, l_orderkey, l_linenumber) AS k FROM p)
SELECT l_orderkey, l_linenumber, p_value, CASE WHEN isnan(p_value) THEN 'NaN'::DOUBLE ELSE round(least(1.0::DOUBLE, min(raw) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 9) END AS fdr FROM r""",
)
def bh(spark, sf):
    p = F.when(F.col("l_partkey") % 211 == 0, F.lit(float("nan"))).otherwise(F.round(F.col("l_discount") * F.col("l_tax"), 6))
    rows = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p_value"))
    return fdr.benjamini_hochberg(rows).withColumn("fdr", F.round("fdr", 9))


@query("module_totals", f"WITH {B.EVIDENCE_SQL} SELECT module_id, sample_idx, sum(count)::BIGINT AS total, sum(weighted) AS total_weighted FROM ev GROUP BY ALL")
def totals(spark, sf):
    return M.module_totals(B.evidence(spark, sf))


@query("module_depth_filter", f"WITH {B.EVIDENCE_SQL}, t AS (SELECT module_id, sample_idx, sum(count) AS t FROM ev GROUP BY ALL), k AS (SELECT module_id FROM t GROUP BY module_id HAVING sum(t) >= 2400 AND count_if(t >= 1) >= 3) SELECT module_id, count(*) AS cells FROM ev JOIN k USING (module_id) GROUP BY module_id")
def depth(spark, sf):
    return M.with_depth(B.evidence(spark, sf), 2400, 3).groupBy("module_id").agg(F.count("*").alias("cells"))


@query("module_testable", f"WITH {B.EVIDENCE_SQL}, t AS (SELECT module_id, sample_idx, label, sum(count) AS t FROM ev GROUP BY ALL), g AS (SELECT module_id, label, sum(t) AS s, count_if(t > 0) AS k FROM t GROUP BY ALL) SELECT module_id FROM g GROUP BY module_id HAVING bool_and(s >= 1200 AND k >= 3)")
def testable(spark, sf):
    return M.testable(B.evidence(spark, sf), _groups(spark), 1200, 3)


@query("size_factors", f"WITH {B.EVIDENCE_SQL}, s AS (SELECT sample_idx, sum(count)::DOUBLE AS t FROM ev GROUP BY 1), f AS (SELECT sample_idx, t / (SELECT quantile_cont(t, 0.5) FROM s) AS f FROM s) SELECT sample_idx, round(f / exp((SELECT avg(ln(f)) FROM f)), 9) AS size_factor FROM f")
def size_factors(spark, sf):
    return M.size_factors(B.evidence(spark, sf)).withColumn("size_factor", F.round("size_factor", 9))


@query(
    "effective_lengths",
    """WITH j AS (SELECT p_partkey AS id, 'c' || p_size % 5 AS chrom, p_partkey % 40 AS s, p_partkey % 40 + 100 + p_size % 10 AS e FROM part), x AS (SELECT 'c' || s_suppkey % 5 AS chrom, s_suppkey * 7 % 40 - s_suppkey % 160 AS s, s_suppkey * 7 % 40 AS e, s_suppkey AS ord FROM supplier), y AS (SELECT 'c' || s_suppkey % 5 AS chrom, s_suppkey * 3 % 40 + 100 + s_suppkey % 10 AS s, s_suppkey * 3 % 40 + 100 + s_suppkey % 10 + s_suppkey % 130 AS e, 1000000 + s_suppkey AS ord FROM supplier),
a AS (SELECT * FROM x UNION ALL SELECT * FROM y), d AS (SELECT chrom, e AS s, arg_max(e - s, ord) AS n FROM a GROUP BY ALL), c AS (SELECT chrom, s AS e, arg_max(e - s, ord) AS n FROM a GROUP BY ALL)
SELECT id, CASE WHEN d.n IS NOT NULL AND c.n IS NOT NULL THEN greatest(1, least(d.n, 100) + least(c.n, 100) - 101 + 1)::DOUBLE ELSE 100.0::DOUBLE END AS eff_len FROM j LEFT JOIN d ON d.chrom = j.chrom AND d.s = j.s LEFT JOIN c ON c.chrom = j.chrom AND c.e = j.e""",
)
def lengths(spark, sf):
    p, k = F.col("p_partkey"), F.col("s_suppkey")
    js = B.table(spark, sf, "part").select(p.alias("id"), F.concat(F.lit("c"), F.col("p_size") % 5).alias("chrom"), (p % 40).alias("start"), (p % 40 + 100 + F.col("p_size") % 10).alias("end"))
    at = k * 3 % 40 + 100 + k % 10
    s = B.table(spark, sf, "supplier")
    exons = s.select(F.concat(F.lit("c"), k % 5).alias("chrom"), (k * 7 % 40 - k % 160).alias("start"), (k * 7 % 40).alias("end"), k.alias("ord")).unionByName(s.select(F.concat(F.lit("c"), k % 5).alias("chrom"), at.alias("start"), (at + k % 130).alias("end"), (k + 1_000_000).alias("ord")))
    return M.exon_aware_length(js, exons).select("id", F.col("eff_len").cast("double").alias("eff_len"))


@query("skipped_exon_lengths", "SELECT p_partkey, 100 + least(p_size * 20, 100) + greatest(0, p_size * 20 - 101 + 1) AS inclusion, 100 AS skipping, greatest(0, p_size * 20 - 101 + 1) AS body, CASE WHEN p_size % 3 > 0 THEN p_partkey / (p_size % 3)::DOUBLE ELSE 0 END AS norm FROM part")
def skipped(spark, sf):
    inclusion, skipping = M.skipped_exon_lengths(F.col("p_size") * 20, 101)
    return B.table(spark, sf, "part").select("p_partkey", inclusion.alias("inclusion"), skipping.alias("skipping"), M.exon_body_length(F.col("p_size") * 20, 101).alias("body"), M.normalised(F.col("p_partkey"), F.col("p_size") % 3).alias("norm"))


@query(
    "event_types",
    """WITH j AS (SELECT DISTINCT o_custkey AS m, l_linenumber % 3 * 100 AS s, l_linenumber % 3 * 100 + 100 + l_partkey % 3 * 100 AS e, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
k AS (SELECT m, s, e, CASE strand WHEN '-' THEN e - 1 ELSE s END AS d, CASE strand WHEN '-' THEN s ELSE e - 1 END AS a, row_number() OVER (PARTITION BY m ORDER BY s, e) AS i, count(*) OVER (PARTITION BY m) AS n FROM j),
w AS (SELECT m, any_value(n) AS n, max(s) FILTER (i = 1) AS s1, max(e) FILTER (i = 1) AS e1, max(d) FILTER (i = 1) AS d1, max(a) FILTER (i = 1) AS a1, max(s) FILTER (i = 2) AS s2, max(e) FILTER (i = 2) AS e2, max(d) FILTER (i = 2) AS d2, max(a) FILTER (i = 2) AS a2, max(s) FILTER (i = 3) AS s3, max(e) FILTER (i = 3) AS e3 FROM k GROUP BY m)
SELECT m::VARCHAR AS module_id, n AS n_junctions, CASE WHEN n = 2 AND d1 = d2 AND a1 <> a2 THEN 'A3SS' WHEN n = 2 AND a1 = a2 AND d1 <> d2 THEN 'A5SS' WHEN n = 2 AND ((s2 <= s1 AND e1 <= e2 AND s1 < e1) OR (s1 <= s2 AND e2 <= e1 AND s2 < e2)) THEN 'RI'
  WHEN n = 3 AND ((s1 = s2 AND e1 = e3 AND e2 <= s3) OR (s2 = s1 AND e2 = e3 AND e1 <= s3) OR (s3 = s1 AND e3 = e2 AND e1 <= s2)) THEN 'SE' ELSE 'Complex' END AS event_type FROM w""",
)
def event_types(spark, sf):
    joined = B.table(spark, sf, "orders").join(B.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    s = F.col("l_linenumber") % 3 * 100
    js = joined.select(F.col("o_custkey").cast("string").alias("module_id"), s.alias("start"), (s + 100 + F.col("l_partkey") % 3 * 100).alias("end"), F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand")).distinct()
    return E.classify(js)


@query("event_type_counts", "WITH t AS (" + SQL["event_types"] + ") SELECT event_type, count(*) AS n FROM t GROUP BY event_type")
def event_counts(spark, sf):
    return E.type_counts(event_types(spark, sf))


@query(
    "diagnostics_quality",
    f"""WITH {B.EVIDENCE_SQL}, t AS (SELECT module_id, sample_idx, sum(count)::DOUBLE AS t, sum(weighted) AS w FROM ev GROUP BY ALL), l AS (SELECT module_id, min(t) AS min_group_total_reads, min(w) AS effective_n_min FROM t GROUP BY 1),
j AS (SELECT module_id, j_idx, max(composite_score) AS c, bool_or(is_annotated) AS a FROM ev GROUP BY ALL), q AS (SELECT module_id, avg(c) AS mean_junction_confidence, min(c) AS min_junction_confidence, count_if(a) / count(*)::DOUBLE AS frac_annotated_junctions, NOT bool_and(a) AS has_novel_junctions, bool_or(c < 0.3) AS has_low_confidence_junction FROM j GROUP BY 1),
m AS (SELECT module_id, avg(mapq) FILTER (mapq > 0) AS mean_mapq, quantile_cont(mapq, 0.5) FILTER (mapq > 0) AS median_mapq, count_if(mapq >= 20) / count_if(mapq > 0)::DOUBLE AS frac_high_mapq, 1 - sum(weighted) / sum(count) AS frac_multi_mapped FROM ev GROUP BY 1)
SELECT module_id, round(mean_mapq, 6) AS mean_mapq, round(median_mapq, 6) AS median_mapq, round(frac_high_mapq, 6) AS frac_high_mapq, round(frac_multi_mapped, 6) AS frac_multi_mapped, min_group_total_reads, effective_n_min, round(mean_junction_confidence, 6) AS mean_junction_confidence, min_junction_confidence, round(frac_annotated_junctions, 6) AS frac_annotated_junctions, has_novel_junctions, has_low_confidence_junction FROM m JOIN l USING (module_id) JOIN q USING (module_id)""",
)
def diagnostics_quality(spark, sf):
    rows = D.quality(B.evidence(spark, sf))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_mapq", "median_mapq", "frac_high_mapq", "frac_multi_mapped", "mean_junction_confidence", "frac_annotated_junctions")})


@query(
    "diagnostics_tier",
    """WITH p AS (SELECT p_partkey AS module_id, p_partkey % 11 > 0 AS null_converged, p_partkey % 13 > 0 AS full_converged, p_size * 1.0::DOUBLE AS mean_mapq, (p_size % 11) / 10.0::DOUBLE AS frac_high_mapq, (p_partkey % 60)::DOUBLE AS min_group_total_reads, (p_partkey % 29)::DOUBLE AS effective_n_min, (p_size % 10) / 10.0::DOUBLE AS mean_junction_confidence, (p_partkey % 17) / 20.0::DOUBLE AS min_junction_confidence, (p_partkey % 7) / 10.0::DOUBLE AS bootstrap_cv FROM part),
f AS (SELECT *, null_converged AND full_converged AS ok, list_filter([CASE WHEN NOT mean_mapq >= 20 THEN 'mean_mapq >= 20' END, CASE WHEN NOT frac_high_mapq >= 0.8 THEN 'frac_high_mapq >= 0.8' END, CASE WHEN NOT min_group_total_reads >= 30 THEN 'min_group_reads >= 30' END, CASE WHEN NOT effective_n_min >= 10 THEN 'effective_n >= 10' END, CASE WHEN NOT mean_junction_confidence >= 0.7 THEN 'mean_junction_confidence >= 0.7' END, CASE WHEN NOT bootstrap_cv < 0.3 THEN 'bootstrap_cv < 0.3' END], lambda x: x IS NOT NULL) AS bad FROM p)
SELECT module_id, CASE WHEN (NOT ok AND (min_group_total_reads = 0 OR min_junction_confidence < 0.3)) OR min_junction_confidence < 0.3 OR min_group_total_reads = 0 THEN 'FAIL' WHEN NOT ok OR min_group_total_reads < 10 OR bootstrap_cv > 0.5 THEN 'LOW' WHEN len(bad) = 0 THEN 'HIGH' WHEN len(bad) <= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier,
  CASE WHEN NOT ok AND min_group_total_reads = 0 THEN 'Zero reads in one group' WHEN NOT ok AND min_junction_confidence < 0.3 THEN 'All junctions have confidence < 0.3' WHEN min_junction_confidence < 0.3 THEN 'All junctions have very low confidence' WHEN min_group_total_reads = 0 THEN 'Zero reads in one group' WHEN NOT ok THEN 'Model convergence failed' WHEN min_group_total_reads < 10 THEN 'Insufficient reads in one group (< 10)' WHEN bootstrap_cv > 0.5 THEN 'High bootstrap variability (CV > 0.5)' WHEN len(bad) = 0 THEN 'All quality criteria met' WHEN len(bad) <= 2 THEN 'Failed criteria: ' || array_to_string(bad, ', ') ELSE 'Failed ' || len(bad) || ' quality criteria' END AS reason FROM f""",
)
def diagnostics_tier(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    rows = B.table(spark, sf, "part").select(
        k.alias("module_id"), (k % 11 > 0).alias("null_converged"), (k % 13 > 0).alias("full_converged"), z.cast("double").alias("mean_mapq"), (z % 11 / 10.0).alias("frac_high_mapq"), (k % 60).cast("double").alias("min_group_total_reads"), (k % 29).cast("double").alias("effective_n_min"),
        (z % 10 / 10.0).alias("mean_junction_confidence"), (k % 17 / 20.0).alias("min_junction_confidence"), (k % 7 / 10.0).alias("bootstrap_cv"),
    )
    return D.diagnose(rows).select("module_id", "confidence_tier", "reason")


@query(
    "dm_log_likelihood",
    f"""WITH {B.EVIDENCE_SQL}, a AS (SELECT *, 0.5::DOUBLE + j_idx % 4 AS alpha FROM ev), t AS (SELECT module_id, sample_idx, sum(lgamma(alpha + count) - lgamma(alpha)) AS x, sum(alpha) AS sa, sum(count) AS n FROM a GROUP BY ALL)
SELECT module_id, round(sum(lgamma(sa) - lgamma(sa + n) + x), 4) AS log_likelihood FROM t GROUP BY module_id""",
)
def dm_likelihood(spark, sf):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        counts = P.matrix(g, "count").T
        alpha = 0.5 + np.array(sorted(g["j_idx"].unique())) % 4
        return pd.DataFrame({"module_id": [g["module_id"].iloc[0]], "log_likelihood": [dirichlet.log_likelihood(np.nan_to_num(counts), alpha)]})

    rows = B.evidence(spark, sf).select("module_id", "j_idx", "sample_idx", "count").groupBy("module_id").applyInPandas(run, "module_id string, log_likelihood double")
    return rows.withColumn("log_likelihood", F.round("log_likelihood", 4))


@query("dm_regression_fit")
def dm_fit(spark, sf):
    return T.fit_modules(B.evidence(spark, sf), B.LABELS)


@query("dm_free_fit")
def dm_free(spark, sf):
    """Free concentrations: one for all samples and one for each group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        counts = np.nan_to_num(P.matrix(g, "count").T)
        y = np.array([B.LABELS[s] for s in sorted(g["sample_idx"].unique())])
        null = dirichlet.fit_free(counts)
        _, _, full = dirichlet.fit_free_groups(counts, y)
        return pd.DataFrame({"module_id": [g["module_id"].iloc[0]], "log_likelihood_null": [null.log_likelihood], "log_likelihood_full": [full], "p_value": [chi2_sf(2 * (full - null.log_likelihood), counts.shape[1])]})

    return B.evidence(spark, sf).select("module_id", "j_idx", "sample_idx", "count").groupBy("module_id").applyInPandas(run, "module_id string, log_likelihood_null double, log_likelihood_full double, p_value double")


@query("differential_usage")
def differential_usage(spark, sf):
    return T.differential(B.evidence(spark, sf), B.LABELS)


@query("heterogeneous_usage")
def heterogeneous_usage(spark, sf):
    return T.heterogeneous(P.with_psi(B.evidence(spark, sf)), B.LABELS)


@query(
    "heterogeneity_variances",
    f"""WITH {B.EVIDENCE_SQL}, g AS (SELECT module_id, j_idx, avg(psi) FILTER (label = 0) AS m0, avg(psi) FILTER (label = 1) AS m1, avg(psi) AS m, var_samp(psi) FILTER (label = 0) AS v0, var_samp(psi) FILTER (label = 1) AS v1 FROM psi GROUP BY ALL), b AS (SELECT *, (3 * (m0 - m) * (m0 - m) + 3 * (m1 - m) * (m1 - m)) / 5 AS between_var FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY round(between_var, 12) DESC, j_idx) AS k FROM b)
SELECT module_id, round(between_var, 9) AS between_group_variance, round((v0 + v1) / 2 / (between_var + 1e-8::DOUBLE), 4) AS heterogeneity_index FROM r WHERE k = 1""",
)
def heterogeneity_variances(spark, sf):
    rows = heterogeneous_usage(spark, sf)
    return rows.select("module_id", F.round("between_group_variance", 9).alias("between_group_variance"), F.round("heterogeneity_index", 4).alias("heterogeneity_index"))


@query("covariate_z_scores", "SELECT c_custkey, CASE WHEN stddev_pop(c_acctbal) OVER w > 0 THEN round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 6) ELSE 0 END AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment)")
def z_scores(spark, sf):
    """Customers of a nation and segment as samples, their balance as covariate."""
    rows = B.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    return P.z_scores(rows, "c_acctbal", ["c_nationkey", "c_mktsegment"], "z").select("c_custkey", F.round("z", 6).alias("z"))


@query("softmax", f"WITH {B.EVIDENCE_SQL}, m AS (SELECT *, max(norm) OVER (PARTITION BY module_id, sample_idx) AS top FROM ev) SELECT module_id, j_idx, sample_idx, round(exp(norm - top) / sum(exp(norm - top)) OVER (PARTITION BY module_id, sample_idx), 9) AS p FROM m")
def softmax(spark, sf):
    rows = P.softmax(B.evidence(spark, sf).select("module_id", "j_idx", "sample_idx", "norm"), "norm", ["module_id", "sample_idx"], "p")
    return rows.select("module_id", "j_idx", "sample_idx", F.round("p", 9).alias("p"))


def _analysed(spark, sf, **settings):
    genes = B.loci_genes(spark, sf)
    start = F.col("start")
    exon = lambda a, b: genes.select("gene_id", F.concat("gene_id", F.lit(".1")).alias("transcript_id"), "chrom", "strand", (start + a).alias("start"), (start + b).alias("end"))
    return analyse(B.loci(spark, sf), genes, exon(900, 1030).unionByName(exon(1230, 1400)), B.LABELS, settings=Settings(min_cluster_reads=4, het=False, **settings))


@query("whole_analysis")
def whole_analysis(spark, sf):
    """Reads to tested modules in one plan; the tests hold it against the genes that are known to change."""
    res = _analysed(spark, sf)
    return res.diff.join(res.diagnostics.select("module_id", "confidence_tier"), "module_id").select("module_id", "event_type", "n_junctions", "max_abs_delta_psi", "p_value", "fdr", "confidence_tier")


@query(
    "whole_analysis_usage",
    f"""WITH {B.LOCI_SQL}, c AS (SELECT locus, sample_idx, s, e, count(*) AS n FROM loci GROUP BY ALL),
k AS (SELECT a.locus, a.s, a.e, i AS sample_idx, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT locus, s, e FROM c) a CROSS JOIN range(6) t(i) LEFT JOIN c ON c.locus = a.locus AND c.e = a.e AND c.sample_idx = i),
u AS (SELECT *, CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w::DOUBLE ELSE 0 END AS psi FROM k WINDOW w AS (PARTITION BY locus, sample_idx)),
g AS (SELECT locus, s, e, sum(n) AS reads, avg(psi) FILTER (sample_idx >= 3) - avg(psi) FILTER (sample_idx < 3) AS d FROM u GROUP BY ALL)
SELECT 'g' || locus || ':chr' || (locus % 3 + 1) || ':' || CASE locus % 2 WHEN 0 THEN '+' ELSE '-' END || ':' || min(s) || '-' || max(e) AS module_id, count(*) AS n_junctions, round(max(abs(d)), 9) AS max_abs_delta_psi FROM g GROUP BY locus""",
)
def whole_analysis_usage(spark, sf):
    """The whole analysis again, by the columns that SQL can say."""
    return _analysed(spark, sf, replicates=5).diff.select("module_id", F.col("n_junctions").cast("bigint").alias("n_junctions"), F.round("max_abs_delta_psi", 9).alias("max_abs_delta_psi"))


@query(
    "flagship",
    f"""WITH {B.EVIDENCE_SQL}, {_MEANS}, t AS (SELECT module_id, label, sum(count) AS s FROM ev GROUP BY ALL), k AS (SELECT module_id FROM t GROUP BY module_id HAVING bool_and(s >= 10)),
d AS (SELECT module_id, max(abs(g2 - g1)) AS d FROM mn JOIN k USING (module_id) GROUP BY module_id)
SELECT module_id, round(d, 9) AS max_abs_delta_psi FROM d ORDER BY round(d, 9) DESC, module_id LIMIT 20""",
)
def flagship(spark, sf):
    """The 20 modules whose usage differs most between the groups, among those deep enough to test."""
    cells = B.evidence(spark, sf)
    deep = cells.join(M.testable(cells, _groups(spark), 10, 1), "module_id", "left_semi")
    top = P.top_junction(P.group_means(P.with_psi(deep), _groups(spark)))
    return top.select("module_id", F.round("max_abs_delta_psi", 9).alias("max_abs_delta_psi")).orderBy(F.col("max_abs_delta_psi").desc(), "module_id").limit(20)
