"""Differential and heterogeneous usage between groups of samples."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dirichlet, hypothesis
from . import psi as P
from .fdr import benjamini_hochberg
from .modules import testable

REFIT_BELOW = 0.001
FITS = "module_id string, n_junctions int, log_likelihood_null double, log_likelihood_full double, degrees_of_freedom int, p_value double, null_converged boolean, full_converged boolean, null_refit_used boolean, null_iterations int, full_iterations int, null_gradient_norm double, full_gradient_norm double"

_ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
_FIT_TYPES = [_ARROW_TYPES[c.split()[1]] for c in FITS.split(", ")]
STACK_CELLS = 1 << 20  # counts of modules that are fitted together; a stack takes some 500 bytes a count


def label_frame(spark, labels: Mapping[int, int]) -> DataFrame:
    return spark.createDataFrame(sorted(labels.items()), "sample_idx int, label int")


def stacked(batch: pa.RecordBatch, samples: np.ndarray, limit: int = STACK_CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, counts, real) of modules of about as many junctions: counts by module, sample and junction, padded.

    A row of the batch is a module with its cells in order of junction and sample; what is missing counts 0.
    """
    cells = batch.column(1)
    sizes, flat = np.diff(cells.offsets.to_numpy()), cells.flatten()
    j, sample = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    count = np.nan_to_num(flat.field(2).to_numpy(zero_copy_only=False).astype(float))
    row = np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (j[1:] != j[:-1])
    number = np.cumsum(new) - 1
    junctions = np.bincount(row[new], minlength=len(sizes))
    number = number - (np.cumsum(junctions) - junctions)[row]
    place = np.minimum(np.searchsorted(samples, sample), len(samples) - 1)
    known = samples[place] == sample
    order, at = np.argsort(junctions, kind="stable"), 0
    while at < len(order):
        # modules come by rising number of junctions: as many as fit at the last one's
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(samples) * junctions[order[end]] <= limit and junctions[order[end]] <= 2 * junctions[order[at]] + 2:
            end += 1
        mine = order[at:end]
        where = np.full(len(sizes), -1)
        where[mine] = np.arange(len(mine))
        use = known & (where[row] >= 0)
        counts = np.zeros((len(mine), len(samples), int(junctions[mine].max())))
        np.add.at(counts, (where[row[use]], place[use], number[use]), count[use])
        yield mine, counts, np.arange(counts.shape[2])[None] < junctions[mine][:, None]
        at = end


def fit_modules(cells: DataFrame, labels: Mapping[int, int], covariates: Mapping[int, Sequence[float]] | None = None, df_mode: str = "groups") -> DataFrame:
    """Null and full Dirichlet-multinomial regression of each module and their likelihood-ratio test.

    Below REFIT_BELOW the null model is fitted again from the full one and kept if better.
    df_mode "k_minus_1" multiplies the degrees of freedom by junctions - 1.  The modules of an
    Arrow batch are fitted together in stacks of STACK_CELLS counts.
    """
    samples = sorted(labels)
    y = np.array([labels[s] for s in samples])
    extra = None if covariates is None else np.array([covariates[s] for s in samples], float)
    full_design, null_design, df0 = dirichlet.design_matrices(y, extra)
    names = [c.split()[0] for c in FITS.split(", ")]

    def tested(counts: np.ndarray, real: np.ndarray) -> Iterator[tuple]:
        nulls, fulls = dirichlet.fit_glm_many(counts, real, null_design), dirichlet.fit_glm_many(counts, real, full_design)
        sizes = real.sum(1).tolist()
        dfs = [df0 * max(1, n - 1) if df_mode == "k_minus_1" else df0 for n in sizes]
        ps = [dirichlet.ratio_test(a.log_likelihood, b.log_likelihood, df) for a, b, df in zip(nulls, fulls, dfs)]
        low = [i for i, p in enumerate(ps) if p < REFIT_BELOW]
        better = set()
        if low:
            for i, again in zip(low, dirichlet.fit_glm_many(counts[low], real[low], null_design, start=[fulls[i] for i in low])):
                if again.log_likelihood > nulls[i].log_likelihood:
                    nulls[i] = again
                    better.add(i)
                    ps[i] = dirichlet.ratio_test(again.log_likelihood, fulls[i].log_likelihood, dfs[i])
        for i, (null, full) in enumerate(zip(nulls, fulls)):
            yield sizes[i], null.log_likelihood, full.log_likelihood, dfs[i], ps[i], null.converged, full.converged, i in better, null.iterations, full.iterations, null.gradient_norm, full.gradient_norm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for mine, counts, real in stacked(batch, np.array(samples)):
                columns = zip(*tested(counts, real))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[ids[i] for i in mine.tolist()], *columns], _FIT_TYPES)], names=names)

    grouped = cells.groupBy("module_id").agg(F.sort_array(F.collect_list(F.struct("j_idx", "sample_idx", F.col("count").cast("double").alias("n")))).alias("cells"))
    return grouped.mapInArrow(run, FITS)


def differential(cells: DataFrame, labels: Mapping[int, int], boot: DataFrame | None = None, covariates: Mapping[int, Sequence[float]] | None = None, min_reads: int = 10, min_samples: int = 3, df_mode: str = "groups") -> DataFrame:
    """A row for each testable module: fits, usage by group, its difference and interval, and FDR over all.

    Arrays are in junction order.  delta_psi is label 1 less label 0; modules that fail the depth
    rules are left out and do not count in the FDR.
    """
    groups = label_frame(cells.sparkSession, labels)
    cells = cells.join(testable(cells, groups, min_reads, min_samples), "module_id", "left_semi")
    fits = benjamini_hochberg(fit_modules(cells, labels, covariates, df_mode))
    shares = P.with_psi(cells)
    means = P.group_means(shares, groups)
    boot = P.bootstrap(cells) if boot is None else boot
    bounds = P.delta_intervals(boot, groups)
    keys = cells.select("module_id", "j_idx", "chrom", "start", "end", "strand", "composite_score", "is_annotated").distinct()
    coords = F.format_string("%s:%d-%d:%s", "chrom", "start", "end", "strand").alias("coord")
    each = means.join(bounds, ["module_id", "j_idx"]).join(keys.select("module_id", "j_idx", coords, "composite_score", "is_annotated"), ["module_id", "j_idx"])
    names = {"coord": "junction_coords", "composite_score": "junction_confidence", "is_annotated": "is_annotated", "psi_group1": "psi_group1", "psi_group2": "psi_group2", "delta_psi": "delta_psi", "delta_psi_ci_low": "delta_psi_ci_low", "delta_psi_ci_high": "delta_psi_ci_high"}
    rows = each.groupBy("module_id").agg(F.sort_array(F.collect_list(F.struct("j_idx", *names))).alias("js"), F.max(F.abs("delta_psi")).alias("max_abs_delta_psi"))
    rows = rows.select("module_id", "max_abs_delta_psi", *(F.col(f"js.{c}").alias(n) for c, n in names.items()))
    return fits.join(rows, "module_id")


HET = "module_id string, n_junctions int, sample_psi array<double>, ttest_pvalue double, mannwhitney_pvalue double, within_group_variance array<double>, between_group_variance double, heterogeneity_index double, bimodal_pvalue double, n_outlier_samples int"


def heterogeneous(shares: DataFrame, labels: Mapping[int, int], min_samples: int = 3) -> DataFrame:
    """Per module the junction that differs most between groups 0 and 1, tested for shift, spread and bimodality.

    No rows where a group has fewer than min_samples samples.
    """
    samples = sorted(labels)
    y = np.array([labels[s] for s in samples])
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    if n0 < min_samples or n1 < min_samples:
        return cells_empty(shares, HET + ", fdr double")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = group.pivot(index="j_idx", columns="sample_idx", values="psi").reindex(columns=samples).fillna(0.0).sort_index().to_numpy()
        m0, m1, m = x[:, y == 0].mean(1), x[:, y == 1].mean(1), x.mean(1)
        between = (n0 * (m0 - m) ** 2 + n1 * (m1 - m) ** 2) / (n0 + n1 - 1)
        row = x[int(between.argmax())]
        a, b = row[y == 0], row[y == 1]
        within = [float(a.var(ddof=1)), float(b.var(ddof=1))]
        outliers = sum(int((np.abs(g - g.mean()) > 2 * (g.std(ddof=1) + 1e-8)).sum()) for g in (a, b))
        top = float(between.max())
        return pd.DataFrame([[group["module_id"].iloc[0], len(x), row.tolist(), hypothesis.welch(a, b), hypothesis.mann_whitney(a, b), within, top, float(np.mean(within) / (top + 1e-8)), max(hypothesis.bimodality(a), hypothesis.bimodality(b)), outliers]], columns=[c.split()[0] for c in HET.split(", ")])

    tested = shares.select("module_id", "j_idx", "sample_idx", "psi").groupBy("module_id").applyInPandas(run, HET)
    nan = lambda c: F.coalesce(c, F.lit(float("nan"))).alias(c)  # pandas gives NaN as null
    tested = tested.select(*(nan(c) if c.endswith("_pvalue") else c for c in tested.columns))
    return benjamini_hochberg(tested, "ttest_pvalue")


def cells_empty(like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)
