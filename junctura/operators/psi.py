"""Usage proportions, bootstrap replicates and percentile intervals."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLICATES = 30
SEED = 42


def share(value: str = "norm", *keys: str) -> Column:
    """value over its sum within keys, 0 where the sum is 0."""
    total = F.sum(value).over(Window.partitionBy(*(keys or ("module_id", "sample_idx"))))
    return F.when(total > 0, F.col(value) / total).otherwise(0.0)


def with_psi(cells: DataFrame) -> DataFrame:
    return cells.withColumn("psi", share("norm", "module_id", "sample_idx"))


def multinomial_replicates(counts: np.ndarray, n: int = REPLICATES, seed: int = SEED) -> np.ndarray:
    """(replicate, junction, sample) draws; samples in order, then replicates; empty samples draw nothing."""
    rng = np.random.RandomState(seed)
    out = np.zeros((n, *counts.shape), np.int64)
    for s in range(counts.shape[1]):
        total = int(counts[:, s].sum())
        if total:
            for b in range(n):
                out[b, :, s] = rng.multinomial(total, counts[:, s] / total)
    return out


def replicate_psi(draws: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    norm = np.where(lengths[None, :, None] > 0, draws / np.maximum(lengths, 1e-300)[None, :, None], 0.0)
    total = norm.sum(1, keepdims=True)
    return np.divide(norm, total, out=np.zeros_like(norm), where=total > 0)


def intervals(replicates: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    return np.percentile(replicates, 100 * alpha / 2, axis=0), np.percentile(replicates, 100 * (1 - alpha / 2), axis=0)


def module_seed(module_id: str, seed: int | None = None) -> int:
    """One fixed seed for all modules if given, else a stable hash of the module's name."""
    return seed if seed is not None else zlib.crc32(module_id.encode()) % 2**31


def matrix(group: pd.DataFrame, column: str) -> np.ndarray:
    """Junctions by samples; cells that are not there count 0."""
    return group.pivot(index="j_idx", columns="sample_idx", values=column).sort_index().sort_index(axis=1).fillna(0).to_numpy()


def bootstrap(cells: DataFrame, n: int = REPLICATES, seed: int | None = None) -> DataFrame:
    """(module_id, j_idx, sample_idx, replicates, ci_low, ci_high, boot_mean, boot_sd).

    One grouped call a module: a module's matrix is junctions by samples, which is small.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        counts, lengths = matrix(group, "count"), matrix(group, "eff_len").max(1)
        got = replicate_psi(multinomial_replicates(counts, n, module_seed(group["module_id"].iloc[0], seed)), lengths)
        low, high = intervals(got)
        j, s = np.meshgrid(range(counts.shape[0]), range(counts.shape[1]), indexing="ij")
        return pd.DataFrame({
            "module_id": group["module_id"].iloc[0], "j_idx": np.array(sorted(group["j_idx"].unique()))[j.ravel()], "sample_idx": np.array(sorted(group["sample_idx"].unique()))[s.ravel()],
            "replicates": list(got.reshape(n, -1).T), "ci_low": low.ravel(), "ci_high": high.ravel(), "boot_mean": got.mean(0).ravel(), "boot_sd": got.std(0).ravel(),
        })

    schema = "module_id string, j_idx int, sample_idx int, replicates array<double>, ci_low double, ci_high double, boot_mean double, boot_sd double"
    return cells.select("module_id", "j_idx", "sample_idx", "count", "eff_len").groupBy("module_id").applyInPandas(run, schema)


def group_means(psi: DataFrame, groups: DataFrame) -> DataFrame:
    """(module_id, j_idx, psi_group1, psi_group2, delta_psi): means of labels 0 and 1 and label 1 less label 0."""
    mean = lambda g: F.avg(F.when(F.col("label") == g, F.col("psi")))
    rows = psi.join(F.broadcast(groups), "sample_idx").groupBy("module_id", "j_idx").agg(mean(0).alias("psi_group1"), mean(1).alias("psi_group2"))
    return rows.withColumn("delta_psi", F.col("psi_group2") - F.col("psi_group1"))


def top_junction(deltas: DataFrame) -> DataFrame:
    """The junction with the largest |delta_psi| of each module, the first of equals."""
    w = Window.partitionBy("module_id").orderBy(F.abs("delta_psi").desc(), "j_idx")
    return deltas.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").withColumn("max_abs_delta_psi", F.abs("delta_psi"))


def delta_intervals(boot: DataFrame, groups: DataFrame) -> DataFrame:
    """Percentile interval of delta_psi: replicates are averaged over a group's samples, then differ."""
    rows = boot.join(F.broadcast(groups), "sample_idx").select("module_id", "j_idx", "label", F.posexplode("replicates").alias("b", "x"))
    mean = lambda g: F.avg(F.when(F.col("label") == g, F.col("x")))
    each = rows.groupBy("module_id", "j_idx", "b").agg((mean(1) - mean(0)).alias("d"))
    both = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return each.groupBy("module_id", "j_idx").agg(both.alias("q")).select("module_id", "j_idx", F.col("q")[0].alias("delta_psi_ci_low"), F.col("q")[1].alias("delta_psi_ci_high"))


def beta_posterior(count: Column, total: Column, a: float = 0.5, b: float = 0.5) -> tuple[Column, Column]:
    """Posterior mean of a proportion and four standard deviations."""
    alpha, beta = count + a, total - count + b
    n = alpha + beta
    return alpha / n, 4 * F.sqrt(alpha * beta / (n * n * (n + 1)))


def softmax(rows: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """Adds exp(value) over its sum within a group, from the group's largest value so that nothing overflows."""
    w = Window.partitionBy(*keys)
    powers = rows.withColumn("__e", F.exp(F.col(value) - F.max(value).over(w)))
    return powers.withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def z_scores(rows: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """Adds the distance from the group's mean in its population standard deviations, 0 where nothing varies."""
    w = Window.partitionBy(*keys)
    spread = F.stddev_pop(value).over(w)
    return rows.withColumn(name, F.when(spread > 0, (F.col(value) - F.avg(value).over(w)) / spread).otherwise(0.0))
