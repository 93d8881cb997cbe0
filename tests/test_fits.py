"""Fits of many modules together are those of each alone."""

import numpy as np
import pytest

from junctura.functions import dirichlet as D
from junctura.operators import differential as T


def modules(n, seed, samples=8):
    rng = np.random.RandomState(seed)
    for k in range(n):
        j = rng.choice([2, 3, 5, 9])
        share = rng.dirichlet(np.ones(j) * 2, 2)
        shift = k % 3 == 0
        counts = np.stack([rng.multinomial(rng.choice([0, 12, 60, 400]), rng.dirichlet(share[int(shift and s >= samples // 2)] * 30 + 1e-3)) for s in range(samples)]).astype(float)
        if k % 7 == 0:
            counts[:, 0] = 0
        if k % 11 == 0:
            counts[:] = 0
        yield counts


def stack(some):
    widest = max(c.shape[1] for c in some)
    out, real = np.zeros((len(some), some[0].shape[0], widest)), np.zeros((len(some), widest), bool)
    for i, c in enumerate(some):
        out[i, :, : c.shape[1]], real[i, : c.shape[1]] = c, True
    return out, real


@pytest.mark.parametrize("design", ["null", "full"])
def test_stacked_fits_are_single_fits(design):
    some = list(modules(60, 3))
    x = D.design_matrices(np.array([0] * 4 + [1] * 4))[design == "null"]
    many = D.fit_glm_many(*stack(some), x)
    ones = [D.fit_glm(c, x) for c in some]
    for c, a, b in zip(some, many, ones):
        assert a.log_likelihood == pytest.approx(b.log_likelihood, abs=1e-5 * max(1, abs(b.log_likelihood))) and a.converged == b.converged
        assert a.alpha.shape == c.shape
    again = D.fit_glm_many(*stack(some), x, start=many)
    assert all(a.log_likelihood >= b.log_likelihood - 1e-6 * max(1, abs(b.log_likelihood)) for a, b in zip(again, many))
    assert sum(a.iterations == b.iterations for a, b in zip(many, ones)) > 40


def test_moments_of_a_stack():
    some = list(modules(40, 5))
    mean, c = D.moments_many(*stack(some))
    for i, one in enumerate(some):
        m, v = D.moments(one)
        assert mean[i, : one.shape[1]] == pytest.approx(m) and not mean[i, one.shape[1] :].any() and c[i] == pytest.approx(v)


def test_modules_are_fitted_in_few_calls(spark, monkeypatch):
    some = list(modules(400, 9, 6))
    rows = [(f"m{i:03}", j, s, int(c[s, j])) for i, c in enumerate(some) for s in range(6) for j in range(c.shape[1]) if c[s, j] or s == 0]
    cells = spark.createDataFrame(rows, "module_id string, j_idx int, sample_idx int, count bigint")
    labels = {s: int(s >= 3) for s in range(6)}
    got = {r.module_id: r for r in T.fit_modules(cells, labels).collect()}
    full, null, df = D.design_matrices(np.array([0, 0, 0, 1, 1, 1]))
    for i, c in enumerate(some[:60]):
        r, a, b = got[f"m{i:03}"], D.fit_glm(c, null), D.fit_glm(c, full)
        assert (r.n_junctions, r.degrees_of_freedom) == (c.shape[1], df)
        assert r.log_likelihood_null >= a.log_likelihood - 1e-4 * max(1, abs(a.log_likelihood)) and r.log_likelihood_full == pytest.approx(b.log_likelihood, rel=1e-5, abs=1e-5)
    grouped = cells.selectExpr("module_id", "struct(j_idx, sample_idx, cast(count as double) n) c").groupBy("module_id").agg({"c": "collect_list"}).withColumnRenamed("collect_list(c)", "c").selectExpr("module_id", "sort_array(c) c")
    (batch,) = grouped.coalesce(1).toArrow().combine_chunks().to_batches()
    stacks = list(T.stacked(batch, np.arange(6)))
    assert len(stacks) <= 4 and sorted(i for mine, _, _ in stacks for i in mine.tolist()) == list(range(400))
    for mine, counts, real in stacks:
        for i, c, on in zip(mine.tolist(), counts, real):
            assert (c[:, on] == some[int(batch.column(0)[i].as_py()[1:])]).all() and not c[:, ~on].any()
