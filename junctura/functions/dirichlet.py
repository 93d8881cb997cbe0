"""Dirichlet-multinomial models: likelihood, regression on a design matrix, free concentrations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .special import chi2_sf, digamma, gammaln

TOP = 16.0  # largest logarithm of a concentration: beyond it differences of log-gammas lose all digits, and the model is multinomial
FLOOR = 1e-10


def log_likelihood(counts: np.ndarray, alpha: np.ndarray) -> float:
    """Sum over rows of counts; alpha is shared or has a row for each."""
    counts = np.atleast_2d(np.asarray(counts, float))
    alpha = np.maximum(np.broadcast_to(np.asarray(alpha, float), counts.shape), FLOOR)
    a = alpha.sum(1)
    return float((gammaln(a) - gammaln(a + counts.sum(1))).sum() + (gammaln(alpha + counts) - gammaln(alpha)).sum())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Optimum:
    x: np.ndarray
    value: float
    converged: bool
    iterations: int
    gradient_norm: float


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int = 500, tol: float = 1e-9, memory: int = 10) -> Optimum:
    """Limited-memory quasi-Newton descent with backtracking; f gives value and gradient."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for turn in range(1, max_iter + 1):
        if np.abs(g).max() < 1e-7:
            return Optimum(x, value, True, turn - 1, float(np.linalg.norm(g)))
        q, used = g.copy(), []
        for s, y, r in reversed(pairs):
            a = r * (s @ q)
            q -= a * y
            used.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(g).sum())
        for (s, y, r), a in zip(pairs, reversed(used)):
            q += (a - r * (y @ q)) * s
        slope = -(g @ q)
        if slope >= 0:
            q, slope, pairs = g / max(1.0, np.abs(g).sum()), -(g @ g) / max(1.0, np.abs(g).sum()), []
        step = 1.0
        while True:
            new = x - step * q
            new_value, new_g = f(new)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
            if step < 1e-12:
                return Optimum(x, value, np.abs(g).max() < 1e-3 * max(1.0, abs(value)), turn, float(np.linalg.norm(g)))
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, 1 / (s @ y))]
        done = value - new_value <= tol * max(1.0, abs(value), abs(new_value))
        x, value, g = new, new_value, new_g
        if done:
            return Optimum(x, value, True, turn, float(np.linalg.norm(g)))
    return Optimum(x, value, False, max_iter, float(np.linalg.norm(g)))


@dataclass
class Fit:
    alpha: np.ndarray
    concentration: float
    log_likelihood: float
    converged: bool
    iterations: int
    gradient_norm: float


def moments(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean proportions and concentration by the method of moments; empty samples take no part."""
    total = counts.sum(1, keepdims=True)
    p = (counts / np.maximum(total, 1))[total[:, 0] > 0]
    if not len(p):
        return np.full(counts.shape[1], 1 / counts.shape[1]), 0.1
    mean, var = p.mean(0), p.var(0)
    return np.maximum(mean, FLOOR), max(0.1, float(np.mean(mean * (1 - mean) / np.maximum(var, 1e-6) - 1)))


def fit_glm(counts: np.ndarray, design: np.ndarray, max_iter: int = 500, start: Fit | None = None) -> Fit:
    """alpha = softmax(design @ beta) * c with one c, by maximum likelihood.

    `start`, a fit with another design, gives the first mean proportions and concentration.
    """
    counts, design = np.asarray(counts, float), np.asarray(design, float)
    p, k = design.shape[1], counts.shape[1]
    if start is None:
        mean, c = moments(counts)
    else:
        mean = start.alpha.mean(0)
        mean, c = np.maximum(mean / mean.sum(), FLOOR), max(0.1, start.concentration)
    beta = np.zeros((p, k))
    beta[0] = np.log(mean / mean.mean())
    total = counts.sum(1)

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        c = max(1e-6, math.exp(min(x[-1], TOP)))
        q = softmax(design @ x[:-1].reshape(p, k))
        alpha = np.maximum(q * c, FLOOR)
        g = digamma(alpha + counts) - digamma(alpha) + (digamma(np.full(1, c)) - digamma(c + total))[:, None]
        inner = c * q * (g - (q * g).sum(1, keepdims=True))
        return -log_likelihood(counts, alpha), -np.append((design.T @ inner).ravel(), (alpha * g).sum() if x[-1] < TOP else 0.0)

    got = minimise(f, np.append(beta.ravel(), math.log(c)), max_iter)
    c = max(1e-6, math.exp(min(got.x[-1], TOP)))
    alpha = softmax(design @ got.x[:-1].reshape(p, k)) * c
    return Fit(alpha, c, log_likelihood(counts, alpha), got.converged, got.iterations, got.gradient_norm)


def minimise_many(f: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], x: np.ndarray, max_iter: int = 500, tol: float = 1e-9, memory: int = 10) -> list[Optimum]:
    """minimise() for many problems side by side, a row of x each; f(rows of x, their numbers) gives values and gradients.

    Every problem takes the steps that it would take alone, and leaves the stack when it is done.
    """
    n, d = x.shape
    out: list[Optimum | None] = [None] * n
    ids, x = np.arange(n), x.copy()
    value, g = f(x, ids)
    s_all, y_all, r_all = np.zeros((n, memory, d)), np.zeros((n, memory, d)), np.zeros((n, memory))
    held = np.zeros(n, int)  # pairs of each problem; the newest is last
    dot = lambda a, b: np.einsum("nd,nd->n", a, b)

    def leave(gone: np.ndarray, converged: np.ndarray, turn: int) -> None:
        nonlocal ids, x, value, g, s_all, y_all, r_all, held
        for k in np.flatnonzero(gone).tolist():
            out[ids[k]] = Optimum(x[k].copy(), float(value[k]), bool(converged[k]), turn, float(np.linalg.norm(g[k])))
        stay = ~gone
        ids, x, value, g, s_all, y_all, r_all, held = (v[stay] for v in (ids, x, value, g, s_all, y_all, r_all, held))

    for turn in range(1, max_iter + 1):
        flat = np.abs(g).max(1) < 1e-7
        if flat.any():
            leave(flat, flat, turn - 1)
        if not len(ids):
            break
        q, used = g.copy(), np.zeros((len(ids), memory))
        first = memory - int(held.max(initial=0))
        for j in range(memory - 1, first - 1, -1):
            has = memory - j <= held
            a = np.where(has, r_all[:, j] * dot(s_all[:, j], q), 0.0)
            q -= a[:, None] * y_all[:, j]
            used[:, j] = a
        any_ = held > 0
        yy = dot(y_all[:, -1], y_all[:, -1])
        q *= np.where(any_, dot(s_all[:, -1], y_all[:, -1]) / np.where(any_, yy, 1.0), 1 / np.maximum(1.0, np.abs(g).sum(1)))[:, None]
        for j in range(first, memory):
            has = memory - j <= held
            q += np.where(has, used[:, j] - r_all[:, j] * dot(y_all[:, j], q), 0.0)[:, None] * s_all[:, j]
        slope = -dot(g, q)
        wrong = slope >= 0
        if wrong.any():
            scale = np.maximum(1.0, np.abs(g[wrong]).sum(1))
            q[wrong], slope[wrong], held[wrong] = g[wrong] / scale[:, None], -dot(g[wrong], g[wrong]) / scale, 0
        step, new, new_value, new_g = np.ones(len(ids)), x.copy(), value.copy(), g.copy()
        trying = np.arange(len(ids))
        stuck = np.zeros(len(ids), bool)
        while len(trying):
            at = x[trying] - step[trying, None] * q[trying]
            v, h = f(at, ids[trying])
            good = np.isfinite(v) & (v <= value[trying] + 1e-4 * step[trying] * slope[trying])
            took = trying[good]
            new[took], new_value[took], new_g[took] = at[good], v[good], h[good]
            trying = trying[~good]
            step[trying] /= 2
            lost = step[trying] < 1e-12
            stuck[trying[lost]] = True
            trying = trying[~lost]
        s, y = new - x, new_g - g
        sy = dot(s, y)
        fresh = (sy > 1e-12) & ~stuck
        for stack, newest in ((s_all, s), (y_all, y)):
            stack[fresh, :-1] = stack[fresh, 1:]
            stack[fresh, -1] = newest[fresh]
        r_all[fresh, :-1] = r_all[fresh, 1:]
        r_all[fresh, -1] = 1 / sy[fresh]
        held[fresh] = np.minimum(held[fresh] + 1, memory)
        done = ~stuck & (value - new_value <= tol * np.maximum(1.0, np.maximum(np.abs(value), np.abs(new_value))))
        near = np.abs(g).max(1) < 1e-3 * np.maximum(1.0, np.abs(value))
        x, value, g = new, new_value, new_g
        if (done | stuck).any():
            leave(done | stuck, np.where(stuck, near, True), turn)
    if len(ids):
        leave(np.ones(len(ids), bool), np.zeros(len(ids), bool), max_iter)
    return out


def moments_many(counts: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """moments() of a stack of counts (module, sample, junction); `real` tells the junctions that are no padding."""
    total = counts.sum(2, keepdims=True)
    seen = total[..., 0] > 0
    n, k = seen.sum(1), real.sum(1)
    p = counts / np.maximum(total, 1)
    mean = p.sum(1) / np.maximum(n, 1)[:, None]
    var = (np.where(seen[..., None], p - mean[:, None], 0.0) ** 2).sum(1) / np.maximum(n, 1)[:, None]
    spread = np.where(real, mean * (1 - mean) / np.maximum(var, 1e-6) - 1, 0.0)
    # floors come first in moments(), so a junction without reads counts with its floor
    low = np.where(n[:, None] > 0, np.maximum(mean, FLOOR), 1 / k[:, None])
    return np.where(real, low, 0.0), np.where(n > 0, np.maximum(0.1, spread.sum(1) / k), 0.1)


def fit_glm_many(counts: np.ndarray, real: np.ndarray, design: np.ndarray, max_iter: int = 500, start: list[Fit] | None = None) -> list[Fit]:
    """fit_glm() of a stack of counts (module, sample, junction), padded with junctions that `real` tells apart.

    All modules are optimised together; padding has share 0 and no part in value or gradient.
    """
    counts, design = np.asarray(counts, float), np.asarray(design, float)
    b, _, k = counts.shape
    p, sizes = design.shape[1], real.sum(1)
    if start is None:
        mean, c = moments_many(counts, real)
    else:
        mean, c = np.zeros((b, k)), np.empty(b)
        for i, fit in enumerate(start):
            one = fit.alpha.mean(0)
            mean[i, : sizes[i]], c[i] = np.maximum(one / one.sum(), FLOOR), max(0.1, fit.concentration)
    beta = np.zeros((b, p, k))
    safe = np.where(real, mean, 1.0)
    beta[:, 0] = np.where(real, np.log(safe / (mean.sum(1) / sizes)[:, None]), 0.0)
    total = counts.sum(2)

    def shares(x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logits = np.einsum("sp,npk->nsk", design, x[:, :-1].reshape(-1, p, k))
        q = softmax(np.where(mask[:, None], logits, -np.inf))
        return q, np.maximum(1e-6, np.exp(np.minimum(x[:, -1], TOP)))

    def likelihood(own: np.ndarray, alpha: np.ndarray, mask: np.ndarray) -> np.ndarray:
        a = np.where(mask[:, None], alpha, 0.0).sum(2)
        return (gammaln(a) - gammaln(a + own.sum(2))).sum(1) + (gammaln(alpha + own) - gammaln(alpha)).sum((1, 2))

    def f(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, mask = counts[ids], real[ids]
        q, c = shares(x, mask)
        alpha = np.maximum(q * c[:, None, None], FLOOR)
        g = digamma(alpha + own) - digamma(alpha) + (digamma(c)[:, None] - digamma(c[:, None] + total[ids]))[..., None]
        g = np.where(mask[:, None], g, 0.0)
        inner = c[:, None, None] * q * (g - (q * g).sum(2, keepdims=True))
        slope = np.where(x[:, -1] < TOP, (np.where(mask[:, None], alpha, 0.0) * g).sum((1, 2)), 0.0)
        return -likelihood(own, alpha, mask), -np.concatenate([np.einsum("sp,nsk->npk", design, inner).reshape(len(x), -1), slope[:, None]], 1)

    got = minimise_many(f, np.concatenate([beta.reshape(b, -1), np.log(c)[:, None]], 1), max_iter)
    q, c = shares(np.array([o.x for o in got]).reshape(b, p * k + 1), real)
    alpha = q * c[:, None, None]
    values = likelihood(counts, np.maximum(alpha, FLOOR), real)
    return [Fit(alpha[i, :, : sizes[i]], float(c[i]), float(values[i]), o.converged, o.iterations, o.gradient_norm) for i, o in enumerate(got)]


def fit_free(counts: np.ndarray, max_iter: int = 200) -> Fit:
    """One concentration for each junction, shared by all samples."""
    counts = np.asarray(counts, float)
    mean, c = moments(counts)
    total = counts.sum(1)

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        alpha = np.maximum(np.exp(np.minimum(x, TOP)), 1e-6)
        a = alpha.sum()
        g = (digamma(alpha + counts) - digamma(alpha)).sum(0) + (digamma(np.full(1, a)) - digamma(a + total)).sum()
        return -log_likelihood(counts, alpha), np.where(x < TOP, -g * alpha, 0.0)

    got = minimise(f, np.log(np.maximum(mean * c, 1e-6)), max_iter)
    alpha = np.maximum(np.exp(np.minimum(got.x, TOP)), 1e-6)
    return Fit(alpha, float(alpha.sum()), -got.value, got.converged, got.iterations, got.gradient_norm)


def fit_free_groups(counts: np.ndarray, labels: np.ndarray, max_iter: int = 200) -> tuple[Fit | None, Fit | None, float]:
    """Free concentrations for labels 0 and 1 apart, and the joint log-likelihood."""
    fits = [fit_free(counts[labels == g], max_iter) if (labels == g).any() else None for g in (0, 1)]
    return fits[0], fits[1], sum(x.log_likelihood for x in fits if x)


def ratio_test(null: float, full: float, df: float) -> float:
    """p-value of a likelihood ratio; 1 where the full model is no better."""
    return chi2_sf(2 * (full - null), df)


def design_matrices(labels: np.ndarray, covariates: np.ndarray | None = None, df_mode: str = "groups") -> tuple[np.ndarray, np.ndarray, int]:
    """(full, null, degrees of freedom): intercept, all groups but the last, standardised covariates.

    Degrees of freedom are groups - 1 (times categories - 1 with df_mode "k_minus_1", at the test).
    """
    groups = np.unique(labels)
    columns = [np.ones((len(labels), 1))]
    extra = np.empty((len(labels), 0))
    if covariates is not None and covariates.size:
        sd = covariates.std(0)
        extra = np.where(sd > 0, (covariates - covariates.mean(0)) / np.where(sd > 0, sd, 1), 0.0)
    hot = (labels[:, None] == groups[None, :-1]).astype(float)
    return np.hstack([*columns, hot, extra]), np.hstack([*columns, extra]), len(groups) - 1
