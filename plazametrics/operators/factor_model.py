"""Logistic-normal multinomial factor model for count vectors.

``y_i ~ Multinomial(n_i, softmax(mu + L f_i))`` with normal priors, lower-triangular
loadings and a positive diagonal, fitted by variational EM: each row's factor scores get a
Gaussian posterior, solved inside the tasks, and each pass sends the driver one gradient
and curvature per category and model. Intercepts and loadings are point estimates, stepped
over the free coordinates alone: nothing above the diagonal, the logarithm on it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import stack
from .moments import added, moments, principal_axes

PRIOR_SD_INTERCEPT, PRIOR_SD_LOADING = 3.0, 1.0


@dataclass
class FactorFit:
    k: int
    intercept: np.ndarray
    loadings: np.ndarray
    bound: float
    passes: int
    #: Largest slope of the bound along a free coordinate, and whether no step gains more than the tolerance.
    gradient: float = 0.0
    converged: bool = False


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def row_scores(y: np.ndarray, mu: np.ndarray, load: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mode and covariance of each row's factor scores by Newton steps, halved while they do not help."""
    n = y.sum(axis=1, keepdims=True)
    f = np.zeros((len(y), load.shape[1]))
    eye = np.eye(load.shape[1])

    def loss(f):
        logits = mu + f @ load.T
        top = logits.max(axis=1)
        return n[:, 0] * (top + np.log(np.exp(logits - top[:, None]).sum(axis=1))) - (y * logits).sum(axis=1) + 0.5 * (f**2).sum(axis=1)

    now = loss(f)
    for step in range(steps + 1):
        p = softmax(mu + f @ load.T)
        gradient = (n * p - y) @ load + f
        centred = load[None, :, :] - (p @ load)[:, None, :]
        hessian = np.einsum("ij,ijk,ijl->ikl", n * p, centred, centred) + eye
        if len(f) == 0 or step == steps:
            break
        move = np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
        if np.abs(move).max() < 1e-8:
            break
        share = np.ones((len(f), 1))
        for _ in range(30):
            then = loss(f - share * move)
            worse = ~(then <= now + 1e-12 * np.abs(now))
            if not worse.any():
                break
            share[worse] /= 2
        f, now = f - share * move, then
    return f, np.linalg.inv(hessian)


def spread_points(f: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Points with the posterior's mean and covariance: two per factor, equally weighted."""
    k = f.shape[1]
    root = np.sqrt(k) * np.linalg.cholesky(cov)
    steps = np.concatenate([root, -root], axis=2)
    return f[:, None, :] + np.swapaxes(steps, 1, 2)


def rotated(load: np.ndarray) -> np.ndarray:
    """The same loadings up to a rotation of the factors: zero above the diagonal, positive on it."""
    k = load.shape[1]
    q, _ = np.linalg.qr(load[:k].T)
    out = load @ q
    out = out * np.where(np.diag(out) < 0, -1.0, 1.0)
    out[np.triu_indices(k, 1)] = 0.0
    out[np.arange(k), np.arange(k)] = np.maximum(out[np.arange(k), np.arange(k)], 1e-2)
    return out


def starting_models(vectors: DataFrame, counts: str, factors: Sequence[int], seed: int) -> dict[int, np.ndarray]:
    """Intercepts and loadings of the leading log-ratio components, slightly moved by the seed."""
    logs = F.transform(counts, lambda x: F.ln(x + 0.5))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / F.size(logs)
    m = moments(vectors.select(F.transform(logs, lambda x: x - mean).alias("x")), "x")[()]
    values, axes = principal_axes(m.scatter() / max(m.n, 1.0))
    rng, out = np.random.default_rng(seed), {}
    for k in factors:
        load = (axes[:k] * np.sqrt(values[:k])[:, None]).T + 0.01 * rng.standard_normal((axes.shape[1], k))
        out[k] = np.hstack([m.mean[:, None], rotated(load)])
    return out


class FreeCoordinates:
    """Steps of intercepts and loadings (one row a category) in the coordinates that may move."""

    def __init__(self, theta: np.ndarray):
        width, k = theta.shape[0], theta.shape[1] - 1
        self.free = np.hstack([np.ones((width, 1), bool), np.tril(np.ones((width, k), bool))])
        self.diagonal = np.zeros((width, k + 1), bool)
        self.diagonal[np.arange(k), np.arange(k) + 1] = True
        #: d theta / d coordinate: the value itself where the coordinate is its logarithm.
        self.scale = np.where(self.diagonal, theta, 1.0) * self.free

    def step(self, gradient: np.ndarray, curvature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slope along the coordinates, and the Newton step, the curvature made positive."""
        slope = gradient * self.scale
        bent = curvature * self.scale[:, :, None] * self.scale[:, None, :]
        extra = np.where(self.diagonal, np.abs(slope), 0.0) + ~self.free
        bent = bent + extra[:, :, None] * np.eye(gradient.shape[1])
        return slope, np.linalg.solve(bent, slope[:, :, None])[:, :, 0]

    def values(self, theta: np.ndarray) -> np.ndarray:
        return np.where(self.diagonal, np.log(np.where(self.diagonal, theta, 1.0)), theta)[self.free]

    def mixed(self, theta: np.ndarray, step: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]], memory: int = 8) -> np.ndarray:
        """The step corrected by how earlier steps changed along the way (Anderson mixing); none is longer than 1."""
        past.append((self.values(theta), step[self.free]))
        del past[:-memory]
        move = past[-1][1]
        if len(past) > 1:
            points, steps = (np.diff(np.stack([p[i] for p in past], 1), axis=1) for i in (0, 1))
            move = move - (points + steps) @ np.linalg.lstsq(steps, move, rcond=1e-8)[0]
        out = np.zeros(theta.shape)
        out[self.free] = move / max(1.0, float(np.abs(move).max()))
        return out

    def moved(self, theta: np.ndarray, step: np.ndarray) -> np.ndarray:
        return np.where(self.diagonal, theta * np.exp(np.clip(np.where(self.diagonal, step, 0.0), -1.0, 1.0)), theta + step)


def fit(
    vectors: DataFrame, counts: str, factors: Sequence[int] = (1, 2, 3, 4), seed: int = 0, passes: int = 60,
    tolerance: float = 5e-5,
) -> list[FactorFit]:
    """Fit one model per number of factors, all in the same passes over the rows.

    A pass returns, per category, the gradient and the curvature ``sum n p x x'``, which
    bounds the softmax curvature at the current point; steps are mixed with earlier ones, and
    halved where the bound sinks. A model is done when a full step promises less than
    ``tolerance`` of the bound. Rows without counts are left out.
    """
    models = starting_models(vectors, counts, factors, seed)
    width = len(next(iter(models.values())))
    best: dict[int, tuple[float, np.ndarray, np.ndarray, float]] = {}
    past: dict[int, list] = {k: [] for k in factors}
    done: dict[int, FactorFit] = {}
    for i in range(passes):
        live = {k: (m[:, 0], m[:, 1:]) for k, m in models.items() if k not in done}
        if not live:
            break
        sizes = {k: width * (k + 1) + width * (k + 1) ** 2 + 1 for k in live}

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals = {k: np.zeros(size) for k, size in sizes.items()}
            for pdf in batches:
                y = stack(pdf[counts])
                y = y[y.sum(axis=1) > 0]
                n = y.sum(axis=1, keepdims=True)
                for k, (mu, load) in live.items():
                    f, cov = row_scores(y, mu, load)
                    points = spread_points(f, cov)
                    for j in range(2 * k):
                        g = points[:, j, :]
                        p = softmax(mu + g @ load.T)
                        x = np.hstack([np.ones((len(g), 1)), g])
                        outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                        value = (y * np.log(np.maximum(p, 1e-300))).sum()
                        totals[k] += np.concatenate(
                            [((y - n * p).T @ x).ravel(), ((n * p).T @ outer).ravel(), [value]]
                        ) / (2 * k)
                    trace = np.trace(cov, axis1=1, axis2=2).sum()
                    totals[k][-1] -= 0.5 * ((f**2).sum() + trace - k * len(f) - np.linalg.slogdet(cov)[1].sum())
            yield pd.DataFrame({"k": list(totals), "sums": list(totals.values())})

        parts = vectors.select(counts).mapInPandas(sums, "k int, sums array<double>")
        merged = added(parts, ["k"])
        for k in live:
            flat, theta = merged[(k,)], models[k]
            precision = np.diag([PRIOR_SD_INTERCEPT**-2] + [PRIOR_SD_LOADING**-2] * k)
            value = float(flat[-1] - 0.5 * np.einsum("jk,kl,jl->", theta, precision, theta))
            last = best.get(k)
            # Posteriors are Gaussian around their mode, so that the bound may sink a little on the way to a flat point.
            if last is not None and not value >= last[0] - 1e-4 * abs(last[0]):
                # Back to the last point, half as far.
                value, theta, step, slope = last[0], last[1], last[2] / 2, last[3]
                gain = np.inf if np.abs(step).max() > 1e-6 else 0.0
                past[k].clear()
            else:
                gradient = flat[: width * (k + 1)].reshape(width, k + 1) - theta @ precision
                curvature = flat[width * (k + 1) : -1].reshape(width, k + 1, k + 1) + precision
                free = FreeCoordinates(theta)
                slopes, step = free.step(gradient, curvature)
                slope, gain = float(np.abs(slopes).max()), 0.5 * float((slopes * step).sum())
                step = free.mixed(theta, step, past[k])
            best[k] = (value, theta, step, slope)
            if gain <= tolerance * abs(value) or i + 1 == passes or not np.isfinite(value):
                done[k] = FactorFit(k, theta[:, 0], theta[:, 1:], value, i + 1, slope, bool(gain <= tolerance * abs(value)))
            else:
                models[k] = FreeCoordinates(theta).moved(theta, step)
    return [done[k] for k in factors]


def mean_probabilities(f: np.ndarray, cov: np.ndarray, mu: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Category probabilities averaged over each row's posterior."""
    points = spread_points(f, cov)
    return sum(softmax(mu + points[:, j, :] @ load.T) for j in range(points.shape[1])) / points.shape[1]


COMPARISON = (
    "n_factors int, inference string, final_loss double, chi_square_discrepancy double, holdout_mae double, "
    "holdout_mean_log_score double, holdout_store_count bigint, converged boolean"
)


def comparison(vectors: DataFrame, fits: Sequence[FactorFit], train: str = "train", test: str = "test") -> DataFrame:
    """Each fitted model on the counts it has seen (chi square) and on those held out (absolute error, log score).

    One pass for all models; a task returns four sums a model.
    """
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {m.k: np.zeros(5) for m in fits}
        for pdf in batches:
            y, h = stack(pdf[train]), stack(pdf[test])
            n, held = y.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
            for m in fits:
                p = mean_probabilities(*row_scores(y, m.intercept, m.loadings), m.intercept, m.loadings)
                expected = n * p
                chi = np.divide((y - expected) ** 2, expected, out=np.zeros_like(y), where=expected > 0).sum()
                some = held[:, 0] > 0
                error = np.abs(h - held * p)[some].sum()
                totals[m.k] += [chi, error, some.sum() * y.shape[1], (h * np.log(np.clip(p, 1e-12, 1.0))).sum(), h.sum()]
        yield pd.DataFrame({"k": list(totals), "sums": list(totals.values())})

    found = added(vectors.select(train, test).mapInPandas(sums, "k int, sums array<double>"), ["k"])
    rows = []
    for m in fits:
        chi, error, cells, score, count = found[(m.k,)].tolist()
        rows.append((m.k, "variational_em", round(-m.bound, 1), round(chi, 1), round(error / cells, 4) if cells else None, round(score / max(count, 1.0), 6), int(count), m.converged))
    return vectors.sparkSession.createDataFrame(rows, COMPARISON)


def score_table(vectors: DataFrame, row_id: str, counts: str, model: FactorFit) -> DataFrame:
    """Factor scores and category probabilities per row, both as means of the row's posterior."""
    types = dict(vectors.dtypes)
    mu, load = model.intercept, model.loadings

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f, cov = row_scores(stack(pdf[counts]), mu, load)
            yield pd.DataFrame({row_id: pdf[row_id], "factors": list(f), "probabilities": list(mean_probabilities(f, cov, mu, load))})

    return vectors.select(row_id, counts).mapInPandas(
        score, f"{row_id} {types[row_id]}, factors array<double>, probabilities array<double>"
    )


def predictive_checks(df: DataFrame, observed: str, heldout: str, probabilities: str) -> DataFrame:
    """Chi-square discrepancy on the training counts; absolute error and log score on held-out ones."""
    n = F.aggregate(observed, F.lit(0.0), lambda a, x: a + x)
    m = F.aggregate(heldout, F.lit(0.0), lambda a, x: a + x)
    cells = df.select(n.alias("n"), m.alias("m"), F.explode(F.arrays_zip(observed, heldout, probabilities)).alias("c"))
    y, h, p = F.col(f"c.{observed}"), F.col(f"c.{heldout}"), F.col(f"c.{probabilities}")
    expected = p * F.col("n")
    chi = F.when(expected > 0, F.pow(y - expected, F.lit(2)) / expected).otherwise(0.0)
    error = F.when(F.col("m") > 0, F.abs(h - p * F.col("m")))
    clipped = F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))
    return cells.agg(
        F.round(F.sum(chi), 1).alias("chi_square_discrepancy"),
        F.round(F.avg(error), 4).alias("holdout_mae"),
        F.round(F.sum(h * F.ln(clipped)) / F.greatest(F.sum(h), F.lit(1.0)), 6).alias("holdout_mean_log_score"),
        F.sum(h).cast("bigint").alias("holdout_store_count"),
    )
