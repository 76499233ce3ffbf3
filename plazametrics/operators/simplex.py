"""Projection onto the probability simplex and simplex-constrained least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def project_simplex(vector: Column) -> Column:
    """Nearest point with non-negative entries summing to one, for one array."""
    ordered = F.reverse(F.array_sort(F.transform(vector, lambda x: x.cast("double"))))
    # The threshold is the largest of (top-r sum - 1) / r over all r.
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("rank"), F.lit(None).cast("double").alias("theta"))

    def step(s: Column, x: Column) -> Column:
        total, rank = s["sum"] + x, s["rank"] + 1
        return F.struct(
            total.alias("sum"), rank.alias("rank"),
            F.greatest(s["theta"], (total - 1.0) / rank).alias("theta"),
        )

    theta = F.aggregate(ordered, start, step)["theta"]
    return F.transform(vector, lambda x: F.greatest(x - theta, F.lit(0.0)))


def project_rows(x: np.ndarray) -> np.ndarray:
    """The same for the rows of a matrix inside a task."""
    top = -np.sort(-x, axis=1)
    theta = ((np.cumsum(top, axis=1) - 1.0) / np.arange(1, x.shape[1] + 1)).max(axis=1)
    return np.maximum(x - theta[:, None], 0.0)


def convex_weights(points: np.ndarray, corners: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights of each point as a convex mix of ``corners`` (accelerated projected gradient)."""
    gram, cross = corners @ corners.T, points @ corners.T
    lipschitz = max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    w = np.full((len(points), len(corners)), 1.0 / len(corners))
    look, t = w, 1.0
    for _ in range(steps):
        new = project_rows(look - (look @ gram - cross) / lipschitz)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + ((t - 1) / t_new) * (new - w)
        moved = np.abs(new - w).max() if len(w) else 0.0
        w, t = new, t_new
        if moved < 1e-10:
            break
    return w
