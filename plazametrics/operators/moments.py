"""First and second moments of vector rows: the only thing matrix work sends to the driver.

``p`` is the number of categories or features and is small by definition; ``n`` is not,
so rows are reduced to ``p x p`` sums inside the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import stack

WIDEST = 2000


@dataclass
class Moments:
    n: float
    total: np.ndarray
    gram: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    def scatter(self) -> np.ndarray:
        """Centred Gram matrix."""
        return self.gram - np.outer(self.total, self.total) / self.n


def summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key with the element-wise sum of its ``sums`` arrays, made on the executors."""
    names = list(keys)
    return (
        parts.select(*names, F.posexplode("sums")).groupBy(*names, "pos").agg(F.sum("col").alias("s")).groupBy(*names)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("sums"))
    )


def added(parts: DataFrame, keys: Sequence[str]) -> dict[tuple, np.ndarray]:
    """:func:`summed` as arrays on the driver."""
    return {tuple(row[g] for g in keys): np.asarray(row["sums"]) for row in summed(parts, keys).collect()}


def moment_parts(df: DataFrame, vector: str, groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Partial sums of the weighted moments of each group, one row a task and group."""
    names = list(groups)

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in (pdf.groupby(names, sort=False) if names else [((), pdf)]):
                key = key if isinstance(key, tuple) else (key,)
                x = stack(part[vector])
                if x.shape[1] > WIDEST:
                    raise ValueError(f"more than {WIDEST} columns in a moment matrix")
                w = part[weight].to_numpy(dtype="float64") if weight else np.ones(len(x))
                flat = np.concatenate([[w.sum()], w @ x, ((x * w[:, None]).T @ x).ravel()])
                sums[key] = sums[key] + flat if key in sums else flat
        rows = [(*key, flat) for key, flat in sums.items()]
        yield pd.DataFrame(rows, columns=[*names, "sums"])

    columns = [vector, *names] + ([weight] if weight else [])
    types = dict(df.dtypes)
    schema = ", ".join([f"{g} {types[g]}" for g in names] + ["sums array<double>"])
    return df.select(*columns).mapInPandas(reduce_batches, schema)


def unpacked(flat: np.ndarray) -> Moments:
    p = int(round((np.sqrt(1 + 4 * (len(flat) - 1)) - 1) / 2))
    return Moments(flat[0], flat[1 : p + 1], flat[p + 1 :].reshape(p, p))


def moments(df: DataFrame, vector: str, groups: Sequence[str] = (), weight: str | None = None) -> dict[tuple, Moments]:
    """Weighted moments per group (one entry, keyed ``()``, without groups)."""
    return {key: unpacked(flat) for key, flat in added(moment_parts(df, vector, groups, weight), list(groups)).items()}


def from_moments(
    df: DataFrame, vector: str, groups: Sequence[str], measure: Callable[[Moments], Sequence[float]], weight: str | None = None
) -> dict[tuple, np.ndarray]:
    """``measure`` of each group's moments, taken in the tasks: its few numbers reach the driver, not the matrices."""
    names = list(groups)
    sums = summed(moment_parts(df, vector, groups, weight), names)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.asarray(measure(unpacked(np.asarray(flat))), dtype="float64") for flat in pdf["sums"]]
            yield pdf[names].assign(found=found)

    types = dict(df.dtypes)
    schema = ", ".join([f"{g} {types[g]}" for g in names] + ["found array<double>"])
    return {tuple(r[g] for g in names): np.asarray(r["found"]) for r in sums.mapInPandas(measured, schema).collect()}


def principal_axes(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and axes as rows, each with its largest loading positive."""
    values, vectors = np.linalg.eigh(scatter)
    values, axes = np.clip(values[::-1], 0.0, None), vectors.T[::-1]
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return values, axes * np.where(signs == 0, 1.0, signs)[:, None]


def array_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def project(vector: Column, mean: np.ndarray, axes: np.ndarray) -> Column:
    """Scores of a vector on the given axes."""
    centred = F.zip_with(vector, array_literal(mean), lambda x, m: x - m)
    return F.array(*[dot(centred, array_literal(axis)) for axis in axes])
