"""Standardisation, correlation structure, nestedness and rarefaction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import stack
from .moments import moments
from .quantiles import BINS


def zscores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns standardised by the population deviation; a constant column gives 0."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    )
    one = stats.select(F.struct("*").alias("s")).scalar()
    held = df.withColumn("_s", one)
    for c in columns:
        spread = F.col(f"_s.s_{c}")
        held = held.withColumn(c, (F.col(c) - F.col(f"_s.m_{c}")) / F.when(spread == 0, 1.0).otherwise(spread))
    return held.drop("_s")


def pearson(a: Column, b: Column) -> Column:
    """Correlation aggregate; NULL below three complete pairs or without variation."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    # Built from its parts: the corr aggregate itself fails on a constant column.
    scale = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.when(F.count(x) >= 3, F.covar_pop(x, y) / scale)


def usable_features(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns without a missing value in any row."""
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if missing[c] == 0]


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "feature", "missing").withColumn("usable", F.col("missing") == 0)


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Marginal correlation of each unordered column pair, one pass over the rows."""
    named = {
        f"{a}|{b}": pearson(F.col(a), F.col(b)) for i, a in enumerate(columns) for b in columns[i + 1:]
    }
    wide = df.agg(*[value.alias(name) for name, value in named.items()])
    long = wide.unpivot([], list(named), "pair", "marginal_corr")
    return long.select(
        F.split("pair", r"\|")[0].alias("feature_a"), F.split("pair", r"\|")[1].alias("feature_b"), "marginal_corr"
    )


def verdict(partial: Column, marginal: Column) -> Column:
    return F.when(F.abs(partial) > 0.3, "direct").when(F.abs(marginal) > 0.4, "spurious").otherwise("weak")


def partial_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Marginal and partial correlation of each pair, all other columns held fixed.

    A column without variation takes no part; its correlations are NULL.
    """
    columns = list(columns)
    m = moments(df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x")), "x")[()]
    cov = m.scatter()
    floor = 1e-12 * np.maximum(np.diag(m.gram), 1e-300)
    varying = np.flatnonzero(np.diag(cov) > floor)
    scale = np.sqrt(np.diag(cov)[varying])
    corr = np.full(cov.shape, np.nan)
    partial = np.full(cov.shape, np.nan)
    if len(varying):
        inner = cov[np.ix_(varying, varying)] / np.outer(scale, scale)
        precision = np.linalg.pinv(inner, hermitian=True)
        root = np.sqrt(np.diag(precision))
        corr[np.ix_(varying, varying)] = inner
        partial[np.ix_(varying, varying)] = -precision / np.outer(root, root)

    def known(value: float) -> float | None:
        return None if np.isnan(value) else float(value)

    rows = [
        (columns[i], columns[j], known(corr[i, j]), known(partial[i, j]))
        for i in range(len(columns)) for j in range(i + 1, len(columns))
    ]
    table = df.sparkSession.createDataFrame(
        rows, "feature_a string, feature_b string, marginal_corr double, partial_corr double"
    )
    return table.select(
        "feature_a", "feature_b", F.round("marginal_corr", 4).alias("marginal_corr"),
        F.round("partial_corr", 4).alias("partial_corr"),
        verdict(F.col("partial_corr"), F.col("marginal_corr")).alias("verdict"),
    )


def diversity_table(df: DataFrame, venue: str, category: str) -> DataFrame:
    """Per venue: stores, distinct categories and the mean ubiquity of those categories."""
    held = df.groupBy(venue, category).agg(F.count("*").alias("_n"))
    spread = held.groupBy(category).agg(F.count("*").alias("_venues"))
    return held.join(spread, category).groupBy(venue).agg(
        F.sum("_n").alias("store_count"), F.count("*").alias("diversity"),
        F.avg("_venues").alias("mean_ubiquity"),
    )


def nestedness(df: DataFrame, venue: str, category: str) -> DataFrame:
    table = diversity_table(df, venue, category)
    return table.agg(
        F.round(pearson(F.col("diversity"), F.col("mean_ubiquity")), 4).alias("corr_diversity_ubiquity"),
        F.round(pearson(F.col("store_count"), F.col("diversity")), 4).alias("corr_size_diversity"),
        F.min("diversity").alias("diversity_min"), F.max("diversity").alias("diversity_max"),
        F.min("store_count").alias("smallest_store_count"),
    )


def rarefaction(vectors: DataFrame, venue: str, counts: str = "counts", reps: int = 30, seed: int = 7) -> DataFrame:
    """Nestedness correlation per repetition after thinning every venue to the smallest size.

    Drawing stores without replacement and keeping their category is a multivariate
    hypergeometric draw on the venue's count vector, so stores are never replicated.
    """
    size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    smallest = int(vectors.agg(F.min(size)).first()[0])
    types = dict(vectors.dtypes)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            full = stack(pdf[counts]).astype("int64")
            for name, mark, row in zip(pdf[venue], pdf["_seed"], full):
                rng = np.random.default_rng([seed, mark & 0x7FFFFFFFFFFFFFFF])
                taken = rng.multivariate_hypergeometric(row, smallest, size=reps, method="marginals") > 0
                rows += [(rep, name, np.flatnonzero(taken[rep])) for rep in range(reps)]
            yield pd.DataFrame(rows, columns=["rep", venue, "kinds"])

    drawn = vectors.select(venue, counts, F.xxhash64(venue).alias("_seed")).mapInPandas(
        draw, f"rep int, {venue} {types[venue]}, kinds array<int>"
    )
    held = drawn.select("rep", venue, F.explode("kinds").alias("kind"))
    spread = held.groupBy("rep", "kind").agg(F.count("*").alias("_venues"))
    table = held.join(spread, ["rep", "kind"]).groupBy("rep", venue).agg(
        F.count("*").alias("diversity"), F.avg("_venues").alias("mean_ubiquity")
    )
    return table.groupBy("rep").agg(
        pearson(F.col("diversity"), F.col("mean_ubiquity")).alias("corr"), F.min("diversity").alias("diversity_min"),
        F.max("diversity").alias("diversity_max"),
    ).withColumn("rarefied_to", F.lit(smallest))


def rarefaction_summary(reps: DataFrame) -> DataFrame:
    return reps.agg(
        F.round(F.avg("corr"), 4).alias("rarefied_corr_mean"),
        F.round(F.stddev_pop("corr"), 4).alias("rarefied_corr_sd"),
        F.first("rarefied_to").alias("rarefied_to_n_stores"),
        F.count("*").alias("rarefaction_reps"),
    )


def posthoc(df: DataFrame, factors: Sequence[str], variables: dict[str, Column], fewest: int = 5) -> DataFrame:
    """Correlation of each external variable with each factor over its complete rows."""
    long = df.select(
        *factors,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("variable"), v.cast("double").alias("value")) for n, v in variables.items()])
        ).alias("_v"),
    ).select(*factors, "_v.*").where(F.col("value").isNotNull())
    result = long.groupBy("variable").agg(
        F.count("*").alias("n"),
        *[F.round(pearson(F.col(f), F.col("value")), 4).alias(f"corr_{f}") for f in factors],
    )
    for f in factors:
        result = result.withColumn(f"corr_{f}", F.when(F.col("n") >= fewest, F.col(f"corr_{f}")))
    return result


def half_summary(df: DataFrame, size: str, values: Sequence[str]) -> DataFrame:
    """Medians of ``values`` among the venues up to and above the median size."""
    from .quantiles import grouped_median

    middle = grouped_median(df, [], size, "_m").select("_m").scalar()
    halves = df.withColumn("half", F.when(F.col(size) <= middle, "smaller").otherwise("larger"))
    result = halves.groupBy("half").agg(F.count("*").alias("venues"))
    for v in values:
        part = grouped_median(halves, ["half"], v, f"median_{v}").drop(f"median_{v}_sample")
        result = result.join(part, "half")
    return result


def share_check(df: DataFrame, shares: Sequence[str]) -> DataFrame:
    """How many rows have each share as the largest, and how many do not sum to one."""
    total = sum((F.col(s) for s in shares[1:]), F.col(shares[0]))
    peak = F.greatest(*shares)
    leader = F.coalesce(*[F.when(F.col(s) == peak, F.lit(s)) for s in shares])
    return df.groupBy(leader.alias("largest_share")).agg(
        F.count("*").alias("venues"), F.count_if(F.abs(total - 1) > 1e-5).alias("not_summing_to_one")
    )


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Mid-ranks: ties share their mean rank. Distinct values are counted before ranking."""
    from pyspark.sql import Window

    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    # Cut at approximate quantiles of the different values, so that no bin holds most of them.
    cuts = counts.agg(F.percentile_approx(value, [i / BINS for i in range(1, BINS)], 20 * BINS)).scalar()
    binned = counts.withColumn("_cuts", cuts).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    before = binned.groupBy("_bin").agg(F.sum("_n").alias("_k")).withColumn(
        "_before",
        F.coalesce(F.sum("_k").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    inside = Window.partitionBy("_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = binned.join(before, "_bin").withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    mid = F.col("_upto") - (F.col("_n") - 1) / 2
    return df.join(ranks.select(value, mid.alias(out)), value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df.select(a, b).dropna(), a, "_ra"), b, "_rb")
    return ranked.agg(F.count("*").alias("n"), F.round(pearson(F.col("_ra"), F.col("_rb")), 4).alias("spearman"))


def regression(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Standardised coefficients and fit of a least-squares model by normal equations."""
    names = [*columns, target]
    m = moments(df.select(F.array(*[F.col(c).cast("double") for c in names]).alias("x")), "x")[()]
    cov = m.scatter()
    scale = np.sqrt(np.diag(cov))
    corr = cov / np.outer(scale, scale)
    beta = np.linalg.solve(corr[:-1, :-1], corr[:-1, -1])
    r2 = float(beta @ corr[:-1, -1])
    adjusted = 1 - (1 - r2) * (m.n - 1) / (m.n - len(columns) - 1)
    rows = [(c, float(b), r2, float(adjusted), int(m.n)) for c, b in zip(columns, beta)]
    fitted = df.sparkSession.createDataFrame(rows, "variable string, beta double, r2 double, adjusted_r2 double, n bigint")
    return fitted.select("variable", *[F.round(c, 4).alias(c) for c in ("beta", "r2", "adjusted_r2")], "n")


def first_order_partial(xy: Column, xz: Column, yz: Column) -> Column:
    """Correlation of x and y given z, from the three marginal correlations."""
    return (xy - xz * yz) / F.sqrt((1 - xz * xz) * (1 - yz * yz))


