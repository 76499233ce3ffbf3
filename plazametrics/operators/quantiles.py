"""Exact medians and order statistics that never gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BINS = 64


def _binned(df: DataFrame, keys: Sequence[str], value: str, weight: str | None, bins: int) -> DataFrame:
    """(keys, value) counts with the group's size and a bin for each value.

    Bins are cut at approximate quantiles of the group's different values, so that each holds about as many of them
    however far they lie apart; counts per bin are exact all the same.
    """
    amount = F.sum(weight) if weight else F.count("*")
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(amount.cast("bigint").alias("_n")).where(F.col("_n") > 0)
    )
    cuts = F.percentile_approx("_v", [i / bins for i in range(1, bins)], 20 * bins)
    span = counts.groupBy(*keys).agg(cuts.alias("_cuts"), F.sum("_n").alias("_size"))
    if keys:
        held = counts.join(span, list(keys))
    else:
        one = span.select(F.struct("_cuts", "_size").alias("s")).scalar()
        held = counts.withColumn("_s", one).select("_v", "_n", "_s.*")
    return held.withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], weight: str | None = None,
    bins: int = BINS,
) -> DataFrame:
    """Values at 1-based ranks per group.

    ``ranks`` maps an output name to a rank expression over ``_size``, the group's number
    of values. Values are counted first; running counts over at most ``bins`` bins locate
    each rank, and only the values of the bins that hold one are ordered.
    """
    keys = list(keys)
    binned = _binned(df, keys, value, weight, bins)
    wanted = {name: rank.cast("bigint") for name, rank in ranks.items()}
    histogram = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_in_bin"), F.first("_size").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = histogram.withColumn("_before", F.coalesce(F.sum("_in_bin").over(earlier), F.lit(0)))
    holds = F.lit(False)
    for rank in wanted.values():
        holds = holds | ((rank > F.col("_before")) & (rank <= F.col("_before") + F.col("_in_bin")))
    targets = placed.where(holds).select(*keys, "_bin", "_before")
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.join(targets, [*keys, "_bin"]).withColumn(
        "_upto", F.col("_before") + F.sum("_n").over(inside)
    )
    picks = [
        F.max(F.when((rank > F.col("_upto") - F.col("_n")) & (rank <= F.col("_upto")), F.col("_v"))).alias(name)
        for name, rank in wanted.items()
    ]
    return ranked.groupBy(*keys).agg(*picks, F.first("_size").alias("_size"))


def grouped_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str, weight: str | None = None
) -> DataFrame:
    """Exact median per group (the mean of the middle two), with the sample size."""
    size = F.col("_size")
    middle = order_statistics(
        df, keys, value, {"_low": F.floor((size + 1) / 2), "_high": F.floor(size / 2) + 1}, weight
    )
    return middle.select(
        *keys, ((F.col("_low") + F.col("_high")) / 2).alias(out), F.col("_size").alias(f"{out}_sample")
    )


def trimmed_bounds(df: DataFrame, value: str, low: str, high: str, share: float = 0.1) -> DataFrame:
    """Values at sorted positions ``floor(share*n)`` and ``ceil((1-share)*n)-1`` (0-based)."""
    size = F.col("_size")
    return order_statistics(
        df, [], value, {low: F.floor(size * share) + 1, high: F.ceil(size * (1 - share))}
    ).drop("_size")
