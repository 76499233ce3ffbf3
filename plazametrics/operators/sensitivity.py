"""Brand-overlap results under several brand identities and singleton policies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import IDENTITIES
from ..session import checkpointed
from .pairs import pair_count, shared_counts
from .quantiles import grouped_median

KEEP, DROP = "keep_all", "drop_weak_singletons"


def identity_cells(
    df: DataFrame, venue: str, brand: str, name: str, observations: Column,
    identities: dict[str, Callable[[Column, Column], Column]] = IDENTITIES,
) -> DataFrame:
    """Distinct (identity, key, venue) with the most observations seen, all identities at once."""
    base = df.groupBy(venue, brand, name).agg(F.max(observations).alias("_obs"))
    labelled = F.array(*[
        F.struct(F.lit(label).alias("brand_identity"), rule(F.col(brand), F.col(name)).alias("key"))
        for label, rule in identities.items()
    ])
    return (
        base.select(venue, "_obs", F.explode(labelled).alias("_i")).select(venue, "_obs", "_i.*")
        .groupBy("brand_identity", "key", venue).agg(F.max("_obs").alias("observations"))
    )


def weak_singletons(cells: DataFrame, venue: str) -> DataFrame:
    """Keys found in one venue only and never seen more than once."""
    return cells.groupBy("brand_identity", "key").agg(
        F.count("*").alias("venues"), F.max("observations").alias("observations")
    ).where((F.col("venues") == 1) & (F.col("observations") <= 1))


def sensitivity_grid(cells: DataFrame, venue: str) -> DataFrame:
    """Brand and overlap statistics for every identity x singleton policy.

    Weak singletons stand in one venue, so they never enter an intersection: the pair
    join is done once per identity and only set sizes differ between the policies. The
    incidence table feeds five consumers and is written out once.
    """
    cells = checkpointed(cells)
    weak = weak_singletons(cells, venue).select("brand_identity", "key", F.lit(True).alias("weak"))
    marked = cells.join(weak, ["brand_identity", "key"], "left").withColumn("weak", F.coalesce("weak", F.lit(False)))
    both = marked.withColumn("singleton_policy", F.explode(F.array(F.lit(KEEP), F.lit(DROP)))).where(
        (F.col("singleton_policy") == KEEP) | ~F.col("weak")
    )
    group = ["brand_identity", "singleton_policy"]
    brands = both.groupBy(*group, "key").agg(F.count("*").alias("venues")).groupBy(*group).agg(
        F.count("*").alias("brand_count"), F.count_if(F.col("venues") == 1).alias("singleton_count")
    )
    sizes = both.groupBy(*group, venue).agg(F.count("*").alias("size"))
    totals = sizes.groupBy(*group).agg(pair_count(F.count("*")).alias("pairs"))
    met = shared_counts(cells.select("brand_identity", "key", venue), venue, "key", ["brand_identity"])
    size_a = sizes.select(*group, F.col(venue).alias("a"), F.col("size").alias("size_a"))
    size_b = sizes.select(*group, F.col(venue).alias("b"), F.col("size").alias("size_b"))
    overlaps = met.join(size_a, ["brand_identity", "a"]).join(size_b, [*group, "b"]).withColumn(
        "jaccard", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    )
    jaccard = checkpointed(overlaps.select(*group, "jaccard"))
    listed = jaccard.groupBy(*group, "jaccard").agg(F.count("*").alias("w"))
    zeros = (
        totals.join(jaccard.groupBy(*group).agg(F.count("*").alias("found")), group, "left")
        .select(*group, F.lit(0.0).alias("jaccard"), (F.col("pairs") - F.coalesce("found", F.lit(0))).alias("w"))
    )
    middle = grouped_median(listed.unionByName(zeros), group, "jaccard", "median", weight="w").drop("median_sample")
    spread = jaccard.groupBy(*group).agg(F.sum("jaccard").alias("sum"), F.max("jaccard").alias("max"))
    weak_counts = weak.groupBy("brand_identity").agg(F.count("*").alias("weak_n"))
    return (
        brands.join(totals, group).join(middle, group, "left").join(spread, group, "left")
        .join(weak_counts, "brand_identity", "left")
        .select(
            *group, F.coalesce("weak_n", F.lit(0)).alias("weak_singletons_in_definition"),
            "brand_count", "singleton_count",
            F.round(F.col("singleton_count") / F.col("brand_count"), 4).alias("singleton_share"),
            F.round(F.coalesce(F.col("sum"), F.lit(0.0)) / F.col("pairs"), 4).alias("jaccard_mean"),
            F.round("median", 4).alias("jaccard_median"),
            F.round(F.coalesce("max", F.lit(0.0)), 4).alias("jaccard_max"),
        )
    )


def sensitivity_summary(grid: DataFrame, cosine_mean: Column) -> DataFrame:
    """Range of the mean overlap and how many times structure exceeds it."""
    return grid.agg(
        F.min("jaccard_mean").alias("jaccard_low"), F.max("jaccard_mean").alias("jaccard_high"),
        F.round(F.max(cosine_mean) / F.max("jaccard_mean"), 1).alias("structural_to_brand_ratio"),
    )
