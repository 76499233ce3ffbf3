"""Per-venue counts, diversity, leave-one-out features and category tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import information, ratio, round_exact
from ..functions.text import UNMAPPED
from ..session import checkpointed
from .moments import WIDEST
from .quantiles import grouped_median
from .resolve import first_mode, merged_text
from .rules import active_rows


def cells(df: DataFrame, venue: str, item: str, weight: str | None = None) -> DataFrame:
    """Rows per (venue, item): the sparse incidence table most operators start from.

    ``weight`` names the row count of an input that is already aggregated.
    """
    return df.groupBy(venue, item).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def venue_total(df: DataFrame, venue: str) -> Column:
    """Number of distinct venues as a scalar subquery."""
    return df.select(F.count_distinct(venue)).scalar()


def brand_coverage(df: DataFrame, venue: str, brand: str) -> DataFrame:
    return cells(df, venue, brand).groupBy(brand).agg(
        F.count("*").alias("mall_coverage_count"),
        F.sum("n").alias("brand_store_instance_count"),
    ).withColumn("shared_across_malls", F.col("mall_coverage_count") >= 2)


def with_brand_metrics(df: DataFrame, venue: str, brand: str, chains: DataFrame, key: Column) -> DataFrame:
    """Append coverage and the known-chain flag to every store row."""
    listed = active_rows(chains).select(F.col("chain_key")).distinct()
    covered = df.join(brand_coverage(df, venue, brand), brand).withColumn("_key", key)
    flagged = covered.join(listed, F.col("_key") == F.col("chain_key"), "left")
    return flagged.withColumn("known_chain", F.col("chain_key").isNotNull()).drop("_key", "chain_key")


def brand_summary(
    df: DataFrame, venue: str, brand: str, name: str, l1: str, l2: str, ordinal: str, chain: Column
) -> DataFrame:
    """One row per brand: coverage, size, chain flag, main categories and venue list."""
    coverage = brand_coverage(df, venue, brand).select(
        brand, "mall_coverage_count", F.col("brand_store_instance_count").alias("store_instance_count")
    )
    head = df.withColumn("_chain", chain).groupBy(brand).agg(
        F.min_by(F.struct(F.col(name).alias("name"), "_chain"), ordinal).alias("_h")
    )
    places = merged_text(df, [brand], venue, "mall_names")
    return (
        coverage.join(head, brand)
        .join(first_mode(df, [brand], l1, ordinal, "category_l1"), brand)
        .join(first_mode(df, [brand], l2, ordinal, "category_l2"), brand)
        .join(places, brand)
        .select(
            brand, F.col("_h.name").alias("canonical_brand_name"), "mall_coverage_count", "store_instance_count",
            F.col("_h._chain").alias("known_chain"), "category_l1", "category_l2", "mall_names",
        )
    )


def diversity(df: DataFrame, venue: str, category: str, level1_count: int | Column) -> DataFrame:
    """Entropy, normalised entropy and HHI over the mapped categories of each venue."""
    level1_count = F.lit(level1_count) if isinstance(level1_count, int) else level1_count
    mapped = df.where(F.col(category) != UNMAPPED).groupBy(venue, category).agg(F.count("*").alias("n"))
    # H = ln N - sum(n ln n) / N and HHI = sum(n^2) / N^2 need one pass and no totals join.
    total = F.sum("n")
    entropy = F.ln(total) - F.sum(F.col("n") * F.ln("n")) / total
    return mapped.groupBy(venue).agg(
        total.alias("mapped_category_count"),
        F.abs(F.round(entropy, 6)).alias("category_entropy"),
        F.abs(F.round(F.when(level1_count > 1, entropy / F.ln(level1_count)).otherwise(0.0), 6)).alias(
            "normalized_category_entropy"
        ),
        F.round(F.sum(F.col("n") * F.col("n")) / (total * total), 6).alias("category_hhi"),
    )


def venue_metrics(
    source: DataFrame,
    excluded: Column,
    unmapped: Column,
    instances: DataFrame,
    venue: str,
    brand: str,
    l1: str,
    floor: str,
    rating: str,
    chain: Column,
    level1_count: int | Column,
) -> DataFrame:
    """Counts, rates and diversity per venue; venues without a surviving store stay in."""
    before = source.groupBy(venue).agg(
        F.count("*").alias("source_record_count"),
        F.count_if(excluded).alias("excluded_record_count"),
        F.count_if(unmapped).alias("unmapped_source_record_count"),
    )
    kept = instances.join(brand_coverage(instances, venue, brand).select(brand, "shared_across_malls"), brand)
    after = kept.groupBy(venue).agg(
        F.count("*").alias("final_store_instance_count"),
        F.count_if("shared_across_malls").alias("shared_store_count"),
        F.count_if(chain).alias("known_chain_store_count"),
        F.count_if(F.coalesce(F.col(floor), F.lit("")) == "").alias("missing_floor_count"),
        F.count_if(F.coalesce(F.col(rating).cast("string"), F.lit("")) == "").alias("missing_rating_count"),
    )
    brands = cells(instances, venue, brand).groupBy(venue).agg(F.count("*").alias("unique_brand_count"))
    joined = (
        before.join(after, venue, "left").join(brands, venue, "left")
        .join(diversity(instances, venue, l1, level1_count), venue, "left")
    )
    filled = joined.na.fill(0)
    total = F.col("final_store_instance_count")
    sources = F.col("source_record_count")
    return filled.select(
        venue, "source_record_count", "excluded_record_count",
        (sources - F.col("excluded_record_count")).alias("eligible_before_dedup"),
        (sources - F.col("excluded_record_count") - total).alias("duplicates_removed"),
        "final_store_instance_count", "unique_brand_count", "shared_store_count",
        F.round(ratio(F.col("shared_store_count"), total), 6).alias("shared_store_ratio"),
        "known_chain_store_count",
        F.round(ratio(F.col("known_chain_store_count"), total), 6).alias("known_chain_rate"),
        "mapped_category_count",
        F.round(ratio(F.col("mapped_category_count"), total), 6).alias("category_mapping_rate"),
        "unmapped_source_record_count",
        F.round(ratio(sources - F.col("unmapped_source_record_count"), sources), 6).alias(
            "source_category_mapping_rate"
        ),
        "missing_floor_count", "missing_rating_count",
        "category_entropy", "normalized_category_entropy", "category_hhi",
    )


def category_summary(df: DataFrame, venue: str, category: str) -> DataFrame:
    """Count and share of all stores per (venue, category)."""
    counts = cells(df, venue, category)
    totals = counts.groupBy(venue).agg(F.sum("n").alias("_total"))
    return counts.join(totals, venue).select(
        venue, category, F.col("n").alias("store_instance_count"),
        F.round(F.col("n") / F.col("_total"), 6).alias("category_ratio"),
    )


def unmapped_summary(df: DataFrame, raw: str, venue: str, name: str, noise: Column, sample: int = 8) -> DataFrame:
    """Unclassified values with size, spread and the first few names in order."""
    from pyspark.sql import Window

    names = df.groupBy(raw, name).agg(F.count("*").alias("n"))
    ordered = Window.partitionBy(raw).orderBy(name)
    first_names = (
        names.withColumn("_r", F.row_number().over(ordered)).where(F.col("_r") <= sample)
        .groupBy(raw).agg(F.array_join(F.array_sort(F.collect_list(name)), " | ").alias("sample_merchant_names"))
    )
    sizes = cells(df, venue, raw).groupBy(raw).agg(
        F.sum("n").alias("source_record_count"), F.count("*").alias("mall_count")
    )
    action = F.when(noise, "discard_ocr_category_noise").otherwise("review_or_edit_category_mapping")
    return sizes.join(first_names, raw).withColumn("suggested_action", action)


def loo_rates(df: DataFrame, venue: str, brand: str, head_min: int = 8) -> DataFrame:
    """Leave-one-out standardisation, local-only rate and head-chain rate.

    A store's own venue always holds its brand, so "other venues holding it" is the
    brand's venue count minus one: no per-venue set difference is needed.
    """
    held = cells(df, venue, brand)
    spread = held.groupBy(brand).agg((F.count("*") - 1).alias("_others"))
    rest = venue_total(df, venue) - 1
    joined = held.join(spread, brand)
    total = F.sum("n")
    return joined.groupBy(venue).agg(
        total.alias("store_count"),
        F.count("*").alias("brand_count"),
        F.sum(F.col("n") * F.col("_others")).alias("_seen"),
        F.sum(F.when(F.col("_others") == 0, F.col("n")).otherwise(0)).alias("_local"),
        F.sum(F.when(F.col("_others") >= head_min - 1, F.col("n")).otherwise(0)).alias("_head"),
    ).select(
        venue, "store_count", "brand_count",
        F.round(ratio(F.col("_seen") / F.col("store_count"), rest), 6).alias("standardization_loo"),
        F.round(F.col("_head") / F.col("store_count"), 6).alias("head_chain_rate"),
        F.round(F.col("_local") / F.col("store_count"), 6).alias("local_only_rate"),
    )


def function_rarity(df: DataFrame, venue: str, category: str) -> DataFrame:
    """Mean over a venue's distinct categories of ``ln(N / max(other venues with it, 1))``."""
    held = df.select(venue, category).distinct()
    spread = held.groupBy(category).agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("_others"))
    joined = held.join(spread, category)
    return joined.groupBy(venue).agg(
        F.count("*").alias("l2_breadth"),
        F.round(F.avg(F.ln(venue_total(df, venue) / F.col("_others"))), 6).alias("function_rarity_loo"),
    )


def membership_shares(df: DataFrame, venue: str, groups: dict[str, Column], weight: str | None = None) -> DataFrame:
    """Share of a venue's stores for which each named condition holds."""
    n = F.col(weight) if weight else F.lit(1)
    shares = [F.round(F.sum(F.when(test, n).otherwise(0)) / F.sum(n), 6).alias(name) for name, test in groups.items()]
    return df.groupBy(venue).agg(*shares)


@dataclass(frozen=True)
class PriceRule:
    low: float = 20.0
    high: float = 1000.0
    min_samples: int = 5


def price_profile(df: DataFrame, venue: str, price: str, eligible: Column, rule: PriceRule = PriceRule()) -> DataFrame:
    """Median, log median, sample size and dispersion of eligible prices.

    Venues without enough samples, and zero values, give NULL.
    """
    value = F.when(eligible, F.col(price).cast("double"))
    priced = df.select(venue, F.when(value.between(rule.low, rule.high), value).alias("_price"))
    spread = priced.groupBy(venue).agg(
        F.count("_price").alias("sitdown_price_sample"),
        F.stddev_pop("_price").alias("_sd"), F.avg("_price").alias("_mean"),
    )
    middle = grouped_median(priced, [venue], "_price", "_median").drop("_median_sample")
    enough = F.col("sitdown_price_sample") >= rule.min_samples
    median = F.when(enough, F.nullif(F.col("_median"), F.lit(0.0)))
    dispersion = F.when(enough & (F.col("_mean") > 0), F.nullif(F.col("_sd") / F.col("_mean"), F.lit(0.0)))
    return spread.join(middle, venue, "left").select(
        venue, "sitdown_price_sample",
        round_exact(median, 2).alias("sitdown_price_median"),
        F.round(F.ln(median), 6).alias("sitdown_price_log"),
        F.round(dispersion, 6).alias("price_dispersion"),
    )


def ubiquity(df: DataFrame, venue: str, category: str) -> DataFrame:
    return cells(df, venue, category).groupBy(category).agg(
        F.count("*").alias("mall_count"), F.sum("n").alias("store_count")
    ).withColumn("ubiquity_ratio", F.round(F.col("mall_count") / venue_total(df, venue), 6))


def entropy_l1(df: DataFrame, venue: str, category: str, weight: str | None = None) -> DataFrame:
    """Entropy over all categories of a venue, unmapped ones included."""
    counts = cells(df, venue, category, weight)
    totals = counts.groupBy(venue).agg(F.sum("n").alias("_total"))
    term = information(F.col("n") / F.col("_total"))
    return counts.join(totals, venue).groupBy(venue).agg(F.round(F.sum(term), 6).alias("category_entropy_l1"))


def venue_features(
    df: DataFrame, venue: str, brand: str, l1: str, l2: str, price: str, rating: str,
    shares: dict[str, Column], sitdown: Column, head_min: int = 8, price_rule: PriceRule = PriceRule(),
) -> DataFrame:
    """The per-venue feature table (without metadata columns).

    Shares, breadth, entropy and ratings come from one table of counts per (venue,
    categories), so ``shares`` are conditions on the category columns. Prices and brands
    need a pass of their own.
    """
    rated = F.col(rating).cast("double")
    base = checkpointed(df.groupBy(venue, l1, l2).agg(
        F.count("*").alias("_n"), F.sum(rated).alias("_rated"), F.count(rated).alias("_ratings")
    ))
    mean = F.sum("_rated") / F.nullif(F.sum("_ratings"), F.lit(0))
    parts = [
        loo_rates(df, venue, brand, head_min),
        function_rarity(base, venue, l2),
        membership_shares(base, venue, shares, "_n"),
        price_profile(df, venue, price, sitdown, price_rule),
        base.groupBy(venue).agg(F.round(mean, 4).alias("mean_rating")),
        entropy_l1(base, venue, l1, "_n"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.join(part, venue, "left")
    return result


def vocabulary(df: DataFrame, category: str, largest: int = WIDEST) -> list:
    """Sorted category labels: a dimension of the model, refused when it is not small."""
    labels = [r[0] for r in df.select(category).distinct().sort(category).limit(largest + 1).collect()]
    if len(labels) > largest:
        raise ValueError(f"more than {largest} categories: not a category column")
    return labels


def count_matrix(df: DataFrame, venue: str, category: str, labels: Sequence | None = None) -> DataFrame:
    """Venue x category counts, wide, absent combinations zero."""
    labels = list(labels) if labels is not None else vocabulary(df, category)
    return cells(df, venue, category).groupBy(venue).pivot(category, labels).agg(F.sum("n")).na.fill(0)


def dense_counts(cells: DataFrame, venue: str, category: str, count: str, labels: Sequence, name: str) -> DataFrame:
    """One dense array per venue from long counts, in the order of ``labels``; absent categories are zero."""
    place = {c: i for i, c in enumerate(labels)}
    shared = cells.sparkSession.sparkContext.broadcast(place)
    kinds = dict(cells.dtypes)
    listed = cells.groupBy(venue).agg(F.collect_list(category).alias("_labels"), F.collect_list(F.col(count).cast("double")).alias("_counts"))

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = shared.value
        for pdf in batches:
            out = np.zeros((len(pdf), len(place)))
            for row, (names, values) in enumerate(zip(pdf["_labels"], pdf["_counts"])):
                known = [(place[c], v) for c, v in zip(names, values) if c in place]
                if known:
                    at, v = zip(*known)
                    out[row, list(at)] = v
            yield pd.DataFrame({venue: pdf[venue], name: list(out)})

    return listed.mapInPandas(filled, f"`{venue}` {kinds[venue]}, {name} array<double>")


def count_vectors(df: DataFrame, venue: str, category: str, labels: Sequence) -> DataFrame:
    """Same matrix with one dense ``counts`` array per venue, in the order of ``labels``."""
    return dense_counts(cells(df, venue, category), venue, category, "n", labels, "counts")


def matrix_shape(vectors: DataFrame, counts: str = "counts") -> DataFrame:
    """Rows, columns, store total, zero share and the range of row sums."""
    row_sum = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    zeros = F.size(F.filter(counts, lambda x: x == 0))
    each = vectors.select(row_sum.alias("_s"), zeros.alias("_z"), F.size(counts).alias("_k"))
    return each.agg(
        F.count("*").alias("row_count"), F.max("_k").alias("category_count"),
        F.sum("_s").cast("bigint").alias("store_total"),
        F.round(F.sum("_z") / F.sum("_k"), 6).alias("zero_share"),
        F.min("_s").cast("bigint").alias("row_sum_min"), F.max("_s").cast("bigint").alias("row_sum_max"),
    )


def category_maps(df: DataFrame, venue: str, category: str) -> DataFrame:
    """``map<category, count>`` per venue (as many entries as the venue has categories)."""
    return cells(df, venue, category).groupBy(venue).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(category), F.col("n"))))).alias("categories")
    )
