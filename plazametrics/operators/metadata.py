"""Venue metadata: look-ups with defaults, strict one-to-one joins, candidate ranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import match_quality, venue_match_key
from ..functions.numeric import as_bool

YEAR = r"^(19|20)\d{2}$"


def with_defaults(df: DataFrame, metadata: DataFrame, key: str, columns: Sequence[str], default: str = "") -> DataFrame:
    """Left join; a missing venue or value gives ``default``."""
    joined = df.join(metadata.select(key, *columns), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(default)) for c in columns})


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only; empty when both sides hold the same set."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return (
        a.join(b, key, "left_anti").withColumn("side", F.lit("left"))
        .unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
    )


def strict_join(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """One-to-one join of tables that must hold the same keys once each; refuses any difference or repeat."""
    sides = [p.select(F.col(key), F.lit(i).alias("_i")) for i, p in enumerate(parts)]
    every = sides[0]
    for side in sides[1:]:
        every = every.unionByName(side)
    counts = every.groupBy(key).agg(*[F.count_if(F.col("_i") == i).alias(f"n{i}") for i in range(len(parts))])
    once = [F.col(f"n{i}") == 1 for i in range(len(parts))]
    wrong = counts.where(~reduce(and_, once) | F.col(key).isNull()).limit(5).collect()
    if wrong:
        raise ValueError(f"keys differ or repeat (key, rows on each side): {[tuple(r) for r in wrong]}")
    result = parts[0]
    for part in parts[1:]:
        result = result.join(part, key)
    return result


def unknown_keys(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct().join(known.select(key), key, "left_anti")


def resolve_location(df: DataFrame, metadata: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Coordinates and district from metadata, else the whole row from the fallback table."""
    fields = ["longitude", "latitude", "district"]
    first = metadata.select(key, F.struct(*fields).alias("_first"))
    second = fallback.select(key, F.struct(*fields).alias("_second"))
    joined = df.join(first, key, "left").join(second, key, "left")
    complete = (F.col("_first.longitude") != "") & (F.col("_first.latitude") != "")
    chosen = F.when(F.coalesce(complete, F.lit(False)), F.col("_first")).otherwise(F.col("_second"))
    source = F.when(F.coalesce(complete, F.lit(False)), "metadata").when(F.col("_second").isNotNull(), "fallback")
    return (
        joined.withColumn("_c", chosen).withColumn("coordinate_source", source)
        .select(*df.columns, "_c.*", "coordinate_source")
    )


def merge_seed_years(records: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Opening year and area from active seed rows; only a four-digit year counts as merged."""
    active = seeds.where(as_bool(F.coalesce("active", F.lit("TRUE"))) & (F.trim(key) != "")).select(
        F.trim(key).alias(key), F.trim("opening_year").alias("_year"), F.trim("commercial_area_sqm").alias("_area")
    )
    valid = F.coalesce(F.col("_year").rlike(YEAR), F.lit(False))
    return (
        records.join(active, key, "left")
        .withColumn("opening_year", F.when(valid, F.col("_year")).otherwise(F.col("opening_year")))
        .withColumn("commercial_area_sqm", F.coalesce(F.nullif("_area", F.lit("")), F.col("commercial_area_sqm")))
        .withColumn("year_merged", valid).drop("_year", "_area")
    )


def best_candidate(
    candidates: DataFrame, key: str, wanted: str, ordinal: str, venues: DataFrame | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Best point of interest per venue and the status of the search.

    ``venues`` holds all keys that were searched for: one without candidates is a ``no_match``. Missing fields of a
    candidate count as empty. The expected district filters candidates only where one of them lies in it. The first
    candidate wins a tie. ``carry`` names further columns of the chosen candidate.
    """
    candidates = candidates.na.fill("", ["expected_district", "adname", "typecode", "poi_name"])
    expected = F.col("expected_district")
    here = F.col("adname") == expected
    hits = candidates.groupBy(key).agg(F.max((expected != "") & here).alias("_hit"))
    pool = candidates.join(hits, key).where(~F.col("_hit") | here)
    quality = match_quality(venue_match_key(F.col(wanted)), venue_match_key(F.col("poi_name")))
    ranked = pool.withColumn("quality", quality).withColumn(
        "_rank",
        F.struct(
            -F.col("quality"), -F.startswith("typecode", F.lit("0601")).cast("int"),
            -(~F.col("adname").isin("", "[]")).cast("int"), F.col(ordinal),
        ),
    )
    # Rows without a rank take no part; a filter on the quality would compute it a second time.
    best = ranked.groupBy(key).agg(F.min_by(
        F.struct("poi_name", "adname", "typecode", "quality", expected.alias("expected"), *carry),
        F.when(F.col("quality") > 0, F.col("_rank")),
    ).alias("b"))
    mismatch = (F.col("b.expected") != "") & ~F.col("b.adname").isin("", "[]") & (F.col("b.adname") != F.col("b.expected"))
    status = (
        F.when(F.col("b").isNull(), "no_match")
        .when(mismatch, F.concat(F.lit("district_mismatch:"), F.col("b.adname"))).otherwise("ok")
    )
    every = (candidates if venues is None else venues).select(key).distinct().join(best, key, "left")
    found = status == "ok"
    return every.select(
        key, status.alias("status"),
        *[F.when(found, F.col(f"b.{c}")).alias(c) for c in ("poi_name", "adname", "typecode", "quality", *carry)],
    )


def still_missing(wanted: DataFrame, existing: DataFrame, key: str, done: Column, force: bool = False) -> DataFrame:
    """Work left to do: wanted keys without a finished row (all of them when forced)."""
    return wanted if force else wanted.join(existing.where(done).select(key), key, "left_anti")


def merge_fetched(existing: DataFrame, fetched: DataFrame, key: str, done: Column) -> DataFrame:
    return existing.where(done).join(fetched.select(key), key, "left_anti").unionByName(fetched)
