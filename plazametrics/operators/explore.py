"""Drill-down queries over the results: search, facets, peers and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import composition_color, remaining_share
from ..functions.text import contains_ci
from .venue import cells

# The catch-all category and the ellipsis of a shortened list.
CATCH_ALL = "其它"
ELLIPSIS = "…"


def search(df: DataFrame, needle: str, columns: Sequence[str]) -> DataFrame:
    """Rows with ``needle`` in any of the columns, ignoring case."""
    test = F.lit(False)
    for c in columns:
        test = test | contains_ci(F.coalesce(F.col(c).cast("string"), F.lit("")), needle)
    return df.where(test)


def store_filter(
    df: DataFrame, needle: str = "", group: str = "", floor: str = "", names: Sequence[str] = ("name", "brand"),
    group_column: str = "group", floor_column: str = "floor",
) -> DataFrame:
    """Text, group and floor, each optional."""
    result = df
    if needle.strip():
        text = F.concat_ws(" ", *[F.col(n) for n in names])
        result = result.where(contains_ci(text, needle.strip()))
    if group:
        result = result.where(F.col(group_column) == group)
    if floor:
        result = result.where(F.col(floor_column) == floor)
    return result


def page(df: DataFrame, order: Sequence[str | Column], size: int = 40) -> DataFrame:
    return df.orderBy(*order).limit(size)


def facets(df: DataFrame, venue: str, column: str) -> DataFrame:
    """Distinct non-empty values per venue with their number of stores."""
    return df.where(F.col(column) != "").groupBy(venue, column).agg(F.count("*").alias("stores"))


def numeric_sort_key(value: Column) -> Column:
    """Sort key under which ``F2`` comes before ``F10``."""
    number = F.regexp_extract(value, r"(\d+)", 1)
    return F.struct(F.regexp_replace(value, r"\d+.*$", "").alias("a"), number.try_cast("bigint").alias("n"), value.alias("v"))


def top_relations(directed: DataFrame, metric: str, shared: str, top: int = 3) -> DataFrame:
    """Each venue's strongest peers with a positive metric."""
    rank = Window.partitionBy("venue").orderBy(F.col(metric).desc(), F.col(shared).desc(), "peer")
    positive = directed.where(F.col(metric) > 0)
    return positive.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)


def over_represented(df: DataFrame, venue: str, category: str, top: int = 5, fewest: int = 3) -> DataFrame:
    """Categories whose share in a venue exceeds their overall share most (signed difference)."""
    counts = cells(df, venue, category)
    venue_sum = counts.groupBy(venue).agg(F.sum("n").alias("_venue"))
    overall = counts.groupBy(category).agg(F.sum("n").alias("_all"))
    total = counts.agg(F.sum("n")).scalar()
    share = F.col("n") / F.col("_venue")
    compared = (
        counts.where((F.col(category) != CATCH_ALL) & (F.col("n") >= fewest))
        .join(venue_sum, venue).join(overall, category)
        .select(venue, category, "n", F.round(share, 6).alias("share"),
                F.round(share - F.col("_all") / total, 6).alias("difference"))
    )
    rank = Window.partitionBy(venue).orderBy(F.col("difference").desc(), category)
    return compared.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)


def venue_detail(features: DataFrame, venue: str, a: str, b: str) -> DataFrame:
    """Panel figures with the rest share and the composition colour."""
    rest = remaining_share(F.col(a), F.col(b))
    return features.withColumn("other_share", F.round(rest, 6)).withColumn(
        "color", composition_color([F.col(a), F.col(b), rest])
    )


def relation_evidence(names: DataFrame, top: int = 5) -> DataFrame:
    """First shared names of each pair, with an ellipsis when there are more."""
    rank = Window.partitionBy("a", "b").orderBy("shared_name")
    sizes = names.groupBy("a", "b").agg(F.count("*").alias("shared_total"))
    head = (
        names.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= top)
        .groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("shared_name")), "、").alias("text"))
    )
    tail = F.when(F.col("shared_total") > top, ELLIPSIS).otherwise("")
    return head.join(sizes, ["a", "b"]).select("a", "b", "shared_total", F.concat("text", tail).alias("evidence"))


def visible_set(matches: DataFrame, selected: DataFrame, peers: DataFrame, venue: str) -> DataFrame:
    """Search hits, the selected venues and their strongest peers."""
    chosen = peers.join(selected.select(F.col(venue).alias("venue")), "venue").select(F.col("peer").alias(venue))
    return matches.select(venue).union(selected.select(venue)).union(chosen).distinct()


def member_mean(df: DataFrame, group: str, shares: Sequence[str]) -> DataFrame:
    """Unweighted mean composition of the members of a map cluster."""
    return df.groupBy(group).agg(F.count("*").alias("size"), *[F.round(F.avg(s), 6).alias(s) for s in shares])


def padded_bounds(bounds: DataFrame, low: str, high: str, pad: float = 0.16) -> DataFrame:
    span = F.col(high) - F.col(low)
    return bounds.withColumns({
        f"{low}_padded": F.round(F.col(low) - span * pad, 6), f"{high}_padded": F.round(F.col(high) + span * pad, 6),
    })


# The corners of the ternary legend and its size in pixels.
TERNARY_CORNERS = ((76, 7), (8, 108), (144, 108))
TERNARY_SIZE = (152, 116)


def ternary_shares(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Barycentric coordinates of a legend pixel."""
    (tx, ty), (lx, ly), (rx, ry) = TERNARY_CORNERS
    area = (ly - ry) * (tx - rx) + (rx - lx) * (ty - ry)
    a = ((ly - ry) * (x - rx) + (rx - lx) * (y - ry)) / area
    b = ((ry - ty) * (x - rx) + (tx - rx) * (y - ry)) / area
    return a, b, 1 - a - b
