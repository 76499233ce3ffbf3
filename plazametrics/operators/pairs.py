"""Pairwise relations: shared items, Jaccard, cosine and co-location lift.

Pair tables hold the pairs that share something. A pair that is absent has an overlap of
zero, and the summaries count those pairs arithmetically.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .blocks import block_pairs, stack
from .quantiles import grouped_median


def meeting_pairs(
    held: DataFrame, item: Sequence[str], member: str, carry: Sequence[str] = (), share: int = 2000
) -> DataFrame:
    """Self-join on ``item`` giving ``a < b`` members that hold it, hot items split.

    An item with more than ``share`` members is cut into that many slices on the left and
    copied to each slice on the right, so one popular item spreads over several tasks. The
    item columns come back as ``_key0``, ``_key1``, ...
    """
    keys = [f"_key{i}" for i in range(len(item))]
    named = held.select(
        *[F.col(c).alias(k) for c, k in zip(item, keys)], F.col(member).alias("_member"), *[F.col(c).alias(f"_c_{c}") for c in carry]
    )
    sizes = named.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(share)).cast("int").alias("_slices"))
    sized = named.join(sizes, keys)
    left = sized.select(
        *keys, F.col("_member").alias("a"), *[F.col(f"_c_{c}").alias(f"{c}_a") for c in carry],
        F.pmod(F.xxhash64("_member"), F.col("_slices")).cast("int").alias("_slice"),
    )
    right = sized.select(
        *keys, F.col("_member").alias("b"), *[F.col(f"_c_{c}").alias(f"{c}_b") for c in carry],
        F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"),
    )
    return left.join(right, [*keys, "_slice"]).where(F.col("a") < F.col("b")).drop("_slice")


def shared_counts(held: DataFrame, member: str, item: str, groups: Sequence[str] = (), share: int = 2000) -> DataFrame:
    """Number of common items of each pair that has one; ``held`` is distinct.

    A member meets an item's others as one list of those above it. The lists are shuffled by the member, in one place
    of a row each, and counted where they arrive; no row per pair and item crosses the network. Hot items are sliced.
    """
    keys = [f"_key{i}" for i in range(len(groups) + 1)]
    named = held.select(*[F.col(c).alias(k) for c, k in zip([*groups, item], keys)], F.col(member).alias("a"))
    sizes = named.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(
        *keys, F.ceil(F.col("_n") / F.lit(share)).cast("int").alias("_slices")
    )
    sized = named.join(sizes, keys)
    slices = F.sequence(F.lit(0), F.col("_slices") - 1)
    left = sized.select(*keys, "a", F.explode(slices).alias("_slice"))
    lists = sized.groupBy(*keys, F.pmod(F.xxhash64("a"), F.col("_slices")).cast("int").alias("_slice")).agg(
        F.collect_list("a").alias("_others")
    )
    named_groups = [F.col(k).alias(g) for k, g in zip(keys, groups)]
    above = left.join(lists, [*keys, "_slice"]).select(
        *named_groups, "a", F.filter("_others", lambda other: other > F.col("a")).alias("_others")
    ).where(F.size("_others") > 0)
    met = above.repartition(*groups, "a").select(*groups, "a", F.explode("_others").alias("b"))
    return met.groupBy(*groups, "a", "b").agg(F.count("*").alias("shared"))


def jaccard_pairs(df: DataFrame, member: str, item: str) -> DataFrame:
    """Shared and united set sizes and Jaccard similarity per pair of members."""
    held = df.select(member, item).distinct()
    sizes = held.groupBy(member).agg(F.count("*").alias("_size"))
    shared = shared_counts(held, member, item)
    size_a = sizes.select(F.col(member).alias("a"), F.col("_size").alias("size_a"))
    size_b = sizes.select(F.col(member).alias("b"), F.col("_size").alias("size_b"))
    union = F.col("size_a") + F.col("size_b") - F.col("shared")
    return shared.join(size_a, "a").join(size_b, "b").select(
        "a", "b", F.col("shared").alias("shared_brand_count"), union.alias("union_brand_count"),
        F.round(F.col("shared") / union, 6).alias("jaccard_similarity"),
    )


def pair_count(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("bigint")


def similarity_summary(pairs: DataFrame, value: str, members: Column) -> DataFrame:
    """Mean, median and maximum over all pairs, the absent ones counting as zero.

    The pairs are read once, into the number of pairs of each value.
    """
    total = pair_count(members)
    listed = checkpointed(pairs.groupBy(value).agg(F.count("*").alias("_w")))
    # The zero row's weight is what the listed pairs leave over.
    zeros = listed.agg((total - F.coalesce(F.sum("_w"), F.lit(0))).alias("_w")).select(F.lit(0.0).alias(value), "_w")
    weighted = listed.unionByName(zeros)
    middle = grouped_median(weighted, [], value, "median", weight="_w").select("median")
    spread = listed.agg(
        (F.sum(F.col(value) * F.col("_w")) / total).alias("mean"), F.max(value).alias("max"), total.alias("pair_count")
    )
    return spread.select(
        F.round("mean", 6).alias("mean"), F.round(middle.scalar(), 6).alias("median"),
        F.round("max", 6).alias("max"), "pair_count",
    )


def cosine_pairs(vectors: DataFrame, member: str, vector: str, id_type: str = "bigint", **sizing) -> DataFrame:
    """Cosine similarity of every pair of dense vectors (0 for a zero vector)."""
    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        a, b = stack(left[vector]), stack(right[vector])
        norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        scale = np.outer(norm_a, norm_b)
        cosine = np.divide(a @ b.T, scale, out=np.zeros_like(scale), where=scale > 0)
        i, j = np.triu_indices(len(a), 1) if same else np.indices(cosine.shape).reshape(2, -1)
        first, second = left[member].to_numpy()[i], right[member].to_numpy()[j]
        swap = first > second
        return pd.DataFrame({
            "a": np.where(swap, second, first), "b": np.where(swap, first, second), "cosine": cosine[i, j],
        })

    return block_pairs(vectors, member, [vector], kernel, f"a {id_type}, b {id_type}, cosine double", **sizing)


@dataclass(frozen=True)
class Entries:
    """Items of the rows of a block: the row and the item of each entry, in order of rows."""

    rows: np.ndarray
    items: np.ndarray
    size: int

    @staticmethod
    def of(column: pd.Series) -> Entries:
        return Entries(np.repeat(np.arange(len(column)), column.str.len().to_numpy().astype("int64")), np.concatenate(column.tolist()), len(column))

    def where(self, keep: np.ndarray) -> Entries:
        return Entries(self.rows[keep], self.items[keep], self.size)


def met_rows(
    left: Entries, right: Entries, most_rows: int = 1 << 18, budget: int = 1 << 20
) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows of ``left`` at a time: the numbers of left and right rows that share items, and how many they share.

    Each item of a left row is written out as the right rows that hold it, about ``budget`` of them at once; sorting
    brings equal pairs together.
    """
    codes, found = pd.factorize(np.concatenate([left.items, right.items]))
    first, second = codes[: len(left.items)], codes[len(left.items) :]
    order = np.argsort(second, kind="stable")
    holders = right.rows[order]
    starts = np.searchsorted(second[order], np.arange(len(found) + 1))
    width = starts[first + 1] - starts[first]
    bounds = np.searchsorted(left.rows, np.arange(left.size + 1))
    written = np.concatenate([[0], np.cumsum(width)])[bounds]
    at = 0
    while at < left.size:
        fitting = int(np.searchsorted(written, written[at] + budget, side="right")) - 1
        upto = min(max(at + 1, fitting), at + most_rows, left.size)
        part = slice(bounds[at], bounds[upto])
        w = width[part]
        place = np.arange(w.sum()) + np.repeat(starts[first[part]] - (np.cumsum(w) - w), w)
        key = np.repeat(left.rows[part], w) * right.size + holders[place]
        key.sort()
        new = np.flatnonzero(np.diff(key, prepend=-1))
        yield slice(at, upto), key[new] // right.size, key[new] % right.size, np.diff(new, append=len(key))
        at = upto


#: Rows of a block of item sets, and blocks of a side while they are small.
SET_ROWS, SET_GRID = 1 << 18, 6


def colocation_lift(
    df: DataFrame, venue: str, brand: str, min_venues: int = 4, max_venues: int = 30, min_together: int = 5
) -> DataFrame:
    """Lift of every brand pair found together in at least ``min_together`` venues.

    A pair needs ``min_together`` common venues, so it shares one outside any fixed set of
    ``min_together - 1`` venues. The busiest ones are taken out as that set: there, where
    nearly all brands meet, no pairs are made; membership is a bit mask per brand and its
    overlap is added to the counts the other venues give. Brands are met block by block,
    and only pairs found together often enough leave a task.
    """
    held = df.select(venue, brand).distinct()
    total = held.select(F.count_distinct(venue)).scalar()
    spread = checkpointed(
        held.groupBy(brand).agg(F.count("*").alias("malls"), F.collect_list(venue).alias("places")).where(
            F.col("malls").between(max(min_venues, min_together), max_venues)
        )
    )
    kind = dict(spread.dtypes)[brand]
    busiest = spread.select(F.explode("places").alias("_v")).groupBy("_v").agg(F.count("*").alias("_n")).orderBy(
        F.col("_n").desc(), "_v"
    ).limit(min(min_together - 1, 62))
    listed = F.array_sort(F.array_compact(F.array(*[F.lit(r["_v"]) for r in busiest.collect()]))).cast(dict(spread.dtypes)["places"])
    mask = F.aggregate(
        F.col("places"), F.lit(0).cast("bigint"),
        lambda bits, v: F.when(F.array_contains(listed, v), bits.bitwiseOR(F.call_function(
            "shiftleft", F.lit(1).cast("bigint"), (F.array_position(listed, v) - 1).cast("int")))).otherwise(bits),
    )
    sets = spread.select(brand, "malls", mask.alias("mask"), F.array_except("places", listed).alias("places"))

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        found = [pd.DataFrame({c: [] for c in ("a", "b", "malls_a", "malls_b", "cooccurrence")})]
        ids = [part[brand].to_numpy() for part in (left, right)]
        malls = [part["malls"].to_numpy() for part in (left, right)]
        masks = [part["mask"].to_numpy() for part in (left, right)]
        for _, i, j, n in met_rows(Entries.of(left["places"]), Entries.of(right["places"])):
            n = n + np.bitwise_count(masks[0][i] & masks[1][j])
            keep = (n >= min_together) & (i < j if same else True)
            i, j, n = i[keep], j[keep], n[keep]
            swap = ids[0][i] > ids[1][j]
            found.append(pd.DataFrame({
                "a": np.where(swap, ids[1][j], ids[0][i]), "b": np.where(swap, ids[0][i], ids[1][j]),
                "malls_a": np.where(swap, malls[1][j], malls[0][i]), "malls_b": np.where(swap, malls[0][i], malls[1][j]),
                "cooccurrence": n,
            }))
        return pd.concat(found[1:] or found, ignore_index=True)

    counted = block_pairs(
        sets, brand, ["malls", "mask", "places"], kernel, f"a {kind}, b {kind}, malls_a bigint, malls_b bigint, cooccurrence bigint",
        block_rows=SET_ROWS, grid=SET_GRID, tile_rows=SET_ROWS,
    )
    return counted.select(
        F.col("a").alias("brand_a"), F.col("b").alias("brand_b"), "malls_a", "malls_b", "cooccurrence",
        F.round(F.col("cooccurrence") * total / (F.col("malls_a") * F.col("malls_b")), 4).alias("lift"),
    )


def never_together(df: DataFrame, venue: str, brand: str, min_venues: int = 8, id_type: str = "bigint") -> DataFrame:
    """Per widespread brand, the number of other widespread brands it never meets.

    Brands are met block by block along the venues they hold, and only counts leave a task. A venue that holds a large
    share of a block is a row of marks instead, so that it produces no pairs.
    """
    held = df.select(venue, brand).distinct()
    sets = checkpointed(
        held.groupBy(brand).agg(F.collect_list(venue).alias("places")).where(F.size("places") >= min_venues)
    )

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        met_a, met_b = np.zeros(len(left), "int64"), np.zeros(len(right), "int64")
        a, b = Entries.of(left["places"]), Entries.of(right["places"])
        values, sizes = np.unique(b.items, return_counts=True)
        hot = values[sizes > max(64, len(right) // 32)]
        in_hot = [np.isin(e.items, hot) for e in (a, b)]
        marks = [np.zeros((e.size, len(hot)), "float32") for e in (a, b)]
        for mark, e, mine in zip(marks, (a, b), in_hot):
            mark[e.rows[mine], np.searchsorted(hot, e.items[mine])] = 1
        most_rows = max(1, (1 << 25) // len(right)) if len(hot) else len(left)
        for rows, i, j, _ in met_rows(a.where(~in_hot[0]), b.where(~in_hot[1]), most_rows):
            if len(hot):
                met = marks[0][rows] @ marks[1].T > 0
                met_a[rows] += met.sum(axis=1)
                met_b += met.sum(axis=0)
                rare = ~met[i - rows.start, j]
                i, j = i[rare], j[rare]
            met_a += np.bincount(i, minlength=len(left))
            met_b += np.bincount(j, minlength=len(right))
        counts = pd.DataFrame({brand: left[brand], "apart": len(right) - met_a})
        if same:
            return counts
        return pd.concat([counts, pd.DataFrame({brand: right[brand], "apart": len(left) - met_b})])

    counted = block_pairs(
        sets, brand, ["places"], kernel, f"{brand} {id_type}, apart bigint", block_rows=SET_ROWS, grid=SET_GRID, tile_rows=SET_ROWS,
    )
    return counted.groupBy(brand).agg(F.sum("apart").alias("never_met"))


def both_directions(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected edges as (venue, peer) rows in both directions; the edges are computed once."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    ways = F.array(*[F.struct(F.col(x).alias("venue"), F.col(y).alias("peer")) for x, y in ((a, b), (b, a))])
    return pairs.select(F.explode(ways).alias("_way"), *rest).select("_way.venue", "_way.peer", *rest)


def shared_names(df: DataFrame, venue: str, brand: str, name: str) -> DataFrame:
    """Long table of the names two venues share, as the lower venue spells them: once for each brand and spelling.

    Names travel with the lower venue's row, so the pairs are neither joined again nor compared with each other.
    """
    spelled = df.select(venue, brand, name).distinct().groupBy(venue, brand).agg(
        F.collect_list(F.when(F.col(name) != "", F.col(name))).alias("_names")
    )
    met = meeting_pairs(spelled, [brand], venue, carry=["_names"])
    return met.select("a", "b", F.explode("_names_a").alias("shared_name"))
