"""Consecutive numbers within groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def numbered(df: DataFrame, group: str, order: Sequence[str | Column], name: str, start: int = 1) -> DataFrame:
    """``df`` with ``name``: each row's place in its group by ``order``, from ``start``.

    Rows are range-partitioned by group and order, counted within their partition, and moved up by what earlier
    partitions hold of their group: one number a partition and group.
    """
    sorted_ = checkpointed(df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema.fields)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            place = pdf.groupby(group, dropna=False).cumcount().to_numpy().astype("int64")
            first, final = pdf[group].iloc[0], pdf[group].iloc[-1]
            same = pdf[group].isna() if pd.isna(first) else pdf[group] == first
            if last is not None and (last[0] == first or (pd.isna(last[0]) and pd.isna(first))):
                place[same.to_numpy()] += held
            own = pdf[group].isna() if pd.isna(final) else pdf[group] == final
            held = int(place[own.to_numpy()].max()) + 1
            last = (final,)
            yield pdf.assign(_part=part, _place=place)

    placed = sorted_.mapInPandas(count, f"{types}, _part int, _place bigint")
    counts = placed.groupBy("_part", F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_part")
    moved = counts.select(F.col("_part").alias("_p"), "_group", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    joined = placed.join(moved, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*df.columns, (F.col("_before") + F.col("_place") + start).alias(name))
