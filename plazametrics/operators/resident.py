"""Work that is repeated many times over the same rows, in tasks that each hold all rows.

Where the numbers of a table are few, a restart or repetition is cheaper on a copy of the rows than as one distributed
pass a step. The rows go from task to task, never to the driver; a table above the bound keeps the distributed passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a table that a task may hold (32 MB).
HELD_NUMBERS = 1 << 22

Work = Callable[[pd.DataFrame, Sequence], Iterator[pd.DataFrame]]


def fits(rows: int, width: int) -> bool:
    return rows * width <= HELD_NUMBERS


def on_all_rows(df: DataFrame, columns: Sequence[str], units: Sequence, work: Work, schema: str) -> DataFrame:
    """``work(rows, own)`` in as many tasks as there are cores: all rows, and each task's own of the ``units``."""
    tasks = max(1, min(len(units), df.sparkSession.sparkContext.defaultParallelism))
    copies = df.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_task"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield from work(rows.drop(columns="_task"), units[int(rows["_task"].iloc[0]) :: tasks])

    return copies.repartitionById(tasks, F.col("_task")).mapInPandas(run, schema)
