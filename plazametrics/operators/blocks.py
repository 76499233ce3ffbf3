"""All-pairs kernels over vectors, worked block against block.

Rows are hashed into blocks, and each unordered pair of blocks meets in one task, where numpy does the arithmetic tile
by tile; only what the kernel returns, or the sums over the tiles, leave the task. A row is copied once a block: to a fixed
grid as long as blocks stay within their bound, beyond that to as few blocks as the bound allows. No cross join is
planned and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Kernel = Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame]
#: Blocks of a side while they are small: 10 pairs of blocks keep as many tasks busy.
GRID = 4
#: Rows of a block at most (9 MB of 70 numbers a row), and of a tile, whose distances are held at once.
BLOCK_ROWS, TILE_ROWS = 16384, 1024
#: Rows whose sums leave a task or are added at once.
SENT_ROWS = 1024


def paired(
    df: DataFrame, row_id: str, columns: Sequence[str], groups: Sequence[str], block_rows: int, rows: int | None, grid: int
) -> tuple[DataFrame, int]:
    """Rows with their block and, as ``_a <= _b``, each pair of blocks they meet in; and the number of blocks."""
    if rows is None:
        rows = (df.groupBy(*groups).count().agg(F.max("count")).first()[0] if groups else df.count()) or 0
    blocks = max(1, min(grid, -(-rows // TILE_ROWS)), -(-rows // block_rows))
    place = F.pmod(F.xxhash64(row_id), F.lit(blocks)).cast("int")
    held = df.select(*groups, row_id, *columns).withColumn("_block", place)
    spread = held.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.withColumn("_a", F.least("_block", "_other")).withColumn("_b", F.greatest("_block", "_other")), blocks


def dealt(keyed: DataFrame, blocks: int) -> DataFrame:
    """One partition a pair of blocks, however small: the shuffle would put pairs of little data into one task."""
    pair = (F.col("_b") * (F.col("_b") + 1) / 2).cast("int") + F.col("_a")
    return keyed.repartitionById(blocks * (blocks + 1) // 2, pair)


def block_pairs(
    df: DataFrame, row_id: str, columns: Sequence[str], kernel: Kernel, schema: str,
    groups: Sequence[str] = (), block_rows: int = BLOCK_ROWS, rows: int | None = None, grid: int = GRID,
    tile_rows: int = TILE_ROWS, prepare: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Apply ``kernel(left, right, same)`` to every unordered pair of tiles of every pair of blocks.

    ``groups`` keeps independent point sets apart; ``rows`` is the number of rows of the
    largest one (counted when not given). ``prepare`` adds columns to a block's rows where they
    meet. Each tile's result leaves the task as soon as it is there.
    """
    keyed, blocks = paired(df, row_id, columns, groups, block_rows, rows, grid)

    def tiles(part: pd.DataFrame) -> list[pd.DataFrame]:
        return [part.iloc[i : i + tile_rows].reset_index(drop=True) for i in range(0, len(part), tile_rows)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        if prepare is not None:
            pdf = prepare(pdf)
        a, b = pdf["_a"].iloc[0], pdf["_b"].iloc[0]
        left = tiles(pdf[pdf["_block"] == a])
        if a == b:
            yield from (kernel(x, y, i == j) for i, x in enumerate(left) for j, y in enumerate(left) if i <= j)
        else:
            right = tiles(pdf[pdf["_block"] == b])
            yield from (kernel(x, y, False) for x in left for y in right)

    if groups:
        return keyed.groupBy(*groups, "_a", "_b").applyInPandas(run, schema)
    return dealt(keyed, blocks).mapInPandas(run, schema)


#: Arrays of a tile's rows, and sums over the other tile's rows for each row of the left and of the right tile.
Prepare = Callable[[pd.DataFrame], tuple[np.ndarray, ...]]
SumKernel = Callable[[Sequence[np.ndarray], Sequence[np.ndarray], bool], tuple[np.ndarray, np.ndarray]]


def block_sums(
    df: DataFrame, row_id: str, columns: Sequence[str], prepare: Prepare, kernel: SumKernel, width: int,
    finish: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str, keep: Sequence[str] | None = None,
    block_rows: int = BLOCK_ROWS, rows: int | None = None, grid: int = GRID, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``finish(rows, sums, times)`` of each block: its rows, for each ``width`` sums over all rows of all blocks, and how
    many rows had its id, whose sums are added.

    A pair of blocks adds its sums tile by tile in one array and sends them once for each of its rows, with the columns
    ``keep``; they are added to each other where the block's rows come together.
    """
    keyed, blocks = paired(df, row_id, columns, (), block_rows, rows, grid)
    names = [row_id, *(columns if keep is None else keep)]
    types = dict(df.dtypes)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        a, b = int(pdf["_a"].iloc[0]), int(pdf["_b"].iloc[0])
        parts = [pdf[pdf["_block"] == n].reset_index(drop=True) for n in ([a] if a == b else [a, b])]
        arrays = [prepare(part) for part in parts]
        sums = [np.zeros((len(part), width)) for part in parts]
        steps = [range(0, len(part), tile_rows) for part in parts]
        for i in steps[0]:
            for j in steps[-1]:
                if a == b and j < i:
                    continue
                one, other = slice(i, i + tile_rows), slice(j, j + tile_rows)
                same = a == b and i == j
                first, second = kernel([v[one] for v in arrays[0]], [v[other] for v in arrays[-1]], same)
                sums[0][one] += first
                if not same:
                    sums[-1][other] += second
        for number, part, total in zip((a, b), parts, sums):
            for at in range(0, len(part), SENT_ROWS):
                yield part[names][at : at + SENT_ROWS].assign(_block=number, _own=a == b, _sums=list(total[at : at + SENT_ROWS]))

    sent = ", ".join([f"`{c}` {types[c]}" for c in names] + ["_block int", "_own boolean", "_sums array<double>"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        places: dict = {}
        total = np.zeros((SENT_ROWS, width))
        for pdf in batches:
            at = np.asarray([places.setdefault(None if pd.isna(v) else v, len(places)) for v in pdf[row_id]], dtype="int64")
            while len(places) > len(total):
                total = np.concatenate([total, np.zeros_like(total)])
            for some in np.split(np.arange(len(at)), range(SENT_ROWS, len(at), SENT_ROWS)):
                np.add.at(total, at[some], np.stack(pdf["_sums"].iloc[some].tolist()) if len(some) else 0.0)
            held.append(pdf.loc[pdf["_own"], names].assign(_at=at[pdf["_own"].to_numpy(dtype=bool)]))
        if places:
            table = pd.concat(held, ignore_index=True)
            times = table.groupby("_at")["_at"].transform("size").to_numpy()
            first = ~table["_at"].duplicated().to_numpy()
            yield finish(table.loc[first, names].reset_index(drop=True), total[table["_at"].to_numpy()[first]], times[first])

    sums = dealt(keyed, blocks).mapInPandas(partial, sent)
    return sums.repartitionById(blocks, F.col("_block")).mapInPandas(whole, schema)


def stack(column: pd.Series) -> np.ndarray:
    return np.asarray(column.tolist(), dtype="float64").reshape(len(column), -1)


#: Part of the squared lengths below which a squared distance is taken from differences.
NEAR = 1e-3


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two matrices: one product, and differences where it would cancel."""
    if not (len(a) and len(b)) or not np.isfinite(a.sum() + b.sum()):
        return plain_distances(a, b)
    middle = a.mean(axis=0)
    x, y = a - middle, b - middle
    m, n = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    # One product gives |x|^2 - 2 x y + |y|^2.
    out = np.column_stack([x, m, np.ones(len(x))]) @ np.column_stack([-2 * y, np.ones(len(y)), n]).T
    near = out <= NEAR * (m.max() + n.max())
    if near.any():
        if near.mean() > 0.02:
            return plain_distances(a, b)
        i, j = np.nonzero(near)
        out[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(out, out=out)


def plain_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += np.subtract.outer(a[:, j], b[:, j]) ** 2
    return np.sqrt(out)
