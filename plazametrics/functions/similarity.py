"""InDel similarity, the one string measure Spark has no built-in for."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that are laid out side by side at a time.
CELLS = 1 << 21


@lru_cache(1 << 16)
def indel_ratio_text(a: str, b: str) -> float:
    """``200 * LCS / (len(a) + len(b))``; the LCS row lives in the bits of one integer."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, char in enumerate(a):
        places[char] = places.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hit = row & places.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _laid_out(texts: list[str], lengths: np.ndarray, width: int, fill: int) -> np.ndarray:
    """Code points of the texts, one row each, filled up to ``width``."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full((len(texts), width), fill, np.uint32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _common(short: list[str], long: list[str], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each pair; the short texts have 64 characters at most."""
    bits = 8 * max(1, -(-int(n.max()) // 8))
    bits = next(b for b in (8, 16, 32, 64) if b >= bits)
    kind = np.dtype(f"uint{bits}")
    a, b = _laid_out(short, n, bits, 0xFFFFFFFF), _laid_out(long, m, int(m.max()), 0xFFFFFFFE)
    row = np.full(len(short), np.iinfo(kind).max, kind)
    for j in range(b.shape[1]):
        places = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view(kind)[:, 0]
        hit = row & places
        row = (row + hit) | (row - hit)
    # Bits beyond the text are never cleared.
    return bits - np.bitwise_count(row).astype(np.int64)


def indel_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """:func:`indel_ratio_text` of many pairs at once; pairs of equal length share their steps."""
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    total, shorter = n + m, np.minimum(n, m)
    out = np.full(len(left), 100.0)
    for i in np.flatnonzero(shorter > 64).tolist():
        out[i] = indel_ratio_text(left[i], right[i])
    out[(shorter == 0) & (total > 0)] = 0.0
    fits = np.flatnonzero((shorter > 0) & (shorter <= 64))
    order = fits[np.lexsort((shorter[fits], (total - shorter)[fits]))]
    at = 0
    while at < len(order):
        # The longest text of a step decides its width.
        to = at + 1
        step = max(1, CELLS // max(64, int((total - shorter)[order[at]]) * 2))
        to = min(len(order), at + step)
        while to > at + 1 and (total - shorter)[order[to - 1]] > 2 * (total - shorter)[order[at]] + 64:
            to = at + (to - at) // 2
        some = order[at:to].tolist()
        swap = [len(left[i]) > len(right[i]) for i in some]
        a = [right[i] if s else left[i] for i, s in zip(some, swap)]
        b = [left[i] if s else right[i] for i, s in zip(some, swap)]
        out[some] = 200.0 * _common(a, b, shorter[some], (total - shorter)[some]) / total[some]
        at = to
    return out


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of two texts; null counts as empty."""
    return pd.Series(indel_ratios(a.fillna("").tolist(), b.fillna("").tolist()))


LIKENESS = T.StructType([T.StructField("name", T.DoubleType()), T.StructField("category", T.DoubleType())])


@F.pandas_udf(LIKENESS)
def _likeness(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    names, kinds = np.full(len(a), np.nan), np.full(len(a), np.nan)
    asked = np.flatnonzero(a.notna().to_numpy())
    names[asked] = indel_ratios(a.iloc[asked].tolist(), b.iloc[asked].tolist())
    near = asked[names[asked] >= 75]
    kinds[near] = indel_ratios(c.iloc[near].tolist(), d.iloc[near].tolist())
    return pd.DataFrame({"name": names, "category": kinds})


def likeness_where(needed: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Ratios of two names and, where these reach 75, of two categories, in one pass; nothing is computed elsewhere."""
    return _likeness(*[F.when(needed, x) for x in (a, b, c, d)])
