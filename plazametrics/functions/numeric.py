"""Lenient parsing, guarded arithmetic and small numeric formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_bool(value: Column) -> Column:
    """Text truth: 1, true, yes or y in any case."""
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("1", "true", "yes", "y")


def number(value: Column, default: float | None = 0.0) -> Column:
    parsed = value.try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def whole_number(value: Column, default: int = 0) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(default))


def ratio(part: Column, total: Column) -> Column:
    """``part / total``, and 0 where there is nothing to divide by."""
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def round_exact(value: Column, digits: int) -> Column:
    """Round by the binary value, ties to even, instead of by its shortest decimal text."""
    scale = 10.0**digits
    return F.rint(value * scale) / scale


def information(p: Column) -> Column:
    """One term of Shannon entropy in nats."""
    return F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))


def marker_diameter(count: Column, smallest: Column) -> Column:
    return F.round(10 * F.sqrt(count / smallest)).cast("int")


def remaining_share(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - a - b)


def composition_color(shares: list[Column]) -> Column:
    """CSS colour whose channels are the shares relative to the largest one."""
    peak = F.greatest(*shares)
    channels = [F.round(220 * s / peak).cast("int").cast("string") for s in shares]
    return F.concat(F.lit("rgb("), F.concat_ws(",", *channels), F.lit(")"))


def percent(value: Column) -> Column:
    """Percentage with one decimal, rounded by the binary value with ties to even, as C's ``%.1f`` does.

    Twenty times the value is kept as a double and its rounding error, which together are exact.
    """
    scaled = value * 100
    twenty = scaled * 16 + scaled * 4
    error = scaled * 4 - (twenty - scaled * 16)
    tenths = F.floor(twenty / 2)
    rest = twenty - tenths * 2
    up = (rest > 1) | ((rest == 1) & ((error > 0) | ((error == 0) & (tenths % 2 != 0))))
    return F.concat(F.format_string("%.1f", (tenths + up.cast("int")) / 10), F.lit("%"))
