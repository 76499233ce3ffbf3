"""String functions, ``Column -> Column``.

Only Unicode NFKC has no built-in counterpart and runs as an Arrow UDF; everything
else stays in the JVM so that it can be code-generated and pushed around by Catalyst.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label of an unclassified item, floor forms, category noise.
UNMAPPED = "未映射"
FLOOR_FORM = r"B\d+|LG\d+|L\d+|F\d+|\d+F"
CATEGORY_NOISE = rf"(?iu)^(?:{FLOOR_FORM}|\d+/(?:{FLOOR_FORM}|商场内)|月|\.*)$"


@F.pandas_udf(T.StringType())
def _normalized(values: pd.Series) -> pd.Series:
    out = values.astype(object)
    some = out.notna()
    out[some] = [unicodedata.normalize("NFKC", v) for v in out[some]]
    return out


def nfkc(value: Column | str) -> Column:
    """NFKC form; ASCII texts are their own form, so that only others (more bytes than characters) go to Python."""
    text = F.col(value) if isinstance(value, str) else value
    return F.coalesce(_normalized(F.when(F.octet_length(text) > F.length(text), text)), text)


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def clean(value: Column) -> Column:
    """Missing becomes an empty string, then NFKC and a Unicode-aware trim."""
    return strip(nfkc(F.coalesce(value, F.lit(""))))


def squeeze(value: Column) -> Column:
    """Drop every whitespace character (input already NFKC)."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", "")


def compact(value: Column) -> Column:
    return squeeze(clean(value))


def brand_key(value: Column) -> Column:
    """Letters and digits only, lower case (input already NFKC)."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]", "")


def stable_id(prefix: str, value: Column, length: int = 12) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha1(value), 1, length)))


def capture_date(folder: Column) -> Column:
    """``city__venue__YYYYMMDD`` -> ``YYYY-MM-DD``; empty when the suffix is missing."""
    parts = [F.regexp_extract(folder, r"__(\d{4})(\d{2})(\d{2})$", i) for i in (1, 2, 3)]
    return F.when(parts[0] == "", "").otherwise(F.concat_ws("-", *parts))


def normalize_floor(value: Column) -> Column:
    """A floor mark such as ``B1``, ``LG2``, ``L3`` or ``4F``; anything else is unknown."""
    mark = F.upper(squeeze(value))
    return F.when(mark.rlike(f"^(?:{FLOOR_FORM})$"), mark).otherwise("")


def has_exact_token(metadata: Column, accepted: Iterable[str]) -> Column:
    """True if one of the ``|``-separated tokens equals an accepted token."""
    tokens = F.transform(F.split(nfkc(F.coalesce(metadata, F.lit(""))), r"\|"), squeeze)
    return F.arrays_overlap(tokens, F.array(*[F.lit(a) for a in accepted]))


def is_category_noise(value: Column) -> Column:
    token = squeeze(value)
    return (token == "") | token.rlike(CATEGORY_NOISE)


def protected_difference(a: Column, b: Column, terms: Iterable[str]) -> Column:
    """A protected term stands in exactly one of the two names."""
    result = F.lit(False)
    for term in terms:
        result = result | (F.contains(a, F.lit(term)) != F.contains(b, F.lit(term)))
    return result


def within_edits(a: Column, b: Column, limit: int) -> Column:
    """Edit distance is at most ``limit`` (the built-in gives -1 beyond it)."""
    return F.levenshtein(a, b, limit) >= 0


def first_useful(*values: Column) -> Column:
    """First value that is not missing, blank, ``[]`` or ``null``."""
    usable = [F.when((v != "") & ~F.trim(v).isin("[]", "null"), v) for v in values]
    return F.coalesce(*usable, F.lit(""))


def contains_ci(value: Column, needle: str | Column) -> Column:
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(value), F.lower(needle))


def csv_guard(value: Column) -> Column:
    """Quote texts a spreadsheet would run as a formula."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def portable_path(value: Column, roots: dict[str, str]) -> Column:
    """Forward slashes; the part up to a known root marker becomes that root's prefix."""
    path = F.translate(value, "\\", "/")
    result = path
    for marker, prefix in reversed(list(roots.items())):
        at = F.instr(path, F.lit(marker))
        tail = F.substring(path, at + len(marker), F.length(path))
        result = F.when(at > 0, F.concat(F.lit(prefix), tail)).otherwise(result)
    return result
