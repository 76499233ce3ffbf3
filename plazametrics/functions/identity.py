"""Brand identities of growing tolerance, and venue-name comparison."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import brand_key

# Store-type suffixes.
STORE_SUFFIXES = (
    "专卖店|专柜|旗舰店|体验店|授权体验店|官方授权体验店|服务体验中心|指定店"
    "|时尚店|传承|女装店|男装店|集合店|概念店|臻选|店"
)
# City prefix, district form and trailing place words of a venue name.
CITY = "上海"
HAN = r"[一-鿿]"
PLACE_TAIL = r"(出入口|[东南西北]?\d*门|[A-Z]区|停车场|购物中心|商场|广场)$"


def strict(brand_id: Column, name: Column) -> Column:
    return brand_id.cast("string")


def _latin(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^A-Za-z0-9]", ""))


def latin_core(brand_id: Column, name: Column) -> Column:
    core = _latin(name)
    return F.when(F.length(core) >= 4, F.concat(F.lit("LAT:"), core)).otherwise(brand_id.cast("string"))


def strip_suffix(brand_id: Column, name: Column, suffixes: str = STORE_SUFFIXES) -> Column:
    bare = F.regexp_replace(F.regexp_replace(name, r"[（(].*?[）)]", ""), f"({suffixes})$", "")
    core, key = _latin(bare), brand_key(bare)
    return (
        F.when(F.length(core) >= 4, F.concat(F.lit("LAT:"), core))
        .when(key != "", F.concat(F.lit("K:"), key))
        .otherwise(brand_id.cast("string"))
    )


IDENTITIES: dict[str, Callable[[Column, Column], Column]] = {
    "strict_current": strict,
    "latin_core_merged": latin_core,
    "strip_suffix_merged": strip_suffix,
}


def venue_match_key(name: Column, city: str = CITY) -> Column:
    """Hoist ``(city X店)``, drop brackets, city, district and trailing place words."""
    text = F.regexp_replace(name, rf"^(.*?)[（(]{city}({HAN}{{2,3}})[店馆][）)]", "$2$1")
    text = F.regexp_replace(text, r"[（(].*?[）)]", "")
    text = F.regexp_replace(text, f"^{city}市?", "")
    text = F.regexp_replace(text, rf"({city}市)?{HAN}{{2,3}}区", "")
    # Without a bracket, the city or a district word only the last step can change a name.
    plain = ~(F.contains(name, F.lit("（")) | F.contains(name, F.lit("(")) | F.contains(name, F.lit(city)) | F.contains(name, F.lit("区")))
    return brand_key(F.when(plain, F.regexp_replace(name, PLACE_TAIL, "")).otherwise(F.regexp_replace(text, PLACE_TAIL, "")))


def name_quality(a: str | None, b: str | None) -> int:
    """3 equal, 2 contained (3+ characters), 1 ordered coverage of 90 % (4+), else 0; a missing name counts as empty.

    Coverage is the share of the shorter name's characters found in the longer one left to right, greedily.
    """
    if not a or not b:
        return 0
    if a == b:
        return 3
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 2 if len(short) >= 3 else 0
    if len(short) < 4:
        return 0
    at, left = 0, len(short)
    for char in short:
        found = long.find(char, at)
        if found >= 0:
            at = found + 1
            continue
        left -= 1
        # What is left can reach no higher share.
        if left / len(short) < 0.9:
            return 0
    return 1


@F.pandas_udf(T.IntegerType())
def match_quality(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`name_quality` of two names. Each text is computed once a row; as an expression it was, in every branch and step."""
    return pd.Series([name_quality(x, y) for x, y in zip(a.tolist(), b.tolist())], dtype="int32")
