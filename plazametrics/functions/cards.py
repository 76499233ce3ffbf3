"""Field extraction from recognised card text. Every input is NFKC text unless noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

# The marks, words and patterns a listing card is read by.
LETTER_FLOOR = r"LG[1-9]|B[1-9]|L[1-9]|F[1-9]"
DIGIT_FLOOR = r"[1-9][0-9]?F"
FLOOR_MARK = rf"(?:{LETTER_FLOOR}|{DIGIT_FLOOR})(?:层)?"
FLOOR_INSIDE = rf"(?<![A-Z0-9.])({LETTER_FLOOR}|{DIGIT_FLOOR})(?:层)?(?![A-Z0-9.])"
FLOOR_WHOLE = rf"^(?:LG|{LETTER_FLOOR}|{DIGIT_FLOOR})(?:层)?$"
IN_VENUE = "商场内"
UNRATED_MARKS = "暂无评分|暂无星级|暂无评价|暂无点评|尚无评分|尚无评价|未评分"
NEW_STORE = r"^(?:新店|新店开业|即将开业|\d{1,2}(?:[./月]\d{1,2})?新店开业)$"
RATING = r"(?<![\d￥¥])([0-5][.·]\d)(?!\d)"
PRICE = r"[￥¥]\s*(\d+(?:\.\d+)?)\s*/\s*人"
HAN_OR_LATIN = r"[㐀-鿿A-Za-z]"
NAME_EDGE = r"[-—_·,，。;；:：]"
CATEGORY_EDGE = r"[ \-—_·,，。;；:：]"
CATEGORY_SCRUB = (
    r"^[^0-9A-Za-z㐀-鿿]*",
    rf"^(?:{UNRATED_MARKS})\s*",
    rf"(?i)^{FLOOR_MARK}[\s:：|、,，]*",
    r"(?i)^[A-Za-z日口□国0-9._-]{0,10}L?[0-5][.·]\d\s*",
    r"^[0-5]\d(?=[㐀-鿿A-Za-z])",
    r"[￥¥].*$",
    r"\d+(?:\.\d+)?\s*/\s*人.*$",
    rf"(?i)[:：]?{FLOOR_MARK}$",
)
CATEGORY_STOP = "^(?:商场内|店内|附近)$"
CATEGORY_BLOCKED = "点评榜|热门榜|好评榜|休息"
IMPLAUSIBLE_MARKS = r'[“”",，。！!]'
IMPLAUSIBLE_WORDS = (
    "点评|榜第|热门榜|好评榜|销量榜|口味榜|回头客榜|服务|方便|划算|值得|推荐|体验|超赞|好看|好用"
)
TITLE_BLOCKED = (
    "点评榜|点评单|点评清单|优惠|代金券|热门榜|好评榜|销量榜|口味榜|回头客榜|已售|点评.{0,2}[单榜]"
)
STRICT_TITLE_BLOCKED = "点评榜|优惠|代金券|休息|人均|热门榜|好评榜"


def has_name_chars(value: Column) -> Column:
    return value.rlike(HAN_OR_LATIN)


def normalize_name(value: Column, simplify: dict[str, str] | None = None) -> Column:
    """Display name: one middle dot, no blanks, no trailing dots or venue note.

    ``simplify`` maps traditional characters to simplified ones.
    """
    text = value
    if simplify:
        text = F.translate(text, "".join(simplify), "".join(simplify.values()))
    text = F.regexp_replace(text, r"[·•・∙，,、]", "·")
    text = F.regexp_replace(text, r"(?U)\s+", "")
    text = F.regexp_replace(text, r"[….]{2,}$", "")
    text = F.regexp_replace(text, rf"[(（]{IN_VENUE}[)）]$", "")
    return F.regexp_replace(text, f"^{NAME_EDGE}+|{NAME_EDGE}+$", "")


def is_unrated(value: Column) -> Column:
    return squeeze(value).rlike(UNRATED_MARKS)


def is_new_store(value: Column) -> Column:
    return squeeze(value).rlike(NEW_STORE)


def rating(value: Column) -> Column:
    found = F.translate(F.regexp_extract(value, RATING, 1), "·", ".")
    return F.when(value.rlike("已售|折"), "").otherwise(found)


def price(value: Column) -> Column:
    return F.regexp_extract(value, PRICE, 1)


def is_floor_token(value: Column) -> Column:
    return F.upper(squeeze(value)).rlike(FLOOR_WHOLE)


def floor(value: Column) -> Column:
    upper = F.upper(value)
    inside = F.regexp_extract(upper, FLOOR_INSIDE, 1)
    bare = squeeze(upper)
    return (
        F.when(inside != "", inside)
        .when(bare.rlike(FLOOR_WHOLE), F.regexp_replace(bare, "层$", ""))
        .when(F.contains(value, F.lit(IN_VENUE)), IN_VENUE)
        .otherwise("")
    )


def category(value: Column) -> Column:
    text = value
    for pattern in CATEGORY_SCRUB:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, f"^{CATEGORY_EDGE}+|{CATEGORY_EDGE}+$", "")
    rejected = (
        is_floor_token(value)
        | text.rlike(CATEGORY_STOP)
        | ~has_name_chars(text)
        | text.rlike(CATEGORY_BLOCKED)
        | (F.length(text) > 24)
    )
    return F.when(rejected, "").otherwise(text)


def is_plausible_category(value: Column) -> Column:
    return (
        (value != "")
        & (F.length(value) <= 18)
        & ~is_floor_token(value)
        & ~value.rlike(IMPLAUSIBLE_MARKS)
        & ~value.rlike(IMPLAUSIBLE_WORDS)
    )


def _box(token: Column) -> tuple[Column, Column, Column, Column]:
    box = token["box"]
    return box[0], box[1], box[2], box[3]


def is_title(token: Column, width: Column, height: Column) -> Column:
    """Structural title candidate: left column, tall and wide enough, a name and no metadata."""
    text = F.trim(token["text"])
    x1, y1, x2, y2 = _box(token)
    tall = y2 - y1 >= F.greatest(F.lit(24), F.rint(height * 0.015))
    wide = x2 - x1 >= F.greatest(F.lit(45), F.rint(width * 0.05))
    return (
        (x1 / width).between(0.23, 0.36)
        & tall
        & wide
        & (token["score"] >= 0.45)
        & (F.length(normalize_name(text)) >= 2)
        & has_name_chars(text)
        & (rating(text) == "")
        & (price(text) == "")
        & ~is_unrated(text)
        & ~text.rlike("^[“\"'￥¥]")
        & ~((F.length(text) >= 12) & text.rlike(r"[，,、。！!]"))
        & ~text.rlike(TITLE_BLOCKED)
    )


def is_strict_title(token: Column, width: Column) -> Column:
    """Older and narrower title test on absolute pixel sizes."""
    text = F.trim(token["text"])
    x1, y1, x2, y2 = _box(token)
    return (
        (x1 / width).between(0.265, 0.32)
        & (y2 - y1 >= 46)
        & (x2 - x1 >= 70)
        & (token["score"] >= 0.55)
        & (F.length(normalize_name(text)) >= 2)
        & has_name_chars(text)
        & ~text.rlike(r"^[★☆*\d.￥¥折元\s]+$")
        & ~text.rlike(STRICT_TITLE_BLOCKED)
    )


def is_new_store_badge(token: Column, title: Column, width: Column, height: Column) -> Column:
    x1, y1, _, y2 = _box(token)
    tx1, ty1, _, ty2 = _box(title)
    middle, title_middle = (y1 + y2) / 2, (ty1 + ty2) / 2
    reach = F.greatest(F.lit(80), F.rint(height * 0.06))
    return (
        is_new_store(token["text"])
        & middle.between(ty1 - 4, title_middle + reach)
        & x1.between(tx1 - 25, tx1 + width * 0.20)
    )


def observation_quality(o: Column) -> Column:
    """Additive evidence score of one observation struct."""
    name = o["merchant_name_raw"]
    bonus = [
        (o["category_raw"] != "", 0.12),
        (o["floor_location"] != "", 0.07),
        (o["rating"] != "", 0.05),
        (o["detection_method"] == "rating_anchor", 0.04),
        (o["card_type"].isin("new_store", "unrated"), 0.04),
        (name.rlike(r"\.\.\.|…"), -0.12),
    ]
    total = o["ocr_confidence"] + F.least(F.length(name), F.lit(24)) * 0.003
    for condition, value in bonus:
        total = total + F.when(condition, value).otherwise(0.0)
    return total


def card_type(counts: Column) -> Column:
    """Resolved type of an entity from its ``map<card_type, count>``, by precedence."""
    def seen(kind: str) -> Column:
        return F.coalesce(F.try_element_at(counts, F.lit(kind)), F.lit(0)) > 0
    return (
        F.when(seen("new_store"), "new_store")
        .when(seen("rated"), "rated")
        .when(seen("unrated"), "unrated")
        .otherwise("unknown")
    )


def exclusion_reason(kind: Column) -> Column:
    return F.when(kind == "new_store", "new_store").when(kind == "unrated", "explicitly_unrated").otherwise("")


def review_reasons(best: Column, observations: Column, kind: Column) -> Column:
    """Ordered list of reasons to look at a card again; empty when it is not researched."""
    listed = F.array_compact(
        F.array(
            F.when(observations == 1, F.lit("single_observation")),
            F.when(best["rating_status"] == "unrated", F.lit("unrated")).when(
                best["rating_status"] != "rated", F.lit("rating_missing")
            ),
            F.when(best["category_raw"] == "", F.lit("category_missing")),
            F.when(best["detection_method"] != "rating_anchor", best["detection_method"]),
            F.when(best["merchant_name_raw"].rlike(r"\.\.\.|…"), F.lit("name_truncated")),
            F.when(best["title_score"] < 0.80, F.lit("low_title_confidence")),
        )
    )
    none = F.array().cast("array<string>")
    return F.when(exclusion_reason(kind) != "", none).otherwise(listed)


def review_status(reasons: Column, kind: Column) -> Column:
    # Excluded from research, review advised, structurally complete.
    return (
        F.when(exclusion_reason(kind) != "", "研究排除")
        .when(F.size(reasons) > 0, "建议复核")
        .otherwise("结构完整")
    )
