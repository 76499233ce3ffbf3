"""Views that give the star-schema tables the shape the operators work on.

The expressions are plain SQL that Spark and the checking engine both read, so a view
means the same on either side. Every view covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import rules_from_rows
from ..sources.tables import read_table

_NAME = "concat(p_name, ' ', lpad(cast(l_partkey as string), 6, '0'))"

# A line item is a store: supplier = venue, part = brand, part type and brand = categories.
LISTING = {
    "mall_id": "l_suppkey",
    "brand_id": "l_partkey",
    "name": _NAME,
    "name_raw": (
        f"case when l_linenumber = 7 and l_discount > 0.085 "
        f"then concat(substr({_NAME}, 1, 2), substr({_NAME}, 4)) else {_NAME} end"
    ),
    "category_l1": "p_type",
    "category_l2": "p_brand",
    "category_raw": "concat(p_type, '/', p_brand)",
    "floor": (
        "case when l_returnflag = 'N' then '' else "
        "concat(case when l_linestatus = 'O' then 'L' else 'B' end, cast(l_linenumber % 3 + 1 as string)) end"
    ),
    "rating": "case when l_tax > 0.005 then l_quantity / 10 end",
    "price": "l_extendedprice / 100",
    "observations": "cast(l_linenumber as bigint)",
    "title_score": "l_tax",
    "ocr_confidence": "l_discount",
    "record_id": (
        "concat_ws('/', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), "
        "cast(l_suppkey as string), cast(cast(l_quantity as bigint) as string), "
        "cast(cast(round(l_extendedprice * 100) as bigint) as string))"
    ),
}
LISTING_SQL = (
    "listings AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in LISTING.items())
    + " FROM lineitem JOIN part ON l_partkey = p_partkey)"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf.rstrip('/')}/{name}.parquet")


def listings(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(*[F.expr(e).alias(n) for n, e in LISTING.items()])


def with_listings(body: str) -> str:
    """SQL over the ``listings`` view; ``body`` may add its own CTEs after a leading comma."""
    return f"WITH {LISTING_SQL} {body}"


# Demonstration rules over ``category_raw``; real rule tables are read from CSV files.
MAPPING_ROWS = [
    {"priority": "10", "active": "TRUE", "match_type": "regex", "pattern": "medium/brand#(1|2|3)$", "category_l1": "美食", "category_l2": "火锅"},
    {"priority": "20", "active": "TRUE", "match_type": "regex", "pattern": "medium/brand#1[0-9]$", "category_l1": "美食", "category_l2": "咖啡"},
    {"priority": "20", "active": "TRUE", "match_type": "contains", "pattern": "medium/", "category_l1": "美食", "category_l2": "其它"},
    {"priority": "30", "active": "TRUE", "match_type": "regex", "pattern": "(standard|large)/brand#[0-9]$", "category_l1": "购物", "category_l2": "服饰"},
    {"priority": "30", "active": "TRUE", "match_type": "contains", "pattern": "standard", "category_l1": "购物", "category_l2": "其它"},
    {"priority": "40", "active": "TRUE", "match_type": "exact", "pattern": "LARGE/brand#25", "category_l1": "购物", "category_l2": "奢侈品"},
    {"priority": "45", "active": "FALSE", "match_type": "contains", "pattern": "promo", "category_l1": "购物", "category_l2": "折扣"},
    {"priority": "48", "active": "TRUE", "match_type": "contains", "pattern": "large", "category_l1": "休闲", "category_l2": "电影院"},
    {"priority": "48", "active": "TRUE", "match_type": "regex", "pattern": "^(large|small)", "category_l1": "休闲", "category_l2": "桌游棋牌"},
    {"priority": "", "active": "TRUE", "match_type": "regex", "pattern": "^economy.*[02468]$", "category_l1": "生活", "category_l2": "其它"},
]
EXCLUSION_ROWS = [
    {"priority": "10", "active": "TRUE", "action": "exclude", "field": "name", "match_type": "contains", "pattern": "ring", "reason": "excluded_brand"},
    {"priority": "20", "active": "TRUE", "action": "exclude", "field": "category_raw", "match_type": "exact", "pattern": "promo/brand#7", "reason": "public_facility"},
    {"priority": "21", "active": "TRUE", "action": "exclude", "field": "name", "match_type": "regex", "pattern": "(bolt|gear) 0+1", "reason": "public_facility"},
    {"priority": "22", "active": "TRUE", "action": "exclude", "field": "absent", "match_type": "contains", "pattern": "a", "reason": "never"},
    {"priority": "30", "active": "TRUE", "action": "keep", "field": "floor", "match_type": "exact", "pattern": "b3", "reason": ""},
]
MAPPING = rules_from_rows(MAPPING_ROWS)
EXCLUSIONS = rules_from_rows(EXCLUSION_ROWS)
MAPPING_CASE = """CASE
  WHEN regexp_matches(lower(category_raw), 'medium/brand#(1|2|3)$') THEN '美食|火锅|mapped|medium/brand#(1|2|3)$'
  WHEN regexp_matches(lower(category_raw), 'medium/brand#1[0-9]$') THEN '美食|咖啡|mapped|medium/brand#1[0-9]$'
  WHEN contains(lower(category_raw), 'medium/') THEN '美食|其它|mapped|medium/'
  WHEN regexp_matches(lower(category_raw), '(standard|large)/brand#[0-9]$') THEN '购物|服饰|mapped|(standard|large)/brand#[0-9]$'
  WHEN contains(lower(category_raw), 'standard') THEN '购物|其它|mapped|standard'
  WHEN lower(category_raw) = 'large/brand#25' THEN '购物|奢侈品|mapped|LARGE/brand#25'
  WHEN contains(lower(category_raw), 'large') THEN '休闲|电影院|mapped|large'
  WHEN regexp_matches(lower(category_raw), '^(large|small)') THEN '休闲|桌游棋牌|mapped|^(large|small)'
  WHEN regexp_matches(lower(category_raw), '^economy.*[02468]$') THEN '生活|其它|mapped|^economy.*[02468]$'
  ELSE '未映射|未映射|unmapped|' END"""
EXCLUSION_LIST = """CASE WHEN floor = 'B3' THEN [] ELSE list_sort(list_distinct(list_filter([
  CASE WHEN contains(lower(name), 'ring') THEN 'excluded_brand' END,
  CASE WHEN lower(category_raw) = 'promo/brand#7' THEN 'public_facility' END,
  CASE WHEN regexp_matches(lower(name), '(bolt|gear) 0+1') THEN 'public_facility' END], lambda x: x IS NOT NULL))) END"""
# Result categories the demonstration rules can give, second level.
MAPPED_SQL = (
    "mapped AS (SELECT *, split_part(m, '|', 1) AS m_l1, split_part(m, '|', 2) AS m_l2, "
    f"split_part(m, '|', 3) AS m_status FROM (SELECT *, {MAPPING_CASE} AS m FROM listings))"
)

# Coordinates spread over the study region, one place per supplier.
PLACE = {
    "mall_id": "s_suppkey",
    "longitude": "120.9 + (s_suppkey % 97) * 0.0125",
    "latitude": "30.6 + (s_suppkey % 89) * 0.0137",
    "district": "concat('District ', cast(s_nationkey as string))",
}


def places(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(*[F.expr(e).alias(n) for n, e in PLACE.items()])


PLACE_SQL = "places AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PLACE.items()) + " FROM supplier)"

# Customers and suppliers that traded with each other: as many pairs as line items at most.
TRADED_SQL = "traded AS (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def traded(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the customer and the supplier of each pair."""
    pairs = (
        table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("o_custkey", "l_suppkey").distinct()
    )
    return (
        pairs.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )


# An event is a recognised token on a screen: user group = video, 200 events of all = a frame.
TOKEN = {
    "video": "user_id % 10",
    "frame_index": "cast(floor(event_id / 200) as bigint)",
    "timestamp_sec": "cast(floor(event_id / 200) as double)",
    "event_id": "event_id",
    "text": (
        "case event_type when 'view' then concat('Shop ', cast(cast(get_k as bigint) % 12 as string)) "
        "when 'click' then concat('4.', cast(cast(get_k as bigint) % 10 as string), '分 美食') "
        "when 'error' then '暂无评分 咖啡' "
        "when 'purchase' then concat('￥', cast(cast(get_k as bigint) + 20 as string), '/人 火锅') "
        "else concat('L', cast(cast(get_k as bigint) % 5 + 1 as string)) end"
    ),
    "score": "0.5 + cast(get_k as bigint) / 200.0",
    "x1": "case event_type when 'view' then 240 else 250 + cast(cast(get_k as bigint) % 7 as int) * 60 end",
    "y1": "cast((event_id * 37) % 1400 as int)",
}
TOKEN_SQL = (
    "tokens AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in TOKEN.items())
    + ", x1 + 130 AS x2, y1 + 40 AS y2 FROM (SELECT *, json_extract_string(props, '$.k') AS get_k FROM events))"
)


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("get_k", F.get_json_object("props", "$.k"))
    # The score as a sum of doubles, as the SQL's division gives it; a decimal would break ties of scores another way.
    score = F.lit(0.5) + F.col("get_k").cast("bigint") / F.lit(200.0)
    base = events.select(*[(score if n == "score" else F.expr(e)).alias(n) for n, e in TOKEN.items()])
    return base.withColumn("x2", F.col("x1") + 130).withColumn("y2", F.col("y1") + 40)


def token_structs(df: DataFrame) -> DataFrame:
    token = F.struct("text", F.col("score").cast("double").alias("score"), F.array("x1", "y1", "x2", "y2").alias("box"))
    return df.select("video", "frame_index", "timestamp_sec", "event_id", token.alias("token"))


# Frames for the bucket operators: one per event, sharpness = value.
FRAME = {"video": "event_type", "frame_index": "event_id", "sharpness": "value"}


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(*[F.expr(e).alias(n) for n, e in FRAME.items()])


FRAME_SQL = "frames AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FRAME.items()) + " FROM events)"
