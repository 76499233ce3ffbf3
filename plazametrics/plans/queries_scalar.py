"""Scalar operators over whole text columns: strings, identities, parsing, geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cards as cd
from ..functions import geo, identity, numeric
from ..functions import text as tx
from ..functions.similarity import indel_ratio
from ..sources.tables import missing_to_null, with_lineage
from ..session import shared_folder
from ..sources.rest import venue_records
from ..sources.sinks import file_digests, flat, read_ordered, script_payload, write_ordered
from .bindings import LISTING_SQL, PLACE_SQL, TOKEN_SQL, TRADED_SQL, listings, places, table, tokens, traded, with_listings
from .registry import query


@query("str1_clean_text", "SELECT doc_id, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS cleaned FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query("str2_compact_token", "SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS compacted FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.squeeze(F.col("text")).alias("compacted"))


@query("str3_brand_key", "SELECT page_id, regexp_replace(lower(html), '[^\\p{L}\\p{N}]', '', 'g') AS brand_key FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.brand_key(F.col("html")).alias("brand_key"))


@query("str4_stable_id", """SELECT doc_id, 'DOC-' || upper(substr(sha1(text), 1, 12)) AS text_id,
  'MALL-' || upper(substr(sha1(source), 1, 10)) AS source_id FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.stable_id("DOC", F.col("text")).alias("text_id"),
        tx.stable_id("MALL", F.col("source"), 10).alias("source_id"),
    )


_FOLDER = "case when o_orderstatus = 'P' then o_orderpriority else concat(o_orderpriority, '__', o_orderstatus, '__', replace(cast(cast(o_orderdate as date) as string), '-', '')) end"


@query("str5_capture_date", f"""SELECT o_orderkey, o_custkey, folder, CASE WHEN regexp_matches(folder, '__\\d{{8}}$')
  THEN concat(substr(right(folder, 8), 1, 4), '-', substr(right(folder, 8), 5, 2), '-', substr(right(folder, 8), 7, 2))
  ELSE '' END AS capture_date FROM (SELECT *, {_FOLDER} AS folder FROM orders)""")
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumn("folder", F.expr(_FOLDER))
    return orders.select("o_orderkey", "o_custkey", "folder", tx.capture_date(F.col("folder")).alias("capture_date"))


_MARK = "concat(case l_linenumber when 1 then ' b' when 2 then 'Lg ' when 3 then 'l' when 4 then 'f' when 5 then '' else 'x' end, cast(l_suppkey as string), case when l_linenumber = 5 then 'f ' else '' end)"


@query("str6_normalize_floor", f"""SELECT mark, floor, count(*) AS n FROM (SELECT mark, CASE WHEN
  regexp_full_match(upper(regexp_replace(mark, '\\s+', '', 'g')), 'B\\d+|LG\\d+|L\\d+|F\\d+|\\d+F')
  THEN upper(regexp_replace(mark, '\\s+', '', 'g')) ELSE '' END AS floor FROM (SELECT {_MARK} AS mark FROM lineitem)) GROUP BY ALL""")
def _(spark, sf):
    marks = table(spark, sf, "lineitem").select(F.expr(_MARK).alias("mark"))
    return marks.withColumn("floor", tx.normalize_floor(F.col("mark"))).groupBy("mark", "floor").agg(F.count("*").alias("n"))


_META = "concat(p_type, ' | ', case when p_size < 10 then ' 新 店' when p_size < 20 then '新店开业' else 'New' end, '|', p_name)"


@query("str7_exact_token", f"""SELECT p_partkey, list_contains(list_transform(string_split(m, '|'),
  lambda x: regexp_replace(x, '\\s+', '', 'g')), '新店') AS is_new_store FROM (SELECT *, {_META} AS m FROM part)""")
def _(spark, sf):
    parts = table(spark, sf, "part").withColumn("m", F.expr(_META))
    return parts.select("p_partkey", tx.has_exact_token(F.col("m"), ["新店"]).alias("is_new_store"))


@query("str8_rule_matches", """SELECT doc_id, lower(source) = 'src3' AS exact_hit, contains(lower(text), 'tion') AS contains_hit,
  regexp_matches(text, '(?i)\\bth[aeiou]+\\b') AS regex_hit FROM documents""")
def _(spark, sf):
    from ..functions.text import nfkc
    from ..operators.rules import matches

    # Every third source is spelled in full-width letters, and so is the pattern.
    wide = F.when(F.col("doc_id") % 3 == 0, F.translate("source", "src0123456789", "ｓｒｃ０１２３４５６７８９")).otherwise(F.col("source"))
    return table(spark, sf, "documents").select(
        "doc_id", matches(nfkc(wide), "exact", "ＳＲＣ3").alias("exact_hit"),
        matches(nfkc("text"), "contains", "TION").alias("contains_hit"),
        matches(nfkc("text"), "regex", r"\bTH[aeiou]+\b").alias("regex_hit"),
    )


_NOISE = "case event_type when 'view' then concat('L', cast(user_id as string)) when 'click' then concat('3/b', cast(user_id as string)) when 'error' then '..' when 'signup' then '月' else concat('咖啡', cast(user_id as string)) end"


@query("str9_category_noise", f"""SELECT event_id, (raw = '' OR regexp_full_match(raw,
  '(?i)(B\\d+|LG\\d+|L\\d+|F\\d+|\\d+F|\\d+/(B\\d+|LG\\d+|L\\d+|F\\d+|\\d+F|商场内)|月|\\.*)')) AS is_noise
  FROM (SELECT event_id, {_NOISE} AS raw FROM events)""")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.is_category_noise(F.expr(_NOISE)).alias("is_noise"))


@query("str10_levenshtein", f"""WITH {TRADED_SQL} SELECT c_custkey, s_suppkey, levenshtein(c_name, s_name) AS distance FROM traded JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE levenshtein(c_name, s_name) <= 8""")
def _(spark, sf):
    pairs = traded(spark, sf)
    near = pairs.where(tx.within_edits(F.col("c_name"), F.col("s_name"), 8))
    return near.select("c_custkey", "s_suppkey", F.levenshtein("c_name", "s_name").alias("distance"))


@query("str11_protected_difference", """SELECT p_partkey, (contains(p_name, 'red') <> contains(p_type, 'red'))
  OR (contains(p_name, 'ring') <> contains(p_type, 'ring')) AS protected FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", tx.protected_difference(F.col("p_name"), F.col("p_type"), ["red", "ring"]).alias("protected")
    )


@query("str12_ocr_normalize_name", """SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '[·•・∙，,、]', '·', 'g'), '\\s+', '', 'g'), '[….]{2,}$', ''), '[(（]商场内[)）]$', ''),
  '^[-—_·,，。;；:：]+|[-—_·,，。;；:：]+$', '', 'g') AS name FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", cd.normalize_name(tx.clean(F.col("text"))).alias("name")
    )


@query("str13_name_chars", "SELECT doc_id, regexp_matches(text, '[\\x{3400}-\\x{9fff}A-Za-z]') AS has_name FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cd.has_name_chars(F.col("text")).alias("has_name"))


@query("str14_extract_rating", f"""WITH {TOKEN_SQL} SELECT event_id, CASE WHEN regexp_matches(text, '已售|折') THEN '' ELSE
  replace(regexp_extract(text, '(?:^|[^\\d￥¥])([0-5][.·]\\d)(?:[^\\d]|$)', 1), '·', '.') END AS rating FROM tokens""")
def _(spark, sf):
    return tokens(spark, sf).select("event_id", cd.rating(F.col("text")).alias("rating"))


@query("str15_extract_price", f"""WITH {TOKEN_SQL} SELECT event_id,
  regexp_extract(text, '[￥¥]\\s*(\\d+(?:\\.\\d+)?)\\s*/\\s*人', 1) AS price FROM tokens""")
def _(spark, sf):
    return tokens(spark, sf).select("event_id", cd.price(F.col("text")).alias("price"))


@query("str16_extract_floor", f"""WITH {TOKEN_SQL}, found AS (SELECT *, regexp_extract(upper(text),
  '(?:^|[^A-Z0-9.])(LG[1-9]|B[1-9]|L[1-9]|F[1-9]|[1-9][0-9]?F)(?:层)?(?:[^A-Z0-9.]|$)', 1) AS f FROM tokens)
  SELECT event_id, CASE WHEN f <> '' THEN f WHEN regexp_full_match(upper(text), 'LG层?') THEN 'LG'
  WHEN contains(text, '商场内') THEN '商场内' ELSE '' END AS floor FROM found""")
def _(spark, sf):
    return tokens(spark, sf).select("event_id", cd.floor(F.col("text")).alias("floor"))


@query("str17_pure_floor", f"""WITH {TOKEN_SQL} SELECT event_id, regexp_full_match(upper(regexp_replace(text, '\\s+', '', 'g')),
  '(LG|LG[1-9]|B[1-9]|L[1-9]|F[1-9]|[1-9][0-9]?F)(层)?') AS is_floor FROM tokens""")
def _(spark, sf):
    return tokens(spark, sf).select("event_id", cd.is_floor_token(F.col("text")).alias("is_floor"))


_FLOOR = "(?:LG[1-9]|B[1-9]|L[1-9]|F[1-9]|[1-9][0-9]?F)(?:层)?"


def _category_sql() -> str:
    value = "text"
    for pattern, to in (
        ("^[^0-9A-Za-z\\x{3400}-\\x{9fff}]*", ""),
        ("^(?:暂无评分|暂无星级|暂无评价|暂无点评|尚无评分|尚无评价|未评分)\\s*", ""),
        (f"(?i)^{_FLOOR}[\\s:：|、,，]*", ""),
        ("(?i)^[A-Za-z日口□国0-9._-]{0,10}L?[0-5][.·]\\d\\s*", ""),
        ("^[0-5]\\d([\\x{3400}-\\x{9fff}A-Za-z])", "\\1"),
        ("[￥¥].*$", ""),
        ("\\d+(?:\\.\\d+)?\\s*/\\s*人.*$", ""),
        (f"(?i)[:：]?{_FLOOR}$", ""),
        ("^[ \\-—_·,，。;；:：]+|[ \\-—_·,，。;；:：]+$", ""),
    ):
        value = f"regexp_replace({value}, '{pattern}', '{to}', 'g')"
    return f"""WITH {TOKEN_SQL}, scrubbed AS (SELECT *, {value} AS v FROM tokens) SELECT event_id, CASE
      WHEN regexp_full_match(upper(text), '(LG|LG[1-9]|B[1-9]|L[1-9]|F[1-9]|[1-9][0-9]?F)(层)?') OR v IN ('商场内', '店内', '附近')
      OR NOT regexp_matches(v, '[\\x{{3400}}-\\x{{9fff}}A-Za-z]') OR regexp_matches(v, '点评榜|热门榜|好评榜|休息')
      OR length(v) > 24 THEN '' ELSE v END AS category FROM scrubbed"""


@query("str18_extract_category", _category_sql())
def _(spark, sf):
    return tokens(spark, sf).select("event_id", cd.category(F.col("text")).alias("category"))


@query("str19_plausible_category", f"""WITH {TOKEN_SQL} SELECT event_id, length(text) BETWEEN 1 AND 18
  AND NOT regexp_full_match(upper(text), '(LG|LG[1-9]|B[1-9]|L[1-9]|F[1-9]|[1-9][0-9]?F)(层)?')
  AND NOT regexp_matches(text, '[“”",，。！!]')
  AND NOT regexp_matches(text, '点评|榜第|热门榜|好评榜|销量榜|口味榜|回头客榜|服务|方便|划算|值得|推荐|体验|超赞|好看|好用') AS plausible
  FROM tokens""")
def _(spark, sf):
    return tokens(spark, sf).select("event_id", cd.is_plausible_category(F.col("text")).alias("plausible"))


@query("str20_unrated_and_new_store", f"""WITH {TOKEN_SQL} SELECT event_id,
  regexp_matches(regexp_replace(text, '\\s+', '', 'g'), '暂无评分|暂无星级|暂无评价|暂无点评|尚无评分|尚无评价|未评分') AS unrated,
  regexp_replace(text, '\\s+', '', 'g') IN ('新店', '新店开业', '即将开业')
  OR regexp_full_match(regexp_replace(text, '\\s+', '', 'g'), '\\d{{1,2}}([./月]\\d{{1,2}})?新店开业') AS new_store FROM tokens""")
def _(spark, sf):
    return tokens(spark, sf).select(
        "event_id", cd.is_unrated(F.col("text")).alias("unrated"), cd.is_new_store(F.col("text")).alias("new_store")
    )


_BLANKED = "case when o_orderstatus = 'P' then '[]' when o_orderstatus = 'O' then '' else o_orderpriority end"


@query("str21_first_useful", f"""SELECT o_orderkey, o_custkey, CASE WHEN v NOT IN ('', '[]', 'null') THEN v
  ELSE o_orderstatus END AS useful FROM (SELECT *, {_BLANKED} AS v FROM orders)""")
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumn("v", F.expr(_BLANKED))
    return orders.select("o_orderkey", "o_custkey", tx.first_useful(F.col("v"), F.col("o_orderstatus")).alias("useful"))


_BRANDED = "concat(p_name, case when p_size < 15 then '旗舰店' when p_size < 25 then '（二层）体验店' else '' end)"


@query("str22_24_brand_identities", f"""SELECT p_partkey, cast(p_partkey AS varchar) AS strict,
  CASE WHEN length(lat) >= 4 THEN 'LAT:' || lat ELSE cast(p_partkey AS varchar) END AS latin_core,
  CASE WHEN length(blat) >= 4 THEN 'LAT:' || blat WHEN bkey <> '' THEN 'K:' || bkey ELSE cast(p_partkey AS varchar) END AS strip_suffix
  FROM (SELECT *, lower(regexp_replace(n, '[^A-Za-z0-9]', '', 'g')) AS lat, lower(regexp_replace(b, '[^A-Za-z0-9]', '', 'g')) AS blat,
    regexp_replace(lower(b), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS bkey FROM (SELECT *, regexp_replace(regexp_replace(n, '[（(].*?[）)]', '', 'g'),
    '(专卖店|专柜|旗舰店|体验店|授权体验店|官方授权体验店|服务体验中心|指定店|时尚店|传承|女装店|男装店|集合店|概念店|臻选|店)$', '', 'g') AS b
    FROM (SELECT p_partkey, {_BRANDED} AS n FROM part)))""")
def _(spark, sf):
    parts = table(spark, sf, "part").withColumn("n", F.expr(_BRANDED))
    pid, name = F.col("p_partkey"), F.col("n")
    return parts.select(
        pid, identity.strict(pid, name).alias("strict"), identity.latin_core(pid, name).alias("latin_core"),
        identity.strip_suffix(pid, name).alias("strip_suffix"),
    )


_VENUE = "concat(case when s_nationkey < 8 then '上海市' else '' end, '浦东区', s_name, case when s_nationkey > 15 then '(上海崇明店)' else '购物中心' end)"


@query("str25_venue_match_key", f"""SELECT s_suppkey, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(n, '^(.*?)[（(]上海([一-鿿]{{2,3}})[店馆][）)]', '\\2\\1'), '[（(].*?[）)]', '', 'g'), '^上海市?', ''),
  '(上海市)?[一-鿿]{{2,3}}区', '', 'g'), '(出入口|[东南西北]?\\d*门|[A-Z]区|停车场|购物中心|商场|广场)$', '')),
  '[^\\p{{L}}\\p{{N}}]', '', 'g') AS match_key FROM (SELECT *, {_VENUE} AS n FROM supplier)""")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", identity.venue_match_key(F.expr(_VENUE)).alias("match_key"))


@query("str26_match_quality")
def _(spark, sf):
    return traded(spark, sf).select("s_suppkey", "c_custkey", identity.match_quality(F.lower("s_name"), F.lower("c_name")).alias("quality"))


@query("str27_indel_ratio")
def _(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return turns.join(following, ["conv_id", "turn"]).select("conv_id", "turn", F.round(indel_ratio("a", "b"), 6).alias("ratio"))


@query("str28_case_insensitive_search", "SELECT page_id, url FROM pages WHERE contains(lower(html), 'tion')")
def _(spark, sf):
    return table(spark, sf, "pages").where(tx.contains_ci(F.col("html"), "TION")).select("page_id", "url")


_TEXTUAL = "case when l_tax < 0.015 then '' when l_tax < 0.025 then 'n/a' else cast(l_linenumber as string) end"


@query("str29_num1_lenient_parsing", f"""SELECT v, flag, parsed, as_int, truth, count(*) AS n FROM (SELECT v, flag,
  coalesce(try_cast(v AS double), 0.0) AS parsed, coalesce(try_cast(v AS int), 0) AS as_int,
  lower(trim(flag)) IN ('1', 'true', 'yes', 'y') AS truth FROM (SELECT {_TEXTUAL} AS v,
  case l_returnflag when 'A' then ' TRUE' when 'N' then 'Y' else 'no' end AS flag FROM lineitem)) GROUP BY ALL""")
def _(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.expr(_TEXTUAL).alias("v"), F.expr("case l_returnflag when 'A' then ' TRUE' when 'N' then 'Y' else 'no' end").alias("flag")
    )
    parsed = raw.select(
        "v", "flag", numeric.number(F.col("v")).alias("parsed"), numeric.whole_number(F.col("v")).alias("as_int"),
        numeric.as_bool(F.col("flag")).alias("truth"),
    )
    return parsed.groupBy("v", "flag", "parsed", "as_int", "truth").agg(F.count("*").alias("n"))


@query("num2_num3_rounded_ratio", """SELECT s_suppkey, round(CASE WHEN n > 0 THEN late / cast(n AS double) ELSE 0 END, 6) AS late_ratio
  FROM (SELECT s_suppkey, count(l_suppkey) AS n, count(*) FILTER (l_returnflag = 'R') AS late
  FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey)""")
def _(spark, sf):
    counted = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("late")
    )
    joined = table(spark, sf, "supplier").join(counted, F.col("s_suppkey") == F.col("l_suppkey"), "left").na.fill(0)
    return joined.select("s_suppkey", F.round(numeric.ratio(F.col("late"), F.col("n")), 6).alias("late_ratio"))


@query("num4_entropy_terms", """SELECT event_type, round(-p * ln(p), 6) AS term FROM (SELECT event_type,
  count(*) / cast((SELECT count(*) FROM events) AS double) AS p FROM events GROUP BY event_type)""")
def _(spark, sf):
    events = table(spark, sf, "events")
    counted = events.groupBy("event_type").agg(F.count("*").alias("n"))
    p = F.col("n") / events.select(F.count("*")).scalar()
    return counted.select("event_type", F.round(numeric.information(p), 6).alias("term"))


@query("num5_planar_distance", f"""WITH {PLACE_SQL} SELECT mall_id, round(sqrt(power((longitude - 121.4737) * 111.32 * cos(radians(latitude)), 2)
  + power((latitude - 31.2304) * 110.57, 2)), 6) AS km FROM places""")
def _(spark, sf):
    return places(spark, sf).select("mall_id", F.round(geo.planar_km(F.col("longitude"), F.col("latitude")), 6).alias("km"))


def _gcj_sql(lon: str, lat: str) -> tuple[str, str]:
    x, y = f"({lon} - 105.0)", f"({lat} - 35.0)"
    shared = f"(20.0 * sin(6.0 * {x} * pi()) + 20.0 * sin(2.0 * {x} * pi())) * 2.0 / 3.0"
    dlat = (
        f"(-100.0 + 2.0 * {x} + 3.0 * {y} + 0.2 * {y} * {y} + 0.1 * {x} * {y} + 0.2 * sqrt(abs({x})) + {shared}"
        f" + (20.0 * sin({y} * pi()) + 40.0 * sin({y} / 3.0 * pi())) * 2.0 / 3.0"
        f" + (160.0 * sin({y} / 12.0 * pi()) + 320.0 * sin({y} * pi() / 30.0)) * 2.0 / 3.0)"
    )
    dlon = (
        f"(300.0 + {x} + 2.0 * {y} + 0.1 * {x} * {x} + 0.1 * {x} * {y} + 0.1 * sqrt(abs({x})) + {shared}"
        f" + (20.0 * sin({x} * pi()) + 40.0 * sin({x} / 3.0 * pi())) * 2.0 / 3.0"
        f" + (150.0 * sin({x} / 12.0 * pi()) + 300.0 * sin({x} / 30.0 * pi())) * 2.0 / 3.0)"
    )
    magic = f"(1 - 0.006693421622965943 * power(sin(radians({lat})), 2))"
    return (
        f"{lon} + {dlon} * 180.0 / (6378245.0 / sqrt({magic}) * cos(radians({lat})) * pi())",
        f"{lat} + {dlat} * 180.0 / (6378245.0 * (1 - 0.006693421622965943) / ({magic} * sqrt({magic})) * pi())",
    )


def _inverse_sql() -> str:
    source = "SELECT mall_id, cast(longitude AS double) AS lon, cast(latitude AS double) AS lat, cast(longitude AS double) AS glon, cast(latitude AS double) AS glat FROM places"
    for _ in range(5):
        mlon, mlat = _gcj_sql("glon", "glat")
        source = f"SELECT mall_id, lon, lat, glon + (lon - ({mlon})) AS glon, glat + (lat - ({mlat})) AS glat FROM ({source})"
    return f"SELECT mall_id, round(glon, 6) AS wgs_lon, round(glat, 6) AS wgs_lat FROM ({source})"


@query("num6_datum_inverse", f"WITH {PLACE_SQL} {_inverse_sql()}")
def _(spark, sf):
    place = places(spark, sf)
    back = geo.gcj02_to_wgs84(F.col("longitude").cast("double"), F.col("latitude").cast("double"))
    return place.select("mall_id", back.alias("w")).select("mall_id", F.col("w.lon").alias("wgs_lon"), F.col("w.lat").alias("wgs_lat"))


@query("num7_region_check", f"""WITH {PLACE_SQL} SELECT mall_id, longitude > 120.8 AND longitude < 122.2 AND latitude > 30.5
  AND latitude < 31.9 AS in_region FROM places""")
def _(spark, sf):
    return places(spark, sf).select("mall_id", geo.in_region(F.col("longitude"), F.col("latitude")).alias("in_region"))


@query("num8_marker_diameter", """SELECT mall_id, cast(round(10 * sqrt(n / cast(min(n) OVER () AS double))) AS int) AS diameter
  FROM (SELECT l_suppkey AS mall_id, count(*) AS n FROM lineitem GROUP BY l_suppkey)""")
def _(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("mall_id")).agg(F.count("*").alias("n"))
    smallest = counts.agg(F.min("n")).scalar()
    return counts.select("mall_id", numeric.marker_diameter(F.col("n"), smallest).alias("diameter"))


_SHARES = """shares AS (SELECT l_suppkey AS mall_id, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS dining,
  avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS retail FROM lineitem GROUP BY l_suppkey)"""


@query("num9_num11_composition_color", f"""WITH {_SHARES}, full_shares AS (SELECT *, greatest(0, 1 - dining - retail) AS rest FROM shares),
  peaks AS (SELECT *, greatest(dining, retail, rest) AS peak FROM full_shares)
  SELECT mall_id, 'rgb(' || cast(round(220 * dining / peak) AS int) || ',' || cast(round(220 * retail / peak) AS int) || ','
  || cast(round(220 * rest / peak) AS int) || ')' AS color, printf('%.1f', dining * 100) || '%' AS dining_text FROM peaks""")
def _(spark, sf):
    shares = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("mall_id")).agg(
        F.avg((F.col("l_returnflag") == "A").cast("double")).alias("dining"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("retail"),
    )
    parts = [F.col("dining"), F.col("retail"), numeric.remaining_share(F.col("dining"), F.col("retail"))]
    return shares.select(
        "mall_id", numeric.composition_color(parts).alias("color"), numeric.percent(F.col("dining")).alias("dining_text")
    )


@query("src2_card_lineage", f"""WITH {LISTING_SQL} SELECT record_id, folder AS source_folder,
  'MALL-' || upper(substr(sha1(cast(mall_id AS varchar)), 1, 10)) AS mall_key,
  concat(substr(right(folder, 8), 1, 4), '-', substr(right(folder, 8), 5, 2), '-', substr(right(folder, 8), 7, 2)) AS capture_date,
  concat(folder, '/', record_id) AS source_record_id, floor AS normalized_floor
  FROM (SELECT *, concat('city__', mall_id, '__20260826') AS folder FROM listings)""")
def _(spark, sf):
    cards = listings(spark, sf).select(
        F.col("record_id").alias("card_id"), F.col("mall_id").cast("string").alias("mall_name"),
        F.concat(F.lit(" "), F.lower("floor")).alias("floor_location"),
        F.format_string("/in/city__%s__20260826/merchant_cards.csv", F.col("mall_id").cast("string")).alias("p"),
    )
    return with_lineage(cards, F.col("p")).select(
        F.col("card_id").alias("record_id"), "source_folder", F.col("mall_id").alias("mall_key"), "capture_date",
        "source_record_id", "normalized_floor",
    )


@query("src_missing_to_null", f"""SELECT o_orderkey, o_custkey, nullif(nullif(v, ''), '[]') AS v FROM
  (SELECT o_orderkey, o_custkey, {_BLANKED} AS v FROM orders)""")
def _(spark, sf):
    return missing_to_null(table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.expr(_BLANKED).alias("v")))


@query("snk1_flat_projection", with_listings("""SELECT record_id, coalesce(cast(brand_id AS varchar), '') AS brand_id,
  coalesce(cast(rating AS varchar), '') AS rating, '' AS evidence FROM listings"""))
def _(spark, sf):
    return flat(listings(spark, sf), ["record_id", "brand_id", "rating", "evidence"])


@query("snk2_csv_guard", """SELECT doc_id, CASE WHEN left(t, 1) IN ('=', '+', '-', '@') THEN '''' || t ELSE t END AS guarded
  FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN '=' || text ELSE text END AS t FROM documents)""")
def _(spark, sf):
    raw = table(spark, sf, "documents").withColumn("t", F.expr("case when lang = 'en' then concat('=', text) else text end"))
    return raw.select("doc_id", tx.csv_guard(F.col("t")).alias("guarded"))


@query("snk3_script_payload", f"""WITH {PLACE_SQL} SELECT concat('(window.VENUES = window.VENUES || []).push({{"mall_id":', mall_id, ',"district":',
  coalesce('"' || district || '"', 'null'), '}});') AS value FROM places""")
def _(spark, sf):
    return script_payload(places(spark, sf).select("mall_id", "district"), "VENUES")


@query("snk5_input_digests")
def _(spark, sf):
    return file_digests(spark, f"{sf.rstrip('/')}/*.parquet").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "bytes", "sha256"
    )


@query("win11_ordered_table", """SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place, c_custkey, c_name, c_acctbal FROM customer""")
def _(spark, sf):
    path = shared_folder(spark, "ordered")
    write_ordered(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path, F.desc("c_acctbal"), F.asc("c_custkey"))
    return read_ordered(spark, path)


@query("src5_search_records", """WITH a AS (SELECT s_name, n_name, s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'api_error:LIMIT' WHEN s_suppkey % 3 = 0 THEN 'no_match'
    WHEN s_suppkey % 4 = 0 THEN 'district_mismatch:' || n_name ELSE 'ok' END AS st FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT s_name AS mall_name, st AS search_status, CASE WHEN st = 'ok' THEN lower(s_name) ELSE '' END AS poi_name, CASE WHEN st = 'ok' THEN n_name ELSE '' END AS district,
    CASE WHEN st = 'ok' THEN '120.5' ELSE '' END AS longitude, CASE WHEN st = 'ok' THEN '31.25' ELSE '' END AS latitude,
    CASE WHEN st = 'ok' AND s_suppkey % 2 = 0 THEN '4.5' ELSE '' END AS poi_rating, CASE WHEN st = 'ok' AND s_suppkey % 2 = 0 THEN 'centre' ELSE '' END AS business_area FROM a""")
def _(spark, sf):
    known = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    even = F.col("s_suppkey") % 2 == 0
    place = lambda name, code: F.concat(
        F.lit('{"id": 7, "name": "'), name, F.lit('", "adname": "'), F.col("n_name"), F.lit(f'", "location": "120.5,31.25", "typecode": "{code}", "business_area": '),
        F.when(even, '"centre", "biz_ext": {"rating": "4.5"}}').otherwise('[], "biz_ext": []}'),
    )
    found = F.when(F.col("s_suppkey") % 3 == 0, place(F.lit("elsewhere"), "060101")).otherwise(F.concat_ws(", ", place(F.lit("elsewhere"), "060101"), place(F.lower("s_name"), "050000")))
    answers = known.select(
        F.col("s_name").alias("mall_name"), F.col("s_name").alias("search_keyword"), F.when(F.col("s_suppkey") % 4 == 0, "NOWHERE").otherwise("").alias("expected_district"),
        F.when(F.col("s_suppkey") % 7 == 0, "api_error:LIMIT").otherwise("ok").alias("fetch_status"), F.concat(F.lit("["), found, F.lit("]")).alias("pois"),
    )
    return venue_records(answers).select("mall_name", "search_status", "poi_name", "district", "longitude", "latitude", "poi_rating", "business_area")


@query("snk9_portable_path", """SELECT page_id, CASE WHEN contains(u, '.example.com/') THEN 'com/' || split_part(u, '.example.com/', 2)
  WHEN contains(u, '.example.net/') THEN 'net/' || split_part(u, '.example.net/', 2) ELSE u END AS portable
  FROM (SELECT page_id, replace(url, chr(92), '/') AS u FROM pages)""")
def _(spark, sf):
    roots = {".example.com/": "com/", ".example.net/": "net/"}
    return table(spark, sf, "pages").select("page_id", tx.portable_path(F.col("url"), roots).alias("portable"))
