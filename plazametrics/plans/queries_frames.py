"""Frame selection, token joins, card parsing, entity merging and drill-down queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cards as cd
from ..operators import entities, explore, frames, pairs, venue
from ..operators.quantiles import trimmed_bounds
from ..session import checkpointed
from ..sources.tables import frame_tokens, in_reading_order
from .bindings import (
    FRAME_SQL, PLACE_SQL, TOKEN_SQL, listings, places, table, token_structs, tokens, with_listings,
)
from .bindings import frames as frame_view
from .queries_venue import share_tests
from .registry import query

GEOMETRY = frames.Geometry(width=864, height=1556, scale=2.0, crop_y=172, frame_height=960)
# The same geometry in SQL: title gaps, row tolerance and region depth in pixels.
MIN_GAP, MAX_GAP, TOLERANCE, DEPTH = 6, 109, 28, 311


@query("stm1_sharpest_frame", f"""WITH {FRAME_SQL}, b AS (SELECT *, greatest(cast(ceil(frame_index / 50.0) AS bigint) - 1, 0) AS bucket FROM frames)
  SELECT video, bucket, frame_index, sharpness FROM (SELECT *, row_number() OVER (PARTITION BY video, bucket ORDER BY sharpness DESC, frame_index) AS r FROM b) WHERE r = 1""")
def _(spark, sf):
    return frames.sharpest_per_bucket(frame_view(spark, sf), 50)


@query("stm2_stm3_probe_frames", f"""WITH {FRAME_SQL} SELECT video, frame_index FROM frames WHERE frame_index >= 100 AND (frame_index - 100) % 3 = 0
  AND frame_index < (SELECT max(frame_index) FROM frames)""")
def _(spark, sf):
    every = frame_view(spark, sf)
    probed = frames.probe_frames(every, fps=30, probe_fps=10, start=100, end=every.agg(F.max("frame_index")).scalar())
    return probed.select("video", "frame_index")


@query("ded7_stm4_changed_frames", f"""WITH RECURSIVE {FRAME_SQL}, b AS (SELECT *, greatest(cast(ceil(frame_index / 50.0) AS bigint) - 1, 0) AS bucket FROM frames),
  f AS (SELECT video, bucket, frame_index, sharpness, row_number() OVER (PARTITION BY video ORDER BY bucket) AS n, count(*) OVER (PARTITION BY video) AS total
    FROM (SELECT *, row_number() OVER (PARTITION BY video, bucket ORDER BY sharpness DESC, frame_index) AS r FROM b) WHERE r = 1),
  s AS (SELECT video, n, sharpness AS last, true AS kept FROM f WHERE n = 1
    UNION ALL SELECT f.video, f.n, CASE WHEN abs(f.sharpness - s.last) >= 1.0 THEN f.sharpness ELSE s.last END, abs(f.sharpness - s.last) >= 1.0 FROM s JOIN f ON f.video = s.video AND f.n = s.n + 1)
  SELECT video, bucket, frame_index FROM f JOIN s USING (video, n) WHERE kept OR n = total""")
def _(spark, sf):
    best = frames.sharpest_per_bucket(frame_view(spark, sf), 50).withColumn("image", F.array("sharpness"))
    return entities.changed_frames(best, "image", 1.0)


ORDERED_SQL = f"""{TOKEN_SQL}, ordered AS (SELECT *, row_number() OVER (PARTITION BY video, frame_index ORDER BY y1, x1, text) AS ord FROM tokens)"""


def ordered_tokens(spark, sf) -> DataFrame:
    return in_reading_order(token_structs(tokens(spark, sf)), ["video", "frame_index"])


@query("src9_token_replay_order", f"""WITH {ORDERED_SQL} SELECT video, frame_index, ord, text, y1 FROM ordered""")
def _(spark, sf):
    rows = ordered_tokens(spark, sf)
    return rows.select("video", "frame_index", "ord", F.col("token.text").alias("text"), F.col("token.box")[1].alias("y1"))


@query("src9_token_payload", f"""WITH {TOKEN_SQL}, kept AS (SELECT video, frame_index, text, score, x1, y1, x2, y2 FROM tokens WHERE event_id % 11 <> 0)
  SELECT video, frame_index, row_number() OVER (PARTITION BY video, frame_index ORDER BY y1, x1, text) AS ord, text, round(score, 6) AS score, x1, y1, x2, y2 FROM kept""")
def _(spark, sf):
    blank = F.when(F.col("event_id") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "token.text"))
    token = F.struct("event_id", blank.alias("text"), F.col("token.score").alias("score"), F.col("token.box").alias("box"))
    held = token_structs(tokens(spark, sf)).groupBy("video", "frame_index").agg(F.array_sort(F.collect_list(token)).alias("t"))
    lists = F.struct(*[F.col(f"t.{c}").alias(f"rec_{name}") for c, name in (("text", "texts"), ("score", "scores"), ("box", "boxes"))])
    # Every other frame has its lists within another object.
    content = F.when(F.col("frame_index") % 2 == 0, F.to_json(F.struct(lists.alias("res")))).otherwise(F.to_json(lists))
    rows = in_reading_order(frame_tokens(held.select("video", "frame_index", content.alias("content"))), ["video", "frame_index"])
    box = [F.col("token.box")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return rows.select("video", "frame_index", "ord", F.col("token.text").alias("text"), F.round("token.score", 6).alias("score"), *box)


_TITLE = "(starts_with(text, 'Shop') OR (starts_with(text, 'L') AND x1 <= 311))"
TITLES_SQL = f"""{ORDERED_SQL}, titles AS (SELECT *, y1 + 20.0 AS cy FROM ordered WHERE {_TITLE}),
  anchors AS (SELECT *, y1 + 20.0 AS cy, CASE WHEN starts_with(text, '4.') OR starts_with(text, '暂无') THEN 3 WHEN starts_with(text, '￥') THEN 2 ELSE 1 END AS priority
    FROM ordered WHERE NOT starts_with(text, 'Shop')),
  near AS (SELECT a.video, a.frame_index, a.ord AS anchor_ord, a.priority, t.ord AS title_ord, a.cy - t.cy AS gap, row_number() OVER (PARTITION BY a.video, a.frame_index, a.ord
    ORDER BY a.cy - t.cy, t.ord) AS r FROM anchors a JOIN titles t USING (video, frame_index) WHERE a.cy - t.cy BETWEEN {MIN_GAP} AND {MAX_GAP} AND t.y2 < a.cy),
  matched AS (SELECT video, frame_index, title_ord, anchor_ord FROM (SELECT *, row_number() OVER (PARTITION BY video, frame_index, title_ord
    ORDER BY priority DESC, gap, anchor_ord) AS q FROM near WHERE r = 1) WHERE q = 1),
  cards AS (SELECT m.*, t.text AS title, t.y1 AS ty, t.x1 AS tx, a.cy AS acy, a.text AS anchor_text, lead(t.y1) OVER (PARTITION BY m.video, m.frame_index ORDER BY t.y1, t.ord) AS nxt
    FROM matched m JOIN titles t ON t.video = m.video AND t.frame_index = m.frame_index AND t.ord = title_ord
    JOIN anchors a ON a.video = m.video AND a.frame_index = m.frame_index AND a.ord = anchor_ord),
  bounded AS (SELECT *, coalesce(nxt, 1556) AS next_y FROM cards)"""


def matches(spark, sf) -> DataFrame:
    t = frames.prepared(ordered_tokens(spark, sf), GEOMETRY)
    titles = t.where("is_title").select(
        *frames.FRAME, F.col("ord").alias("title_ord"), F.col("cy").alias("cy_t"), F.col("y2").alias("y2_t"), F.col("y1").alias("y1_t"),
    )
    anchors = frames.anchor_tokens(t).select(*frames.FRAME, "anchor_ord", "priority", "cy")
    found = frames.nearest_above(
        anchors, titles.drop("y1_t"), GEOMETRY.reach(6, 0.004), GEOMETRY.reach(90, 0.07), frames.FRAME
    )
    return frames.next_title(found.join(titles, [*frames.FRAME, "title_ord"]), GEOMETRY.height)


@query("joi12_nearest_title_join", f"WITH {TITLES_SQL} SELECT video, frame_index, title_ord, anchor_ord FROM matched")
def _(spark, sf):
    return matches(spark, sf).select("video", "frame_index", "title_ord", "anchor_ord")


@query("win3_next_title", f"WITH {TITLES_SQL} SELECT video, frame_index, title_ord, next_y FROM bounded")
def _(spark, sf):
    return matches(spark, sf).select("video", "frame_index", "title_ord", "next_y")


def parsed(spark, sf) -> tuple[DataFrame, DataFrame]:
    return frames.parse_cards(ordered_tokens(spark, sf), GEOMETRY)


ROWS_SQL = f"""{TITLES_SQL}, on_row AS (SELECT b.*, o.ord, o.text, o.x1, o.score, starts_with(o.text, 'L') AS pure FROM bounded b LEFT JOIN ordered o ON b.video = o.video AND b.frame_index = o.frame_index
    AND abs(o.y1 + 20.0 - acy) <= {TOLERANCE} AND o.y1 < next_y AND o.x1 >= tx - 20),
  fields AS (SELECT video, frame_index, title_ord, coalesce(min_by(CASE WHEN starts_with(text, '4.') THEN left(text, 3) END, ord) FILTER (starts_with(text, '4.')), '') AS rating,
    coalesce(min_by(regexp_extract(text, '￥(\\d+)/人', 1), ord) FILTER (starts_with(text, '￥')), '') AS avg_price_yuan,
    coalesce(arg_max(text, (x1, -ord)) FILTER (pure), '') AS floor_location, coalesce(string_agg(text, ' | ' ORDER BY ord), '') AS metadata_text FROM on_row GROUP BY ALL)"""


@query("joi13_win4_win6_row_fields", f"WITH {ROWS_SQL} SELECT video, frame_index, title_ord, rating, avg_price_yuan, floor_location, metadata_text FROM fields")
def _(spark, sf):
    cards, _ = parsed(spark, sf)
    return cards.select("video", "frame_index", "title_ord", "rating", "avg_price_yuan", "floor_location", "metadata_text")


@query("joi14_region_tokens", f"""WITH {TITLES_SQL} SELECT b.video, b.frame_index, title_ord, coalesce(string_agg(o.text, ' | ' ORDER BY o.ord), '') AS all_text FROM bounded b
  LEFT JOIN ordered o ON b.video = o.video AND b.frame_index = o.frame_index AND o.y1 + 20.0 >= ty - 8 AND o.y1 + 20.0 < least(1556, next_y - 4, ty + {DEPTH}) GROUP BY ALL""")
def _(spark, sf):
    cards, _ = parsed(spark, sf)
    return cards.select("video", "frame_index", "title_ord", "all_text")


@query("win5_category_contest", f"""WITH {ROWS_SQL}, contest AS (SELECT *, CASE WHEN starts_with(text, '4.') THEN substr(text, 4) WHEN starts_with(text, '暂无') THEN '咖啡'
    WHEN starts_with(text, 'Shop') THEN text END AS cat FROM on_row),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY video, frame_index, title_ord ORDER BY score + (CASE WHEN ord = anchor_ord THEN 0.35 ELSE 0.0 END)
    + (CASE WHEN starts_with(text, '4.') THEN 0.2 ELSE 0.0 END) - length(cat) * 0.003 DESC, ord) AS q FROM contest WHERE cat IS NOT NULL)
  SELECT f.video, f.frame_index, f.title_ord, coalesce(cat, '') AS category_raw FROM fields f LEFT JOIN ranked r ON r.q = 1 AND f.video = r.video AND f.frame_index = r.frame_index AND f.title_ord = r.title_ord""")
def _(spark, sf):
    cards, _ = parsed(spark, sf)
    return cards.select("video", "frame_index", "title_ord", "category_raw")


@query("stm6_parse_cards")
def _(spark, sf):
    return parsed(spark, sf)[0]


@query("stm7_title_candidates", f"""WITH {ORDERED_SQL} SELECT event_id, {_TITLE} AS structural FROM ordered""")
def _(spark, sf):
    rows = token_structs(tokens(spark, sf))
    return rows.select("event_id", cd.is_title(F.col("token"), F.lit(864), F.lit(1556)).alias("structural"))


@query("stm7_strict_titles", f"""WITH {TOKEN_SQL} SELECT event_id, x1 / 864.0 BETWEEN 0.265 AND 0.32 AND false AS strict FROM tokens""")
def _(spark, sf):
    rows = token_structs(tokens(spark, sf))
    return rows.select("event_id", cd.is_strict_title(F.col("token"), F.lit(864)).alias("strict"))


@query("stm8_new_store_badges", f"""WITH {TOKEN_SQL} SELECT event_id, event_id % 5 = 0 AND y1 + 20.0 BETWEEN 596 AND 620 + 93 AND x1 BETWEEN 215 AND 240 + 172.8 AS badge FROM tokens""")
def _(spark, sf):
    rows = tokens(spark, sf).withColumn("text", F.when(F.col("event_id") % 5 == 0, "新店 开业").otherwise(F.col("text")))
    title = F.struct(F.lit("Shop").alias("text"), F.lit(0.9).alias("score"), F.array(*[F.lit(v) for v in (240, 600, 370, 640)]).alias("box"))
    badge = cd.is_new_store_badge(F.col("token"), title, F.lit(864), F.lit(1556))
    return token_structs(rows).select("event_id", badge.alias("badge"))


@query("agg27_recall_audit", f"""WITH {TITLES_SQL}, per AS (SELECT video, frame_index, count(*) AS n, count(*) FILTER ({_TITLE}) AS t, count(*) FILTER (NOT starts_with(text, 'Shop')) AS a FROM ordered GROUP BY ALL),
  made AS (SELECT video, frame_index, count(*) AS k FROM matched GROUP BY ALL)
  SELECT count(*) AS frames, count(k) AS frames_with_cards, count(*) - count(k) AS frames_without_cards, cast(sum(n) AS bigint) AS ocr_tokens, cast(sum(t) AS bigint) AS title_candidates,
  cast(sum(a) AS bigint) AS raw_anchors, cast(sum(k) AS bigint) AS accepted_cards, (SELECT count(*) FROM near WHERE r = 1) AS matched_anchors FROM per LEFT JOIN made USING (video, frame_index)""")
def _(spark, sf):
    _, audit = parsed(spark, sf)
    total = frames.recall_audit(audit)
    return total.select(
        "frames", "frames_with_cards", "frames_without_cards", "ocr_tokens", "title_candidates", "raw_anchors",
        "accepted_cards", "matched_anchors",
    )


def observations(spark, sf) -> DataFrame:
    cards = parsed(spark, sf)[0].withColumn("ord", F.col("frame_index") * 1000 + F.col("title_ord"))
    return checkpointed(entities.with_match_keys(cards))


@query("ded5_stm5_merge_observations")
def _(spark, sf):
    return entities.merge_observations(observations(spark, sf))


@query("agg28_agg29_entity_cards")
def _(spark, sf):
    seen = observations(spark, sf)
    found = entities.entity_cards(entities.merge_observations(seen), seen)
    return found.select(
        "video", "entity", "merchant_name_raw", "observations", "card_type", "exclusion_reason", "research_eligible",
        F.array_join("review_reasons", " | ").alias("review_reason"), "review_status",
    )


@query("agg33_run_summary")
def _(spark, sf):
    seen = observations(spark, sf)
    found = entities.entity_cards(entities.merge_observations(seen), seen)
    return found.groupBy("card_type", "review_status").agg(F.count("*").alias("entities"), F.sum("observations").alias("observations"))


_CARD_TYPE = """CASE WHEN sum(CASE WHEN l_linenumber = 7 AND l_tax > 0.07 AND l_returnflag = 'A' THEN 1 ELSE 0 END) > 0 THEN 'new_store'
  WHEN sum(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END) > 0 THEN 'rated' WHEN sum(CASE WHEN l_discount < 0.005 THEN 1 ELSE 0 END) > 0 THEN 'unrated' ELSE 'unknown' END"""


@query("agg28_card_type_precedence", f"SELECT l_orderkey, {_CARD_TYPE} AS card_type FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if((F.col("l_linenumber") == 7) & (F.col("l_tax") > 0.07) & (F.col("l_returnflag") == "A")).alias("a"),
        F.count_if(F.col("l_quantity") > 49).alias("b"), F.count_if(F.col("l_discount") < 0.005).alias("c"),
    )
    by_type = F.create_map(F.lit("new_store"), "a", F.lit("rated"), "b", F.lit("unrated"), "c")
    return counts.select("l_orderkey", cd.card_type(by_type).alias("card_type"))


@query("ded4_same_merchant_pairs")
def _(spark, sf):
    seen = entities.with_match_keys(parsed(spark, sf)[0].withColumn("ord", F.col("frame_index")))
    fields = F.struct(*entities.MATCH_FIELDS)
    left = seen.select("video", "frame_index", F.col("title_ord").alias("ord_a"), fields.alias("l"))
    right = seen.select("video", "frame_index", F.col("title_ord").alias("ord_b"), fields.alias("r"))
    met = left.join(right, ["video", "frame_index"]).where(F.col("ord_a") < F.col("ord_b"))
    return met.select("video", "frame_index", "ord_a", "ord_b", entities.same_merchant_pair(F.col("l"), F.col("r")).alias("same"))


@query("ded6_observation_quality", """SELECT c_custkey, round(0.5 + (CASE WHEN c_mktsegment <> 'BUILDING' THEN 0.12 ELSE 0 END) + (CASE WHEN c_nationkey > 9 THEN 0.07 ELSE 0 END)
  + (CASE WHEN c_acctbal > 0 THEN 0.05 ELSE 0 END) + (CASE WHEN c_nationkey % 2 = 0 THEN 0.04 ELSE 0 END) + least(length(c_name), 24) * 0.003, 6) AS quality FROM customer""")
def _(spark, sf):
    seen = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("merchant_name_raw"), F.lit(0.5).alias("ocr_confidence"),
        F.expr("case when c_mktsegment <> 'BUILDING' then c_mktsegment else '' end").alias("category_raw"),
        F.expr("case when c_nationkey > 9 then 'L1' else '' end").alias("floor_location"),
        F.expr("case when c_acctbal > 0 then '4.5' else '' end").alias("rating"),
        F.expr("case when c_nationkey % 2 = 0 then 'rating_anchor' else 'metadata_anchor' end").alias("detection_method"),
        F.lit("rated").alias("card_type"),
    )
    return seen.select("c_custkey", F.round(cd.observation_quality(F.struct("*")), 6).alias("quality"))


@query("prj4_fil13_numbered_cards", """SELECT o_orderkey, o_custkey, card_id FROM (SELECT *, 'CARD-' || lpad(cast(row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate, o_orderkey) AS varchar), 4, '0') AS card_id FROM orders) WHERE o_orderstatus <> 'P'""")
def _(spark, sf):
    numbered = frames.numbered(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "CARD", 4, "card_id")
    return numbered.where(F.col("o_orderstatus") != "P").select("o_orderkey", "o_custkey", "card_id")


# ---------------------------------------------------------------- drill-down

@query("fil9_store_filter", with_listings("SELECT record_id, name FROM listings WHERE contains(lower(concat_ws(' ', name, category_l2)), 'ring') AND category_l1 = 'PROMO' AND floor = 'L2'"))
def _(spark, sf):
    hits = explore.store_filter(
        listings(spark, sf), "RING ", "PROMO", "L2", names=("name", "category_l2"), group_column="category_l1", floor_column="floor"
    )
    return hits.select("record_id", "name")


@query("fil9_store_page", with_listings("SELECT record_id, name FROM listings WHERE mall_id = 3 ORDER BY record_id LIMIT 40"))
def _(spark, sf):
    return explore.page(listings(spark, sf).where("mall_id = 3").select("record_id", "name"), ["record_id"])


@query("fil10_mall_search", f"WITH {PLACE_SQL} SELECT s_suppkey, s_name FROM supplier JOIN places ON s_suppkey = mall_id WHERE contains(lower(s_name), '7') OR contains(lower(district), '7')")
def _(spark, sf):
    malls = table(spark, sf, "supplier").join(places(spark, sf), F.col("s_suppkey") == F.col("mall_id"))
    return explore.search(malls, "7", ["s_name", "district"]).select("s_suppkey", "s_name")


@query("fil11_facets", with_listings("SELECT mall_id, floor, count(*) AS stores FROM listings WHERE floor <> '' GROUP BY ALL"))
def _(spark, sf):
    return explore.facets(listings(spark, sf), "mall_id", "floor")


@query("fil11_numeric_order", """SELECT DISTINCT 'F' || p_size AS label, cast(p_size AS bigint) AS number FROM part""")
def _(spark, sf):
    labels = table(spark, sf, "part").select(F.concat(F.lit("F"), F.col("p_size").cast("string")).alias("label")).distinct()
    keyed = labels.withColumn("_key", explore.numeric_sort_key(F.col("label")))
    return keyed.orderBy("_key").select("label", F.col("_key.n").alias("number"))


RELATION_SQL = """h AS (SELECT DISTINCT mall_id, brand_id FROM listings), s AS (SELECT mall_id, count(*) AS n FROM h GROUP BY ALL),
  e AS (SELECT x.mall_id AS venue, y.mall_id AS peer, count(*) AS shared FROM h x JOIN h y ON x.brand_id = y.brand_id AND x.mall_id <> y.mall_id GROUP BY ALL),
  rel AS (SELECT venue, peer, shared, round(shared / cast(a.n + b.n - shared AS double), 6) AS j FROM e JOIN s a ON a.mall_id = venue JOIN s b ON b.mall_id = peer),
  top AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY j DESC, shared DESC, peer) AS rank FROM rel)"""


def relations(spark, sf) -> DataFrame:
    directed = pairs.both_directions(pairs.jaccard_pairs(listings(spark, sf), "mall_id", "brand_id"))
    return explore.top_relations(directed, "jaccard_similarity", "shared_brand_count")


@query("win7_top_relations", with_listings(f", {RELATION_SQL} SELECT venue, peer, shared AS shared_brand_count, j AS jaccard_similarity, rank FROM top WHERE rank <= 3"))
def _(spark, sf):
    return relations(spark, sf).select("venue", "peer", "shared_brand_count", "jaccard_similarity", "rank")


@query("win8_over_represented", with_listings(""", c AS (SELECT mall_id, category_l2, count(*) AS n FROM listings GROUP BY ALL), v AS (SELECT mall_id, sum(n) AS vn FROM c GROUP BY ALL),
  o AS (SELECT category_l2, sum(n) AS cn FROM c GROUP BY ALL), t AS (SELECT sum(n) AS tn FROM c),
  d AS (SELECT mall_id, category_l2, n, round(n / cast(vn AS double), 6) AS share, round(n / cast(vn AS double) - cn / cast(tn AS double), 6) AS difference FROM c JOIN v USING (mall_id) JOIN o USING (category_l2), t WHERE n >= 3)
  SELECT mall_id, category_l2, n, share, difference, rank FROM (SELECT *, row_number() OVER (PARTITION BY mall_id ORDER BY difference DESC, category_l2) AS rank FROM d) WHERE rank <= 5"""))
def _(spark, sf):
    return explore.over_represented(listings(spark, sf), "mall_id", "category_l2")


@query("ui1_mall_detail", with_listings(""", s AS (SELECT mall_id, round(avg(CASE WHEN category_l1 = 'MEDIUM' THEN 1.0 ELSE 0.0 END), 6) AS d, round(avg(CASE WHEN category_l1 = 'LARGE' THEN 1.0 ELSE 0.0 END), 6) AS r
    FROM listings GROUP BY mall_id) SELECT mall_id, d AS dining_share, r AS retail_share, round(greatest(0, 1 - d - r), 6) AS other_share FROM s"""))
def _(spark, sf):
    shares = venue.membership_shares(listings(spark, sf), "mall_id", {k: v for k, v in share_tests().items() if k in ("dining_share", "retail_share")})
    return explore.venue_detail(shares, "mall_id", "dining_share", "retail_share").drop("color")


@query("ui2_mall_list", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_name").orderBy("s_name")


@query("ui3_visible_set", with_listings(f", {RELATION_SQL} SELECT DISTINCT mall_id FROM (SELECT s_suppkey AS mall_id FROM supplier WHERE contains(s_name, '99') UNION ALL SELECT 5 UNION ALL SELECT peer FROM top WHERE venue = 5 AND rank <= 3)"))
def _(spark, sf):
    malls = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("mall_id"), "s_name")
    return explore.visible_set(explore.search(malls, "99", ["s_name"]), malls.where("mall_id = 5"), relations(spark, sf), "mall_id")


@query("ui4_relation_evidence", """WITH h AS (SELECT DISTINCT c_nationkey AS v, p_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
  n AS (SELECT x.v AS a, y.v AS b, x.p_name AS s FROM h x JOIN h y ON x.p_name = y.p_name AND x.v < y.v)
  SELECT a, b, count(*) AS shared_total, array_to_string(list_sort(list(s))[1:5], '、') || CASE WHEN count(*) > 5 THEN '…' ELSE '' END AS evidence FROM n GROUP BY ALL""")
def _(spark, sf):
    sold = (
        table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select("c_nationkey", F.col("p_name").alias("brand"), "p_name")
    )
    return explore.relation_evidence(pairs.shared_names(sold, "c_nationkey", "brand", "p_name"))


@query("agg34_cluster_mean", """WITH s AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS r FROM lineitem GROUP BY l_suppkey)
  SELECT s_nationkey, count(*) AS size, round(avg(a), 6) AS a, round(avg(r), 6) AS r FROM s JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey""")
def _(spark, sf):
    shares = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.avg((F.col("l_returnflag") == "A").cast("double")).alias("a"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("r")
    )
    members = shares.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return explore.member_mean(members, "s_nationkey", ["a", "r"])


@query("agg35_trimmed_bounds", """WITH o AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS n FROM lineitem),
  b AS (SELECT max(CASE WHEN r = floor(n * 0.1) + 1 THEN v END) AS low, max(CASE WHEN r = ceil(n * 0.9) THEN v END) AS high FROM o)
  SELECT low, high, round(low - (high - low) * 0.16, 6) AS low_padded, round(high + (high - low) * 0.16, 6) AS high_padded FROM b""")
def _(spark, sf):
    bounds = trimmed_bounds(table(spark, sf, "lineitem"), "l_extendedprice", "low", "high")
    return explore.padded_bounds(bounds, "low", "high")


@query("num10_ternary_shares", """SELECT vec_id, x, y, round(((-0.0) * (x - 144) + (144 - 8) * (y - 108)) / ((108 - 108) * (76 - 144) + (144 - 8) * (7 - 108.0)), 6) AS a,
  round(((108 - 7) * (x - 144) + (76 - 144) * (y - 108)) / ((144 - 8) * (7 - 108.0)), 6) AS b FROM (SELECT vec_id, vec_id % 152 AS x, label * 11 AS y FROM embeddings)""")
def _(spark, sf):
    pixels = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 152).alias("x"), (F.col("label") * 11).alias("y"))
    a, b, _ = explore.ternary_shares(F.col("x"), F.col("y"))
    return pixels.select("vec_id", "x", "y", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))
