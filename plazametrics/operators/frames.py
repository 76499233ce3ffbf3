"""From recognised text tokens of frames to card observations.

Tokens carry ``video``, ``frame_index``, ``timestamp_sec``, ``ord`` (reading order within
the frame) and ``token`` (text, score, box). A frame is a screen, so per-frame joins stay
small; frames spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cards as cd
from ..functions.text import nfkc
from ..session import checkpointed

FRAME = ["video", "frame_index"]


@dataclass(frozen=True)
class Geometry:
    width: int
    height: int
    scale: float = 2.0
    crop_y: int = 0
    frame_height: int = 0

    def reach(self, floor: int, share: float) -> int:
        return max(floor, round(self.height * share))


def probe_frames(frames: DataFrame, fps: float, probe_fps: float, start: int = 0, end: int | None = None) -> DataFrame:
    """Frames within the clip, thinned to the probing rate."""
    step = max(1, round(fps / probe_fps))
    inside = frames.where(F.col("frame_index") >= start)
    if end is not None:
        inside = inside.where(F.col("frame_index") < end)
    return inside.where(F.pmod(F.col("frame_index") - start, F.lit(step)) == 0)


def bucket_of(index: Column, start: int, bucket_frames: int) -> Column:
    """Buckets close on their last frame: the boundary frame belongs to the earlier one."""
    return F.greatest(F.ceil((index - start) / bucket_frames) - 1, F.lit(0)).cast("bigint")


def sharpest_per_bucket(
    frames: DataFrame, bucket_frames: int, start: int = 0, sharpness: str = "sharpness"
) -> DataFrame:
    """The sharpest frame of each bucket, the first one on a tie."""
    rest = [c for c in frames.columns if c not in ("video",)]
    bucketed = frames.withColumn("bucket", bucket_of(F.col("frame_index"), start, bucket_frames))
    return bucketed.groupBy("video", "bucket").agg(
        F.max_by(F.struct(*rest), F.struct(F.col(sharpness), -F.col("frame_index"))).alias("_best")
    ).select("video", "bucket", "_best.*")


def nearest_above(
    anchors: DataFrame, titles: DataFrame, min_gap: float, max_gap: float, keys: list[str]
) -> DataFrame:
    """Each anchor's closest title above it, then each title's best anchor.

    Anchors bring ``anchor_ord, priority, cy``; titles ``title_ord, cy_t, y2_t``.
    """
    gap = F.col("cy") - F.col("cy_t")
    near = anchors.join(titles, keys).where(gap.between(min_gap, max_gap) & (F.col("y2_t") < F.col("cy")))
    each = near.groupBy(*keys, "anchor_ord").agg(
        F.min_by(F.struct("title_ord", "priority", gap.alias("gap")), F.struct(gap.alias("gap"), "title_ord")).alias("m")
    )
    return each.select(*keys, "anchor_ord", "m.*").groupBy(*keys, "title_ord").agg(
        F.min_by(F.struct("anchor_ord", "priority", "gap"), F.struct(-F.col("priority"), "gap", "anchor_ord")).alias("m")
    ).select(*keys, "title_ord", "m.*")


def prepared(tokens: DataFrame, g: Geometry) -> DataFrame:
    """Token geometry and every extracted field, computed once per token."""
    text = nfkc(F.col("token.text"))
    box = F.col("token.box")
    base = tokens.withColumn("text", text).withColumn("raw", F.col("token.text")).withColumn(
        "norm", F.struct(F.col("text").alias("text"), F.col("token.score").alias("score"), box.alias("box"))
    )
    return base.select(
        *FRAME, "timestamp_sec", "ord", "norm", "raw", F.col("token.score").alias("score"),
        box[0].alias("x1"), box[1].alias("y1"), box[3].alias("y2"), ((box[1] + box[3]) / 2).alias("cy"),
        cd.is_title(F.col("norm"), F.lit(g.width), F.lit(g.height)).alias("is_title"),
        cd.rating(F.col("text")).alias("t_rating"), cd.price(F.col("text")).alias("t_price"),
        cd.floor(F.col("text")).alias("t_floor"), cd.is_floor_token(F.col("text")).alias("pure_floor"),
        cd.is_unrated(F.col("text")).alias("unrated"), cd.is_new_store(F.col("text")).alias("new_store"),
        cd.category(F.col("text")).alias("t_category"),
    )


def anchor_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens that mark a card: a rating, an unrated note, a price or a floor."""
    rated, priced = F.col("t_rating") != "", F.col("t_price") != ""
    floored = F.col("t_floor") != ""
    kind = (
        F.when(rated, F.struct(F.lit(3).alias("priority"), F.lit("rating_anchor").alias("method"), F.lit("rated").alias("status")))
        .when(F.col("unrated"), F.struct(F.lit(3).alias("priority"), F.lit("unrated_anchor").alias("method"), F.lit("unrated").alias("status")))
        .when(priced | floored, F.struct(
            F.when(priced, 2).otherwise(1).alias("priority"), F.lit("metadata_anchor").alias("method"),
            F.lit("ocr_missing").alias("status"),
        ))
    )
    return tokens.withColumn("_k", kind).where(F.col("_k").isNotNull()).select(
        *FRAME, F.col("ord").alias("anchor_ord"), "cy", "_k.*"
    )


def next_title(matches: DataFrame, height: int) -> DataFrame:
    """Upper edge of the following title in the frame, or the frame's bottom."""
    down = Window.partitionBy(*FRAME).orderBy("y1_t", "title_ord")
    return matches.withColumn("next_y", F.lead("y1_t").over(down)).withColumn(
        "is_last", F.col("next_y").isNull()
    ).withColumn("next_y", F.coalesce("next_y", F.lit(height)))


def parse_cards(tokens: DataFrame, g: Geometry) -> tuple[DataFrame, DataFrame]:
    """Card observations and the per-frame recall audit."""
    # Titles, anchors, rows and the audit all read the extracted fields.
    t = checkpointed(prepared(tokens, g))
    titles = t.where("is_title").select(
        *FRAME, F.col("ord").alias("title_ord"), F.col("cy").alias("cy_t"), F.col("y2").alias("y2_t"),
        F.col("y1").alias("y1_t"), F.col("x1").alias("x1_t"), F.col("norm").alias("title"), F.col("raw").alias("title_raw"),
        F.col("score").alias("title_score"), "timestamp_sec",
    )
    anchors = anchor_tokens(t)
    matched = nearest_above(
        anchors.select(*FRAME, "anchor_ord", "priority", "cy"), titles.select(*FRAME, "title_ord", "cy_t", "y2_t"),
        g.reach(6, 0.004), g.reach(90, 0.07), FRAME,
    ).drop("priority", "gap")
    matches = next_title(
        matched.join(titles, [*FRAME, "title_ord"]).join(anchors, [*FRAME, "anchor_ord"]), g.height
    ).withColumnRenamed("cy", "cy_a")
    tolerance = g.reach(24, 0.018)
    own = matches.select(*FRAME, "title_ord", "anchor_ord", "cy_a", "x1_t", "y1_t", "next_y", "title")
    bottom = F.least(F.lit(g.height), F.col("next_y") - 4, F.col("y1_t") + g.reach(260, 0.20))
    on_row = (
        (F.abs(F.col("cy") - F.col("cy_a")) <= tolerance)
        & (F.col("y1") < F.col("next_y")) & (F.col("x1") >= F.col("x1_t") - 20)
    )
    in_region = (F.col("cy") >= F.col("y1_t") - 8) & (F.col("cy") < bottom)
    near = own.join(t.drop("timestamp_sec"), FRAME).withColumn("row", on_row).withColumn("region", in_region).where("row or region")

    def first_text(column: str) -> Column:
        return F.coalesce(F.min_by(column, F.when(F.col("row") & (F.col(column) != ""), F.col("ord"))), F.lit(""))

    def joined(test: Column) -> Column:
        picked = F.array_sort(F.collect_list(F.when(test, F.struct("ord", "raw"))))
        return F.array_join(F.transform(picked, lambda e: e["raw"]), " | ")

    contest = (
        F.col("row") & ~F.col("pure_floor") & ~F.col("new_store") & cd.is_plausible_category(F.col("t_category"))
    )
    rank = (
        F.col("score") + F.when(F.col("ord") == F.col("anchor_ord"), 0.35).otherwise(0.0)
        + F.when((F.col("t_rating") != "") | (F.col("t_price") != ""), 0.20).otherwise(0.0)
        - F.least(F.length("t_category"), F.lit(18)) * 3 / 1000
    )
    badge = cd.is_new_store_badge(F.col("norm"), F.col("title"), F.lit(g.width), F.lit(g.height))
    claimed = F.max_by("t_floor", F.when(F.col("row") & F.col("pure_floor"), F.struct("x1", -F.col("ord"))))
    fields = near.groupBy(*FRAME, "title_ord").agg(
        first_text("t_rating").alias("rating"), first_text("t_price").alias("avg_price_yuan"),
        F.coalesce(F.nullif(claimed, F.lit("")), first_text("t_floor")).alias("floor_location"),
        F.max_by(F.struct(F.col("t_category").alias("category"), "score"), F.when(contest, F.struct(rank.alias("r"), -F.col("ord")))).alias("c"),
        joined(F.col("row")).alias("metadata_text"), joined(F.col("region")).alias("all_text"),
        F.max(F.col("region") & badge).alias("badge"),
    )
    # A card whose row and region hold no token keeps empty fields.
    full = matches.join(fields, [*FRAME, "title_ord"], "left").na.fill(
        "", ["rating", "avg_price_yuan", "floor_location", "metadata_text", "all_text"]
    ).na.fill({"badge": False})
    category = F.coalesce("c.category", F.lit(""))
    status = F.when((F.col("status") == "rated") & (F.col("rating") == ""), "ocr_missing").otherwise(F.col("status"))
    crop_top = F.greatest(F.lit(0), F.floor(F.lit(g.crop_y) + F.col("y1_t") / g.scale - 18))
    crop_end = F.when(F.col("is_last"), F.floor(g.crop_y + F.col("y1_t") / g.scale + 235)).otherwise(
        F.floor(g.crop_y + F.col("next_y") / g.scale - 18)
    )
    cards = full.withColumn("rating_status", status).select(
        *FRAME, "timestamp_sec", "title_ord", F.col("title_raw").alias("merchant_name_raw"),
        category.alias("category_raw"), "rating", "avg_price_yuan", "floor_location",
        F.when(category != "", (F.col("title_score") + F.col("c.score")) / 2).otherwise(F.col("title_score")).alias("ocr_confidence"),
        crop_top.cast("int").alias("crop_top"),
        F.least(F.lit(g.frame_height), F.greatest(crop_top + 120, crop_end)).cast("int").alias("crop_bottom"),
        "all_text", F.col("method").alias("detection_method"), "rating_status",
        F.when(category != "", "parsed").otherwise("missing").alias("category_status"),
        (F.col("y2_t") - F.col("y1_t")).alias("title_height"), "title_score", "metadata_text",
        F.when(F.col("badge"), "new_store").when(F.col("rating_status") == "unrated", "unrated")
        .when((F.col("rating_status") == "rated") & (F.col("rating") != ""), "rated").otherwise("unknown").alias("card_type"),
    )
    return cards, frame_audit(t, anchors, titles, cards, g)


def frame_audit(tokens: DataFrame, anchors: DataFrame, titles: DataFrame, cards: DataFrame, g: Geometry) -> DataFrame:
    """Per frame: tokens, candidates, anchors, and what became of them."""
    base = tokens.groupBy(*FRAME).agg(
        F.count("*").alias("ocr_tokens"), F.count_if("is_title").alias("title_candidates")
    )
    marks = anchors.groupBy(*FRAME).agg(
        F.count("*").alias("raw_anchors"),
        F.count_if(F.col("method") == "rating_anchor").alias("rating_anchors"),
        F.count_if(F.col("method") == "unrated_anchor").alias("unrated_anchors"),
        F.count_if(F.col("method") == "metadata_anchor").alias("metadata_anchors"),
    )
    gap = F.col("cy") - F.col("cy_t")
    hit = (
        anchors.join(titles.select(*FRAME, "cy_t", "y2_t"), FRAME)
        .where(gap.between(g.reach(6, 0.004), g.reach(90, 0.07)) & (F.col("y2_t") < F.col("cy")))
        .select(*FRAME, "anchor_ord").distinct().groupBy(*FRAME).agg(F.count("*").alias("matched_anchors"))
    )
    made = cards.groupBy(*FRAME).agg(
        F.count("*").alias("accepted_cards"),
        F.count_if(F.col("rating_status") == "rated").alias("rated_cards"),
        F.count_if(F.col("rating_status") == "unrated").alias("unrated_cards"),
        F.count_if(~F.col("rating_status").isin("rated", "unrated")).alias("missing_rating_cards"),
        F.count_if(F.col("category_raw") == "").alias("missing_category_cards"),
        F.count_if(F.col("floor_location") == "").alias("missing_floor_cards"),
    )
    joined = base.join(marks, FRAME, "left").join(hit, FRAME, "left").join(made, FRAME, "left").na.fill(0)
    return joined.withColumn("unmatched_anchors", F.col("raw_anchors") - F.col("matched_anchors"))


def recall_audit(per_frame: DataFrame) -> DataFrame:
    """Totals over frames and how many frames gave a card."""
    counters = [c for c, t in per_frame.dtypes if c not in FRAME and t in ("bigint", "int")]
    return per_frame.agg(
        F.count("*").alias("frames"),
        F.count_if(F.col("accepted_cards") > 0).alias("frames_with_cards"),
        F.count_if(F.col("accepted_cards") == 0).alias("frames_without_cards"),
        *[F.sum(c).alias(c) for c in counters],
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], prefix: str, digits: int, out: str) -> DataFrame:
    """Sequence ids such as ``CARD-0001`` in order within each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, F.format_string(f"{prefix}-%0{digits}d", rank))
