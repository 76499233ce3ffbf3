"""Readers: header CSVs of text columns, listing-card folders, token replays, rule tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.rules import Rule, rules_from_rows

# Columns of a listing-card file.
CARD_COLUMNS = (
    "card_id", "mall_name", "merchant_name_raw", "merchant_name_normalized", "category_raw", "rating",
    "avg_price_yuan", "floor_location", "card_type", "research_eligible", "exclusion_reason", "rating_status",
    "category_status", "detection_method", "ocr_confidence", "title_score", "title_height", "observations",
    "name_variants", "first_seen_sec", "last_seen_sec", "evidence_image", "source_video", "all_text",
    "metadata_text", "review_status", "review_reason",
)


#: Session setting for files of one row group on one machine: deal every table out to the cores as it is read.
SPREAD_KEY = "plazametrics.spreadTables"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as it is split by ``spark.sql.files.*``, or dealt out where the session asks for it."""
    df = spark.read.parquet(path)
    if spark.conf.get(SPREAD_KEY, "false") == "true":
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Header CSV, BOM tolerated, every column text and a missing value an empty text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    if columns:
        reader = reader.schema(text_schema(columns)).option("enforceSchema", False)
    df = reader.csv(path)
    return df.na.fill("", df.columns)


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """A rule table in file order; rules are configuration and live on the driver."""
    content = spark.read.text(path, wholetext=True).first()[0].lstrip("﻿")
    return rules_from_rows(csv.DictReader(io.StringIO(content)))


def read_cards(spark: SparkSession, root: str, filename: str = "merchant_cards.csv", venues: DataFrame | None = None) -> DataFrame:
    """Listing cards of all ``<root>/<city__venue__date>/<filename>`` with lineage columns.

    The venue of a file is the one its first card names; ``venues`` keeps only the listed ones.
    """
    raw = read_text_csv(spark, f"{root.rstrip('/')}/*/{filename}", CARD_COLUMNS).withColumn(
        "_path", F.col("_metadata.file_path")
    )
    return with_lineage(raw, F.col("_path"), venues).drop("_path")


def with_lineage(cards: DataFrame, path: Column, venues: DataFrame | None = None) -> DataFrame:
    # In a path a plus sign is itself; the decoder would take it for a blank.
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    named = cards.withColumn("source_folder", F.regexp_extract(plain, r"([^/]+)/[^/]+$", 1)).withColumn("source_file", plain)
    owner = named.groupBy("source_folder").agg(
        tx.clean(F.min_by("mall_name", "card_id")).alias("_owner")
    )
    kept = named.join(owner, "source_folder")
    if venues is not None:
        kept = kept.join(venues.select(tx.clean(F.col("mall_name")).alias("_owner")).distinct(), "_owner", "left_semi")
    name = tx.clean(F.col("mall_name"))
    return (
        kept.drop("_owner").withColumn("mall_name", name)
        .withColumn("mall_id", tx.stable_id("MALL", F.col("mall_name"), 10))
        .withColumn("capture_date", tx.capture_date(F.col("source_folder")))
        .withColumn("source_record_id", F.concat_ws("/", "source_folder", "card_id"))
        .withColumn("normalized_floor", tx.normalize_floor(tx.nfkc("floor_location")))
    )


LISTED = "array<struct<text:string,score:double,box:array<double>>>"


def frame_tokens(frames: DataFrame, content: str = "content") -> DataFrame:
    """Tokens of recognised frames, one row each (``token``: text, score, box) in place of the JSON ``content``.

    Two forms: a list of tokens; or parallel lists ``rec_texts``, ``rec_scores``, ``rec_boxes``, also within ``res``, as
    long as the shortest of them, texts trimmed and blank ones dropped. What is neither has no tokens.
    """
    whole = F.try_parse_json(content)
    body = F.coalesce(F.try_variant_get(whole, "$.res", "variant"), whole)
    texts, scores, boxes = (F.try_variant_get(body, f"$.rec_{c}", f"array<{t}>") for c, t in (("texts", "string"), ("scores", "double"), ("boxes", "array<double>")))
    numbers = lambda box: F.transform(box, lambda v: v.cast("int"))
    one = lambda text, score, box: F.struct(text.alias("text"), score.alias("score"), numbers(box).alias("box"))
    size = F.least(F.size(texts), F.size(scores), F.size(boxes))
    zipped = F.transform(F.arrays_zip(texts.alias("t"), scores.alias("s"), boxes.alias("b")), lambda x: one(F.trim(x["t"]), x["s"], x["b"]))
    parallel = F.filter(F.slice(zipped, F.lit(1), size), lambda x: x["text"] != "")
    listed = F.transform(F.try_variant_get(whole, "$", LISTED), lambda x: one(x["text"], x["score"], x["box"]))
    return frames.withColumn("token", F.explode(F.coalesce(listed, parallel))).drop(content)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Replay of recognised tokens: one JSON text per frame file ``frame_000123.json``, in either form."""
    files = spark.read.text(path, wholetext=True)
    framed = files.select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("video"),
        F.regexp_extract("_metadata.file_name", r"frame_(\d+)", 1).cast("bigint").alias("frame_index"),
        F.col("value").alias("content"),
    )
    return in_reading_order(frame_tokens(framed), ["video", "frame_index"])


def in_reading_order(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number tokens of a frame from top to bottom, then left to right."""
    box = F.col("token.box")
    order = Window.partitionBy(*keys).orderBy(box[1], box[0], F.col("token.text"))
    return tokens.withColumn("ord", F.row_number().over(order))


def missing_to_null(df: DataFrame) -> DataFrame:
    """Blank, ``[]`` and ``null`` texts become NULL."""
    return df.withColumns({
        c: F.when(~F.trim(c).isin("", "[]", "null"), F.col(c)) for c, t in df.dtypes if t == "string"
    })
