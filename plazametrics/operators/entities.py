"""Merging card observations into entities, and dropping frames that did not change.

Both are order-dependent folds over one video, and neither runs in one task a video. Observations whose names are not
connected by any chain of possible matches can never meet in an entity, so each component of names is folded by itself.
Frames are folded in segments, again wherever the frame that a segment starts from turns out to be another.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cards as cd
from ..functions.similarity import indel_ratio, indel_ratio_text, likeness_where
from ..functions.text import nfkc
from ..session import checkpointed
from .components import components
from .ranks import numbered

MATCH_FIELDS = ["name_key", "category_key", "rating", "floor_location", "avg_price_yuan"]


def compatible(a: str, b: str) -> bool:
    """Equal, or one side unknown."""
    return not a or not b or a == b


def same_merchant(left: dict, right: dict) -> bool:
    """Match rule on normalised names with category, rating, floor and price as evidence."""
    a, b = left["name_key"], right["name_key"]
    if not a or not b or not compatible(left["floor_location"], right["floor_location"]):
        return False
    if a == b or (min(len(a), len(b)) >= 4 and (a.startswith(b) or b.startswith(a))):
        return True
    likeness = indel_ratio_text(a, b)
    if likeness < 75:
        return False
    c, d = left["category_key"], right["category_key"]
    if not (not c or not d or c in d or d in c or indel_ratio_text(c, d) >= 60):
        return False
    if likeness >= 91:
        return True
    return (
        abs(len(a) - len(b)) <= 2
        and compatible(left["rating"], right["rating"])
        and compatible(left["avg_price_yuan"], right["avg_price_yuan"])
    )


def same_merchant_pair(left: Column, right: Column) -> Column:
    """The same rule as a column over two structs of the match fields.

    Ratios are taken only of pairs that the cheap tests leave open, and of categories only where the names are close.
    """
    def either(field: str) -> Column:
        return (left[field] == "") | (right[field] == "") | (left[field] == right[field])

    a, b, c, d = left["name_key"], right["name_key"], left["category_key"], right["category_key"]
    allowed = (a != "") & (b != "") & either("floor_location")
    sure = (a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & (F.startswith(a, b) | F.startswith(b, a)))
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    # A ratio of 75 needs three eighths of all characters in common.
    reachable = 8 * shorter >= 3 * (longer + shorter)
    ratio = likeness_where(allowed & ~sure & reachable, a, b, c, d)
    kinds = (c == "") | (d == "") | F.contains(c, d) | F.contains(d, c) | (ratio["category"] >= 60)
    close = kinds & (
        (ratio["name"] >= 91)
        | ((ratio["name"] >= 75) & (longer - shorter <= 2) & either("rating") & either("avg_price_yuan"))
    )
    return allowed & (sure | F.coalesce(close, F.lit(False)))


def with_match_keys(observations: DataFrame, simplify: dict[str, str] | None = None) -> DataFrame:
    name = cd.normalize_name(nfkc(F.trim("merchant_name_raw")), simplify)
    return observations.withColumn("name_key", F.lower(name)).withColumn(
        "category_key", F.lower(cd.category(nfkc("category_raw")))
    ).withColumn("quality", cd.observation_quality(F.struct("*")))


ENTITY_FIELDS = (
    "entity int, best_ord bigint, first_seen_sec double, last_seen_sec double, observations bigint, "
    "variants array<string>, card_type_counts map<string,bigint>"
)


class Tracker:
    """Entities of one video in the order they were first seen."""

    def __init__(self, records: list[dict] | None = None) -> None:
        self.records = records or []

    def add(self, o: dict) -> None:
        for r in self.records:
            if same_merchant(r["best"], o):
                break
        else:
            self.records.append({
                "best": o, "first_ord": o["ord"], "first": o["timestamp_sec"], "last": o["timestamp_sec"], "count": 1,
                "variants": {o["merchant_name_raw"]}, "types": {o["card_type"]: 1},
            })
            return
        r["count"] += 1
        r["last"] = o["timestamp_sec"]
        r["variants"].add(o["merchant_name_raw"])
        r["types"][o["card_type"]] = r["types"].get(o["card_type"], 0) + 1
        if o["quality"] > r["best"]["quality"]:
            r["best"] = o

    def rows(self, video) -> list[tuple]:
        return [
            (video, r["first_ord"], r["best"]["ord"], r["first"], r["last"], r["count"], sorted(r["variants"]), r["types"])
            for r in self.records
        ]


TRACKED = ["video", "ord", "timestamp_sec", "merchant_name_raw", "card_type", "quality", *MATCH_FIELDS]


def least_common(n: int) -> int:
    """Characters that a name of ``n`` shares with any name it may match by likeness.

    A ratio of 75 counts for lengths at most 2 apart, one of 91 for any: in the least case 3/8 of 2n - 2, or 91/109 of n.
    """
    return max(1, min(ceil(0.375 * (2 * n - 2) - 1e-9), ceil(0.91 / 1.09 * n - 1e-9)))


def character_frequencies(names: DataFrame, name: str = "name_key") -> dict[str, int]:
    """How many names have each character; there are no more entries than characters in Unicode."""
    each = names.select(F.explode(F.array_distinct(F.split(name, ""))).alias("c")).groupBy("c").count()
    return {r["c"]: r["count"] for r in each.collect()}


def _rare_characters(names: DataFrame) -> DataFrame:
    """The characters (with their occurrence) of a name of which a likely partner must have one, rarest first."""
    shared = names.sparkSession.sparkContext.broadcast(character_frequencies(names))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = shared.value
        for pdf in batches:
            lists = []
            for text in pdf["name_key"]:
                seen: Counter = Counter()
                every = []
                for c in text:
                    every.append((often.get(c, 0), c, seen[c]))
                    seen[c] += 1
                every.sort(key=lambda t: (t[0], t[1], -t[2]))
                lists.append([f"{c}{k}" for _, c, k in every[: len(text) - least_common(len(text)) + 1]])
            yield pdf.assign(tokens=lists)

    kind = dict(names.dtypes)["video"]
    return names.mapInPandas(tokens, f"video {kind}, v bigint, name_key string, tokens array<string>")


def likely_names(names: DataFrame) -> DataFrame:
    """u, v: pairs of names of one video that are close enough to match. ``names``: video, v (number of a name), name_key."""
    each = _rare_characters(names).select("video", "v", "name_key", "tokens", F.posexplode("tokens").alias("at", "token"))
    size = F.length("name_key")
    side = lambda mark: each.select("video", "token", *[F.col(c).alias(c + mark) for c in ("v", "name_key", "tokens", "at")], size.alias("n" + mark))
    longer, shorter = F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    need = F.when(longer - shorter <= 2, F.ceil(0.375 * (longer + shorter) - 1e-9)).otherwise(F.ceil(0.455 * (longer + shorter) - 1e-9))
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    first = F.size(F.array_intersect(F.slice("tokens_a", F.lit(1), F.col("at_a")), F.slice("tokens_b", F.lit(1), F.col("at_b")))) == 0
    met = side("_a").join(side("_b"), ["video", "token"]).where(F.col("v_a") < F.col("v_b")).where((need <= shorter) & (need <= room) & first)
    ratio = indel_ratio("name_key_a", "name_key_b")
    return met.where((ratio >= 91) | ((ratio >= 75) & (longer - shorter <= 2))).select(F.col("v_a").alias("u"), F.col("v_b").alias("v"))


def prefix_names(names: DataFrame) -> DataFrame:
    """u, v: a name and another of the video, of four characters at least, that it begins with."""
    starts = names.where(F.length("name_key") > 4).select(
        F.col("v").alias("u"), F.explode(F.transform(F.sequence(F.lit(4), F.length("name_key") - 1), lambda k: F.xxhash64("video", F.substring(F.col("name_key"), F.lit(1), k)))).alias("v")
    )
    return starts.join(names.where(F.length("name_key") >= 4).select("v"), "v", "left_semi").select("u", "v")


def name_components(observations: DataFrame) -> DataFrame:
    """video, name_key, component: names that no chain of possible matches connects are in different components.

    Names are numbered by a hash; names of equal hash merely share a component, which changes no entity.
    """
    names = checkpointed(
        observations.where(F.col("name_key") != "").select("video", "name_key").distinct()
        .select("video", F.xxhash64("video", "name_key").alias("v"), "name_key")
    )
    found = components(likely_names(names).union(prefix_names(names)))
    joined = names.join(found.withColumnRenamed("u", "v"), "v", "left")
    return joined.select("video", "name_key", F.coalesce("component", "v").alias("component"))


def merge_observations(observations: DataFrame) -> DataFrame:
    """Entities per video, numbered as first seen; ``best_ord`` points at the observation that represents each.

    Each observation joins the first entity whose current best it matches. An entity only ever holds observations of
    one component of names, so a task folds components in time order and keeps the entities of one of them. An empty
    name matches nothing.
    """
    types = dict(observations.dtypes)
    names = ["video", "first_ord", *[f.strip().split(" ")[0] for f in ENTITY_FIELDS.split(", ")][1:]]
    rows = observations.select(*TRACKED).fillna("", MATCH_FIELDS)
    found = name_components(rows).withColumnRenamed("video", "_video")
    near = rows.join(found.select("_video", "name_key", "component"), F.col("video").eqNullSafe(F.col("_video")) & (rows["name_key"] == found["name_key"]), "left").select(
        *[rows[c] for c in TRACKED], F.coalesce("component", F.xxhash64("video", "ord")).alias("component")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tracker = None, Tracker()
        for pdf in batches:
            for o in pdf.to_dict("records"):
                here = (o["video"], o["component"])
                if here != at:
                    if tracker.records:
                        yield pd.DataFrame(tracker.rows(at[0]), columns=names)
                    at, tracker = here, Tracker()
                tracker.add(o)
        if tracker.records:
            yield pd.DataFrame(tracker.rows(at[0]), columns=names)

    ordered = near.repartition("video", "component").sortWithinPartitions("video", "component", "timestamp_sec", "ord")
    entities = ordered.mapInPandas(fold, f"video {types['video']}, first_ord {types['ord']}, {ENTITY_FIELDS.removeprefix('entity int, ')}")
    placed = numbered(entities, "video", ["first_seen_sec", "first_ord"], "entity", start=0)
    return placed.select("video", F.col("entity").cast("int").alias("entity"), *names[2:])


def entity_cards(entities: DataFrame, observations: DataFrame) -> DataFrame:
    """Entities with their best observation, resolved type, eligibility and review reasons."""
    best = observations.withColumnRenamed("ord", "best_ord")
    kind = cd.card_type(F.col("card_type_counts"))
    joined = entities.join(best.withColumnRenamed("card_type", "best_card_type"), ["video", "best_ord"])
    typed = joined.withColumn("card_type", kind).withColumn("exclusion_reason", cd.exclusion_reason(F.col("card_type")))
    reasons = cd.review_reasons(
        F.struct("rating_status", "category_raw", "detection_method", "merchant_name_raw", "title_score"),
        F.col("observations"), F.col("card_type"),
    )
    return (
        typed.withColumn("research_eligible", F.col("exclusion_reason") == "")
        .withColumn("review_reasons", reasons)
        .withColumn("review_status", cd.review_status(F.col("review_reasons"), F.col("card_type")))
    )


#: Frames of a segment: as many images are in a task's memory.
SEGMENT = 256


def changed_frames(frames: DataFrame, image: str, least: float, segment: int = SEGMENT) -> DataFrame:
    """Frames whose mean absolute difference to the last *kept* frame reaches ``least``.

    The first frame of a video and its last bucket are always kept. A video is cut into segments, all of which are
    folded at once, as if their first frame were kept. Where the last kept frame before a segment turns out to be
    another, that segment alone is folded again with it, until nothing changes: then every segment has started from the
    frame that one pass over the video would have come with.
    """
    types = dict(frames.dtypes)
    placed = numbered(frames.select("video", "bucket", "frame_index", image), "video", ["bucket"], "_n", start=0)
    cut = checkpointed(placed.withColumn("_segment", F.floor(F.col("_n") / segment)))
    key = ["video", "_segment"]
    folded = f"video {types['video']}, _segment bigint, entry_n bigint, kept array<bigint>, exit_n bigint, exit {types[image]}"

    def fold(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(entries):
            return pd.DataFrame(columns=["video", "_segment", "entry_n", "kept", "exit_n", "exit"])
        rows, entry = rows.sort_values("_n"), entries.iloc[0]
        at, last = (None, None) if pd.isna(entry["entry_n"]) else (int(entry["entry_n"]), np.asarray(entry["entry"], dtype="float64"))
        start, kept = at, []
        for n, picture in zip(rows["_n"].tolist(), rows[image]):
            picture = np.asarray(picture, dtype="float64")
            if last is None or np.abs(picture - last).mean() >= least:
                at, last = n, picture
                kept.append(n)
        first = rows.iloc[0]
        return pd.DataFrame({"video": [first["video"]], "_segment": [first["_segment"]], "entry_n": pd.array([start], "Int64"), "kept": [kept], "exit_n": [at], "exit": [last]})

    def run(rows: DataFrame, entries: DataFrame) -> DataFrame:
        return checkpointed(rows.groupBy(*key).cogroup(entries.groupBy(*key)).applyInPandas(fold, folded))

    every = cut.select(*key).distinct()
    done = run(cut, every.withColumns({"entry_n": F.lit(None).cast("bigint"), "entry": F.lit(None).cast(types[image])}))
    while True:
        come = done.select("video", (F.col("_segment") + 1).alias("_segment"), F.col("exit_n").alias("entry_n"), F.col("exit").alias("entry"))
        other = come.join(done.select(*key, F.col("entry_n").alias("_had")), key).where(~F.col("entry_n").eqNullSafe(F.col("_had"))).drop("_had")
        other = checkpointed(other)
        if other.isEmpty():
            break
        again = run(cut.join(other.select(*key), key, "left_semi"), other)
        done = checkpointed(done.join(again.select(*key), key, "left_anti").unionByName(again))
    kept = done.select("video", F.explode("kept").alias("_n")).withColumn("_kept", F.lit(True))
    final = cut.groupBy("video").agg(F.max("bucket").alias("_last"))
    marked = cut.drop(image).join(kept, ["video", "_n"], "left").join(final, "video")
    return marked.where(F.col("_kept") | (F.col("bucket") == F.col("_last"))).select("video", "bucket", "frame_index")
