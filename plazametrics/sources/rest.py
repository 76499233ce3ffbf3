"""Place search over REST for the venues of a table.

The fetch function is given by the user (it owns the address and the key), so nothing here
opens a connection by itself. Searches run in at most three partitions, each waiting its
share of the service's minimum interval.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metadata import best_candidate
from ..session import checkpointed

# Parallel searches and seconds between two requests of the whole job.
MAX_PARALLEL = 3
MIN_INTERVAL = 0.35

POI_SCHEMA = "mall_name string, fetch_status string, pois string"


def search_places(
    wanted: DataFrame, fetch: Callable[[str], dict], keyword: str = "search_keyword",
    parallel: int = MAX_PARALLEL, interval: float = MIN_INTERVAL,
) -> DataFrame:
    """One row per venue with the raw answer; errors become a status, never an exception."""
    pause = interval * parallel

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for pdf in batches:
            rows = []
            for name, word in zip(pdf["mall_name"], pdf[keyword]):
                time.sleep(max(0.0, last + pause - time.monotonic()))
                last = time.monotonic()
                try:
                    answer = fetch(word)
                    ok = str(answer.get("status")) == "1"
                    status = "ok" if ok else f"api_error:{answer.get('info', 'unknown')}"
                    pois = json.dumps(answer.get("pois") or [], ensure_ascii=False)
                except Exception as error:
                    status, pois = f"request_error:{type(error).__name__}", "[]"
                rows.append((name, status, pois))
            yield pd.DataFrame(rows, columns=["mall_name", "fetch_status", "pois"])

    return wanted.select("mall_name", keyword).repartition(parallel).mapInPandas(run, POI_SCHEMA)


#: Fields of an answer's places; a field that is not a text arrives as its JSON.
PLACES = "array<struct<id:string,name:string,adname:string,address:string,location:string,typecode:string,business_area:string,biz_ext:string>>"
RECORD = (
    "poi_name", "poi_id", "district", "business_area", "address", "longitude", "latitude", "typecode", "poi_rating",
    "opening_year", "commercial_area_sqm",
)


def plain_text(value: Column) -> Column:
    """A text as it is; empty for a list or an object in its place, and for null."""
    return F.when(value.rlike(r"^\s*[\[{]"), "").otherwise(F.coalesce(value, F.lit("")))


def candidate_rows(answers: DataFrame) -> DataFrame:
    """One row per place of each answer, in the service's order (``ordinal``)."""
    each = answers.select(*[c for c in answers.columns if c != "pois"], F.posexplode(F.from_json("pois", PLACES)).alias("ordinal", "_p"))
    place = {c: F.coalesce(F.col(f"_p.{c}"), F.lit("")) for c in ("id", "name", "adname", "address", "location", "typecode")}
    return each.select(
        *[c for c in each.columns if c != "_p"], place["name"].alias("poi_name"), place["id"].alias("poi_id"), place["adname"].alias("adname"),
        place["address"].alias("address"), place["typecode"].alias("typecode"), plain_text(F.col("_p.business_area")).alias("business_area"),
        F.substring_index(place["location"], ",", 1).alias("longitude"),
        F.when(F.contains(place["location"], F.lit(",")), F.regexp_replace(place["location"], "^[^,]*,", "")).otherwise("").alias("latitude"),
        plain_text(F.get_json_object("_p.biz_ext", "$.rating")).alias("poi_rating"),
    )


def venue_records(answers: DataFrame) -> DataFrame:
    """One record per answer: its status and, where that is ``ok``, the chosen place.

    ``answers``: mall_name, search_keyword, expected_district, fetch_status, pois. A failed request or an error of the
    service keeps its status; without an acceptable place it is ``no_match``, in another district than the expected one
    ``district_mismatch:<district>``. Opening year and area are left for the seeds.
    """
    answered = answers.where(F.col("fetch_status") == "ok")
    fields = ("poi_id", "business_area", "address", "longitude", "latitude", "poi_rating")
    best = best_candidate(candidate_rows(answered), "mall_name", "search_keyword", "ordinal", answered, fields)
    every = answers.select("mall_name", "fetch_status").join(best.withColumnRenamed("adname", "district"), "mall_name", "left")
    status = F.when(F.col("fetch_status") == "ok", F.col("status")).otherwise(F.col("fetch_status"))
    known = set(best.columns) | {"district"}
    return every.select("mall_name", status.alias("search_status"), *[F.coalesce(F.col(c) if c in known else F.lit(None).cast("string"), F.lit("")).alias(c) for c in RECORD])


def search_records(wanted: DataFrame, fetch: Callable[[str], dict], aliases: DataFrame | None = None, **pace) -> DataFrame:
    """Search every venue once and return its record with the time of the search.

    ``aliases`` may give a venue another keyword and the district it is expected in. Answers are written before they are
    read, so no venue is searched again when a result is.
    """
    named = wanted.select("mall_name").distinct()
    if aliases is not None:
        named = named.join(aliases.select("mall_name", "search_keyword", "expected_district").dropDuplicates(["mall_name"]), "mall_name", "left")
    else:
        named = named.withColumns({"search_keyword": F.lit(""), "expected_district": F.lit("")})
    asked = checkpointed(named.select(
        "mall_name", F.coalesce(F.nullif(F.trim("search_keyword"), F.lit("")), F.col("mall_name")).alias("search_keyword"),
        F.trim(F.coalesce("expected_district", F.lit(""))).alias("expected_district"),
    ))
    answers = checkpointed(search_places(asked, fetch, **pace).withColumn("fetched_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")))
    records = venue_records(asked.join(answers.drop("fetched_at"), "mall_name"))
    return records.join(answers.select("mall_name", "fetched_at"), "mall_name")
