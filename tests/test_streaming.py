from __future__ import annotations

import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from plazametrics.operators import entities
from plazametrics.streaming import frames as streams

from .test_cards import SCHEMA, frame, observation


def drain(df, mode, name, rows):
    """The output once all input rows are read; a query on processing time never runs out of batches."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    read, until = {}, time.time() + 100
    while sum(read.values()) < rows and time.time() < until and query.isActive:
        read.update((p["batchId"], p["numInputRows"]) for p in query.recentProgress)
        time.sleep(0.2)
    query.stop()
    assert query.exception() is None and sum(read.values()) == rows
    return df.sparkSession.table(name)


def test_sharpest_frames_of_a_stream(spark, tmp_path):
    rows = spark.range(40).select(
        F.lit("v").alias("video"), F.col("id").alias("frame_index"), (F.col("id") % 7).cast("double").alias("sharpness"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
    )
    rows.write.parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "frames"))
    got = {r["bucket_start"].second: r["frame_index"] for r in drain(streams.sharpest_frames(stream, 10.0), "update", "sharpest", 40).collect()}
    assert got == {0: 6, 10: 13, 20: 20, 30: 34}


@pytest.mark.parametrize("keep", [None, timedelta(hours=1)])
def test_entity_stream_matches_batch(spark, tmp_path, keep):
    spark.conf.set(streams.STATE_STORE, streams.ROCKS)
    names = ["river cafe", "river cafu", "tall tower books", "tall tower book", "", "onyx"]
    rows = [observation(names[i * 7 % 6], "food", "L1", at=float(i), order=i, ocr_confidence=0.5 + (i * 5 % 9) / 100) for i in range(24)]
    keyed = frame(spark, rows).select(*entities.TRACKED)
    want = {r["entity"]: (r["observations"], r["best_ord"], r["variants"], r["card_type_counts"]) for r in entities.merge_observations(keyed).collect()}
    for part in range(3):
        keyed.where((F.col("ord") >= part * 8) & (F.col("ord") < part * 8 + 8)).coalesce(1).write.mode("append").parquet(str(tmp_path / "obs"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    stream = spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "obs"))
    out = drain(streams.merge_observations(stream, keep), "update", f"entities_{keep is None}", 24).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {}
    for r in sorted(out, key=lambda r: r["observations"]):
        got[r["entity"]] = (r["observations"], r["best_ord"], r["variants"], r["card_type_counts"])
    assert got == want and SCHEMA
    # A batch returns what it touched, not all that is known.
    assert len(out) < 3 * len(want)
