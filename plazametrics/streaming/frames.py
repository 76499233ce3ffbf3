"""Frame selection and entity merging on unbounded input.

The batch operators fold one video in time order; here Spark keeps the fold's state
between micro-batches. A checkpoint folder makes a restarted query skip finished files.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.entities import ENTITY_FIELDS, TRACKED, Tracker

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sharpest_frames(frames: DataFrame, seconds: float = 1.0, lateness: str = "10 seconds") -> DataFrame:
    """The sharpest frame of each tumbling window per video; needs a TIMESTAMP ``ts`` column."""
    timed = frames.withWatermark("ts", lateness)
    return timed.groupBy("video", F.window("ts", f"{seconds} seconds")).agg(
        F.max_by(F.struct("frame_index", "sharpness"), F.struct(F.col("sharpness"), -F.col("frame_index"))).alias("best")
    ).select("video", F.col("window.start").alias("bucket_start"), "best.*")


class EntityState(StatefulProcessor):
    """Entities of a video, each an entry of its own: only those that a batch touches are written again."""

    def __init__(self, best_types: dict[str, str], keep: timedelta | None) -> None:
        self.best_types, self.keep = best_types, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        best = ", ".join(f"best_{c} {self.best_types[c]}" for c in TRACKED[1:])
        kept = int(self.keep.total_seconds() * 1000) if self.keep else None
        self.entities = handle.getMapState(
            "entities", "entity int",
            f"{best}, first_ord {self.best_types['ord']}, first double, last double, seen bigint, variants array<string>, types map<string,bigint>", kept,
        )
        self.next = handle.getValueState("next", "entity int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fields = TRACKED[1:]
        known = sorted((k[0], tuple(v)) for k, v in self.entities.iterator())
        tracker = Tracker([
            {"entity": e, "best": dict(zip(fields, v)), "first_ord": v[len(fields)], "first": v[-5], "last": v[-4], "count": v[-3], "variants": set(v[-2]), "types": dict(v[-1])}
            for e, v in known
        ])
        before = [r["count"] for r in tracker.records]
        seen = pd.concat(list(rows)).sort_values(["timestamp_sec", "ord"], kind="stable")
        for o in seen.to_dict("records"):
            tracker.add(o)
        number = self.next.get()[0] if self.next.exists() else 0
        out = []
        for place, r in enumerate(tracker.records):
            if place < len(before) and r["count"] == before[place]:
                continue
            if "entity" not in r:
                r["entity"], number = number, number + 1
            best = tuple(x.item() if hasattr(x, "item") else x for x in (r["best"][c] for c in fields))
            self.entities.updateValue((r["entity"],), (*best, int(r["first_ord"]), float(r["first"]), float(r["last"]), int(r["count"]), sorted(r["variants"]), r["types"]))
            out.append((key[0], r["entity"], r["best"]["ord"], r["first"], r["last"], r["count"], sorted(r["variants"]), r["types"]))
        self.next.update((number,))
        yield pd.DataFrame(out, columns=["video", *[f.strip().split(" ")[0] for f in ENTITY_FIELDS.split(", ")]])

    def close(self) -> None:
        pass


def merge_observations(observations: DataFrame, keep: timedelta | None = None) -> DataFrame:
    """Entities per video as observations arrive (update mode); a batch returns the entities that it touched.

    Observations of a micro-batch are taken in time order; the result matches the batch operator when batches arrive in
    time order. ``keep``: entities not seen for this long are forgotten, and their numbers not given again. The size of
    a micro-batch is bounded by its source (``maxFilesPerTrigger``). Needs the RocksDB state store.
    """
    if observations.sparkSession.conf.get(STATE_STORE, "") != ROCKS:
        raise RuntimeError(f"set {STATE_STORE} to {ROCKS}")
    rows = observations.select(*TRACKED).fillna("", [c for c in TRACKED if c.endswith("_key")] + ["rating", "floor_location", "avg_price_yuan"])
    types = dict(rows.dtypes)
    return rows.groupBy("video").transformWithStateInPandas(
        EntityState({c: types[c] for c in TRACKED}, keep), f"video {types['video']}, {ENTITY_FIELDS}", "Update", "ProcessingTime" if keep else "None"
    )
