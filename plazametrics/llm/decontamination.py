"""Benchmark decontamination by a prefix-filtered set join.

A window is ``size`` consecutive words of an item, or all words of a shorter item. Windows and documents are sets of
positioned shingles. Containment must be whole, so one necessary token per window suffices as its prefix: the shingle
that fewest documents have. Documents and windows meet on that shingle only; its offset in the window gives the place
at which the window would have to start (positional bound), the document's length bounds it on the other side, and
the words themselves are compared at the end.

Nulls: a text that is null or has no words has no windows and is never hit. Items without item_id are matched like
others but add nothing to the list of ids. Repeated rows are judged one by one. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BitFilter, Words, shingle_hashes, shingle_starts, signed, slices, stored

WINDOW = 10
SHINGLE = 5


def item_windows(items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, text: str = "text", item: str = "item_id") -> DataFrame:
    """(item_id, window, n, offset, hash): every shingle of every window; windows shorter than ``shingle`` have one."""
    schema = "item_id string, window string, n int, offset int, k int, hash long"

    def windows(batches):
        for part in slices(batches):
            words, ids = Words(part.column(1)), part.column(0).to_pylist()
            hashes = words.hashes()
            rows = []
            for i, name in enumerate(ids):
                first, count = int(words.first[i]), int(words.counts[i])
                n = min(size, count)
                for at in range(first, first + count - n + 1 if n else 0):
                    k = min(shingle, n)
                    starts = np.arange(at, at + n - k + 1)
                    said = words.text(at, at + n)
                    rows += [(name, said, n, o, k, h) for o, h in enumerate(signed(shingle_hashes(hashes, starts, k)).tolist())]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                names=["item_id", "window", "n", "offset", "k", "hash"],
            )

    chosen = items.select(F.col(item).cast("string").alias("item_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(windows, schema)


def _candidates(docs: DataFrame, known: BitFilter, lengths: list[int], size: int) -> DataFrame:
    """Per document its words' count and the places whose shingle may be one of an item's, with the words around."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((known.bits, known.log2))
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("back", pa.int32()), ("hash", pa.int64()), ("around", pa.string())]))

    def found(batches):
        known = BitFilter(*shared.value)
        for part in slices(batches):
            words = Words(part.column(part.num_columns - 1))
            hashes, lists = words.hashes(), [[] for _ in range(part.num_rows)]
            for k in lengths:
                starts = shingle_starts(words.first, k)
                shingles = shingle_hashes(hashes, starts, k)
                hit = known.has(shingles)
                at, codes = starts[hit], signed(shingles[hit]).tolist()
                for doc, word, code in zip((np.searchsorted(words.first, at, "right") - 1).tolist(), at.tolist(), codes):
                    first, end = int(words.first[doc]), int(words.first[doc + 1])
                    low = max(first, word - (size - k))
                    lists[doc].append({"pos": word - first, "back": word - low, "hash": code, "around": words.text(low, min(end, word + size))})
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(words.counts, pa.int64()), pa.array(lists, kind)], names=[*part.schema.names[:-1], "n_words", "places"])

    schema = ", ".join(f"{n} {t}" for n, t in docs.dtypes[:-1]) + ", n_words long, places array<struct<pos:int,back:int,hash:long,around:string>>"
    return docs.mapInArrow(found, schema)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted ids as strings, joined by commas), text_key.

    The items' shingles reach the tasks as a bit set of fixed size; items, windows and candidates are joined.
    """
    windows = stored(item_windows(items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")), size, shingle), "windows")
    known = BitFilter.of(windows, "hash")
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())
    chosen = docs.select(F.col(doc).alias("doc_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_key"), F.col(text).cast("string").alias("text"))
    places = stored(_candidates(chosen, known, lengths, size).withColumn("row", F.monotonically_increasing_id()), "places")

    place = places.where(F.size("places") > 0).select("row", "n_words", F.inline("places"))
    rarity = place.groupBy("hash").agg(F.count_distinct("row").alias("documents"))
    # A shingle that no document has proves that its window occurs nowhere.
    prefix = (
        windows.select("window", "n", "offset", "hash").distinct().join(rarity, "hash", "left")
        .groupBy("window", "n").agg(F.min(F.struct(F.coalesce("documents", F.lit(0)).alias("documents"), "offset", "hash")).alias("least"))
        .where("least.documents > 0").select("window", "n", "least.offset", "least.hash")
    )
    start = F.col("pos") - F.col("offset")
    matches = (
        place.join(prefix, "hash")
        .where((start >= 0) & (start + F.col("n") <= F.col("n_words")) & (F.col("back") >= F.col("offset")))
        .where(F.array_join(F.slice(F.split("around", " "), F.col("back") - F.col("offset") + 1, F.col("n")), " ") == F.col("window"))
        .select("row", start.alias("start"), (start + F.col("n")).alias("end"), "window")
    )
    covered = matches.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")).select("row", F.expr(
        "aggregate(spans, named_struct('to', 0, 'n', 0L), (a, x) -> named_struct("
        "'to', greatest(a.to, x.end), 'n', a.n + greatest(0, x.end - greatest(x.start, a.to)))).n"
    ).alias("n_hit"))
    listed = (
        matches.select("row", "window").distinct().join(windows.where("item_id is not null").select("window", "item_id").distinct(), "window")
        .groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
        .select("row", F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("items"))
    )
    return (
        places.select("row", "doc_id", "n_words", "text_key").join(covered, "row", "left").join(listed, "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), "text_key")
    )


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns."""
    dirty = contamination(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")), items, **options)
    dirty = dirty.where("n_hit > 0").select(F.col("text_key").alias("_dirty")).distinct()
    return docs.join(dirty, F.md5(F.coalesce(text, F.lit("")).cast("binary")) == F.col("_dirty"), "left_anti")
