"""Document fingerprints of closed syncmers.

A k-mer of bytes is a closed syncmer if the least of its inner substrings of ``s`` bytes (by hash) is its first or its
last. Whether a k-mer is chosen depends on itself alone, so equal passages have the same anchors in any document, and
the distance between two anchors is the same too. A fingerprint lists the ``size`` anchors of least hash with their
byte positions, the first of equal ones. Likeness of two fingerprints: of the least ``size`` anchors of both together,
the share that both have at the commonest shift of positions.

A text without any closed syncmer, such as one shorter than k bytes, has one anchor, the whole text; null counts as
empty. Equal texts have equal fingerprints
and likeness 1. Repeated rows are treated one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mixed, prefix_hashes, slice_hashes, slices, text_bytes

K, S = 16, 6
SIZE = 64


def anchors(array: pa.Array, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (32 bits) and byte position in its text of every closed syncmer, and the first of each text."""
    data, offsets = text_bytes(array)
    n = len(data)
    prefix = prefix_hashes(data)
    m = max(n - s + 1, 0)
    inner = mixed(slice_hashes(prefix, np.arange(m), np.arange(m) + s))
    count = max(n - k + 1, 0)
    span = k - s + 1
    # Least inner hash of every window by doubling: two overlapping halves of a power of two cover it.
    least, width = inner, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    if count:
        least = np.minimum(least[:count], least[span - width : span - width + count])
        chosen = (inner[:count] == least) | (inner[span - 1 : span - 1 + count] == least)
        room = np.repeat(offsets[1:], np.diff(offsets))[:count] - np.arange(count)
        at = np.flatnonzero(chosen & (room >= k))
    else:
        at = np.zeros(0, np.int64)
    counts = np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])
    # A text without any is its own only anchor. Several empty texts may begin at one place.
    bare = np.flatnonzero(counts == 0)
    where = np.searchsorted(at, offsets[bare])
    length = np.insert(np.full(len(at), k), where, np.diff(offsets)[bare])
    at = np.insert(at, where, offsets[bare])
    first = np.concatenate([[0], np.cumsum(np.maximum(counts, 1))])
    begins = np.repeat(offsets[:-1], np.diff(first))
    hashes = mixed(slice_hashes(prefix, at, at + length) + length.astype(np.uint64)) >> np.uint64(32)
    return hashes, at - begins, first


def sketches(array: pa.Array, size: int = SIZE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the least hashes, ascending, and their first positions."""
    hashes, position, first = anchors(array)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        h = hashes[a:b]
        if b - a > 4 * size:
            # Positions ascend, so a stable choice keeps the first of equal hashes.
            near = np.flatnonzero(h <= np.partition(h, 2 * size)[2 * size])
            h, p = h[near], position[a:b][near]
            if len(np.unique(h)) < size:
                h, p = hashes[a:b], position[a:b]
        else:
            p = position[a:b]
        least, at = np.unique(h, return_index=True)
        out.append((least[:size], p[at[:size]]))
    return out


def written(sketch: tuple[np.ndarray, np.ndarray]) -> str:
    """16 hex digits for each anchor: hash, position."""
    return (sketch[0] << np.uint64(32) | sketch[1].astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(">u8").tobytes().hex()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)
    return both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def likeness(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], size: int = SIZE) -> float:
    both, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    union = np.union1d(one[0], two[0])[:size]
    shared = both <= union[-1]
    shift = (one[1][i] - two[1][j])[shared]
    if not len(shift):
        return 0.0
    return float(np.unique(shift, return_counts=True)[1].max() / len(union))


def fingerprints(docs: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """``docs`` with one more column, ``fingerprint``."""
    names = docs.columns
    at = names.index(text)

    def made(batches):
        for part in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([written(x) for x in sketches(part.column(at), size)], pa.string())], names=[*names, "fingerprint"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(made, f"{columns}, fingerprint string")


def with_next(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id and text in descending doc_id in partitions, each row before the one that follows it, the last of a
    partition followed by a copy (``own`` false) of the first row of the next partition that has rows.

    Cuts between partitions are quantiles of the ids alone; the few rows at the cuts are found by a second look at the
    ids and sent to both partitions, so that no row's text passes through one place.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Larger sort keys come later; rows without id come last.
    key = F.coalesce(-F.col("doc_id").cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)"))
    tie = F.xxhash64("text")
    bounds = chosen.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100_000)).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)
    low = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(F.size(F.filter(low, lambda b: b > F.col("doc_id"))))
    placed = chosen.withColumn("part", part).withColumn("order", F.struct(key.alias("key"), tie.alias("tie")))
    heads = sorted((r["part"], r["least"]) for r in placed.groupBy("part").agg(F.min("order").alias("least")).collect())
    if not heads:
        return placed.select("part", "doc_id", "text", "order", F.lit(True).alias("own")).limit(0)
    # One row a partition: whose end its first row belongs to. The last partition is followed by the first.
    ends = [(p, least["key"], least["tie"], heads[k - 1][0]) for k, (p, least) in enumerate(heads)]
    heads_df = spark.createDataFrame(ends, "_part int, _key decimal(20,0), _tie bigint, _to int")
    is_head = (F.col("part") == F.col("_part")) & (F.col("order.key") == F.col("_key")) & (F.col("order.tie") == F.col("_tie"))
    own = placed.withColumn("own", F.lit(True))
    copies = placed.join(F.broadcast(heads_df), is_head).dropDuplicates(["part"]).select(F.col("_to").alias("part"), "doc_id", "text", "order", F.lit(False).alias("own"))
    own = own.select("part", "doc_id", "text", "order", "own")
    both = own.unionByName(copies)
    return both.repartitionById(parts + 1, F.col("part")).sortWithinPartitions(F.desc("own"), "order.key", "order.tie").select("part", "doc_id", "text", "own")


def compared(docs: DataFrame, size: int = SIZE, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, whose last half is the start of the next document's.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Next is in descending
    doc_id, rows without id last, ties in the order of a hash of the text; the last is followed by the first.
    """

    def rows(batches):
        held = None
        for part in slices(batches, "text"):
            if held is not None:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            yield from _compared(part, size)
            held = part.slice(part.num_rows - 1)

    def _compared(part, size):
        texts = part.column(2).to_pylist()
        ids, own = part.column(1).to_pylist(), part.column(3).to_pylist()
        n = sum(own[: len(texts) - 1])
        if not n:
            return
        edited = []
        for one, two in zip(texts[:n], texts[1:]):
            half = len(one) // 2
            edited.append(one[: len(one) - half] + two[:half])
        plain, changed = sketches(part.column(2).slice(0, n + 1), size), sketches(pa.array(edited, pa.string()), size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
             pa.array([written(x) for x in plain[:n]], pa.string()), pa.array([written(x) for x in changed], pa.string()),
             pa.array([likeness(a, b, size) for a, b in zip(plain, changed)], pa.float64()), pa.array([likeness(a, b, size) for a, b in zip(plain, plain[1:])], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, doc, text).mapInArrow(rows, schema)
