"""Line dedup by a tree of log templates.

A line's path in the tree is its number of tokens and its first ``depth`` tokens; tokens with a digit are variable
fields and count as one wildcard. Under a path that many documents share, a position is constant where more than half
of the path's lines have the same token there and variable elsewhere; a line's template is its constants. Templates
that recur across documents are dropped from every document, if most of the line is constant.

Counts are over different texts, and near copies count once: a template must come with enough groups of texts that are
linked by a Jaccard similarity of shingle sets of ``ALIKE`` or more, so that the lines which a group of near copies has in
common are no boilerplate: removing those copies is another operator's task. Where a template's lines are a quarter of
a text's tokens or more, the text is compared without them, so that a long passage does not make unrelated texts alike;
a text has four such templates at most. A text that has no other lines is compared whole.

Empty lines stay. A null text stays null. Repeated rows are treated alike. All other columns pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import minhash
from .shared import BitFilter, mixed, prefix_hashes, signed, slice_hashes, slices, stored, text_bytes, text_key

DEPTH = 3
MIN_DOCUMENTS = 10
CONSTANT = 0.6
#: Texts of this Jaccard similarity are near copies; such a pair shares none of 80 bands of 3 registers with probability 2e-5.
ALIKE = 0.5
BANDS, ROWS = 80, 3
#: A template with this share of a text's tokens is left out where the text is compared.
LARGE = 0.25
WILDCARD = np.uint64(0x2A3C2A3E2A3C2A3E)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


class Lines:
    """Lines of a slice of texts with their token hashes; lines without tokens are left out."""

    def __init__(self, array: pa.Array, depth: int):
        data, offsets = text_bytes(array)
        n = len(data)
        inside = ~_SPACE[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        filled = offsets[:-1][np.diff(offsets) > 0]
        before[filled] = False
        after[filled[1:] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        hashes = mixed(slice_hashes(prefix_hashes(data), starts, ends))
        self.tokens = np.where(digits[ends] > digits[starts], WILDCARD, hashes)
        # Numbers of lines run through the slice: a new one after each line break and with each text.
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, starts) + np.searchsorted(offsets[1:], starts, "right")
        new = np.ones(len(starts), bool)
        new[1:] = line[1:] != line[:-1]
        self.first = np.append(np.flatnonzero(new), len(starts))
        at = starts[new]
        self.doc = np.searchsorted(offsets, at, "right") - 1
        # Number of the line within its text.
        self.number = np.searchsorted(breaks, at) - np.searchsorted(breaks, offsets[self.doc])
        self.length = np.diff(self.first)
        path = mixed(self.length.astype(np.uint64))
        for k in range(depth):
            deep = self.length > k
            path[deep] = mixed(path[deep] * np.uint64(31) + self.tokens[self.first[:-1][deep] + k])
        self.path = path


def _paths(batches, depth: int):
    for part in slices(batches):
        lines = Lines(part.column(1), depth)
        pair = np.unique(np.stack([lines.doc.astype(np.uint64), lines.path]), axis=1)
        doc = pair[0].astype(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(signed(pair[1].copy()))], names=["key", "path"])


def _lines_of(batches, depth: int, known: BitFilter):
    for part in slices(batches):
        lines = Lines(part.column(1), depth)
        tokens_of = np.bincount(lines.doc, lines.length, minlength=part.num_rows).astype(np.int64)
        hit = np.flatnonzero(known.has(lines.path))
        doc = lines.doc[hit]
        ends = np.concatenate([[0], np.cumsum(lines.length[hit])]).astype(np.int32)
        tokens = np.concatenate([lines.tokens[lines.first[i] : lines.first[i + 1]] for i in hit.tolist()] or [lines.tokens[:0]])
        yield pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(doc)), pa.array(tokens_of[doc]), pa.array(signed(lines.path[hit])), pa.array(lines.number[hit], pa.int32()),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(tokens)))],
            names=["key", "n_text", "path", "line", "tokens"],
        )


def _frequent(rows: DataFrame, by: list[str], min_documents: int) -> DataFrame:
    """Those ``by`` that enough texts have; ``rows``: one per text and ``by``."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents).select(*by)


def _recurring(named: DataFrame, texts: DataFrame, min_documents: int) -> DataFrame:
    """Templates that enough groups of near copies have; ``named``: key, n_text, line, n and template of each line."""
    frequent = _frequent(named.select("key", "template").distinct(), ["template"], min_documents)
    held = (
        named.join(frequent, "template")
        .groupBy("key", "template").agg(F.sort_array(F.collect_set("line")).alias("lines"), F.sum("n").alias("part"), F.first("n_text").alias("n_text"))
    )
    large = (F.col("part") >= LARGE * F.col("n_text")) & (F.col("part") < F.col("n_text"))
    held = stored(held.select("key", "template", F.when(large, F.col("template")).alias("without"), F.when(large, F.col("lines")).alias("lines")), "held")
    wanted = held.groupBy("key").agg(F.collect_set(F.struct("without", "lines")).alias("units"))
    apart = texts.dropDuplicates(["key"]).join(wanted, "key").select("key", "text", F.inline("units"))
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("lines", i)), "\n")
    units = stored(apart.select("key", "without", F.when(F.col("lines").isNull(), F.col("text")).otherwise(rest).alias("text")), "units")
    groups = minhash.grouped(units.select(F.lit(None).cast("long").alias("doc_id"), "text"), ALIKE, bands=BANDS, rows=ROWS).select("text_key", "leader").distinct()
    named_units = units.select("key", "without", text_key("text").alias("text_key")).join(groups, "text_key")
    of = named_units.withColumnsRenamed({"key": "_key", "without": "_without"})
    return _frequent(
        held.join(of, (F.col("key") == F.col("_key")) & F.col("without").eqNullSafe(F.col("_without"))).select("template", "leader").distinct(),
        ["template"], min_documents,
    )


def recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, depth: int = DEPTH, constant: float = CONSTANT, text: str = "text") -> DataFrame:
    """(key, lines): for each text with recurring templates its md5 and the numbers of their lines."""
    sc = docs.sparkSession.sparkContext
    texts = docs.where(F.col(text).isNotNull()).select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("key"), F.col(text).cast("string").alias("text"))
    paths = texts.mapInArrow(lambda b: _paths(b, depth), "key binary, path bigint").distinct()
    hot = stored(_frequent(paths, ["path"], min_documents), "paths")
    known = BitFilter.of(hot, "path")
    shared = sc.broadcast((known.bits, known.log2))
    lines = texts.mapInArrow(lambda b: _lines_of(b, depth, BitFilter(*shared.value)), "key binary, n_text bigint, path bigint, line int, tokens array<bigint>")
    lines = stored(lines.dropDuplicates(["key", "line"]).join(hot, "path"), "lines")

    totals = lines.groupBy("path").agg(F.count(F.lit(1)).alias("total"))
    place = lines.select("path", F.posexplode("tokens").alias("at", "token")).groupBy("path", "at", "token").agg(F.count(F.lit(1)).alias("n"))
    commonest = place.groupBy("path", "at").agg(F.max(F.struct("n", "token")).alias("most"))
    constants = (
        commonest.join(totals, "path").select("path", F.struct("at", F.when(F.col("most.n") > 0.5 * F.col("total"), F.col("most.token")).alias("token")).alias("x"))
        .groupBy("path").agg(F.sort_array(F.collect_list("x")).alias("constants"))
    )
    # All lines of a path have as many tokens, so the list has an entry for each position.
    held = F.transform("tokens", lambda t, i: F.when((i < depth) | (F.get("constants", i)["token"] == t), t))
    named = (
        lines.join(constants, "path")
        .select("key", "n_text", "path", "line", F.size("tokens").alias("n"), held.alias("held"))
        .select("key", "n_text", "line", "n", F.xxhash64("path", "held").alias("template"), (F.size(F.filter("held", lambda x: x.isNotNull())) >= constant * F.col("n")).alias("firm"))
        .where("firm").select("key", "n_text", "line", "n", "template")
    )
    named = stored(named, "templates")
    return named.join(_recurring(named, texts, min_documents), "template").groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _without(texts: pa.Array, lines: pa.Array) -> tuple[list, list, list]:
    kept, counts, dropped = [], [], []
    for text, gone in zip(texts.to_pylist(), lines):
        parts = None if text is None else text.split("\n")
        counts.append(0 if text is None else len(parts))
        gone = gone.values.to_numpy() if gone.is_valid else []
        dropped.append(len(gone))
        if len(gone):
            on = np.ones(len(parts), bool)
            on[gone] = False
            text = "\n".join(parts[i] for i in np.flatnonzero(on).tolist())
        kept.append(text)
    return kept, counts, dropped


def without_recurring_lines(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``, and two more columns: n_lines, n_dropped."""
    found = recurring_lines(docs.select(F.col(text).alias("text")), **options).withColumnRenamed("key", "_key").withColumnRenamed("lines", "_lines")
    joined = docs.join(found, F.unhex(F.md5(F.col(text).cast("binary"))) == F.col("_key"), "left").drop("_key")
    names = docs.columns
    at = names.index(text)

    def rewritten(batches):
        for part in slices(batches, text):
            kept, counts, dropped = _without(part.column(at), part.column(len(names)))
            columns = [*part.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())]
            columns[at] = pa.array(kept, part.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_lines", "n_dropped"])

    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return joined.mapInArrow(rewritten, schema)
