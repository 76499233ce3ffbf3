"""Token ids as Parquet files that can be read selectively.

Documents are ordered by doc_id into consecutive parts; each part is one task and one file, rows in order. A row has
doc_id, place (of the document in its part), offset (ids before it in its part), n_tokens and ids, a list column.
Ids are dictionary-encoded, the numbers beside them delta-encoded (format version 2 without a dictionary); the sizes of
row groups and pages are parameters, and page indexes let a reader that asks for some documents, or only for the
numbers, skip all other pages.

Texts are encoded by the given tokenizer. Where a text has only characters whose normal form is plain (ASCII and the
Latin letters up to U+00FF), it is cut at the tokenizer's own word borders, and each distinct piece is encoded once in
a task; any other text, and one that contains a special token's name, is encoded whole.

A null text is empty: only the end id. Rows without doc_id come first. Repeated rows are written one by one, in any
order among themselves. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .byte_bpe import gathered
from .pretokens import character_classes, cuts_without_space
from .shared import OTHER_BASE, mixed, prefix_hashes, slice_hashes, slices, text_bytes

END_ID = 1
#: Distinct pieces that a task remembers before it starts anew.
REMEMBERED = 400_000
#: Pieces that are encoded as one text.
PIECES_AT_ONCE = 1000
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
_ROWS = "doc_id bigint, place bigint, offset bigint, n_tokens bigint, ids array<int>"


class PieceEncoder:
    """Encodes texts by their distinct pieces; exact for texts that :meth:`plain` accepts."""

    def __init__(self, json_text: str, classes: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = np.frombuffer(classes, np.uint8)
        self._forget()

    def _forget(self):
        # Names of the known pieces in ascending order, other names to tell them by, and where their ids are.
        self.names, self.others, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ids_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def plain(self, array: pa.Array) -> np.ndarray:
        """Whether each text has only characters that stand for themselves after normalisation, but for case."""
        data, offsets = text_bytes(array)
        before = np.zeros(len(data), np.uint8)
        before[1:] = data[:-1]
        letter = (before == 0xC3) & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
        fine = ((data >= 0x20) & (data < 0x7F)) | (data == 9) | (data == 10) | (data == 13) | (data == 0xC3) | letter
        wrong = np.concatenate([[0], np.cumsum(~fine)])
        out = wrong[offsets[1:]] == wrong[offsets[:-1]]
        for name in self.special:
            out &= ~pc.fill_null(pc.match_substring(array, name), False).to_numpy(zero_copy_only=False)
        return out

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin."""
        plain = self.plain(array)
        if plain.all():
            return self._by_pieces(array)
        flat, offsets = self._by_pieces(array.filter(pa.array(plain)))
        whole = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch([t or "" for t in array.filter(pa.array(~plain)).to_pylist()], add_special_tokens=False)]
        lists, k, w = [], 0, 0
        for is_plain in plain.tolist():
            if is_plain:
                lists.append(flat[offsets[k] : offsets[k + 1]])
                k += 1
            else:
                lists.append(whole[w])
                w += 1
        return np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece, from one text of all of them with blanks between, cut at its words again."""
        e = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        ids, words = e.ids, e.word_ids
        cuts = [0, *(i for i in range(1, len(words)) if words[i] != words[i - 1]), len(words)]
        if len(cuts) - 1 != len(pieces):
            return [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _by_pieces(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(array)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(array) + 1, np.int64)
        data = data.copy()
        data[(data >= 65) & (data <= 90)] += 32
        capital = np.zeros(len(data), bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        data[capital] += 32
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        begins = np.searchsorted(chars, offsets)
        first = np.zeros(len(points), bool)
        first[begins[:-1][begins[:-1] < len(points)]] = True
        starts, ends = cuts_without_space(points, first, self.classes)
        low, high = chars[starts], np.append(chars, len(data))[ends]
        names = mixed(slice_hashes(prefix_hashes(data), low, high))
        distinct, at, inverse = np.unique(names, return_index=True, return_inverse=True)
        other = mixed(slice_hashes(prefix_hashes(data, OTHER_BASE), low[at], high[at], OTHER_BASE))
        if len(self.names) > REMEMBERED:
            self._forget()
        codes = self._places(distinct, other, lambda new: [data[a:b].tobytes().decode() for a, b in zip(low[at[new]].tolist(), high[at[new]].tolist())])
        here = codes[inverse]
        ends_of = np.concatenate([[0], np.cumsum(np.diff(self.ids_at)[here])])
        return gathered(self.ids, self.ids_at, here), ends_of[np.searchsorted(starts, begins)]

    def _places(self, names: np.ndarray, others: np.ndarray, pieces) -> np.ndarray:
        """Where the ids of the named pieces are; ``names`` ascend. New pieces are encoded and remembered."""
        at = np.searchsorted(self.names, names)
        known = at < len(self.names)
        known[known] = self.names[at[known]] == names[known]
        out = np.full(len(names), -1)
        out[known] = np.where(self.others[at[known]] == others[known], self.place[at[known]], -1)
        new = np.flatnonzero(out < 0)
        if len(new):
            lists = []
            wanted = pieces(new)
            for k in range(0, len(wanted), PIECES_AT_ONCE):
                lists += self._ids(wanted[k : k + PIECES_AT_ONCE])
            out[new] = len(self.ids_at) - 1 + np.arange(len(new))
            self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + np.cumsum([len(x) for x in lists])])
            self.ids = np.concatenate([self.ids, np.array([i for x in lists for i in x], np.int32)])
            # A piece whose name another has already is encoded again each time.
            own = new[~known[new]]
            self.others, self.place = np.insert(self.others, at[own], others[own]), np.insert(self.place, at[own], out[own])
            self.names = np.insert(self.names, at[own], names[own])
        return out


def ordered_parts(docs: DataFrame, by: str, parts: int) -> DataFrame:
    """``docs`` in ``parts`` partitions of consecutive ``by``, each in ascending order; null comes first."""
    bounds = docs.agg(F.percentile_approx(by, [k / parts for k in range(1, parts)], 100_000)).first()[0] if parts > 1 else None
    low = F.array(*[F.lit(b) for b in sorted(set(bounds or []))]) if bounds else F.array().cast("array<bigint>")
    part = F.coalesce(F.size(F.filter(low, lambda b: b < F.col(by))), F.lit(0)) if bounds else F.lit(0)
    return docs.withColumn("_part", part).repartitionById(parts, F.col("_part")).sortWithinPartitions(F.col(by).asc_nulls_first())


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, doc: str = "doc_id", text: str = "text") -> None:
    """Encode, append ``end_id`` to each document, and write in ascending doc_id order: one folder part=k per part."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast((file.read(), character_classes()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered_parts(docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id", parts)

    def encoded(batches):
        encoder, place, offset = PieceEncoder(*shared.value), 0, 0
        for part in slices(batches, "text", 4 << 20):
            ids, at = encoder.encode(part.column(1))
            n = np.diff(at) + 1
            ends = np.concatenate([[0], np.cumsum(n)])
            flat = np.full(int(ends[-1]), end_id, np.int32)
            own = np.ones(len(flat), bool)
            own[ends[1:] - 1] = False
            flat[own] = ids
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.arange(place, place + len(n))), pa.array(offset + ends[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), part.column(2)],
                names=["doc_id", "place", "offset", "n_tokens", "ids", "part"],
            )
            place, offset = place + len(n), offset + int(ends[-1])

    rows = ordered.mapInArrow(encoded, _ROWS + ", part int")
    writer = rows.write.partitionBy("part").option("parquet.writer.version", "v2").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    for column in ("doc_id", "place", "offset", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.option("parquet.enable.dictionary#ids.list.element", "true").option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; reads only the columns that are asked for."""
    rows = spark.read.schema(_ROWS + ", part int").parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row a file: the running sum needs them in one place, and the join sends as many rows.
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ids_crc32, of the ids as little-endian unsigned 32-bit integers, in place of ids."""

    def summed(batches):
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(flat[a:b].data) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(summed, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def shared_path(spark: SparkSession, name: str = "tokens") -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
