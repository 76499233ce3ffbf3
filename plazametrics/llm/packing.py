"""Packing of examples into training sequences by vector bin packing with the dot-product heuristic.

An example is a vector: its tokens, one segment, and its loss-bearing tokens. A sequence has a limit for each. Sequences
are filled one at a time: of the examples that still fit all limits, the one comes next whose vector has the largest
dot product with what is left of the limits, each dimension weighted by how much of it the examples need on average. A
sequence is closed when nothing fits.

Every task packs its own rows in blocks of bounded size, so nothing is shuffled; what a block leaves over costs less than
a sequence. Ids of sequences hold the number of the partition, and are the same when a task runs again.

:func:`packed` places whole examples. :func:`packed_documents` tokenizes texts and may cut them: a text longer than a
sequence is cut at its length, the rest is packed as above, gaps are then filled with pieces of the emptiest sequences,
and a sequence that is not full in the end is cut at powers of two, to which sequences may be padded instead. So no
sequence of pieces is padded at all.

Null tokens or loss-bearing tokens count as 0; an example of 0 tokens takes a segment. An example beyond a limit by
itself stands alone and is marked oversized. A null text is empty: only the end id. Rows without id and repeated rows are
examples of their own. Equal vectors are placed in the order of their rows. Other columns are not read by
:func:`packed_documents`, and kept by :func:`packed`, which refuses columns of its own names. An empty table gives none.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import character_classes
from .shared import slices
from .token_files import END_ID, PieceEncoder

#: Examples of a block that are packed whole; a placement looks at every distinct vector of its block.
BLOCK = 8192
#: Bytes of text of a block of documents.
BLOCK_BYTES = 4 << 20
#: A sequence's number within its partition has so many bits.
LOCAL_BITS = 40


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold. Of a document's piece all tokens but the first bear loss, so 2047 bounds nothing there."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2047

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.int64)


def placed(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[int]]:
    """Examples of each sequence, by the dot-product heuristic; all fit the limits by themselves."""
    if not len(tokens):
        return []
    vectors, kind = np.unique(np.stack([tokens, np.ones(len(tokens), np.int64), loss], 1), axis=0, return_inverse=True)
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    at, ends = np.searchsorted(kind[order], np.arange(len(vectors))), np.searchsorted(kind[order], np.arange(len(vectors)), "right")
    at = at.tolist()
    share = vectors / limits.array()
    need = share[kind].mean(0)
    pull = share * need / limits.array()
    out: list[list[int]] = []
    left = len(tokens)
    live = np.ones(len(vectors), bool)
    while left:
        rest, bin_ = limits.array(), []
        fits = live.copy()
        score = np.where(fits, pull @ rest, -1.0)
        while True:
            best = int(score.argmax())
            if score[best] < 0:
                break
            bin_.append(int(order[at[best]]))
            at[best] += 1
            left -= 1
            if at[best] == ends[best]:
                live[best] = fits[best] = False
            rest = rest - vectors[best]
            fits &= (vectors <= rest).all(1)
            score = np.where(fits, pull @ rest, -1.0)
        out.append(bin_)
        if live.sum() * 2 < len(live):
            kept = np.flatnonzero(live)
            vectors, pull, ends, live, at = vectors[kept], pull[kept], ends[kept], live[kept], [at[i] for i in kept.tolist()]
    return out


def packed(examples: DataFrame, limits: Limits = Limits(), tokens: str = "n_tokens", loss: str = "n_loss") -> DataFrame:
    """``examples`` with sequence_id, segment (from 0), offset (tokens before it in its sequence) and oversized."""
    taken = {"sequence_id", "segment", "offset", "oversized"} & set(examples.columns)
    if taken:
        raise ValueError(f"columns of these names are in the way: {sorted(taken)}")
    own = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in (tokens, loss)]
    names = examples.columns

    def blocks(batches):
        first = TaskContext.get().partitionId() << LOCAL_BITS
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                n, m = (part.column(len(names) + i).to_numpy(zero_copy_only=False) for i in (0, 1))
                large = (n > limits.tokens) | (m > limits.loss) | (limits.segments < 1)
                small = np.flatnonzero(~large)
                bins = [small[b] for b in placed(n[small], m[small], limits)] + [np.array([i]) for i in np.flatnonzero(large)]
                rows = np.concatenate(bins)
                sizes = np.array([len(b) for b in bins])
                starts = np.cumsum(sizes) - sizes
                before = np.cumsum(n[rows]) - n[rows]
                columns = part.take(pa.array(rows)).columns[: len(names)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(first + np.repeat(np.arange(len(bins)), sizes)), pa.array((np.arange(len(rows)) - np.repeat(starts, sizes)).astype(np.int32)),
                     pa.array(before - np.repeat(before[starts], sizes)), pa.array(large[rows])],
                    names=[*names, "sequence_id", "segment", "offset", "oversized"],
                )
                first += len(bins)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema.fields)
    return examples.select("*", *[c.alias(f"_packing{i}") for i, c in enumerate(own)]).mapInArrow(blocks, f"{kinds}, sequence_id bigint, segment int, offset bigint, oversized boolean")


#: A piece of a document: its row in the block, the token it starts at, and how many it has.
Piece = tuple[int, int, int]


def _loss(pieces: list[Piece]) -> int:
    return sum(n - 1 for _, _, n in pieces)


def _filled(bins: list[list[Piece]], limits: Limits) -> list[list[Piece]]:
    """Gaps of the fullest sequences are filled from the emptiest, whose pieces are cut as needed."""
    size = [sum(n for _, _, n in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: -size[i])
    low, high = 0, len(order) - 1
    while low < high:
        i, j = order[low], order[high]
        gap = limits.tokens - size[i]
        room = min(gap, limits.loss - _loss(bins[i]) + 1) if gap and len(bins[i]) < limits.segments else 0
        if room <= 0:
            low += 1
            continue
        row, start, n = bins[j].pop()
        if n > room:
            bins[j].append((row, start, n - room))
            row, start, n = row, start + n - room, room
        bins[i].append((row, start, n))
        size[i] += n
        size[j] -= n
        high -= not bins[j]
    return [b for b in bins if b]


def _at_powers(pieces: list[Piece], full: int) -> list[list[Piece]]:
    """The pieces as sequences of a power of two of tokens each, the longest first; one of ``full`` tokens stays."""
    total = sum(n for _, _, n in pieces)
    if total == full or not total & (total - 1):
        return [pieces]
    out, rest = [], list(reversed(pieces))
    for k in range(total.bit_length() - 1, -1, -1):
        if not total >> k & 1:
            continue
        want, bin_ = 1 << k, []
        while want:
            row, start, n = rest.pop()
            if n > want:
                rest.append((row, start + want, n - want))
                n = want
            bin_.append((row, start, n))
            want -= n
        out.append(bin_)
    return out


def cut_sequences(lengths: np.ndarray, limits: Limits) -> list[list[Piece]]:
    """Sequences of pieces of documents with these numbers of tokens: every token in one piece, nothing padded."""
    whole = min(limits.tokens, limits.loss + 1)
    out = [[(row, start, whole)] for row in np.flatnonzero(lengths >= whole).tolist() for start in range(0, int(lengths[row]) - whole + 1, whole)]
    rest = lengths % whole
    rows = np.flatnonzero(rest)
    ends = lengths - rest
    bins = [[(int(r), int(ends[r]), int(rest[r])) for r in rows[b].tolist()] for b in placed(rest[rows], rest[rows] - 1, limits)]
    full = [b for b in bins if sum(n for _, _, n in b) == limits.tokens]
    open_ = _filled([b for b in bins if sum(n for _, _, n in b) != limits.tokens], limits)
    return [part for b in [*out, *full, *open_] for part in _at_powers(b, limits.tokens)]


_encoders: dict[int, PieceEncoder] = {}


def _encoder(shared) -> PieceEncoder:
    """One encoder a Python worker, which keeps what it has learned of words between tasks."""
    text, classes = shared.value
    name = zlib.crc32(text.encode())
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = PieceEncoder(text, classes)
    return _encoders[name]


def packed_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = END_ID, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, start (its document's tokens before it), length, ids_crc32, doc_tokens, sequence_id, offset, segment."""
    if limits.tokens < 1 or limits.tokens & (limits.tokens - 1) or limits.segments < 1 or limits.loss < 0:
        raise ValueError("the limit of tokens must be a power of two, that of segments at least 1")
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast((file.read(), character_classes()))

    def blocks(batches):
        encoder, first = _encoder(shared), TaskContext.get().partitionId() << LOCAL_BITS
        for part in slices(batches, "text", BLOCK_BYTES):
            ids, at = encoder.encode(part.column(1))
            lengths = np.diff(at) + 1
            ends = np.cumsum(lengths)
            flat = np.full(int(ends[-1]), end_id, "<u4")
            own = np.ones(len(flat), bool)
            own[ends - 1] = False
            flat[own] = ids
            bins = cut_sequences(lengths, limits)
            pieces = np.array([p for b in bins for p in b], np.int64)
            rows, starts, sizes = pieces.T
            places = (ends - lengths)[rows] + starts
            sums = [zlib.crc32(flat[a : a + n].data) for a, n in zip(places.tolist(), sizes.tolist())]
            count = np.array([len(b) for b in bins])
            begins = np.cumsum(count) - count
            before = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows)), pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64()), pa.array(lengths[rows]),
                 pa.array(first + np.repeat(np.arange(len(bins)), count)), pa.array(before - np.repeat(before[begins], count)), pa.array((np.arange(len(rows)) - np.repeat(begins, count)).astype(np.int32))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment"],
            )
            first += len(bins)

    texts = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return texts.mapInArrow(blocks, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, segment int")
