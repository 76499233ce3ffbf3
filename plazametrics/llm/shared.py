"""What several operators need: stored tables, text slices of Arrow batches, vectorised word and shingle hashes.

Hashes are polynomials over bytes modulo 2**64 with an odd base, so that the hash of any slice follows from one
prefix array; :func:`mixed` spreads them over all bits. Operators whose result must be exact compare the texts
themselves after a hash has found a candidate.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xC2B2AE3D27D4EB4F
WORD_BASE = 0xD6E8FEB86659FD93
#: Bytes of text that a task works on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back: survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column | str) -> Column:
    """16 bytes that name a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has about ``limit`` bytes of ``column`` at most, or one row."""
    for batch in batches:
        offsets = text_offsets(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def text_offsets(array: pa.Array) -> np.ndarray:
    """Byte offsets of the strings or binaries of ``array`` in its data buffer."""
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    if not len(array) or array.buffers()[1] is None:
        return np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated UTF-8 bytes of a string array and the offset of each text; null is empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    offsets = text_offsets(array)
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to one slice's length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, min(SLICE_BYTES + 1, 2 * n), 1)
        made = np.full(size, base % (1 << 64), np.uint64)
        made[0] = 1
        have = np.multiply.accumulate(made)
        if size <= SLICE_BYTES + 1:
            _powers[base] = have
    return have[:n]


def prefix_hashes(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """h[i] = sum of (values[j] + 1) * base**j over j < i; see :func:`slice_hashes`."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, len(values)), out=out[1:])
    return out


def slice_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of each [start, end) slice, the same wherever it stands; not yet mixed."""
    inverse = pow(base, -1, 1 << 64)
    return (prefix[ends] - prefix[starts]) * powers(inverse, len(prefix))[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True


class Words:
    """Words of a slice of texts: runs of digits, ASCII letters (A-Z lower-cased) and all non-ASCII characters."""

    def __init__(self, array: pa.Array):
        data, self.offsets = text_bytes(array)
        self.data = _LOWER[data]
        inside = _IS_WORD[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        filled = self.offsets[:-1][np.diff(self.offsets) > 0]
        before[filled] = False
        after[filled[1:] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: Index of each text's first word.
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return mixed(slice_hashes(prefix_hashes(self.data), self.starts, self.ends))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``n`` words within one text."""
        starts = shingle_starts(self.first, n)
        return starts, shingle_hashes(self.hashes(), starts, n)

    def text(self, start: int, end: int) -> str:
        """Words [start, end) of the slice, joined by blanks."""
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(start, end)).decode()


def shingle_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Words at which a run of ``n`` words of one text begins; ``first``: first word of each text, and the end."""
    room = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
    return np.flatnonzero(room >= n)


def shingle_hashes(word_hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(len(starts), np.uint64)
    for k in range(n):
        total = total * np.uint64(WORD_BASE) + word_hashes[starts + k]
    return mixed(total ^ np.uint64(n))


class BitFilter:
    """A fixed-size set of 64-bit hashes with false positives: its size is a bound whatever the table's size.

    It only spares work: whatever passes is matched exactly afterwards. 2**23 words of 64 bits are 64 MB at most
    on the driver, and as many bits as hashes are set, so small sets stay small when compressed.
    """

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    @staticmethod
    def of(df: DataFrame, column: str, log2: int = 24) -> "BitFilter":
        """From a column of 64-bit hashes; at most 2**(log2 - 6) rows of 16 bytes reach the driver."""
        slot = F.shiftrightunsigned(F.col(column), 64 - log2)
        words = (
            df.where(F.col(column).isNotNull())
            .select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - log2}) & 63 as int))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bits"))
            .toArrow()
        )
        bits = np.zeros(1 << (log2 - 6), np.uint64)
        bits[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype(np.uint64)
        return BitFilter(bits, log2)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - self.log2)
        return (self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def signed(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the long values that Spark holds."""
    return hashes.view(np.int64)
