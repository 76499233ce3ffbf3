"""Removal of byte strings that occur more than once, by prefix doubling over sampled positions.

A string of ``length`` bytes that starts at p is looked at from its anchor: the position with the least hash among the
first third of its k-mers. The anchor depends on the string alone, so equal strings have it at the same place, and only
about one position in sixty is an anchor. Prefix doubling then names the suffixes that start at anchors: the name of the
first 2h bytes is made from the names of the first h and of the h bytes at offset h; Spark counts the names of each
round, and positions whose name is unique are out. Names are hashes rather than ranks in sorted order: only their
equality matters here. What is left after the last round (all bytes that every string of an anchor has in common) is
grouped by the digest of these bytes, and the strings' differing first and last bytes are compared there.

A group of more than ``hot`` positions is not brought together but split by salts: each part finds the strings that it
has more than once, and then sends every string once, with its place where it is still alone, to be counted over parts.

Texts are UTF-8 bytes; a null text is empty; strings never cross texts. Repeated rows are copies of each other: all
their bytes go, from every copy, where they have ``length`` or more. Exact copies are found by their digest and looked
into once. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BASE, OTHER_BASE, BitFilter, mixed, prefix_hashes, signed, slice_hashes, slices, stored, text_bytes

LENGTH = 400
HOT = 1024
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class Geometry:
    """Sizes that follow from the length of the strings."""

    def __init__(self, length: int):
        if length < 16:
            raise ValueError("strings of fewer than 16 bytes are not supported")
        self.length = length
        #: k-mers among which the anchor is chosen, and their bytes.
        self.reach, self.k = length // 3, min(24, length // 4)
        #: Bytes from the anchor on that every string with this anchor has.
        self.core = length - self.reach + 1
        #: Prefix lengths of the rounds, each twice the one before; the last two overlap so as to end at the core.
        self.start = self.core // 4


class Anchors:
    """Anchors of a slice of texts; ``low`` to ``high`` are the starts of the strings that have anchor ``at``."""

    def __init__(self, array: pa.Array, g: Geometry):
        self.data, self.offsets = text_bytes(array)
        self.prefix = prefix_hashes(self.data)
        n = len(self.data)
        room = np.repeat(self.offsets[1:], np.diff(self.offsets)) - np.arange(n)
        starts = np.flatnonzero(room >= g.length)
        self.at = self.low = self.high = np.zeros(0, np.int64)
        if len(starts):
            count = n - g.k + 1
            place = np.arange(count)
            bits = np.uint64(max(int(count).bit_length(), 1))
            keyed = (mixed(slice_hashes(self.prefix, place, place + g.k)) >> bits << bits) | place.astype(np.uint64)
            least, width = keyed, 1
            while width * 2 <= g.reach:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            last = starts + (g.reach - width)
            anchor = (np.minimum(least[starts], least[last]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            new = np.ones(len(starts), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            begin = np.flatnonzero(new)
            self.at, self.low = anchor[begin], starts[begin]
            self.high = starts[np.append(begin[1:], len(starts)) - 1]

    def keep(self, live: np.ndarray) -> None:
        self.at, self.low, self.high = self.at[live], self.low[live], self.high[live]

    def names(self, g: Geometry, rounds: int) -> np.ndarray:
        """Names of the anchors' prefixes after so many doublings."""
        return self._names(self.at, g.start, rounds, g.core)

    def _names(self, at: np.ndarray, h: int, rounds: int, core: int) -> np.ndarray:
        if rounds == 0:
            return mixed(slice_hashes(self.prefix, at, at + h))
        before = h << (rounds - 1)
        # The last pair may overlap: it ends with the core.
        offset = core - before if 2 * before > core or core - 2 * before < h else before
        return mixed(self._names(at, h, rounds - 1, core) * _PAIR + self._names(at + offset, h, rounds - 1, 2 * before))


ROUNDS = 3


class Seen:
    """Lets each text of a task through once: its copies have the same strings and are found by their digest."""

    def __init__(self):
        self.keys: set[bytes] = set()

    def first(self, part: pa.RecordBatch) -> pa.RecordBatch:
        fresh = []
        for key in part.column(0).to_pylist():
            fresh.append(key not in self.keys)
            self.keys.add(key)
        return part if all(fresh) else part.filter(pa.array(fresh))


def _counted(texts: DataFrame, g: Geometry, done: list, rounds: int) -> DataFrame:
    """(name, n): how often each name of this round occurs among the positions that are still in."""

    def named(batches):
        filters, seen = [BitFilter(*b.value) for b in done], Seen()
        for part in map(seen.first, slices(batches, "text")):
            a = Anchors(part.column(1), g)
            for r, known in enumerate(filters):
                a.keep(known.has(a.names(g, r)))
            names, n = np.unique(a.names(g, rounds), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(names)), pa.array(n, pa.int64())], names=["name", "n"])

    return texts.mapInArrow(named, "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))


def _windows(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray, g: Geometry, core: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Row, bytes before the anchor, and two names of every string of the rows; ``core``: two numbers a row."""
    rows = np.repeat(np.arange(len(low)), high - low + 1)
    first = np.concatenate([[0], np.cumsum(high - low + 1)])
    before = low[rows] + (np.arange(len(rows)) - first[rows])
    names = []
    for k, base in enumerate((BASE, OTHER_BASE)):
        a = slice_hashes(prefix_hashes(left, base), left_at[rows + 1] - before, left_at[rows + 1], base)
        b = slice_hashes(prefix_hashes(right, base), right_at[rows], right_at[rows] + (g.length - g.core - before), base)
        names.append(mixed(mixed(mixed(core[rows, k] + before.astype(np.uint64)) ^ a) + b))
    return rows, before, names[0], names[1]


def _around(texts: DataFrame, g: Geometry, done: list, hot: list) -> DataFrame:
    """Positions that are still in: the digest of their common bytes and what stands around them.

    ``salt`` is -1, or for hot positions a number by which their group is split.
    """
    schema = "core binary, salt int, key binary, at int, low int, high int, before binary, after binary"
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def rows_of(batches):
        filters, seen = [BitFilter(*b.value) for b in done], Seen()
        tiers = [(BitFilter(*b.value), n) for b, n in hot]
        for part in map(seen.first, slices(batches, "text")):
            keys = part.column(0).to_pylist()
            a = Anchors(part.column(1), g)
            for r, known in enumerate(filters):
                a.keep(known.has(a.names(g, r)))
            doc = np.searchsorted(a.offsets, a.at, "right") - 1
            salt = np.full(len(a.at), -1)
            own = np.array([int.from_bytes(k[:4], "little") for k in keys], np.int64)[doc] if len(doc) else salt
            for busy, n in tiers:
                salt = np.where(busy.has(a.names(g, ROUNDS - 1)), own % n, salt)
            data, rows = a.data.tobytes(), []
            for at, low, high, d, b, s in zip(a.at.tolist(), a.low.tolist(), a.high.tolist(), doc.tolist(), a.offsets[doc].tolist(), salt.tolist()):
                core = hashlib.md5(data[at : at + g.core]).digest()
                rows.append((core, s, keys[d], at - b, at - high, at - low, data[low:at], data[at + g.core : high + g.length]))
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["core", "salt", "key", "at", "low", "high", "before", "after"])

    return texts.mapInArrow(rows_of, schema)


def _same_strings(name: np.ndarray, other: np.ndarray):
    """First row, number of the string for each row, and rows of each string; strings differ where either name does."""
    _, first, inverse, n = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    if (other != other[first][inverse]).any():
        _, first, inverse, n = np.unique(np.stack([name, other], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse.reshape(-1), n


def _grouped(batches, g: Geometry, rows_at_once: int = 20_000):
    """Within sorted groups of one core and salt: the strings that occur more than once, as spans of their texts.

    Of salted groups also every string, once, as a row with its name, and its place where it occurs once.
    """
    held: list[pa.RecordBatch] = []
    names = ["key", "start", "end", "name"]

    def spans(table: pa.Table):
        batch = table.combine_chunks().to_batches()[0]
        # Copies of a text that other tasks read: the same position again.
        keys, at = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        same = [i == 0 or (keys[i], at[i]) != (keys[i - 1], at[i - 1]) for i in range(len(at))]
        batch = batch if all(same) else batch.filter(pa.array(same))
        core = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, 2)
        salt, at, low, high = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 3, 4, 5))
        # Strings of different salts are not compared here.
        core_here = core ^ mixed(salt.astype(np.uint64))[:, None]
        around = (*text_bytes(batch.column(6)), *text_bytes(batch.column(7)))
        rows, before, name, other = _windows(*around, g, core_here, low, high)
        first, inverse, n = _same_strings(name, other)
        hit = np.flatnonzero(n[inverse] > 1)
        r, back = rows[hit], before[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (r[1:] != r[:-1]) | (back[1:] != back[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(hit))[: len(begin)] - 1
        if len(begin):
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(pa.array(r[begin])), pa.array(at[r[begin]] - back[end], pa.int32()), pa.array(at[r[begin]] - back[begin] + g.length, pa.int32()), pa.nulls(len(begin), pa.binary())],
                names=names,
            )
        split = first[salt[rows[first]] >= 0]
        if len(split):
            both = _windows(*around, g, core, low, high)[2:]
            whole = np.stack([both[0][split], both[1][split]], axis=1).tobytes()
            alone = n[inverse[split]] == 1
            r, back = rows[split], before[split]
            place = lambda values: pa.array(values, pa.int32(), mask=~alone)
            owner = batch.column(2).take(pa.array(r, mask=~alone))
            yield pa.RecordBatch.from_arrays([owner, place(at[r] - back), place(at[r] - back + g.length), pa.array([whole[16 * i : 16 * i + 16] for i in range(len(split))], pa.binary())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows_at_once:
            table = pa.Table.from_batches(held)
            cores, salts = table.column(0).combine_chunks(), table.column(1).combine_chunks()
            last = len(cores) - 1
            same = pc.and_(pc.equal(cores, cores[last]), pc.equal(salts, salts[last])).to_numpy(zero_copy_only=False)
            cut = int(np.argmax(same))
            if cut:
                yield from spans(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield from spans(pa.Table.from_batches(held))


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, text: str = "text") -> DataFrame:
    """(key, spans): for each text with repeated strings its md5 and the covered spans, sorted; they may overlap."""
    g = Geometry(length)
    sc = docs.sparkSession.sparkContext
    plain = F.coalesce(F.col(text), F.lit("")).cast("string")
    texts = docs.select(plain.alias("text")).where(F.octet_length("text") >= length).select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    done: list = []
    tiers: list = []
    for r in range(ROUNDS):
        counted = _counted(texts, g, done, r).where("n > 1")
        if r == ROUNDS - 1:
            counted = stored(counted, "names")
            for least, n in ((hot, 64), (64 * hot, 4096), (4096 * hot, 1 << 18)):
                busy = BitFilter.of(counted.where(F.col("n") > least), "name", 22)
                if busy.bits.any():
                    tiers.append((sc.broadcast((busy.bits, busy.log2)), n))
        known = BitFilter.of(counted, "name", 26)
        done.append(sc.broadcast((known.bits, known.log2)))
    apart = _around(texts, g, done, tiers).repartition("core", "salt").sortWithinPartitions("core", "salt", "key", "at")
    every = apart.mapInArrow(lambda b: _grouped(b, g), "key binary, start int, end int, name binary")
    if tiers:
        every = stored(every, "spans")
        # A salted group gives a place only for a string that is alone there: no more of them than salts meet here.
        places = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "start", "end"))).alias("places")
        across = every.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("groups"), places).where("groups > 1")
        every = every.where("name is null").drop("name").unionByName(across.select(F.inline("places")))
    else:
        every = every.drop("name")
    copies = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("end")).where("n > 1").select("key", F.lit(0).alias("start"), "end")
    return every.unionByName(copies).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return list(zip(starts[begin].tolist(), reach[np.append(begin[1:], len(starts)) - 1].tolist()))


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes)."""
    plain = F.coalesce(F.col(text), F.lit("")).cast("string")
    found = repeated_spans(docs.select(F.col(text).alias("text")), length, hot)
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), plain.alias("text"))
    joined = rows.join(found, F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("key"), "left").select("doc_id", "text", "spans")

    def removed(batches):
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column(1))
            lists = part.column(2)
            out = []
            for i in range(part.num_rows):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                if not lists[i].is_valid:
                    out.append((len(text), 0, 0, text))
                    continue
                spans = lists[i].values
                runs = merged(spans.field("start").to_numpy(), spans.field("end").to_numpy())
                cuts = [0, *[x for run in runs for x in run], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                out.append((len(text), len(text) - len(kept), len(runs), kept))
            n, gone, runs, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(removed, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
