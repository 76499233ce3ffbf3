"""Byte-level BPE encoding and decoding with a given rank file.

Texts are cut by the tokenizer's pattern; each block of texts keeps its distinct words as byte arrays and every text
as positions in that list. Spark's higher-order functions then fold the ranked merges over each distinct word; the rank table is a literal (an
array of small maps, found by hash, because a map's look-up is a scan). Decoding concatenates the ids' pieces. A word
that is in the table is its own token, as in the original. Words that a bounded sample of documents repeats are encoded
first and sent along as a table of bounded size, so that blocks only encode the rest. Blocks are independent and of
bounded size, and nothing of them is shuffled.

Merges are applied in order of rank. That is what merging the least pair again and again does, provided that a merge
never makes a pair of lower rank than its own: :func:`consistent` checks it for a table.

A null text is empty and has no tokens. Repeated rows are encoded one by one. Other columns are not read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pretokens import character_classes, cuts_with_blanks
from .shared import BASE, OTHER_BASE, mixed, prefix_hashes, slice_hashes, slices, text_bytes

#: Bytes of text whose distinct words are kept together.
BLOCK_BYTES = 16 << 20
#: Borders of a word up to this length are the bits of one number; a longer word merges in rounds, each all of the
#: least pair.
LONG_WORD = 60
#: Documents whose repeated words are encoded first, about, and the most of these words; a cache of bounded size.
HEAD_SAMPLE, HEAD_WORDS = 16_000, 400_000
_BUCKET_BITS = 16
_BLOCK = "docs array<bigint>, counts array<int>, codes binary, words array<binary>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def consistent(ranks: dict[bytes, int]) -> bool:
    """Whether every entry is encoded as itself, by merges of ranks up to its own."""
    for entry, own in ranks.items():
        parts, last = [entry[i : i + 1] for i in range(len(entry))], -1
        while len(parts) > 1:
            options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not options:
                return False
            rank, i = min(options)
            if rank < last or rank > own:
                return False
            parts[i : i + 2], last = [parts[i] + parts[i + 1]], rank
    return True


class Cut:
    """A slice of texts cut into words: where they are, which are the same, and each text's first word."""

    def __init__(self, array: pa.Array, classes: np.ndarray):
        self.data, offsets = text_bytes(array)
        chars = np.flatnonzero((self.data & 0xC0) != 0x80)
        points = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        begins = np.searchsorted(chars, offsets)
        first[begins[:-1][begins[:-1] < len(points)]] = True
        cuts = cuts_with_blanks(points, first, classes)
        self.starts = chars[cuts]
        self.ends = np.append(self.starts[1:], len(self.data))[: len(self.starts)]
        self.first = np.searchsorted(cuts, begins)
        self.names = mixed(slice_hashes(prefix_hashes(self.data), self.starts, self.ends))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names of the distinct words, their first places, each word's number among them, and how often they occur."""
        return np.unique(self.names, return_index=True, return_inverse=True, return_counts=True)

    def words(self, at: np.ndarray) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]

    def other_names(self, at: np.ndarray) -> np.ndarray:
        return mixed(slice_hashes(prefix_hashes(self.data, OTHER_BASE), self.starts[at], self.ends[at], OTHER_BASE))


class Head:
    """Words encoded beforehand, by two hashes; a table of bounded size that spares work and changes nothing."""

    def __init__(self, words: pa.Array, ids: pa.Array, texts: pa.Array):
        data, at = text_bytes(words)
        names = [mixed(slice_hashes(prefix_hashes(data, b), at[:-1], at[1:], b)) for b in (BASE, OTHER_BASE)]
        order = np.argsort(names[0])
        self.names, self.others = names[0][order], names[1][order]
        # Taken from Arrow's buffers: as Python objects, the words of a full head would be a hundred megabytes.
        ids_at = ids.offsets.to_numpy().astype(np.int64)
        self.ids = gathered(ids.values.to_numpy(zero_copy_only=False).astype(np.int32), ids_at, order)
        self.ids_at = np.concatenate([[0], np.cumsum(np.diff(ids_at)[order])])
        plain, at = text_bytes(texts)
        self.bytes = gathered(plain, at, order)
        self.bytes_at = np.concatenate([[0], np.cumsum(np.diff(at)[order])])

    def find(self, names: np.ndarray, others) -> np.ndarray:
        """Places of the names in the head, -1 where they are not in it."""
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        hit = np.flatnonzero(self.names[at] == names)
        hit = hit[self.others[at[hit]] == others(hit)]
        out = np.full(len(names), -1)
        out[hit] = at[hit]
        return out


def _head(docs: DataFrame, classes, by_rank: "Ranks", literals, sample: int, most: int) -> Head:
    """Encode the words that a sample of about ``sample`` documents has more than once, the ``most`` commonest of them."""
    share = min(1.0, sample / max(docs.count(), 1))

    def counted(batches):
        table = np.frombuffer(classes.value, np.uint8)
        for part in slices(batches):
            cut = Cut(part.column(1), table)
            _, at, _, n = cut.distinct()
            yield pa.RecordBatch.from_arrays([pa.array(cut.words(at), pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    words = docs.sample(share, 11).mapInArrow(counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    chosen = words.orderBy(F.desc("n"), "word").limit(most).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    encoded = chosen.withColumns(literals).select("word", "pieces", by_rank.encode(F.col("word")).alias("ids"))
    rows = encoded.select("word", "ids", by_rank.decode(F.col("ids")).alias("text")).toArrow()
    return Head(*(rows.column(c).combine_chunks() for c in ("word", "ids", "text")))


def words_by_block(docs: DataFrame, classes, head, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of texts: doc ids, words per text, each word's place in the head or, behind it, in the block's own list."""

    def blocks(batches):
        table, known_before = np.frombuffer(classes.value, np.uint8), head.value
        base = len(known_before.names)
        ids, counts, codes, words, known, held = [], [], [], [], {}, 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())),
                 pa.array([np.concatenate(codes or [np.zeros(0, np.int32)]).tobytes()], pa.binary()), pa.array([words], pa.list_(pa.binary()))],
                names=["docs", "counts", "codes", "words"],
            )

        for part in slices(batches):
            cut = Cut(part.column(1), table)
            names, at, inverse, _ = cut.distinct()
            local = known_before.find(names, lambda hit: cut.other_names(at[hit]))
            new = np.flatnonzero(local < 0)
            for i, word in zip(new.tolist(), cut.words(at[new])):
                code = known.get(word)
                if code is None:
                    code = known[word] = len(words)
                    words.append(word)
                local[i] = base + code
            codes.append(local[inverse].astype(np.int32))
            ids += part.column(0).to_pylist()
            counts += np.diff(cut.first).tolist()
            held += len(cut.data)
            if held >= block_bytes:
                yield row()
                ids, counts, codes, words, known, held = [], [], [], [], {}, 0
        if ids:
            yield row()

    return docs.mapInArrow(blocks, _BLOCK)


class Ranks:
    """The rank table, computed once and then a literal of the plan, and the merges as expressions over it.

    ``table`` is an array of small maps from byte piece to rank, found by hash, because the look-up in one map is a
    scan; ``pieces`` has the byte piece of each rank. Both are as large as the tokenizer's file.
    """

    mask = (1 << _BUCKET_BITS) - 1

    def __init__(self, table: Column, pieces: Column, longest: int):
        self.table, self.pieces, self.longest = table, pieces, longest

    @classmethod
    def literals(cls, spark, ranks: dict[bytes, int]) -> tuple[Column, Column]:
        rows = pa.table({"piece": pa.array(list(ranks), pa.binary()), "rank": pa.array(list(ranks.values()), pa.int32())})
        at = spark.createDataFrame(rows).select("rank", F.hash("piece").bitwiseAND(cls.mask).alias("at")).toArrow()
        place = np.zeros(max(ranks.values()) + 1, np.int64)
        place[at.column("rank").to_numpy()] = at.column("at").to_numpy()
        order = np.argsort(place[rows.column("rank").to_numpy()], kind="stable")
        sorted_ = rows.take(pa.array(order)).combine_chunks()
        ends = np.searchsorted(place[sorted_.column("rank").to_numpy()], np.arange(cls.mask + 2)).astype(np.int32)
        maps = pa.MapArray.from_arrays(pa.array(ends), sorted_.column("piece").chunk(0), sorted_.column("rank").chunk(0))
        by_rank: list = [None] * len(place)
        for piece, rank in ranks.items():
            by_rank[rank] = piece
        one = pa.table({
            "buckets": pa.ListArray.from_arrays(pa.array([0, len(maps)], pa.int32()), maps), "pieces": pa.array([by_rank], pa.list_(pa.binary())),
        })
        literal = spark.createDataFrame(one)
        return literal.select("buckets").scalar(), literal.select("pieces").scalar()

    def rank(self, piece: Column) -> Column:
        return F.element_at(F.get(self.table, F.hash(piece).bitwiseAND(self.mask)), piece)

    def merged_by_rank(self, word: Column) -> Column:
        """Token ids of a word of at most ``LONG_WORD`` bytes: its substrings in the table, in order of rank, then from
        the left, folded over a bit set of piece borders. A substring is merged where it is two adjacent pieces by then.
        """
        n = F.length(word)
        one = F.lit(1).cast("bigint")
        bit = lambda i: F.call_function("shiftleft", one, i)
        # rank, start and end of a substring in one number, so that sorting needs no structs
        packed = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda start: F.transform(
            F.sequence(start + 2, F.least(n, start + self.longest)),
            lambda end: self.rank(F.substring(word, start + 1, end - start)).cast("bigint") * 65536 + (start * 256 + end),
        )))
        merges = F.array_sort(F.filter(packed, lambda x: x.isNotNull()))

        def merge(borders: Column, x: Column) -> Column:
            end = bit(x.bitwiseAND(255).cast("int"))
            start = bit(F.shiftright(x, 8).bitwiseAND(255).cast("int"))
            inside = borders.bitwiseAND(end - start - start)
            apart = (F.bit_count(inside) == 1) & (borders.bitwiseAND(start + end) == start + end)
            return F.when(apart, borders - inside).otherwise(borders)

        def pieces(borders: Column) -> Column:
            cuts = F.filter(F.sequence(F.lit(0), n), lambda i: borders.bitwiseAND(bit(i)) != 0)
            return _bound(cuts, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda x, y: self.rank(F.substring(word, x + 1, y - x))))

        return _bound(F.aggregate(merges, bit(n + 1) - 1, merge), pieces)

    def pair_ranks(self, pieces: Column) -> Column:
        following = F.slice(pieces, F.lit(2), F.size(pieces))
        return F.zip_with(pieces, following, lambda x, y: F.when(y.isNotNull(), self.rank(F.concat(x, y))))

    def merged_everywhere(self, pieces: Column) -> Column:
        """Every pair of least rank joined, from the left, where they overlap the first of two.

        Same outcome as one at a time, because a joined piece never has a pair of lower rank than its own
        (true of every table in which each entry is encoded as itself by its own rank last).
        """

        def join(ranks: Column) -> Column:
            least = F.array_min(ranks)
            marks = F.array_join(F.transform(ranks, lambda r: F.when(r.eqNullSafe(least), "1").otherwise("0")), "")
            marks = F.regexp_replace(marks, "11", "10")
            here = F.split(marks, "")
            taken = F.split(F.concat(F.lit("0"), marks), "")
            triples = F.arrays_zip(pieces.alias("p"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("q"), here.alias("h"), taken.alias("t"))
            kept = F.filter(triples, lambda x: x["p"].isNotNull() & (x["t"] == "0"))
            return F.when(least.isNull(), pieces).otherwise(F.transform(kept, lambda x: F.when(x["h"] == "1", F.concat(x["p"], x["q"])).otherwise(x["p"])))

        return _bound(self.pair_ranks(pieces), join)

    def merged_in_rounds(self, word: Column) -> Column:
        """Token ids of a word by rounds that merge all of the least pair."""
        single = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
        start = F.struct(single.alias("p"), F.lit(-1).alias("n"))
        return F.transform(F.aggregate(F.sequence(F.lit(2), F.length(word)), start, self._step, lambda s: s["p"]), self.rank)

    def encode(self, word: Column) -> Column:
        """Token ids of one word (binary, not empty)."""
        whole = self.rank(word)
        folded = F.when(F.length(word) <= LONG_WORD, self.merged_by_rank(word)).otherwise(self.merged_in_rounds(word))
        return _bound(whole, lambda w: F.when(w.isNotNull(), F.array(w)).otherwise(folded))

    def _step(self, state: Column, _: Column) -> Column:
        """Merge until a step changes nothing; then pass the state on."""
        done = state["n"] == F.size(state["p"])
        return F.when(done, state).otherwise(F.struct(self.merged_everywhere(state["p"]).alias("p"), F.size(state["p"]).alias("n")))

    def decode(self, ids: Column) -> Column:
        return F.aggregate(ids, F.lit(b""), lambda text, i: F.concat(text, F.get(self.pieces, i)))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gathered(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The pieces flat[offsets[c]:offsets[c + 1]] of all codes c, one after another."""
    lengths = (offsets[1:] - offsets[:-1])[codes]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0)
    return flat[at + np.repeat(offsets[codes] - (ends - lengths), lengths)]


def _assembled(batches, head: Head):
    for batch in batches:
        for r in range(batch.num_rows):
            ids, counts, codes, words = (batch.column(i) for i in range(4))
            texts = batch.column(4)
            docs = ids[r].as_py()
            where = np.frombuffer(codes[r].as_py(), np.int32)
            ends = np.cumsum([0, *counts[r].as_py()])
            encoded, decoded = words[r].values, texts[r].values
            own_at = encoded.offsets.to_numpy().astype(np.int64) if len(encoded) else np.zeros(1, np.int64)
            token_at = np.concatenate([head.ids_at, len(head.ids) + own_at[1:] - own_at[0]])
            tokens = np.concatenate([head.ids, encoded.values.to_numpy()[own_at[0] : own_at[-1]]])
            own_bytes, own_at = text_bytes(decoded)
            byte_at = np.concatenate([head.bytes_at, len(head.bytes) + own_at[1:]])
            bytes_ = np.concatenate([head.bytes, own_bytes])
            d = 0
            while d < len(docs):
                to = min(max(d + 1, int(np.searchsorted(ends, ends[d] + 300_000, "right")) - 1), len(docs))
                mine = where[ends[d] : ends[to]]
                lists = gathered(tokens, token_at, mine)
                plain = gathered(bytes_, byte_at, mine)
                cut = ends[d : to + 1] - ends[d]
                n_ids = np.concatenate([[0], np.cumsum((token_at[1:] - token_at[:-1])[mine])])[cut]
                n_bytes = np.concatenate([[0], np.cumsum((byte_at[1:] - byte_at[:-1])[mine])])[cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[d:to], pa.int64()), pa.ListArray.from_arrays(pa.array(n_ids, pa.int32()), pa.array(lists, pa.int32())),
                     pa.Array.from_buffers(pa.binary(), to - d, [None, pa.py_buffer(n_bytes.astype(np.int32).tobytes()), pa.py_buffer(plain.tobytes())])],
                    names=["doc_id", "ids", "decoded"],
                )
                d = to


def encode(docs: DataFrame, ranks_path: str, doc: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, sample: int = HEAD_SAMPLE, most: int = HEAD_WORDS) -> DataFrame:
    """One row per document: doc_id, ids (array<int>), decoded (binary, the ids' pieces one after another)."""
    sc, ranks = docs.sparkSession.sparkContext, read_ranks(ranks_path)
    table, pieces = Ranks.literals(docs.sparkSession, ranks)
    literals = {"table": table, "pieces": pieces}
    by_rank = Ranks(F.col("table"), F.col("pieces"), max(map(len, ranks)))
    chosen = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    classes = sc.broadcast(character_classes())
    head = sc.broadcast(_head(chosen, classes, by_rank, literals, sample, most))
    blocks = words_by_block(chosen, classes, head, block_bytes)
    encoded = blocks.withColumns(literals).withColumn("ids", F.transform("words", by_rank.encode))
    decoded = encoded.select("docs", "counts", "codes", "ids", F.transform("ids", by_rank.decode).alias("texts"))
    return decoded.mapInArrow(lambda b: _assembled(b, head.value), "doc_id bigint, ids array<int>, decoded binary")
