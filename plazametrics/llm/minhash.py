"""Near-duplicate documents: ProbMinHash signatures over five-word shingles, banding, exact verification.

Every distinct shingle of a document is a Poisson process whose rate is its weight; its arrivals fall on random
registers, each register keeps the shingle that came first, and a shingle stops as soon as its next arrival would be
later than every register's. Two documents agree in a register with the probability Jaccard similarity of their
weighted shingles. All weights are 1, so that this is the Jaccard similarity of shingle sets by which links are verified:
a passage that a document repeats many times takes no register from the others. Registers are grouped into bands; documents that share a band are candidates.

Documents with the same shingle set are one class and only its representative goes on. Within a band's bucket no
pairs are enumerated: all members are compared with one centre, then with another where the bucket still holds several
groups; documents of buckets that hold several groups even then are joined on their rarest shingles, which finds every
pair that could still join two groups. Links are the pairs
whose exact Jaccard similarity of shingle sets reaches the threshold; groups are their connected components, found by
joins.

A document of fewer than five words has one shingle, all its words; a document without words (null, empty) is a group
of its own and never a duplicate. Repeated rows belong to one class. Rows without doc_id are grouped like others and
come last in order. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BitFilter, Words, mixed, shingle_hashes, shingle_starts, signed, slices, stored, text_key

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares none of 40 bands of 6 registers with probability 5e-6.
BANDS, ROWS = 40, 6
#: Comparisons of a bucket's groups with a centre drawn anew, before what is left is joined by rare shingles. More of them
#: leave less to that join and cost a search for components each.
STAR_ROUNDS = 1
_SLICE = 6 << 20
#: Products such as 0.8 * 35 may come out a little above the whole number.
SLACK = 1e-9
#: A character of a word, as :class:`Words` has them.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_GOLDEN = 0x9E3779B97F4A7C15


def weighted_shingles(array: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, their counts, and the first shingle of each text."""
    words = Words(array)
    hashes = words.hashes()
    starts = shingle_starts(words.first, n)
    codes = shingle_hashes(hashes, starts, n)
    counts = np.maximum(words.counts - n + 1, 0)
    for k in range(1, n):
        short = np.flatnonzero(words.counts == k)
        if len(short):
            at = np.concatenate([[0], np.cumsum(counts)])[short]
            codes = np.insert(codes, at, shingle_hashes(hashes, words.first[short], k))
            counts[short] = 1
    first = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        codes[a:b].sort()
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    new[first[:-1][counts > 0]] = True
    at = np.flatnonzero(new)
    return codes[at], np.diff(np.append(at, len(codes))), np.searchsorted(at, first)


def prob_minhash(codes: np.ndarray, weights: np.ndarray, first: np.ndarray, registers: int) -> np.ndarray:
    """For each text and register the shingle whose arrival is earliest; texts without shingles have zeros."""
    texts = len(first) - 1
    earliest = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    last = np.full(texts, np.inf)
    doc = np.repeat(np.arange(texts), np.diff(first))
    code, rate, time, turn = codes, weights.astype(np.float64), np.zeros(len(codes)), 0
    while len(code):
        drawn = mixed(code + np.uint64((turn * _GOLDEN + _GOLDEN) % (1 << 64)))
        time = time - np.log1p(-((drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
        slot = doc * registers + (mixed(drawn) % np.uint64(registers)).astype(np.int64)
        sooner = time < earliest[slot]
        np.minimum.at(earliest, slot[sooner], time[sooner])
        won = time == earliest[slot]
        winner[slot[won]] = code[won]
        live = np.unique(doc) if turn else np.flatnonzero(np.diff(first))
        last[live] = earliest.reshape(texts, registers)[live].max(axis=1)
        on = time < last[doc]
        code, rate, time, doc, turn = code[on], rate[on], time[on], doc[on], turn + 1
    return winner.reshape(texts, registers)


def set_names(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two hashes for each text's set of shingles, independent of order."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    for k in range(2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(codes ^ np.uint64(0xA5A5 + k)))])
        out[:, k] = mixed(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))
    return out


def signatures(docs: DataFrame, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n_shingles, name_a and name_b (of the shingle set), bands (array of hashes; empty without words)."""

    def signed_rows(batches):
        for part in slices(batches, limit=_SLICE):
            codes, _, first = weighted_shingles(part.column(2), n)
            registers = prob_minhash(codes, np.ones(len(codes)), first, bands * rows).reshape(len(first) - 1, bands, rows)
            total = np.zeros(registers.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                total = mixed(total * np.uint64(_GOLDEN) + registers[:, :, r])
            some = np.diff(first) > 0
            names = set_names(codes, first)
            ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(first), pa.int32()), pa.array(signed(names[:, 0].copy())), pa.array(signed(names[:, 1].copy())),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(total[some].reshape(-1))))],
                names=["doc_id", "text_key", "n_shingles", "name_a", "name_b", "bands"],
            )

    return docs.mapInArrow(signed_rows, "doc_id bigint, text_key binary, n_shingles int, name_a bigint, name_b bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, wanted: BitFilter, n: int = SHINGLE) -> DataFrame:
    """name_a, name_b and the shingles of the texts whose name may be wanted."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted.bits, wanted.log2))

    def sets(batches):
        wanted = BitFilter(*shared.value)
        for part in slices(batches, limit=_SLICE):
            codes, _, first = weighted_shingles(part.column(part.num_columns - 1), n)
            names = set_names(codes, first)
            hit = np.flatnonzero(wanted.has(names[:, 0]) & (np.diff(first) > 0))
            ends = np.concatenate([[0], np.cumsum(np.diff(first)[hit])]).astype(np.int32)
            lists = np.concatenate([codes[first[i] : first[i + 1]] for i in hit.tolist()] or [codes[:0]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(names[hit, 0])), pa.array(signed(names[hit, 1])), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(lists)))],
                names=["name_a", "name_b", "shingles"],
            )

    return docs.mapInArrow(sets, "name_a bigint, name_b bigint, shingles array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the least node that it is connected with.

    Each turn takes over the least label of a node's neighbours and of the node that it is labelled with.
    """
    links = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = stored(labels, "labels")
    while True:
        # A node hears from its neighbours and from its own label, as if that were a neighbour too.
        heard = links.select("a", "b").union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        near = heard.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
        after = stored(near.join(labels.withColumnRenamed("label", "old"), "node"), "labels")
        if after.where("label < old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those (a, b) whose shingle sets reach the threshold."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(common >= threshold * (F.size("of_a") + F.size("of_b") - common) - SLACK)
        .select("a", "b")
    )


def _prefix_pairs(left_over: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different labels that may reach the threshold, by prefix filtering: with shingles in order of
    rarity, two sets that similar share one of the first n - ceil(threshold * n) + 1 of each, and enough after the first
    that they share. What many documents have in common is frequent and stays behind what tells them apart."""
    tokens = left_over.join(sets, "class").select("class", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    ranked = tokens.join(often, "shingle").groupBy("class", "label", "n").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("all"))
    prefix = stored(
        ranked.select("class", "label", "n", F.posexplode(F.slice("all", F.lit(1), (F.col("n") - F.ceil(threshold * F.col("n") - SLACK) + 1).cast("int"))).alias("at", "x"))
        .where("x.often > 1").select("class", "label", "n", "at", F.col("x.shingle").alias("shingle")),
        "prefix",
    )
    one, two = prefix.alias("p"), prefix.alias("q")
    similar = F.least("p.n", "q.n") >= threshold * F.greatest("p.n", "q.n") - SLACK
    # Positional bound: what two sets share from their first common shingle on must be enough.
    enough = F.least(F.col("p.n") - F.col("p.at"), F.col("q.n") - F.col("q.at")) >= threshold / (1 + threshold) * (F.col("p.n") + F.col("q.n")) - SLACK
    return (
        one.join(two, (F.col("p.shingle") == F.col("q.shingle")) & (F.col("p.label") < F.col("q.label")) & similar & enough)
        .select(F.least("p.class", "q.class").alias("a"), F.greatest("p.class", "q.class").alias("b"))
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key (md5), class_id (least doc_id of equal shingle sets), group_id (least of the group),
    n_class (rows of the class), kept (the first document of its group)."""
    return grouped(docs, threshold, n, bands, rows, doc, text).select("doc_id", "text_key", "class_id", "group_id", "n_class", (F.col("row") == F.col("leader")).alias("kept"))


def grouped(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`near_duplicates`, with the numbers of the document's row and of its group's first row instead of kept."""
    chosen = docs.select(F.col(doc).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).cast("string").alias("text"))
    signed_docs = stored(signatures(chosen, n, bands, rows).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # Classes are numbered by their first row; a document without words is a class of its own.
    own = F.when(F.col("n_shingles") == 0, F.col("row"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    named = signed_docs.select("name_a", "name_b", own.alias("own"), "n_shingles", "row", "doc_id", "text_key", order.alias("order"))
    classes = stored(
        named.groupBy("name_a", "name_b", "own").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n_class"), F.first("n_shingles").alias("n_shingles"))
        .select("name_a", "name_b", "own", F.col("first.row").alias("class"), F.col("first.doc_id").alias("class_id"), "n_class", "n_shingles"),
        "classes",
    )
    banded = (
        signed_docs.join(classes.where("own is null").select(F.col("class").alias("row"), "n_class"), "row")
        .select(F.col("row").alias("class"), "n_shingles", F.explode("bands").alias("bucket"))
    )
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_bucket")).where("n_bucket > 1")
    members = stored(banded.join(shared, "bucket"), "members")
    # A document that is in the large buckets of many bands has most in common with the others: the best centre.
    central = members.groupBy("class").agg(F.sum("n_bucket").alias("central"))
    members = stored(members.join(central, "class").select("bucket", "class", "n_shingles", "central"), "members")
    centres = members.groupBy("bucket").agg(F.max(F.struct("central", "class")).alias("c")).select("bucket", F.col("c.class").alias("centre"))
    sizes = classes.select(F.col("class").alias("centre"), F.col("n_shingles").alias("n_centre"))
    similar = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y) - SLACK

    candidates = members.join(centres, "bucket").where("class != centre").select(F.col("centre").alias("a"), F.col("class").alias("b"), "n_shingles").distinct()
    tested = candidates.join(sizes, F.col("a") == F.col("centre")).where(similar(F.col("n_shingles"), F.col("n_centre")))
    tested = stored(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tested")
    wanted = members.select("class").distinct().join(classes, "class").select("class", "name_a", "name_b")
    sets = stored(
        shingle_sets(chosen, BitFilter.of(wanted, "name_a"), n).groupBy("name_a", "name_b").agg(F.first("shingles").alias("shingles"))
        .join(wanted, ["name_a", "name_b"]).select("class", "shingles"),
        "sets",
    )
    edges = stored(_verified(tested, sets, threshold), "edges")
    labels = components(edges)

    top = F.max(F.struct("central", "class", "n_shingles", "label")).alias("c")
    for turn in range(STAR_ROUNDS + 1):
        grouped = members.join(labels, F.col("class") == F.col("node"), "left").select("bucket", "class", "n_shingles", "central", F.coalesce("label", "class").alias("label"))
        grouped = stored(grouped, "grouped")
        # The next centre: the most central member outside the first centre's group.
        first = grouped.groupBy("bucket").agg(top).select("bucket", F.col("c.label").alias("first_label"))
        several = grouped.join(first, "bucket").where("label != first_label").groupBy("bucket").agg(top)
        if turn < STAR_ROUNDS:
            pairs = grouped.join(several.select("bucket", "c"), "bucket")
            pairs = pairs.where((F.col("label") != F.col("c.label")) & similar(F.col("n_shingles"), F.col("c.n_shingles")))
            pairs = pairs.select(F.least("class", "c.class").alias("a"), F.greatest("class", "c.class").alias("b"))
        else:
            left_over = grouped.join(several.select("bucket"), "bucket").select("class", "label").distinct()
            pairs = _prefix_pairs(left_over, sets, threshold)
        fresh = stored(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "fresh")
        if fresh.isEmpty():
            continue
        more = stored(_verified(fresh, sets, threshold), "edges")
        tested = tested.union(fresh)
        if not more.isEmpty():
            edges = edges.union(more)
            labels = components(edges)

    of_class = (
        classes.join(labels, F.col("class") == F.col("node"), "left").drop("node")
        .select("name_a", "name_b", "own", "class", "class_id", "n_class", F.coalesce("label", "class").alias("label"))
    )
    leaders = of_class.groupBy("label").agg(F.min(F.struct(F.col("class_id").isNull().alias("unknown"), "class_id", "class")).alias("leader"))
    of_class = of_class.join(leaders, "label").select("name_a", "name_b", "own", "class_id", "n_class", F.col("leader.class_id").alias("group_id"), F.col("leader.class").alias("leader"))
    return (
        named.select("doc_id", "text_key", "row", "name_a", "name_b", "own").alias("d").join(
            of_class.alias("c"), (F.col("d.name_a") == F.col("c.name_a")) & (F.col("d.name_b") == F.col("c.name_b")) & F.col("d.own").eqNullSafe(F.col("c.own"))
        ).select("d.doc_id", "text_key", "class_id", "group_id", "n_class", "row", "leader")
    )


def without_near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group, its first document, and every row without words, with all columns of ``docs``."""
    has_words = F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(_WORD)
    some = docs.where(has_words)
    found = near_duplicates(some.select(doc, text), doc=doc, text=text, **options).where("kept").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
    kept = some.join(found, F.col(doc).cast("long").eqNullSafe(F.col("_doc")) & (text_key(text) == F.col("_key")))
    # Repeated rows of the first document would all have been found.
    return kept.dropDuplicates(["_doc", "_key"]).drop("_doc", "_key").union(docs.where(~has_words))
