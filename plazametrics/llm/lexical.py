"""Ranked lexical search of a query set over all documents, by presence-mask grouping.

Terms are maximal runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters of the whole text. A first
pass counts, per document, its terms and the occurrences of query terms, and stores these. A second pass goes through
blocks of documents with the query set at hand: a bit matrix says which term is in which document, so the mask of a
query's terms in each document is a few bit operations; documents with equal masks are a group. The maximum score of a
mask is the sum of its terms' largest contributions in the block. Distinct masks are evaluated by descending maximum
score, and a query is finished with a block when no mask left can reach the task's worst kept score. Every task sends the
best documents of each query; these are ranked in two steps, so that no task sees more than some tasks' best.

Weights, counts and scores are those of all documents:
N documents have a term, L terms in all, n in one document, a term is in df documents and tf times in this one.
w = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 + (50 n N) div L, score = sum of w ((10**9 tf) div (1000 tf + 20 m)).

A null or empty text has no terms; an item without terms and a document without a term of the item give no rows. Items
of equal text are one query, whose result is returned for each; repeated rows of documents are documents of their own,
and of equal scores the smaller id ranks first (null last). Empty tables give no rows. Other columns are not read.
Items are worked on in blocks of bounded size, each of which is sent to all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Words, slices, stored

#: Documents whose bit and contribution matrices are held at a time.
BLOCK = 1024
#: Distinct texts of items that one pair of passes works on.
QUERIES_AT_ONCE = 2000
#: Documents that the first evaluation of masks takes at least; later ones take more.
FIRST = 64
#: First-step groups of a query's best documents.
GROUPS = 64
_TABLE_BITS = 20


class Vocabulary:
    """Query terms by 64-bit name, with their bytes, so that a term found by name is compared in full."""

    def __init__(self, terms: list[bytes]):
        words = Words(pa.array([t.decode() for t in terms], pa.string()))
        names = words.hashes()
        self.order = np.argsort(names, kind="stable")
        self.names = names[self.order]
        # Terms whose name another has: so unlikely that they are refused, not handled.
        if (self.names[1:] == self.names[:-1]).any():
            raise ValueError("two terms have one name")
        self.data, self.starts, self.lengths = words.data, words.starts, words.ends - words.starts
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.names >> np.uint64(64 - _TABLE_BITS)] = True

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words that are query terms, and which."""
        names = words.hashes()
        at = np.flatnonzero(self.table[names >> np.uint64(64 - _TABLE_BITS)])
        place = np.minimum(np.searchsorted(self.names, names[at]), len(self.names) - 1)
        fits = self.names[place] == names[at]
        at, term = at[fits], self.order[place[fits]]
        fits = words.ends[at] - words.starts[at] == self.lengths[term]
        at, term = at[fits], term[fits]
        lengths = self.lengths[term]
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        differs = words.data[np.repeat(words.starts[at], lengths) + within] != self.data[np.repeat(self.starts[term], lengths) + within]
        wrong = np.zeros(len(at), bool)
        wrong[np.repeat(np.arange(len(at)), lengths)[differs]] = True
        return at[~wrong], term[~wrong]


def query_terms(texts: list[str | None]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct terms of all texts, and which of them each text has."""
    number: dict[bytes, int] = {}
    lists = []
    for text in texts:
        words = Words(pa.array([text], pa.string()))
        own = {words.data[a:b].tobytes() for a, b in zip(words.starts.tolist(), words.ends.tolist())}
        lists.append(np.array([number.setdefault(t, len(number)) for t in sorted(own)], np.int64))
    return list(number), lists


def counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Documents with at least one term: doc_id, n, and the query terms they have (ascending) with occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        vocabulary = Vocabulary(shared.value)
        size = len(shared.value)
        for part in slices(batches):
            words = Words(part.column(1))
            at, term = vocabulary.find(words)
            doc = np.searchsorted(words.first, at, "right") - 1
            pairs, times = np.unique(doc * size + term, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(part.num_rows + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, x.astype(np.int32)) for x in (pairs % size, times)]
            rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tf"])
            yield rows.filter(pa.array(words.counts > 0))

    return docs.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tf array<int>")


def totals(counts: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and df of each query term: sums of one row a term and task."""

    def summed(batches):
        df, docs, terms = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
            docs += batch.num_rows
            terms += int(batch.column(0).to_numpy().sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [docs, terms]))], names=["term", "x"])

    rows = counts.select("n", "terms").mapInArrow(summed, "term bigint, x bigint").groupBy("term").agg(F.sum("x").alias("x")).collect()
    found = {r["term"]: r["x"] for r in rows}
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(i, 0) for i in range(size)], np.int64)


def lengths_term(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of each document; in whole numbers of any size where 64 bits do not hold the product."""
    if int(n.max(initial=0)) * 50 * documents < 1 << 63:
        return 50 + (50 * n * documents) // terms
    return np.array([50 + 50 * int(x) * documents // terms for x in n], np.int64)


class Best:
    """The best ``top`` documents of each query so far: highest score first, then smallest id, null last."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * queries

    def least(self, q: int) -> int:
        """Score that a further document must reach."""
        scores = self.kept[q][0]
        return int(scores[-1]) if len(scores) == self.top else 1

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        fits = scores >= self.least(q)
        if not fits.any():
            return
        both = [np.concatenate([a, b[fits]]) for a, b in zip(self.kept[q], (scores, ids, nulls))]
        order = np.lexsort((both[1], both[2], -both[0]))[: self.top]
        self.kept[q] = tuple(x[order] for x in both)


def masks_of(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks of the columns of a bit matrix (one row each, as booleans) and the mask of every column."""
    packed = np.packbits(present, axis=0, bitorder="little")
    words = np.zeros(((len(packed) + 7) // 8, 8, packed.shape[1]), np.uint8)
    words.reshape(-1, packed.shape[1])[: len(packed)] = packed
    keys = np.ascontiguousarray(words.transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
    _, first, code = np.unique(keys[0], return_index=True, return_inverse=True)
    for more in keys[1:]:
        # Terms beyond the first 64 refine the groups.
        _, code_more = np.unique(more, return_inverse=True)
        _, first, code = np.unique(code.astype(np.int64) * (code_more.max() + 1) + code_more, return_index=True, return_inverse=True)
    return present[:, first].T, code


def searched(present: np.ndarray, gains: np.ndarray, ids: np.ndarray, nulls: np.ndarray, q: int, best: Best) -> int:
    """One query over a block: distinct masks by descending maximum score. Returns the documents evaluated."""
    masks, code = masks_of(present)
    most = masks @ gains.max(1)
    order = np.argsort(-most, kind="stable")
    docs = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(masks)))
    done, at, want = 0, 0, FIRST
    while at < len(order) and most[order[at]] >= best.least(q):
        chosen = []
        while at < len(order) and most[order[at]] >= best.least(q) and sum(map(len, chosen)) < want:
            k = order[at]
            chosen.append(docs[ends[k - 1] if k else 0 : ends[k]])
            at += 1
        some = np.concatenate(chosen)
        best.add(q, gains[:, some].sum(0), ids[some], nulls[some])
        done += len(some)
        want *= 4
    return done


def best_documents(counts: DataFrame, queries: list[tuple[str, np.ndarray]], weights: np.ndarray, documents: int, terms: int, top: int) -> DataFrame:
    """query, score, doc_id, part: every task's best of each query, with the number of its group."""
    shared = counts.sparkSession.sparkContext.broadcast((queries, weights))

    def search(batches):
        queries, weights = shared.value
        best = Best(len(queries), top)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                ids = part.column(0)
                nulls = ids.is_null().to_numpy(zero_copy_only=False)
                numbers = ids.fill_null(0).to_numpy()
                m = lengths_term(part.column(1).to_numpy(), documents, terms)
                term, tf = (part.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
                doc = np.repeat(np.arange(part.num_rows), np.diff(part.column(2).offsets.to_numpy()))
                present = np.zeros((len(weights), part.num_rows), bool)
                present[term, doc] = True
                gains = np.zeros(present.shape, np.int64)
                gains[term, doc] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                for q, (_, own) in enumerate(queries):
                    searched(present[own], gains[own], numbers, nulls, q, best)
        group = TaskContext.get().partitionId() % GROUPS
        for (name, _), (scores, numbers, nulls) in zip(queries, best.kept):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(scores)), pa.array(scores), pa.array(numbers, mask=nulls), pa.array(np.full(len(scores), group, np.int32))],
                    names=["query", "score", "doc_id", "part"],
                )

    return counts.mapInArrow(search, "query string, score bigint, doc_id bigint, part int")


def _ranked(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, top: int = 50, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents of each item with a score above 0."""
    texts = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item).alias("item_id"), F.col(item_text).cast("string").alias("asked")).withColumn("query", F.md5("asked"))
    distinct = asked.where(F.col("asked").isNotNull()).select("query", "asked").distinct()
    blocks = max(1, math.ceil(distinct.count() / queries_at_once))
    parts = []
    for b in range(blocks):
        rows = distinct.where(F.pmod(F.xxhash64("asked"), F.lit(blocks)) == b).orderBy("query").collect()
        terms, lists = query_terms([r["asked"] for r in rows])
        queries = [(r["query"], own) for r, own in zip(rows, lists) if len(own)]
        if not queries:
            continue
        counts = stored(counted(texts, terms), "terms")
        n, total, df = totals(counts, len(terms))
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        found = best_documents(counts, queries, weights, n, total, top)
        parts.append(_ranked(_ranked(found, ["query", "part"], top), ["query"], top))
    kind = dict(asked.dtypes)["item_id"]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    return every.join(asked, "query").select("item_id", "rank", "doc_id", "score")
