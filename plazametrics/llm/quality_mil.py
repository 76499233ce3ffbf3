"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE`` tokens, the last one shorter). Each passage is encoded as counts
of character classes and of their pairs, token lengths, repetition; a layer turns that into a representation, gated
attention (tanh times sigmoid) weighs the passages, and the weighted mean is scored. Only document labels are used.

The model is fitted on the driver on a bounded sample of labelled rows: at most ``sample`` labels, those with the
least hash of their id, of their documents (any ``sample`` rows, where ids are repeated) the bags of at most
``MOST_PASSAGES`` passages, and in that order as many as have ``ALL_PASSAGES`` together. Scoring covers all documents
whole, inside tasks; the model (a few thousand numbers) travels in the task's code.

A null or empty text is a bag of one passage without tokens. Labels that are null, or whose document is missing, are
not used; without any usable label every score is 0.5. Repeated rows are scored one by one. Ids, labels, language and
source are never inputs of a score. Other columns pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import mixed, prefix_hashes, slice_hashes, slices, stored, text_bytes

PASSAGE = 80
SAMPLE = 6000
MOST_PASSAGES = 256
#: Passages that reach the driver: 64 MB of features.
ALL_PASSAGES = 200_000
THRESHOLD = 0.3
_LOWER, _UPPER, _DIGIT, _BLANK, _BREAK, _STOP, _SYMBOL, _FOREIGN = range(8)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LOWER, _UPPER, _DIGIT, _FOREIGN
_CLASS[[9, 11, 12, 32]], _CLASS[[10, 13]], _CLASS[[44, 46]] = _BLANK, _BREAK, _STOP
FEATURES = 8 + 64 + 8


def passages(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (float32) and the first passage of each text."""
    data, offsets = text_bytes(array)
    n, texts = len(data), len(offsets) - 1
    kind = _CLASS[data]
    inside = (kind != _BLANK) & (kind != _BREAK)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before[filled] = False
    after[filled[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first_token = np.searchsorted(starts, offsets)
    tokens = np.diff(first_token)
    bags = np.maximum(1, -(-tokens // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    total = int(first[-1])
    # Bytes of a passage run from its first token (or the text's start) to the next passage.
    bag = np.repeat(np.arange(texts), bags)
    rank = np.arange(total) - first[bag]
    head = np.minimum(first_token[bag] + rank * PASSAGE, first_token[bag + 1])
    low = np.where(rank == 0, offsets[bag], starts[np.minimum(head, max(len(starts) - 1, 0))] if len(starts) else offsets[bag])
    size = np.diff(np.append(low, n))
    of_byte = np.repeat(np.arange(total), size)
    single = np.bincount(of_byte * 8 + kind, minlength=total * 8).reshape(total, 8)
    pair = kind[:-1].astype(np.int64) * 8 + kind[1:] if n else np.zeros(0, np.int64)
    same = of_byte[:-1] == of_byte[1:]
    double = np.bincount(of_byte[:-1][same] * 64 + pair[same], minlength=total * 64).reshape(total, 64)

    in_passage = first[np.repeat(np.arange(texts), tokens)] + (np.arange(len(starts)) - np.repeat(first_token[:-1], tokens)) // PASSAGE
    count = np.bincount(in_passage, minlength=total)
    some = np.maximum(count, 1)
    length = (ends - starts).astype(np.float64)
    names = mixed(slice_hashes(prefix_hashes(data), starts, ends))
    order = np.argsort(names ^ mixed(in_passage.astype(np.uint64)), kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = (names[order[1:]] != names[order[:-1]]) | (in_passage[order[1:]] != in_passage[order[:-1]])
    different = np.bincount(in_passage[order[fresh]], minlength=total)
    again = np.zeros(len(starts), bool)
    again[1:] = (names[1:] == names[:-1]) & (in_passage[1:] == in_passage[:-1])
    share = lambda flags: np.bincount(in_passage, weights=flags, minlength=total) / some
    extra = np.stack([
        np.log1p(count), share(length) / 8, np.sqrt(share(length**2)) / 8, different / some, share(again),
        share(kind[starts] == _UPPER), share(kind[ends - 1] == _SYMBOL), share(kind[starts] == _SYMBOL),
    ], axis=1)
    bytes_ = np.maximum(size, 1)[:, None]
    return np.concatenate([single / bytes_, double / bytes_, extra], axis=1).astype(np.float32), first


class GatedAttention:
    """encode: relu(x W + b); weight: softmax of w (tanh(h V) * sigmoid(h U)); score: sigmoid of the weighted mean."""

    shapes = (("W", (FEATURES, 24)), ("b", (24,)), ("V", (24, 12)), ("U", (24, 12)), ("w", (12,)), ("c", (24,)), ("d", (1,)))

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.at = {k: draw.normal(0, (2 / s[0]) ** 0.5, s) if len(s) > 1 else draw.normal(0, 0.1, s) for k, s in self.shapes}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p, at = self.at, first[:-1]
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(at)), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "score": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def gradients(self, f: dict, y: np.ndarray) -> dict:
        p, at = self.at, np.flatnonzero(np.diff(f["bag"], prepend=-1))
        error = (f["score"] - y) / len(y)
        dz = error[:, None] * p["c"]
        dh = f["a"][:, None] * dz[f["bag"]]
        da = (f["h"] * dz[f["bag"]]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, at)[f["bag"]])
        gate = f["t"] * f["g"]
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * gate * (1 - f["g"])
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (f["h"] > 0)
        return {"c": f["z"].T @ error, "d": np.array([error.sum()]), "w": gate.T @ de, "V": f["h"].T @ dt, "U": f["h"].T @ dg, "W": f["x"].T @ dh, "b": dh.sum(axis=0)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 40, batch: int = 128, rate: float = 0.004, decay: float = 1e-4, seed: int = 3) -> "GatedAttention":
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        draw, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.at.items()}
        s = {k: np.zeros_like(v) for k, v in self.at.items()}
        size = np.diff(first)
        for _ in range(rounds):
            for some in np.array_split(draw.permutation(len(y)), max(1, len(y) // batch)):
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in some.tolist()])
                grads = self.gradients(self.forward(x[rows], np.concatenate([[0], np.cumsum(size[some])])), y[some])
                step += 1
                for k, g in grads.items():
                    g = g + decay * self.at[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.at[k] = self.at[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, all_passages: int = ALL_PASSAGES, doc: str = "doc_id", text: str = "text") -> GatedAttention | None:
    """Fit on at most ``sample`` labels and ``all_passages`` passages; None without labels of both kinds."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).alias("_doc"), F.col(label).cast("double").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_doc"), "_doc", "_y").limit(sample)
    rows = docs.select(F.col(doc).alias("_doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "_doc")

    def features(batches):
        for part in slices(batches, "text"):
            x, first = passages(part.column(part.schema.get_field_index("text")))
            bags = [None if b - a > MOST_PASSAGES else x[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("_doc")), part.column(part.schema.get_field_index("_y")), pa.array(bags, pa.binary())], names=["_doc", "_y", "bag"])

    bags = rows.mapInArrow(features, "_doc bigint, _y double, bag binary").where("bag is not null")
    one = stored(bags.limit(sample).withColumn("_h", F.xxhash64("_doc")), "bags")
    # At most ``sample`` rows of four numbers.
    sizes = sorted(tuple(r) for r in one.select("_h", "_doc", "_y", F.length("bag") / (4 * FEATURES)).collect())
    held = int(np.searchsorted(np.cumsum([r[3] for r in sizes]), all_passages, "right"))
    if not held:
        return None
    last = sizes[held - 1]
    within = (F.col("_h") < last[0]) | ((F.col("_h") == last[0]) & ((F.col("_doc") < last[1]) | ((F.col("_doc") == last[1]) & (F.col("_y") <= last[2]))))
    found = one.where(within).select("_doc", "_y", "bag").toArrow().sort_by([("_doc", "ascending"), ("_y", "ascending")])
    y = found.column("_y").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in found.column("bag").to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return GatedAttention().fit(np.concatenate(bags), first, y)


def scored(docs: DataFrame, model: GatedAttention | None, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with one more column: the probability of label 1."""
    if model is None:
        return docs.withColumn(score, F.lit(0.5))
    names = docs.columns
    at = names.index(text)

    def judged(batches):
        for part in slices(batches, text):
            x, first = passages(part.column(at))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.forward(x, first)["score"], pa.float64())], names=[*names, score])

    return docs.mapInArrow(judged, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def held_out(doc: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text divisible by five."""
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def without_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    model = learn(docs, labels.where(~held_out()), text=text, **options)
    return scored(docs, model, text, "_score").where(F.col("_score") >= threshold).drop("_score")
