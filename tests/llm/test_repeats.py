from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

from plazametrics.llm import repeats as R


def by_force(texts: list[bytes], length: int):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_repeats(seed: int):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdé ") for _ in range(draw.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(30) for _ in range(4)]
    texts = [None, "", "short", "a" * 300, "ab" * 200, prose(3)]
    for _ in range(60):
        parts = [prose(draw.randint(0, 40)) for _ in range(3)]
        if draw.random() < 0.6:
            s = draw.choice(shared)
            a = draw.randint(0, 40)
            parts.insert(draw.randint(0, 3), s[a : draw.randint(a, len(s))])
        texts.append(" ".join(parts))
    texts += [texts[10], texts[10], texts[11][:-20], texts[12] + texts[12]]
    texts += [shared[0][:140] + prose(2) for _ in range(30)]
    return texts


@pytest.mark.parametrize("length, hot", [(64, 256), (64, 5), (101, 256), (100, 3)])
def test_equals_brute_force(spark, length, hot):
    texts = texts_with_repeats(length + hot)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in R.without_repeats(docs, length, hot).collect()}
    want = by_force([(t or "").encode() for t in texts], length)
    assert [got[i] for i in range(len(texts))] == want


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, "x" * 500, 1)], "doc_id long, text string, key int")
    row = R.without_repeats(docs).first()
    assert (row.doc_id, row.n_bytes, row.n_removed, row.n_spans) == (None, 500, 500, 1)
    assert R.without_repeats(docs.limit(0)).count() == 0


def test_strings_with_one_equal_name_differ():
    name, other = np.array([5, 5, 5, 7, 7], np.uint64), np.array([1, 2, 1, 3, 3], np.uint64)
    first, inverse, n = R._same_strings(name, other)
    assert n[inverse].tolist() == [2, 1, 2, 2, 2] and sorted(first.tolist()) == [0, 1, 3]
    first, inverse, n = R._same_strings(name, name)
    assert n[inverse].tolist() == [3, 3, 3, 2, 2] and first.tolist() == [0, 3]
