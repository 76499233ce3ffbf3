from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from plazametrics.llm import minhash as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def groups(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def corpus(seed):
    draw = random.Random(seed)
    prose = lambda n: [draw.choice("abcdefghijklmnopqrstuvwxyz") + str(draw.randint(0, 99)) for _ in range(n)]
    texts = [None, "", "!!", "one two", "one, Two", "one two three", "a b c d e", "a b c d e"]
    for _ in range(6):
        base = prose(draw.randint(40, 150))
        for _ in range(draw.randint(2, 25)):
            copy = list(base)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(len(copy))] = "new" + str(draw.randint(0, 9999))
            texts.append(" ".join(copy))
    passage = prose(30)
    return texts + [" ".join(prose(15) + passage + prose(15)) for _ in range(60)] + ["x y " * 3000]


def test_groups_equal_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string")
        rows = {r.doc_id: r for r in M.near_duplicates(docs).collect()}
        want = groups(texts)
        assert [rows[i].group_id for i in range(len(texts))] == want
        assert [i for i in range(len(texts)) if rows[i].kept] == sorted(set(want))


def test_agreement_estimates_probability_jaccard():
    draw = random.Random(3)
    a = {draw.getrandbits(63): draw.randint(1, 4) for _ in range(200)}
    b = {k: (w if draw.random() < 0.8 else draw.randint(1, 4)) for k, w in a.items() if draw.random() < 0.85}
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    codes = np.array([*a, *b], np.uint64)
    weights = np.array([*a.values(), *b.values()])
    got = M.prob_minhash(codes, weights, np.array([0, len(a), len(a) + len(b)]), 4096)
    assert abs((got[0] == got[1]).mean() - want) < 0.03


def test_weighted_shingles():
    codes, counts, first = M.weighted_shingles(pa.array(["a a a a a a", None, "b c", "d e f g h i"]))
    assert np.diff(first).tolist() == [1, 0, 1, 2] and counts.tolist() == [2, 1, 1, 1] and len(codes) == 4


def test_without_near_duplicates(spark):
    rows = [(2, "the same words in here", 1), (1, "The same words, in here", 2), (1, "The same words, in here", 3), (None, None, 4), (None, None, 5), (7, "other", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = M.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect())[-2:] == [(1, "The same words, in here"), (7, "other")]
    assert M.without_near_duplicates(docs.limit(0)).count() == 0


def test_a_passage_repeated_many_times(spark):
    draw = random.Random(9)
    texts = []
    for times in (10, 50, 200, 50, 50, 50):
        words = ["w" + str(draw.getrandbits(40)) for _ in range(104)]
        texts += [" ".join(words), " ".join(words + words[40:56] * times)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.group_id for r in M.near_duplicates(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == groups(texts) == [i - i % 2 for i in range(len(texts))]


def test_no_column_depends_on_the_comparisons_made(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert M.near_duplicates(docs).columns == ["doc_id", "text_key", "class_id", "group_id", "n_class", "kept"]


def test_rows_without_words_all_stay(spark):
    rows = [(None, None, 1), (None, "", 2), (None, None, 3), (5, "!?", 4), (5, "!?", 5), (6, "Words here\n", 6), (6, "Words here\n", 7), (8, "é", 8), (9, "é", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = sorted(r.row for r in M.without_near_duplicates(docs).collect())
    assert kept[:5] == [1, 2, 3, 4, 5] and kept[5] in (6, 7) and kept[6:] == [8]
