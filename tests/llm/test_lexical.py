from __future__ import annotations

import math
import re

import numpy as np
import pytest

from plazametrics.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_force(docs, items, top):
    lists = [terms(t) for _, t in docs]
    n_docs, total = sum(bool(x) for x in lists), sum(map(len, lists))
    df = {}
    for x in lists:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for (doc, _), x in zip(docs, lists):
            score = 0
            for t in set(terms(text)) & set(x):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * x.count(t) // (1000 * x.count(t) + 20 * (50 + 50 * len(x) * n_docs // total)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -score) for k, (score, null, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def run(spark, docs, items, top, **more):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, score int, query int").repartition(3)
    b = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id bigint, text string, rank int, part int")
    return sorted((tuple(r) for r in lexical.ranked(d, b, top, **more).collect()), key=str)


@pytest.mark.parametrize("top,at_once", [(5, 2000), (50, 3)])
def test_equals_plain_scores(spark, top, at_once):
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(150)] + ["Ñandú", "ZÜRICH", "日本", "a", "A"])
    chance = 1 / np.arange(1, 156) ** 0.8
    draw = lambda n: ", ".join(rng.choice(words, n, p=chance / chance.sum()))
    docs = [(int(i), draw(int(n))) for i, n in enumerate(rng.integers(1, 80, 2600))]
    docs += [(i + 5000, docs[7][1]) for i in range(300)] + [(9000, "w149 " * 20000)]
    items = [(i, draw(int(n))) for i, n in enumerate([1, 3, 10, 40, 200, 9, 7])] + [(8, " ".join(words))]
    assert len(set(terms(items[-1][1]))) > 64
    assert run(spark, docs, items, top, queries_at_once=at_once) == by_force(docs, items, top)


def test_nulls_ties_repeated_rows_and_empty_texts(spark):
    docs = [(3, "red fox"), (1, "red fox"), (None, "red fox"), (1, "red fox"), (2, None), (4, ""), (5, "?!"), (6, "fox den"), (7, "RED-red")]
    items = [(1, "Red"), (1, "Red"), (2, None), (3, "--"), (4, "unheard"), (None, "den fox fox"), (5, "red")]
    for top in (2, 50):
        assert run(spark, docs, items, top) == by_force(docs, items, top)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")], 5) == [] and run(spark, [(1, "a")], [], 5) == [] and run(spark, [(1, None)], [(1, "a")], 5) == []


def test_masks_and_evaluations():
    rng = np.random.default_rng(8)
    present = rng.random((70, 500)) < 0.1
    masks, code = lexical.masks_of(present)
    assert (masks[code] == present.T).all() and len({m.tobytes() for m in masks}) == len(masks)
    gains = np.where(present[:12], rng.integers(1, 1000, (12, 500)), 0)
    best = lexical.Best(1, 10)
    done = lexical.searched(present[:12], gains, np.arange(500), np.zeros(500, bool), 0, best)
    want = sorted(zip(-gains.sum(0), range(500)))[:10]
    assert [(-s, i) for s, i in zip(best.kept[0][0], best.kept[0][1])] == want and done < 400


def test_whole_numbers_beyond_64_bits():
    n = np.array([1, 10**9])
    assert lexical.lengths_term(n, 10**11, 3 * 10**13).tolist() == [50 + 50 * x * 10**11 // (3 * 10**13) for x in n.tolist()]
