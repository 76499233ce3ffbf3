from __future__ import annotations

import random
import re

from plazametrics.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_force(text, items, size):
    own, hit, found = words(text), set(), set()
    for item, said in items:
        w = words(said)
        n = min(size, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i : i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(own), len(hit), len(found), ",".join(sorted(found))


def test_equals_brute_force(spark):
    draw = random.Random(2)
    prose = lambda n: " ".join(draw.choice(["a", "b", "Ab", "cé", "9", "É"]) + draw.choice(["", ",", "."]) for _ in range(n))
    items = [(1, prose(30)), (2, "one"), (3, "A b c"), (4, None), (5, "...!"), (None, prose(12)), (10, prose(14)), (10, prose(9)), (2, "one")]
    texts = [None, "", "one", "ONE two", "x a-b c y", "!!", *(prose(draw.randint(1, 200)) for _ in range(40))]
    texts += [prose(20) + " " + items[0][1][10:60] + " " + prose(5), items[6][1] + prose(3), items[6][1] + prose(3), "a b c " * 4000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "y")], "doc_id long, text string, window string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"]) for r in D.contamination(docs, table).collect())
    want = sorted([(i, *by_force(t, items, 10)) for i, t in enumerate(texts)] + [(0, 0, 0, 0, "")])
    assert got == want
    kept = D.without_contaminated(docs, table)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[2])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    assert D.contamination(docs.limit(0), items).count() == 0
    assert D.contamination(docs, items.limit(0)).first().n_hit == 0
