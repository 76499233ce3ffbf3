from __future__ import annotations

import hashlib

import pyarrow as pa

from plazametrics.llm import syncmers as S


def test_anchors_are_closed_syncmers():
    from plazametrics.llm.shared import mixed, prefix_hashes, slice_hashes
    import numpy as np

    texts = ["the quick brown fox jumps over the lazy dog", "", "short", "ananananananananananananan", "é" * 30, "x" * 16]
    hashes, at, first = S.anchors(pa.array(texts))
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        n = len(data)
        m = max(n - S.S + 1, 0)
        inner = mixed(slice_hashes(prefix_hashes(data), np.arange(m), np.arange(m) + S.S))
        want = [p for p in range(n - S.K + 1) if min(inner[p : p + S.K - S.S + 1]) in (inner[p], inner[p + S.K - S.S])]
        assert at[first[i] : first[i + 1]].tolist() == (want or [0]), text


def test_context_free():
    passage = "a passage of some length that stands in two documents, at different places"
    h, _, first = S.anchors(pa.array([passage, "something before it. " + passage + " and after"]))
    assert set(h[: first[1]].tolist()) <= set(h[first[1] :].tolist())


def test_compared_rows(spark):
    texts = {1: "abc", 2: None, 3: "", 4: "a é text of 17 ch", 5: "x" * 5000, 6: "abc", 9: "words " * 400, None: "no id at all"}
    docs = spark.createDataFrame([(i, t, "z") for i, t in texts.items()], "doc_id long, text string, part string")
    got = {r.doc_id: r for r in S.compared(docs).collect()}
    order = [9, 6, 5, 4, 3, 2, 1, None]
    for i, n in zip(order, order[1:] + order[:1]):
        one, two = texts[i] or "", texts[n] or ""
        half = len(one) // 2
        edited = one[: len(one) - half] + two[:half]
        assert got[i].n_chars == len(one) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and (got[i].near_next == 1) == (one == two)
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (one == edited)
    assert got[1].fingerprint == got[6].fingerprint
    assert S.compared(docs.limit(0)).count() == 0
    assert S.compared(docs.where("doc_id = 4")).first().near_next == 1.0


def test_repeated_rows_and_many_parts(spark):
    docs = spark.range(500).selectExpr("id div 2 as doc_id", "concat('text number ', cast(id div 4 as string), repeat(' and more', 9)) as text")
    rows = S.compared(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i // 2 for i in range(500))
    assert sum(r.near_next == 1 for r in rows) >= 375
