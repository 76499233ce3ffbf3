from __future__ import annotations

import numpy as np
import pyarrow as pa

from plazametrics.llm import quality_mil as Q

FOLDER = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    draw = np.random.default_rng(1)
    model = Q.GatedAttention()
    x, first, y = draw.normal(size=(7, Q.FEATURES)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    grads = model.gradients(model.forward(x, first), y)
    loss = lambda: -np.mean(y * np.log(s := model.forward(x, first)["score"]) + (1 - y) * np.log(1 - s))
    for name, value in model.at.items():
        at = tuple(draw.integers(0, n) for n in value.shape)
        old = value[at]
        value[at] = old + 1e-6
        up = loss()
        value[at] = old - 1e-6
        down = loss()
        value[at] = old
        assert abs((up - down) / 2e-6 - grads[name][at]) < 1e-5, name


def test_passages_cover_whole_texts():
    x, first = Q.passages(pa.array([None, "", "a b", "w " * 200, "É!! 9 " * 81]))
    assert np.diff(first).tolist() == [1, 1, 1, 3, 3] and np.isfinite(x).all() and x.shape[1] == Q.FEATURES


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.learn(docs, labels.where(~Q.held_out()))
    rows = Q.scored(docs, model).join(labels, "doc_id").where(Q.held_out()).select("score", "quality").collect()
    assert len(rows) > 50 and np.mean([(r.score >= Q.THRESHOLD) == (r.quality == 1) for r in rows]) > 0.95


def test_score_depends_on_the_text_alone(spark):
    docs = spark.createDataFrame([(1, "a text", "en", 0.5), (1, "a text", "de", 0.1), (None, None, None, None), (5, "", "x", 0.0)], "doc_id long, text string, lang string, _y double")
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = Q.scored(docs, Q.learn(docs, labels)).collect()
    assert len(got) == 4 and len({r.score for r in got if r.text == "a text"}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in Q.scored(docs, Q.learn(docs, labels.limit(0))).collect()} == {0.5}
    assert Q.without_low_quality(docs.limit(0), labels).count() == 0


def test_repeated_ids_and_the_bound_on_passages(spark):
    good, bad = "The quick fox runs. It was a fine day for all of us here.", "zz## 99 %% @@ ## zz zz 11 ## @@ %%"
    docs = [(i, good if i % 2 else bad) for i in range(60)] * 3 + [(None, good)]
    labels = [(i, i % 2) for i in range(60)] + [(0, 1), (None, 1), (99, 0)]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    again = Q.learn(d, t)
    assert Q.learn(d, t, sample=5) is not None
    assert Q.learn(d, t, all_passages=0) is None
    few = Q.learn(d, t, all_passages=9)
    assert few is not None and not np.allclose(few.at["W"], again.at["W"])
