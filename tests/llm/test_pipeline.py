from __future__ import annotations

import corpus_pipeline as C
import public_tokenizers
import pytest
import tiktoken

from plazametrics.llm import byte_bpe, quality_mil
from plazametrics.llm.shared import stored

from .test_decontamination import by_force as contaminated
from .test_line_templates import by_force as cleaned
from .test_minhash import groups

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, stage in C.STAGES:
        docs.append(stored(stage(spark, docs[-1], FOLDER), "step"))
    return docs


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(spark, steps):
    assert [k for k, _ in C.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    assert all(d.columns == steps[0].columns for d in steps[:-1])
    assert sorted(texts(C.run(spark, FOLDER))) == sorted(texts(steps[-1]))


def test_quality_keeps_what_the_model_accepts(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = texts(steps[1])
    known = [i for i in texts(steps[0]) if i in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in known) >= 0.95 * len(known)
    model = quality_mil.learn(steps[0], spark.read.parquet(f"{FOLDER}/labels.parquet").where(~quality_mil.held_out()))
    assert {r.doc_id for r in quality_mil.scored(steps[0], model).where("score >= 0.3").collect()} == set(kept)


def test_lines(steps):
    before, after = texts(steps[1]), texts(steps[2])
    want = dict(zip(before, cleaned(list(before.values()))))
    # Lines that near copies share stay, which the plain version does not know.
    assert before.keys() == after.keys() and all(len(after[i]) >= len(want[i]) for i in before)
    assert sum(after[i] == want[i] for i in before) >= 0.8 * len(before)
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_of_each_group_stays(steps):
    before = sorted(texts(steps[2]).items())
    assert sorted(texts(steps[3])) == sorted({before[g][0] for g in groups([t for _, t in before])})


def test_decontamination(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert sorted(texts(steps[4])) == sorted(i for i, t in texts(steps[3]).items() if not contaminated(t, items, 10)[1])


def test_tokens(steps):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(C.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before = texts(steps[4])
    rows = steps[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(before)
    assert all(list(r.ids) == library.encode_ordinary(before[r.doc_id]) and r.text == before[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)
