from __future__ import annotations

import random

import public_tokenizers
import pytest
import regex
import tiktoken

from plazametrics.llm import byte_bpe as B
from plazametrics.llm.pretokens import character_classes, cuts_with_blanks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "a's it's 's  's \n's ''s 'S x'll we've'd 're're", "  lead", "trail   ", "\n\n x \t\ty\r\n", "日本語テキスト、中文 123４５", "é​ x y　z", "aaaa" * 300, "=-" * 500 + "x" * 700, "'", "x'sfoo 'llama 'relax'", "\x1c\x1d a\x85b", "😀😀 👩‍👩‍👧", "a\x00b", "1'2's"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


def test_cuts_equal_the_pattern():
    import numpy as np

    draw = random.Random(1)
    table = np.frombuffer(character_classes(), np.uint8)
    pattern = regex.compile(public_tokenizers.PATTERN)
    for _ in range(300):
        texts = ["".join(draw.choice("ab '\n\tsvelrdm1½é日! ") for _ in range(draw.randint(0, 40))) for _ in range(5)]
        points = np.array([ord(c) for t in texts for c in t], np.uint32)
        first, want, at = np.zeros(len(points), bool), [], 0
        for t in texts:
            if t:
                first[at] = True
            want += [at + m.start() for m in pattern.finditer(t)]
            at += len(t)
        assert cuts_with_blanks(points, first, table).tolist() == want


def test_table_is_consistent():
    ranks = B.read_ranks(PATH)
    assert B.consistent(ranks)
    assert not B.consistent({b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 4})


def test_ids_and_round_trip(spark, library):
    draw = random.Random(3)
    texts = [None, *ODD, *("".join(draw.choice("ab '\n\tsvelrdm1½é日!") for _ in range(draw.randint(1, 60))) for _ in range(300))]
    texts += ["".join(draw.choice("abcdefgh") for _ in range(600)), ODD[1], ODD[1]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in B.encode(docs, PATH, block_bytes=2000).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert list(rows[i].ids) == library.encode_ordinary(text or "")
        assert bytes(rows[i].decoded) == (text or "").encode()


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "x"), (None, "x")], "doc_id long, text string")
    assert [r.doc_id for r in B.encode(docs, PATH).collect()] == [None, None]
    assert B.encode(docs.limit(0), PATH).count() == 0
