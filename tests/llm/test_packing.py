from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plazametrics.llm import packing
from plazametrics.llm.packing import Limits

PATH = public_tokenizers.path("word_bpe_49k.json")


def power(n):
    return n & (n - 1) == 0


def by_force(tokens, loss, limits):
    """The heuristic stated plainly: of what fits, the largest weighted dot product; ties: the smaller vector."""
    top = limits.array()
    vectors = [np.array([t, 1, m]) for t, m in zip(tokens, loss)]
    need = np.mean([v / top for v in vectors], axis=0)
    left, out = list(range(len(vectors))), []
    while left:
        rest, bin_ = top.copy(), []
        while True:
            fit = [i for i in left if (vectors[i] <= rest).all()]
            if not fit:
                break
            i = max(fit, key=lambda i: (round(float(vectors[i] / top * need / top @ rest), 12), tuple(-vectors[i]), -i))
            bin_.append(i)
            left.remove(i)
            rest = rest - vectors[i]
        out.append(bin_)
    return out


@pytest.mark.parametrize("limits", [Limits(64, 5, 40), Limits(64, 64, 20), Limits(100, 3, 100)])
def test_heuristic_under_each_limit(limits):
    rng = np.random.default_rng(limits.loss)
    tokens = rng.integers(1, 50, 120)
    loss = np.minimum((tokens * rng.choice([0.2, 0.5, 1.0], 120)).astype(np.int64), limits.loss)
    bins = packing.placed(tokens, loss, limits)
    assert sorted(i for b in bins for i in b) == list(range(120))
    assert all(tokens[b].sum() <= limits.tokens and len(b) <= limits.segments and loss[b].sum() <= limits.loss for b in bins)
    assert [[(tokens[i], loss[i]) for i in b] for b in bins] == [[(tokens[i], loss[i]) for i in b] for b in by_force(tokens, loss, limits)]


@pytest.mark.parametrize("limits", [Limits(64, 4, 63), Limits(64, 64, 63), Limits(64, 64, 30), Limits(8, 1, 7), Limits(1, 1, 0)])
def test_cut_sequences_hold_every_token_once_and_need_no_padding(limits):
    rng = np.random.default_rng(9)
    for lengths in (rng.integers(1, 200, 80), rng.integers(1, 4, 90), np.array([1]), np.array([640]), np.array([63, 63])):
        bins = packing.cut_sequences(lengths, limits)
        seen = sorted((r, s, n) for b in bins for r, s, n in b)
        for row, length in enumerate(lengths):
            at = 0
            for r, s, n in (p for p in seen if p[0] == row):
                assert s == at and n > 0
                at += n
            assert at == length
        for b in bins:
            total = sum(n for _, _, n in b)
            assert total <= limits.tokens and power(total) and len(b) <= limits.segments and sum(n - 1 for _, _, n in b) <= limits.loss


def test_documents(spark):
    rng = np.random.default_rng(2)
    words = ["alpha", "Über", "naïve", "x1", "end.", "<|endoftext|>", "ﬁn", "é", "日本"]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 300, 60)] + [None, "", "  ", "word " * 9000, "a" * 5000]
    texts += texts[:3]
    rows = [(None if i == 5 else i % 64, t, 7, 8) for i, t in enumerate(texts)]
    found = packing.packed_documents(spark.createDataFrame(rows, "doc_id bigint, text string, length int, sequence_id int").repartition(3), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for (i, *_), text in zip(rows, texts):
        want.setdefault(i, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    got = {}
    for r in found:
        got.setdefault((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens), []).append(r)
    for i, lists in want.items():
        pieces = [k for k, v in got.items() for _ in v if k[0] == i]
        assert sum(p[2] for p in pieces) == sum(map(len, lists))
        for _, start, length, crc, size in pieces:
            assert any(len(x) == size and zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()) == crc for x in lists)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.segment)
        assert [r.segment for r in parts] == list(range(len(parts))) and len(parts) <= 64
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert power(sum(r.length for r in parts)) and sum(r.length for r in parts) <= 2048


def test_whole_examples(spark):
    """Conversations: assistant turns bear loss."""
    rng = np.random.default_rng(4)
    rows = [(i % 50, int(t), int(t * rng.random())) for i, t in enumerate(rng.integers(0, 900, 400))] + [(None, None, None), (70, 3000, 5), (71, 10, 5000)]
    limits = Limits(2048, 6, 900)
    found = packing.packed(spark.createDataFrame(rows, "conv_id int, n_tokens int, n_loss int").repartition(2), limits).collect()
    assert sorted(((r.conv_id, r.n_tokens, r.n_loss) for r in found), key=str) == sorted(rows, key=str)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.segment)
        if parts[0].oversized:
            assert len(parts) == 1 and (parts[0].n_tokens > 2048 or parts[0].n_loss > 900)
        else:
            assert len(parts) <= 6 and sum(r.n_tokens or 0 for r in parts) <= 2048 and sum(r.n_loss or 0 for r in parts) <= 900
        assert [r.offset for r in parts] == [sum(p.n_tokens or 0 for p in parts[:k]) for k in range(len(parts))]
    assert sum(r.oversized for r in found) == 2 and len(sequences) < 150


def test_empty_tables_and_clashing_names(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
    assert packing.packed(spark.createDataFrame([], "n_tokens int, n_loss int")).collect() == []
    with pytest.raises(ValueError, match="sequence_id"):
        packing.packed(spark.createDataFrame([], "n_tokens int, n_loss int, sequence_id int"))
