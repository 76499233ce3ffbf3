from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest

import __spark_entry__ as entry

from ..compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
NAMES = {f"op{n}_": None for n in range(1, 14)}


@pytest.fixture(scope="module")
def documents():
    return {r[0]: r[1] for r in duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()}


def test_one_query_each_and_the_pipeline():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(p) for n in names) == 1 for p in NAMES)


@pytest.mark.parametrize("name", ["op1_decontamination", "op12_simplex_centroids", "op13_presence_masks"])
def test_equals_sql(spark, name):
    assert differences(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name]) == ""


def test_packing(spark, documents):
    pieces, lengths = {}, {}
    for r in entry.queries()["op11_vector_packing"](spark, FOLDER).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert set(pieces) == set(documents) and all(n & (n - 1) == 0 and n <= 2048 for n in lengths.values())
    for parts in pieces.values():
        ends = [0]
        for start, length, total in sorted(parts):
            assert start == ends[-1]
            ends.append(start + length)
        assert ends[-1] == total


def test_repeats(spark, documents):
    from .test_repeats import by_force

    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in entry.queries()["op7_prefix_doubling"](spark, FOLDER).collect()}
    assert [got[i] for i in documents] == by_force([(t or "").encode() for t in documents.values()], 400)


def test_personal_data(spark, documents):
    from .test_personal_data import plain_spans

    for r in entry.queries()["op10_personal_data"](spark, FOLDER).collect():
        spans = plain_spans(documents[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_quality_rows(spark, documents):
    rows = entry.queries()["op9_attention_quality"](spark, FOLDER).collect()
    assert len(rows) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
