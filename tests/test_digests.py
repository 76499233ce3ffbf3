"""Digests of files that no task holds: line feeds, their absence, marks, splits and packed files."""

from __future__ import annotations

import gzip
import hashlib

import numpy as np

from plazametrics.sources import sinks


def test_digests_of_odd_files_in_splits(spark, tmp_path):
    rng = np.random.default_rng(9)
    files = {
        "feed.bin": b"\n", "feeds.bin": b"\n\n\r\n", "none.bin": b"a\rb", "one.bin": b"a\n", "zeros.bin": b"\0" * 70000,
        "noise.bin": rng.bytes(3_000_000), "lines b+%20.bin": b"x" * 99 + b"\n" * 50000, "mark.bin": b"\xef\xbb\xbfabc\n", "packed.gz": gzip.compress(b"abc\n" * 99),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        found = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in sinks.file_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}


def test_no_row_holds_a_file(spark, tmp_path):
    data = b"ab\n" * 1000
    (tmp_path / "a.bin").write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        row = sinks.file_digests(spark, str(tmp_path)).first()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert (row["bytes"], row["sha256"]) == (3000, hashlib.sha256(data).hexdigest())
