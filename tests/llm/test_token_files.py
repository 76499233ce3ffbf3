from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from plazametrics.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "It's THE É ß ÿ Ÿ É×÷ don't 'S 'LL ''s", "<|endoftext|> x <|startoftext|>", "Σίσυφος ΣΑΣ", "日本語 ½²³ 12３", "é ﬁ", "\x0b\x0c\x1c a\x85b\xa0c", "x" * 5000, "İstanbul", "a_b-c --- ...", "1234.5", "\x7f\x00"]


def test_files_equal_the_library(spark):
    draw = random.Random(4)
    texts = [*ODD, *("".join(draw.choice("ab 'éÉ\n\tsveLRdm1!×") for _ in range(draw.randint(1, 60))) for _ in range(400))]
    ids = [*range(len(texts) - 1), None]
    docs = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts)], "doc_id long, text string, part int").repartition(3)
    path = T.shared_path(spark)
    T.write_tokens(docs, path, PATH)
    got = {r.doc_id: r for r in T.checksums(T.read_tokens(spark, path)).collect()}
    library, start = Tokenizer.from_file(PATH), 0
    for i, text in sorted(zip(ids, texts), key=lambda x: -1 if x[0] is None else x[0]):
        want = [*library.encode(text or "", add_special_tokens=False).ids, T.END_ID]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes())), text
        start += len(want)
    ids_back = T.read_tokens(spark, path).where("doc_id = 2").first()["ids"]
    assert list(ids_back) == [*library.encode(texts[2], add_special_tokens=False).ids, T.END_ID]


def test_encodings_and_page_indexes(spark, tmp_path):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('some words here ', 20) as text")
    T.write_tokens(docs, str(tmp_path / "t"), PATH, row_group_bytes=1 << 16, page_bytes=1 << 12)
    groups = 0
    for file in (tmp_path / "t").rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        assert all(c.has_offset_index and (c.has_column_index or "list" in n) for n, c in columns.items())
    assert groups >= len(list((tmp_path / "t").rglob("*.parquet")))


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (0, "b c")], "doc_id long, text string")
    path = T.shared_path(spark)
    T.write_tokens(docs, path, PATH)
    assert sorted(r.start for r in T.read_tokens(spark, path).collect()) == [0, 3, 5]
    path = T.shared_path(spark)
    T.write_tokens(docs.limit(0), path, PATH)
    assert T.read_tokens(spark, path).count() == 0
