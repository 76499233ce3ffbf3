"""Writers: flat CSV, JSON, report text, manifests and folder routing."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import csv_guard


def flat(df: DataFrame, columns: Sequence[str] | None = None, guard: bool = False) -> DataFrame:
    """Text projection for CSV: lists joined by `` | ``, missing values empty, extras dropped."""
    types = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        if c not in types:
            value: Column = F.lit("")
        elif types[c].startswith("array"):
            value = F.array_join(F.transform(c, lambda x: x.cast("string")), " | ")
        elif types[c].startswith(("map", "struct")):
            value = F.to_json(c)
        else:
            value = F.col(c).cast("string")
        value = F.coalesce(value, F.lit(""))
        out.append((csv_guard(value) if guard and types.get(c) == "string" else value).alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, guard: bool = False) -> None:
    flat(df, columns, guard).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def script_payload(rows: DataFrame, variable: str) -> DataFrame:
    """Script lines that append one JSON document each to the list ``window.X``, in any order and any number of files."""
    line = F.concat(F.lit(f"(window.{variable} = window.{variable} || []).push("), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), F.lit(");"))
    return rows.select(line.alias("value"))


#: Endings of files that Spark's text reader unpacks as it reads; the digest of such a file is taken of its whole content.
PACKED = ("gz", "gzip", "bz2", "deflate", "snappy", "lz4", "zst", "zstd", "passthrough")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of input files, however long.

    Files are read as their bytes between line feeds, in as many splits as the reader makes; the pieces of a file come
    together in order and pass through one hash, so that no task holds a file.
    """
    files = spark.read.format("binaryFile").load(path)
    listed = files.select("path", F.col("length").alias("bytes"), F.col("_metadata.file_path").alias("_file"))
    packed = F.col("_file").rlike(rf"\.({'|'.join(PACKED)})$")
    # A filter on the path would not keep the content of other files unread.
    whole = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(PACKED)}}}").load(path).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")
    ).where(~packed)
    pieces = lines.mapInArrow(line_pieces, "_file string, _start bigint, _piece bigint, _bytes binary")
    held = pieces.unionByName(listed.where(~packed).select(
        "_file", F.lit(-1).cast("bigint").alias("_start"), F.col("bytes").alias("_piece"), F.lit(b"").alias("_bytes")
    ))
    ordered = held.repartition("_file").sortWithinPartitions("_file", "_start", "_piece")
    hashed = ordered.mapInArrow(piece_digests, "_file string, sha256 string")
    return listed.join(hashed, "_file").select("path", "bytes", "sha256").unionByName(whole)


#: Bytes of a piece of a file, and the byte order mark that the reader leaves out.
PIECE_BYTES, MARK = 1 << 20, b"\xef\xbb\xbf"


def line_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each split with a line feed after each, joined to pieces numbered in order."""
    at, number, lines, size = None, 0, [], 0

    def piece() -> pa.RecordBatch:
        data = b"\n".join([*lines, b""])
        return pa.RecordBatch.from_pylist([{"_file": at[0], "_start": at[1], "_piece": number, "_bytes": data}], PIECES)

    for batch in batches:
        for line, file, start in zip(*(batch.column(c) for c in ("line", "_file", "_start"))):
            if lines and (size > PIECE_BYTES or (file.as_py(), start.as_py()) != at):
                yield piece()
                number, lines, size = number + 1, [], 0
            at = file.as_py(), start.as_py()
            lines.append(line.as_py())
            size += len(lines[-1]) + 1
    if lines:
        yield piece()


PIECES = pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("_piece", pa.int64()), ("_bytes", pa.binary())])


def piece_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file from its length (a piece before all others) and its pieces in order.

    The line feed after the last line, and a byte order mark before the first, are the file's own or not by its length.
    """
    file, length, seen, digests, last = None, 0, 0, [], b""

    def hexadecimal() -> str:
        missing = length - seen - len(last)
        if missing not in (-1, 0, len(MARK) - 1, len(MARK)):
            raise ValueError(f"{file}: {seen + len(last)} bytes read of {length}")
        digest = digests[missing > 0]
        digest.update(last if missing in (0, len(MARK)) else last[:-1])
        return digest.hexdigest()

    for batch in batches:
        for row in range(batch.num_rows):
            name, start, number, data = (batch.column(c)[row].as_py() for c in range(4))
            if start < 0:
                if file is not None:
                    yield pa.RecordBatch.from_pylist([{"_file": file, "sha256": hexadecimal()}])
                file, length, seen, digests, last = name, number, 0, [hashlib.sha256(), hashlib.sha256(MARK)], b""
                continue
            for digest in digests:
                digest.update(last)
            seen, last = seen + len(last), data
    if file is not None:
        yield pa.RecordBatch.from_pylist([{"_file": file, "sha256": hexadecimal()}])


def markdown_table(df: DataFrame, limit: int) -> str:
    """A report table of the first ``limit`` rows of an ordered result, and how many are left out."""
    rows = df.limit(limit).collect()
    left_out = df.count() - len(rows)
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    body = "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows)
    return head + body + (f"\n{left_out} more rows\n" if left_out else "")


# The folder each result table is routed to.
LAYERS = {
    "core": ("mall_metadata", "mall_profiles", "compositional_factor_loadings", "archetype_profiles"),
    "diagnostics": (
        "category_ubiquity", "brand_colocation", "brand_sensitivity", "partial_correlations", "kmeans_reference",
        "compositional_factor_selection", "compositional_lnm_comparison", "compositional_parallel_analysis",
        "compositional_pca_sensitivity", "compositional_posthoc",
    ),
    "intermediate": ("mall_features", "mall_category_counts", "compositional_factor_scores", "archetype_mixtures"),
}


def layer_of(table: str) -> str:
    for layer, tables in LAYERS.items():
        if table in tables:
            return layer
    return "machine"


@dataclass(frozen=True)
class Written:
    """A result table as it was written: its place, rows, order-independent digest of the rows, and seconds of its own."""

    path: str
    rows: int
    digest: str
    seconds: float


def row_digest(df: DataFrame) -> Column:
    """A number that names the rows whatever their order: two tables of equal rows, repeats included, have the same."""
    plain = [F.to_json(c) if t.startswith(("map", "struct", "array")) else F.col(c).cast("string") for c, t in df.dtypes]
    marked = [x for p in plain for x in (p.isNull(), p)]
    return F.coalesce(F.sum(F.xxhash64(*marked).cast("decimal(38,0)")), F.lit(0)).cast("string")


def written(df: DataFrame, path: str, write=None) -> Written:
    """Write a table and take its count and digest from the rows as they pass: the table is computed once."""
    seen, started = Observation(), time.perf_counter()
    passing = df.observe(seen, F.count(F.lit(1)).alias("rows"), row_digest(df).alias("digest"))
    (write or (lambda d: d.write.mode("overwrite").parquet(path)))(passing)
    return Written(path, seen.get["rows"], seen.get["digest"], round(time.perf_counter() - started, 3))


def package(tables: dict[str, DataFrame], root: str) -> dict[str, Written]:
    """Write every result to its layer under ``root``."""
    return {name: written(df, f"{root.rstrip('/')}/{layer_of(name)}/{name}") for name, df in tables.items()}


def write_ordered(df: DataFrame, path: str, *order: Column | str) -> None:
    """Parquet files that hold the rows in order: by file number, then as they stand in a file."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_ordered(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """Rows of :func:`write_ordered` with their place (from 1) in the whole table."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    # One row a file: part numbers are padded, so names are in order.
    before = sizes.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    return rows.join(before, "_file").withColumn(place, F.col("_before") + F.col("_index") + 1).drop("_file", "_index", "_before")


def publish(spark: SparkSession, staging: str, current: str) -> None:
    """Swap a finished staging folder in by rename, and the old one back if that fails."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(current).getFileSystem(conf)
    backup = path(current.rstrip("/") + ".backup")
    had_current = fs.exists(path(current))
    if had_current:
        fs.delete(backup, True)
        if not fs.rename(path(current), backup):
            raise RuntimeError(f"cannot set aside {current}")
    if not fs.rename(path(staging), path(current)):
        if had_current:
            fs.rename(backup, path(current))
        raise RuntimeError(f"cannot publish {staging}")
    if had_current:
        fs.delete(backup, True)
