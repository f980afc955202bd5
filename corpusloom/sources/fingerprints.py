"""Digests of source files and tables."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import expect_small_files, ship_package
from corpusloom.sources.lines import number_lines, read_lines
from corpusloom.sources.text_files import local_name, require_rows

_PIECES = 4
_PIECE_DIGITS = 15  # hex digits that fit a signed 64-bit number
_BUFFER = 8 << 20


def file_digests(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """`(path, size, sha256, sha1)` of many small files, one cell each; `stream_digest` is for large ones."""
    expect_small_files(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        local_name("path").alias("path"), F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"), F.sha1("content").alias("sha1"),
    )


def stream_digest(spark: SparkSession, path: str) -> DataFrame:
    """One row `(path, size, sha256, sha1)` of a file of any size, read once by one task in small buffers.

    A whole-file digest has to see the bytes in order. The path is opened by the file systems that
    Arrow knows (local, HDFS, object stores).
    """

    def run(batches):
        for batch in batches:
            for name in batch["path"]:
                system, inner = pafs.FileSystem.from_uri(name) if "://" in name or name.startswith("file:") else (pafs.LocalFileSystem(), name)
                digests, size = (hashlib.sha256(), hashlib.sha1()), 0
                with system.open_input_stream(inner) as stream:
                    while data := stream.read(_BUFFER):
                        size += len(data)
                        for digest in digests:
                            digest.update(data)
                yield pd.DataFrame({"path": [name], "size": [size], "sha256": [digests[0].hexdigest()], "sha1": [digests[1].hexdigest()]})

    ship_package(spark)
    named = spark.createDataFrame([(re.sub(r"\Afile:/(?!/)", "file:///", path),)], "path string")
    return named.mapInPandas(run, "path string, size long, sha256 string, sha1 string")


def source_file_fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of a line file, or of a folder of them: the table digest of (file name, line number, line).

    The same for every size, and read in parallel. Lines end at LF only, so other line endings and
    another order of the lines give another digest.
    """
    lines = number_lines(read_lines(spark, path, "\n"))
    named = lines.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("file"), "line", "value")
    return table_fingerprint(named, ["file", "line", "value"]).first()["fingerprint"]


def text_tree_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """One row `(fingerprint, file_count, total_bytes)` of the `.txt` files below `root`: the table
    digest of (path below root, size, content hash), the same for a tree of any size."""
    base = local_name(F.lit(root.rstrip("/") + "/"))
    files = file_digests(spark, root, "*.txt", recursive=True)
    require_rows(files.select("path"), f"no .txt files found under {root}")
    rows = files.select(F.substr("path", F.length(base) + 1).alias("file"), "size", "sha256")
    return table_fingerprint(rows, ["file", "size", "sha256"], total_bytes=F.sum("size")).withColumnRenamed("row_count", "file_count")


def row_digest(columns: list[str]) -> Column:
    """Digest of one row: the column digests in order, a null being the text null."""
    parts = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("null")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def table_fingerprint(rows: DataFrame, columns: list[str], **sums: Column) -> DataFrame:
    """`(fingerprint, row_count)` of a table, whatever its row order and partitioning; `sums` are
    further aggregates of its columns.

    Row digests are added up piece by piece, so every task combines its rows to one partial sum and
    nothing is collected. Copies of a row count as often as they occur.
    """
    digested = rows.withColumn("_digest", row_digest(columns))
    pieces = [
        F.sum(F.conv(F.substring("_digest", 1 + p * _PIECE_DIGITS, _PIECE_DIGITS), 16, 10).cast("decimal(20,0)")).alias(f"_p{p}")
        for p in range(_PIECES)
    ]
    added = digested.agg(F.count("*").alias("row_count"), *pieces, *[total.alias(name) for name, total in sums.items()])
    line = F.concat_ws(":", F.col("row_count").cast("string"), *[
        F.coalesce(F.col(f"_p{p}").cast("string"), F.lit("0")) for p in range(_PIECES)
    ])
    return added.select(F.sha2(line, 256).alias("fingerprint"), "row_count", *sums)


def verify_checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare `(path, sha256, sha1)` with a checksum list `(name, algorithm, checksum)` by file name."""
    named = files.withColumn("name", F.regexp_extract("path", r"([^/]*)\z", 1))
    found = F.when(F.lower("algorithm") == "sha1", F.col("sha1")).otherwise(F.col("sha256"))
    return named.join(expected, "name", "left").select(
        "name", "path", "algorithm", found.alias("actual"), F.lower("checksum").alias("expected"),
        F.when(F.col("checksum").isNull(), "not_listed")
        .when(found == F.lower("checksum"), "ok").otherwise("mismatch").alias("verdict"),
    )
