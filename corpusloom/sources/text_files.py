"""Text-file sources: one flat folder or file of `.txt`, or a whole tree of them."""

from __future__ import annotations

import functools
import posixpath
import re

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.session import bound_batches, expect_small_files, ship_package
from corpusloom.sources.lines import with_positions
from corpusloom.sources.small_files import list_small_files, one_form, read_whole


def local_name(uri: Column | str) -> Column:
    """A `file:` URI as the plain path it stands for; other schemes keep theirs."""
    return F.regexp_replace(tx.col(uri), r"\Afile:/+", "/")


def _whole_files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    expect_small_files(spark)
    small = list_small_files(spark, path, ".txt", recursive)
    others = [path] if small is None else small[1]
    files = []
    if small is not None:
        files.append(read_whole(small[0]))
    if others:
        read = spark.read.text(others, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=recursive)
        files.append(read.select((F.col("_metadata.file_path") if small is None else one_form(F.col("_metadata.file_path"))).alias("path"), "value"))
    return functools.reduce(DataFrame.unionByName, files).select(
        F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))).alias("uri"),
        tx.strip("value").alias("text"),
    )


def write_text_files(rows: DataFrame, path: str) -> None:
    """Write the rows (`file`, `value`) as lines of many small text files below `path`, which must not be there yet.

    A partition's rows of one `file` are its lines, so no two partitions may name the same one. The tasks write the files
    where they stay: Spark's own writer costs several processes a file on a local file system, and its driver moves each.
    The path is opened by the file systems that Arrow knows (local, HDFS, object stores). A task that is repeated
    overwrites its files.
    """
    root = re.sub(r"\Afile:/(?!/)", "file:///", path)
    spark = rows.sparkSession
    ship_package(spark)
    bound_batches(spark)

    def write(batches):
        system, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        system.create_dir(base, recursive=True)
        at, out, files = None, None, 0
        for batch in batches:
            for name, line in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                if name != at:
                    if out is not None:
                        out.close()
                    if "/" in name:
                        system.create_dir(posixpath.join(base, posixpath.dirname(name)), recursive=True)
                    at, out, files = name, system.open_output_stream(posixpath.join(base, name)), files + 1
                out.write((line or "").encode() + b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    rows.select("file", "value").sortWithinPartitions("file").mapInArrow(write, "files long").agg(F.sum("files")).collect()


def require_rows(df: DataFrame, message: str) -> None:
    if df.isEmpty():
        raise ValueError(message)


def read_text_sources(spark: SparkSession, path: str) -> DataFrame:
    """`(title, text, source)` of one `.txt` file or of the `.txt` files directly in a folder.

    Blank files are dropped; a folder without any `.txt` file is an error.
    """
    files = _whole_files(spark, path, recursive=False)
    require_rows(files.select("uri"), f"no .txt files found in {path}")
    return files.filter(F.length("text") > 0).select(
        tx.path_stem("uri").alias("title"), "text", local_name("uri").alias("source")
    )


def read_text_tree(spark: SparkSession, root: str) -> DataFrame:
    """Corpus documents of every `.txt` below `root`, in path-component order."""
    files = _whole_files(spark, root, recursive=True)
    require_rows(files.select("uri"), f"no .txt files found under {root}")
    base = local_name(F.lit(root.rstrip("/") + "/"))
    relative = F.substr(local_name("uri"), F.length(base) + 1)
    docs = files.filter(F.length("text") > 0).select(relative.alias("source"), "text")
    key = F.concat(F.lit(root.rstrip("/") + ":"), "source")
    made = docs.select(
        tx.document_id(F.lit(None).cast("string"), key, "text").alias("document_id"),
        tx.path_stem("source").alias("title"),
        "text",
        "source",
        tx.sha256_hex("text").alias("content_digest"),
        F.to_json(F.struct(F.col("source").alias("relative_path"))).alias("metadata"),
    )
    placed = with_positions(made, ["source"], [F.split("source", "/")])
    return placed.select("document_id", "title", "text", "source", "content_digest", "position", "metadata")


def check_source_path(root: str, path: str, text_only: bool = True) -> str:
    """A path below `root`, resolved; anything that leaves the root is refused. Both may have a scheme."""
    if not path.strip():
        raise ValueError("source path must not be empty")
    scheme, base = _parted(root)
    own, rest = _parted(path.strip())
    base = posixpath.normpath(base)
    full = posixpath.normpath(rest if own else posixpath.join(base, rest))
    if own not in ("", scheme) or full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError("source path must be inside the source folder")
    name = posixpath.basename(full)
    if text_only and "." in name and not name.endswith(".txt"):
        raise ValueError("only .txt files and folders are supported")
    return scheme + full


def _parted(path: str) -> tuple[str, str]:
    scheme, mark, rest = path.partition("://")
    return (scheme + mark, rest) if mark else ("", path)


def resolve_source(spark: SparkSession, root: str, path: str) -> str:
    """A `.txt` file or a folder below `root` that is there. Links of a local file system are followed before it is judged."""
    full = _without_links(spark, check_source_path(root, path, text_only=False))
    full = check_source_path(_without_links(spark, root), full, text_only=False)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(full)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop_path):
        raise ValueError(f"no source at {path.strip()!r}")
    if not full.endswith(".txt") and not files.getFileStatus(hadoop_path).isDirectory():
        raise ValueError("only .txt files and folders are supported")
    return full


def _without_links(spark: SparkSession, path: str) -> str:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return path
    return spark._jvm.java.io.File(hadoop_path.toUri().getPath()).getCanonicalPath()


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop_path).getLength()
