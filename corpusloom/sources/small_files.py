"""Folders of many small files, listed and read by the tasks.

Spark's readers list every file on the driver and open each through several layers, which for a million small files takes
longer than their contents and more memory than a driver has. Here the tasks list the folders level by level and read
small files whole, by the file systems that Arrow knows; large and compressed files are left to Spark's readers, and so is
everything where files are few or Arrow does not know the path.
"""

from __future__ import annotations

import os
import re
import stat
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage, ship_package

MANY_FILES = 2_000  # fewer are left to Spark's readers
WHOLE_FILE_BYTES = 32 << 20  # larger files too, which read them in blocks
TASK_BYTES = 64 << 20  # of files that one task reads
OPEN_BYTES = 16 << 10  # that opening a file counts for
_FOLDERS_A_TASK = 512
_BATCH_ROWS, _BATCH_BYTES = 10_000, 4 << 20
_CODED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".zstd")
_LISTED = "path string, folder boolean, size long"
_URI_SAFE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-!.~'()*:@&=+$,;/")
_BOM = b"\xef\xbb\xbf"


def list_small_files(spark: SparkSession, path: str, suffix: str = "", recursive: bool = False) -> tuple[DataFrame, list[str]] | None:
    """The files `(path, size)` of a folder that are read whole, and the paths of the others; None if all are for Spark's readers.

    As Spark lists them: hidden and empty files are not there, and without `recursive` only folders named `key=value` are
    entered. A path may end in `/*`.
    """
    root, several = (path[:-2], True) if path.endswith("/*") else (path, False)
    if re.search(r"[*?\[{\\]", root):
        return None
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    try:
        system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.getFileStatus(hadoop_path).isDirectory():
            return None
        uri = system.makeQualified(hadoop_path).toUri()
        if uri.getScheme() == "file":
            base, top = "", uri.getPath()
        else:
            base = f"{uri.getScheme()}://{uri.getAuthority()}"
            pafs.FileSystem.from_uri(base + "/")
            top = uri.getPath()
    except Exception:  # whatever this is, Spark's reader says what it thinks of it
        return None
    ship_package(spark)
    folders, levels, depth = spark.createDataFrame([(top.rstrip("/") or "/",)], "path string"), [], 0
    while True:
        enter_all = recursive or (several and depth == 0)
        listed = cut_lineage(folders.mapInArrow(_list_of(base, suffix, enter_all), _LISTED), "listed")
        levels.append(listed.filter(~F.col("folder")).select("path", "size"))
        folders = listed.filter("folder").select("path")
        n = folders.count()
        if not n:
            break
        folders, depth = folders.repartition(max(1, min(-(-n // _FOLDERS_A_TASK), 8 * spark.sparkContext.defaultParallelism))), depth + 1
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    coded = F.lit(False)
    for ending in _CODED:
        coded = coded | F.endswith("path", F.lit(ending))
    whole = (F.col("size") <= WHOLE_FILE_BYTES) & ~coded
    count, size = files.filter(whole).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if count < MANY_FILES:
        return None
    left = [row["path"] for row in files.filter(~whole).select("path").collect()]  # large, so not many
    others = [(base or "file://") + re.sub(r"([*?\[\]{}\\])", r"\\\1", name) for name in left]  # names, not patterns
    tasks = max(spark.sparkContext.defaultParallelism, -(-(size + count * OPEN_BYTES) // TASK_BYTES))
    named = files.filter(whole).select(F.lit(base).alias("base"), "path")
    return named.repartition(tasks, "path").sortWithinPartitions("path"), others  # the same rows in the same order each time


def read_whole(files: DataFrame, line_sep: str | None = None, by_line: bool = False) -> DataFrame:
    """`(path, value)` of listed files, the path as the URI that Spark gives: a row each or, `by_line`, one for each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        values: list[bytes] = []
        held, systems = 0, {}
        for batch in batches:
            for base, name in zip(batch.column("base").to_pylist(), batch.column("path").to_pylist()):
                if base not in systems:
                    systems[base] = pafs.FileSystem.from_uri(base + "/")[0] if base else None
                data = _content(systems[base], name)
                uri = (base or "file:") + quoted(name)
                found = _lines(data, line_sep) if by_line else [data]
                for at in range(0, len(found), _BATCH_ROWS):
                    part = found[at : at + _BATCH_ROWS]
                    values += part
                    names += [uri] * len(part)
                    held += sum(map(len, part))
                    if len(values) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                        yield _batch(names, values)
                        names, values, held = [], [], 0
        if values:
            yield _batch(names, values)

    ship_package(files.sparkSession)
    return files.mapInArrow(run, "path string, value string")


def _batch(names: list[str], values: list[bytes]) -> pa.RecordBatch:
    raw = pa.array(values, pa.binary())
    text = pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())  # bytes as they are, valid or not, as Spark reads them
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), text], names=["path", "value"])


def _content(system: pafs.FileSystem | None, name: str) -> bytes:
    if system is None:
        with open(name, "rb") as stream:
            return stream.read()
    with system.open_input_stream(name) as stream:
        return stream.read()


def _lines(data: bytes, line_sep: str | None) -> list[bytes]:
    """Lines as Hadoop's reader cuts them: a mark of the byte order is no text, and nothing follows the last line end."""
    data = data.removeprefix(_BOM)
    end = line_sep.encode() if line_sep else b"\n"
    if not line_sep:
        data = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    found = data.split(end)
    return found if found[-1] else found[:-1]


def one_form(path: Column) -> Column:
    """A URI of a local file as `read_whole` gives it; Spark's readers give two forms."""
    return F.regexp_replace(path, r"\Afile:/+", "file:/")


def quoted(path: str) -> str:
    """A path as Java writes it in a URI."""
    if _URI_SAFE.issuperset(path):
        return path
    return "".join(c if c in _URI_SAFE or (c > "\x7f" and unicodedata.category(c) not in ("Cc", "Zs", "Zl", "Zp")) else
                   "".join(f"%{b:02X}" for b in c.encode()) for c in path)


def _hidden(name: str) -> bool:
    return (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))) or name.startswith(".") or name.endswith("._COPYING_")


def _list_of(base: str, suffix: str, enter_all: bool):
    """Lists folders: their files that end in `suffix`, and the folders to enter next."""

    def entries(system, folder: str) -> Iterator[tuple[str, str, bool, int]]:
        if system is None:
            with os.scandir(folder) as found:
                for entry in found:
                    try:
                        known = entry.stat()  # of what a link leads to
                    except FileNotFoundError:
                        continue
                    yield entry.name, entry.path, stat.S_ISDIR(known.st_mode), known.st_size
        else:
            for info in system.get_file_info(pafs.FileSelector(folder)):
                yield info.base_name, info.path, info.type == pafs.FileType.Directory, info.size or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = pafs.FileSystem.from_uri(base + "/")[0] if base else None
        rows: list[tuple[str, bool, int]] = []
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for name, path, is_folder, size in entries(system, folder):
                    if _hidden(name):
                        continue
                    if (enter_all or "=" in name) if is_folder else (size and name.endswith(suffix)):
                        rows.append((path, is_folder, size))
                    if len(rows) >= _BATCH_ROWS:
                        yield _listed(rows)
                        rows = []
        if rows:
            yield _listed(rows)

    return run


def _listed(rows: list[tuple[str, bool, int]]) -> pa.RecordBatch:
    columns = zip(("path", "folder", "size"), zip(*rows), (pa.string(), pa.bool_(), pa.int64()))
    made = [(name, pa.array(list(values), kind)) for name, values, kind in columns]
    return pa.RecordBatch.from_arrays([array for _, array in made], names=[name for name, _ in made])
