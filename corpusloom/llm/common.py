"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.session import may_broadcast, ship_package

CHUNK_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """What a job that uses Python workers needs: this package on the workers, Arrow batches of bounded bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def released(run: Callable) -> Callable:
    """`run`, a function over Arrow batches, that gives its memory back to the system when a task ends.

    Workers are used again for other stages; what allocators keep would add up to the executors' memory.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidy


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or `name` with underscores behind it if a column of `df` has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(df: DataFrame, rows: int, size: int) -> DataFrame:
    """`df` marked for a broadcast if its counted rows and bytes are within the library's bound."""
    return F.broadcast(df) if may_broadcast(rows, size) else df


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold about `limit` bytes of `text` at most, or one row."""
    for batch in batches:
        column = batch.column(text)
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        yield batch.slice(start)


def filled(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together as long as they hold no more than `limit` bytes of `text`, as each costs a step of its own."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        size = pc.sum(pc.binary_length(batch.column(text))).as_py() or 0
        if held and total + size > limit:
            yield pa.concat_batches(held)
            held, total = [], 0
        held.append(batch)
        total += size
    if held:
        yield pa.concat_batches(held)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column one after another, and the offsets of its rows; null rows are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def sha256_joined(values: Column) -> Column:
    """Lowercase hex of the values of an array, in decimal and joined by commas."""
    return F.sha2(F.concat_ws(",", values.cast("array<string>")), 256)


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of `df` with further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
