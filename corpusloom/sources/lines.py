"""Physical line numbers and corpus positions without moving the texts.

A task reads a file block in order, so `monotonically_increasing_id` counts the rows of a block; how
many rows lie before the block comes from a small table of block sizes. That table is evaluated once,
counted, and broadcast while it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from corpusloom.session import CheckedKeys, checked_keys, cut_lineage, expect_small_files
from corpusloom.sources.small_files import list_small_files, one_form, read_whole

_BLOCK = ["path", "block"]


def read_lines(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """`(path, block, value)` of line files, in file order inside a block. Lines end at LF, CR or CR LF, or at `line_sep`."""
    expect_small_files(spark)
    small = list_small_files(spark, path) if isinstance(path, str) else None
    if small is None:
        return lines_of(spark.read.text(path, lineSep=line_sep))
    files, others = small
    found = read_whole(files, line_sep, by_line=True).select("path", F.lit(0).cast("bigint").alias("block"), "value")
    if not others:
        return found
    left = lines_of(spark.read.text(others, lineSep=line_sep))
    return found.unionByName(left.withColumn("path", one_form(F.col("path"))))


def lines_of(text: DataFrame) -> DataFrame:
    return text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _count_rows(rows: DataFrame, name: str, first: int, across_files: bool) -> tuple[DataFrame, CheckedKeys]:
    """Number rows that are still in scan order; also the table of block sizes `_n`.

    Sizes are summed in two levels: the blocks are sorted into pieces, one window runs inside each piece, the other over
    one row a piece. A broadcast block table leaves the rows where they are.
    """
    marked = rows.withColumn("_mark", F.monotonically_increasing_id())
    blocks = marked.groupBy(*_BLOCK).agg(F.min("_mark").alias("_first"), F.count("*").alias("_n"))
    sizes = checked_keys(blocks.orderBy(*_BLOCK).withColumn("_piece", F.spark_partition_id()))
    group = [] if across_files else ["path"]
    inside = _ahead("_n", Window.partitionBy(*group, "_piece").orderBy(*_BLOCK))
    pieces = sizes.keys.groupBy(*group, "_piece").agg(F.sum("_n").alias("_size"))
    pieces = pieces.select(*group, "_piece", _ahead("_size", Window.partitionBy(*group).orderBy("_piece")).alias("_pieces"))
    offsets = sizes.keys.withColumn("_inside", inside).join(F.broadcast(pieces) if sizes.small else pieces, [*group, "_piece"])
    offsets = offsets.select(*_BLOCK, (F.col("_pieces") + F.col("_inside") - F.col("_first") + first).alias("_offset"))
    numbered = marked.join(F.broadcast(offsets) if sizes.small else offsets, _BLOCK).withColumn(name, F.col("_mark") + F.col("_offset"))
    return numbered.drop("_mark", "_offset"), sizes


def _ahead(size: str, order: WindowSpec) -> Column:
    """Sum of `size` over the rows before this one."""
    return F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def number_lines(lines: DataFrame) -> DataFrame:
    """Add the 1-based physical `line` of the file, blank lines counted."""
    return _count_rows(lines, "line", 1, across_files=False)[0]


def place_lines(lines: DataFrame, name: str = "place") -> tuple[DataFrame, int]:
    """Add the 0-based place of every row over all files, in the order of their paths; also the number of rows."""
    numbered, sizes = _count_rows(lines, name, 0, across_files=True)
    return numbered, sizes.keys.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def number_kept(lines: DataFrame, keep, name: str = "position") -> DataFrame:
    """`keep(numbered lines)` with the 0-based position of every remaining row over all files.

    `keep` may filter and project, but not reorder; it has to keep `path`, `block` and `line`.
    """
    numbered, sizes = _count_rows(lines, "line", 1, across_files=False)
    kept = keep(numbered)
    if sizes.small:
        return _count_rows(kept, name, 0, across_files=True)[0]
    return with_positions(kept, ["path", "line"], [F.col("path"), F.col("line")], name)


def with_positions(rows: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Add the 0-based position of every row in `order`; `keys` identify a row.

    Only the keys are sorted. The sorted keys are written to the shared folder: its files are then
    numbered pieces, and a piece's offset is the size of the pieces before it.
    """
    sorted_keys = rows.select(*keys).orderBy(*order).withColumn("_piece", F.spark_partition_id()).withColumn(
        "_mark", F.monotonically_increasing_id()
    )
    stored = cut_lineage(sorted_keys, "positions")
    pieces = stored.groupBy("_piece").agg(F.min("_mark").alias("_first"), F.count("*").alias("_n"))
    before = _ahead("_n", Window.orderBy("_piece"))  # one row per sorted piece: a few thousand at most
    offsets = pieces.select("_piece", (before - F.col("_first")).alias("_offset"))
    numbered = checked_keys(
        stored.join(offsets, "_piece").select(*keys, (F.col("_mark") + F.col("_offset")).alias(name))
    )
    return rows.join(F.broadcast(numbered.keys) if numbered.small else numbered.keys, keys)
