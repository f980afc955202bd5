"""Columnar tables: driver inputs and chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas

def read_table(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """A Parquet table as it lies; with `spread`, for small single-file inputs, dealt over the cores."""
    table = spark.read.parquet(path)
    return table.repartition(spark.sparkContext.defaultParallelism) if spread else table


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunk rows of a JSONL chunk file, and the rows that lack a required field or do not parse."""
    permissive = schemas._struct(schemas.CHUNK_DDL + ", _corrupt STRING")
    rows = (
        spark.read.schema(permissive)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    return split_chunks(rows)


def split_chunks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    missing = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in schemas.CHUNK_FIELDS])
    )
    checked = rows.withColumn("missing", missing)
    bad = F.size("missing") > 0
    if "_corrupt" in rows.columns:
        bad = bad | F.col("_corrupt").isNotNull()
    good = checked.filter(~bad).select(*schemas.CHUNK_FIELDS)
    return good, checked.filter(bad).select("id", "missing")
