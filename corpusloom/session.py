"""Session defaults and the shared scratch location used by jobs that write intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; `conf` keys use `__` in place of dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, read from `spark.checkpoint.dir`.

    Only a single-process master may fall back to a temporary folder: on a cluster a machine-local
    path would be invisible to the other executors and lost with the node.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


STORED = "zstd"  # compression of what jobs write; texts and sorted keys take far less than by Spark's default


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back: reliable, and evaluated exactly once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", STORED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MAX_BROADCAST_KEYS = 1_000_000
MAX_BROADCAST_KEY_BYTES = 128 << 20


def may_broadcast(rows: int, size: int) -> bool:
    return rows <= MAX_BROADCAST_KEYS and size <= MAX_BROADCAST_KEY_BYTES


def key_bytes(*columns: str) -> Column:
    """Bytes of one row of keys, as text."""
    return sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(8))


class CheckedKeys(NamedTuple):
    """A key table evaluated once, with its rows and whether it may be broadcast."""

    keys: DataFrame
    rows: int
    small: bool


def checked_keys(keys: DataFrame) -> CheckedKeys:
    """Evaluate a narrow key table once and measure it, to decide whether it may be broadcast."""
    stored = cut_lineage(keys, "keys")
    rows, size = stored.agg(F.count("*"), F.coalesce(F.sum(key_bytes(*stored.columns)), F.lit(0))).first()
    return CheckedKeys(stored, rows, may_broadcast(rows, size))


ARROW_BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches of rows that go to Python workers end at so many bytes; a count of rows alone does not bound texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


FILE_COST = 128 << 10  # bytes that opening a file counts for when files are put together to tasks
LISTING_TASKS_A_CORE = 4


def expect_small_files(spark: SparkSession) -> None:
    """Many small files are listed and read by few tasks: by Spark's defaults up to 10,000 list folders, and a task reads 32
    files at most, as each counts for 4 MB."""
    spark.conf.set("spark.sql.files.openCostInBytes", str(FILE_COST))
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(LISTING_TASKS_A_CORE * spark.sparkContext.defaultParallelism))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system its scheme names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern with wildcards matches, in name order."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return sorted(str(status.getPath()) for status in found or [])


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove one table or partition folder; False when it was already gone."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def put_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not be there yet."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop_path, False)
    try:
        out.writeUTF(text)
    finally:
        out.close()


def read_small(spark: SparkSession, path: str) -> str | None:
    """What `put_once` wrote; None if it was not written to its end."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    file = files.open(hadoop_path)
    try:
        if files.getFileStatus(hadoop_path).getLen() < 2:
            return None
        length = file.readUnsignedShort()
        if files.getFileStatus(hadoop_path).getLen() < 2 + length:
            return None
        file.seek(0)
        return file.readUTF()
    finally:
        file.close()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_corpusloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for module in sorted(root.rglob("*.py")):
            bundle.write(module, module.relative_to(root.parent))
    context.addPyFile(str(archive))  # Spark copies it to every executor
    context._corpusloom_shipped = True
