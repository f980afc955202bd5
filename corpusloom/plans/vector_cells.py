"""The inverted file of a stored vector index: centres once, then the vectors of each committed batch by cell.

In the folder of the index's generation `cells/centres` holds the centres, `cells/vectors/batch=<n>` a batch's vectors in the order of
cells, so that a filter on cells skips row groups, and `cells/summary/batch=<n>` the rows and radii of its cells.
The summary is written last: a batch counts from then on, and what an attempt that died left is overwritten.
`cells/depth` has the share of all rows that an approximate query compares; it is measured anew when the rows have doubled.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import cells
from corpusloom.plans import index_store as store
from corpusloom.session import cut_lineage, matching_paths, path_exists

_STORED = "id STRING, embedding ARRAY<DOUBLE>, cell INT, reach DOUBLE"


def _folder(spark: SparkSession, path: str) -> str:
    return f"{store.home(spark, path)}/cells"


def indexed_batches(spark: SparkSession, path: str) -> list[int]:
    """The batches of the index that lie in cells."""
    found = (re.search(r"batch=(\d+)/_SUCCESS\Z", name) for name in matching_paths(spark, f"{_folder(spark, path)}/summary/batch=*/_SUCCESS"))
    return sorted(int(match[1]) for match in found if match)


def centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{_folder(spark, path)}/centres").orderBy("cell").collect()  # bounded by `cells.cell_count`
    return np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))


def refresh(spark: SparkSession, path: str, n_cells: int | None = None) -> list[int]:
    """Bring all committed batches of a vector index into cells; returns the batches that were added.

    The first call fits the centres on what is there. Later ones read the new batches only and keep the centres, however
    the vectors have changed since; searches stay right, and `rebuild` of the index fits them anew.
    """
    done = set(indexed_batches(spark, path))
    missing = [n for n in store.committed_batches(spark, path) if n not in done]
    if not missing:
        return []
    folder = _folder(spark, path)
    if not path_exists(spark, f"{folder}/centres/_SUCCESS"):
        made = cells.train(store.index_table(spark, path, "vectors").select("id", "embedding"), n_cells)
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(made)]
        spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    middle = centres(spark, path)
    for n in missing:
        added = spark.read.parquet(store.batch_folder(store.home(spark, path), "vectors", n)).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        placed = cells.assign(added, middle) if len(middle) else spark.createDataFrame([], _STORED)
        target = store.batch_folder(folder, "vectors", n)
        cut = cut_lineage(placed, "placed")  # a range shuffle looks at its input twice
        cut.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(target)
        cells.summary(spark.read.schema(_STORED).parquet(target)).coalesce(1).write.mode("overwrite").parquet(store.batch_folder(folder, "summary", n))
    _measure(spark, path, max(missing))
    return missing


def _depths(spark: SparkSession, path: str) -> list[str]:
    return sorted(n.rsplit("/", 1)[0] for n in matching_paths(spark, f"{_folder(spark, path)}/depth/batch=*/_SUCCESS"))


def _measure(spark: SparkSession, path: str, batch: int) -> None:
    vectors, counted = _tables(spark, path)
    known = _depths(spark, path)
    total = counted.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if not total or known and total < 2 * spark.read.parquet(known[-1]).first()["rows"]:
        return
    enough = cells.enough_rows(vectors, cells.Probes(centres(spark, path), counted))
    row = spark.createDataFrame([(total, enough / total)], "rows long, share double")
    row.coalesce(1).write.mode("overwrite").parquet(store.batch_folder(_folder(spark, path), "depth", batch))


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    done = indexed_batches(spark, path)
    if not done:
        raise FileNotFoundError(f"index {path} has no cells")
    folder = _folder(spark, path)
    vectors = spark.read.schema(_STORED).parquet(*[store.batch_folder(folder, "vectors", n) for n in done])
    parts = spark.read.schema(cells.SUMMARY_DDL).parquet(*[store.batch_folder(folder, "summary", n) for n in done])
    return vectors, parts.groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, exact: bool = True, enough: int | None = None) -> DataFrame:
    """The k nearest stored vectors of `queries` (`query_id`, `embedding`) by cosine; see `cells.search`.

    Only batches in cells are searched: an index with younger ones is an error, `refresh` it first.
    """
    if indexed_batches(spark, path) != store.committed_batches(spark, path):
        raise ValueError(f"index {path} has batches that are not in cells yet")
    vectors, counted = _tables(spark, path)
    depth = _depths(spark, path)
    if not exact and enough is None and depth:
        total = counted.agg(F.sum("rows")).first()[0] or 0
        enough = math.ceil(total * spark.read.parquet(depth[-1]).first()["share"])
    return cells.search(vectors, queries, centres(spark, path), counted, k, exact, enough)
