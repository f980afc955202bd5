"""Nearest neighbours through cells: an inverted file over k-means centres.

Every vector lies in the cell of its nearest centre. A query probes cells from the nearest on, and only vectors of these
are compared with it. Two ways to stop:

* approximate: as soon as the probed cells hold enough rows, by their counted sizes. How many are enough is measured
  (`enough_rows`): on vectors that form clusters a small share, on evenly spread ones most of them;
* exact: a second pass goes to every cell that could still hold a better neighbour than the k-th found. With a unit
  query no vector of a cell scores more than its centre does plus the cell's radius, so the rest is skipped.

Vectors are scanned where they lie, best in the order of their cells (`by_cell`). Slices of the queries, of bounded size, are
broadcast with a bit for each cell that a query probes; only the best rows of a task are shuffled (see `blocked`). So a
vector is never repeated for a cell, nor a query, and a cell that holds a third of all rows lies in many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors as vx
from corpusloom.operators import blocked
from corpusloom.operators.blocked import NO_MATCH
from corpusloom.operators.lexical import check_limit
from corpusloom.operators.vectors import COSINE, VectorScorer
from corpusloom.operators.vectors import search as search_all
from corpusloom.session import cut_lineage, ship_package

SAMPLE_A_CELL = 64  # vectors that centres are fitted on, for each of them
MAX_SAMPLE = 1 << 18
MAX_CENTRE_BYTES = 64 << 20
ROUNDS = 8
TARGET_RECALL = 0.95
MEASURED_QUERIES = 256  # stored vectors whose neighbours are looked up to find how far a query has to go
_MARGIN = 0.01  # above the target, as some queries stand for all
FIRST_ROWS = 1_000  # that an exact query compares before it knows how far it has to go
_SLACK = 2.0 / blocked.SCORE_UNIT  # scores are compared at nine digits

SUMMARY_DDL = "cell int, rows long, radius double"


def unit(embedding: str = "embedding"):
    """A vector at length one; a zero vector stays."""
    return vx.l2_normalize(F.col(embedding).cast("array<double>"))


def cell_count(rows: int, dimensions: int) -> int:
    """About the square root of the rows, as far as the centres may be broadcast."""
    return max(1, min(math.isqrt(max(rows, 1)), MAX_CENTRE_BYTES // (8 * max(dimensions, 1))))


def train(vectors: DataFrame, cells: int | None = None, seed: int = 42) -> np.ndarray:
    """Centres of `vectors` (`id`, `embedding`), by k-means over a sample of bounded size.

    The sample are the rows with the least hashes of their ids: `SAMPLE_A_CELL` for each cell, `MAX_SAMPLE` at most. Which
    rows were sampled decides how fast a search is, never whether a vector is indexed.
    """
    rows, dimensions = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not rows:
        return np.zeros((0, 0))
    cells = cell_count(rows, dimensions) if cells is None else max(1, min(cells, rows))
    chosen = vectors.orderBy(F.xxhash64("id")).limit(min(cells * SAMPLE_A_CELL, MAX_SAMPLE))
    sample = cut_lineage(chosen.select(array_to_vector(unit()).alias("features")), "sample")
    model = KMeans(k=cells, seed=seed, maxIter=ROUNDS, initMode="random").fit(sample)
    return np.array(model.clusterCenters())


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """`vectors` with `cell`, that of the nearest centre, and `reach`, the distance from it, at length one. Map-only."""
    spark = vectors.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(centres)
    scorer = VectorScorer(COSINE)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        half = (middle**2).sum(axis=1) / 2
        for batch in batches:
            if not batch.num_rows:
                continue
            given = scorer.matrix(batch.column("embedding"))
            cell = np.argmax(given @ middle.T - half, axis=1)
            reach = np.sqrt(((given - middle[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(reach)], names=[*batch.schema.names, "cell", "reach"]
            )

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(place, f"{kind}, cell int, reach double")


def by_cell(assigned: DataFrame) -> DataFrame:
    """Assigned vectors in the order of their cells, over as many tasks as run at once; `assigned` is looked at twice."""
    tasks = assigned.sparkSession.sparkContext.defaultParallelism
    return assigned.repartitionByRange(tasks, "cell", "id").sortWithinPartitions("cell", "id")


def summary(assigned: DataFrame) -> DataFrame:
    """(`cell`, `rows`, `radius`) of assigned vectors."""
    return assigned.groupBy("cell").agg(F.count("*").alias("rows"), F.max("reach").alias("radius"))


class Probes:
    """Cells with their centres, counted rows and radii; empty ones are left out."""

    def __init__(self, centres: np.ndarray, counted: DataFrame):
        """`counted` has at most one row a centre, whose number is bounded by the bytes of the centres."""
        found = sorted((r["cell"], r["rows"], r["radius"]) for r in counted.collect())
        self.cell = np.array([c for c, _, _ in found], np.int32)
        self.rows = np.array([n for _, n, _ in found], np.int64)
        self.radius = np.array([r for _, _, r in found], float)
        self.centres = centres[self.cell] if len(found) else np.zeros((0, centres.shape[1] if centres.size else 0))

    def nearest(self, queries: np.ndarray, enough: int) -> np.ndarray:
        """Marks (queries x cells) the nearest cells that hold `enough` rows together."""
        return self.rows_before(queries) < enough

    def rows_before(self, queries: np.ndarray) -> np.ndarray:
        """For each cell the rows of those that are nearer to the query."""
        near = queries @ self.centres.T - (self.centres**2).sum(axis=1) / 2
        order = np.argsort(-near, axis=1, kind="stable")
        rows = self.rows[order]
        before = np.empty(near.shape, np.int64)
        np.put_along_axis(before, order, np.cumsum(rows, axis=1) - rows, axis=1)
        return before

    def reachable(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Marks the cells that may hold a vector with a score of `least` or more."""
        return queries @ self.centres.T + self.radius + _SLACK >= least[:, None]


def probe(queries: DataFrame, probes: Probes, enough: int, beyond: bool = False) -> DataFrame:
    """(`query_id`, `embedding`, `cells`, `probed`): a bit for each of the probes' cells, the first one highest, and their number.

    First the nearest cells with `enough` rows; with `beyond` instead the cells that those left out and that can reach the
    query's `least` score. Queries without any are left out.
    """
    spark = queries.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(probes)
    scorer = VectorScorer(COSINE)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, blocked.QUERY_BLOCK):
                part = batch.slice(at, blocked.QUERY_BLOCK)
                given = scorer.matrix(part.column("embedding"))
                marks = known.nearest(given, enough)
                if beyond:
                    marks = ~marks & known.reachable(given, part.column("least").to_numpy(zero_copy_only=False))
                probed = marks.sum(axis=1)
                some = np.flatnonzero(probed)
                taken = part.take(pa.array(some))
                bits = [row.tobytes() for row in np.packbits(marks[some], axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [taken.column("query_id"), taken.column("embedding"), pa.array(bits, pa.binary()), pa.array(probed[some].astype(np.int32))],
                    names=["query_id", "embedding", "cells", "probed"],
                )

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInArrow(mark, f"query_id {kind}, embedding array<double>, cells binary, probed int")


class CellScorer:
    """Scores only the pairs whose query probes the item's cell, by one product for each cell of a block."""

    def __init__(self, scorer: VectorScorer, cell: np.ndarray, k: int):
        self.scorer, self.cell, self.k = scorer, cell, k
        self._seen = None  # the block that was laid out last, as it meets many blocks of queries

    def prepare(self, queries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        bits = b"".join(queries.column("cells").to_pylist())
        return self.scorer.prepare(queries), np.frombuffer(bits, np.uint8).reshape(queries.num_rows, -(-len(self.cell) // 8))

    def _parts(self, items: pa.RecordBatch) -> list[tuple[int, np.ndarray, pa.RecordBatch, VectorScorer]]:
        """Place of the cell, columns, items and their scorer, for each cell of a block; rows that repeat the one before are left out."""
        if self._seen is None or self._seen[0] is not items:
            given = items.column("cell").to_numpy(zero_copy_only=False)
            ids, vectors = np.array(items.column("id").to_pylist(), object), self.scorer.matrix(items.column("embedding"))
            parts = []
            for cell in np.unique(given):
                columns = np.flatnonzero(given == cell)
                repeated = np.zeros(len(columns), bool)
                repeated[1:] = (ids[columns[1:]] == ids[columns[:-1]]) & (vectors[columns[1:]] == vectors[columns[:-1]]).all(axis=1)
                columns = columns[~repeated]
                parts.append((int(np.searchsorted(self.cell, cell)), columns, items.take(pa.array(columns)), VectorScorer(self.scorer.mode)))
            self._seen = items, parts
        return self._seen[1]

    def _asking(self, state: tuple[np.ndarray, np.ndarray], items: pa.RecordBatch) -> Iterator[tuple]:
        """The parts with the queries that probe their cell."""
        for at, columns, part, scorer in self._parts(items):
            rows = np.flatnonzero(state[1][:, at >> 3] & (128 >> (at & 7)))
            if len(rows):
                yield rows, columns, part, scorer

    def keys(self, state: tuple[np.ndarray, np.ndarray], items: pa.RecordBatch) -> np.ndarray:
        found = np.full((len(state[0]), items.num_rows), NO_MATCH)
        for rows, columns, part, scorer in self._asking(state, items):
            found[np.ix_(rows, columns)] = scorer.keys(state[0][rows], part)
        return found

    def candidates(
        self, state: tuple[np.ndarray, np.ndarray], items: pa.RecordBatch, floor: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `Scorer.candidates`; queries without a floor give the k best of a cell, as more cannot count."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for rows, columns, part, scorer in self._asking(state, items):
            known = floor[rows] != NO_MATCH
            if known.any():
                query, column, key = scorer.candidates(state[0][rows[known]], part, floor[rows[known]])
                found.append((rows[known][query], columns[column], key))
            if not known.all():
                keys = scorer.keys(state[0][rows[~known]], part)
                best = blocked._top_columns(keys, self.k)
                query = np.repeat(rows[~known], best.shape[1])
                found.append((query, columns[best.ravel()], np.take_along_axis(keys, best, axis=1).ravel()))
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _nearest_probed(stored: DataFrame, asked: DataFrame, probes: Probes, k: int, **layout: int) -> DataFrame:
    """The k best of each query of `asked`, a stored table of `probe`, among the cells it probes; a pair counts once."""
    size = F.size("embedding") * 8 + F.octet_length("cells") + 32
    reducer = blocked.TopK(CellScorer(VectorScorer(COSINE), probes.cell, k), k, distinct=True)
    found, _ = blocked.reduce_items(stored, asked.drop("probed"), reducer, size, **layout)
    # rows with equal ids are one; both steps need the rows of a query together
    once = found.repartition("query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return blocked.rank_rows(once, k)


def enough_rows(assigned: DataFrame, probes: Probes, k: int = 10, target: float = TARGET_RECALL) -> int:
    """Rows that a query has to compare so that `target` of its k nearest are among them.

    Measured on `MEASURED_QUERIES` stored vectors, those with the least hashes: for each of their neighbours, found by an
    exact scan and without the vector itself, the rows of all cells that are nearer than the neighbour's.
    """
    total = int(probes.rows.sum())
    stored = assigned.select("id", F.col("embedding").cast("array<double>").alias("embedding"), "cell")
    asked = cut_lineage(stored.orderBy(F.xxhash64(F.lit(7), "id")).limit(MEASURED_QUERIES).select(F.col("id").alias("query_id"), "embedding"), "measured")
    nearest, _ = search_all(stored, asked, k + 1)
    nearest = cut_lineage(nearest.filter(F.col("id") != F.col("query_id")).select("query_id", "id"), "nearest")
    placed = stored.select("id", "cell").join(F.broadcast(nearest), "id")  # no more than queries times k
    cells_of: dict[str, list[int]] = {}
    for row in placed.collect():
        cells_of.setdefault(row["query_id"], []).append(row["cell"])
    given = [(r["query_id"], r["embedding"]) for r in asked.collect() if r["query_id"] in cells_of]
    if not given:
        return total
    before = probes.rows_before(VectorScorer(COSINE).matrix(pa.array([v for _, v in given], pa.list_(pa.float64()))))
    at = {c: i for i, c in enumerate(probes.cell.tolist())}
    depths = [before[i, at[c]] + 1 for i, (q, _) in enumerate(given) for c in cells_of[q]]
    return int(min(total, np.quantile(depths, min(1.0, target + _MARGIN), method="higher")))


def search(
    assigned: DataFrame, queries: DataFrame, centres: np.ndarray, counted: DataFrame, k: int = 10, exact: bool = True,
    enough: int | None = None, **layout: int,
) -> DataFrame:
    """The k nearest vectors of every query by cosine: `(query_id, id, score, rank)`, ties to the lower id.

    `assigned` has `id`, `embedding`, `cell`, `counted` the `summary` of all its rows. With `exact` the result is that of
    `vectors.search`, which takes over if the bounds leave more than half of the cells to go to. Without `exact`
    neighbours in cells that were not probed are missed; a query compares at least `enough` rows, by default as many as
    `enough_rows` finds. Queries that are null, empty or not finite are an error.
    """
    check_limit(k)
    probes = Probes(centres, cut_lineage(counted, "cell-sizes"))
    total = int(probes.rows.sum())
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    stored = assigned.select("id", F.col("embedding").cast("array<double>").alias("embedding"), "cell")
    if not total:
        return blocked.rank_rows(asked.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("score")).limit(0), k)
    if enough is None:
        enough = FIRST_ROWS if exact else enough_rows(stored, probes, k)
    enough = min(total, max(k, enough))
    first = _nearest_probed(stored, cut_lineage(probe(asked, probes, enough), "probes"), probes, k, **layout)
    if not exact or enough >= total:
        return first
    first = cut_lineage(first, "probed")
    worst = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("found"))
    bounded = asked.join(worst, "query_id", "left").select(
        "query_id", "embedding", F.when(F.col("found") >= k, F.col("least")).otherwise(float("-inf")).alias("least")
    )
    further = cut_lineage(probe(bounded, probes, enough, beyond=True), "further-probes")
    probed = further.agg(F.coalesce(F.sum("probed"), F.lit(0))).first()[0]
    if not probed:
        return first
    if 2 * probed > asked.count() * len(probes.cell):
        return search_all(stored.select("id", "embedding"), asked, k, COSINE, **layout)[0]
    second = _nearest_probed(_in_cells(stored, probes, further), further, probes, k, **layout)
    return blocked.rank_rows(first.drop("rank").unionByName(second.drop("rank")), k)


def _in_cells(stored: DataFrame, probes: Probes, asked: DataFrame) -> DataFrame:
    """Stored vectors of the cells that are asked for; with few of them the scan skips what lies in others."""

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                at = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0)))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32))], names=["at"])

    rows = asked.select("cells").mapInArrow(union, "at int").distinct().collect()  # no more than there are centres
    wanted = sorted(probes.cell[[r["at"] for r in rows]].tolist())
    return stored.filter(F.col("cell").isin(wanted)) if len(wanted) < len(probes.cell) else stored


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the queries, the neighbours that an exact search gives, and how many of these were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("expected"), F.count("hit").alias("found"))
