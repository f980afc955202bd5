"""Hard negatives of anchor vectors by table look-ups in place of products (the method of Four Russians).

Components are whole numbers. A candidate is stored as bit planes: for each bit of its components, from the sign down,
one byte for every eight dimensions. An anchor has, for every eight dimensions, a table of the sums of all 256 subsets of
its components. The inner product is then exact by look-ups and shifts alone: for each plane add the table entries that
the plane's bytes point at, and double the sum before the next plane (the sign's plane counts negative).

Anchors and candidates meet block by block on a grid: blocks are cut by a hash of the whole row, so no label and no
vector that many rows share fills a block. A cell gives the best few candidates of each anchor, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import released, require
from corpusloom.session import cut_lineage

GROUP = 8  # dimensions of a table
ANCHOR_BLOCK, CANDIDATE_BLOCK = 512, 16_384  # rows of a cell
_CHUNK = 512  # candidates scored at once
_PACKED = "vec_id long, label long, dims int, planes binary, key long"


def pack_planes(numbers: np.ndarray, planes: int) -> np.ndarray:
    """Rows of whole numbers as bit planes of two's complement, the sign first: (rows, planes, groups) bytes."""
    n, d = numbers.shape
    wide = np.zeros((n, -(-d // GROUP) * GROUP), np.int64)
    wide[:, :d] = numbers
    bits = [np.packbits((wide >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(planes - 1, -1, -1)]
    return np.stack(bits, axis=1)


def unpack_planes(packed: np.ndarray) -> np.ndarray:
    """The numbers that `pack_planes` was given, with zeros up to a whole group."""
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    weights = 1 << np.arange(packed.shape[1] - 1, -1, -1, dtype=np.int64)
    weights[0] = -weights[0]
    return np.einsum("npd,p->nd", bits, weights)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """For each group of dimensions the sums of all subsets of each anchor's components: (groups, 256, anchors)."""
    groups = anchors.shape[1] // GROUP
    sums = np.zeros((groups, 1 << GROUP, len(anchors)), kind)
    for g in range(groups):
        for bit in range(GROUP):
            half = 1 << bit
            sums[g, half : 2 * half] = sums[g, :half] + anchors[:, g * GROUP + bit].astype(kind)
    return sums


def look_up_scores(sums: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products of all anchors with all candidates: (anchors, candidates)."""
    n, planes, groups = packed.shape
    out = np.empty((sums.shape[2], n), sums.dtype)
    for start in range(0, n, _CHUNK):
        part = packed[start : start + _CHUNK]
        total = np.zeros((len(part), sums.shape[2]), sums.dtype)
        entry = np.empty_like(total)
        for plane in range(planes):
            if plane == 1:
                np.negative(total, out=total)  # what was added so far is the sign's plane
            total <<= 1
            for g in range(groups):
                total += np.take(sums[g], part[:, plane, g], axis=0, out=entry, mode="clip")
        out[:, start : start + _CHUNK] = (-total if planes == 1 else total).T
    return out


def best_columns(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k times the rows that have a best column left and that column, the first of equal ones. Changes `scores`."""
    least = np.iinfo(scores.dtype).min
    rows = np.arange(len(scores))
    for _ in range(k if scores.size else 0):
        column = scores[rows].argmax(axis=1)
        found = scores[rows, column] > least
        rows, column = rows[found], column[found]
        if not len(rows):
            return
        yield rows, column
        scores[rows, column] = least


class _Block:
    """The rows of a table of packed vectors of one size, in the order of ids."""

    def __init__(self, table: pa.Table, planes: int):
        table = table.sort_by([("vec_id", "ascending"), ("key", "ascending"), ("label", "ascending")])
        self.table = table
        self.id, self.key, self.label = (table[c].to_numpy() for c in ("vec_id", "key", "label"))
        raw = b"".join(table["planes"].to_pylist())
        self.planes = np.frombuffer(raw, np.uint8).reshape(table.num_rows, planes, -1) if raw else np.zeros((table.num_rows, planes, 0), np.uint8)


def _scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    numbers = unpack_planes(anchors)
    reach = int(np.abs(numbers).sum(axis=1).max(initial=0)) << anchors.shape[1]
    return look_up_scores(subset_sums(numbers, np.int32 if reach < 1 << 30 else np.int64), candidates)


def _blocks(left: pa.Table, right: pa.Table, planes: int) -> Iterator[tuple[_Block, _Block]]:
    """Anchors and candidates that have the same number of dimensions."""
    for d in np.unique(left["dims"].to_numpy()):
        mine, theirs = (t.filter(pa.array(t["dims"].to_numpy() == d)) for t in (left, right))
        if theirs.num_rows:
            yield _Block(mine, planes), _Block(theirs, planes)


_POSITIVES = "anchor_id long, anchor_key long, anchor_label long, positive_id long, positive_key long, positive_score long"
_NEGATIVES = "anchor_id long, anchor_key long, anchor_label long, place int, positive_id long, positive_score long, negative_id long, negative_key long, negative_score long"


def _rows(ddl: str, parts: list[list[np.ndarray]]) -> pa.Table:
    names, kinds = zip(*[field.split() for field in ddl.split(", ")])
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table([pa.array(c, pa.int32() if kind == "int" else pa.int64()) for c, kind in zip(columns, kinds)], names=list(names))


def _positives(planes: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for anchors, others in _blocks(left, right, planes):
            for label in np.unique(anchors.label):
                a, c = np.flatnonzero(anchors.label == label), np.flatnonzero(others.label == label)
                if not len(c):
                    continue
                scores = _scores(anchors.planes[a], others.planes[c])
                kept = scores.copy()
                kept[(anchors.id[a][:, None] == others.id[c]) & (anchors.key[a][:, None] == others.key[c])] = np.iinfo(kept.dtype).min
                for i, j in best_columns(kept, k):
                    own, other = a[i], c[j]
                    parts.append([anchors.id[own], anchors.key[own], anchors.label[own], others.id[other], others.key[other], scores[i, j]])
        return _rows(_POSITIVES, parts)

    return run


def _negatives(planes: int, k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for anchors, others in _blocks(left, right, planes):
            scores = _scores(anchors.planes, others.planes)
            least = np.iinfo(scores.dtype).min
            scores[anchors.label[:, None] == others.label] = least
            found = anchors.table["positives"].to_pylist()
            for place in range(max(map(len, found))):
                a = np.array([i for i, p in enumerate(found) if len(p) > place])
                ids, value = (np.array([found[i][place][c] for i in a], np.int64) for c in ("positive_id", "positive_score"))
                # low * p <= 100 * n <= high * p, as bounds of n
                floor, roof = -(-low * value // 100), high * value // 100
                mine = scores[a]
                kept = np.where((mine >= floor[:, None]) & (mine <= roof[:, None]), mine, least)
                for i, j in best_columns(kept, k):
                    own = a[i]
                    parts.append([
                        anchors.id[own], anchors.key[own], anchors.label[own], np.full(len(i), place), ids[i], value[i],
                        others.id[j], others.key[j], scores[own, j],
                    ])
        return _rows(_NEGATIVES, parts)

    return run


def whole_numbers(vectors: DataFrame, id: str, label: str, embedding: str, scale: int) -> DataFrame:
    """(`vec_id`, `label`, `numbers`): floor(scale * x) of the components, for rows that can take part."""
    usable = F.col(id).isNotNull() & F.col(label).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numbers = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(usable).select(F.col(id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), numbers.alias("numbers"))


def packed_vectors(numbers: DataFrame) -> tuple[DataFrame, int]:
    """Distinct rows as bit planes (`dims`, `planes`, and `key`, a hash that tells rows with one id apart), and the number of planes."""
    largest = numbers.agg(F.max(F.greatest(F.array_max("numbers"), -F.array_min("numbers"))), F.max(F.size("numbers"))).first()
    top, dims = largest[0] or 0, largest[1] or 0
    if top >= 1 << 62 or dims * (top + 1) * (top + 1) >= 1 << 62:
        raise ValueError("inner products of these vectors do not fit into 64 bits")
    planes = int(top).bit_length() + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("numbers")
            sizes = np.asarray(lists.value_lengths())
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                rows = pack_planes(flat.reshape(len(at), d), planes)
                ids, labels = (batch.column(c).take(pa.array(at)) for c in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(np.full(len(at), d, np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["vec_id", "label", "dims", "planes"],
                )

    packed = numbers.mapInArrow(released(pack), "vec_id long, label long, dims int, planes binary").distinct()
    return cut_lineage(packed.withColumn("key", F.xxhash64("dims", "planes")), "bit-planes"), planes


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id: str = "vec_id", label: str = "label", embedding: str = "embedding",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """(`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`), exact.

    Components become floor(`scale` * x); a score is the whole inner product with the anchor. Higher scores come first,
    then smaller ids. An anchor (`is_anchor`, a condition on the column `vec_id`) has as positives its first `positives`
    other rows of the same label, and each of them the first `negatives` rows of other labels with a score of `low` to
    `high` percent of the positive's. A positive without such rows gives none, and so does an anchor without positives.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no part. Rows equal in id,
    label and whole components count once; rows that only share an id are different rows, in the order of a hash of
    their components where scores and ids tie. Only vectors of the same number of dimensions are compared; those without
    any have the score 0. Products beyond 64 bits are an error. Other columns are not looked at.
    """
    require(vectors, id, label, embedding)
    if min(positives, negatives) < 1:
        raise ValueError("at least one positive and one negative")
    packed, planes = packed_vectors(whole_numbers(vectors, id, label, embedding, scale))
    marked = packed.filter(is_anchor)
    n, n_anchors = packed.count(), marked.count()
    a_blocks, c_blocks = max(1, -(-n_anchors // ANCHOR_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    block = lambda count: F.pmod(F.xxhash64("vec_id", "label", "key"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    anchors = marked.withColumn("a", block(a_blocks)).withColumn("c", every(c_blocks))
    others = packed.select(*[F.col(c).alias(c) for c in packed.columns]).withColumn("c", block(c_blocks)).withColumn("a", every(a_blocks))

    def cells(left: DataFrame, run: Callable, ddl: str) -> DataFrame:
        return left.groupBy("a", "c").cogroup(others.groupBy("a", "c")).applyInArrow(run, ddl)

    anchor = ["anchor_id", "anchor_key", "anchor_label"]
    near = cells(anchors, _positives(planes, positives), _POSITIVES)
    first = Window.partitionBy(*anchor).orderBy(F.desc("positive_score"), "positive_id", "positive_key")
    near = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    lists = near.groupBy(*anchor).agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    lists = cut_lineage(lists.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key"), F.col("anchor_label").alias("label"), "positives"), "positives")
    far = cells(anchors.join(lists, ["vec_id", "key", "label"]), _negatives(planes, negatives, low, high), _NEGATIVES)
    order = Window.partitionBy(*anchor, "place").orderBy(F.desc("negative_score"), "negative_id", "negative_key")
    ranked = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
