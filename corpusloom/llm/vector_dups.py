"""Near-duplicate vectors by tile products of 8-bit codes with exact error bounds.

Vectors are compared within their label. Copies are folded to one class with a weight first. The classes of a label
are dealt to tiles of bounded size, and every pair of tiles is a group of its own, so a label of any size is spread
over tasks. A group multiplies the tiles' codes: with u = s q + e the product of two unit vectors differs from
s s' q.q' by at most (1 + |e|) |e'| + |e|, so only pairs that this allows above the threshold are computed in double
precision. A group gives sums of weights and, of its links, a star for each connected part: never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import require
from corpusloom.llm.components import connected_components
from corpusloom.session import cut_lineage, key_bytes, may_broadcast

THRESHOLD = 0.98
TILE_ROWS = 1024
_EXACT_SUM = 1 << 24  # integers up to here are exact in single precision
_SLACK = 1e-9  # above any rounding of the double-precision steps


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit codes, scales and the lengths of the errors of unit vectors."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1) + 1e-12


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of codes, exact: whole numbers in single precision, over so many dimensions at a time that they fit."""
    step = _EXACT_SUM // (127 * 127)
    total = a[:, :step].astype(np.float32) @ b[:, :step].astype(np.float32).T
    for k in range(step, a.shape[1], step):
        total = total.astype(np.float64) + a[:, k : k + step].astype(np.float32) @ b[:, k : k + step].astype(np.float32).T
    return total


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs of rows of `x` and `y` with a cosine of `threshold` or more, in double precision."""
    norms = [np.linalg.norm(v, axis=1) for v in (x, y)]
    (qa, sa, ea), (qb, sb, eb) = (quantised(v / n[:, None]) for v, n in zip((x, y), norms))
    bound = code_products(qa, qb) * sa[:, None] * sb[None] + ((1 + ea)[:, None] * eb[None] + ea[:, None])
    i, j = np.nonzero(bound >= threshold - _SLACK)
    kept = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        at = slice(k, k + (1 << 16))
        kept[at] = np.einsum("nd,nd->n", x[i[at]], y[j[at]]) / (norms[0][i[at]] * norms[1][j[at]]) >= threshold
    return i[kept], j[kept]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of `n` nodes the least node that it reaches over the links (a, b)."""
    least = np.arange(n)
    while len(a):
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if (least == before).all():
            break
    return least


def _tile_pair(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks()
        order = np.argsort(batch["id"].to_numpy(), kind="stable")
        batch = batch.take(order)
        id, weight, tile = (batch[c].to_numpy() for c in ("id", "weight", "tile"))
        i, j = batch["i"][0].as_py(), batch["j"][0].as_py()
        flat = batch["vector"].combine_chunks()
        vectors = np.asarray(flat.flatten(), np.float64).reshape(len(id), -1)
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        none = np.zeros(0, np.int64)
        a, b = close_pairs(vectors[left], vectors[right], threshold) if len(left) and len(right) else (none, none)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        links = np.bincount(a, weight[b], len(id)) + np.bincount(b, weight[a], len(id))
        least = stars(len(id), a, b)
        some = links > 0
        return pa.table({"id": id[some], "links": links[some].astype(np.int64), "to": id[least[some]]})

    return run


def vector_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row (`id`, `n_links`, `component_id`, `kept`) for each row of `vectors`.

    Two vectors are linked if their labels are equal and not null, they have the same size, and their cosine in
    double precision is `threshold` or more. `n_links` counts the other rows linked directly, copies too;
    `component_id` is the least id reachable, its own included; `kept` marks the row that has it.

    Vectors that are null, empty or all zero, or hold a null or a non-finite component, and vectors without a label
    link with nothing and are kept. Each row counts as a vector, also where rows repeat; an id that stands for several
    different vectors has the links and the component of all of them. A null id cannot be named: its row has no links,
    a null component, and is not kept. Other columns play no part.
    """
    require(vectors, id, vector, label)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = vectors.select(F.col(id).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    name = F.struct("label", F.size("vector").alias("size"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    named = rows.select("id", F.when(F.col("ok"), name).alias("name"), F.when(F.col("ok"), F.col("vector")).alias("vector"))
    classes = named.filter(F.col("name").isNotNull()).groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = classes.select("name", "id", "weight", "vector", "name.label", "name.size")
    classes = cut_lineage(classes, "classes")

    counts = cut_lineage(classes.groupBy("label", "size").agg(F.count("*").alias("n")), "labels")
    total, size = counts.agg(F.count("*"), F.coalesce(F.sum(key_bytes("label", "size", "n")), F.lit(0))).first()
    tiles = F.ceil(F.col("n") / TILE_ROWS).cast("int")
    dealt = classes.join(F.broadcast(counts) if may_broadcast(total, size) else counts, ["label", "size"])
    dealt = dealt.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("i"), F.greatest(t, "tile").alias("j")))
    spread = dealt.select("label", "size", "tile", "id", "weight", "vector", F.explode(pairs).alias("pair")).select("label", "size", "pair.i", "pair.j", "tile", "id", "weight", "vector")
    kind = spread.schema["id"].dataType.simpleString()
    found = spread.groupBy("label", "size", "i", "j").applyInArrow(_tile_pair(threshold), f"id {kind}, links long, to {kind}")
    found = cut_lineage(found, "tile-links")

    parts = connected_components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    links = links.join(parts.withColumnRenamed("node", "id"), "id", "left")
    done = classes.select("name", "id", "weight").join(links, "id", "left")
    done = cut_lineage(done.select("name", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c")), "components")
    none = named.filter(F.col("name").isNull()).select("id", F.lit(None).cast("long").alias("n"), F.col("id").alias("c"))
    out = named.filter(F.col("name").isNotNull()).select("id", "name").join(done, "name").select("id", "n", "c").union(none)
    component = F.coalesce("c", "id")
    return out.select(
        F.col("id").alias(id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
