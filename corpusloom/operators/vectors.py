"""Vector tables and nearest-neighbour search over a table of queries."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import vectors as vx
from corpusloom.operators import blocked
from corpusloom.operators.lexical import check_limit

COSINE = "cosine"
L2 = "l2"  # squared L2; the ranking is that of L2
DISTANCE = "distance"  # raw squared L2, smallest first

# What a score of each mode means.
SCORE_SEMANTICS = {
    COSINE: "cosine_similarity",
    L2: "negative_l2_distance",
    DISTANCE: "distance_lower_is_better",
}
DEFAULT_EMBEDDING_BATCH = 16
_PAIRS = 1 << 16  # scored one by one at a time
_SPARSE_SHARE = 16  # of all pairs; beyond that the matrix product in double precision is cheaper
_FLOAT32_LENGTH = 1e15  # its square is far from the largest number of single precision
_TINY = 1e-30
_SHORT = 1e4  # squared length up to which a difference of products is exact to nine digits


@dataclass(frozen=True)
class EmbeddingIdentity:
    """What produced the vectors of an index. Only the last part of a model path counts."""

    backend: str
    model_name: str
    dimensions: int
    normalizes_vectors: bool
    model_path_id: str | None = None
    fingerprint_version: int = 1

    @staticmethod
    def path_id(model_path: str | None) -> str | None:
        return (PurePosixPath(model_path).name or None) if model_path else None

    def as_dict(self) -> dict:
        return {key: value for key, value in asdict(self).items() if value is not None}

    def fingerprint(self) -> str:
        canonical = json.dumps(self.as_dict(), sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(canonical.encode()).hexdigest()

    def mismatch(self, other: "EmbeddingIdentity") -> str | None:
        """The first field in which an index and a request differ."""
        for name in ("backend", "model_name", "model_path_id", "dimensions", "normalizes_vectors"):
            if getattr(self, name) != getattr(other, name):
                return name
        return None if self.fingerprint() == other.fingerprint() else "fingerprint"


HASH_IDENTITY = EmbeddingIdentity("mock", "hash", vx.HASH_DIMENSIONS, True)


def embed_with(
    load_model: Callable[[], Callable[[list[str]], list[list[float]]]], dimensions: int, batch_size: int = DEFAULT_EMBEDDING_BATCH
) -> Callable[[Column], Column]:
    """A text -> vector column function around a user's model.

    `load_model` runs once per Python worker; the function it returns embeds a list of texts. Every
    vector is checked for size and finite values.
    """
    if batch_size <= 0:
        raise ValueError("embedding batch size must be greater than 0")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            vectors: list[np.ndarray] = []
            for at in range(0, len(texts), batch_size):
                part = texts.iloc[at : at + batch_size].tolist()
                if not all(part):
                    raise ValueError("empty text cannot be embedded")
                made = np.asarray(model(part), dtype=float)
                if made.shape != (len(part), dimensions) or not np.isfinite(made).all():
                    raise ValueError(f"embedder must return {dimensions} finite values per text")
                vectors.extend(made)
            yield pd.Series(vectors, index=texts.index, dtype=object)

    return embed


def hash_vectors(chunks: DataFrame, normalize: bool = True) -> DataFrame:
    """Chunk rows with their hash embedding; map-only."""
    return chunks.withColumn("embedding", vx.hash_embed("text", normalize))


class VectorScorer:
    """Scores a block of vectors against a block of queries by one matrix product."""

    def __init__(self, mode: str = COSINE):
        if mode not in SCORE_SEMANTICS:
            raise ValueError(f"unknown vector score {mode!r}")
        self.mode = mode
        self._seen = None  # the block that was laid out last, as it meets many blocks of queries

    def prepare(self, queries: pa.Table) -> np.ndarray:
        return self.matrix(queries.column("embedding").combine_chunks())

    def _block(self, items: pa.RecordBatch) -> np.ndarray:
        if self._seen is None or self._seen[0] is not items:
            self._seen = items, self.matrix(items.column("embedding"))
        return self._seen[1]

    def keys(self, state: np.ndarray, items: pa.RecordBatch) -> np.ndarray:
        vectors = self._block(items)
        if self.mode == COSINE:
            scores = state @ vectors.T
        else:
            own, theirs = (state**2).sum(axis=1)[:, None], (vectors**2).sum(axis=1)
            if max(own.max(initial=0.0), theirs.max(initial=0.0)) < _SHORT:
                scores = 2.0 * (state @ vectors.T) - own - theirs
            else:  # the products of long vectors are too large to leave nine digits in their difference
                scores = np.stack([-((vectors - query) ** 2).sum(axis=1) for query in state])
        return np.rint(scores * blocked.SCORE_UNIT)

    def candidates(self, state: np.ndarray, items: pa.RecordBatch, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = self._near(state, items, floor)
        if near is None:
            return blocked.reaching(self.keys(state, items), floor)
        return self._exact(state, items, *near, floor)

    def _near(self, state: np.ndarray, items: pa.RecordBatch, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(query, item) of all pairs that may reach the floor, by single precision and a bound on its error.

        None if these are so many that all keys are cheaper, or if single precision does not hold the vectors.
        """
        vectors = self._block(items)
        length, lengths = np.linalg.norm(state, axis=1), np.linalg.norm(vectors, axis=1)
        widest = lengths.max(initial=0.0)
        if not max(length.max(initial=0.0), widest) < _FLOAT32_LENGTH:
            return None
        scores = state.astype(np.float32) @ vectors.astype(np.float32).T
        if self.mode != COSINE:
            scores *= 2
            scores -= (length**2).astype(np.float32)[:, None]
            scores -= (lengths**2).astype(np.float32)
        error = (state.shape[1] + 16) * 2.0**-22 * ((length + widest) ** 2 + _TINY)
        least = (floor - 1) / blocked.SCORE_UNIT - error
        reached = scores >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]
        if np.count_nonzero(reached) * _SPARSE_SHARE > reached.size:
            return None
        return np.divmod(np.flatnonzero(reached), reached.shape[1])

    def _exact(self, state: np.ndarray, items: pa.RecordBatch, query: np.ndarray, column: np.ndarray, floor: np.ndarray):
        vectors, parts = self._block(items), []
        for at in range(0, len(query), _PAIRS):
            a, b = state[query[at : at + _PAIRS]], vectors[column[at : at + _PAIRS]]
            parts.append((a * b).sum(axis=1) if self.mode == COSINE else -((b - a) ** 2).sum(axis=1))
        key = np.rint(np.concatenate([np.zeros(0), *parts]) * blocked.SCORE_UNIT)
        reached = key >= floor[query]
        return query[reached], column[reached], key[reached]

    def matrix(self, vectors: pa.Array) -> np.ndarray:
        """Vectors as rows. Nulls, other sizes and values that are not finite are refused: they would
        shift or poison the scores of others."""
        sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        if len(sizes) and (sizes < 1).any():
            raise ValueError("a vector is null or empty")
        if len(sizes) and (sizes != sizes[0]).any():
            raise ValueError("vectors differ in dimensions")
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if not np.isfinite(flat).all():
            raise ValueError("a vector holds a null or a value that is not finite")
        matrix = flat.reshape(len(vectors), sizes[0] if len(sizes) else 0)
        if self.mode == COSINE:
            length = np.linalg.norm(matrix, axis=1, keepdims=True)
            matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
        return matrix


def usable_vectors(vectors: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose `embedding` can be searched, and error rows `(id, error_type)` of the others."""
    marked = vectors.withColumn("_error", vx.vector_error("embedding", dimensions))
    bad = marked.filter(F.col("_error").isNotNull()).select("id", F.col("_error").alias("error_type"))
    return marked.filter(F.col("_error").isNull()).drop("_error"), bad


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, mode: str = COSINE, **layout: int
) -> tuple[DataFrame, int | None]:
    """The k nearest vectors of every query: `(query_id, id, score, rank)`.

    Exact. Vectors that are null, not finite or of another size are an error; `usable_vectors` parts
    them from the others first. Vectors are read where they lie when the queries can be broadcast (see `blocked`).
    """
    check_limit(k)
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    stored = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    scorer = VectorScorer(L2 if mode == DISTANCE else mode)
    ranked, bound = blocked.top_k(stored, asked, scorer, k, F.size("embedding") * 8 + 32, **layout)
    if mode == DISTANCE:
        ranked = ranked.withColumn("score", F.abs("score"))
    return ranked, bound


def search_chunks(
    vectors: DataFrame, queries: DataFrame, k: int = 5, mode: str = COSINE, **layout: int
) -> DataFrame:
    """`search` with the columns of a search result."""
    ranked, bound = search(vectors, queries, k, mode, **layout)
    return blocked.attach(ranked, bound, vectors, ["title", "source", "chunk_index", "text"]).select(
        "query_id", "rank", "score", "id", "title", "source", "chunk_index", "text"
    )


def semantic_search(
    vectors: DataFrame,
    queries: DataFrame,
    index_identity: EmbeddingIdentity,
    identity: EmbeddingIdentity = HASH_IDENTITY,
    embed: Callable[[Column], Column] | None = None,
    k: int = 5,
    **layout: int,
) -> DataFrame:
    """Embed the query texts the way the index was embedded, then search.

    A different embedder is refused before anything is read.
    """
    differs = index_identity.mismatch(identity)
    if differs:
        raise ValueError(f"embedding {differs} mismatch: rebuild the index")
    make = embed or (lambda text: vx.hash_embed(text, identity.normalizes_vectors))
    asked = queries.filter(F.length("text") > 0).select("query_id", make(F.col("text")).alias("embedding"))
    mode = COSINE if identity.normalizes_vectors else L2
    return search_chunks(vectors, asked, k, mode, **layout).withColumn(
        "score_semantics", F.lit(SCORE_SEMANTICS[mode])
    )


def distance_search(
    vectors: DataFrame, queries: DataFrame, embed: Callable[[Column], Column] | None = None, k: int = 5, **layout: int
) -> DataFrame:
    """Embed the query texts and search by raw distance, the nearest first; blank queries have no rows."""
    make = embed or vx.hash_embed
    asked = queries.filter(F.length("text") > 0).select("query_id", make(F.col("text")).alias("embedding"))
    return search_chunks(vectors, asked, k, DISTANCE, **layout).withColumn("score_semantics", F.lit(SCORE_SEMANTICS[DISTANCE]))
