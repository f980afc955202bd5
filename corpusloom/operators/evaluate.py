"""Retrieval quality: ranks of relevant documents, top-1 accuracy, recall@3, mean reciprocal rank.

Documents rank by cosine (9 digits), ties by input position. No ranking of all documents is built:
the best relevant document comes from a block scan of the query's label; its rank is one more than the
number of documents ahead of it, which a second scan counts that also finds the three best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors as vx
from corpusloom.operators import blocked
from corpusloom.operators.vectors import COSINE, VectorScorer
from corpusloom.session import cut_lineage

RECALL_DEPTH = 3
_FEW_LABELS = 64  # of a block, looked for one by one
_TRIPLE = ("anchor", "related", "unrelated")


class EvaluationScorer(VectorScorer):
    """Cosine keys that can leave out the query's own row and, if asked, other labels."""

    def __init__(self, same_label: bool = False):
        super().__init__(COSINE)
        self.same_label = same_label

    def prepare(self, queries: pa.Table) -> dict:
        return {
            "vectors": super().prepare(queries),
            "self": np.array(queries.column("self_id").to_pylist(), dtype=object),
            "label": queries.column("label").to_numpy(zero_copy_only=False),
        }

    def keys(self, state: dict, items: pa.RecordBatch) -> np.ndarray:
        keys = super().keys(state["vectors"], items)
        own, label = self._own(state, items), self._labels(items)
        hit = np.flatnonzero(own >= 0)
        keys[hit, own[hit]] = blocked.NO_MATCH
        if self.same_label:
            keys[state["label"][:, None] != label] = blocked.NO_MATCH
        return keys

    def affinity(self, rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        """The label, so that with `same_label` most blocks of items have nothing for most blocks of queries."""
        label = rows.column("label")
        label = label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label
        return pc.fill_null(label.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)

    def candidates(self, state: dict, items: pa.RecordBatch, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.same_label:
            there = pc.unique(items.column("label")).drop_null().to_pylist()
            mine = np.zeros(len(floor), bool)
            for label in there if len(there) <= _FEW_LABELS else ():
                mine |= state["label"] == label
            rows = np.flatnonzero(mine)
            if len(there) <= _FEW_LABELS and len(rows) < len(floor):
                if not len(rows):
                    return rows, rows, np.zeros(0)
                query, column, key = self._reached({name: part[rows] for name, part in state.items()}, items, floor[rows])
                return rows[query], column, key
        return self._reached(state, items, floor)

    def _reached(self, state: dict, items: pa.RecordBatch, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = self._near(state["vectors"], items, floor)
        if near is None:
            return blocked.reaching(self.keys(state, items), floor)
        query, column = near
        counts = column != self._own(state, items)[query]
        if self.same_label:
            counts &= state["label"][query] == self._labels(items)[column]
        return self._exact(state["vectors"], items, query[counts], column[counts], floor)

    def _own(self, state: dict, items: pa.RecordBatch) -> np.ndarray:
        """For each query the place of its own row among the items, -1 if it is not there."""
        ids = np.array(items.column("id").to_pylist(), dtype=object)
        own = np.searchsorted(ids, np.where(np.equal(state["self"], None), "", state["self"]))
        own[own == len(ids)] = -1
        there = np.flatnonzero(own >= 0)
        own[there[ids[own[there]] != state["self"][there]]] = -1
        return own

    def _labels(self, items: pa.RecordBatch) -> np.ndarray:
        return items.column("label").to_numpy(zero_copy_only=False)


def _position_id(df: DataFrame, column: str, name: str) -> DataFrame:
    """Input positions as fixed-width text: text order is input order."""
    return df.withColumn(name, F.lpad(F.col(column).cast("string"), 19, "0"))


def _items(records: DataFrame, label: str | None) -> DataFrame:
    made = _position_id(records, "position", "id")
    return made.select(
        "id", F.col("embedding").cast("array<double>").alias("embedding"),
        (F.col(label) if label else F.lit(0)).alias("label"),
    )


def _queries(queries: DataFrame, label: str | None) -> DataFrame:
    own = F.lpad(F.col("self_position").cast("string"), 19, "0") if "self_position" in queries.columns else F.lit(None)
    return queries.select(
        "query_id", F.col("embedding").cast("array<double>").alias("embedding"),
        own.cast("string").alias("self_id"), (F.col(label) if label else F.lit(0)).alias("label"),
    )





def _query_size():
    return F.size("embedding") * 8 + 64


def rank_of(items: DataFrame, queries: DataFrame, marks: DataFrame, **layout: int) -> DataFrame:
    """`(query_id, rank)` of one marked document `(query_id, mark_id, mark_score)` per query."""
    marked = queries.join(marks, "query_id")
    ahead = blocked.count_ahead(items, marked, EvaluationScorer(), _query_size(), **layout)
    return ahead.select("query_id", (F.col("ahead") + 1).alias("rank"))


def by_label(records: DataFrame, queries: DataFrame, label: str = "label", **layout: int) -> DataFrame:
    """Per query: relevance counts, top-1 and top-3 hits and the first relevant rank, where documents
    with the query's label are the relevant ones.

    `records(position, embedding, label)`, `queries(query_id, embedding, label[, self_position])`; a
    query that is itself a record names its position and is left out of its own ranking.
    """
    items, asked = _items(records, label), _queries(queries, label)
    first, _ = blocked.top_k(items, asked, EvaluationScorer(same_label=True), 1, _query_size(), **layout)
    marks = cut_lineage(first.select("query_id", F.col("id").alias("mark_id"), F.col("score").alias("mark_score")), "marks")
    marked = asked.join(marks, "query_id", "left")
    top, ahead, bound = blocked.top_k_ahead(items, marked, EvaluationScorer(), RECALL_DEPTH, _query_size(), **layout)
    ranks = ahead.join(marks.select("query_id"), "query_id").select("query_id", (F.col("ahead") + 1).alias("rank"))

    labelled = blocked.attach(top, bound, items.withColumnRenamed("label", "_found"), ["_found"]).select("query_id", "rank", "_found")
    hits = asked.select("query_id", "label").join(labelled, "query_id").groupBy("query_id").agg(
        F.count_if((F.col("rank") == 1) & (F.col("_found") == F.col("label"))).alias("top1_hits"),
        F.count_if(F.col("_found") == F.col("label")).alias("top3_hits"),
    )
    sizes = items.groupBy("label").agg(F.count("*").alias("_n"))
    own = F.when(F.col("self_id").isNotNull(), 1).otherwise(0)
    relevant = asked.join(sizes, "label", "left").select(
        "query_id", (F.coalesce("_n", F.lit(0)) - own).alias("relevant")
    )
    return _per_query(relevant, hits, ranks)


def by_judgements(
    records: DataFrame, queries: DataFrame, relevant: DataFrame, **layout: int
) -> DataFrame:
    """As `by_label`, with explicit `(query_id, id)` judgements over `records(id, position, embedding)`."""
    items, asked = _items(records, None), _queries(queries, None)
    judged = (
        relevant.distinct()
        .join(_position_id(records, "position", "_pos").select("id", "_pos", F.col("embedding").alias("_doc")), "id", "left")
        .join(asked.select("query_id", F.col("embedding").alias("_query")), "query_id")
        .withColumn("score", F.round(vx.cosine(F.col("_query"), F.col("_doc").cast("array<double>")), blocked.SCORE_DIGITS))
    )
    counts = judged.groupBy("query_id").agg(F.count("*").alias("relevant"))
    present = judged.filter(F.col("_pos").isNotNull())
    best = present.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("_pos").alias("p"))).alias("b"))
    marks = best.select("query_id", F.col("b.p").alias("mark_id"), (-F.col("b.s")).alias("mark_score"))
    ranks = rank_of(items, asked, marks, **layout)
    top, _ = blocked.top_k(items, asked, EvaluationScorer(), RECALL_DEPTH, _query_size(), **layout)
    hits = top.join(present.select("query_id", F.col("_pos").alias("id")), ["query_id", "id"]).groupBy("query_id").agg(
        F.count_if(F.col("rank") == 1).alias("top1_hits"), F.count("*").alias("top3_hits")
    )
    relevant_counts = asked.select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("relevant", F.lit(0)).alias("relevant")
    )
    return _per_query(relevant_counts, hits, ranks)


def _per_query(relevant: DataFrame, hits: DataFrame, ranks: DataFrame) -> DataFrame:
    joined = relevant.join(hits, "query_id", "left").join(ranks, "query_id", "left")
    top3 = F.coalesce("top3_hits", F.lit(0))
    return joined.select(
        "query_id",
        F.col("relevant").cast("bigint").alias("relevant"),
        F.coalesce("top1_hits", F.lit(0)).cast("bigint").alias("top1_hits"),
        top3.cast("bigint").alias("top3_hits"),
        F.col("rank").cast("bigint").alias("first_relevant_rank"),
        F.when(F.col("relevant") > 0, top3 / F.col("relevant")).alias("recall_at_3"),
        F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def metrics(per_query: DataFrame, documents_count: int | None = None) -> DataFrame:
    """Means over all queries, 0.0 when there are none. A query without relevant documents has no
    recall; it is left out of that mean and counted in `queries_without_relevant`."""
    row = per_query.agg(
        F.count("*").alias("query_count"),
        F.count_if(F.col("relevant") == 0).alias("queries_without_relevant"),
        F.coalesce(F.avg("top1_hits"), F.lit(0.0)).alias("top1_accuracy"),
        F.coalesce(F.avg("recall_at_3"), F.lit(0.0)).alias("recall_at_3"),
        F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mean_reciprocal_rank"),
    )
    return row if documents_count is None else row.withColumn("documents_count", F.lit(documents_count))


def related_ranks_higher(triples: DataFrame, embed=vx.hash_embed, texts: DataFrame | None = None) -> DataFrame:
    """Probe over `(triple_id, anchor, related, unrelated)` texts: is the related text the closer one?

    With `texts`, a table `(id, text)`, the triples name texts by id: each is embedded once, however many triples have it,
    and only vectors are joined to them. A triple of a text that is not in the table has no row.
    """
    if texts is None:
        made = triples.select("triple_id", *[embed(F.col(c)).alias(c) for c in _TRIPLE])
    else:
        vectors = cut_lineage(texts.select("id", embed(F.col("text")).alias("_vector")), "vectors")
        made = triples.select("triple_id", *_TRIPLE)
        for name in _TRIPLE:
            made = made.join(vectors.select(F.col("id").alias(name), F.col("_vector").alias(f"_{name}")), name)
        made = made.select("triple_id", *[F.col(f"_{name}").alias(name) for name in _TRIPLE])
    scored = made.select(
        "triple_id", vx.cosine("anchor", "related").alias("related_similarity"),
        vx.cosine("anchor", "unrelated").alias("unrelated_similarity"),
    )
    return scored.withColumn("related_ranks_higher", F.col("related_similarity") > F.col("unrelated_similarity"))
