"""Incoming rows against what is already there: new, unchanged, changed; add, skip, conflict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from corpusloom.operators.chunking import distinct_chunks
from corpusloom.session import checked_keys, cut_lineage, key_bytes, may_broadcast

NEW, UNCHANGED, CHANGED = "new", "unchanged", "changed"
ADD, SKIP, CONFLICT = "add", "skip", "conflict"


def _copies(docs: DataFrame) -> DataFrame:
    """One narrow row per (document_id, content_digest); copies are combined before the shuffle."""
    return docs.groupBy("document_id", "content_digest").agg(
        F.min("position").alias("position"), F.count("*").alias("copies")
    )


def _touched(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a large stored table that a batch can meet: while the batch's keys are few they are
    broadcast to them, so that a batch does not shuffle all that was ever stored."""
    wanted = checked_keys(keys.select(key).distinct())
    return stored.join(F.broadcast(wanted.keys), key, "left_semi") if wanted.small else stored


def classify(docs: DataFrame, ledger: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`(document_id, content_digest, position, copies, verdict)` of incoming documents.

    `ledger` is a table, or a function that looks a table of ids up. `new` is the first copy of an id the ledger does not have; the same digest again is `unchanged`;
    any other digest of the id, in the ledger or earlier in the input, makes it `changed`.

    The texts are read once, for their digests. Which digest came first only matters for ids with
    several; these are few, and every step combines before it shuffles, so a hot id is no problem.
    """
    copies = cut_lineage(_copies(docs), "copies")
    several = copies.groupBy("document_id").agg(
        F.min_by("content_digest", "position").alias("_first"), F.count("*").alias("_n")
    ).filter(F.col("_n") > 1)
    stored = ledger(copies) if callable(ledger) else ledger
    known = _touched(stored, copies, "document_id").select("document_id", F.col("content_digest").alias("_done"))
    joined = copies.join(several, "document_id", "left").join(known, "document_id", "left")
    first = F.coalesce("_first", "content_digest")
    verdict = (
        F.when(F.col("_done") == F.col("content_digest"), UNCHANGED)
        .when(F.col("_done").isNotNull(), CHANGED)
        .when(F.col("content_digest") == first, NEW)
        .otherwise(CHANGED)
    )
    return joined.select("document_id", "content_digest", "position", "copies", verdict.alias("verdict"))


def classify_in_turn(docs: DataFrame, ledger: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `classify` says of the batches `run_part` one after the other, each with the ledger that those before it left.

    An id is completed by the first batch whose first copy of it has a text (`run_text`); in later ones that digest is
    `unchanged` and any other `changed`, as if the ledger had it.
    """
    copies = cut_lineage(docs.groupBy("run_part", "document_id", "content_digest").agg(
        F.min("position").alias("position"), F.count("*").alias("copies"), F.min_by("run_text", "position").alias("_text")
    ), "copies")
    firsts = copies.groupBy("run_part", "document_id").agg(
        F.min_by("content_digest", "position").alias("_first"), F.min_by("_text", "position").alias("_text"), F.count("*").alias("_n")
    )
    completed = firsts.filter("_text").groupBy("document_id").agg(
        F.min("run_part").alias("_since"), F.min_by("_first", "run_part").alias("_completed")
    )
    known = _touched(ledger(copies), copies, "document_id").select("document_id", F.col("content_digest").alias("_ledger"))
    joined = copies.join(firsts.filter(F.col("_n") > 1).select("run_part", "document_id", "_first"), ["run_part", "document_id"], "left")
    joined = joined.join(completed, "document_id", "left").join(known, "document_id", "left")
    done = F.coalesce("_ledger", F.when(F.col("_since") < F.col("run_part"), F.col("_completed")))
    verdict = (
        F.when(done == F.col("content_digest"), UNCHANGED)
        .when(done.isNotNull(), CHANGED)
        .when(F.col("content_digest") == F.coalesce("_first", "content_digest"), NEW)
        .otherwise(CHANGED)
    )
    return joined.select("run_part", "document_id", "content_digest", "position", "copies", verdict.alias("verdict"))


def new_documents(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The wide rows of new documents, one per id (and batch `run_part`, if there are several). `verdicts` should be a stored table.

    Texts are shuffled only if they must be: a small set of new documents, or a small set of
    exceptions among mostly new ones, is broadcast after its size was counted.
    """
    key = [*(c for c in ("run_part",) if c in verdicts.columns), "document_id", "content_digest"]
    fresh = F.col("verdict") == NEW
    exception = ~fresh | (F.col("copies") > 1)
    size = key_bytes(*key, "position")
    n_fresh, fresh_size, n_odd, odd_size = verdicts.agg(
        F.count_if(fresh), F.coalesce(F.sum(F.when(fresh, size)), F.lit(0)),
        F.count_if(exception), F.coalesce(F.sum(F.when(exception, size)), F.lit(0)),
    ).first()
    wanted = verdicts.filter(fresh).select(*key, "position")
    if may_broadcast(n_fresh, fresh_size):
        return docs.join(F.broadcast(wanted), [*key, "position"], "left_semi")
    if may_broadcast(n_odd, odd_size):
        odd = verdicts.filter(exception).select(*key, F.when(fresh, F.col("position")).alias("_keep"), F.lit(True).alias("_odd"))
        marked = docs.join(F.broadcast(odd), key, "left")
        return marked.filter(F.col("_odd").isNull() | (F.col("position") == F.col("_keep"))).drop("_keep", "_odd")
    return docs.join(wanted, [*key, "position"], "left_semi")


def conflicts(verdicts: DataFrame, *keep: str) -> DataFrame:
    """Error rows of changed documents, without their text; `keep` names further columns."""
    return verdicts.filter(F.col("verdict") == CHANGED).select(
        *keep, "document_id", "position", F.lit("content_changed").alias("error_type"),
        F.concat(F.lit("document "), "document_id", F.lit(" changed since its completion; rebuild to ingest it again")).alias("message"),
    )


def ingest_counts(verdicts: DataFrame | GroupedData) -> DataFrame:
    """Seen, new, skipped and conflicting rows, by one aggregation over the narrow verdicts."""

    def rows_of(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    fresh, same, changed = (F.col("verdict") == v for v in (NEW, UNCHANGED, CHANGED))
    return verdicts.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("records_seen"),
        rows_of(fresh, F.lit(1)).alias("records_new"),
        (rows_of(same, F.col("copies")) + rows_of(fresh, F.col("copies") - 1)).alias("records_skipped"),
        rows_of(changed, F.col("copies")).alias("records_failed"),
    )


def unseen_chunks(chunks: DataFrame, existing: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Chunks whose id is not there yet, one per id. `ids`: the chunks' ids where they are stored.

    The ids already there are found over narrow columns; they are few when the documents are new,
    and then the texts need no shuffle.
    """
    ids = cut_lineage(chunks.select("id") if ids is None else ids.select("id"), "ids")
    there = _touched(existing.select("id"), ids, "id")
    return _without(chunks, ids, ids.join(there, "id", "left_semi").distinct())


def _without(chunks: DataFrame, ids: DataFrame, excluded: DataFrame) -> DataFrame:
    """Chunks with other ids than `excluded`, one per id; few exclusions are broadcast."""
    known = checked_keys(excluded)
    if not known.rows:
        return distinct_chunks(chunks, ids)
    side = F.broadcast(known.keys) if known.small else known.keys
    left = ids.join(side, "id", "left_anti")
    return distinct_chunks(chunks.join(side, "id", "left_anti"), left)


def compare_chunks(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks with an `action`: `add`, `skip` (same id and content) or `conflict` (other content).

    The digest comparison only needs narrow columns; the wide ones follow in `chunks_to_add`.
    """
    mine = chunks.groupBy("id").agg(F.min("sha256").alias("sha256"), F.max("sha256").alias("_other"))
    mine = cut_lineage(mine, "incoming")
    theirs = _touched(existing.select("id", F.col("sha256").alias("_stored")), mine, "id")
    action = (
        F.when(F.col("sha256") != F.col("_other"), CONFLICT)
        .when(F.col("_stored").isNull(), ADD)
        .when(F.col("_stored") == F.col("sha256"), SKIP)
        .otherwise(CONFLICT)
    )
    return mine.join(theirs, "id", "left").select("id", "sha256", action.alias("action"))


def chunks_to_add(chunks: DataFrame, compared: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The wide rows to add, one per id. `ids`: the chunks' ids where they are stored."""
    ids = chunks.select("id") if ids is None else ids.select("id")
    return _without(chunks, ids, compared.filter(F.col("action") != ADD).select("id"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Replace rows with the same key, add the others."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)
