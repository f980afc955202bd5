"""Overlapping character windows and content-addressed chunk rows. Map-only: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.session import checked_keys

DEFAULT_SIZE = 1000
DEFAULT_OVERLAP = 200


def check_chunk_params(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be greater than 0")
    if overlap < 0:
        raise ValueError("chunk overlap must not be negative")
    if overlap >= size:
        raise ValueError("chunk overlap must be smaller than chunk size")


def windows(text: Column | str, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> Column:
    """Array of windows over stripped text, empty for blank text.

    One regex pass: the look-ahead captures a window, the match itself advances by the step, so the
    cost is linear in the text (cutting by `substring` would rescan the text for every window).
    Windows that start at or after the first one to reach the end are cut off.
    """
    check_chunk_params(size, overlap)
    step = size - overlap
    text = tx.col(text)
    pieces = F.regexp_extract_all(
        text, F.lit(rf"(?s)(?=(.{{1,{size}}}+)).{{1,{step}}}+"), F.lit(1)
    )
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - size) / F.lit(step)).cast("int") + 1)
    return F.slice(pieces, 1, count)


def explode_windows(
    docs: DataFrame, text: str = "text", size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP
) -> DataFrame:
    """Replace the text column by `(chunk_index, text)` rows."""
    kept = [F.col(c) for c in docs.columns if c != text]
    stripped = docs.withColumn(text, tx.strip(text)).filter(F.length(text) > 0)
    return stripped.select(*kept, F.posexplode(windows(text, size, overlap)).alias("chunk_index", "text"))


def _chunk_rows(docs: DataFrame, slug: Column, size: int, overlap: int, extra: tuple[str, ...]) -> DataFrame:
    rows = explode_windows(
        docs.select(slug.alias("_slug"), "title", "source", "text", *extra), "text", size, overlap
    ).withColumn("sha256", tx.sha256_hex("text"))
    return rows.select(
        tx.chunk_id("_slug", "chunk_index", "sha256").alias("id"),
        "title", "source", "chunk_index", "text", "sha256", *extra,
    )


def chunk_sources(docs: DataFrame, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
    """Chunk rows of source records `(title, text, source)`; ids carry the slug of the source path."""
    return _chunk_rows(docs, tx.source_slug("source"), size, overlap, ())


def chunk_documents(
    docs: DataFrame, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP, keep: tuple[str, ...] = ("document_id",)
) -> DataFrame:
    """Chunk rows of corpus documents; ids carry the slug of the document id.

    `document_id` stays on the row: two ids may share one slug, and only the full id tells whether
    equal chunk ids come from equal documents.
    """
    return _chunk_rows(docs, tx.document_slug("document_id"), size, overlap, keep)


def distinct_chunks(chunks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per chunk id, without shuffling the texts. `ids`: the chunks' ids where they are stored.

    Only the ids are shuffled to find those that occur more than once. These are few (equal content
    of documents whose ids share a slug), so the other rows are written where they lie and only the
    repeated ones are reduced. `keep_one` does the same for any number of them.
    """
    repeated = (chunks if ids is None else ids).groupBy("id").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("id")
    known = checked_keys(repeated)
    if known.rows == 0:
        return chunks
    if not known.small:
        return keep_one(chunks)
    single = chunks.join(F.broadcast(known.keys), "id", "left_anti")
    return single.unionByName(keep_one(chunks.join(F.broadcast(known.keys), "id", "left_semi")))


def keep_one(chunks: DataFrame) -> DataFrame:
    """The least row of every chunk id; copies are combined before the shuffle, so a hot id stays small."""
    rest = [c for c in chunks.columns if c != "id"]
    packed = chunks.groupBy("id").agg(F.min(F.struct(*rest)).alias("_row"))
    return packed.select("id", *[F.col(f"_row.{c}").alias(c) for c in rest])
