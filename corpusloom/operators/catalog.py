"""The catalog of indexes and the run table, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators.delta import upsert

CATALOG_COLUMNS = [part.split(" ")[0] for part in schemas.CATALOG_DDL.split(", ")]
_PROVENANCE = ("corpus_run_id", "source_fingerprint")


def counts(chunks: DataFrame, slug: str = "slug", source: str = "source") -> DataFrame:
    """Chunk and source counts per index. Sources are reduced per (index, source) first, so one big
    index is not counted in one task."""
    per_source = chunks.groupBy(slug, source).agg(F.count("*").alias("_n"))
    return per_source.groupBy(slug).agg(
        F.sum("_n").alias("chunk_count"), F.count("*").alias("source_count")
    )


def list_newest(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.col("updated_at").desc(), F.col("slug"))


def upsert_entries(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """Insert or replace by slug; a replaced entry keeps its creation time."""
    created = catalog.select("slug", F.col("created_at").alias("_created"))
    kept = entries.join(created, "slug", "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_created")
    return upsert(catalog, kept, "slug")


def delete_entries(catalog: DataFrame, slugs: DataFrame) -> DataFrame:
    return catalog.join(slugs.select("slug"), "slug", "left_anti")


def missing_data(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """Catalog entries without any chunk."""
    return catalog.join(chunks.select("slug"), "slug", "left_anti")


def export_manifest(catalog: DataFrame) -> DataFrame:
    """What an export holds, newest index first."""
    listed = list_newest(catalog)
    return listed.select("name", "slug", "backend", "chunk_count", "source_count")


def import_conflicts(catalog: DataFrame, archive: DataFrame) -> DataFrame:
    return archive.join(catalog.select("slug"), "slug", "left_semi").select("slug")


def import_entries(catalog: DataFrame, archive: DataFrame, root: str) -> DataFrame:
    """The catalog after an import: archived entries replace theirs, paths point below `root`, and
    run id and source fingerprint are dropped (they belong to the exporting workspace)."""
    remapped = archive.select(*[_imported(c, root).alias(c) for c in CATALOG_COLUMNS])
    return upsert(catalog, remapped, "slug")


def _imported(column: str, root: str) -> Column:
    if column in _PROVENANCE:
        return F.lit(None).cast("string")
    if column in ("chunks_path", "index_dir"):
        return index_location(F.col("slug"), root, "chunks" if column == "chunks_path" else "index")
    return F.col(column)


def index_location(slug: Column, root: str, part: str) -> Column:
    return F.concat(F.lit(f"{root.rstrip('/')}/indexes/"), slug, F.lit(f"/{part}"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last row of every run."""
    row = F.struct(*runs.columns)
    return runs.groupBy("run_id").agg(F.max_by(row, F.struct("updated_at", "records_completed")).alias("_row")).select("_row.*")


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run, ties by run id descending."""
    return runs.orderBy(F.col("updated_at").desc(), F.col("run_id").desc()).limit(1)


def with_progress(runs: DataFrame) -> DataFrame:
    share = F.round(F.lit(100.0) * F.col("records_completed") / F.col("estimated_records"), 2)
    return runs.withColumn("progress_percent", F.when(F.col("estimated_records") > 0, share))


def readable_runs(runs: DataFrame) -> DataFrame:
    """Run rows of a known schema; a semantic row needs its embedding fingerprint."""
    known = (F.col("schema_name") == schemas.RUN_SCHEMA_NAME) & F.col("schema_version").isin(
        schemas.LEXICAL_SCHEMA_VERSION, schemas.SEMANTIC_SCHEMA_VERSION
    )
    complete = (F.col("schema_version") == schemas.LEXICAL_SCHEMA_VERSION) | F.col("embedding_fingerprint").isNotNull()
    return runs.filter(known & complete)


RESUME_FIELDS = (
    "index_backend", "source_fingerprint", "index_slug", "chunk_size", "chunk_overlap", "embedding_fingerprint",
)


def resume_mismatch(stored: dict, wanted: dict) -> str | None:
    """The first setting in which a stored run and a request differ."""
    return next((name for name in RESUME_FIELDS if stored.get(name) != wanted.get(name)), None)
