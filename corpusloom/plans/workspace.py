"""A workspace of named indexes: catalog versions, index folders, export and import.

Index data lies in `<root>/indexes/<slug>/index`. The catalog has no MERGE to rely on: every change
writes a whole new version folder, and readers take the newest finished one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import text as tx
from corpusloom.operators import catalog as cat
from corpusloom.operators import chunking
from corpusloom.plans import index_store as store
from corpusloom.session import delete_path, path_exists
from corpusloom.sources.text_files import read_text_sources, resolve_source

_VERSION = re.compile(r"version-(\d+)\Z")


def name_to_slug(spark: SparkSession, name: str) -> str:
    row = spark.range(1).select(tx.index_slug(F.lit(name)).alias("slug"), tx.index_name_error(F.lit(name)).alias("error")).first()
    if row["error"]:
        raise ValueError(f"{name!r} cannot name an index: {row['error']}")
    return row["slug"]


@dataclass
class Workspace:
    spark: SparkSession
    root: str
    sources: str | None = None  # the folder that `ingest_path` reads from, and nothing outside of it

    def index_dir(self, slug: str) -> str:
        return f"{self.root}/indexes/{slug}/index"

    # catalog ---------------------------------------------------------------------------------
    def _versions(self) -> list[int]:
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/catalog")
        files = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(base):
            return []
        names = [status.getPath() for status in files.listStatus(base)]
        found = [_VERSION.search(path.getName()) for path in names if path_exists(self.spark, f"{path}/_SUCCESS")]
        return sorted(int(match[1]) for match in found if match)

    def catalog(self) -> DataFrame:
        versions = self._versions()
        reader = self.spark.read.schema(schemas.CATALOG_DDL)
        if not versions:
            return self.spark.createDataFrame([], schemas.CATALOG_DDL)
        return reader.parquet(f"{self.root}/catalog/version-{versions[-1]:08d}")

    def replace_catalog(self, rows: DataFrame) -> None:
        following = (self._versions() or [0])[-1] + 1
        rows.select(*cat.CATALOG_COLUMNS).coalesce(1).write.parquet(f"{self.root}/catalog/version-{following:08d}")

    def upsert(self, entries: DataFrame) -> None:
        self.replace_catalog(cat.upsert_entries(self.catalog(), entries))

    def entry(self, slug: str):
        return self.catalog().filter(F.col("slug") == slug).first()

    # indexes ---------------------------------------------------------------------------------
    def ingest_sources(
        self, name: str, sources: DataFrame, backend: str = store.LEXICAL, force: bool = False,
        size: int = chunking.DEFAULT_SIZE, overlap: int = chunking.DEFAULT_OVERLAP,
    ) -> DataFrame:
        """Chunk sources into a named index and record it; an existing name needs force."""
        slug = name_to_slug(self.spark, name)
        if self.entry(slug) is not None and not force:
            raise ValueError(f"the name {name.strip()!r} already exists in the catalog (force replaces its index)")
        chunks = chunking.chunk_sources(sources, size, overlap)
        path = self.index_dir(slug)
        build = store.build_lexical if backend == store.LEXICAL else store.build_vectors
        meta = build(chunks, path, source=name.strip(), force=force)
        if meta.first()["chunk_count"] == 0:
            raise ValueError("the sources hold no text to index")
        self.record(name.strip(), slug, backend)
        return self.catalog().filter(F.col("slug") == slug)

    def record(self, name: str, slug: str, backend: str, run_id: str | None = None, fingerprint: str | None = None) -> None:
        rows = store.index_table(self.spark, self.index_dir(slug), store.TABLES[backend][0]).withColumn("slug", F.lit(slug))
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        self.upsert(cat.counts(rows).select(
            F.lit(name).alias("name"), "slug", F.lit(backend).alias("backend"),
            cat.index_location(F.col("slug"), self.root, "chunks").alias("chunks_path"),
            cat.index_location(F.col("slug"), self.root, "index").alias("index_dir"),
            "chunk_count", "source_count", now.alias("created_at"), now.alias("updated_at"),
            F.lit(run_id).cast("string").alias("corpus_run_id"),
            F.lit(fingerprint).cast("string").alias("source_fingerprint"),
        ))

    def ingest_text(self, name: str, pastes: DataFrame, **options) -> DataFrame:
        return self.ingest_sources(name, inline_sources(pastes), **options)

    def ingest_path(self, name: str, path: str, **options) -> DataFrame:
        """Index a `.txt` file or the `.txt` files of a folder below the source folder; any other path is refused
        before it is read."""
        if self.sources is None:
            raise ValueError("the workspace has no source folder")
        return self.ingest_sources(name, read_text_sources(self.spark, resolve_source(self.spark, self.sources, path)), **options)

    def delete(self, slug: str) -> bool:
        """Drop an index; True when its data was still there."""
        if self.entry(slug) is None:
            raise KeyError(f"no index {slug!r}")
        existed = delete_path(self.spark, f"{self.root}/indexes/{slug}")
        gone = self.spark.createDataFrame([(slug,)], "slug string")
        self.replace_catalog(cat.delete_entries(self.catalog(), gone))
        return existed

    def missing_indexes(self) -> list[str]:
        """Catalog slugs without data; the catalog is a short table of names."""
        listed = self.catalog().select("slug").toLocalIterator()
        return [row["slug"] for row in listed if not path_exists(self.spark, self.index_dir(row["slug"]))]

    # export and import -----------------------------------------------------------------------
    def _selected(self, slug: str | None) -> DataFrame:
        chosen = self.catalog() if slug is None else self.catalog().filter(F.col("slug") == slug)
        if chosen.isEmpty():
            raise KeyError("the catalog is empty" if slug is None else f"no index {slug!r}")
        return chosen

    def export(self, path: str, slug: str | None = None, force: bool = False) -> DataFrame:
        """Copy one or all indexes, table by table, with the catalog rows and a manifest."""
        if path_exists(self.spark, path) and not force:
            raise FileExistsError(f"{path} exists (use force)")
        chosen = self._selected(slug)
        for row in chosen.select("slug").toLocalIterator():
            _copy_index(self.spark, self.index_dir(row["slug"]), f"{path}/indexes/{row['slug']}/index")
        chosen.coalesce(1).write.mode("overwrite").parquet(f"{path}/catalog")
        manifest = cat.export_manifest(chosen).withColumn("schema_version", F.lit(schemas.EXPORT_SCHEMA_VERSION))
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
        return self.spark.read.parquet(f"{path}/manifest")

    def import_(self, path: str, force: bool = False) -> DataFrame:
        """Bring in every index of an export. A name in the catalog, or a folder with data, needs force.

        Each index is copied as a new generation. Only when all are whole are they published and the catalog's
        next version written, so a copy that fails leaves the workspace as it was.
        """
        manifest = self.spark.read.parquet(f"{path}/manifest")
        if not manifest.filter(F.col("schema_version") != schemas.EXPORT_SCHEMA_VERSION).isEmpty():
            raise ValueError("the export has an unknown layout version")
        archive = self.spark.read.schema(schemas.CATALOG_DDL).parquet(f"{path}/catalog")
        slugs = [row["slug"] for row in archive.select("slug").toLocalIterator()]
        if not slugs:
            raise ValueError("nothing to import")
        for slug in slugs:
            if not re.fullmatch(r"[a-z0-9_][a-z0-9_-]*", slug):
                raise ValueError(f"{slug!r} cannot be an index folder")
            if not store.committed_batches(self.spark, f"{path}/indexes/{slug}/index"):
                raise ValueError(f"no data for {slug!r} in the export")
        taken = {row["slug"] for row in cat.import_conflicts(self.catalog(), archive).toLocalIterator()}
        taken |= {slug for slug in slugs if path_exists(self.spark, self.index_dir(slug))}
        if taken and not force:
            raise ValueError(f"in the way: {', '.join(sorted(taken))} (use force)")
        arriving = {slug: store.new_generation(self.spark, self.index_dir(slug)) for slug in slugs}
        for slug, generation in arriving.items():
            _copy_index(self.spark, f"{path}/indexes/{slug}/index", generation)
        for slug, generation in arriving.items():
            store.publish(self.spark, self.index_dir(slug), generation)
        self.replace_catalog(cat.import_entries(self.catalog(), archive, self.root))
        return self.catalog().join(F.broadcast(archive.select("slug")), "slug", "left_semi")


def _copy_index(spark: SparkSession, source: str, target: str) -> None:
    """The committed rows of an index as one batch; nothing else comes along."""
    described = store.index_stats(spark, source)
    first, *others = store.TABLES[described.first()["backend"]]
    store.put_keyed(store.index_table(spark, source, first), target, first, 0)
    for table in others:
        store.put_batch(store.index_table(spark, source, table), target, table, 0)
    described.withColumn("batch_number", F.lit(0).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(store.batch_folder(target, "commits", 0))


def inline_sources(pastes: DataFrame) -> DataFrame:
    """Pasted `(title, text)` rows as sources; blank titles or texts are dropped."""
    made = pastes.select(tx.strip("title").alias("title"), tx.strip("text").alias("text"))
    return made.filter((F.length("title") > 0) & (F.length("text") > 0)).withColumn(
        "source", F.concat(F.lit("web:"), "title")
    )
