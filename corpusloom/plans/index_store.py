"""Indexes as Parquet tables of committed batches.

An index folder holds `chunks`, `terms` and `postings`, or `vectors`, each as `batch=<n>` folders, and
`commits/batch=<n>` with one row that describes the index up to that batch. The commit is written
last and readers only see committed batches: what a failed attempt left behind is invisible, and the
next attempt takes the same number and overwrites it. The ids of its chunks lie in a `KeyTable`.

A build makes a new generation of the index, a folder of the same kind below it, and publishes it by one small file in
`current`: until then readers see the old one, and a build that dies changes nothing. The generation before is kept
for readers that have it open, older ones are deleted.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import delta, lexical, vectors
from corpusloom.operators.chunking import distinct_chunks
from corpusloom.operators.vectors import EmbeddingIdentity
from corpusloom.plans.key_table import KeyTable
from corpusloom.session import STORED, cut_lineage, delete_path, matching_paths, put_once, read_small

LEXICAL, SEMANTIC = "simple", "semantic"
TABLES = {LEXICAL: ("chunks", "terms", "postings"), SEMANTIC: ("vectors",)}


# generations --------------------------------------------------------------------------------------
def published(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """How many generations were published, and the name of the newest."""
    files = matching_paths(spark, f"{path}/current/version-*")
    for name in reversed(files):
        generation = read_small(spark, name)
        if generation:  # else who wrote it has died
            return int(files[-1].rsplit("-", 1)[1]), generation
    return len(files), None


def home(spark: SparkSession, path: str) -> str:
    """The folder of the published generation; the index folder itself as long as none was built."""
    generation = published(spark, path)[1]
    return f"{path}/{generation}" if generation else path


def new_generation(spark: SparkSession, path: str, force: bool = True, name: str | None = None) -> str:
    """A folder for a generation that nobody sees yet; one that replaces another needs force."""
    if committed_batches(spark, path) and not force:
        raise FileExistsError(f"index {path} is not empty (use force)")
    return f"{path}/gen-{name or uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, generation: str) -> None:
    """Make a finished generation the index. Of two that take the same number one fails."""
    number, current = published(spark, path)
    name = generation.rsplit("/", 1)[1]
    if current == name:
        return
    put_once(spark, f"{path}/current/version-{number + 1:08d}", name)
    for folder in matching_paths(spark, f"{path}/gen-*"):
        if folder.rsplit("/", 1)[1] not in (name, current):
            delete_path(spark, folder)
    if current:  # what lies in the folder itself is older still
        for table in (*sum(TABLES.values(), ()), "commits", "cells"):
            delete_path(spark, f"{path}/{table}")


# batches ------------------------------------------------------------------------------------------
def committed_batches(spark: SparkSession, path: str) -> list[int]:
    found = (re.search(r"batch=(\d+)/_SUCCESS\Z", name) for name in matching_paths(spark, f"{home(spark, path)}/commits/batch=*/_SUCCESS"))
    return sorted(int(match[1]) for match in found if match)


def next_batch(spark: SparkSession, path: str) -> int:
    return (committed_batches(spark, path) or [-1])[-1] + 1


def batch_folder(path: str, table: str, batch: int) -> str:
    return f"{path}/{table}/batch={batch:08d}"


def index_table(spark: SparkSession, path: str, table: str, ddl: str | None = None) -> DataFrame:
    """The committed rows of a table; an empty one with `ddl` if there are none."""
    path = home(spark, path)
    folders = [batch_folder(path, table, n) for n in committed_batches(spark, path)]
    there = set(matching_paths(spark, f"{path}/{table}/batch=*"))
    names = {name.rsplit("/", 1)[1] for name in there}
    folders = [folder for folder in folders if folder.rsplit("/", 1)[1] in names]
    if not folders:
        if ddl is None:
            raise FileNotFoundError(f"index {path} has no {table}")
        return spark.createDataFrame([], ddl)
    reader = spark.read.schema(ddl) if ddl else spark.read
    return reader.parquet(*folders)


def commits(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per committed batch, or per batch of a run committed in it, or None if there is none."""
    path = home(spark, path)
    done = committed_batches(spark, path)
    return spark.read.schema(schemas.COMMIT_DDL).parquet(*[batch_folder(path, "commits", n) for n in done]) if done else None


def put_batch(rows: DataFrame, path: str, table: str, batch: int) -> DataFrame:
    """Write a table's part of a batch, over whatever an earlier attempt left, and read it back."""
    folder = batch_folder(home(rows.sparkSession, path), table, batch)
    rows.write.mode("overwrite").option("compression", STORED).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def chunk_keys(spark: SparkSession, path: str) -> KeyTable:
    """The ids of all chunks with the digests of their texts."""
    return KeyTable(spark, home(spark, path), "keys", "id STRING, sha256 STRING")


def stored_ids(spark: SparkSession, path: str, ids: DataFrame, table: str) -> DataFrame:
    """(`id`, `sha256`) of stored chunks, at least of those in `ids`."""
    found = chunk_keys(spark, path).lookup(ids, committed_batches(spark, path))
    return index_table(spark, path, table, "id STRING, sha256 STRING") if found is None else found


def ledger_keys(spark: SparkSession, path: str) -> KeyTable:
    """The documents that runs have completed."""
    return KeyTable(spark, home(spark, path), "ledger", schemas.RUN_LEDGER_DDL)


# chunk tables -------------------------------------------------------------------------------------
def write_chunks(chunks: DataFrame, path: str, force: bool = False) -> None:
    """A table of chunk rows in one committed batch; an existing one is only replaced by force."""
    spark = chunks.sparkSession
    made = new_generation(spark, path, force)
    commit(put_keyed(chunks, made, "chunks", 0), made, 0, LEXICAL, "", None)
    publish(spark, path, made)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Add the chunks whose ids are not in the table, as a batch of their own."""
    spark = chunks.sparkSession
    batch = next_batch(spark, path)
    ids = cut_lineage(chunks.select("id"), "ids")
    added = put_keyed(delta.unseen_chunks(chunks, stored_ids(spark, path, ids, "chunks"), ids).select(*chunks.columns), path, "chunks", batch)
    commit(added, path, batch, LEXICAL, "", None)


def put_keyed(rows: DataFrame, path: str, table: str, batch: int) -> DataFrame:
    """`put_batch` with the ids of the rows."""
    stored = put_batch(rows, path, table, batch)
    chunk_keys(rows.sparkSession, path).put(stored.select("id", "sha256"), batch)
    return stored


# building and appending ---------------------------------------------------------------------------
def write_postings(terms: DataFrame, path: str, batch: int = 0) -> None:
    """Postings sorted by token, so a search for few words skips most row groups. Ranges are cut on
    (token, chunk), which also splits a frequent token over several files."""
    rows = lexical.postings(terms)
    put_batch(rows.repartitionByRange("token", "chunk_id").sortWithinPartitions("token", "chunk_id"), path, "postings", batch)


def put_lexical(chunks: DataFrame, path: str, batch: int) -> DataFrame:
    """Chunks, term table and postings of a batch that is not committed yet; returns the stored chunks."""
    stored = put_keyed(chunks, path, "chunks", batch)
    write_postings(put_batch(lexical.term_table(stored), path, "terms", batch), path, batch)
    return stored


def build_lexical(chunks: DataFrame, path: str, source: str = "", force: bool = False) -> DataFrame:
    """Chunks, term table, postings and metadata of a lexical index; returns the metadata row."""
    spark = chunks.sparkSession
    made = new_generation(spark, path, force)
    commit(put_lexical(distinct_chunks(chunks), made, 0), made, 0, LEXICAL, source, None)
    publish(spark, path, made)
    return index_stats(spark, path)


def append_lexical(chunks: DataFrame, path: str, source: str = "") -> DataFrame:
    """Add unseen chunks with their terms as a batch. Nothing is rewritten, and a repeated append adds nothing."""
    spark = chunks.sparkSession
    columns = index_table(spark, path, "chunks").columns
    batch = next_batch(spark, path)
    ids = cut_lineage(chunks.select("id"), "ids")
    added = put_lexical(delta.unseen_chunks(chunks, stored_ids(spark, path, ids, "chunks"), ids).select(*columns), path, batch)
    return commit(added, path, batch, LEXICAL, source, None)


def build_vectors(
    chunks: DataFrame, path: str, identity: EmbeddingIdentity = vectors.HASH_IDENTITY, embed=None, source: str = "", force: bool = False
) -> DataFrame:
    spark = chunks.sparkSession
    made = new_generation(spark, path, force)
    commit(put_keyed(embedded(distinct_chunks(chunks), identity, embed), made, "vectors", 0), made, 0, SEMANTIC, source, identity)
    publish(spark, path, made)
    return index_stats(spark, path)


def build_distances(chunks: DataFrame, path: str, embed=None, source: str = "", force: bool = False) -> DataFrame:
    """A vector index of the first layout. It does not record what made its vectors, is searched by raw distance and is
    never appended to, as nothing says whether further vectors would match."""
    spark = chunks.sparkSession
    made = new_generation(spark, path, force)
    rows = put_keyed(embedded(distinct_chunks(chunks), vectors.HASH_IDENTITY, embed), made, "vectors", 0)
    commit(rows, made, 0, SEMANTIC, source, None, version=schemas.DISTANCE_SCHEMA_VERSION)
    publish(spark, path, made)
    return index_stats(spark, path)


def append_vectors(
    chunks: DataFrame, path: str, identity: EmbeddingIdentity = vectors.HASH_IDENTITY, embed=None, source: str = ""
) -> DataFrame:
    """Embed and add chunks: same id and content is skipped, same id and other content is an error,
    and so is an index made by another embedder. Only chunks to add are embedded."""
    spark = chunks.sparkSession
    if not committed_batches(spark, path):
        return build_vectors(chunks, path, identity, embed, source)
    batch = next_batch(spark, path)
    return commit(put_vectors(chunks, path, batch, identity, embed), path, batch, SEMANTIC, source, identity)


def put_vectors(
    chunks: DataFrame, path: str, batch: int, identity: EmbeddingIdentity, embed=None, keys: DataFrame | None = None,
    columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """The vectors of unseen chunks as a batch that is not committed yet; with these `columns` of the chunks, or all."""
    spark = chunks.sparkSession
    if committed_batches(spark, path):
        stored = read_identity(spark, path)
        differs = "metadata" if stored is None else stored.mismatch(identity)
        if differs:
            raise ValueError(f"embedding {differs} mismatch: rebuild the index")
    mine = cut_lineage(chunks.select("id", "sha256"), "ids") if keys is None else keys
    compared = cut_lineage(delta.compare_chunks(mine, stored_ids(spark, path, mine, "vectors")), "compare")
    clash = compared.filter(F.col("action") == delta.CONFLICT).first()
    if clash is not None:
        raise ValueError(f"chunk {clash['id']!r} is stored with different content: rebuild the index")
    added = delta.chunks_to_add(chunks, compared, mine).select(*(columns or chunks.columns))
    return put_keyed(embedded(added, identity, embed), path, "vectors", batch)


def embedded(chunks: DataFrame, identity: EmbeddingIdentity, embed) -> DataFrame:
    if embed is None:
        return vectors.hash_vectors(chunks, identity.normalizes_vectors)
    return chunks.withColumn("embedding", embed(F.col("text")))


def commit(
    added: DataFrame, path: str, batch: int, backend: str, source: str, identity: EmbeddingIdentity | None,
    version: int | None = None, batches: DataFrame | None = None, **more
) -> DataFrame:
    """Make a batch visible and return the row that describes the index with it.

    The chunk count is the count before plus the counted rows of this batch. If it holds several batches of a run,
    `batches` has a row with the counters of each, and so has the commit.
    """
    spark = added.sparkSession
    path = home(spark, path)
    done = committed_batches(spark, path)
    count = spark.read.parquet(batch_folder(path, "commits", done[-1])).first()["chunk_count"] if done else 0
    version = version or (schemas.LEXICAL_SCHEMA_VERSION if backend == LEXICAL else schemas.SEMANTIC_SCHEMA_VERSION)
    described = identity or EmbeddingIdentity("", "", 0, False)
    row = added.agg((F.count("*") + count).alias("chunk_count")).select(
        F.lit(batch).cast("bigint").alias("batch_number"),
        F.lit(backend).alias("backend"), F.lit(version).alias("schema_version"), "chunk_count",
        F.lit(source).alias("source_chunks"),
        F.lit(identity.fingerprint() if identity else None).cast("string").alias("embedding_fingerprint"),
        F.lit(described.backend).alias("embedding_backend"),
        F.lit(described.model_name).alias("embedding_model_name"),
        F.lit(described.dimensions).alias("embedding_dimensions"),
        F.lit(described.normalizes_vectors).alias("normalizes_vectors"),
        F.lit(described.model_path_id).cast("string").alias("model_path_id"),
        *[F.lit(value).alias(name) for name, value in more.items()],
    )
    if batches is not None:
        row = batches.crossJoin(row)
    row.coalesce(1).write.mode("overwrite").parquet(batch_folder(path, "commits", batch))
    for keys in (chunk_keys(spark, path), ledger_keys(spark, path)):
        keys.compact([*done, batch])
    return index_stats(spark, path)


def index_stats(spark: SparkSession, path: str) -> DataFrame:
    """The newest commit row; chunks and vectors are not touched."""
    path = home(spark, path)
    done = committed_batches(spark, path)
    if not done:
        raise FileNotFoundError(f"no index at {path}")
    newest = spark.read.parquet(batch_folder(path, "commits", done[-1]))
    return newest.orderBy(F.desc("run_batch")).limit(1) if "run_batch" in newest.columns else newest


def read_identity(spark: SparkSession, path: str) -> EmbeddingIdentity | None:
    row = index_stats(spark, path).first()
    if row is None or row["embedding_fingerprint"] is None:
        return None
    return EmbeddingIdentity(
        row["embedding_backend"], row["embedding_model_name"], row["embedding_dimensions"],
        row["normalizes_vectors"], row["model_path_id"],
    )


def search_index(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 5, identity: EmbeddingIdentity | None = None, embed=None,
    by_postings: bool = False,
) -> DataFrame:
    """Search an index by whatever it was built for.

    A lexical index is searched by one scan of its term table or, with `by_postings`, for few short
    questions through the sorted postings; the results are the same. A vector index of the first layout gives raw
    distances, the nearest first; `embed` has to be the one it was built with.
    """
    lexical.check_limit(k)
    described = index_stats(spark, path).first()
    if described["backend"] == LEXICAL:
        chunks = index_table(spark, path, "chunks")
        if by_postings:
            found = lexical.lookup_chunks(index_table(spark, path, "postings"), chunks, queries, k)
        else:
            found = lexical.search_chunks(index_table(spark, path, "terms"), chunks, queries, k)
        return found.withColumn("score_semantics", F.lit("lexical_term_frequency"))
    if described["schema_version"] == schemas.DISTANCE_SCHEMA_VERSION:
        return vectors.distance_search(index_table(spark, path, "vectors"), queries, embed, k)
    stored = read_identity(spark, path)
    if stored is None:
        raise ValueError(f"index {path} has no embedding metadata")
    return vectors.semantic_search(
        index_table(spark, path, "vectors"), queries, stored, identity or stored, embed, k
    )
