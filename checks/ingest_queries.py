"""Incremental ingest, index storage, catalog and workspace queries.

What counts as "already there" comes from the tables: labelled documents are the completed ones, and
the toxic ones among them were completed with an older text.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import SQL_CHUNKS, SQL_DOCS, SQL_TERMS, SQL_USER_TURNS, chunks, documents, query, scratch, table, user_turns
from corpusloom.functions import text as tx
from corpusloom.operators import catalog as cat
from corpusloom.operators import delta
from corpusloom.plans import index_store, ingest
from corpusloom.plans.workspace import Workspace, inline_sources
from corpusloom.session import cut_lineage
from corpusloom.sources import fingerprints, text_files
from corpusloom.streaming import ingest_stream

_SQL_LEDGER = SQL_DOCS + """, ledger AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(d.text || CASE WHEN toxic = 1 THEN ' (old)' ELSE '' END) AS content_digest
  FROM labels JOIN documents d USING (doc_id)),
incoming AS (
  SELECT document_id, content_digest, position FROM docs
  UNION ALL SELECT document_id, content_digest, position + 10000000 FROM docs WHERE source = 'src1'
  UNION ALL SELECT document_id, sha256(text || '!'), position + 20000000 FROM docs WHERE source = 'src2'),
copies AS (SELECT document_id, content_digest, min(position) AS position, count(*) AS copies FROM incoming GROUP BY ALL),
verdicts AS (
  SELECT c.document_id, c.content_digest, c.position, c.copies,
         CASE WHEN l.content_digest = c.content_digest THEN 'unchanged' WHEN l.content_digest IS NOT NULL THEN 'changed'
              WHEN c.content_digest = first_value(c.content_digest) OVER (PARTITION BY c.document_id ORDER BY c.position) THEN 'new'
              ELSE 'changed' END AS verdict
  FROM copies c LEFT JOIN ledger l USING (document_id))"""


def _ledger(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    old = F.when(F.col("toxic") == 1, " (old)").otherwise("")
    return rows.select(
        F.col("doc_id").cast("string").alias("document_id"), tx.sha256_hex(F.concat("text", old)).alias("content_digest"),
        F.lit("2024-01-01").alias("completed_at"),
    )


def _incoming(spark, sf_dir):
    """All documents, some twice and some a second time with another text."""
    docs = documents(spark, sf_dir)
    again = docs.filter(F.col("source") == "src1").withColumn("position", F.col("position") + 10_000_000)
    edited = docs.filter(F.col("source") == "src2").withColumns({
        "text": F.concat("text", F.lit("!")), "position": F.col("position") + 20_000_000,
    }).withColumn("content_digest", tx.sha256_hex("text"))
    return docs.unionByName(again).unionByName(edited)


def _verdicts(spark, sf_dir):
    return delta.classify(_incoming(spark, sf_dir), _ledger(spark, sf_dir))


@query("ingest_delta", f"WITH {_SQL_LEDGER} SELECT document_id, content_digest, position, copies, verdict FROM verdicts")
def ingest_delta(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query("ingest_conflicts", f"WITH {_SQL_LEDGER} SELECT document_id, position, 'content_changed' AS error_type FROM verdicts WHERE verdict = 'changed'")
def ingest_conflicts(spark, sf_dir):
    return delta.conflicts(_verdicts(spark, sf_dir)).drop("message")


_SQL_COUNTS = """CAST(sum(copies) AS BIGINT) AS records_seen, count(*) FILTER (verdict = 'new') AS records_new,
  CAST(coalesce(sum(copies) FILTER (verdict = 'unchanged'), 0) + coalesce(sum(copies - 1) FILTER (verdict = 'new'), 0) AS BIGINT) AS records_skipped,
  CAST(coalesce(sum(copies) FILTER (verdict = 'changed'), 0) AS BIGINT) AS records_failed"""


@query("ingest_counters", f"WITH {_SQL_LEDGER} SELECT {_SQL_COUNTS} FROM verdicts")
def ingest_counters(spark, sf_dir):
    return delta.ingest_counts(_verdicts(spark, sf_dir))


def _config(**options):
    return ingest.IngestConfig("corpus", source="documents", source_fingerprint="f", **options)


def _store(spark):
    return ingest.CorpusStore(spark, scratch(spark, "corpus"))


_RUN = ("status", "records_seen", "records_completed", "records_skipped", "records_failed", "chunks_written")


def _completed_run(spark, sf_dir):
    """An ingest whose ledger already holds what the labels cover."""
    store, config = _store(spark), _config(continue_on_error=True)
    store.put(_ledger(spark, sf_dir), f"ledger/run_id={config.run_id()}/batch=before")
    ingest.run(store, _incoming(spark, sf_dir), config)
    return store, config


_SQL_FRESH = _SQL_LEDGER + """, fresh AS (SELECT v.document_id, length(text) AS n FROM verdicts v JOIN docs USING (document_id) WHERE verdict = 'new'),
sizes AS (SELECT count(*) AS records_completed, CAST(sum(CASE WHEN n > 1000 THEN 1 + CAST(ceil((n - 1000) / 800.0) AS BIGINT) ELSE 1 END) AS BIGINT) AS chunks_written FROM fresh)"""


@query("ingest_errors", f"WITH {_SQL_LEDGER} SELECT document_id, position, 'content_changed' AS error_type FROM verdicts WHERE verdict = 'changed'")
def ingest_errors(spark, sf_dir):
    store, config = _completed_run(spark, sf_dir)
    return store.errors(config.run_id()).select("document_id", "position", "error_type")


@query("run_summary", f"""WITH {_SQL_FRESH}, c AS (SELECT {_SQL_COUNTS} FROM verdicts)
SELECT 'completed' AS status, records_seen, records_completed, records_skipped, records_failed, chunks_written FROM c, sizes""")
def run_summary(spark, sf_dir):
    store, _ = _completed_run(spark, sf_dir)
    return store.runs().filter(F.col("status") == "completed").select(*_RUN)


@query("run_status", f"""WITH {_SQL_FRESH}
SELECT records_completed, chunks_written, (SELECT count(*) FROM incoming) AS estimated_records,
       round(100.0::DOUBLE * records_completed / (SELECT count(*) FROM incoming), 2) AS progress_percent FROM sizes""")
def run_status(spark, sf_dir):
    store, _ = _completed_run(spark, sf_dir)
    return ingest.status(store).select("records_completed", "chunks_written", "estimated_records", "progress_percent")


@query("run_latest", """
WITH r AS (SELECT 'run-' || user_id AS run_id, max(ts) AS updated, count(*) AS records_completed FROM events GROUP BY user_id)
SELECT run_id, records_completed FROM r ORDER BY updated DESC, run_id DESC LIMIT 1""")
def run_latest(spark, sf_dir):
    """Every user is a run, every event an update of it."""
    events = table(spark, sf_dir, "events")
    runs = events.groupBy("user_id").agg(F.max("ts").cast("string").alias("updated_at"), F.count("*").alias("records_completed"))
    named = runs.withColumn("run_id", F.concat(F.lit("run-"), "user_id"))
    return cat.latest_run(named).select("run_id", "records_completed")


@query("ingest_batches", f"""WITH {SQL_DOCS}
SELECT lpad(CAST(position // 300 AS VARCHAR), 8, '0') AS batch, count(*) AS documents, max(position) AS last_position FROM docs GROUP BY ALL""")
def ingest_batches(spark, sf_dir):
    """What the committed batches of a run say about themselves."""
    store, config = _store(spark), _config(batch_size=300)
    ingest.run(store, documents(spark, sf_dir), config)
    done = store.committed("corpus", config.run_id())
    return done.select(F.col("run_batch").alias("batch"), F.col("records_completed").alias("documents"), F.col("last_completed_position").alias("last_position"))


def _die_behind(store, config, docs, batches: int) -> None:
    """Ingest the first batches of a run as one does that is killed behind them, in the middle of the next."""
    run_id = config.run_id()
    row = ingest._run_row(store.spark, config, run_id, "running", ingest._no_counts(store.spark), 0, docs.count())
    store.put(row, f"runs/state={run_id}-0000-running")
    for number in range(batches):
        part = docs.filter(F.floor(F.col("position") / config.batch_size) == number)
        ingest.ingest_batch(store, part, config, run_id, f"{number:08d}")
    index = store.index_dir(config.index_slug)
    torn = store.chunks(config.index_slug).withColumn("id", F.concat(F.lit("torn-"), "id"))
    index_store.put_batch(cut_lineage(torn, "torn"), index, "chunks", index_store.next_batch(store.spark, index))


_SQL_FOUND = f"""WITH {SQL_TERMS}, {SQL_USER_TURNS},
scored AS (SELECT query_id, chunk_id AS id, round(sum(qtf * (1 + 0.1::DOUBLE * tf)), 9) AS score FROM asked_terms JOIN terms USING (token) GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 3)
SELECT query_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score, id FROM hits"""


def _found(spark, sf_dir, index: str):
    found = index_store.search_index(spark, index, user_turns(spark, sf_dir), 3)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "id")


@query("ingest_search", _SQL_FOUND)
def ingest_search(spark, sf_dir):
    """An ingest, then a search in the index that the catalog names."""
    store, config = _store(spark), _config()
    ingest.run(store, documents(spark, sf_dir), config)
    entry = Workspace(spark, store.root).entry("corpus")
    return _found(spark, sf_dir, entry["index_dir"])


@query("ingest_resume", _SQL_FOUND)
def ingest_resume(spark, sf_dir):
    """A run that died in its third batch, resumed and searched."""
    store, config = _store(spark), _config(batch_size=400)
    docs = documents(spark, sf_dir)
    _die_behind(store, config, docs, 2)
    ingest.run(store, docs, config, resume=True)
    return _found(spark, sf_dir, store.index_dir("corpus"))


@query("append_retry", _SQL_FOUND)
def append_retry(spark, sf_dir):
    """An append that died before its commit, repeated twice."""
    path = scratch(spark, "lexical")
    rows = cut_lineage(chunks(spark, sf_dir).drop("document_id"), "chunks")
    some = rows.filter(F.col("source").isin("src1", "src2", "src3"))
    index_store.build_lexical(some, path)
    index_store.put_lexical(rows, path, index_store.next_batch(spark, path))  # everything but the commit
    for _ in range(2):
        index_store.append_lexical(rows, path)
    return _found(spark, sf_dir, path)


_SQL_INDEXED = f"WITH {SQL_CHUNKS} SELECT id, title, source, chunk_index, sha256 FROM chunks"


@query("ingest_replay", _SQL_INDEXED)
def ingest_replay(spark, sf_dir):
    """The same run twice: the second one does nothing."""
    store, config = _store(spark), _config()
    ingest.run(store, documents(spark, sf_dir), config)
    ingest.run(store, documents(spark, sf_dir), config)
    return store.chunks("corpus").select("id", "title", "source", "chunk_index", "sha256")


@query("ingest_rebuild", _SQL_INDEXED)
def ingest_rebuild(spark, sf_dir):
    """An index of edited texts, rebuilt by force from the real ones."""
    store, config = _store(spark), _config()
    edited = documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" edited"))).withColumn("content_digest", tx.sha256_hex("text"))
    ingest.run(store, edited, config)
    ingest.run(store, documents(spark, sf_dir), config, force=True)
    return store.chunks("corpus").select("id", "title", "source", "chunk_index", "sha256")


@query("ingest_stream", _SQL_INDEXED)
def ingest_stream_job(spark, sf_dir):
    """Documents arriving as files, ingested by a stream until none is left."""
    arriving = scratch(spark, "arriving")
    documents(spark, sf_dir).repartition(4, "document_id").write.parquet(arriving)
    store, config = _store(spark), _config()
    stream = ingest_stream.document_stream(spark, arriving, files_per_trigger=2)
    ingest_stream.start(store, stream, config, scratch(spark, "stream-state")).awaitTermination()
    return store.chunks("corpus").select("id", "title", "source", "chunk_index", "sha256")


@query("stream_search", _SQL_FOUND)
def stream_search(spark, sf_dir):
    """A stream whose state is lost after some micro-batches, so that it repeats them; then a search in the index that the
    catalog names."""
    arriving = scratch(spark, "arriving")
    docs = documents(spark, sf_dir).repartition(4, "document_id")
    docs.filter(F.col("position") % 3 > 0).write.parquet(arriving)
    store, config = _store(spark), _config()
    ingest_stream.start(store, ingest_stream.document_stream(spark, arriving, 2), config, scratch(spark, "state")).awaitTermination()
    docs.filter(F.col("position") % 3 == 0).write.mode("append").parquet(arriving)
    row = ingest_stream.drain(store, ingest_stream.document_stream(spark, arriving, 2), config, scratch(spark, "state")).first()
    entry = Workspace(spark, store.root).entry("corpus")
    if (entry["corpus_run_id"], entry["chunk_count"]) != (row["run_id"], row["chunks_written"]):
        raise AssertionError("the catalog is not of the last commit")
    return _found(spark, sf_dir, entry["index_dir"])


@query("stream_counters", f"""WITH {SQL_CHUNKS}
SELECT 'completed' AS status, (SELECT count(*) FROM docs) AS records_seen, (SELECT count(*) FROM docs WHERE length(text) > 0) AS records_completed,
       count(*) AS chunks_written FROM chunks""")
def stream_counters(spark, sf_dir):
    """The run row of a stream, from its commits."""
    arriving = scratch(spark, "arriving")
    documents(spark, sf_dir).repartition(3, "document_id").write.parquet(arriving)
    store, config = _store(spark), _config(backend=index_store.SEMANTIC)
    done = ingest_stream.drain(store, ingest_stream.document_stream(spark, arriving, 1), config, scratch(spark, "state"))
    return done.select("status", "records_seen", "records_completed", "chunks_written")


def _old_and_new(spark, sf_dir):
    """A store with an index of some documents, and the documents of the forced run that is to replace it."""
    store, config = _store(spark), _config(batch_size=400)
    docs = documents(spark, sf_dir)
    ingest.run(store, docs.filter(F.col("source") == "src1"), config)
    return store, config, docs


@query("rebuild_interrupted", f"WITH {SQL_CHUNKS} SELECT id, title, source, chunk_index, sha256 FROM chunks WHERE source = 'src1'")
def rebuild_interrupted(spark, sf_dir):
    """A forced run that died behind its first batch leaves the old index as it was."""
    store, config, docs = _old_and_new(spark, sf_dir)
    _die_in_rebuild(store, config, docs)
    return store.chunks("corpus").select("id", "title", "source", "chunk_index", "sha256")


def _die_in_rebuild(store, config, docs):
    real, calls = ingest.ingest_batch, []

    def dying(*args, **options):
        if calls:
            raise InterruptedError
        calls.append(real(*args, **options))

    ingest.ingest_batch = dying
    try:
        ingest.run(store, docs, config, force=True)
    except InterruptedError:
        pass
    finally:
        ingest.ingest_batch = real


@query("rebuild_resumed", _SQL_INDEXED)
def rebuild_resumed(spark, sf_dir):
    """The same forced run, resumed: it replaces the index when it is whole."""
    store, config, docs = _old_and_new(spark, sf_dir)
    _die_in_rebuild(store, config, docs)
    ingest.run(store, docs, config, resume=True)
    return store.chunks("corpus").select("id", "title", "source", "chunk_index", "sha256")


@query("append_compacted", f"""WITH {SQL_CHUNKS}
SELECT id, sha256, (SELECT count(*) FROM chunks) AS chunk_count, 2 AS runs FROM chunks""")
def append_compacted(spark, sf_dir):
    """Nine appends that overlap: the key table holds every id once, in two runs."""
    path = scratch(spark, "chunks")
    rows = cut_lineage(chunks(spark, sf_dir).drop("document_id"), "chunks")
    part = F.pmod(F.xxhash64("id"), F.lit(9))
    index_store.write_chunks(rows.filter(part == 0), path)
    for n in range(1, 9):
        index_store.append_chunks(rows.filter((part == n) | (part == n - 1)), path)
    keys, done = index_store.chunk_keys(spark, path), index_store.committed_batches(spark, path)
    count = index_store.index_stats(spark, path).first()["chunk_count"]
    return keys.all(done).select("id", "sha256", F.lit(count).alias("chunk_count"), F.lit(len(keys.live(done))).alias("runs"))


# index storage ------------------------------------------------------------------------------------
_SQL_SOME = "FROM chunks WHERE CAST(document_id AS BIGINT) IN (SELECT doc_id FROM labels)"


def _labelled(spark, sf_dir, rows):
    some = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    return rows.join(some, "document_id", "left_semi")


@query("chunks_append", f"WITH {SQL_CHUNKS} SELECT id, sha256 FROM chunks")
def chunks_append(spark, sf_dir):
    path = scratch(spark, "chunks")
    rows = cut_lineage(chunks(spark, sf_dir), "chunks")
    index_store.write_chunks(_labelled(spark, sf_dir, rows), path)
    index_store.append_chunks(rows, path)
    return index_store.index_table(spark, path, "chunks").select("id", "sha256")


@query("chunks_write", f"WITH {SQL_CHUNKS} SELECT id, title, source, chunk_index, text, sha256 FROM chunks")
def chunks_write(spark, sf_dir):
    path = scratch(spark, "chunks")
    index_store.write_chunks(chunks(spark, sf_dir), path)
    return index_store.index_table(spark, path, "chunks").drop("document_id")


@query("lex_build", f"WITH {SQL_TERMS} SELECT token, chunk_id, tf FROM terms")
def lex_build(spark, sf_dir):
    path = scratch(spark, "lexical")
    index_store.build_lexical(chunks(spark, sf_dir), path)
    return index_store.index_table(spark, path, "postings").withColumn("tf", F.col("tf").cast("long"))


@query("lex_append", f"""WITH {SQL_TERMS}, n AS (SELECT count(*) AS chunk_count FROM chunks)
SELECT chunk_count, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens, count(DISTINCT token) AS vocabulary FROM terms, n GROUP BY chunk_count""")
def lex_append(spark, sf_dir):
    path = scratch(spark, "lexical")
    rows = cut_lineage(chunks(spark, sf_dir), "chunks")
    index_store.build_lexical(_labelled(spark, sf_dir, rows), path)
    index_store.append_lexical(rows, path)
    counted = index_store.index_stats(spark, path).first()["chunk_count"]
    totals = index_store.index_table(spark, path, "postings").agg(
        F.count("*").alias("postings"), F.sum("tf").alias("tokens"), F.count_distinct("token").alias("vocabulary")
    )
    return totals.withColumn("chunk_count", F.lit(counted).cast("bigint"))


@query("vec_append", f"""WITH {SQL_CHUNKS}, stored AS (
  SELECT c.id, sha256(c.text || CASE WHEN toxic = 1 THEN ' (old)' ELSE '' END) AS sha256 FROM chunks c JOIN labels ON doc_id = CAST(document_id AS BIGINT))
SELECT c.id, CASE WHEN s.id IS NULL THEN 'add' WHEN s.sha256 = c.sha256 THEN 'skip' ELSE 'conflict' END AS action
FROM chunks c LEFT JOIN stored s USING (id)""")
def vec_append(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id"), "toxic")
    old = F.when(F.col("toxic") == 1, " (old)").otherwise("")
    stored = rows.join(labels, "document_id").select("id", tx.sha256_hex(F.concat("text", old)).alias("sha256"))
    return delta.compare_chunks(rows, stored).select("id", "action")


@query("index_stats", f"""WITH {SQL_CHUNKS}
SELECT 'semantic' AS backend, 2 AS schema_version, count(*) AS chunk_count, 8 AS embedding_dimensions, 'documents' AS source_chunks FROM chunks""")
def index_stats(spark, sf_dir):
    path = scratch(spark, "vectors")
    index_store.build_vectors(chunks(spark, sf_dir), path, source="documents")
    return index_store.index_stats(spark, path).select("backend", "schema_version", "chunk_count", "embedding_dimensions", "source_chunks")


@query("chunk_and_index", f"""WITH {SQL_TERMS}
SELECT 'simple' AS backend, (SELECT count(*) FROM chunks) AS chunk_count, (SELECT count(DISTINCT source) FROM chunks) AS source_count,
       count(*) AS postings FROM terms""")
def chunk_and_index(spark, sf_dir):
    path = scratch(spark, "lexical")
    meta = index_store.build_lexical(chunks(spark, sf_dir), path).select("backend", "chunk_count")
    sources = index_store.index_table(spark, path, "chunks").agg(F.count_distinct("source")).first()[0]
    postings = index_store.index_table(spark, path, "postings").count()
    return meta.withColumns({"source_count": F.lit(sources).cast("bigint"), "postings": F.lit(postings).cast("bigint")})


# catalog ------------------------------------------------------------------------------------------
_SQL_CATALOG = SQL_CHUNKS + """, catalog AS (
  SELECT upper(source) AS name, source AS slug, 'simple' AS backend, '/old/' || source || '/chunks' AS chunks_path,
         '/old/' || source || '/index' AS index_dir, count(*) AS chunk_count, count(DISTINCT document_id) AS source_count,
         strftime(make_timestamp((1704067200 + min(CAST(document_id AS BIGINT))) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS created_at,
         strftime(make_timestamp((1704067200 + max(CAST(document_id AS BIGINT))) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS updated_at,
         'run-' || source AS corpus_run_id, sha256(source) AS source_fingerprint
  FROM chunks GROUP BY source),
changes AS (
  SELECT * REPLACE ('semantic' AS backend, chunk_count * 2 AS chunk_count, '2030-01-01T00:00:00+00:00' AS created_at)
  FROM catalog WHERE chunk_count % 2 = 0
  UNION ALL SELECT * REPLACE ('new-' || slug AS slug, '2030-01-01T00:00:00+00:00' AS created_at) FROM catalog WHERE chunk_count % 2 = 1)"""


def _catalog(spark, sf_dir):
    """One index per document source."""
    rows = chunks(spark, sf_dir)
    per_document = rows.groupBy("source", "document_id").agg(F.count("*").alias("n"))

    def moment(column):
        return F.date_format(F.timestamp_seconds(F.lit(1704067200) + column), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")

    number = F.col("document_id").cast("long")
    return per_document.groupBy("source").agg(
        F.sum("n").alias("chunk_count"), F.count("*").alias("source_count"),
        moment(F.min(number)).alias("created_at"), moment(F.max(number)).alias("updated_at"),
    ).select(
        F.upper("source").alias("name"), F.col("source").alias("slug"), F.lit("simple").alias("backend"),
        F.concat(F.lit("/old/"), "source", F.lit("/chunks")).alias("chunks_path"),
        F.concat(F.lit("/old/"), "source", F.lit("/index")).alias("index_dir"),
        "chunk_count", "source_count", "created_at", "updated_at",
        F.concat(F.lit("run-"), "source").alias("corpus_run_id"), F.sha2("source", 256).alias("source_fingerprint"),
    )


def _changes(catalog):
    late = {"created_at": F.lit("2030-01-01T00:00:00+00:00")}
    even = catalog.filter(F.col("chunk_count") % 2 == 0).withColumns({
        "backend": F.lit("semantic"), "chunk_count": F.col("chunk_count") * 2, **late
    })
    odd = catalog.filter(F.col("chunk_count") % 2 == 1).withColumns({"slug": F.concat(F.lit("new-"), "slug"), **late})
    return even.unionByName(odd)


@query("catalog_counts", f"WITH {SQL_CHUNKS} SELECT source AS slug, count(*) AS chunk_count, count(DISTINCT document_id) AS source_count FROM chunks GROUP BY ALL")
def catalog_counts(spark, sf_dir):
    return cat.counts(chunks(spark, sf_dir).withColumnRenamed("source", "slug"), source="document_id")


@query("catalog_list", f"WITH {_SQL_CATALOG} SELECT row_number() OVER (ORDER BY updated_at DESC, slug) AS place, slug, updated_at FROM catalog")
def catalog_list(spark, sf_dir):
    listed = cat.list_newest(_catalog(spark, sf_dir))
    place = F.row_number().over(Window.orderBy(F.col("updated_at").desc(), "slug"))  # the catalog: one row per index
    return listed.select(place.cast("long").alias("place"), "slug", "updated_at")


@query("catalog_upsert", f"""WITH {_SQL_CATALOG}
SELECT * FROM catalog WHERE slug NOT IN (SELECT slug FROM changes)
UNION ALL SELECT c.* REPLACE (coalesce(o.created_at, c.created_at) AS created_at) FROM changes c LEFT JOIN catalog o USING (slug)""")
def catalog_upsert(spark, sf_dir):
    entries = cut_lineage(_catalog(spark, sf_dir), "catalog")
    return cat.upsert_entries(entries, _changes(entries))


@query("catalog_delete", f"WITH {_SQL_CATALOG} SELECT slug, chunk_count FROM catalog WHERE chunk_count % 2 = 1")
def catalog_delete(spark, sf_dir):
    entries = cut_lineage(_catalog(spark, sf_dir), "catalog")
    return cat.delete_entries(entries, entries.filter(F.col("chunk_count") % 2 == 0)).select("slug", "chunk_count")


@query("catalog_audit", f"""WITH {_SQL_CATALOG}
SELECT slug FROM changes WHERE slug NOT IN (SELECT source FROM chunks)""")
def catalog_audit(spark, sf_dir):
    entries = _changes(_catalog(spark, sf_dir))
    return cat.missing_data(entries, chunks(spark, sf_dir).select(F.col("source").alias("slug"))).select("slug")


@query("export_indexes", f"WITH {_SQL_CATALOG} SELECT name, slug, backend, chunk_count, source_count FROM catalog")
def export_indexes(spark, sf_dir):
    """Catalog and chunks of all indexes written as one export and its manifest read back."""
    path = scratch(spark, "export")
    rows = chunks(spark, sf_dir).withColumnRenamed("document_id", "_doc")
    rows.withColumn("slug", F.col("source")).write.partitionBy("slug").parquet(f"{path}/chunks")
    cat.export_manifest(_catalog(spark, sf_dir)).write.parquet(f"{path}/manifest")
    manifest = spark.read.parquet(f"{path}/manifest")
    stored = cat.counts(spark.read.parquet(f"{path}/chunks"), source="_doc")
    return manifest.join(stored, ["slug", "chunk_count", "source_count"], "left_semi").select("name", "slug", "backend", "chunk_count", "source_count")


@query("import_indexes", f"""WITH {_SQL_CATALOG}
SELECT name, slug, backend, chunk_count, chunks_path, corpus_run_id, source_fingerprint FROM catalog WHERE slug NOT IN (SELECT slug FROM changes)
UNION ALL SELECT name, slug, backend, chunk_count, '/ws/indexes/' || slug || '/chunks', NULL, NULL FROM changes""")
def import_indexes(spark, sf_dir):
    entries = cut_lineage(_catalog(spark, sf_dir), "catalog")
    merged = cat.import_entries(entries, _changes(entries), "/ws")
    return merged.select("name", "slug", "backend", "chunk_count", "chunks_path", "corpus_run_id", "source_fingerprint")


_SQL_WORKSPACE = f"""WITH {SQL_DOCS}, c AS (
  SELECT document_id, text, unnest(range(CASE WHEN length(text) > 1000 THEN 1 + CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT) ELSE 1 END)) AS i FROM docs WHERE length(text) > 0)
SELECT 'All Documents' AS name, 'all-documents' AS slug, 'simple' AS backend, count(*) AS chunk_count, count(DISTINCT document_id) AS source_count FROM c"""


@query("workspace_ingest", _SQL_WORKSPACE)
def workspace_ingest(spark, sf_dir):
    space = Workspace(spark, scratch(spark, "workspace"))
    docs = documents(spark, sf_dir)
    sources = docs.select("title", "text", F.concat(F.lit("/in/"), "document_id", F.lit(".txt")).alias("source"))
    return space.ingest_sources(" All Documents ", sources).select("name", "slug", "backend", "chunk_count", "source_count")


@query("workspace_path_ingest", _SQL_WORKSPACE)
def workspace_path_ingest(spark, sf_dir):
    """The same index from text files below the workspace's source folder, one for each document.

    No two files have the same name, as a chunk's id comes from its file's name and its text.
    """
    folder = scratch(spark, "sources")
    name = F.format_string("part-%d.txt", F.monotonically_increasing_id())
    text_files.write_text_files(table(spark, sf_dir, "documents").select(name.alias("file"), F.col("text").alias("value")), f"{folder}/texts")
    space = Workspace(spark, scratch(spark, "workspace"), sources=folder)
    return space.ingest_path("All Documents", "texts").select("name", "slug", "backend", "chunk_count", "source_count")


def _workspaces(spark, sf_dir) -> tuple[Workspace, Workspace]:
    """A workspace with a lexical and a semantic index, and one that has imported its export over data in the way."""
    docs = table(spark, sf_dir, "documents").select("lang", F.concat(F.lit("doc "), "doc_id").alias("title"), "text", F.concat(F.lit("/in/"), "doc_id").alias("source"))
    space = Workspace(spark, scratch(spark, "workspace"))
    for lang, backend in (("de", index_store.LEXICAL), ("es", index_store.SEMANTIC)):
        space.ingest_sources(f"Lang {lang}", docs.filter(F.col("lang") == lang).drop("lang"), backend)
    out = scratch(spark, "export")
    space.export(out)
    other = Workspace(spark, scratch(spark, "other"))
    index_store.build_vectors(chunks(spark, sf_dir).drop("document_id").filter("chunk_index > 5"), other.index_dir("lang-de"))
    try:  # not in the catalog, but in the way
        other.import_(out)
    except ValueError:
        other.import_(out, force=True)
    return space, other


@query("workspace_import", f"""WITH {SQL_CHUNKS}
SELECT 'lang-' || lang AS slug, CASE lang WHEN 'de' THEN 'simple' ELSE 'semantic' END AS backend, '/in/' || document_id AS source, CAST(chunk_index AS BIGINT) AS chunk_index, sha256
FROM chunks JOIN documents d ON CAST(d.doc_id AS VARCHAR) = document_id WHERE lang IN ('de', 'es')""")
def workspace_import(spark, sf_dir):
    """The rows of two exported indexes as they lie in the workspace that imported them."""
    _, other = _workspaces(spark, sf_dir)
    parts = []
    for slug, backend in (("lang-de", index_store.LEXICAL), ("lang-es", index_store.SEMANTIC)):
        rows = index_store.index_table(spark, other.index_dir(slug), index_store.TABLES[backend][0])
        parts.append(rows.select(F.lit(slug).alias("slug"), F.lit(other.entry(slug)["backend"]).alias("backend"), "source", F.col("chunk_index").cast("long").alias("chunk_index"), "sha256"))
    return parts[0].unionByName(parts[1])


@query("workspace_search", f"""WITH {SQL_TERMS}, {SQL_USER_TURNS},
scored AS (SELECT query_id, chunk_id, round(sum(qtf * (1 + 0.1::DOUBLE * tf)), 9) AS score
  FROM asked_terms JOIN terms USING (token) JOIN chunks ON id = chunk_id JOIN documents d ON CAST(d.doc_id AS VARCHAR) = document_id WHERE lang = 'de' GROUP BY ALL)
SELECT query_id, round(max(score), 6) AS best FROM scored GROUP BY query_id""")
def workspace_search(spark, sf_dir):
    """Best scores in an imported index; the workspace's other index was deleted before."""
    _, other = _workspaces(spark, sf_dir)
    if not other.delete("lang-es") or other.missing_indexes():
        raise AssertionError("the deleted index had no data, or another is missing")
    found = index_store.search_index(spark, other.index_dir("lang-de"), user_turns(spark, sf_dir), 1)
    return found.select("query_id", F.round("score", 6).alias("best"))


# digests ------------------------------------------------------------------------------------------
@query("table_fingerprint", """
WITH d AS (SELECT sha256(coalesce(sha256(CAST(doc_id AS VARCHAR)), 'null') || coalesce(sha256(text), 'null') || coalesce(sha256(source), 'null')) AS digest FROM documents)
SELECT sha256(count(*) || ':' || """ + " || ':' || ".join(
    f"CAST(sum(CAST(('0x' || substring(digest, {1 + 15 * p}, 15))::BIGINT AS HUGEINT)) AS VARCHAR)" for p in range(4)
) + """) AS fingerprint, count(*) AS row_count FROM d""")
def table_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return fingerprints.table_fingerprint(rows, ["doc_id", "text", "source"]).select("fingerprint", "row_count")


@query("src_inline", f"""WITH {SQL_DOCS}
SELECT title, 'web:' || title AS source, sha256(text) AS digest FROM docs WHERE length(text) > 0""")
def src_inline(spark, sf_dir):
    pastes = documents(spark, sf_dir).select(F.concat(F.lit(" "), "title", F.lit("\n")).alias("title"), F.concat(F.lit("\t"), "text").alias("text"))
    return inline_sources(pastes).select("title", "source", tx.sha256_hex("text").alias("digest"))
