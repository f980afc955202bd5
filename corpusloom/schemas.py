"""Fixed schemas of the tables exchanged between jobs (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)  # DDL keeps the schemas readable


SOURCE_DDL = "title STRING, text STRING, source STRING"
DOCUMENT_DDL = (
    "document_id STRING, title STRING, text STRING, source STRING, "
    "content_digest STRING, position BIGINT, metadata STRING"
)
CHUNK_DDL = "id STRING, title STRING, source STRING, chunk_index INT, text STRING, sha256 STRING"
TERMS_DDL = "id STRING, tokens ARRAY<STRING>, tfs ARRAY<INT>"
POSTING_DDL = "token STRING, chunk_id STRING, tf INT"
VECTOR_DDL = CHUNK_DDL + ", embedding ARRAY<DOUBLE>"
CATALOG_DDL = (
    "name STRING, slug STRING, backend STRING, chunks_path STRING, index_dir STRING, "
    "chunk_count BIGINT, source_count BIGINT, created_at STRING, updated_at STRING, "
    "corpus_run_id STRING, source_fingerprint STRING"
)
LEDGER_DDL = "document_id STRING, content_digest STRING, completed_at STRING"
RUN_LEDGER_DDL = LEDGER_DDL + ", run_id STRING"
ERROR_DDL = "document_id STRING, position BIGINT, error_type STRING, message STRING"
RUN_DDL = (
    "schema_name STRING, schema_version INT, run_id STRING, created_at STRING, updated_at STRING, "
    "source STRING, source_format STRING, source_fingerprint STRING, index_slug STRING, "
    "index_backend STRING, chunk_size INT, chunk_overlap INT, batch_size INT, records_seen BIGINT, "
    "records_completed BIGINT, records_failed BIGINT, records_skipped BIGINT, chunks_written BIGINT, "
    "last_completed_position BIGINT, status STRING, estimated_records BIGINT, "
    "embedding_fingerprint STRING, records_embedded BIGINT, committed_batches BIGINT"
)
RUN_COUNTS = (
    "records_seen", "records_new", "records_skipped", "records_failed", "records_completed", "chunks_written",
    "last_completed_position",
)
COMMIT_DDL = (
    "batch_number BIGINT, backend STRING, schema_version INT, chunk_count BIGINT, source_chunks STRING, "
    "embedding_fingerprint STRING, embedding_backend STRING, embedding_model_name STRING, embedding_dimensions INT, "
    "normalizes_vectors BOOLEAN, model_path_id STRING, run_id STRING, run_batch STRING, "
    + ", ".join(f"{name} BIGINT" for name in RUN_COUNTS)
)
PAGE_DDL = (
    "title STRING, namespace INT, page_id BIGINT, redirect_target STRING, revision_id BIGINT, "
    "revision_timestamp STRING, revision_sha1 STRING, revision_text STRING"
)
EVAL_DDL = (
    "records ARRAY<STRUCT<id: STRING, text: STRING>>, "
    "queries ARRAY<STRUCT<query: STRING, relevant_ids: ARRAY<STRING>>>"
)

CHUNK_FIELDS = ("id", "title", "source", "chunk_index", "text", "sha256")

# Versions stamped into run rows, index manifests and export manifests.
RUN_SCHEMA_NAME = "corpus_run"
LEXICAL_SCHEMA_VERSION = 1
SEMANTIC_SCHEMA_VERSION = 2
DISTANCE_SCHEMA_VERSION = 1  # a vector index that does not say what made its vectors
CATALOG_SCHEMA_VERSION = 1
EXPORT_SCHEMA_VERSION = 1
