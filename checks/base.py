"""Shared inputs of the registered queries, as DataFrames and as the SQL that derives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking, lexical
from corpusloom.session import cut_lineage, scratch_path, ship_package
from corpusloom.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the equivalent SQL where there is one."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", spread=True)  # one small file each


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as corpus documents."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("doc "), "doc_id").alias("title"),
        "text", "source", tx.sha256_hex("text").alias("content_digest"), F.col("doc_id").alias("position"),
        F.lit(None).cast("string").alias("metadata"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(documents(spark, sf_dir))


def stored_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and term table, written once as an index would hold them."""
    rows = cut_lineage(chunks(spark, sf_dir), "chunks")
    return rows, lexical.term_table(rows)


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a query."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.concat(F.lit("v"), "vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("long").alias("label"), F.col("vec_id").alias("position"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


# SQL twins of the inputs above -------------------------------------------------------------------

SQL_WS = (
    "(SELECT string_agg(chr(p), '') FROM (SELECT unnest([9,10,11,12,13,28,29,30,31,32,133,160,5760,8192,8193,"
    "8194,8195,8196,8197,8198,8199,8200,8201,8202,8232,8233,8239,8287,12288]) AS p))"
)
SQL_DOCS = f"""docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, 'doc ' || doc_id AS title, source,
         trim(text, {SQL_WS}) AS text, sha256(text) AS content_digest, doc_id AS position
  FROM documents)"""
SQL_CHUNKS = SQL_DOCS + """, cut AS (
  SELECT *, unnest(range(CASE WHEN length(text) > 1000
                  THEN 1 + CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT) ELSE 1 END)) AS i
  FROM docs WHERE length(text) > 0),
chunks AS (
  SELECT document_id || ':' || printf('%06d', i) || ':' || substring(sha256(substring(text, i * 800 + 1, 1000)), 1, 12) AS id,
         document_id, title, source, CAST(i AS INTEGER) AS chunk_index,
         substring(text, i * 800 + 1, 1000) AS text,
         sha256(substring(text, i * 800 + 1, 1000)) AS sha256
  FROM cut)"""
SQL_TERMS = SQL_CHUNKS + """, tokens AS (
  SELECT id AS chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM chunks),
terms AS (SELECT token, chunk_id, count(*) AS tf FROM tokens GROUP BY ALL)"""
SQL_USER_TURNS = """asked AS (
  SELECT conv_id || '-' || turn AS query_id, text FROM conversations WHERE role = 'user'),
asked_terms AS (
  SELECT query_id, token, count(*) AS qtf
  FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM asked) GROUP BY ALL)"""


def sql_lexical_hits(k: int = 5) -> str:
    """Ranked lexical hits of every user turn."""
    return f"""{SQL_TERMS}, {SQL_USER_TURNS},
scored AS (
  SELECT query_id, chunk_id, round(sum(qtf * (1 + 0.1::DOUBLE * tf)), 9) AS score
  FROM asked_terms JOIN terms USING (token) GROUP BY ALL),
hits AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM scored QUALIFY rank <= {k}),
results AS (
  SELECT query_id, rank, score, id, title, source, chunk_index, text
  FROM hits JOIN chunks ON chunks.id = hits.chunk_id)"""
