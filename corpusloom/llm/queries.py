"""The registered queries of this subpackage, each with the SQL it is compared with where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    bpe, decontaminate, hard_negatives, language, merkle, minhash, page_text, piece_coding, shards, token_counts, toxicity, url_rules, vector_dups,
)
from corpusloom.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
rows_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows_ a JOIN rows_ b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.doc_id AND reach.c < links.b),
least AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)"""


@query("op9_minhash_near_dedup", _NEAR_SQL)
def op9(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


_VECTOR_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (
  SELECT * FROM vectors WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
  AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT vec_id, vec_id AS c FROM vectors
  UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.vec_id AND reach.c < links.b),
least AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM least"""


@query("op1_embedding_near_dedup", _VECTOR_SQL)
def op1(spark, sf_dir):
    return vector_dups.vector_duplicates(table(spark, sf_dir, "embeddings"))


_BENCH_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS words
  FROM (SELECT item, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, sizes WHERE len(w) >= m),
found AS (
  SELECT doc_id, item, i, m FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS words FROM places) p JOIN windows USING (m, words)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM found)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op8_benchmark_decontamination", _BENCH_SQL)
def op8(spark, sf_dir):
    return decontaminate.digests(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def ranks() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op2_byte_level_bpe")
def op2(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN)


@query("op7_token_counts")
def op7(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(rows, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), chain)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "spans")


@query("op3_language_id")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, "text", F.col("lang"))
    return language.identify(docs, model, declared=F.col("lang"), host=F.col("source"))


@query("language_of_pages")
def language_of_pages(spark, sf_dir):
    said = language.page_evidence()
    pages = table(spark, sf_dir, "pages").select("page_id", *[c.alias(k) for k, c in said.items()])
    model = language.train(pages, "text", F.col("declared"))
    return language.identify(pages, model, "page_id", declared=F.col("declared"), host=F.col("host"), suffix=F.col("suffix"))


@query("op4_sharding")
def op4(spark, sf_dir):
    sharded = shards.shuffled_shards(table(spark, sf_dir, "documents"), 16, seed=17)
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op6_url_filter")
def op6(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, rule_verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


@query("op10_html_main_text")
def op10(spark, sf_dir):
    return page_text.main_texts(table(spark, sf_dir, "pages"))


_NEGATIVES_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER hardest AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW hardest AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER hardest <= 3"""


@query("op12_hard_negatives", _NEGATIVES_SQL)
def op12(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


@query("op13_merkle_manifest")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proven = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], claimed={"text": tampered})
    return merkle.audit(proven).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", "verified"
    )


@query("op11_sentencepiece")
def op11(spark, sf_dir):
    return piece_coding.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
