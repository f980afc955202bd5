"""A corpus pipeline of five stages; each takes documents and gives what the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontaminate, language, minhash, toxicity
from corpusloom.llm.common import prepare, sha256_joined
from corpusloom.session import cut_lineage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, trained on the labelled ones, does not predict to be toxic."""
    prepare(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with some certainty."""
    prepare(spark)
    said = {"declared": F.col("lang"), "host": F.col("source")}
    return language.keep_identified(docs, language.train(docs, "text", said["declared"]), **said)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepare(spark)
    return minhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark that make up a twentieth of them or more."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, and whether these give the text back."""
    prepare(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    given = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("given"))
    coded = bpe.encode_and_decode(given, ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), sha256_joined(F.col("ids")).alias("ids_sha256"),
        (F.col("given") == F.sha2("decoded", 256)).alias("same_text"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("language", identified),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("byte_level_bpe", tokenized),
]
ORACLE_SQL = None  # trained models and token merges are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
