"""Answer a table of questions from an index, and score an embedder on an evaluation set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vectors as vx
from corpusloom.operators import evaluate, rag
from corpusloom.plans import index_store
from corpusloom.session import cut_lineage
from corpusloom.sources.eval_sets import read_evaluation_set


def answer(
    spark: SparkSession, index: str, questions: DataFrame, k: int = 5, load_model: Callable | None = None,
    embed: Callable[[Column], Column] | None = None, intro: str = rag.DEFAULT_INTRO,
) -> DataFrame:
    """Search the index (lexically or semantically, as it was built), assemble prompts and answer.

    Without a model, only questions without hits have an answer. `questions` has `query_id` and `text`.
    """
    results = index_store.search_index(spark, index, questions, k, embed=embed)
    asked = rag.ask(results, questions, intro)
    return rag.fixed_answers(asked) if load_model is None else rag.model_answers(asked, load_model)


def evaluate_embedder(spark: SparkSession, path: str, embed: Callable[[Column], Column] = vx.hash_embed) -> DataFrame:
    """Top-1 accuracy, recall@3 and mean reciprocal rank of an embedder on an evaluation file."""
    records, queries, relevant = read_evaluation_set(spark, path)
    stored = cut_lineage(records.select("id", "position", embed(F.col("text")).alias("embedding")), "records")
    asked = cut_lineage(queries.select("query_id", embed(F.col("text")).alias("embedding")), "queries")
    return evaluate.metrics(evaluate.by_judgements(stored, asked, relevant), stored.count())
