"""Evaluation sets: one JSON object with `records` and `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas


def read_evaluation_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`records(id, position, text)`, `queries(query_id, text)` and `relevant(query_id, id)`.

    Positions follow the file. A file that does not have the expected shape is refused.
    """
    ddl = schemas.EVAL_DDL + ", _corrupt STRING"
    loaded = spark.read.schema(ddl).option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    checked = loaded.select(
        (F.col("_corrupt").isNotNull() | F.col("records").isNull() | F.col("queries").isNull()
         | F.exists("records", lambda r: r["id"].isNull() | r["text"].isNull())
         | F.exists("queries", lambda q: q["query"].isNull() | q["relevant_ids"].isNull() | F.exists(q["relevant_ids"], lambda i: i.isNull()))
         ).alias("bad")
    ).first()
    if checked is None or checked["bad"]:
        raise ValueError(f"{path} is not an evaluation set (records of id and text, queries of query and relevant_ids)")
    records = loaded.select(F.posexplode("records").alias("position", "r")).select(
        "r.id", F.col("position").cast("long").alias("position"), "r.text"
    )
    queries = loaded.select(F.posexplode("queries").alias("query_id", "q")).select("query_id", F.col("q.query").alias("text"), "q.relevant_ids")
    relevant = queries.select("query_id", F.explode("relevant_ids").alias("id"))
    return records, queries.select("query_id", "text"), relevant
