"""Shuffled shards by a two-pass external shuffle.

First pass: records are scattered by seeded hashes into buckets that fit into a task's memory. Second pass: each bucket
is put in order, shuffled with Fisher-Yates and written. The buckets one after another are a random order of all records;
it is dealt to the shards in turn, so that their row counts are at most one apart (law `rows`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import extended, free_name, require
from corpusloom.session import checked_keys, cut_lineage, may_broadcast

BUCKET_BYTES = 16 << 20
BUCKETS_A_SHARD = 16  # at least, so that small inputs use all cores
BUCKETS_A_TASK = 8  # held one after another
MAX_TASKS = 20_000  # beyond it tasks take more buckets
LAW = "rows"


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A random order of n records that depends on the seed and the bucket only."""
    random = np.random.Generator(np.random.Philox(key=np.array([seed, bucket], np.uint64)))
    order = list(range(n))
    picks = random.integers(0, np.arange(n, 0, -1)) if n else []
    for left, pick in zip(range(n - 1, 0, -1), picks):
        pick = int(pick)
        order[left], order[pick] = order[pick], order[left]
    return np.array(order, np.int64)


def _shuffled(seed: int, names: dict[str, str]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        keys = [(names[c], "ascending") for c in ("order", "crc", "size")]  # the same order whatever order rows came in
        table = table.take(pc.sort_indices(table, keys))
        order = fisher_yates(table.num_rows, seed, table[names["bucket"]][0].as_py())
        return table.take(pa.array(order)).append_column(names["place"], pa.array(np.arange(table.num_rows)))

    return run


def _numbered(rows: DataFrame, names: dict[str, str], counts: DataFrame) -> DataFrame:
    """`rows` with a column `number`: 0 for a row whose key no other has, else 0, 1, ... among the rows of the key.

    Copies are written with the partition they come from before they are numbered, so that a task that runs again
    numbers them alike; those of one key are counted by partition first, so that no task has to hold a key's rows.
    """
    key = [names["key"], names["crc"], "size"]
    number, source, seq = names["number"], names["source"], names["seq"]
    repeated = checked_keys(counts.filter("n > 1").select(*key))
    if not repeated.rows:
        return rows.withColumn(number, F.lit(0).cast("long"))
    keys = F.broadcast(repeated.keys) if repeated.small else repeated.keys
    copies = rows.join(keys, key, "left_semi").withColumn(source, F.spark_partition_id()).withColumn(seq, F.monotonically_increasing_id())
    copies = cut_lineage(copies, "copies")
    before = Window.partitionBy(*key).orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    starts = copies.groupBy(*key, source).agg(F.count("*").alias("n"))
    starts = starts.select(*key, source, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*key, source).orderBy(seq)) - 1
    copies = copies.withColumn(number, inside.cast("long")).join(starts.withColumnRenamed("n", names["start"]), [*key, source])
    copies = copies.withColumn(number, F.col(number) + F.col(names["start"])).drop(source, seq, names["start"])
    return rows.join(keys, key, "left_anti").withColumn(number, F.lit(0).cast("long")).unionByName(copies)


def shuffled_shards(docs: DataFrame, shards: int, seed: int = 0, id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of `docs` with `size`, `text_crc32`, `law`, `shard`, `slot` and `grown_shard`.

    `size` is the text's UTF-8 bytes (null: none) plus 1, `slot` counts from 0 without gaps in each shard, and
    `grown_shard` is null, as this law deals all rows anew for another number of shards. The order depends on ids,
    texts, the seed and the number of buckets, not on partitions. Rows that repeat id and text are numbered and
    scattered by their numbers, so that they overfill no bucket; which of them has which number is open, the places
    that they take together are not. Null ids and texts and empty tables are fine; columns with the result's names
    are replaced.
    """
    require(docs, id, text)
    if shards < 1:
        raise ValueError("at least one shard")
    result = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = docs.select(*[c for c in docs.columns if c.lower() not in result])
    names = {k: free_name(rows, k) for k in ("bucket", "key", "order", "crc", "place", "number", "source", "seq", "start")} | {"size": "size"}
    rows = rows.withColumn("size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)
    rows = rows.withColumn(names["crc"], F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = rows.withColumn(names["key"], F.xxhash64(F.lit(seed), F.col(id), names["crc"], F.col("size")))
    counts = cut_lineage(rows.groupBy(names["key"], names["crc"], "size").agg(F.count("*").alias("n")), "keys")
    total = counts.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0))).first()[0]
    buckets = max(-(-total // bucket_bytes), shards * BUCKETS_A_SHARD)
    rows = _numbered(rows, names, counts)
    rows = rows.withColumn(names["order"], F.xxhash64(names["key"], names["number"])).drop(names["key"], names["number"])
    rows = rows.withColumn(names["bucket"], F.pmod(F.col(names["order"]), F.lit(buckets)))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-buckets // BUCKETS_A_TASK), MAX_TASKS))
    kind = extended(rows, f"`{names['place']}` long")
    shuffled = rows.repartition(tasks, names["bucket"]).groupBy(names["bucket"]).applyInArrow(_shuffled(seed, names), kind)
    shuffled = cut_lineage(shuffled, "buckets")

    # ranks before each bucket, in two levels: within groups of 1024 buckets, and over the groups
    counts = shuffled.groupBy(F.col(names["bucket"]).alias("b")).agg(F.count("*").alias("n"))
    counts = cut_lineage(counts.withColumn("g", F.floor(F.col("b") / 1024)), "bucket-counts")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("inner", F.coalesce(F.sum("n").over(before(Window.partitionBy("g").orderBy("b"))), F.lit(0)))
    outer = counts.groupBy("g").agg(F.sum("n").alias("n")).select("g", F.coalesce(F.sum("n").over(before(Window.orderBy("g"))), F.lit(0)).alias("outer"))
    starts = inner.join(outer, "g").select("b", (F.col("inner") + F.col("outer")).alias("start"))
    starts = cut_lineage(starts, "bucket-starts")
    n = starts.count()
    ranked = shuffled.join(F.broadcast(starts) if may_broadcast(n, 32 * n) else starts, shuffled[names["bucket"]] == starts["b"])
    rank = F.col("start") + F.col(names["place"])
    kept = [c for c in docs.columns if c.lower() not in result]
    return ranked.select(
        *kept, "size", F.col(names["crc"]).alias("text_crc32"), F.lit(LAW).alias("law"), (rank % shards).cast("int").alias("shard"),
        F.floor(rank / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder `shard=<n>` for each shard, its files in the order of the slots."""
    dealt = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)
