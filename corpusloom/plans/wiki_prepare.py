"""Prepare a wiki dump: scan, filter, clean, write articles, errors and one summary row.

The settings are written first, so that a run which died can only be resumed with the same ones. Batches
are ranges of places in the dump. It is scanned twice, whatever their number: page ends are counted, then
pages are parsed and written to a folder of their batch, which is all that the batch reads. Each writes its
articles and errors to folders of its own and then a commit with its counters. A resumed run goes on with the
batches that are not committed, its limit counts what is, and the summary adds up the commits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import wiki
from corpusloom.session import delete_path, matching_paths, path_exists, scratch_path
from corpusloom.sources import fingerprints, wiki_dump
from corpusloom.sources.text_files import table_bytes

ARTICLE_DDL = (
    "id STRING, title STRING, text STRING, source STRING, url STRING, metadata STRUCT<page_id: BIGINT, "
    "revision_id: BIGINT, revision_timestamp: STRING, revision_sha1: STRING, namespace: INT, redirect: BOOLEAN, "
    "redirect_target: STRING, dump_file: STRING, normalizer: STRING>"
)
PLACED_DDL = schemas.PAGE_DDL + ", error STRING, place BIGINT, batch INT"
BATCHED_BY = "place"
CONFIG_FIELDS = (
    "input_path", "output_path", "project", "base_url", "namespaces", "include_redirects", "min_text_chars", "normalizer",
)


def config_row(dump_path: str, output: str, options: wiki.WikiOptions) -> dict:
    return {
        "input_path": dump_path, "output_path": output, "project": options.project, "base_url": options.base_url,
        "namespaces": ",".join(map(str, sorted(options.namespaces))),
        "include_redirects": str(options.include_redirects).lower(),
        "min_text_chars": str(options.min_text_chars), "normalizer": options.normalizer_version,
    }


def config_mismatches(stored: dict, wanted: dict) -> list[str]:
    return [name for name in CONFIG_FIELDS if stored.get(name) != wanted.get(name)]


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """The committed articles below `<output>/articles`."""
    output = path.rstrip("/").removesuffix("/articles")
    done = [f"{path}/batch={n:08d}" for n in _committed(spark, output)]
    return spark.read.schema(ARTICLE_DDL).json(done) if done else spark.createDataFrame([], ARTICLE_DDL)


def read_errors(spark: SparkSession, output: str) -> DataFrame:
    """The error rows of all committed batches."""
    return spark.read.parquet(*[f"{output}/errors/batch={n:08d}" for n in _committed(spark, output)])


def _committed(spark: SparkSession, output: str) -> list[int]:
    found = matching_paths(spark, f"{output}/commits/batch=*/_SUCCESS")
    return sorted(int(name.rsplit("batch=", 1)[1].split("/")[0]) for name in found)


def plan(spark: SparkSession, dump_path: str, options: wiki.WikiOptions = wiki.WikiOptions()) -> DataFrame:
    """Dry run: one row with the settings and how many pages would be looked at; nothing is written."""
    settings = [F.lit(value).alias(name) for name, value in config_row(dump_path, "", options).items()]
    pages = wiki_dump.read_pages(spark, dump_path)
    return pages.agg(F.count("*").alias("pages_found"), F.count_if(F.col("error").isNotNull()).alias("pages_unusable")).select(
        "pages_found", "pages_unusable", F.lit("planned").alias("status"), *settings
    )


def prepare(
    spark: SparkSession, dump_path: str, output: str, options: wiki.WikiOptions = wiki.WikiOptions(),
    resume: bool = False, force: bool = False, sha256: str | None = None, sha1: str | None = None,
    batches: int = 1, source_url: str | None = None, dump_date: str | None = None, digest: bool = False,
) -> DataFrame:
    """Run the job and return its summary row. `output` holds `settings`, `articles`, `errors`, `commits` and `summary`.

    An expected checksum is compared before anything else is read. With `digest` the summary has the
    dump's SHA-256, which one task reads through. A limit takes pages in the order of the dump.
    """
    wanted = config_row(dump_path, output, options)
    if force:
        for part in ("settings", "pages", "articles", "errors", "commits", "summary"):
            delete_path(spark, f"{output}/{part}")
    started = path_exists(spark, f"{output}/settings/_SUCCESS")
    if started and not resume:
        if _committed(spark, output):
            raise ValueError(f"{output} already holds prepared articles (resume or force)")
        started = False  # a run that died before its first commit: nothing to keep
    described = _check_digest(spark, dump_path, sha256, sha1) if sha256 or sha1 or digest else None
    if started:
        stored = spark.read.parquet(f"{output}/settings").first().asDict()
        differing = config_mismatches(stored, wanted)
        if differing:
            raise ValueError("cannot resume, different " + ", ".join(differing))
        if stored.get("batched_by") != BATCHED_BY:
            raise ValueError("cannot resume, its batches are no ranges of places in the dump")
        edges = list(stored["edges"])
    else:
        edges = start(spark, dump_path, output, options, batches)

    done = _committed(spark, output)
    emitted = sum(row["records_emitted"] for row in _commits(spark, output, done).collect()) if done else 0  # one row a batch
    for number in range(len(edges) + 1):
        left = None if options.limit is None else options.limit - emitted
        if number in done:
            continue
        if left is not None and left <= 0:
            break
        emitted += prepare_batch(spark, batch_pages(spark, dump_path, output, options, edges, number), output, options, number, left)
    counted = _commits(spark, output, _committed(spark, output))
    totals = counted.agg(*[F.sum(name).alias(name) for name in counted.columns])
    status = F.when(F.col("page_errors") > 0, "failed").otherwise("completed")
    extra = {
        "source_url": source_url, "dump_date": dump_date, "dump_sha256": described["sha256"] if described else None,
        "dump_bytes": table_bytes(spark, dump_path), "batches": len(edges) + 1, "articles_path": f"{output}/articles",
    }
    summary = totals.select(
        "*", status.alias("status"), *[F.lit(value).alias(name) for name, value in wanted.items()],
        *[F.lit(value).cast("bigint" if name in ("dump_bytes", "batches") else "string").alias(name) for name, value in extra.items()],
        F.current_timestamp().alias("finished_at"),
    )
    summary.coalesce(1).write.mode("overwrite").parquet(f"{output}/summary")
    delete_path(spark, f"{output}/pages")
    return spark.read.parquet(f"{output}/summary")


def start(spark: SparkSession, dump_path: str, output: str, options: wiki.WikiOptions, batches: int = 1) -> list[int]:
    """Write the settings of a run and, if it has several batches, the pages of each. Returns the first places of the
    second and later ones."""
    edges, placed = [], None
    if batches > 1:
        placed, count = wiki_dump.placed_pages(spark, dump_path)
        edges = [count * n // batches for n in range(1, batches)]
    else:
        wiki_dump.require_wiki_root(spark, dump_path)
    named = [F.lit(value).alias(name) for name, value in config_row(dump_path, output, options).items()]
    listed = F.array(*[F.lit(x) for x in edges]).cast("array<bigint>").alias("edges")
    spark.range(1).select(*named, listed, F.lit(BATCHED_BY).alias("batched_by")).coalesce(1).write.mode("overwrite").parquet(f"{output}/settings")
    if placed is not None:
        _write_pages(placed, output, edges)
    return edges


def _write_pages(placed: DataFrame, output: str, edges: list[int]) -> None:
    number = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<bigint>"), lambda edge: edge <= F.col("place")))
    placed.withColumn("batch", number).write.mode("overwrite").partitionBy("batch").parquet(f"{output}/pages")


def batch_pages(spark: SparkSession, dump_path: str, output: str, options: wiki.WikiOptions, edges: list[int], number: int) -> DataFrame:
    """The pages of one batch; those of a run without batches come from the dump itself.

    What a run that died had not written to the end is written again.
    """
    if not edges:
        return wiki_dump.read_pages(spark, dump_path) if options.limit is None else wiki_dump.placed_pages(spark, dump_path)[0]
    if not path_exists(spark, f"{output}/pages/_SUCCESS"):
        _write_pages(wiki_dump.placed_pages(spark, dump_path)[0], output, edges)
    return spark.read.schema(PLACED_DDL).parquet(f"{output}/pages").filter(F.col("batch") == number).drop("batch")


def prepare_batch(spark: SparkSession, part: DataFrame, output: str, options: wiki.WikiOptions, number: int, limit: int | None = None) -> int:
    """Articles, errors and the commit of one batch of pages; returns how many articles it gave."""
    disposed, scratch = _stage(spark, part, options)
    if not options.continue_on_error:
        bad = wiki.page_errors(disposed, options.max_message_chars).first()
        if bad is not None:
            raise ValueError(bad["message"])
    if limit is not None:
        disposed = wiki.first_emitted(disposed, limit)
    folder = f"batch={number:08d}"
    wiki.article_records(disposed, options).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{output}/articles/{folder}")
    wiki.page_errors(disposed, options.max_message_chars).write.mode("overwrite").parquet(f"{output}/errors/{folder}")
    wiki.counters(disposed).write.mode("overwrite").parquet(f"{output}/commits/{folder}")
    delete_path(spark, scratch)
    return spark.read.parquet(f"{output}/commits/{folder}").first()["records_emitted"]


def _commits(spark: SparkSession, output: str, numbers: list[int]) -> DataFrame:
    return spark.read.parquet(*[f"{output}/commits/batch={n:08d}" for n in numbers])


def _check_digest(spark: SparkSession, path: str, sha256: str | None, sha1: str | None) -> dict:
    actual = fingerprints.stream_digest(spark, path).first()
    for name, wanted in (("sha256", sha256), ("sha1", sha1)):
        if wanted and actual[name] != wanted.lower():
            raise ValueError(f"{name} mismatch for {path}: expected {wanted.lower()}, got {actual[name]}")
    return actual.asDict()


def _stage(spark: SparkSession, pages: DataFrame, options: wiki.WikiOptions) -> tuple[DataFrame, str]:
    """The disposed pages, stored so that the clean-up runs once, and where."""
    path = scratch_path(spark, "wiki-pages")
    disposed = wiki.dispose(pages, options)
    disposed.write.partitionBy("disposition").parquet(path)
    return spark.read.schema(disposed.schema).parquet(path), path


def repair_output(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Whole article records of a torn JSONL file written by another tool, and a count row."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.withColumn("_row", F.from_json("value", ARTICLE_DDL))
    whole = F.try_parse_json("value").isNotNull() & F.col("_row.id").isNotNull()
    marked = parsed.withColumn("_whole", whole)
    counts = marked.agg(
        F.count_if("_whole").alias("whole_records"), F.count_if(~F.col("_whole")).alias("torn_records")
    )
    return marked.filter("_whole").select("_row.*"), counts
