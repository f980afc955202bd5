"""Wiki page table to article records: filters, clean-up, dispositions and counters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import wikitext as wt
from corpusloom.session import cut_lineage, ship_package

# The states a page can end in.
ERROR, NAMESPACE, REDIRECT, SHORT, EMITTED = "error", "namespace", "redirect", "short", "emitted"

RANGES = 1_000  # counted at a time when the limit's last page is looked for


@dataclass(frozen=True)
class WikiOptions:
    project: str = "wiki"
    base_url: str = "https://example.org/wiki/"
    dump_file: str = "dump.xml"
    namespaces: tuple[int, ...] = (0,)
    include_redirects: bool = False
    min_text_chars: int = 100
    limit: int | None = None
    continue_on_error: bool = False
    normalizer: Callable[..., DataFrame] | None = None  # as `wikitext.clean`; None: that one
    normalizer_version: str = wt.NORMALIZER_VERSION
    # no limits unless given: nesting and work of the clean-up, bytes of a revision, characters of a message
    max_depth: int | None = None
    max_steps: int | None = None
    max_revision_bytes: int | None = None
    max_message_chars: int | None = None

    def __post_init__(self) -> None:
        if self.min_text_chars < 0:
            raise ValueError("min_text_chars must not be negative")
        if self.limit is not None and self.limit <= 0:
            raise ValueError("limit must be greater than 0")


def _early_disposition(options: WikiOptions) -> Column:
    """What can be decided without cleaning the text; null for pages that need it."""
    redirected = F.lit(False) if options.include_redirects else F.col("redirect_target").isNotNull()
    return (
        F.when(F.col("error").isNotNull(), ERROR)
        .when(~F.col("namespace").isin(*options.namespaces), NAMESPACE)
        .when(redirected, REDIRECT)
    )


def dispose(pages: DataFrame, options: WikiOptions = WikiOptions()) -> DataFrame:
    """Every page with its `disposition`, clean `text` (where it was needed), count and warnings.

    Cheap rules come first, and the text of pages they decide is blanked before the Python stages.
    """
    if options.max_revision_bytes is not None:
        too_large = F.octet_length("revision_text") > options.max_revision_bytes
        pages = pages.withColumn("error", F.coalesce("error", F.when(too_large, "text_too_large")))
    marked = pages.withColumn("_early", _early_disposition(options))
    needs_text = F.col("_early").isNull() & F.col("redirect_target").isNull()
    marked = marked.withColumn("_raw", F.when(needs_text, F.col("revision_text"))).drop("revision_text")
    if options.normalizer is None:
        cleaned = wt.clean(marked, "_raw", max_depth=options.max_depth, max_steps=options.max_steps)
    else:
        cleaned = options.normalizer(marked, "_raw")
    target = F.when(F.col("_early").isNull() & F.col("redirect_target").isNotNull(), wt.redirect_text("redirect_target"))
    cleaned = cleaned.withColumn("text", F.coalesce(target, "text"))
    cleaned = cleaned.withColumn("visible_chars", tx.visible_chars("text"))
    final = F.coalesce(
        "_early", F.when(F.col("visible_chars") < options.min_text_chars, SHORT).otherwise(EMITTED)
    )
    return cleaned.withColumn("disposition", final).drop("_early", "_raw")


def article_records(disposed: DataFrame, options: WikiOptions = WikiOptions()) -> DataFrame:
    """Prepared articles of the emitted pages."""
    ship_package(disposed.sparkSession)
    emitted = disposed.filter(F.col("disposition") == EMITTED).withColumn("title", tx.nfc("title"))
    return emitted.select(
        F.concat(F.lit(f"{options.project}:page:"), F.col("page_id").cast("string")).alias("id"),
        "title",
        "text",
        F.lit(options.project).alias("source"),
        tx.article_url(options.base_url, "title").alias("url"),
        F.struct(
            "page_id", "revision_id", "revision_timestamp", "revision_sha1", "namespace",
            F.col("redirect_target").isNotNull().alias("redirect"), "redirect_target",
            F.lit(options.dump_file).alias("dump_file"), F.lit(options.normalizer_version).alias("normalizer"),
        ).alias("metadata"),
    )


def first_emitted(disposed: DataFrame, limit: int) -> DataFrame:
    """The pages up to the `limit`-th emitted one, by their place in the dump; by page id where they have none."""
    order = "place" if "place" in disposed.columns else "page_id"
    last = value_of_rank(cut_lineage(disposed.filter(F.col("disposition") == EMITTED).select(order), "emitted"), order, limit)
    return disposed if last is None else disposed.filter(F.col(order) <= last)


def value_of_rank(rows: DataFrame, column: str, rank: int) -> int | None:
    """The `rank`-th smallest of the whole numbers in `column`, None if there are fewer.

    Ever narrower ranges are counted, RANGES of them at a time, so nothing is sorted and only counts are collected.
    """
    low, high, found = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if found < rank:
        return None
    while low < high:
        step = (high - low) // RANGES + 1
        counts = rows.filter(F.col(column).between(low, high)).groupBy(F.expr(f"(`{column}` - {low}) div {step}").alias("at")).count()
        for at, n in sorted(counts.collect()):
            if n >= rank:
                low, high = low + at * step, min(high, low + (at + 1) * step - 1)
                break
            rank -= n
    return low


def counters(disposed: DataFrame) -> DataFrame:
    """One row of page counters, by one aggregation."""
    return disposed.agg(
        F.count("*").alias("pages_scanned"),
        *[
            F.count_if(F.col("disposition") == state).alias(name)
            for name, state in (
                ("records_emitted", EMITTED), ("redirects_skipped", REDIRECT),
                ("namespace_pages_skipped", NAMESPACE), ("short_pages_skipped", SHORT), ("page_errors", ERROR),
            )
        ],
    )


def page_errors(disposed: DataFrame, max_message_chars: int | None = None) -> DataFrame:
    """Error rows without any body text."""
    message = F.concat(F.lit("page "), F.coalesce("title", F.lit("?")), F.lit(": "), "error")
    if max_message_chars is not None:
        message = F.substring(message, 1, max_message_chars)
    return disposed.filter(F.col("disposition") == ERROR).select(
        "page_id", "title", F.col("error").alias("error_type"),
        message.alias("message"),
    )
