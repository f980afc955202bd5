"""MediaWiki XML dumps (plain, gzip or bzip2) as a page table. Splittable input is read in splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import text as tx
from corpusloom.sources.lines import lines_of, place_lines

_DUMP_DDL = (
    "title ARRAY<STRING>, ns ARRAY<STRING>, id ARRAY<STRING>, redirect ARRAY<STRUCT<_title: STRING>>, "
    "revision ARRAY<STRUCT<id: STRING, timestamp: STRING, sha1: STRING, text: STRING>>"
)


def read_dump(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Raw `<page>` elements; `malformed` marks those that do not parse, a torn last one among them.

    `prefix` is that of the dump's name space, with its colon; elements are read by their local names.

    The dump is cut into page elements as text and each is parsed by itself, so a broken page costs
    no other. Surrounding blanks are kept: they are part of an article's text.
    """
    return _elements(_pieces(spark, path, prefix), prefix)


def _pieces(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The dump, cut behind each page end."""
    return spark.read.option("lineSep", f"</{prefix}page>").text(path)


def _elements(pieces: DataFrame, prefix: str) -> DataFrame:
    """The parsed page elements of pieces, with the `place` of their piece if it has one."""
    end, start = f"</{prefix}page>", rf"<{prefix}page[\s>]"
    place = [c for c in ("place",) if c in pieces.columns]
    element = pieces.select(*place, F.explode(F.split("value", f"(?={start})")).alias("page")).filter(F.regexp_like("page", F.lit(rf"\A{start}")))
    torn = F.regexp_like("page", F.lit(rf"(?s)</{prefix}mediawiki\s*>\s*\z"))  # behind the last page end: it has none of its own
    options = {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_corrupt"}
    closed = F.when(torn, F.col("page")).otherwise(F.concat("page", F.lit(end)))
    if prefix:
        closed = F.regexp_replace(closed, rf"(</?){prefix}", "$1")
    parsed = element.select(*place, F.from_xml(closed, _DUMP_DDL + ", _corrupt STRING", options).alias("x"))
    return parsed.select(*place, "x.title", "x.ns", "x.id", "x.redirect", "x.revision", F.col("x._corrupt").isNotNull().alias("malformed"))


def require_wiki_root(spark: SparkSession, path: str) -> str:
    """The name space prefix of the `<mediawiki>` root, mostly none; XML without this root is refused.

    Reading stops at the first match.
    """
    root = F.regexp_extract("value", r"<((?:[A-Za-z_][\w.-]*:)?)mediawiki[\s>]", 1)
    found = spark.read.text(path).filter(F.regexp_like("value", F.lit(r"<([A-Za-z_][\w.-]*:)?mediawiki[\s>]"))).select(root).first()
    if found is None:
        raise ValueError(f"{path} is not a MediaWiki XML dump (no <mediawiki> root element)")
    return found[0]


def _number(text: Column, kind: str) -> Column:
    return tx.strip(text).try_cast(kind)


def pages(raw: DataFrame) -> DataFrame:
    """First title, id, namespace and redirect of a page, and its last revision; `error` says what
    makes a page unusable."""
    title = F.get("title", F.lit(0))
    page_id = _number(F.get("id", F.lit(0)), "bigint")
    last = F.try_element_at("revision", F.lit(-1))
    text = F.coalesce(last["text"], F.lit(""))
    has_revision = F.coalesce(F.size("revision"), F.lit(0)) > 0
    malformed = F.col("malformed") if "malformed" in raw.columns else F.lit(False)
    error = (
        F.when(malformed, "malformed_page")
        .when(title.isNull() | (tx.strip(title) == ""), "missing_title")
        .when(page_id.isNull(), "missing_id")
        .when(~has_revision, "missing_revision")
    )
    return raw.select(
        title.alias("title"),
        F.coalesce(_number(F.get("ns", F.lit(0)), "int"), F.lit(0)).alias("namespace"),
        page_id.alias("page_id"),
        F.get("redirect", F.lit(0))["_title"].alias("redirect_target"),
        _number(last["id"], "bigint").alias("revision_id"),
        last["timestamp"].alias("revision_timestamp"),
        last["sha1"].alias("revision_sha1"),
        text.alias("revision_text"),
        error.alias("error"),
        *[c for c in ("place",) if c in raw.columns],
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return pages(read_dump(spark, path, require_wiki_root(spark, path)))


def placed_pages(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """`read_pages` with their `place` in the dump, and how many places there are; files follow in the order of their paths.

    A place is a page end. What is torn before it shares the place of the next whole page.
    """
    prefix = require_wiki_root(spark, path)
    pieces, count = place_lines(lines_of(_pieces(spark, path, prefix)))
    return pages(_elements(pieces, prefix)), count


PAGE_COLUMNS = [field.split(" ")[0] for field in schemas.PAGE_DDL.split(", ")]
