"""Wiki page queries over pages derived from `documents`: every text becomes a page with markup."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from checks.base import query, scratch, table
from corpusloom.functions import text as tx
from corpusloom.functions import wikitext as wt
from corpusloom.operators import wiki
from corpusloom.plans import wiki_prepare
from corpusloom.sources import wiki_dump

_HEAD = (
    "{{Infobox|name={{nested|1}}|x=1}}\n<!-- note -->'''Lead''' of [[Article|the article]] and [[Plain link]]."
    "[[File:Pic.png|thumb|caption]][[Categoría:Cosas]]<ref name=\"a\">cited {{cite}}</ref><ref name=\"b\"/>"
    " See [https://example.org/a label text] or [http://example.org].\n\n\n\n== Heading ==\n"
)
_TAIL = (
    "\n{| class=\"t\"\n|-\n| cell {{t}}\n|}\n<gallery>\nA.png\n</gallery><math>x^2</math>__NOTOC__\n"
    "fr:Article\nTom &amp; Jerry &lt;3 &eacute;  \n"
)
_OPTIONS = wiki.WikiOptions(project="testwiki", base_url="https://example.org/wiki", dump_file="dump.xml", min_text_chars=40)

_SQL_PAGES = """pages_in AS (
  SELECT doc_id AS page_id, CASE WHEN lang = 'es' AND source = 'src5' THEN '  '
                                 ELSE 'Cafe' || chr(769) || ' ' || source || '/' || doc_id || ' (a&b)' END AS title,
         CASE lang WHEN 'de' THEN 1 ELSE 0 END AS namespace,
         CASE WHEN source = 'src7' THEN 'Target ' || doc_id END AS redirect_target,
         source = 'src3' AS is_short, lang = 'fr' AND source = 'src9' AS no_revision, text
  FROM documents),
disposed AS (
  SELECT *, CASE WHEN trim(title) = '' THEN 'missing_title' WHEN no_revision THEN 'missing_revision' END AS error,
         CASE WHEN is_short THEN 'Short stub.' ELSE
           'Lead of the article and Plain link. See label text or .' || chr(10) || chr(10) || 'Heading' || chr(10) || text ||
           chr(10) || chr(10) || 'Tom & Jerry <3 é' END AS clean
  FROM pages_in),
states AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN namespace <> 0 THEN 'namespace' WHEN redirect_target IS NOT NULL THEN 'redirect'
                 WHEN length(regexp_replace(clean, '\\s', '', 'g')) < 40 THEN 'short' ELSE 'emitted' END AS disposition
  FROM disposed)"""


def _raw_pages(spark, sf_dir):
    """Raw page elements, as a dump scan gives them."""
    rows = table(spark, sf_dir, "documents")
    title = F.when((F.col("lang") == "es") & (F.col("source") == "src5"), "  ").otherwise(
        F.concat(F.lit("Café "), "source", F.lit("/"), "doc_id", F.lit(" (a&b)"))
    )
    body = F.when(F.col("source") == "src3", "Short stub.").otherwise(F.concat(F.lit(_HEAD), "text", F.lit(_TAIL)))
    number = F.col("doc_id").cast("string")

    def revision(identifier, text):
        return F.struct(
            identifier.alias("id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.sha1(text).alias("sha1"), text.alias("text")
        )

    revisions = F.array(revision(F.lit("1"), F.lit("an older text")), revision((F.col("doc_id") + 5000).cast("string"), body))
    no_revision = (F.col("lang") == "fr") & (F.col("source") == "src9")
    redirect = F.when(F.col("source") == "src7", F.array(F.struct(F.concat(F.lit("Target "), "doc_id").alias("_title"))))
    return rows.select(
        F.array(title).alias("title"), F.array(F.when(F.col("lang") == "de", "1").otherwise("0")).alias("ns"),
        F.array(number).alias("id"), redirect.alias("redirect"), F.when(~no_revision, revisions).alias("revision"),
    )


def _pages(spark, sf_dir):
    return wiki_dump.pages(_raw_pages(spark, sf_dir))


def _dump(spark, sf_dir, by_id: bool = False) -> str:
    """The pages as an XML dump, in the order of their ids if a limit has to go by it."""
    path = scratch(spark, "dump")
    raw = _raw_pages(spark, sf_dir)
    if by_id:
        raw = raw.orderBy(F.col("id")[0].cast("long"))
    flat = raw.select(F.col("title")[0].alias("title"), F.col("ns")[0].alias("ns"), F.col("id")[0].alias("id"), F.get("redirect", F.lit(0)).alias("redirect"), "revision")
    flat.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return path


@query("wiki_scan", f"""WITH {_SQL_PAGES}
SELECT page_id, CAST(namespace AS INTEGER) AS namespace, redirect_target, error,
       CASE WHEN no_revision THEN NULL ELSE page_id + 5000 END AS revision_id,
       CASE WHEN no_revision THEN 0 WHEN is_short THEN 11 ELSE length(text) + {len(_HEAD) + len(_TAIL)} END AS text_chars FROM states""")
def wiki_scan(spark, sf_dir):
    rows = wiki_dump.read_pages(spark, _dump(spark, sf_dir))
    return rows.select(
        "page_id", "namespace", "redirect_target", "error", "revision_id", F.length("revision_text").cast("long").alias("text_chars")
    )


def _broken_dump(spark, sf_dir) -> str:
    """A dump in which every seventh page has an unclosed inner tag, every eleventh no end, and one behind each is torn."""
    path = scratch(spark, "broken")
    rows = table(spark, sf_dir, "documents").select("doc_id")
    number = F.col("doc_id").cast("string")
    inner = F.concat(
        F.lit("<page><title>P"), number, F.lit("</title><ns>0</ns><id>"), number, F.lit("</id><revision><id>1</id>"),
        F.when(F.col("doc_id") % 7 == 3, "<text>lost").otherwise("<text>kept</text>"), F.lit("</revision>"),
    )
    page = F.concat(inner, F.when(F.col("doc_id") % 11 == 5, "").otherwise("</page>"))
    pages = rows.select(F.concat(F.lit("<mediawiki>\n"), page, F.lit("\n<page><title>torn</title><id>")).alias("value"))
    pages.write.text(path)
    return path


@query("wiki_malformed", """
SELECT doc_id AS page_id, NULL AS error, 1 AS pages FROM documents WHERE doc_id % 7 <> 3
UNION ALL SELECT NULL, 'malformed_page', count(*) + count(*) FILTER (doc_id % 7 = 3) FROM documents""")
def wiki_malformed(spark, sf_dir):
    """Broken pages among good ones: each is counted once, and none takes another with it."""
    rows = wiki_dump.read_pages(spark, _broken_dump(spark, sf_dir))
    number = F.when(F.col("error").isNull(), F.col("page_id"))
    return rows.groupBy(number.alias("page_id"), "error").agg(F.count("*").alias("pages"))


@query("wiki_invalid_pages", f"WITH {_SQL_PAGES} SELECT page_id, error AS error_type FROM states WHERE error IS NOT NULL")
def wiki_invalid_pages(spark, sf_dir):
    return _pages(spark, sf_dir).filter(F.col("error").isNotNull()).select("page_id", F.col("error").alias("error_type"))


@query("wiki_namespace", f"WITH {_SQL_PAGES} SELECT page_id FROM states WHERE namespace IN (1)")
def wiki_namespace(spark, sf_dir):
    return _pages(spark, sf_dir).filter(F.col("namespace").isin(1)).select("page_id")


@query("wiki_redirects", f"""WITH {_SQL_PAGES}
SELECT page_id, 'Redirect to ' || redirect_target AS text,
       length(regexp_replace('Redirect to ' || redirect_target, '\\s', '', 'g')) AS visible_chars
FROM states WHERE error IS NULL AND namespace = 0 AND redirect_target IS NOT NULL""")
def wiki_redirects(spark, sf_dir):
    options = wiki.WikiOptions(include_redirects=True, min_text_chars=10)
    disposed = wiki.dispose(_pages(spark, sf_dir), options)
    emitted = disposed.filter((F.col("disposition") == wiki.EMITTED) & F.col("redirect_target").isNotNull())
    return emitted.select("page_id", "text", F.col("visible_chars").cast("long").alias("visible_chars"))


@query("wiki_min_chars", f"""WITH {_SQL_PAGES}
SELECT page_id, length(regexp_replace(clean, '\\s', '', 'g')) AS visible_chars FROM states
WHERE disposition IN ('short', 'emitted')""")
def wiki_min_chars(spark, sf_dir):
    disposed = wiki.dispose(_pages(spark, sf_dir), _OPTIONS)
    kept = disposed.filter(F.col("disposition").isin(wiki.SHORT, wiki.EMITTED))
    return kept.select("page_id", F.col("visible_chars").cast("long").alias("visible_chars"))


@query("wiki_limit", f"WITH {_SQL_PAGES} SELECT page_id, disposition FROM states WHERE page_id <= (SELECT max(page_id) FROM (SELECT page_id FROM states WHERE disposition = 'emitted' ORDER BY page_id LIMIT 25))")
def wiki_limit(spark, sf_dir):
    return wiki.first_emitted(wiki.dispose(_pages(spark, sf_dir), _OPTIONS), 25).select("page_id", "disposition")


@query("wiki_disposition", f"WITH {_SQL_PAGES} SELECT page_id, disposition FROM states")
def wiki_disposition(spark, sf_dir):
    return wiki.dispose(_pages(spark, sf_dir), _OPTIONS).select("page_id", "disposition")


_SQL_URL = """'https://example.org/wiki/' || replace(replace(replace(replace(replace(url_encode(replace(nfc_normalize(title), ' ', '_')), '%2F', '/'), '%28', '('), '%29', ')'), '%26', '&'), '%3A', ':')"""


@query("wiki_records", f"""WITH {_SQL_PAGES}
SELECT 'testwiki:page:' || page_id AS id, nfc_normalize(title) AS title, sha256(clean) AS text_digest, 'testwiki' AS source,
       {_SQL_URL} AS url, page_id, page_id + 5000 AS revision_id, redirect_target IS NOT NULL AS redirect, 'dump.xml' AS dump_file
FROM states WHERE disposition = 'emitted'""")
def wiki_records(spark, sf_dir):
    records = wiki.article_records(wiki.dispose(_pages(spark, sf_dir), _OPTIONS), _OPTIONS)
    return records.select(
        "id", "title", tx.sha256_hex("text").alias("text_digest"), "source", "url", "metadata.page_id", "metadata.revision_id",
        "metadata.redirect", "metadata.dump_file",
    )


@query("wiki_url", f"WITH {_SQL_PAGES} SELECT page_id, {_SQL_URL} AS url FROM states")
def wiki_url(spark, sf_dir):
    rows = _pages(spark, sf_dir)
    return rows.withColumn("title", tx.nfc("title")).select("page_id", tx.article_url("https://example.org/wiki/", "title").alias("url"))


@query("wiki_clean", f"""WITH {_SQL_PAGES}
SELECT page_id, clean AS text, length(regexp_replace(clean, '\\s', '', 'g')) AS visible_chars FROM states WHERE NOT no_revision""")
def wiki_clean(spark, sf_dir):
    rows = _pages(spark, sf_dir).filter(F.col("error").isNull() | (F.col("error") != "missing_revision"))
    cleaned = wt.clean(rows.select("page_id", "revision_text"), "revision_text")
    return cleaned.select("page_id", "text", F.col("visible_chars").cast("long").alias("visible_chars"))


@query("wiki_warnings", """
SELECT doc_id AS page_id, CASE lang WHEN 'de' THEN 'Unclosed ''{{'' block' WHEN 'fr' THEN 'Template nesting depth exceeded (32)' END AS warning,
       sha256(CASE lang WHEN 'de' THEN text WHEN 'fr' THEN text || chr(10) || repeat('}}', 39) || ' end' ELSE text END) AS text_digest
FROM documents""")
def wiki_warnings(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    deep = F.concat(F.lit("\n" + "{{a" * 40), F.lit("}}" * 40 + " end"))
    raw = F.concat("text", F.when(F.col("lang") == "de", "\n{{open").when(F.col("lang") == "fr", deep).otherwise(""))
    cleaned = wt.clean(rows.select(F.col("doc_id").alias("page_id"), raw.alias("raw")), "raw", max_depth=32, max_steps=512_000)
    return cleaned.select("page_id", F.get("warnings", F.lit(0)).alias("warning"), tx.sha256_hex("text").alias("text_digest"))


_SQL_COUNTERS = f"""WITH {_SQL_PAGES}
SELECT count(*) AS pages_scanned, count(*) FILTER (disposition = 'emitted') AS records_emitted,
       count(*) FILTER (disposition = 'redirect') AS redirects_skipped, count(*) FILTER (disposition = 'namespace') AS namespace_pages_skipped,
       count(*) FILTER (disposition = 'short') AS short_pages_skipped, count(*) FILTER (disposition = 'error') AS page_errors"""


@query("wiki_counters", f"{_SQL_COUNTERS} FROM states")
def wiki_counters(spark, sf_dir):
    return wiki.counters(wiki.dispose(_pages(spark, sf_dir), _OPTIONS))


def _options():
    return wiki.WikiOptions(
        project="testwiki", base_url="https://example.org/wiki", dump_file="dump.xml", min_text_chars=40, continue_on_error=True
    )


@query("wiki_prepare", f"{_SQL_COUNTERS}, 'failed' AS status FROM states")
def wiki_prepare_job(spark, sf_dir):
    summary = wiki_prepare.prepare(spark, _dump(spark, sf_dir), scratch(spark, "prepared"), _options())
    return summary.select(
        "pages_scanned", "records_emitted", "redirects_skipped", "namespace_pages_skipped", "short_pages_skipped", "page_errors", "status"
    )


@query("wiki_write", f"""WITH {_SQL_PAGES}
SELECT 'testwiki:page:' || page_id AS id, page_id, sha256(clean) AS text_digest FROM states WHERE disposition = 'emitted'""")
def wiki_write(spark, sf_dir):
    output = scratch(spark, "prepared")
    wiki_prepare.prepare(spark, _dump(spark, sf_dir), output, _options())
    articles = wiki_prepare.read_articles(spark, f"{output}/articles")
    return articles.select("id", "metadata.page_id", tx.sha256_hex("text").alias("text_digest"))


_SQL_LIMITED = f"""WITH {_SQL_PAGES},
ordered AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS place, count(*) OVER () AS n FROM states WHERE disposition = 'emitted'),
last AS (SELECT max(page_id) AS page_id FROM ordered WHERE place <= 3 * n // 5),
taken AS (SELECT s.* FROM states s, last WHERE s.page_id <= last.page_id)"""


def _resumed(spark, sf_dir, limited: bool = True) -> str:
    """A run over three batches that died behind its first one, in the middle of the second, then resumed. Its limit, if it
    has one, is three fifths of all articles, which lies behind the first batch at any size."""
    output, dump = scratch(spark, "prepared"), _dump(spark, sf_dir, by_id=limited)
    limit = None
    if limited:
        limit = 3 * wiki.dispose(wiki_dump.read_pages(spark, dump), _options()).filter(F.col("disposition") == "emitted").count() // 5
    options = dataclasses.replace(_options(), limit=limit)
    edges = wiki_prepare.start(spark, dump, output, options, batches=3)
    pages = wiki_prepare.batch_pages(spark, dump, output, options, edges, 0)
    wiki_prepare.prepare_batch(spark, pages, output, options, 0, limit)
    wiki_prepare.read_articles(spark, f"{output}/articles").write.json(f"{output}/articles/batch=00000001")  # torn
    wiki_prepare.prepare(spark, dump, output, options, resume=True)
    return output


@query("wiki_resume", _SQL_LIMITED + " SELECT page_id, sha256(clean) AS text_digest FROM taken WHERE disposition = 'emitted'")
def wiki_resume(spark, sf_dir):
    articles = wiki_prepare.read_articles(spark, f"{_resumed(spark, sf_dir)}/articles")
    return articles.select("metadata.page_id", tx.sha256_hex("text").alias("text_digest"))


@query("wiki_resume_totals", _SQL_LIMITED + """ SELECT count(*) AS pages_scanned, count(*) FILTER (disposition = 'emitted') AS records_emitted,
  count(*) FILTER (disposition = 'error') AS page_errors, count(*) FILTER (disposition = 'error') AS error_rows FROM taken""")
def wiki_resume_totals(spark, sf_dir):
    """The summary of the resumed run, and its error rows, as of one that was never interrupted."""
    output = _resumed(spark, sf_dir)
    errors = wiki_prepare.read_errors(spark, output).count()
    summary = spark.read.parquet(f"{output}/summary").select("pages_scanned", "records_emitted", "page_errors")
    return summary.withColumn("error_rows", F.lit(errors).cast("bigint"))


@query("wiki_resume_whole", f"""WITH {_SQL_PAGES}
SELECT page_id, sha256(clean) AS text_digest FROM states WHERE disposition = 'emitted'""")
def wiki_resume_whole(spark, sf_dir):
    """All pages of a dump, by a run that was interrupted and has no limit."""
    articles = wiki_prepare.read_articles(spark, f"{_resumed(spark, sf_dir, limited=False)}/articles")
    return articles.select("metadata.page_id", tx.sha256_hex("text").alias("text_digest"))


@query("wiki_resume_whole_totals", f"{_SQL_COUNTERS}, count(*) FILTER (disposition = 'error') AS error_rows, 3 AS batches FROM states")
def wiki_resume_whole_totals(spark, sf_dir):
    """The summary of that run, its error rows and its committed batches."""
    output = _resumed(spark, sf_dir, limited=False)
    counted = [F.lit(wiki_prepare.read_errors(spark, output).count()).cast("bigint").alias("error_rows")]
    summary = spark.read.parquet(f"{output}/summary")
    names = ["pages_scanned", "records_emitted", "redirects_skipped", "namespace_pages_skipped", "short_pages_skipped", "page_errors"]
    return summary.select(*names, *counted, F.lit(len(wiki_prepare._committed(spark, output))).alias("batches"))


@query("partial_repair", """
SELECT count(*) FILTER (lang <> 'de') AS whole_records, count(*) FILTER (lang = 'de') AS torn_records FROM documents""")
def partial_repair(spark, sf_dir):
    """Article lines of which the German ones are cut short."""
    path = scratch(spark, "torn")
    rows = table(spark, sf_dir, "documents")
    line = F.to_json(F.struct(F.concat(F.lit("w:page:"), "doc_id").alias("id"), "text", "source"))
    torn = F.when(F.col("lang") == "de", F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    rows.select(torn.alias("value")).write.text(path)
    return wiki_prepare.repair_output(spark, path)[1]
