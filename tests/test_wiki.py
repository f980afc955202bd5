import re
import bz2
import gzip
import hashlib
import html
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from corpusloom.functions import wikitext as wt
from corpusloom.operators import wiki
from corpusloom.plans import wiki_prepare
from corpusloom.sources import wiki_dump

LONG = "Water boils at one hundred degrees and freezes at zero; people have known this for a long time."
CASES = {
    "See [[Target|the label]].": "See the label.",
    "See [[Plain]].": "See Plain.",
    "[[a|b|c]]": "c",
    "[[File:x.png|thumb|hi]]x[[ category : c]]": "x",
    "[https://e.org a label] [http://e.org]!": "a label !",
    "a {{t|{{u}}}} b": "a  b",
    "a {{never closed": "a",
    "x{| t\n|-\n|}y": "xy",
    "x<ref>r</ref>y<ref name=a/>z": "xyz",
    "a<ref name=x/>lost<ref>r</ref>b": "ab",
    "== Title ==\ntext": "Title\ntext",
    "===\nx": "x",
    "'''b''' ''i'' it's": "b i it's",
    "Tom &amp; &eacute;": "Tom & é",
    "a  \n\n\n\nb\t\n": "a\n\nb",
    "<!-- c\n -->x__TOC__<gallery>\nA\n</gallery><math>y</math><math/>": "x",
    "fr:Article\nkeep\n see:this\n": "keep",
    "a\r\nb\rc": "a\nb\nc",
}


def test_clean_cases(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "i int, raw string")
    found = [r["text"] for r in wt.clean(rows, "raw").orderBy("i").collect()]
    assert found == list(CASES.values())


MORE_CASES = {
    "[[:Category:Shown]]": ":Category:Shown",
    "[[]] x": "[[]] x",
    "[[CATEGORÍA:Cosas]]a[[image:p.png]]": "a",
    "[https://e.org]x[https://e.org   two  words ]": "xtwo  words",
    "see https://e.org now": "see https://e.org now",
    "{{a{{b}}c}}d{{e}}": "d",
    "}}a{{b}}": "}}a",
    "{|a{|b|}c|}d|}": "d|}",
    "{{x|{|y|}}}z": "}z",
    "<REF name=q>a</Ref >b": "b",
    "<math display=block>x</math>y<math />z": "yz",
    "<gallery mode=packed>\nA.png|[[l]]\n</gallery>t": "t",
    "__NOTOC____TOC__a__b__": "a__b__",
    "de:Artikel\nen: kept\nabcd:kept\n": "en: kept\nabcd:kept",
    "==a==\n=== b ===\n= c\nd": "a\nb\n= c\nd",
    "'''''a''''' 'b' x": "a 'b' x",
    "&lt;b&gt; &#233; &bogus; &amp;amp;": "<b> é &bogus; &amp;",
    " \xa0 a\t\n \n\n\n b \xa0": "a\n\n b",
    "plain\ntext": "plain\ntext",
    "": "",
}


def test_more_clean_cases(spark):
    rows = spark.createDataFrame(list(enumerate(MORE_CASES)), "i int, raw string").repartition(3)
    found = {r["i"]: r for r in wt.clean(rows, "raw").collect()}
    for i, (raw, want) in enumerate(MORE_CASES.items()):
        assert (found[i]["text"], found[i]["visible_chars"]) == (want, len("".join(want.split()))), raw


def balanced(text, opener, closer):
    """What stands outside all regions, by a count of open ones, character by character."""
    out, open_, i = [], 0, 0
    while i < len(text):
        two = text[i : i + 2]
        if two == opener:
            open_, i = open_ + 1, i + 2
        elif two == closer and open_:
            open_, i = open_ - 1, i + 2
        else:
            out += [text[i]] if not open_ else []
            i += 1
    return "".join(out)


def test_balanced_removal_on_random_texts():
    rng = random.Random(11)
    for _ in range(4000):
        text = "".join(rng.choice(["{{", "}}", "a", "é", "\n", "| ", "x}"]) for _ in range(rng.randrange(30)))
        assert wt.drop_nested(text, "{{", "}}")[0] == balanced(text, "{{", "}}"), text


def test_limits_only_where_given():
    deep, many = "{{" * 4000 + "}}" * 4000 + "x", "{{}}" * 300_000
    assert wt.drop_nested(deep, "{{", "}}") == ("x", []) and wt.drop_nested(many + "y", "{{", "}}") == ("y", [])
    notes = wt.drop_nested("{{" * 40 + "}}" * 40 + "x", "{{", "}}", max_depth=32)
    assert notes == ("}}" * 39 + "x", [wt.TOO_DEEP.format(limit=32)])
    assert wt.drop_nested(many, "{{", "}}", max_steps=512_000) == ("", [wt.TOO_LONG_INSIDE.format(opener="{{")])
    assert wt.drop_nested("a{{b", "{{", "}}") == ("a", [wt.UNCLOSED.format(opener="{{")])
    assert wt.drop_nested("a{{b}}c}}", "{{", "}}") == ("ac}}", []) and wt.drop_nested("a{{", "{{", "}}") == ("a", [])


def page(title, ns, number, body, redirect="", revision=True):
    inner = f"<revision><id>1</id><text>old</text></revision><revision><id>{number}9</id><timestamp>T</timestamp><sha1>s</sha1><text xml:space=\"preserve\">{html.escape(body)}</text></revision>"
    return f"<page><title>{title}</title><ns>{ns}</ns><id>{number}</id>{redirect}{inner if revision else ''}</page>"


DUMP = '<?xml version="1.0"?>\n<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">\n<siteinfo><sitename>t</sitename></siteinfo>\n' + "\n".join([
    page("Water", 0, 1001, f"  == Intro ==\n{LONG} {{{{box|{{{{x}}}}}}}}[[Boil|boiling]]<ref>r</ref>\n"),
    page("Talk:Water", 1, 1002, LONG), page("Stub", 0, 1003, "tiny"),
    page("H2O", 0, 1004, "#REDIRECT [[Water]]", '<redirect title="Water" />'), page("User:Me", 2, 1005, LONG),
]) + "\n</mediawiki>\n"
OPTIONS = wiki.WikiOptions(project="testwiki", min_text_chars=50)


@pytest.fixture(params=["xml", "xml.gz", "xml.bz2"])
def dump(request, tmp_path):
    path = tmp_path / f"dump.{request.param}"
    pack = {"xml": bytes, "xml.gz": gzip.compress, "xml.bz2": bz2.compress}[request.param]
    path.write_bytes(pack(DUMP.encode()))
    return str(path)


def counts(row):
    return tuple(row[c] for c in ("pages_scanned", "records_emitted", "redirects_skipped", "namespace_pages_skipped", "short_pages_skipped", "page_errors"))


def test_dump_to_articles(spark, dump, tmp_path):
    summary = wiki_prepare.prepare(spark, dump, str(tmp_path / "out"), OPTIONS).first()
    assert counts(summary) == (5, 1, 1, 2, 1, 0) and summary["status"] == "completed"
    [article] = wiki_prepare.read_articles(spark, str(tmp_path / "out/articles")).collect()
    assert article["id"] == "testwiki:page:1001" and article["text"] == f"Intro\n{LONG} boiling"
    assert article["metadata"]["revision_id"] == 10019 and article["metadata"]["redirect"] is False


def test_namespace_redirect_and_limit(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text(DUMP)
    pages = wiki_dump.read_pages(spark, str(path))
    talk = wiki.dispose(pages, wiki.WikiOptions(namespaces=(1,), min_text_chars=10))
    assert wiki.counters(talk).first()["records_emitted"] == 1
    redirects = wiki.WikiOptions(include_redirects=True, min_text_chars=10)
    both = wiki.dispose(pages, redirects)
    assert {r["text"] for r in wiki.article_records(both, redirects).collect()} >= {"Redirect to Water"}
    assert counts(wiki.counters(wiki.first_emitted(both, 1)).first())[:2] == (1, 1)


def test_page_errors_and_resume(spark, tmp_path):
    path, out = tmp_path / "d.xml", str(tmp_path / "out")
    bad = page("No revision", 0, 7, "", revision=False) + page("", 0, 8, LONG) + page("No id", 0, "x", LONG)
    path.write_text(DUMP.replace("</mediawiki>", bad + "</mediawiki>"))
    with pytest.raises(ValueError, match="missing"):
        wiki_prepare.prepare(spark, str(path), out, OPTIONS)
    lenient = wiki.WikiOptions(project="testwiki", min_text_chars=50, continue_on_error=True)
    summary = wiki_prepare.prepare(spark, str(path), out, lenient).first()
    assert counts(summary) == (8, 1, 1, 2, 1, 3) and summary["status"] == "failed"
    errors = {r["error_type"] for r in wiki_prepare.read_errors(spark, out).collect()}
    assert errors == {"missing_revision", "missing_title", "missing_id"}
    with pytest.raises(ValueError, match="resume or force"):
        wiki_prepare.prepare(spark, str(path), out, lenient)
    with pytest.raises(ValueError, match="min_text_chars"):
        wiki_prepare.prepare(spark, str(path), out, wiki.WikiOptions(project="testwiki", min_text_chars=5), resume=True)
    again = wiki_prepare.prepare(spark, str(path), out, lenient, resume=True).first()
    assert counts(again) == counts(summary) and wiki_prepare.read_errors(spark, out).count() == 3
    assert wiki_prepare.read_articles(spark, f"{out}/articles").count() == 1


def test_a_run_that_died_keeps_its_settings_and_counters(spark, tmp_path):
    path, whole, out = tmp_path / "d.xml", str(tmp_path / "whole"), str(tmp_path / "out")
    pages = [page(f"P{k}", 0, k, LONG) for k in range(12, 0, -1)]  # a limit goes by the dump, not by ids
    pages.insert(4, page("", 0, 5, LONG))
    path.write_text("<mediawiki>\n" + "\n".join(pages) + "\n</mediawiki>")
    options = wiki.WikiOptions(project="testwiki", min_text_chars=50, continue_on_error=True, limit=9)
    once = wiki_prepare.prepare(spark, str(path), whole, options).first()
    wiki_prepare.prepare(spark, str(path), out, options, batches=3)
    for part in ("commits/batch=00000001", "commits/batch=00000002", "summary"):  # as if it had died in its second batch
        wiki_prepare.delete_path(spark, f"{out}/{part}")
    with pytest.raises(ValueError, match="different project"):
        wiki_prepare.prepare(spark, str(path), out, wiki.WikiOptions(project="other", min_text_chars=50), resume=True)
    resumed = wiki_prepare.prepare(spark, str(path), out, options, resume=True, source_url="https://e.org/d.xml", digest=True).first()
    assert counts(resumed) == counts(once) == (10, 9, 0, 0, 0, 1)
    ids = lambda o: sorted(r["id"] for r in wiki_prepare.read_articles(spark, f"{o}/articles").collect())
    assert ids(out) == ids(whole) == sorted(f"testwiki:page:{k}" for k in range(4, 13))
    assert (resumed["source_url"], resumed["dump_bytes"], resumed["batches"]) == ("https://e.org/d.xml", path.stat().st_size, 3)
    assert resumed["dump_sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
    planned = wiki_prepare.plan(spark, str(path), options).first()
    assert (planned["pages_found"], planned["pages_unusable"], planned["status"]) == (13, 1, "planned")


def test_a_broken_page_costs_no_other(spark, tmp_path):
    path = tmp_path / "d.xml"
    pages = [page(f"P{k}", 0, k, LONG) for k in range(1, 8)]
    pages[1] = pages[1].replace("</text>", "", 1)
    pages[4] = pages[4].replace("</page>", "")
    path.write_text("<mediawiki>\n" + "\n".join(pages) + "\n<page><title>torn</title><revision><text>x")
    rows = wiki_dump.read_pages(spark, str(path)).collect()
    assert sorted(r["page_id"] for r in rows if r["error"] is None) == [1, 3, 4, 5, 6, 7]
    assert [r["error"] for r in rows if r["error"]] == ["malformed_page"] * 2


def test_other_normalizer_and_revision_limit(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text(DUMP)

    def shout(pages, raw):
        rows = pages.withColumn("text", F.upper(raw)).withColumn("visible_chars", F.length("text"))
        return rows.withColumn("warnings", F.array().cast("array<string>"))

    own = {"project": "testwiki", "min_text_chars": 50, "normalizer": shout, "normalizer_version": "shout-1"}
    options = wiki.WikiOptions(**own, max_revision_bytes=105)
    disposed = wiki.dispose(wiki_dump.read_pages(spark, str(path)), options)
    assert {r["page_id"]: r["error"] for r in disposed.collect() if r["error"]} == {1001: "text_too_large"}
    options = wiki.WikiOptions(**own)
    [article] = wiki.article_records(wiki.dispose(wiki_dump.read_pages(spark, str(path)), options), options).collect()
    assert "WATER BOILS" in article["text"] and article["metadata"]["normalizer"] == "shout-1"


def test_other_root_is_refused(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text("<rss><page><title>x</title></page></rss>")
    with pytest.raises(ValueError, match="not a MediaWiki"):
        wiki_dump.read_pages(spark, str(path))


def test_repair(spark, tmp_path):
    path = tmp_path / "torn.jsonl"
    path.write_text('{"id":"w:page:1","text":"a"}\n\n{"id":"w:page:2","text":"b"}\n{"id":"w:page:3","te')
    whole, numbers = wiki_prepare.repair_output(spark, str(path))
    assert [r["id"] for r in whole.orderBy("id").collect()] == ["w:page:1", "w:page:2"]
    assert numbers.first().asDict() == {"whole_records": 2, "torn_records": 1}


def test_a_registered_query_resumes_a_whole_dump(spark):
    from checks import base, wiki_queries  # noqa: F401

    sf_dir = "/root/testdata/sf0.001"
    row = base.QUERIES["wiki_resume_whole_totals"](spark, sf_dir).first().asDict()
    whole = base.QUERIES["wiki_counters"](spark, sf_dir).first().asDict()
    assert row["batches"] == 3 and {k: row[k] for k in whole} == whole and row["error_rows"] == row["page_errors"]


def test_a_dump_with_a_name_space_prefix(spark, tmp_path):
    plain, prefixed = tmp_path / "plain.xml", tmp_path / "prefixed.xml"
    plain.write_text(DUMP)
    marked = re.sub(r"<(/?)(?=[a-z])", r"<\1mw:", DUMP).replace("xmlns=", "xmlns:mw=")
    prefixed.write_text(marked)
    rows = [sorted(map(repr, wiki_dump.read_pages(spark, str(p)).collect())) for p in (plain, prefixed)]
    assert rows[0] == rows[1] and rows[0]


def test_the_value_of_a_rank(spark):
    numbers = [(k * k * 977 % 10**9 - 500,) for k in range(3000)] + [(7,)] * 50
    rows = spark.createDataFrame(numbers, "v long")
    for rank in (1, 2, 49, 1500, 3050):
        assert wiki.value_of_rank(rows, "v", rank) == sorted(x for x, in numbers)[rank - 1]
    assert wiki.value_of_rank(rows, "v", 3051) is None and wiki.value_of_rank(rows.limit(0), "v", 1) is None


def test_a_batch_reads_its_own_part_of_the_dump(spark, tmp_path):
    """Batches are cut by place over all files and splits; their pages are written once, and again if that was interrupted."""
    folder, out = tmp_path / "dump", str(tmp_path / "out")
    folder.mkdir()
    for name, ids in (("a", range(40, 60)), ("b", range(0, 30)), ("c", [])):
        (folder / f"{name}.xml").write_text("<mediawiki>\n" + "\n".join(page(f"P{k}", 0, k, LONG) for k in ids) + "\n</mediawiki>\n")
    options = wiki.WikiOptions(project="testwiki", min_text_chars=50)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        edges = wiki_prepare.start(spark, str(folder), out, options, batches=4)
        order = [*range(40, 60), *range(0, 30)]
        batches = [[r["page_id"] for r in wiki_prepare.batch_pages(spark, str(folder), out, options, edges, n).orderBy("place").collect()] for n in range(4)]
        assert sum(batches, []) == order and all(batches)
        wiki_prepare.delete_path(spark, f"{out}/pages/_SUCCESS")
        (tmp_path / "out/pages/batch=2/part-torn.parquet").write_bytes(b"torn")
        limited = wiki.WikiOptions(project="testwiki", min_text_chars=50, limit=33)
        wiki_prepare.prepare(spark, str(folder), out, limited, resume=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = {r["id"] for r in wiki_prepare.read_articles(spark, f"{out}/articles").collect()}
    assert found == {f"testwiki:page:{k}" for k in order[:33]} and not (tmp_path / "out/pages").exists()


def test_clean_up_bounds_the_bytes_of_a_python_batch(spark):
    @F.pandas_udf("int")
    def rows_of_batch(text: pd.Series) -> pd.Series:
        return pd.Series(len(text), index=text.index)

    pages = spark.range(0, 24, 1, 1).select("id", F.repeat(F.lit("a word "), 100_000).alias("raw"))
    cleaned = wt.clean(pages, "raw", text="clean")
    assert cleaned.count() == 24
    assert pages.select(rows_of_batch("raw").alias("n")).agg(F.max("n")).first()[0] < 12  # 0.7 MB each
