import json

import pytest

from corpusloom.operators import vectors
from corpusloom.plans import ask, index_store, ingest, wiki_prepare
from corpusloom.operators.wiki import WikiOptions
from corpusloom.sources.eval_sets import read_evaluation_set

LINES = [{"id": "one", "text": "Beacon: the green lamp is on the north tower."}, {"id": "two", "content": "Bread needs flour."}, {"title": "T", "text": "Water is wet."}]


def test_corpus_path_to_answers(spark, tmp_path):
    source = tmp_path / "corpus.jsonl"
    source.write_text("\n".join(map(json.dumps, LINES)) + "\nbroken\n")
    store = ingest.CorpusStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="line 4"):
        ingest.run_path(store, str(source), "idx")
    row = ingest.run_path(store, str(source), "idx", continue_on_error=True).first()
    assert (row["records_completed"], row["source_format"]) == (3, "jsonl")
    assert [e["error_type"] for e in store.errors(row["run_id"]).collect()] == ["malformed_json"]

    assert (row["records_failed"], row["committed_batches"]) == (1, 1)
    index = store.index_dir("idx")
    questions = spark.createDataFrame([("a", "Where is the green lamp?"), ("b", "zzz")], "query_id string, text string")
    answers = {r["query_id"]: r for r in ask.answer(spark, index, questions, 1).collect()}
    assert "north tower" in answers["a"]["prompt"] and answers["b"]["no_context"]
    upper = {r["query_id"]: r["answer"] for r in ask.answer(spark, index, questions, 1, lambda: lambda ps: [p[-7:].upper() for p in ps]).collect()}
    assert upper == {"a": "ANSWER:", "b": "No relevant context found."}


def test_text_tree_path(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("alpha")
    (tmp_path / "in/sub/b.txt").write_text("beta")
    store = ingest.CorpusStore(spark, str(tmp_path / "store"))
    row = ingest.run_path(store, str(tmp_path / "in"), "idx", backend=index_store.SEMANTIC, identity=vectors.HASH_IDENTITY).first()
    assert (row["records_completed"], row["source_format"]) == (2, "text_directory")
    (tmp_path / "in/a.txt").write_text("changed")
    assert ingest.run_path(store, str(tmp_path / "in"), "other").first()["run_id"] != row["run_id"]


def test_evaluation_file(spark, tmp_path):
    path = tmp_path / "set.json"
    records = [{"id": f"w{i}", "text": t} for i, t in enumerate(["purify water", "drinking water", "bicycle chain", "gear repair"])]
    queries = [{"query": "drinkable water", "relevant_ids": ["w0", "w1"]}, {"query": "bicycle gear", "relevant_ids": ["w2", "w3"]}]
    path.write_text(json.dumps({"records": records, "queries": queries}, indent=1))
    found = ask.evaluate_embedder(spark, str(path)).first()
    assert (found["query_count"], found["documents_count"], found["top1_accuracy"], found["recall_at_3"], found["mean_reciprocal_rank"]) == (2, 4, 1.0, 1.0, 1.0)
    for bad in ({"records": records}, {"records": [{"id": "x"}], "queries": []}, []):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError, match="evaluation set"):
            read_evaluation_set(spark, str(path))


def test_prepared_wiki_articles_feed_the_corpus_reader(spark, tmp_path):
    dump = tmp_path / "dump.xml"
    body = "'''Salt''' is a [[mineral|common mineral]] used in food and found in the sea all over the world."
    dump.write_text(f"<mediawiki><page><title>Salt</title><ns>0</ns><id>5</id><revision><id>6</id><text>{body}</text></revision></page></mediawiki>")
    with pytest.raises(ValueError, match="sha256 mismatch"):
        wiki_prepare.prepare(spark, str(dump), str(tmp_path / "out"), WikiOptions(min_text_chars=10), sha256="00")
    wiki_prepare.prepare(spark, str(dump), str(tmp_path / "out"), WikiOptions(min_text_chars=10))
    from corpusloom.sources import jsonl

    docs, bad = jsonl.read_corpus_jsonl(spark, str(tmp_path / "out/articles"))
    [doc] = docs.collect()
    assert doc["document_id"] == "wiki:page:5" and doc["text"].startswith("Salt is a common mineral") and bad.count() == 0
    assert json.loads(doc["metadata"])["metadata"]["page_id"] == 5
