import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import catalog as cat
from corpusloom.operators import delta, vectors
from corpusloom.plans import index_store, ingest
from corpusloom.plans.workspace import Workspace, inline_sources
from corpusloom.session import cut_lineage
from corpusloom.streaming import ingest_stream

DDL = "document_id string, title string, text string, source string, position long"


def make_docs(spark, rows):
    rows = [(i, f"title {i}", text, "src", at) for at, (i, text) in enumerate(rows)]
    return spark.createDataFrame(rows, DDL).select(
        "document_id", "title", "text", "source", tx.sha256_hex("text").alias("content_digest"), "position",
        F.lit(None).cast("string").alias("metadata"),
    )


DOCS = [("one", "first text about water"), ("two", "second text " * 200), ("three", "third")]


@pytest.fixture
def store(spark, tmp_path):
    return ingest.CorpusStore(spark, str(tmp_path / "corpus"))


def config(**options):
    return ingest.IngestConfig("idx", source="/s", source_fingerprint="fp", **options)


def test_classify_duplicates_conflicts_and_hot_ids(spark):
    rows = [("a", "x")] * 50 + [("a", "y"), ("b", "z"), ("c", "same"), ("d", "new text")]
    ledger = spark.createDataFrame([("c", hashlib.sha256(b"same").hexdigest(), ""), ("d", "old digest", "")], "document_id string, content_digest string, completed_at string")
    verdicts = delta.classify(make_docs(spark, rows), ledger)
    found = {(r["document_id"], r["verdict"]): (r["position"], r["copies"]) for r in verdicts.collect()}
    assert found == {("a", "new"): (0, 50), ("a", "changed"): (50, 1), ("b", "new"): (51, 1), ("c", "unchanged"): (52, 1), ("d", "changed"): (53, 1)}
    assert delta.ingest_counts(verdicts).first().asDict() == {"records_seen": 54, "records_new": 2, "records_skipped": 50, "records_failed": 2}
    assert sorted(r["position"] for r in delta.new_documents(make_docs(spark, rows), verdicts).collect()) == [0, 51]


def test_run_is_idempotent_and_resumable(spark, store):
    docs = make_docs(spark, DOCS + [("blank", "  ")])
    first = ingest.run(store, docs, config()).first()
    assert (first["records_completed"], first["records_seen"], first["chunks_written"]) == (3, 4, 5)
    before = sorted(map(tuple, store.chunks("idx").select("id", "sha256").collect()))
    assert ingest.run(store, docs, config()).first()["updated_at"] == first["updated_at"]
    assert sorted(map(tuple, store.chunks("idx").select("id", "sha256").collect())) == before
    assert ingest.status(store).first()["progress_percent"] == 75.0
    assert store.terms("idx").count() == 5


def test_interrupted_run_needs_resume_with_same_settings(spark, store):
    settings = config(continue_on_error=True)
    run_id = settings.run_id()
    half = make_docs(spark, DOCS[:1])
    ingest.ingest_batch(store, half, settings, run_id, "before")
    row = ingest._run_row(spark, settings, run_id, "running", ingest._no_counts(spark), 0, 3)
    store.put(row, f"runs/state={run_id}-0000-running")
    docs = make_docs(spark, DOCS)
    with pytest.raises(ValueError, match="resume or force"):
        ingest.run(store, docs, settings)
    done = ingest.run(store, docs, settings, resume=True).first()
    assert (done["records_completed"], done["records_skipped"], done["committed_batches"]) == (3, 1, 2)
    assert store.chunks("idx").count() == 5 and store.ledger(run_id).count() == 3
    with pytest.raises(ValueError, match="no run"):
        ingest.run(store, docs, config(chunk_size=500), resume=True)


def test_a_batch_lost_before_its_ledger_is_done_over(spark, store):
    settings, docs = config(), make_docs(spark, DOCS)
    run_id = settings.run_id()
    torn = spark.createDataFrame([("one:000000:x", "t", "src", 0, "left over", "x")], "id string, title string, source string, chunk_index int, text string, sha256 string")
    index_store.put_batch(torn, store.index_dir("idx"), "chunks", 0)
    store.put(ingest._run_row(spark, settings, run_id, "running", ingest._no_counts(spark), 0, 3), f"runs/state={run_id}-0000-running")
    ingest.run(store, docs, settings, resume=True)
    ids = {r["id"] for r in store.chunks("idx").collect()}
    assert len(ids) == 5 and ids == {r["id"] for r in store.terms("idx").collect()}


def test_a_repeated_batch_overwrites_itself(spark, store):
    settings, docs = config(), make_docs(spark, DOCS)
    for _ in range(2):
        ingest.ingest_batch(store, docs, settings, "r", "7")
        assert store.chunks("idx").count() == 5 and store.ledger("r").count() == 3


def test_changed_document_is_an_error_or_an_error_row(spark, store):
    ingest.ingest_batch(store, make_docs(spark, DOCS), config(), "r", "0")
    edited = make_docs(spark, [("one", "edited"), ("four", "fourth")])
    with pytest.raises(ValueError, match="one changed"):
        ingest.ingest_batch(store, edited, config(), "r", "1")
    counts = ingest.ingest_batch(store, edited, config(continue_on_error=True), "r", "1").first()
    assert (counts["records_completed"], counts["records_failed"]) == (1, 1)
    [error] = store.errors("r").filter("document_id = 'one'").collect()
    assert "edited" not in error["message"]


def test_force_rebuild_only_drops_this_index(spark, store):
    docs = make_docs(spark, DOCS)
    ingest.run(store, docs, config())
    ingest.run(store, docs, ingest.IngestConfig("other", source="/s", source_fingerprint="fp"))
    ingest.run(store, make_docs(spark, DOCS[:1]), config(), force=True)
    assert (store.chunks("idx").count(), store.chunks("other").count()) == (1, 5)


def test_semantic_ingest(spark, store):
    settings = config(backend=index_store.SEMANTIC, identity=vectors.HASH_IDENTITY)
    done = ingest.run(store, make_docs(spark, DOCS), settings).first()
    assert (done["records_embedded"], done["schema_version"], done["embedding_fingerprint"]) == (5, 2, vectors.HASH_IDENTITY.fingerprint())
    assert store.vectors("idx").filter(F.size("embedding") == 8).count() == 5


def test_run_id_and_resume_mismatch():
    payload = {"source_fingerprint": "fp", "source_path": "/s", "index_slug": "idx", "chunk_size": 1000, "chunk_overlap": 200, "backend": "simple"}
    expected = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    assert config().run_id() == expected != config(chunk_size=900).run_id()
    assert cat.resume_mismatch(config().settings(), config(chunk_size=900).settings()) == "chunk_size"
    for bad in ({"batch_size": 0}, {"backend": "x"}, {"chunk_overlap": 1000}):
        with pytest.raises(ValueError):
            config(**bad)


def test_plan_writes_nothing(spark, store, tmp_path):
    row = ingest.plan(make_docs(spark, DOCS), config()).first()
    assert (row["estimated_records"], row["status"]) == (3, "planned") and not (tmp_path / "corpus").exists()


def test_partitioning_does_not_change_the_index(spark, tmp_path):
    docs = make_docs(spark, [(f"d{i % 40}", f"text {i % 40} " * (i % 40 + 1)) for i in range(120)])
    found = []
    for n in (1, 7):
        store = ingest.CorpusStore(spark, str(tmp_path / f"c{n}"))
        ingest.run(store, docs.repartition(n, "text"), config(chunk_size=50, chunk_overlap=10))
        found.append(sorted(map(tuple, store.chunks("idx").select("id", "text").collect())))
    assert found[0] == found[1] and len(found[0]) > 40


def test_stream_equals_batch_and_survives_a_replay(spark, store, tmp_path):
    settings = config(continue_on_error=True)
    incoming = str(tmp_path / "in")
    make_docs(spark, DOCS).repartition(3).write.parquet(incoming)
    state = str(tmp_path / "state")

    def drain():
        ingest_stream.start(store, ingest_stream.document_stream(spark, incoming, 1), settings, state).awaitTermination()

    drain()
    assert ingest_stream.batch_counts(store, settings.run_id()).first()["records_completed"] == 3
    make_docs(spark, DOCS[:1] + [("four", "late text"), ("two", "other")]).coalesce(1).write.mode("append").parquet(incoming)
    drain()
    assert store.ledger(settings.run_id()).count() == 4 and store.chunks("idx").count() == 6
    ingest_stream.start(store, ingest_stream.document_stream(spark, incoming, 1), settings, str(tmp_path / "fresh")).awaitTermination()
    assert store.chunks("idx").count() == 6  # a lost stream state re-reads everything and adds nothing


def test_stream_of_json_lines(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    for name, rows in (("a", [{"id": "one", "text": "x"}, {"id": "two", "content": "y"}]), ("b", [{"id": "three", "text": "z"}])):
        (tmp_path / f"in/{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    settings = config(continue_on_error=True)
    lines = ingest_stream.line_stream(spark, str(tmp_path / "in"), 1)
    ingest_stream.start(store, lines, settings, str(tmp_path / "state")).awaitTermination()
    assert {r["document_id"] for r in store.ledger(settings.run_id()).collect()} == {"one", "two", "three"}
    assert sorted(e["message"] for e in store.errors(settings.run_id()).collect()) == ["malformed_json on line 2", "malformed_json on line 3"]


def test_stream_leaves_a_run_and_a_catalog_entry(spark, store, tmp_path):
    settings = config(continue_on_error=True)
    incoming = str(tmp_path / "in")
    make_docs(spark, DOCS).repartition(3).write.parquet(incoming)
    space = Workspace(spark, store.root)
    ingest_stream.start(store, ingest_stream.document_stream(spark, incoming, 1), settings, str(tmp_path / "s")).awaitTermination()
    row = store.runs().first()
    assert (row["status"], row["records_completed"], row["chunks_written"], row["committed_batches"]) == ("running", 3, 5, 3)
    entry = space.entry("idx")
    assert (entry["chunk_count"], entry["corpus_run_id"]) == (5, settings.run_id())
    # died behind the commit: run row and entry are lost, the micro-batches come again from a lost state
    from corpusloom.session import delete_path

    delete_path(spark, f"{store.root}/runs")
    space.replace_catalog(space.catalog().limit(0))
    done = ingest_stream.drain(store, ingest_stream.document_stream(spark, incoming, 1), settings, str(tmp_path / "t")).first()
    assert (done["status"], done["records_seen"], done["committed_batches"]) == ("completed", 3, 3)
    assert space.entry("idx")["chunk_count"] == 5 and store.chunks("idx").count() == 5


def test_a_rebuild_that_dies_leaves_the_old_index(spark, store, monkeypatch):
    docs = make_docs(spark, DOCS)
    settings = config(batch_size=1)
    ingest.run(store, docs.limit(1), settings)
    before = sorted(map(tuple, store.chunks("idx").collect()))
    real, calls = ingest.ingest_batch, []

    def dying(*args, **options):
        if len(calls) == 2:
            raise InterruptedError
        calls.append(real(*args, **options))

    for _ in range(2):  # a second forced run starts anew
        calls.clear()
        monkeypatch.setattr(ingest, "ingest_batch", dying)
        with pytest.raises(InterruptedError):
            ingest.run(store, docs, settings, force=True)
        monkeypatch.setattr(ingest, "ingest_batch", real)
        assert sorted(map(tuple, store.chunks("idx").collect())) == before
    with pytest.raises(ValueError, match="resume or force"):
        ingest.run(store, docs, settings)
    row = ingest.run(store, docs, settings, resume=True).first()
    assert (row["records_completed"], row["committed_batches"], store.chunks("idx").count()) == (3, 3, 5)
    assert store.ledger(settings.run_id()).count() == 3


def test_batches_committed_together_are_as_one_by_one(spark, tmp_path, monkeypatch):
    long = "word " * 500
    rows = [
        ("a", "first"), ("b", " "), ("c", long), ("a", "first"), ("b", "late"), ("b", "later"), ("d", " "), ("d", "x"), ("a", "other"),
        ("c", long), ("e/f", "same"), ("e f", "same"), ("b", "late"), ("g", "z"), ("g", "zz"), ("h", "z"), (None, "no id"), ("d", "x"),
    ]
    docs = make_docs(spark, rows)
    settings = config(batch_size=2, continue_on_error=True)
    run_id = settings.run_id()
    one, many = (ingest.CorpusStore(spark, str(tmp_path / name)) for name in ("one", "many"))
    for number in range(9):
        part = docs.filter(F.floor(F.col("position") / 2) == number)
        ingest.ingest_batch(one, part, settings, run_id, f"{number:08d}")
    real, calls = ingest.ingest_batch, []
    monkeypatch.setattr(ingest, "ingest_batch", lambda *a, **o: calls.append(a[4]) or real(*a, **o))
    assert ingest.run(many, docs, settings).first()["committed_batches"] == 9
    assert calls == [range(0, 1), range(1, 2), range(2, 4), range(4, 8), range(8, 9)]

    def state(store):
        tables = store.committed("idx", run_id), store.chunks("idx"), store.terms("idx"), store.errors(run_id), store.ledger(run_id).drop("completed_at")
        return [sorted(map(str, t.collect())) for t in tables]

    assert state(many) == state(one)
    strict = config(batch_size=2)
    stopped = ingest.CorpusStore(spark, str(tmp_path / "stopped"))
    with pytest.raises(ValueError, match="document d changed|document b changed"):
        ingest.run(stopped, docs.filter("position not in (4, 5)"), strict)
    assert stopped.committed("idx", run_id).count() == 3  # those before the batch with the conflict
    assert ingest._groups([2, 3, 5, 6, 7], 2) == [range(2, 4), range(5, 8)] and ingest._groups([], 3) == []


def test_generations_are_published_whole(spark, tmp_path):
    from corpusloom.operators import chunking
    from corpusloom.session import matching_paths, path_exists, put_once

    chunks = chunking.chunk_documents(make_docs(spark, DOCS)).drop("document_id")
    path = str(tmp_path / "lex")
    index_store.build_lexical(chunks.limit(1), path)
    first = index_store.home(spark, path)
    unseen = index_store.new_generation(spark, path)
    index_store.put_lexical(chunks, unseen, 0)  # a build that dies before its end
    assert index_store.home(spark, path) == first and index_store.index_table(spark, path, "chunks").count() == 1
    (tmp_path / "lex/current/version-00000009").write_bytes(b"\x00")  # a pointer that was not written to its end
    assert index_store.home(spark, path) == first
    index_store.build_lexical(chunks, path, force=True)
    second = index_store.home(spark, path)
    assert second != first and index_store.index_table(spark, path, "chunks").count() == 5
    assert path_exists(spark, first) and not path_exists(spark, unseen)  # what readers may have open stays
    index_store.build_lexical(chunks.limit(2), path, force=True)
    assert not path_exists(spark, first) and len(matching_paths(spark, f"{path}/gen-*")) == 2
    assert index_store.append_lexical(chunks, path).first()["chunk_count"] == 5
    with pytest.raises(Exception, match="exist"):
        put_once(spark, f"{path}/current/version-00000010", "x")


def test_key_table(spark, tmp_path):
    from corpusloom.plans.key_table import FANIN, KeyTable
    from corpusloom.session import delete_path

    keys = KeyTable(spark, str(tmp_path), "keys", "id STRING, n INT", buckets=4)
    made = {}
    for batch in range(FANIN * 2 + 3):
        rows = [(f"k{batch}-{i}", batch) for i in range(3 if batch != 5 else 0)]
        made[batch] = rows
        keys.put(spark.createDataFrame(rows, "id string, n int"), batch)
        keys.compact(list(range(batch + 1)))
    done = list(range(FANIN * 2 + 3))
    assert keys.live(done) == [(0, 7), (8, 15), (16, 16), (17, 17), (18, 18)]
    assert keys.live(done[:-1])[-1] == (17, 17) and keys.live([0, 1, 2]) is None  # runs merged beyond it
    every = sorted(row for rows in made.values() for row in rows)
    assert sorted(map(tuple, keys.all(done).collect())) == every
    asked = spark.createDataFrame([("k3-1",), ("none",)], "id string")
    found = keys.lookup(asked, done)
    assert ("k3-1", 3) in set(map(tuple, found.collect())) and found.count() < len(every)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:80]
    keys.put(spark.createDataFrame([("torn", 0)], "id string, n int"), 19)
    assert "torn" not in {r["id"] for r in keys.all(done).collect()}
    keys.put(spark.createDataFrame([("again", 0)], "id string, n int"), 19)  # the next attempt leaves nothing of it
    assert {r["id"] for r in keys.all([*done, 19]).collect()} - {k for k, _ in every} == {"again"}
    delete_path(spark, keys._run(17, 17))
    assert keys.live(done) is None and keys.lookup(asked, done) is None
    assert keys.lookup(asked, []).count() == 0


def test_run_table(spark):
    rows = [("r1", "2024-01-01", 1, 4), ("r2", "2024-01-02", 2, 0), ("r3", "2024-01-02", 1, 3)]
    runs = spark.createDataFrame(rows, "run_id string, updated_at string, records_completed long, estimated_records long")
    assert cat.latest_run(runs).first()["run_id"] == "r3"
    assert {r["run_id"]: r["progress_percent"] for r in cat.with_progress(runs).collect()} == {"r1": 25.0, "r2": None, "r3": 33.33}


def test_index_append_and_search(spark, tmp_path):
    from corpusloom.operators import chunking

    docs = make_docs(spark, DOCS)
    chunks = chunking.chunk_documents(docs).drop("document_id")
    path = str(tmp_path / "lex")
    index_store.build_lexical(chunks.filter("title = 'title one'"), path, source="x")
    with pytest.raises(FileExistsError):
        index_store.build_lexical(chunks, path)
    assert index_store.append_lexical(chunks.union(chunks), path).first()["chunk_count"] == 5
    queries = spark.createDataFrame([("q", "water text")], "query_id string, text string")
    best = index_store.search_index(spark, path, queries, 1).first()
    assert best["source"] == "src" and best["score_semantics"] == "lexical_term_frequency"
    assert index_store.index_table(spark, path, "postings").count() == sum(len(r["tokens"]) for r in index_store.index_table(spark, path, "terms").collect())

    path = str(tmp_path / "sem")
    index_store.append_vectors(chunks.filter("title = 'title one'"), path)
    assert index_store.append_vectors(chunks, path).first()["chunk_count"] == 5
    found = index_store.search_index(spark, path, spark.createDataFrame([("q", "water")], "query_id string, text string"), 1).first()
    assert found["title"] == "title one" and found["score_semantics"] == "cosine_similarity"
    clash = chunks.withColumn("sha256", F.lit("other"))
    with pytest.raises(ValueError, match="different content"):
        index_store.append_vectors(clash, path)
    with pytest.raises(ValueError, match="model_name mismatch"):
        index_store.append_vectors(chunks, path, vectors.EmbeddingIdentity("mock", "m", 8, True))


def test_workspace_round_trip(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "ws"))
    pastes = spark.createDataFrame([(" A ", " some text "), ("B", " "), (" ", "x")], "title string, text string")
    assert [tuple(r) for r in inline_sources(pastes).collect()] == [("A", "some text", "web:A")]
    made = space.ingest_text("My Index", pastes).first()
    assert (made["slug"], made["chunk_count"], made["source_count"]) == ("my-index", 1, 1)
    with pytest.raises(ValueError, match="already exists"):
        space.ingest_text("my  index", pastes)
    again = space.ingest_text("My Index", pastes, force=True).first()
    assert again["created_at"] == made["created_at"] and again["updated_at"] > made["updated_at"]
    space.ingest_text("Second", pastes, backend=index_store.SEMANTIC)
    with pytest.raises(ValueError):
        space.ingest_text("../x", pastes)
    out = str(tmp_path / "export")
    assert {r["slug"] for r in space.export(out).collect()} == {"my-index", "second"}
    with pytest.raises(FileExistsError):
        space.export(out, slug="second")
    with pytest.raises(KeyError):
        space.export(str(tmp_path / "x"), slug="nope")

    other = Workspace(spark, str(tmp_path / "other"))
    other.import_(out)
    with pytest.raises(ValueError, match="use force"):
        other.import_(out)
    assert other.import_(out, force=True).count() == 2
    entry = other.entry("my-index")
    assert entry["chunks_path"].startswith(other.root) and entry["corpus_run_id"] is None
    assert other.missing_indexes() == []
    queries = spark.createDataFrame([("q", "text")], "query_id string, text string")
    assert index_store.search_index(spark, other.index_dir("my-index"), queries).count() == 1
    assert other.delete("second") is True and other.catalog().count() == 1
    with pytest.raises(KeyError):
        other.delete("second")


@pytest.mark.parametrize("limit", [1_000_000, 3, 0])
def test_key_limits_do_not_change_results(spark, tmp_path, monkeypatch, limit):
    """Broadcast keys, broadcast exceptions and plain shuffles give the same rows."""
    from corpusloom import session
    from corpusloom.operators import chunking
    from corpusloom.sources import jsonl

    monkeypatch.setattr(session, "MAX_BROADCAST_KEYS", limit)
    rows = [(f"d{i}", f"text {i}") for i in range(10)] + [("d0", "text 0"), ("d1", "other"), ("d_2", "text 2"), ("d:2", "text 2")]
    docs = make_docs(spark, rows)
    ledger = spark.createDataFrame([("d9", hashlib.sha256(b"text 9").hexdigest(), "")], "document_id string, content_digest string, completed_at string")
    verdicts = delta.classify(docs, ledger)
    fresh = delta.new_documents(docs, verdicts)
    assert sorted(r["position"] for r in fresh.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 13]
    chunks = chunking.chunk_documents(fresh)
    unique = chunking.distinct_chunks(chunks)
    assert unique.count() == 10 and unique.select("id").distinct().count() == 10  # d_2 and d:2 share a chunk id
    existing = chunks.filter("document_id in ('d3', 'd4')").select("id", "sha256")
    assert delta.unseen_chunks(chunks, existing).count() == 8
    compared = delta.compare_chunks(chunks, existing)
    assert delta.chunks_to_add(chunks, compared).count() == 8
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(json.dumps({"text": t}) if i % 3 else "" for i, (_, t) in enumerate(rows)))
    found, _ = jsonl.read_corpus_jsonl(spark, str(path))
    assert [(r["position"], r["title"]) for r in found.orderBy("position").collect()] == [
        (at, f"line-{i + 1}") for at, i in enumerate(i for i in range(len(rows)) if i % 3)
    ]


def test_source_paths_of_a_workspace_stay_inside(spark, tmp_path):
    inside, outside = tmp_path / "in", tmp_path / "out"
    for folder in (inside / "part.one", outside):
        folder.mkdir(parents=True)
        (folder / "a.txt").write_text("a lamp by the river")
    (inside / "b.txt").write_text("a boat")
    (inside / "c.pdf").write_text("no text")
    (inside / "noending").write_text("no text")
    (inside / "link").symlink_to(outside)
    (inside / "link.txt").symlink_to(outside / "a.txt")
    space = Workspace(spark, str(tmp_path / "ws"), sources=str(inside))
    bad = ("", "../out", str(outside), "part.one/../../out/a.txt", "link", "link.txt", "link/a.txt", "c.pdf", "noending", "none.txt", "s3a://other/a.txt")
    for path in bad:
        with pytest.raises(ValueError):
            space.ingest_path("Refused", path)
    assert space.catalog().isEmpty()
    for name, path, count in (("Folder", "part.one", 1), ("File", "b.txt", 1), ("Whole", str(inside / "part.one" / "a.txt"), 1)):
        assert space.ingest_path(name, path).first()["chunk_count"] == count
    with pytest.raises(ValueError, match="already exists"):
        space.ingest_path("file", "b.txt")
    with pytest.raises(ValueError, match="source folder"):
        Workspace(spark, str(tmp_path / "ws")).ingest_path("x", "b.txt")


def test_paths_with_a_scheme_are_contained_too():
    from corpusloom.sources.text_files import check_source_path

    assert check_source_path("s3a://bucket/in", "x/y.txt") == check_source_path("s3a://bucket/in", "s3a://bucket/in/x/y.txt") == "s3a://bucket/in/x/y.txt"
    assert check_source_path("/", "x.txt") == "/x.txt"
    for path in ("../x.txt", "s3a://bucket/inner/x.txt", "file:///bucket/in/x.txt", "/etc/x.txt"):
        with pytest.raises(ValueError):
            check_source_path("s3a://bucket/in", path)


def test_the_first_vector_layout_gives_distances(spark, tmp_path):
    path = str(tmp_path / "old")
    rows = [(f"c{n}", f"T{n}", "s", 0, text, hashlib.sha256(text.encode()).hexdigest()) for n, text in enumerate(("river water", "a bicycle chain", "stars"))]
    chunks = spark.createDataFrame(rows, "id string, title string, source string, chunk_index int, text string, sha256 string")
    made = index_store.build_distances(chunks, path).first()
    assert (made["schema_version"], made["chunk_count"], made["embedding_fingerprint"]) == (1, 3, None)
    asked = spark.createDataFrame([("q", "river water"), ("blank", "")], "query_id string, text string")
    found = index_store.search_index(spark, path, asked, 3).orderBy("rank").collect()
    assert [r["query_id"] for r in found] == ["q"] * 3 and found[0]["id"] == "c0" and found[0]["score"] == 0
    assert [r["score"] for r in found] == sorted(r["score"] for r in found) and found[0]["score_semantics"] == "distance_lower_is_better"
    with pytest.raises(ValueError, match="mismatch"):
        index_store.append_vectors(chunks, path)
    with pytest.raises(FileExistsError):
        index_store.build_distances(chunks, path)
    assert index_store.build_distances(chunks.limit(2), path, force=True).first()["chunk_count"] == 2


def test_stored_tables_are_compressed_well(spark, tmp_path):
    rows = spark.createDataFrame([("a:0", "t", "s", 0, "lamp river", "d")], "id string, title string, source string, chunk_index int, text string, sha256 string")
    index_store.build_lexical(cut_lineage(rows, "rows"), str(tmp_path / "index"))
    written = [p.name for p in (tmp_path / "index").rglob("part-*.parquet") if "commits" not in str(p)]
    assert len(written) >= 4 and all(name.endswith(".zstd.parquet") for name in written)
