import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as vx
from corpusloom.operators import blocked, evaluate, lexical
from corpusloom.operators import vectors as vec

WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "x1", "zeta"]


def texts(n, seed, longest=25):
    rng = random.Random(seed)
    weights = [1, 1, 2, 1, 12, 8, 1, 1]  # "the" is in nearly every text
    return [" ".join(rng.choices(WORDS, weights, k=rng.randrange(longest))) for _ in range(n)]


def brute_lexical(chunks, query, k):
    asked = re.findall("[a-z0-9]+", query.lower())
    scored = []
    for key, text in chunks.items():
        counts = Counter(re.findall("[a-z0-9]+", text.lower()))
        score = sum(1 + 0.1 * counts[t] for t in asked if counts[t])
        if score > 0:
            scored.append((-round(score, 9), key))
    return [(key, -score) for score, key in sorted(scored)[:k]]


@pytest.mark.parametrize("layout", [{}, {"max_broadcast_queries": 0, "cell_items": 40, "cell_queries": 7}])
def test_lexical_search_matches_brute_force(spark, layout):
    chunks = {f"c{i:03d}": t for i, t in enumerate(texts(200, 1))}
    asked = {f"q{i}": t for i, t in enumerate(texts(30, 2) + ["unknown words", "", "?!", "beta beta beta"])}
    terms = lexical.term_table(spark.createDataFrame(list(chunks.items()), "id string, text string"))
    queries = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    ranked, _ = lexical.search(terms, queries, 7, **layout)
    found = {}
    for row in ranked.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["id"], row["score"]))
    for key, query in asked.items():
        assert found.get(key, []) == brute_lexical(chunks, query, 7)


@pytest.mark.parametrize("layout", [{}, {"max_broadcast_queries": 0, "cell_queries": 9}])
def test_floors_and_like_blocks_give_the_same_hits(spark, monkeypatch, layout):
    for name, value in {"SEED_QUERIES": 2, "SEED_SHARE": 3, "QUERY_BLOCK": 4, "ITEM_BLOCK": 16, "GATHERED_BLOCKS": 3}.items():
        monkeypatch.setattr(blocked, name, value)
    scan = blocked._scan
    monkeypatch.setattr(blocked, "_scan", lambda *args: scan(*args))  # goes to the workers with these values
    chunks = {f"c{i:03d}": t for i, t in enumerate(texts(150, 11) + ["le la lampe le"] * 20 + [""])}
    asked = {f"q{i}": t for i, t in enumerate(texts(25, 12) + ["la lampe", "lampe le le", "nothing of it", "zeta x1"])}
    terms = lexical.term_table(spark.createDataFrame(list(chunks.items()), "id string, text string"))
    found, _ = lexical.search(terms, spark.createDataFrame(list(asked.items()), "query_id string, text string"), 4, **layout)
    got = {}
    for row in found.orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["id"], pytest.approx(row["score"])))
    expected = {q: brute_lexical(chunks, t, 4) for q, t in asked.items()}
    assert got == {q: hits for q, hits in expected.items() if hits}


def test_a_block_that_cannot_reach_the_floor_is_not_scored(monkeypatch):
    def table(rows, counts):
        return pa.table({"query_id": list(rows), "id": list(rows), "tokens": list(rows.values()), counts: [[1] * len(t) for t in rows.values()]})

    queries = table({"q1": ["lamp", "river"], "q2": ["lampe"]}, "qtfs").append_column("floor", pa.array([2.2, None], pa.float64()))
    scored = []
    real = lexical.TermScorer._tenths
    monkeypatch.setattr(lexical.TermScorer, "_tenths", lambda self, state, items: scored.append(state["n"]) or real(self, state, items))
    blocks = [{"a": ["lamp"], "b": ["stone"]}, {"c": ["lampe", "lamp"]}, {"d": ["lamp", "river"]}]
    monkeypatch.setattr(blocked, "ITEM_BLOCK", 1)
    batches = [table(b, "tfs").select(["id", "tokens", "tfs"]).combine_chunks().to_batches()[0] for b in blocks]
    found = [row for out in blocked._scan(blocked.TopK(lexical.TermScorer(), 1), queries, iter(batches)) for row in out.to_pylist()]
    assert sorted((r["query_id"], r["id"], r["score"]) for r in found) == [("q1", "d", 2.2), ("q2", "c", 1.1)]
    assert scored == [1, 1]  # one query each in the blocks of c and d


def test_all_scores_equal_search(spark):
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts(60, 3))], "id string, text string")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts(12, 4))], "query_id int, text string")
    terms = lexical.term_table(chunks)
    scores = lexical.all_scores(lexical.postings(terms), lexical.query_terms(queries), salts=3)
    every, _ = lexical.search(terms, queries, 60)
    left = {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in scores.collect()}
    assert left == {(r["query_id"], r["id"]): round(r["score"], 9) for r in every.collect()}


def test_lookup_equals_search(spark):
    chunks = spark.createDataFrame([(f"c{i:02d}", t) for i, t in enumerate(texts(80, 9))], "id string, text string")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts(15, 10))], "query_id int, text string")
    terms = lexical.term_table(chunks)
    looked_up, bound = lexical.lookup(lexical.postings(terms), queries, 4)
    searched, _ = lexical.search(terms, queries, 4)
    key = lambda rows: {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in rows.collect()}
    assert key(looked_up) == key(searched) and bound == 60
    many = queries.select("text", F.explode(F.sequence(F.col("query_id") * 10, F.col("query_id") * 10 + 9)).alias("query_id"))
    assert sorted(map(tuple, lexical.lookup(lexical.postings(terms), many, 4)[0].collect())) == sorted(map(tuple, lexical.search(terms, many, 4)[0].collect()))


def test_lookup_sums_a_chunk_for_all_queries_at_once(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts(120, 7))], "id string, text string")
    rows = lexical.postings(lexical.term_table(chunks))
    asked = [(f"q{i}", t) for i, t in enumerate(texts(12, 8))] + [(None, "the beta"), ("q1", "beta beta"), ("empty", "")]
    queries = spark.createDataFrame(asked, "query_id string, text string")
    monkeypatch.setattr(lexical, "MAX_SUMMED_QUERIES", 0)
    pairs, bound = lexical.lookup(rows, queries, 4)
    expected = sorted(map(str, pairs.select("query_id", "id", "score", "rank").collect()))
    monkeypatch.undo()
    monkeypatch.setattr(lexical, "all_scores", None)  # would sum every pair
    found, same = lexical.lookup(rows, queries, 4)
    assert same == bound and sorted(map(str, found.select("query_id", "id", "score", "rank").collect())) == expected


def test_term_counts_of_words_that_begin_alike(spark):
    rows = spark.createDataFrame([("aa a aa aaa a 1 11 1",), ("",), (None,)], "text string")
    found = [r[0] for r in rows.select(lexical.term_counts(F.split("text", " "))).limit(1).collect()]
    assert [(r.token, r.tf) for r in found[0]] == [("1", 2), ("11", 1), ("a", 2), ("aa", 2), ("aaa", 1)]
    assert [r[0] for r in rows.select(lexical.term_counts(lexical.tx.tokenize("text"))).collect()][1:] == [[], []]


def test_term_counts(spark):
    rows = spark.createDataFrame([("a", "b a b B c2"), ("b", "--")], "id string, text string")
    found = {r["id"]: dict(zip(r["tokens"], r["tfs"])) for r in lexical.term_table(rows).collect()}
    assert found == {"a": {"a": 1, "b": 3, "c2": 1}, "b": {}}


def test_limits_are_checked(spark):
    nothing = spark.createDataFrame([], "id string, text string")
    with pytest.raises(ValueError):
        lexical.search(nothing, nothing, 0)


def hash_embedding(text, normalize=True):
    words = [w for w in re.findall("[a-z0-9]+", text.lower()) if w not in vx.STOPWORDS] or [text.lower()]
    rows = [np.frombuffer(hashlib.sha256(w.encode()).digest(), ">u4") / 2**32 * 2 - 1 for w in words]
    value = np.mean(rows, axis=0)
    value[:4] += 3.0 * bool(set(words) & set(vx.WATER_WORDS))
    value[4:] += 3.0 * bool(set(words) & set(vx.BICYCLE_WORDS))
    return value / np.linalg.norm(value) if normalize else value


def test_hash_embedding(values):
    samples = ["safe drinking Water", "repair a bicycle chain", "water and gear", "the of to", "Ünïcode ?", "a a b", "?"]
    for normalize in (True, False):
        found = values(vx.hash_embed("x", normalize), samples + [""])
        assert found[-1] is None
        for text, vector in zip(samples, found):
            assert np.allclose(vector, hash_embedding(text, normalize), atol=1e-12)
    assert np.allclose(values(vx.token_vector("x"), ["abc"])[0], hash_embedding("abc", False))


def test_vector_expressions(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    found = rows.select(vx.cosine("a", "b").alias("c"), vx.l2_normalize("a").alias("n")).collect()
    assert [r["c"] for r in found] == [pytest.approx(0.96), 0.0]
    assert found[0]["n"] == [pytest.approx(0.6), pytest.approx(0.8)] and found[1]["n"] == [0.0, 0.0]
    with pytest.raises(Exception, match="differ in dimensions"):
        rows.select(vx.cosine(F.array(F.lit(1.0)), "b")).collect()
    odd = spark.createDataFrame([([1.0, math.nan],), ([1.0],), ([1.0, math.inf],), ([],), ([1.0, 2.0],)], "v array<double>")
    assert [r[0] for r in odd.select(vx.vector_error("v", 2)).collect()] == ["not_finite", "dimension_mismatch", "not_finite", "empty", None]
    score = spark.range(1).select(vx.distance_score(F.lit(0.2), True), vx.distance_score(F.lit(1.5), False)).first()
    assert (round(score[0], 9), score[1]) == (0.8, -1.5)


def vector_rows(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, 6)).round(3)
    made[:copies] = made[0]
    return [(f"v{i:03d}", row.tolist()) for i, row in enumerate(made)]


@pytest.mark.parametrize("mode", [vec.COSINE, vec.L2, vec.DISTANCE])
@pytest.mark.parametrize("layout", [{}, {"max_broadcast_queries": 0, "cell_items": 30, "cell_queries": 9}])
def test_vector_search_matches_brute_force(spark, mode, layout):
    stored, asked = vector_rows(120, 5, copies=40), vector_rows(20, 6)
    asked += [("same", stored[0][1])]  # a third of the table are copies of this one
    ranked, _ = vec.search(
        spark.createDataFrame(stored, "id string, embedding array<double>"),
        spark.createDataFrame(asked, "query_id string, embedding array<double>"), 5, mode, **layout,
    )
    found = {}
    for row in ranked.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["id"], round(row["score"], 6)))
    for key, query in asked:
        scored = []
        for other, vector in stored:
            q, v = np.array(query), np.array(vector)
            score = q @ v / np.linalg.norm(q) / np.linalg.norm(v) if mode == vec.COSINE else -((q - v) ** 2).sum()
            scored.append((-round(score, 9), other))
        best = sorted(scored)[:5]
        sign = 1 if mode == vec.DISTANCE else -1
        assert [i for i, _ in found[key]] == [i for _, i in best]
        assert [s for _, s in found[key]] == pytest.approx([sign * s for s, _ in best], abs=1e-6)


def test_top_columns_prefers_the_leftmost_of_equals():
    keys = np.array([[5, 7, 7, 5, blocked.NO_MATCH, 7]])
    assert blocked._top_columns(keys, 4).tolist() == [[1, 2, 5, 0]]
    huge = np.array([[1 << 60, 1 << 61, 1 << 61, 3]])
    assert blocked._top_columns(huge, 2).tolist() == [[1, 2]]


def test_user_embedder(spark):
    rows = spark.createDataFrame([("a",), ("bbb",), ("cc",)], "text string").repartition(2)
    good = vec.embed_with(lambda: lambda batch: [[len(t), 1.0] for t in batch], 2, batch_size=1)
    assert sorted(r[0][0] for r in rows.select(good("text")).collect()) == [1.0, 2.0, 3.0]
    short = vec.embed_with(lambda: lambda batch: [[1.0] for _ in batch], 2)
    with pytest.raises(Exception, match="2 finite values"):
        rows.select(short("text")).collect()
    with pytest.raises(ValueError):
        vec.embed_with(lambda: None, 2, batch_size=0)


def test_identity_mismatch_reports_the_first_difference():
    base = vec.EmbeddingIdentity("b", "m", 8, True, vec.EmbeddingIdentity.path_id("/models/x"))
    assert base.model_path_id == "x" and base.mismatch(base) is None
    other = vec.EmbeddingIdentity("b", "m2", 4, True, "x")
    assert base.mismatch(other) == "model_name"
    assert base.mismatch(vec.EmbeddingIdentity("b", "m", 8, False, "x")) == "normalizes_vectors"
    assert len(base.fingerprint()) == 64


@pytest.mark.parametrize("layout", [{}, {"max_broadcast_queries": 0, "cell_items": 25, "cell_queries": 6}])
def test_evaluation_matches_full_ranking(spark, layout):
    rng = np.random.default_rng(8)
    made = rng.normal(size=(90, 5)).round(2)
    made[60:] = made[10]  # a third are copies
    labels = rng.integers(0, 4, 90)
    rows = [(f"r{i}", i, made[i].tolist(), int(labels[i])) for i in range(90)]
    records = spark.createDataFrame(rows, "id string, position long, embedding array<double>, label int")
    queries = records.select(F.col("position").alias("query_id"), "embedding", "label", F.col("position").alias("self_position"))
    found = {r["query_id"]: r for r in evaluate.by_label(records, queries, **layout).collect()}
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    judged = []
    expected = {}
    for q in range(90):
        order = sorted((i for i in range(90) if i != q), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))
        hits = [labels[i] == labels[q] for i in order]
        first = hits.index(True) + 1 if any(hits) else None
        expected[q] = (sum(hits), int(hits[0]), sum(hits[:3]), first)
        judged += [(q, f"r{i}") for i in order if labels[i] == labels[q]]
        row = found[q]
        assert (row["relevant"], row["top1_hits"], row["top3_hits"], row["first_relevant_rank"]) == expected[q]
    relevant = spark.createDataFrame(judged, "query_id long, id string")
    same = evaluate.by_judgements(records, queries, relevant, **layout).collect()
    assert {r["query_id"]: (r["relevant"], r["top1_hits"], r["top3_hits"], r["first_relevant_rank"]) for r in same} == expected
    row = evaluate.metrics(spark.createDataFrame(same)).first()
    assert row["mean_reciprocal_rank"] == pytest.approx(np.mean([1 / e[3] for e in expected.values()]))
    assert row["recall_at_3"] == pytest.approx(np.mean([e[2] / e[0] for e in expected.values()]))


def test_labels_are_evaluated_by_two_scans(spark, monkeypatch):
    """With floors, and with queries that have no relevant document or no label, as without."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist(), None if i % 17 == 0 else 100 + i if i % 23 == 0 else i % 3) for i in range(120)]
    records = spark.createDataFrame(rows, "position long, embedding array<double>, label int")
    queries = records.select(F.col("position").alias("query_id"), "embedding", "label", F.col("position").alias("self_position"))
    found, scans = [], []
    real = blocked.reduce_items
    monkeypatch.setattr(blocked, "reduce_items", lambda *args, **layout: scans.append(args[2]) or real(*args, **layout))
    for least in (1, 1 << 30):
        monkeypatch.setattr(blocked, "SEED_QUERIES", least)
        monkeypatch.setattr(blocked, "SEED_SHARE", 4)
        found.append(sorted(map(str, evaluate.by_label(records, queries).collect())))
    assert found[0] == found[1] and len(found[0]) == 120 and len(scans) == 4
    unit = np.array([e for _, e, _ in rows]) / np.linalg.norm([e for _, e, _ in rows], axis=1, keepdims=True)
    for row in evaluate.by_label(records, queries).collect():
        q = row["query_id"]
        order = sorted((i for i in range(120) if i != q), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))
        hits = [rows[q][2] is not None and rows[i][2] == rows[q][2] for i in order]
        assert row["first_relevant_rank"] == (hits.index(True) + 1 if any(hits) else None) and row["top3_hits"] == sum(hits[:3])


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "query_id int, relevant long, top1_hits long, top3_hits long, recall_at_3 double, reciprocal_rank double")
    assert evaluate.metrics(empty).first().asDict() == {
        "query_count": 0, "queries_without_relevant": 0, "top1_accuracy": 0.0, "recall_at_3": 0.0, "mean_reciprocal_rank": 0.0,
    }


def test_related_probe(spark):
    rows = spark.createDataFrame([(1, "purify water", "drinking water", "bicycle repair")], "triple_id int, anchor string, related string, unrelated string")
    assert evaluate.related_ranks_higher(rows).first()["related_ranks_higher"]


def test_many_queries_neither_shuffle_nor_repeat_the_items(spark):
    items = spark.range(400).toDF("n").select(
        F.concat(F.lit("c"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("id"),
        F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("n") * i) + 1.5).alias("embedding"),
    )
    asked = items.filter(F.col("id") < "c050").select(F.col("id").alias("query_id"), "embedding")
    found, bound = blocked.reduce_items(
        items, asked, blocked.TopK(vec.VectorScorer(), 3), F.lit(64), max_broadcast_queries=10, cell_queries=20
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert bound is None and "Exchange" not in plan and "CoGroup" not in plan
    whole = blocked.rank_rows(blocked.reduce_items(items, asked, blocked.TopK(vec.VectorScorer(), 3), F.lit(64))[0], 3)
    assert {tuple(r) for r in blocked.rank_rows(found, 3).collect()} == {tuple(r) for r in whole.collect()}


def test_lex_scores_adds_the_scores_of_a_chunk_where_it_lies(spark, tmp_path):
    from checks.text_queries import lex_scores

    docs = spark.createDataFrame([(i, f"lamp river {i} lamp", "en", "s", 14) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a lamp 3"), (2, "river river")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = lex_scores(spark, str(tmp_path))
    assert "hashpartitioning(query_id" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {(r["query_id"], int(r["chunk_id"].split(":")[0])): r["score"] for r in found.collect()}
    assert rows == {(1, i): 2.3 if i == 3 else 1.2 for i in range(6)} | {(2, i): 2.2 for i in range(6)}


def _text_tables(spark, folder, texts):
    rows = [(i, t, f"src{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    asked = [(0, "alpha beta"), (1, "gamma"), (2, "x1 delta the"), (3, None), (4, "")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["eval_fixture", "similarity_triples"])
def test_documents_without_text_have_no_vector_and_are_left_out(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from checks.base import ORACLES, QUERIES
    from checks import vector_queries  # noqa: F401

    made = [f"{t} word{i}" for i, t in enumerate(texts(20, 9))]
    made[3], made[4], made[13] = None, "", None
    folder = _text_tables(spark, tmp_path, made)
    found = QUERIES[name](spark, folder).toPandas()
    database = duckdb.connect()
    for table in ("documents", "benchmark"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    expected = database.execute(ORACLES[name]).fetch_df()[list(found.columns)]
    plain = [sorted(tuple(None if v != v else v for v in row) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False)) for frame in (found, expected)]
    assert len(plain[0]) > 2 and plain[0] == plain[1]


def test_related_probe_of_named_texts_embeds_each_once(spark):
    rows = {f"t{i}": t + " x1" for i, t in enumerate(texts(8, 4))}
    triples = [(i, f"t{i}", f"t{i + 1}", f"t{i + 2}") for i in range(6)]
    ddl = "triple_id int, anchor string, related string, unrelated string"
    named = spark.createDataFrame([*triples, (6, "t0", "t1", "gone")], ddl)
    spelled = spark.createDataFrame([(n, *map(rows.get, ids)) for n, *ids in triples], ddl)
    table = spark.createDataFrame(list(rows.items()), "id string, text string")
    by_id = evaluate.related_ranks_higher(named, texts=table)
    assert sorted(by_id.collect()) == sorted(evaluate.related_ranks_higher(spelled).collect())
