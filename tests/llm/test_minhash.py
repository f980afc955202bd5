import numpy as np
import pytest

from corpusloom.llm import minhash, shingles
from corpusloom.llm.components import connected_components


def brute(rows):
    sets = {}
    for i, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
        words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    of = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if either and 100 * both >= 75 * either and of[b] < of[a]:
                    of[a], changed = of[b], True
    return {i: (len(s), of[i], of[i] == i) for i, s in sets.items()}


def corpus():
    rng = np.random.default_rng(3)
    rows = []
    for group in range(6):
        words = [f"w{rng.integers(400)}é" for _ in range(int(rng.integers(30, 300)))]
        for copy in range(90 if group == 0 else 6):
            own = list(words)
            for k in rng.choice(len(own), int(len(own) * [0, 0.01, 0.02, 0.05][copy % 4]), replace=False):
                own[k] = f"x{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(own)))
    odd = [None, "", " \t\n", "one", "ONE", "a b c d e", "A  b\x0bc d\x0ce", "a\xa0b c d e", "same " * 3000, "same " * 2000]
    return rows + [(len(rows) + k, t) for k, t in enumerate(odd)]


def test_as_by_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", minhash.F.lit("clash"))
    got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows)
    assert {r.doc_id for r in minhash.keep_one(docs).collect()} == {i for i, x in got.items() if x[2]}


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, "A b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 1, False), (1, 1, True), (1, 1, True), (5, 1, False)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_go_by_their_texts(spark):
    """Twice, as any of an id's texts could be taken by chance."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (8, "another text of its own words"), (4, b + " z"), (None, a), (None, "no name at all for it")]
    for _ in range(2):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = sorted((r.doc_id or 0, r.component_id or 0) for r in minhash.near_duplicates(docs).collect())
        assert got == [(0, 0), (0, 5), (4, 4), (5, 4), (5, 5), (6, 5), (7, 4), (8, 8)]
        kept = sorted((r.doc_id or 0, r.text) for r in minhash.keep_one(docs).collect())
        assert kept == [(0, a), (0, "no name at all for it"), (4, b + " z"), (8, "another text of its own words")]


def test_one_of_identical_rows_stays(spark):
    rows = [(1, "a b c d e f")] * 3 + [(None, "g h i j k l")] * 2 + [(2, "a b c d e f"), (3, ""), (3, ""), (4, None), (1, "other words than the first")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, key int").repartition(3)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "g h i j k l"), (1, "a b c d e f"), (1, "other words than the first"), (3, ""), (3, ""), (4, "")]


def test_rows_do_not_run_into_each_other():
    data = np.frombuffer("abcd ef".encode(), np.uint8)
    together = shingles.word_hashes(data, np.array([0, 7]))
    apart = shingles.word_hashes(data, np.array([0, 2, 2, 7]))
    assert len(together[0]) == 2 and list(apart[1]) == [0, 1, 1, 3] and together[0][1] == apart[0][2]


@pytest.mark.parametrize("n", [2, 40])
def test_components_of_a_chain_and_a_star(spark, n):
    links = [(i, i + 1) for i in range(100, 100 + n)] + [(7, 7 + k) for k in range(1, n)] + [(500, 500), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 101 + n)} | {7 + k: 7 for k in range(n)}
