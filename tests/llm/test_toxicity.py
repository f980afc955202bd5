import itertools
import random
import zlib

import numpy as np

from corpusloom.llm import toxicity as tx


def brute(emission, starts, steps, first):
    out = np.zeros(len(emission))
    for a, b in zip(starts, [*starts[1:], len(emission)]):
        total, own = 0.0, np.zeros(b - a)
        for tags in itertools.product((0, 1), repeat=b - a):
            weight = first * tags[0] + sum(e for e, t in zip(emission[a:b], tags) if t) + sum(steps[i, j] for i, j in zip(tags, tags[1:]))
            total += np.exp(weight)
            own += np.exp(weight) * np.array(tags)
        out[a:b] = own / total
    return out


def test_marginals_as_by_enumeration(monkeypatch):
    rng = np.random.default_rng(0)
    for block in (2, 3, 128):
        monkeypatch.setattr(tx, "_BLOCK", block)
        for starts in ([0], [0, 1], [0, 4, 9]):
            emission, steps = rng.normal(size=12) * 3, rng.normal(size=(2, 2))
            np.testing.assert_allclose(tx.marginals(emission, np.array(starts), steps, -0.4), brute(emission, starts, steps, -0.4), atol=1e-9)


def corpus(n=1600):
    pick = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(pick.choice(("ba", "do", "ri", "mu")) for _ in range(pick.randrange(1, 4))) for _ in range(pick.randrange(5, 60))]
        toxic = pick.random() < 0.2
        if toxic:
            for _ in range(pick.randrange(1, 4)):
                words[pick.randrange(len(words))] = pick.choice(("Nasty", "vile", "zorgg" + "".join(pick.choice("abcdefgh") for _ in range(3))))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_labels(spark):
    rows, labels = corpus()
    odd = [(10_000, None), (10_001, ""), (10_002, " ,. "), (10_003, "ba do " * 30000), (10_004, "İ vile nasty x"), (None, "vile nasty"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("score", tx.F.lit("clash"))
    given = [(i, (1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]  # wrong where they must not be used
    labelled = spark.createDataFrame([*given, (None, 1), (7, None), (3, given[3][1])], "doc_id long, toxic int")
    chain = tx.train(docs, labelled)
    got = {r.doc_id: r for r in tx.score(docs.withColumnRenamed("score", "spans"), chain).collect()}
    truth = dict(labels)
    test = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == truth[i] for i in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[10_000].score == got[10_001].score == got[10_002].score < 0.3 and got[10_003].predicted == 0
    row = got[10_004]
    assert [row.text[s.start : s.stop].strip() for s in row.spans] == ["vile nasty"] or [row.text[s.start : s.stop] for s in row.spans] == ["vile", "nasty"]
    kept = tx.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert {r.held_out for r in docs.select(tx.held_out("doc_id").alias("held_out"), "doc_id").filter("doc_id is null").collect()} == {False}


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    chain = tx.train(docs, none)
    assert {r.predicted for r in tx.score(docs, chain).collect()} == {0}
    assert tx.score(docs.limit(0), chain).count() == 0


def test_rare_toxic_words_and_near_copies():
    pick = random.Random(7)
    rare = ["".join(pick.choice("bcdfghjklmnpqrstvwxz") + pick.choice("aeiou") for _ in range(5)) for _ in range(60)]

    def clean():
        return ["".join(pick.choice(("ba", "do", "ri", "mu")) for _ in range(pick.randrange(1, 4))) for _ in range(pick.randrange(20, 60))]

    texts, toxic = [], []
    for k in range(1600):  # each of the words is in about one and a half of 100 toxic texts
        words = clean()
        if k % 2:
            words.insert(pick.randrange(len(words)), rare[k // 2 % 60])
        texts.append(" ".join(words))
        toxic.append(k % 2 == 1)
    base = clean() * 2
    base[10:10] = ["onlyhere", "whenever"]
    for k in range(60):  # near copies of one toxic text
        texts.append(" ".join([*base, rare[k], f"x{k}"]))
        toxic.append(True)
    tagger = tx.Tagger(tx.fit(texts, np.array(toxic), 0.5))
    score, spans = tagger.score([" ".join([*clean(), w, *clean()]) for w in rare])
    plain, _ = tagger.score([" ".join(clean()) for _ in range(60)])
    assert (score >= tx.THRESHOLD).mean() >= 0.9 and (plain >= tx.THRESHOLD).mean() <= 0.1
    assert sum(map(bool, spans)) >= 54
    assert not tagger.score(["ba do onlyhere ri mu whenever ba"])[1][0]
