"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as hn

DDL = "vec_id long, label int, embedding array<float>, rank string, key string"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    usable = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        usable[(i, label, q)] = None
    found = []
    for a in usable:
        if not anchors(a[0]):
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b) for b in usable if b != a and len(b[2]) == len(a[2])]
        near = sorted((s, i) for s, i, b in scored if b[1] == a[1])[:positives]
        for s, i in near:
            far = sorted((t, j) for t, j, b in scored if b[1] != a[1] and low * -s <= 100 * -t <= high * -s)[:negatives]
            found += [(a[0], i, k + 1, j, -s, -t) for k, (t, j) in enumerate(far)]
    return sorted(found)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def vectors(seed, n, width=12, copies=0):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = centres[pick.randrange(4)]
        rows.append((i, pick.randrange(3), [float(np.float32(x + pick.gauss(0, 0.7))) for x in c]))
    for k in range(copies):
        rows.append((n + k, pick.randrange(3), rows[3][2]))  # one vector under many ids: ties
    return rows


@pytest.mark.parametrize("blocks", [(512, 16_384), (3, 17)])
def test_against_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(hn, "CANDIDATE_BLOCK", blocks[1])
    rows = vectors(1, 120, copies=60)
    rows += [rows[10], rows[10]]  # repeated rows count once
    rows += [(200, 1, [0.0] * 12), (201, 2, [0.0] * 12), (203, 1, [-x for x in rows[5][2]])]
    rows += [(210, None, rows[0][2]), (220, 1, None), (230, 1, [None] * 12), (240, 0, [float("nan")] * 12), (250, 0, [float("inf")] + [1.0] * 11), (None, 1, rows[0][2])]
    rows += [(260, 1, []), (261, 1, []), (262, 2, []), (270, 1, [1.0, 2.0]), (271, 1, [1.0, 2.0]), (272, 2, [0.9, 1.5])]
    df = spark.createDataFrame([(*r, "kept", "out") for r in rows], DDL).repartition(5)
    got = rows_of(hn.hard_negatives(df, F.col("vec_id") % 10 == 0))
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 100
    assert any(a == 260 for a, *_ in got) and any(a == 270 for a, *_ in got)  # without dimensions all scores are 0


def test_large_components_and_settings(spark):
    rows = [(i, label, [1000.0 * x for x in v]) for i, label, v in vectors(2, 60)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], DDL)
    got = rows_of(hn.hard_negatives(df, F.col("vec_id") < 7, positives=2, negatives=4, low=10, high=80))
    assert got == brute(rows, lambda i: i < 7, 2, 4, 10, 80) and got
    with pytest.raises(ValueError, match="64 bits"):
        hn.hard_negatives(spark.createDataFrame([(0, 1, [1e30], "", "")], DDL), F.lit(True))
    with pytest.raises(ValueError, match="at least one"):
        hn.hard_negatives(df, F.lit(True), positives=0)


def test_rows_that_share_an_id(spark):
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [0.8, 0.6]), (0, 2, [0.5, 0.5]), (7, 2, [0.6, 0.4]), (8, 1, [0.9, 0.4])]
    df = spark.createDataFrame([(*r, "", "") for r in rows], DDL)
    assert rows_of(hn.hard_negatives(df, F.col("vec_id") == 0)) == brute(rows, lambda i: i == 0)


def test_empty(spark):
    empty = spark.createDataFrame([], DDL)
    assert hn.hard_negatives(empty, F.col("vec_id") % 50 == 0).collect() == []
    alone = spark.createDataFrame([(0, 1, [1.0], "", "")], DDL)
    assert hn.hard_negatives(alone, F.lit(True)).collect() == []
    assert hn.hard_negatives(alone, F.lit(False)).collect() == []


def test_planes_give_the_numbers_back():
    made = np.random.default_rng(3).integers(-1000, 1000, (50, 21))
    packed = hn.pack_planes(made, 11)
    assert (hn.unpack_planes(packed)[:, :21] == made).all() and packed.shape == (50, 11, 3)
    anchors = hn.unpack_planes(packed[:9])
    assert (hn.look_up_scores(hn.subset_sums(anchors, np.int64), packed) == anchors @ hn.unpack_planes(packed).T).all()
