import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import shards as sh


def rows(n=700):
    out = [(k, f"text {k % 50} é" * (k % 9), "kept") for k in range(n)]
    return out + [(n, None, None), (None, "x", "y"), (n + 1, "long " * 50000, None)] + [(3, "again", "z")] * 40


def check(got, n, shards):
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(shards)}
    assert sum(map(len, by.values())) == n and all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 200])
def test_law_and_order(spark, bucket_bytes):
    given = rows()
    docs = spark.createDataFrame(given, "doc_id long, text string, place string")
    got = sh.shuffled_shards(docs, 5, seed=3, bucket_bytes=bucket_bytes).collect()
    check(got, len(given), 5)
    assert Counter((r.doc_id, r.text, r.place) for r in got) == Counter(given)
    name = lambda rs: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rs)
    for parts in (1, 7) if bucket_bytes > 1000 else (7,):  # whatever the partitions, copies of a row too: they are alike
        assert name(sh.shuffled_shards(docs.repartition(parts), 5, seed=3, bucket_bytes=bucket_bytes).collect()) == name(got)
    assert name(sh.shuffled_shards(docs, 5, seed=4, bucket_bytes=bucket_bytes).collect()) != name(got)


def test_copies_are_scattered(spark, monkeypatch):
    given = [(k, f"text {k}", k) for k in range(300)] + [(5, "copy", k) for k in range(200)] + [(None, None, k) for k in range(100)]
    docs = spark.createDataFrame(given, "doc_id long, text string, number long").repartition(6)
    got = sh.shuffled_shards(docs, 4, bucket_bytes=300).collect()
    check(got, len(given), 4)
    assert sorted(r.number for r in got) == sorted(n for _, _, n in given)
    for rows_of in ([r for r in got if r.text == "copy"], [r for r in got if r.doc_id is None]):
        shares = Counter(r.shard for r in rows_of)
        assert len(shares) == 4 and max(shares.values()) < 2 * min(shares.values())
        places = sorted(4 * r.slot + r.shard for r in rows_of)
        assert places[-1] - places[0] > 400 and len({p // 60 for p in places}) == 10
    alone = [(r.doc_id, r.shard, r.slot) for r in got if r.text and r.text != "copy"]
    monkeypatch.setattr("corpusloom.session.MAX_BROADCAST_KEYS", 0)  # the same by joins that shuffle
    again = sh.shuffled_shards(docs.repartition(1), 4, bucket_bytes=300).collect()
    check(again, len(given), 4)
    assert sorted(alone) == sorted((r.doc_id, r.shard, r.slot) for r in again if r.text and r.text != "copy")


def test_files_and_no_rows(spark, tmp_path):
    docs = spark.createDataFrame(rows(60), "doc_id long, text string, place string")
    sharded = sh.shuffled_shards(docs, 3)
    sh.write_shards(sharded, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
    assert sh.shuffled_shards(docs.limit(0), 3).count() == 0


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sh.fisher_yates(4, 9, k)) for k in range(24_000))
    assert len(seen) == 24 and max(abs(n - 1000) for n in seen.values()) < 150
    assert sh.fisher_yates(0, 1, 1).tolist() == [] and np.array_equal(sh.fisher_yates(50, 1, 2), sh.fisher_yates(50, 1, 2))
