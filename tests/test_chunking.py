import random

import pytest

from corpusloom.operators import chunking


def cut(text, size, overlap):
    """Windows restated: starts at multiples of the step, up to the first one that reaches the end."""
    text = text.strip()
    starts = range(0, len(text), size - overlap)
    last = next((s for s in starts if s + size >= len(text)), None)
    return [text[s : s + size] for s in starts if s <= last] if text else []


@pytest.mark.parametrize("size,overlap", [(10, 3), (10, 0), (7, 6), (1, 0), (50, 10)])
def test_windows_match_restatement(spark, size, overlap):
    rng = random.Random(size * 100 + overlap)
    texts = ["".join(rng.choice("ab \né😀") for _ in range(rng.randrange(90))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {}
    for row in chunking.explode_windows(rows, "text", size, overlap).collect():
        found.setdefault(row["i"], {})[row["chunk_index"]] = row["text"]
    for i, text in enumerate(texts):
        assert [found.get(i, {})[n] for n in sorted(found.get(i, {}))] == cut(text, size, overlap)


def test_chunk_rows(spark):
    text = "".join(str(i % 10) for i in range(260))
    docs = spark.createDataFrame([("a:b", "t", "s", text), ("blank", "t", "s", " \n ")], "document_id string, title string, source string, text string")
    rows = chunking.chunk_documents(docs, 50, 10).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(7))
    assert rows[0]["text"][-10:] == rows[1]["text"][:10]
    assert all(r["id"] == f"a_b:{r['chunk_index']:06d}:{r['sha256'][:12]}" for r in rows)
    by_source = chunking.chunk_sources(docs.drop("document_id").replace("s", "/in/My Doc.txt", "source"), 50, 10)
    assert {r["id"].split(":")[0] for r in by_source.collect()} == {"my_doc"}


def test_parameters_are_checked():
    for size, overlap in ((0, 0), (10, -1), (10, 10), (10, 11)):
        with pytest.raises(ValueError):
            chunking.check_chunk_params(size, overlap)


def test_distinct_chunks_keep_one_row_per_id(spark):
    docs = spark.createDataFrame([(i, "t", "s", "same text") for i in ("a:b", "a_b", "a b")], "document_id string, title string, source string, text string")
    chunks = chunking.chunk_documents(docs)
    assert chunks.count() == 3
    assert chunking.distinct_chunks(chunks).count() == 1
