"""Both encoders against the libraries whose results they have to give."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken

from corpusloom.llm import bpe, merging, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    pick = random.Random(1)
    odd = [
        None, "", " ", "  ", "a  b", "   lead", "trail   ", "\n\n \n", "a\tb\r\n", "▁▁x ▁", "日本語テキスト です", "😀😀 é̈ ﬁ", "a" * 3000, "ab" * 2000, " " * 500,
        "aaaa bbbb " * 50, "<s>hi</s><unk> <0x0A> <|endoftext|>", "\x00\x1c\x1d\x85 x", "'s 're it'll  don't", "1234567890" * 30, "İıſK", "-" * 777 + "=" * 333,
        "long " * 30000, "same text", "same text",
    ]
    odd += ["".join(pick.choice("ab cdeéñ日\n  .,'0189xyzTHE▁") for _ in range(pick.randrange(1, 400))) for _ in range(300)]
    return odd + ["".join(pick.choice("the in") for _ in range(300)) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 5 else k, t, "kept") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_ids_and_bytes(docs):
    tokens = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, ids="coded")
    assert coded.columns == ["doc_id", "text", "ids", "coded"]
    for row in bpe.decode(coded, RANKS, "coded").collect():
        assert row.coded == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    digests = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and digests.count() == len(texts())
    assert bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_what_is_remembered_changes_nothing(monkeypatch):
    tokens = bpe.read_ranks(RANKS)
    whole = bpe.Encoder(tokens, public_tokenizers.PATTERN).encode([t or "" for t in texts()])
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    forgetful = bpe.Encoder(tokens, public_tokenizers.PATTERN)
    assert [forgetful.encode([t or ""])[0] for t in texts()] == whole


def test_small_batches_are_one_corpus(docs, monkeypatch):
    replayed = []
    replay = bpe.Encoder.replay
    monkeypatch.setattr(bpe.Encoder, "replay", lambda self, words: replayed.append(words) or replay(self, words))
    rows = texts() * 2
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": pa.array([t], pa.string())}) for k, t in enumerate(rows)]
    run = bpe._encoding(docs, RANKS, public_tokenizers.PATTERN, "text", "ids", ["doc_id"])
    found = pa.Table.from_batches(run(iter(batches)))
    assert len(replayed) == 1 and len(set(replayed[0])) == len(replayed[0])
    assert found.column("doc_id").to_pylist() == list(range(len(rows)))
    whole = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN).encode([t or "" for t in rows])
    assert found.column("ids").to_pylist() == [np.frombuffer(ids, np.int32).tolist() for ids in whole]


def test_bad_ids(spark):
    with pytest.raises(Exception, match="IndexError|range"):
        bpe.decode(spark.createDataFrame([([99999999],)], "ids array<int>"), RANKS).collect()
    assert [r.decoded for r in bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), RANKS).collect()] == [None, b""]


def test_counts(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counted = token_counts.count_tokens(docs.withColumnRenamed("ids", "n_tokens"), MODEL, limit=100)
    assert counted.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    for row in counted.collect():
        n = len(library.encode(row.text or ""))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((row.text or "").encode()), n, n > 100)
    assert token_counts.count_tokens(docs.limit(0), MODEL).count() == 0


def test_rounds_against_single_merges():
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ba", "aab", "aba"]
    for seed in range(30):
        ranks = np.random.default_rng(seed).permutation(len(pieces))
        counter = token_counts.Counter([(p, -float(r)) for p, r in zip(pieces, ranks)])
        table = merging.PairTable(pieces, np.array(ranks, np.int32))
        pick = random.Random(seed)
        words = ["".join(pick.choice("abcd") for _ in range(pick.randrange(1, 40))) for _ in range(50)]
        assert counter.merged(words).tolist() == [len(table.merge_one([pieces.index(c) if c in pieces else -1 for c in w])) for w in words]
