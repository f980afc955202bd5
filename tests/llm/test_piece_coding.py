"""Piece encoding and decoding against the library."""

import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from corpusloom.llm import merging, piece_coding, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    pick = random.Random(4)
    odd = [
        None, "", " ", "  ", "a  b", "   lead", "trail   ", "\n\n \n", "a\tb\r\n", "▁▁x ▁", "▁", "日本語テキスト です", "😀😀 é̈ ﬁ", "a" * 3000, "ab" * 2000, " " * 500,
        "aaaa bbbb " * 50, "<s>hi</s><unk> <0x0A> <|endoftext|>", "\x00\x1c\x1d\x85 x", "'s 're it'll", "1234567890" * 30, "İıſK", "-" * 777 + "=" * 333,
        "long " * 30000, "same text", "same text", "".join(chr(c) for c in range(0x4E00, 0x5600)), "nospaceatallinthistext" * 400,
    ]
    odd += ["".join(pick.choice("ab cdeéñ日\n  .,'0189xyzTHE▁") for _ in range(pick.randrange(1, 400))) for _ in range(300)]
    return odd + ["".join(pick.choice("thein") for _ in range(600)) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 5 else k, t, "kept") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_ids_and_texts(docs):
    coded = piece_coding.encode(docs, MODEL, ids="coded")
    assert coded.columns == ["doc_id", "text", "ids", "coded"]
    rows = piece_coding.decode(coded, MODEL, "coded").collect()
    assert len(rows) == len(texts())
    for row in rows:
        assert row.coded == LIBRARY.encode(row.text or "")
        assert row.decoded == LIBRARY.decode(row.coded)
    digests = piece_coding.round_trip(docs, MODEL)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and digests.count() == len(texts())
    assert piece_coding.round_trip(docs.limit(0), MODEL).count() == 0


def test_the_query(spark, tmp_path, docs):
    from hashlib import sha256

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_sentencepiece"](spark, str(tmp_path)).collect()
    digest = lambda s: sha256(s.encode()).hexdigest()
    expected = []
    for k, t in enumerate(texts()):
        ids = LIBRARY.encode(t or "")
        expected.append((-1 if k == 5 else k, len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids))))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(expected)


def test_limits_of_memory_and_rounds_change_nothing(monkeypatch):
    known = piece_coding.Vocabulary(MODEL)
    whole = [LIBRARY.encode(t or "") for t in texts()]
    for name, value in (("REMEMBERED", 10), ("ROUNDS", 1), ("_FEW_KINDS", 0)):
        monkeypatch.setattr(piece_coding, name, value)
        coder = piece_coding.Coder(known)
        assert [np.frombuffer(coder.encode([t or ""])[0], np.int32).tolist() for t in texts()] == whole


def test_any_ids_decode(spark):
    coder = piece_coding.Coder(piece_coding.Vocabulary(MODEL))
    pick = random.Random(6)
    for _ in range(5000):
        ids = [pick.choice([pick.randrange(300), pick.randrange(32000), 0, 1, 2]) for _ in range(pick.randrange(9))]
        assert coder.decode(np.array(ids, np.int32)) == LIBRARY.decode(ids)
    given = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in piece_coding.decode(given, MODEL).collect()] == [None, ""]
    for wrong in (99999999, -1):
        with pytest.raises(Exception, match="IndexError|ValueError"):
            piece_coding.decode(spark.createDataFrame([([wrong],)], "ids array<int>"), MODEL).collect()


def test_rounds_against_single_merges():
    """Also where a merge makes a pair that comes before what is left of its round."""
    names = ["a", "b", "c", "ab", "bc", "abc", "ba", "aab", "aba", "aa", "aaa"]
    for seed in range(60):
        ranks = np.random.default_rng(seed).permutation(len(names)).astype(np.int32)
        known = SimpleNamespace(names=names, ids=list(range(len(names))), ranks=ranks, surface=[n.encode() for n in names], byte_id=list(range(1000, 1256)))
        table = merging.PairTable(names, ranks)
        pick = random.Random(seed)
        words = ["".join(pick.choice("abcd") for _ in range(pick.randrange(1, 40))) for _ in range(50)]
        got = [np.frombuffer(x, np.int32).tolist() for x in piece_coding.Coder(known).merged(words)]
        for word, ids in zip(words, got):
            single = table.merge_one([names.index(c) if c in names else -1 for c in word])
            assert ids == [1000 + ord("d") if s < 0 else s for s in single]
