import hashlib
import random
import unicodedata
from urllib.parse import quote

from pyspark.sql import functions as F

from corpusloom.functions import text as tx

BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　"


def random_texts(n, alphabet, longest=30, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_strip_collapse_and_visible_characters(values):
    texts = random_texts(2000, BLANKS + "ab​é😀.")
    assert values(tx.strip("x"), texts) == [t.strip() for t in texts]
    assert values(tx.collapse_whitespace("x"), texts) == [" ".join(t.split()) for t in texts]
    assert values(tx.visible_chars("x"), texts) == [len("".join(t.split())) for t in texts]


def test_tokens(values):
    assert values(tx.tokenize("x"), ["Prompt-Assembly, RAG!", "naïve İx", "--"]) == [
        ["prompt", "assembly", "rag"], ["na", "ve", "i", "x"], [],
    ]


def test_source_slug(values):
    cases = {
        "/data/My File.v2.txt": "my_file_v2", "notes": "notes", "/x/.hidden": "hidden", "/x/é.txt": "source",
        "web:A title": "web_a_title", "/a/b/": "b", "": "source", "x/..": "source",
    }
    assert values(tx.source_slug("x"), list(cases)) == list(cases.values())
    assert values(tx.document_slug("x"), ["a:b", "é", "A--b_"]) == ["a_b", "document", "a_b"]


def test_document_id(values):
    key, text = F.lit("k"), F.lit("body")
    derived = "doc-" + hashlib.sha256(b"k\nbody").hexdigest()[:16]
    assert values(tx.document_id("x", key, text), [" a/b c ", None, "  ", "é-1:x_"]) == ["a_b_c", derived, derived, "é-1:x_"]


def test_index_slug(values):
    cases = {"My Index": "my-index", "Sample_01": "sample_01", " a \t b!! ": "a-b", "--": None, "é": None}
    assert values(tx.index_slug("x"), list(cases)) == list(cases.values())
    names = ["ok name", "", "../up", "a/b", "a\\b", "!!"]
    assert values(tx.index_name_error("x"), names) == [None, "empty", "traversal", "traversal", "traversal", "empty_slug"]


def test_snippet(values):
    assert values(tx.snippet("x", 10), ["short", "exactly 10", "eleven char"]) == ["short", "exactly 10", "eleven " + "..."]


def test_chunk_id(values):
    sha = F.lit("0123456789abcdef")
    assert values(tx.chunk_id("x", F.lit(7), sha), ["s"]) == ["s:000007:0123456789ab"]


def test_article_url(values):
    titles = random_texts(3000, "aZ9 éß😀/:@!$&'()*+,;=-._~%?#[]\"<>^`{|}\\", 20)
    keep = "/:@!$&'()*+,;=-._~"
    assert values(tx.article_url("https://x.org/w", "x"), titles) == [
        "https://x.org/w/" + quote(t.replace(" ", "_"), safe=keep) for t in titles
    ]


def test_nfc(values):
    texts = ["Café", "plain", None]
    assert values(tx.nfc("x"), texts) == ["Café", "plain", None]
    assert unicodedata.is_normalized("NFC", "Café")
