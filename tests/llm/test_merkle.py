"""The Merkle manifest against a tree built in memory."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle, queries

DDL = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def climb(leaves, fanout):
    """The root, and for every leaf its siblings as a list of (left, right)."""
    at, proofs, nodes = list(range(len(leaves))), [[] for _ in leaves], list(leaves)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            start = i - i % fanout
            proofs[k].append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + fanout])))
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], proofs


def brute(rows, fanout=3):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subroots, kept = [], []
    for s in order:
        mine = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        root, proofs = climb([leaf(*r) for r in mine], fanout)
        subroots.append(root)
        kept.append(list(zip(mine, proofs)))
    top, over = climb(subroots, fanout) if subroots else (None, [])
    out = []
    for sub, source_proof, found in zip(subroots, over, kept):
        for row, proof in found:
            whole = proof + source_proof
            text = row[1]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(row[0], text, *row[2:])
            for a, b in whole:
                node = h(a, node, b)
            out.append((row[0], leaf(*row), sub, top, h(*[a + b for a, b in whole]), node, node == top))
    return sorted(out, key=repr)


def found(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def rows_of(seed, sizes):
    pick = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = pick.choice([None, "", "a\nb", "é\n😀 long " * 30, "plain", "\n\n"])
            rows.append((pick.randrange(10**6), text, pick.choice([None, "en", "de"]), source, pick.choice([None, 3, -7])))
    pick.shuffle(rows)
    return rows


@pytest.fixture
def manifest(spark):
    def run(rows, **settings):
        df = spark.createDataFrame([(*r, "own", "column") for r in rows], DDL).repartition(3)
        hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
        tampered = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
        proven = merkle.audit(merkle.manifest(df, FIELDS, claimed={"text": tampered}, **settings))
        return proven.withColumn("proof_sha256", F.sha2(merkle.siblings(F.col("proof")), 256))

    return run


@pytest.mark.parametrize("levels, ranges", [(7, 50_000), (1, 13), (0, 40)])
def test_against_a_tree_in_memory(manifest, monkeypatch, levels, ranges):
    monkeypatch.setattr(merkle, "RANGE_ROWS", ranges)
    rows = rows_of(levels, {"b": 100, None: 20, "é": 1, "a": 28, "": 3, "B": 9, "z": 4})
    rows += [rows[0]] * 50 + [(None, "x", None, "a", 1), (None, "y", None, "a", 1), (rows[1][0], "other\n", "en", rows[1][3], 5)]
    assert found(manifest(rows, levels=levels)) == brute(rows)


def test_butterfly_of_every_size(spark):
    """Also of last subtrees with fewer partitions than the others."""
    states = [(k, i, k, h(f"{k} {i}")) for k in range(1, 32) for i in range(k)]
    got = merkle.butterfly(spark.createDataFrame(states, "tree long, part long, parts long, digest string")).collect()
    for tree in range(1, 32):
        k = tree
        root, proofs = climb([h(f"{tree} {i}") for i in range(k)], 3)
        mine = {r.part: (r.digest, [tuple(p) for p in r.proof]) for r in got if r.tree == tree}
        assert mine == {i: (root, proofs[i]) for i in range(k)}


def test_another_fanout(manifest):
    rows = rows_of(5, {"b": 77, "a": 5})
    got = manifest(rows, levels=2, fanout=4)
    assert found(got) == brute(rows, 4)


def test_single_and_empty(manifest):
    one = [(5, "t\n", "en", None, 2)]
    assert found(manifest(one)) == brute(one)
    assert found(manifest([])) == []


def test_the_query(spark, tmp_path):
    rows = rows_of(9, {"s1": 60, "s2": 7})
    spark.createDataFrame([(*r, "", "") for r in rows], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found(got) == brute(rows)
    assert {r.verified for r in got.collect()} == {True, False}
