"""Byte-level BPE by replaying the merges over a table of distinct words.

A task takes the texts of up to 4 MB, cuts them by the vocabulary's pattern and keeps each distinct word that it does
not know yet once, as a row of symbols. An inverted index leads from each pair of neighbouring symbols, by the rank of
its merge, to its places in that table. Merges are applied in rank order to all their places at once, and only the pairs
left and right of a merged place are looked up anew and entered. Documents are then strings of known words.

There is no shuffle: the table belongs to the task. A table of the whole corpus would have to be joined to every word
of every document. Which words are remembered never changes a result.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import extended, filled, free_name, pieces, released, require, sha256_joined
from corpusloom.llm.merging import PairTable, leftmost_apart

CORPUS_BYTES = 4 << 20
_STEP = 1 << 18
REMEMBERED = 300_000  # words after which a task forgets those it knows; more only cost time


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in the order of their ids. Ids have to be gapless and hold all single bytes."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                tokens[int(rank)] = base64.b64decode(token)
    out = [tokens[i] for i in range(len(tokens))]
    if len({t for t in out if len(t) == 1}) != 256:
        raise ValueError("a byte-level vocabulary holds every byte")
    return out


class Encoder:
    """Words to ids. Words seen so far have numbers, that of word `n` has the ids `ids[ends[n] : ends[n + 1]]`."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.find = regex.compile(pattern).findall
        self.table = PairTable(tokens, np.arange(len(tokens)))
        self.byte = np.zeros(256, np.int32)
        for i, token in enumerate(tokens):
            if len(token) == 1:
                self.byte[token[0]] = i
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int32)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words behind each other and how many each has, by all merges in rank order over the whole table."""
        sizes = np.array([len(w) for w in words], np.int32)
        if not len(words):
            return np.zeros(0, np.int32), sizes
        ends = np.cumsum(sizes + 1)
        n = int(ends[-1])
        joined = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        symbol = self.byte[joined]
        symbol[ends - 1] = -1  # a stop behind each word
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes + 1)
        before, after = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        made = np.full(n, -1, np.int32)
        for k in range(0, n - 1, _STEP):  # in steps, as the look-up needs room
            at = slice(k, min(k + _STEP, n - 1))
            made[at] = self.table.look_up(symbol[at], symbol[k + 1 : at.stop + 1])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = made[at]
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            for i, r in enumerate(rank[cuts[:-1]].tolist()):
                places = at[cuts[i] : cuts[i + 1]]
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(queue, r)

        some = np.flatnonzero(made >= 0)
        if len(some):
            enter(some.astype(np.int32))
        alone: set[int] = set()
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank)
            at = places[0] if len(places) == 1 else _distinct(np.concatenate(places))
            at = at[made[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at = at[leftmost_apart(at, after[at])]
                again = word[at[1:]] == word[at[:-1]]
                if again.any():  # a merge beside one place could come before the next place: such words go one by one
                    several = np.unique(word[at[1:][again]])
                    mine = at[np.isin(word[at], several)]
                    new = np.full(len(mine), rank, np.int32)
                    left, right = before[mine], after[after[mine]]
                    sides = [self.table.look_up(symbol[left], new), self.table.look_up(new, symbol[right]), self.table.look_up(new, new)]
                    early = np.any([(s >= 0) & (s < rank) for s in sides], axis=0)
                    if early.any():
                        slow = np.unique(word[mine[early]])
                        alone.update(slow.tolist())
                        for w in slow:
                            made[ends[w] - sizes[w] - 1 : ends[w]] = -1
                        at = at[made[at] == rank]
                        if not len(at):
                            continue
            gone = after[at]
            symbol[at], symbol[gone] = rank, -2
            made[gone] = -1
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            touched = _distinct(np.concatenate([at, left[left >= 0]]))
            now = self.table.look_up(symbol[touched], symbol[after[touched]])
            made[touched] = now
            touched = touched[now >= 0]
            if len(touched):
                enter(touched)
        for w in alone:
            at = int(ends[w] - sizes[w] - 1)
            merged = self.table.merge_one(self.byte[np.frombuffer(words[w], np.uint8)].tolist())
            symbol[at : ends[w] - 1] = -2
            symbol[at : at + len(merged)] = merged
        keep = symbol >= 0
        return symbol[keep], np.add.reduceat(keep, ends - sizes - 1, dtype=np.int32)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as the bytes of 32-bit numbers."""
        ids, at = self.coded(texts)
        return [ids[a:b].tobytes() for a, b in itertools.pairwise(at.tolist())]

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts behind each other, and where those of each end, with a 0 in front."""
        if len(self.number) > REMEMBERED:
            self.forget()
        number, known = self.number, len(self.number)  # each distinct word is held once, a text as its words' numbers
        cut = [np.fromiter(map(number.__getitem__, found), np.int32, len(found)) for found in map(self.find, texts)]
        ids, lengths = self.replay([w.encode() for w in itertools.islice(number, known, None)])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths, dtype=np.int32)])
        words = np.concatenate([np.zeros(0, np.int32), *cut])
        at, place = gathered(self.ends, words)
        return self.ids[place], at[np.cumsum([0, *map(len, cut)])]


def _distinct(places: np.ndarray) -> np.ndarray:
    """Sorted and each once; on short arrays faster than `np.unique`."""
    places.sort()
    first = np.ones(len(places), bool)
    np.not_equal(places[1:], places[:-1], out=first[1:])
    return places[first]


def gathered(ends: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a choice of runs `ends[i] : ends[i + 1]`: where each ends when they lie behind each other, with a 0 in front, and
    the places of all of them."""
    begin = ends[chosen]
    at = np.zeros(len(chosen) + 1, np.int64)
    np.cumsum(ends[chosen + 1] - begin, out=at[1:])
    if at[-1] >= 1 << 31:
        raise ValueError("more than 2 GB in one batch")
    at = at.astype(np.int32)
    return at, np.repeat(begin - at[:-1], np.diff(at)) + np.arange(at[-1], dtype=np.int32)


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoding(docs: DataFrame, ranks: str, pattern: str, text: str, ids: str, kept: list[str]) -> Run:
    sent = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*sent.value)
        for batch in pieces(filled(batches, text, CORPUS_BYTES), text, CORPUS_BYTES):
            found, at = encoder.coded([t or "" for t in batch.column(text).to_pylist()])
            values = pa.ListArray.from_arrays(at, pa.array(found))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], values], names=[*kept, ids])

    return run


def _decoding(docs: DataFrame, ranks: str, ids: str, decoded: str, kept: list[str]) -> Run:
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(sent.value), np.uint8)
        ends = np.cumsum([0, *map(len, sent.value)], dtype=np.int32)
        for batch in batches:
            column = batch.column(ids)
            numbers = column.flatten().to_numpy()  # of null rows nothing
            if len(numbers) and numbers.min() < 0:
                raise ValueError("ids are 0 or more")
            at, place = gathered(ends, numbers)
            rows = np.cumsum([0, *pc.fill_null(pc.list_value_length(column), 0).to_pylist()])
            out = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(at[rows]), pa.py_buffer(data[place])])
            if column.null_count:
                out = pc.if_else(column.is_valid(), out, None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], out], names=[*kept, decoded])

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with a column `ids`, array<int>: the whole text by the rank file at `ranks`, each match of `pattern` by itself.

    Equal to what the file's library gives without special tokens. A null or empty text has no ids. All rows and
    columns are kept as they are; a column named as `ids` is replaced. The vocabulary is read on the driver and sent to
    the tasks.
    """
    require(docs, text)
    others = [c for c in docs.columns if c != ids]
    kept = docs.select(*others)
    return kept.mapInArrow(released(_encoding(docs, ranks, pattern, text, ids, others)), extended(kept, f"`{ids}` array<int>"))


def decode(docs: DataFrame, ranks: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`docs` with a column `decoded`, binary: the bytes that `ids` stand for.

    Null ids give null, none give no bytes; an id that the vocabulary does not hold is an error. All rows and other
    columns are kept; a column named as `decoded` is replaced.
    """
    require(docs, ids)
    others = [c for c in docs.columns if c != decoded]
    kept = docs.select(*others)
    return kept.mapInArrow(released(_decoding(docs, ranks, ids, decoded, others)), extended(kept, f"`{decoded}` binary"))


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`decode` of `encode`, in one worker, with `ids` and `decoded` in place of the text."""
    require(docs, text)
    others = [c for c in docs.columns if c not in (ids, decoded, text)]
    coding = _encoding(docs, ranks, pattern, text, ids, others)
    decoding = _decoding(docs, ranks, ids, decoded, [*others, ids])
    kind = extended(docs.select(*others), f"`{ids}` array<int>, `{decoded}` binary")
    return docs.select(*others, text).mapInArrow(released(lambda batches: decoding(coding(batches))), kind)


def round_trip(docs: DataFrame, ranks: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(`id`, `n_tokens`, `ids_sha256`, `decoded_sha256`) of every row: digests of the ids and of the bytes they give back."""
    rows = docs.select(id, text)
    ids = free_name(rows, "ids")
    decoded = free_name(rows, "decoded")
    return encode_and_decode(rows, ranks, pattern, text, ids, decoded).select(
        id, F.size(ids).cast("long").alias("n_tokens"), sha256_joined(F.col(ids)).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"),
    )
