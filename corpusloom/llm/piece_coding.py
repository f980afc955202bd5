"""Encoding and decoding by a piece vocabulary, with vectorised merge rounds.

A batch's distinct words lie behind each other in one flat array of symbols, cut wherever two characters stand beside
each other that no piece holds: no merge can reach over such a place. In each round every segment finds the least rank of
its pairs, all pairs of that rank merge at once from left to right, and the arrays are compacted; what has no pair left
is done. Texts are then strings of known words.

Merging all pairs of the least rank at once differs from merging them one by one only if a merge makes a pair with a
neighbour that comes before the next of them. A round therefore ends at the first such place of a segment.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import extended, free_name, pieces, released, require, sha256_joined
from corpusloom.llm.merging import NO_RANK, PairTable, leftmost_apart

BLANK = "▁"  # stands for a blank in pieces
UNKNOWN_SURFACE = " ⁇ "  # what the unknown id gives back
REMEMBERED = 300_000  # words a task keeps; more only cost time
ROUNDS = 2_000  # after so many a segment is merged pair by pair
_FEW_KINDS = 1_500
_SHORT_WORD = 256  # characters up to which a word is remembered


class Vocabulary:
    """What a model file says of its ids.

    Texts have to be taken as they are, with a blank put in front, and unknown characters written as bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names: list[str] = []  # of pieces that merge
        self.ids: list[int] = []
        scores = []
        self.surface: list[bytes] = []  # by id, what it gives back; blanks are blanks
        self.raw = bytearray(model.get_piece_size())  # by id, whether it is a byte
        self.blank_first = bytearray(model.get_piece_size())
        self.byte_id = [-1] * 256
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.raw[i] = 1
                self.surface.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i):
                self.surface.append(b"")
            elif model.is_unknown(i):
                self.surface.append(UNKNOWN_SURFACE.encode())
            elif model.is_unused(i):
                raise ValueError("unused pieces are not supported")
            else:
                self.surface.append(name.replace(BLANK, " ").encode())
                self.blank_first[i] = name.startswith(BLANK)
                self.names.append(name)
                self.ids.append(i)
                scores.append(model.get_score(i))
        if min(self.byte_id) < 0:
            raise ValueError("only vocabularies that write unknown characters as bytes")
        as_they_are = all(model.decode(model.encode(x)) == x for x in ("a  b ", "Ａ\t①\n"))
        if not as_they_are or not model.id_to_piece(model.encode("a")[0]).startswith(BLANK):
            raise ValueError("only vocabularies that take texts as they are and put a blank in front")
        self.ranks = np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int32)


class Coder:
    """Words to ids, and ids to bytes; `remembered` holds words seen so far as the bytes of 32-bit ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.known = vocabulary
        names = vocabulary.names
        self.table = PairTable(names, vocabulary.ranks)
        self.id_of = np.array(vocabulary.ids, np.int32)
        self.symbol = {ord(p): i for i, p in enumerate(names) if len(p) == 1}
        beside = {ord(p[i]) << 32 | ord(p[i + 1]) for p in names for i in range(len(p) - 1)}
        self.beside = np.array(sorted(beside), np.int64)
        # a text may be cut in front of blanks if no piece holds a blank behind another character
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in names)
        self.runs = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.remembered: dict[str, bytes] = {}
        self.control = np.array([not s for s in vocabulary.surface])

    # encoding -------------------------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """A text, with a blank in front, as words that no merge connects."""
        if not text:
            return []
        text = BLANK + text.replace(" ", BLANK)
        return self.runs.findall(text) if self.cuts else [text]

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, at = np.unique(code, return_inverse=True)
        at = at.astype(np.int32)
        of_kind = np.array([self.symbol.get(int(c), -1) for c in kinds], np.int32)
        symbol, n = of_kind[at], len(code)
        first = np.cumsum(sizes) - sizes
        opens = np.zeros(n, bool)
        opens[first] = True
        made, apart = self._first_pairs(kinds, of_kind, at)
        opens[1:] |= apart
        made = np.append(np.where(opens[1:], np.int32(-1), made), np.int32(-1))
        segment = np.cumsum(opens, dtype=np.int32)
        final = symbol.copy()  # by place of the first character: the symbol there, -2 inside of one
        self._rounds(symbol, made, segment, np.arange(n, dtype=np.int32), final)
        return self._ids(final, code, first)

    def _first_pairs(self, kinds: np.ndarray, of_kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For neighbouring characters what they make, and whether no piece holds them beside each other."""

        def look_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pair = kinds[a].astype(np.int64) << 32 | kinds[b]
            place = np.searchsorted(self.beside, pair)
            place[place == len(self.beside)] = 0
            apart = self.beside[place] != pair if len(self.beside) else np.ones(len(pair), bool)
            return self.table.look_up(of_kind[a], of_kind[b]), apart

        many = len(kinds)
        if many > _FEW_KINDS:
            return look_up(at[:-1], at[1:])
        pair = at[:-1] * np.int32(many) + at[1:]  # few characters: each pair is looked up once
        there = np.flatnonzero(np.bincount(pair, minlength=many * many))
        made, apart = np.full(many * many, -1, np.int32), np.ones(many * many, bool)
        made[there], apart[there] = look_up(there // many, there % many)
        return made[pair], apart[pair]

    def _rounds(self, symbol: np.ndarray, made: np.ndarray, segment: np.ndarray, place: np.ndarray, final: np.ndarray) -> None:
        """Merge in rounds; `made` has what a symbol and the next one make. What a merge leaves is written to `final`
        where it begins."""
        for _ in range(ROUNDS):
            if not len(symbol):
                return
            rank = self.table.rank(made)
            begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            least = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(segment)))
            keep = np.repeat(least < NO_RANK, length)
            chosen = np.flatnonzero(keep & (rank == np.repeat(least, length)))
            if not len(chosen):
                return
            chosen = chosen[leftmost_apart(chosen, chosen + 1)]
            chosen = self._until_early(chosen, made, symbol, segment, rank)
            final[place[chosen]] = made[chosen]
            final[place[chosen + 1]] = -2
            symbol[chosen] = made[chosen]
            keep[chosen + 1] = False
            now = (np.cumsum(keep, dtype=np.int32) - 1)[chosen]
            symbol, segment, place, made = symbol[keep], segment[keep], place[keep], made[keep]
            touched = np.concatenate([now, now[now > 0] - 1])
            behind = np.minimum(touched + 1, len(symbol) - 1)
            inside = (segment[behind] == segment[touched]) & (behind > touched)
            made[touched] = np.where(inside, self.table.look_up(symbol[touched], symbol[behind]), -1)
        for s in np.split(np.arange(len(segment)), np.flatnonzero(np.diff(segment)) + 1):
            self._one_by_one(symbol[s], place[s], final)

    def _until_early(self, chosen: np.ndarray, made: np.ndarray, symbol: np.ndarray, segment: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of the places to merge, those up to the first of each segment that makes a pair which comes before the next."""
        of = segment[chosen]
        if len(of) < 2 or not (of[1:] == of[:-1]).any():
            return chosen
        new, last = made[chosen], len(symbol) - 1
        before, behind = np.maximum(chosen - 1, 0), np.minimum(chosen + 2, last)
        left = np.where((chosen > 0) & (segment[before] == of), symbol[before], -1)
        right = np.where((chosen + 2 <= last) & (segment[behind] == of), symbol[behind], -1)
        sides = [self.table.look_up(left, new), self.table.look_up(new, right), self.table.look_up(new, new)]
        early = np.any([self.table.rank(s) <= rank[chosen] for s in sides], axis=0)
        if not early.any():
            return chosen
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        earlier = np.cumsum(early) - early  # early places before this one, over all segments
        return chosen[earlier == np.repeat(earlier[begin], np.diff(np.append(begin, len(of))))]

    def _one_by_one(self, symbols: np.ndarray, place: np.ndarray, final: np.ndarray) -> None:
        merged = self.table.merge_one(symbols.tolist())
        final[place] = -2
        at = 0
        for s in merged:  # a symbol covers as many of the given ones as make up its string
            final[place[at]] = s
            if s < 0:
                at += 1
                continue
            missing = len(self.known.names[s])
            while missing > 0:
                missing -= len(self.known.names[symbols[at]])
                at += 1

    def _ids(self, final: np.ndarray, code: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The ids of all words, unknown characters as the ids of their bytes."""
        kept = np.flatnonzero(final != -2)
        symbol = final[kept]
        unknown = np.flatnonzero(symbol < 0)
        ids = self.id_of[symbol]
        count = np.ones(len(kept), np.int64)
        if len(unknown):
            spelled = [[self.known.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in code[kept[unknown]].tolist()]
            count[unknown] = [len(s) for s in spelled]
            start = np.cumsum(count) - count
            ids = np.repeat(ids, count)
            ids[np.repeat(start[unknown], count[unknown]) + np.concatenate([np.arange(len(s)) for s in spelled])] = np.concatenate(spelled)
        total = np.concatenate([[0], np.cumsum(count)])
        starts = total[np.searchsorted(kept, first)] * 4
        flat = ids.astype(np.int32).tobytes()
        ends = [*starts[1:].tolist(), len(flat)]
        return [flat[a:b] for a, b in zip(starts.tolist(), ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as the bytes of 32-bit numbers."""
        cut = [self.words(t) for t in texts]
        words = set().union(*cut)
        missing = [w for w in words if w not in self.remembered]
        if len(self.remembered) + len(missing) > REMEMBERED:
            self.remembered, missing = {}, list(words)
        known = self.remembered
        known.update(zip(missing, self.merged(missing)))
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        for w in missing:
            if len(w) > _SHORT_WORD:
                del known[w]
        return out

    # decoding -------------------------------------------------------------------------------------
    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for, as the library gives it; bytes that are no characters become U+FFFD each."""
        if not len(ids):
            return ""
        if ids.min() < 0:
            raise ValueError("ids are 0 or more")
        known, control = self.known, self.control[ids]
        if control.any():
            return self._decode_runs(ids[np.argmin(control) :].tolist() if not control.all() else [])
        listed = ids.tolist()
        whole = b"".join(map(known.surface.__getitem__, listed))
        try:
            return (whole[1:] if known.blank_first[listed[0]] else whole).decode()
        except UnicodeDecodeError:
            return self._decode_runs(listed)

    def _decode_runs(self, ids: list[int]) -> str:
        known, parts, run = self.known, [], bytearray()
        for k, i in enumerate([*ids, -1]):
            if i >= 0 and known.raw[i]:
                run += known.surface[i]
                continue
            while run:
                size = _character(run)
                parts.append(run[:size].decode() if size else "�")
                del run[: size or 1]
            if i >= 0:
                surface = known.surface[i]
                parts.append(surface[1:].decode() if k == 0 and known.blank_first[i] else surface.decode())
        return "".join(parts)


def _character(run: bytearray) -> int:
    """Bytes of the UTF-8 character at the start, 0 if there is none."""
    for size in range(1, 5):
        try:
            bytes(run[:size]).decode()
            return min(size, len(run))
        except UnicodeDecodeError:
            continue
    return 0


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoding(docs: DataFrame, model: str, text: str, ids: str, kept: list[str]) -> Run:
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent.value)
        for batch in pieces(batches, text):
            found = coder.encode([t or "" for t in batch.column(text).to_pylist()])
            at = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
            values = pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], values], names=[*kept, ids])

    return run


def _decoding(docs: DataFrame, model: str, ids: str, decoded: str, kept: list[str]) -> Run:
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent.value)
        for batch in batches:
            out = [coder.decode(row.values.to_numpy()) if row.is_valid else None for row in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.string())], names=[*kept, decoded])

    return run


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with a column `ids`, array<int>: the whole text as the model file's library encodes it, without marks of
    begin and end and without sampling.

    A null or empty text has no ids; strings of control pieces inside a text are ordinary text. All rows and columns
    are kept as they are; a column named as `ids` is replaced. The vocabulary is read on the driver and sent to the tasks.
    """
    require(docs, text)
    others = [c for c in docs.columns if c != ids]
    kept = docs.select(*others)
    return kept.mapInArrow(released(_encoding(docs, model, text, ids, others)), extended(kept, f"`{ids}` array<int>"))


def decode(docs: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`docs` with a column `decoded`: the text that `ids` stand for.

    Null ids give null, none give an empty text; an id that the vocabulary does not hold is an error. All rows and other
    columns are kept; a column named as `decoded` is replaced.
    """
    require(docs, ids)
    others = [c for c in docs.columns if c != decoded]
    kept = docs.select(*others)
    return kept.mapInArrow(released(_decoding(docs, model, ids, decoded, others)), extended(kept, f"`{decoded}` string"))


def encode_and_decode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`decode` of `encode`, in one worker, with `ids` and `decoded` in place of the text."""
    require(docs, text)
    others = [c for c in docs.columns if c not in (ids, decoded, text)]
    coding = _encoding(docs, model, text, ids, others)
    decoding = _decoding(docs, model, ids, decoded, [*others, ids])
    kind = extended(docs.select(*others), f"`{ids}` array<int>, `{decoded}` string")
    return docs.select(*others, text).mapInArrow(released(lambda batches: decoding(coding(batches))), kind)


def round_trip(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(`id`, `n_tokens`, `ids_sha256`, `decoded_sha256`) of every row: digests of the ids and of the text they give back."""
    rows = docs.select(id, text)
    ids, decoded = free_name(rows, "ids"), free_name(rows, "decoded")
    return encode_and_decode(rows, model, text, ids, decoded).select(
        id, F.size(ids).cast("long").alias("n_tokens"), sha256_joined(F.col(ids)).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"),
    )
