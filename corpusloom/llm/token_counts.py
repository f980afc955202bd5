"""Token counts by a piece vocabulary, with rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens lie behind each other in one array of symbols. In each round every sequence finds the
lowest rank among its own pairs and merges that pair, all sequences at the same time; what is finished leaves the
arrays. What remains is counted: a known piece as one token, an unknown character as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpusloom.llm.common import extended, pieces, released, require
from corpusloom.llm.merging import NO_RANK, PairTable, leftmost_apart

BLANK = "▁"  # stands for a blank in pieces
REMEMBERED = 300_000  # pre-tokens a task keeps; more only cost time
LIMIT = 4096


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a model file with their scores.

    Control, unknown and byte pieces never match text. The file has to leave characters as they are, put a blank in
    front of a text, keep runs of blanks, and write unknown characters as bytes.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if sum(model.is_byte(i) for i in ids) != 256:
        raise ValueError("only vocabularies that write unknown characters as bytes")
    kept = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in kept]


class Counter:
    """Pre-tokens to token counts; `remembered` holds those seen so far."""

    def __init__(self, scored: list[tuple[str, float]]):
        names = [p for p, _ in scored]
        scores = np.array([s for _, s in scored])
        self.table = PairTable(names, np.unique(-scores, return_inverse=True)[1].astype(np.int32))
        self.symbol = {p: i for i, p in enumerate(names) if len(p) == 1}
        self.remembered: dict[str, int] = {}
        # a text may be cut in front of blanks if no piece holds a blank behind another character
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in names)
        self.runs = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")

    def words(self, text: str) -> list[str]:
        """A text as pre-tokens, none of whose neighbours can merge."""
        if not text:
            return []
        text = BLANK + text.replace(" ", BLANK)
        if not self.cuts:
            return [text]
        if BLANK + BLANK in text or text[-1] == BLANK:
            return self.runs.findall(text)
        return [BLANK + w for w in text[1:].split(BLANK)]

    def merged(self, words: list[str]) -> np.ndarray:
        """The number of symbols of each word after all merges, an unknown character counting as its bytes."""
        sizes = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, at = np.unique(code, return_inverse=True)
        known = np.array([self.symbol.get(chr(c), -1) for c in kinds], np.int32)
        width = np.array([1 if k >= 0 else len(chr(c).encode("utf-8", "surrogatepass")) for c, k in zip(kinds, known)], np.int64)
        symbol, word = known[at], np.repeat(np.arange(len(words)), sizes)
        count = np.bincount(word, width[at], len(words)).astype(np.int64)
        first, unmerged, starts = symbol, count.copy(), np.cumsum(sizes) - sizes
        alone: list[int] = []
        while len(symbol) > 1:
            made = np.append(self.table.look_up(symbol[:-1], symbol[1:]), np.int32(-1))
            made[:-1][word[1:] != word[:-1]] = -1
            rank = self.table.rank(made)
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(word))))
            busy = least < NO_RANK
            if not busy.any():
                break
            chosen = np.flatnonzero(busy & (rank == least))
            chosen = chosen[leftmost_apart(chosen, chosen + 1)]
            again = word[chosen[1:]] == word[chosen[:-1]]
            if again.any():  # a merge beside one place could come before the next place: such words go one by one
                several = chosen[np.isin(word[chosen], word[chosen[1:][again]])]
                new = made[several]
                left = np.where((several > 0) & (word[several - 1] == word[several]), symbol[several - 1], -1)
                beyond = np.minimum(several + 2, len(symbol) - 1)
                right = np.where((beyond == several + 2) & (word[beyond] == word[several]), symbol[beyond], -1)
                sides = [self.table.look_up(left, new), self.table.look_up(new, right), self.table.look_up(new, new)]
                early = np.any([self.table.rank(x) <= rank[several] for x in sides], axis=0)
                slow = np.unique(word[several[early]])
                if len(slow):
                    alone.extend(slow.tolist())
                    busy &= ~np.isin(word, slow)
                    chosen = chosen[busy[chosen]]
            count -= np.bincount(word[chosen], minlength=len(words))
            symbol = symbol.copy()
            symbol[chosen] = made[chosen]
            keep = busy.copy()
            keep[chosen + 1] = False
            symbol, word = symbol[keep], word[keep]
        for w in alone:
            a, b = starts[w], starts[w] + sizes[w]
            count[w] = unmerged[w] - (sizes[w] - len(self.table.merge_one(first[a:b].tolist())))
        return count

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.words(t) for t in texts]
        words = set().union(*cut)
        if len(self.remembered) + len(words) > REMEMBERED:
            self.remembered = {}
        missing = [w for w in words if w not in self.remembered]
        if missing:
            self.remembered.update(zip(missing, self.merged(missing).tolist()))
        known = self.remembered.__getitem__
        return [sum(map(known, c)) for c in cut]


def count_tokens(docs: DataFrame, model: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """`docs` with `n_bytes` (UTF-8), `n_tokens` and `over_limit` (n_tokens > `limit`).

    Tokens are those that the model file's library gives for the whole text, without begin and end marks; strings of
    control pieces inside a text are ordinary text. A null or empty text has none. All rows and other columns are
    kept; columns with the result's names are replaced. The vocabulary is read on the driver and sent to the tasks.
    """
    require(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(read_pieces(model))
    result = ["n_bytes", "n_tokens", "over_limit"]
    others = [c for c in docs.columns if c not in result]
    kind = extended(docs.select(*others), "n_bytes long, n_tokens long, over_limit boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in pieces(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            tokens = counter.counts(texts)
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
                names=[*others, *result],
            )

    return docs.select(*others).mapInArrow(released(run), kind)
