"""Toxic spans and document scores by a linear-chain conditional random field.

Only documents are labelled, so tokens get their labels from them first: a token of a toxic document is toxic if one
of its forms (the word, or a proper prefix of it) is far more frequent in toxic than in other documents, and so often
that chance does not explain it. A chain with
two tags is trained on these labels. Its forward-backward marginals give each token's chance to be toxic; their sum,
density and peak give the document's score through a logistic curve fitted on documents that the chain did not see.

Training takes a sample of at most MAX_ROWS labelled documents for each class (least hashes of the id first, none above
MAX_CHARS), on the driver; everything else is a map over whole texts.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import extended, free_name, pieces, released, require
from corpusloom.llm.shingles import mixed

MAX_ROWS = 1500
MAX_CHARS = 8_000
THRESHOLD = 0.3
SPAN = 0.5
FALSE_SHARE = 0.05  # of the forms found toxic that may be so by chance
LEAST_TEXTS = 3  # that have a form before it is tested
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7, 8)
PART_TOKENS = 1 << 16  # of the sample that are looked at together
REMEMBERED = 300_000  # words a task keeps; more only cost time
_BLOCK = 128
_words = re.compile(r"\w+").findall
_places = re.compile(r"\w+").finditer
_SALT = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93


def _hashes(code: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each stretch of characters."""
    total = np.zeros(len(begin), np.uint64)
    for k in range(int(length.max(initial=0))):  # as many steps as the longest stretch has characters
        more = np.flatnonzero(length > k)
        total[more] = mixed(total[more] * np.uint64(_STEP) + code[begin[more] + k])
    return total


def forms(words: list[str]) -> np.ndarray:
    """Bucket numbers of each word's forms: the word, its proper prefixes, its ending; 0 where there is none."""
    sizes = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(sizes) - sizes
    out = np.zeros((len(words), len(PREFIXES) + 2), np.int64)
    ending = np.minimum(sizes, 3)
    whole = np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    stretches = [(start, np.minimum(n, sizes), sizes > n) for n in PREFIXES] + [(start + sizes - ending, ending, sizes > 3)]
    for k, (value, has) in enumerate([(whole, sizes > 0), *[(_hashes(code, a, n), has) for a, n, has in stretches]]):
        value = mixed(value + np.uint64((k + 1) * _SALT % (1 << 64)))
        out[:, k] = np.where(has, value % np.uint64(BUCKETS - 1) + np.uint64(1), 0)
    return out


def _scan(m: np.ndarray) -> np.ndarray:
    """Row vectors v_t = v_(t-1) m_t from v = (1, 1), each scaled to a sum of 1; `m` has shape (n, 2, 2).

    Blocks are multiplied out side by side, then passed through in order, then filled in side by side.
    """
    n = len(m)
    blocks = -(-n // _BLOCK)
    padded = np.concatenate([m, np.broadcast_to(np.eye(2), (blocks * _BLOCK - n, 2, 2))]).reshape(blocks, _BLOCK, 2, 2)
    whole = padded[:, 0]
    for t in range(1, _BLOCK):
        whole = whole @ padded[:, t]
        whole = whole / whole.sum((1, 2), keepdims=True)
    enter = np.empty((blocks, 2))
    a, b = 0.5, 0.5
    for k, ((p, q), (r, s)) in enumerate(whole.tolist()):
        enter[k] = a, b
        a, b = a * p + b * r, a * q + b * s
        a, b = a / (a + b), b / (a + b)
    out = np.empty((blocks, _BLOCK, 2))
    now = enter
    for t in range(_BLOCK):
        now = (now[:, None] @ padded[:, t])[:, 0]
        now = now / now.sum(1, keepdims=True)
        out[:, t] = now
    return out.reshape(-1, 2)[:n]


class Chain(NamedTuple):
    """Weights of the forms, log weights of the steps between tags (from, to), of the first tag, and the score's curve."""

    weights: np.ndarray
    steps: np.ndarray
    first: float
    curve: np.ndarray


def marginals(emission: np.ndarray, starts: np.ndarray, steps: np.ndarray, first: float, pairs: bool = False):
    """For each token the chance of the toxic tag, given its whole text; `starts` are the texts' first tokens.

    With `pairs` also the summed chances of each step between tags, and of a toxic first tag.
    """
    n = len(emission)
    e = np.exp(np.clip(emission, -30, 30))
    m = np.empty((n, 2, 2))
    m[:, :, 0] = np.exp(steps[:, 0])
    m[:, :, 1] = np.exp(steps[:, 1]) * e[:, None]
    m[starts, :, 0] = 1
    m[starts, :, 1] = (np.exp(first) * e[starts])[:, None]
    forward = _scan(m)
    back = np.ones((n, 2, 2))
    back[:-1] = m[1:].transpose(0, 2, 1)
    last = np.append(starts[1:] - 1, n - 1)
    back[last] = 1
    backward = _scan(back[::-1])[::-1]
    both = forward * backward
    chance = both[:, 1] / both.sum(1)
    if not pairs:
        return chance
    inner = np.ones(n, bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    joint = forward[inner - 1][:, :, None] * m[inner] * backward[inner][:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return chance, joint.sum(0), chance[starts].sum()


def _in_parts(emission: np.ndarray, starts: np.ndarray, steps: np.ndarray, first: float):
    """`marginals` with pairs, over some texts at a time, so that a large sample needs little memory."""
    chances, joint, opening = [], np.zeros((2, 2)), 0.0
    k = 0
    while k < len(starts):
        after = max(k + 1, int(np.searchsorted(starts, starts[k] + PART_TOKENS, "right")) - 1)
        stop = starts[after] if after < len(starts) else len(emission)
        chance, own, begun = marginals(emission[starts[k] : stop], starts[k:after] - starts[k], steps, first, pairs=True)
        chances.append(chance)
        joint += own
        opening += begun
        k = after
    return np.concatenate(chances), joint, opening


def _summaries(chance: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text: logarithm of the summed toxic chances, their density, the peak, and 1; texts without tokens are zero."""
    out = np.zeros((len(sizes), 4))
    out[:, 3] = 1
    full = np.flatnonzero(sizes)
    if len(full):
        total = np.add.reduceat(chance**2, starts)  # squared, so that the tiny chances of a long text do not add up
        out[full, 0] = np.log(total + 0.01) - np.log(0.01)
        out[full, 1] = np.minimum(total / sizes[full] * 20, 1)
        out[full, 2] = np.maximum.reduceat(chance, starts)
    return out


def _copies(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each text number the least text that it shares one of four least 5-word runs with, directly or by others."""
    parent = np.arange(int(text.max(initial=-1)) + 1)
    at = np.flatnonzero(text[4:] == text[:-4]) if len(text) > 4 else np.zeros(0, np.int64)
    if not len(at):
        return parent
    run = np.zeros(len(at), np.uint64)
    for k in range(5):
        run = mixed(run * np.uint64(_STEP) + word[at + k].astype(np.uint64))
    owner, begin = np.unique(text[at], return_index=True)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for seed in range(4):
        least = np.minimum.reduceat(mixed(run + np.uint64((seed + 1) * _SALT % (1 << 64))), begin)
        first: dict[int, int] = {}
        for value, own in zip(least.tolist(), owner.tolist()):
            one, other = root(first.setdefault(value, own)), root(own)
            parent[max(one, other)] = min(one, other)
    return np.array([root(k) for k in range(len(parent))], np.int64)


def _by_chance(bad: np.ndarray, good: np.ndarray, share: float) -> np.ndarray:
    """The chance that of bad + good texts, each toxic with the chance `share`, `bad` or more are toxic."""
    n = (bad + good).astype(np.int64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(n.max(initial=0)) + 1)))])
    total = np.zeros(len(n))
    for k in range(int(good.max(initial=-1)) + 1):
        own = np.flatnonzero(good >= k)
        m = n[own]
        total[own] += np.exp(logs[m] - logs[k] - logs[m - k] + k * np.log1p(-share) + (m - k) * np.log(share))
    return np.minimum(total, 1.0)


def _token_labels(form: np.ndarray, word: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic texts with a form that toxic texts have far more often than others.

    Texts that are copies of one another but for some words count once. Forms are tested against chance; the bound is that
    of Benjamini and Hochberg, so that it does not depend on how many texts there are.
    """
    group = _copies(word, text)[text]
    either = [np.unique(group[toxic[text] == c]) for c in (False, True)]
    n_clean, n_toxic = (max(1, len(x)) for x in either)
    tied = np.unique(np.stack([group * 2 + toxic[text], word], 1), axis=0)
    seen = np.zeros((2, BUCKETS))
    for k in range(form.shape[1]):
        each = np.unique(np.stack([tied[:, 0], form[tied[:, 1], k]], 1), axis=0)
        for c in (0, 1):
            seen[c] += np.bincount(each[each[:, 0] % 2 == c, 1], minlength=BUCKETS)
    seen[:, 0] = 0
    tested = seen.sum(0) >= LEAST_TEXTS
    likely = np.flatnonzero(tested & (seen[1] >= LEAST_TEXTS) & (seen[1] / n_toxic >= 12 * seen[0] / n_clean))
    chance = _by_chance(seen[1, likely], seen[0, likely], n_toxic / (n_toxic + n_clean))
    order = np.argsort(chance, kind="stable")
    below = np.flatnonzero(chance[order] <= FALSE_SHARE * np.arange(1, len(order) + 1) / max(1, tested.sum()))
    marked = np.zeros(BUCKETS, bool)
    marked[likely[order[: below.max(initial=-1) + 1]]] = True
    return marked[form].any(1)[word] & toxic[text]


def _logistic(x: np.ndarray, t: np.ndarray, weight: np.ndarray, start: float) -> np.ndarray:
    """A weighted logistic regression by Newton steps, each halved until it lowers the loss, so that it cannot swing."""
    ridge = np.array([0.05, 0.05, 0.05, 1e-4])

    def loss(c: np.ndarray) -> float:
        z = x @ c
        return float(weight @ (np.logaddexp(0, z) - t * z) + 0.5 * ridge @ (c * c))

    curve = np.array([0.0, 0, 0, start])
    best = loss(curve)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -500, 500)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hessian, x.T @ (weight * (t - p)) - ridge * curve)
        while (now := loss(curve + move)) > best and np.abs(move).max() > 1e-9:
            move = move / 2
        if not now < best - 1e-10 * abs(best):
            break
        curve, best = curve + move, now
    return curve


def fit(texts: list[str], toxic: np.ndarray, prior: float, rounds: int = 40) -> Chain:
    """A chain from labelled texts; `prior` is the share of toxic texts where scores are to hold."""
    first_of = {t: k for k, t in reversed(list(enumerate(texts)))}  # copies of a text count once
    kept = sorted(first_of.values())
    texts, toxic = [texts[k] for k in kept], toxic[kept]
    nothing = Chain(np.zeros(BUCKETS, np.float32), np.zeros((2, 2)), 0.0, np.array([0, 0, 0, np.log(prior / (1 - prior))]))
    if len(texts) < 20 or toxic.all() or not toxic.any():
        return nothing
    cut = [_words(t.lower()) for t in texts]
    vocabulary: dict[str, int] = {}
    word = np.array([vocabulary.setdefault(w, len(vocabulary)) for c in cut for w in c], np.int64)
    sizes = np.array([len(c) for c in cut])
    text = np.repeat(np.arange(len(cut)), sizes)
    form = forms(list(vocabulary))
    seen = np.arange(len(texts)) % 4 != 0  # the others fit the curve
    train = seen[text]
    label = np.zeros(len(word), bool)
    label[train] = _token_labels(form, word[train], text[train], toxic)
    if not label.any():
        warnings.warn("no word is toxic beyond chance: every text gets the share of toxic labels as its score", stacklevel=2)
        return nothing

    def starts_of(chosen: np.ndarray) -> np.ndarray:
        own = sizes[chosen]
        return (np.cumsum(own) - own)[own > 0]

    starts, y, used = starts_of(seen), label[train], word[train]
    weights, steps, first = np.zeros(BUCKETS), np.array([[0.0, -4.0], [0.0, -4.0]]), -4.0
    count = np.bincount(used, minlength=len(form))
    inner = np.ones(len(y), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    observed = np.array([[np.sum((y[inner - 1] == a) & (y[inner] == b)) for b in (0, 1)] for a in (0, 1)], float)
    wanted = np.bincount(used, y, len(form))
    square = [np.full(BUCKETS, 1e-2), np.full((2, 2), 1.0)]
    for _ in range(rounds):
        chance, joint, opening = _in_parts(weights[form].sum(1)[used], starts, steps, first)
        by_word = wanted - np.bincount(used, chance, len(form))
        gradient = np.bincount(form.ravel(), np.repeat(by_word, form.shape[1]), BUCKETS) - 0.05 * weights
        gradient[0] = 0
        square[0] += gradient**2
        weights += 0.5 * gradient / np.sqrt(square[0])
        step = observed - joint
        square[1] += step**2
        steps += 0.2 * step / np.sqrt(square[1])
        first += 0.2 * np.sign(y[starts].sum() - opening) * min(1, abs(y[starts].sum() - opening) / (1 + y[starts].sum()))
    weights[0] = 0
    others = ~train
    chance = _in_parts(weights[form].sum(1)[word[others]], starts_of(~seen), steps, first)[0]
    x, t = _summaries(chance, starts_of(~seen), sizes[~seen]), toxic[~seen]
    balance = np.where(t, prior / max(t.mean(), 1e-6), (1 - prior) / max(1 - t.mean(), 1e-6))
    curve = _logistic(x, t.astype(float), balance, np.log(prior / (1 - prior)))
    return Chain(weights.astype(np.float32), steps, float(first), curve)


def held_out(id: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Chain:
    """Fit on at most `max_rows` labelled texts of either class; an id with several labels counts as toxic if one says so.

    Held-out rows, null ids, labels and texts, and texts over MAX_CHARS are not used. With fewer than 20 texts or one
    class only, every text gets the share of toxic labels as its score.
    """
    require(docs, id, text)
    require(labels, id, label)
    known = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(id)).groupBy(F.col(id).alias("id")).agg(F.max(label).alias("label"))
    counts = dict(known.groupBy(F.col("label") == 1).count().collect())
    bad, good = counts.get(True, 0), counts.get(False, 0)
    ranked = [known.filter(side).orderBy(F.xxhash64("id"), "id").limit(max_rows) for side in (F.col("label") == 1, F.col("label") != 1)]
    sample = ranked[0].union(ranked[1])
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(F.length("text") <= MAX_CHARS)
    chosen = rows.join(F.broadcast(sample), "id").dropDuplicates(["id"]).select("id", "text", (F.col("label") == 1).alias("bad"))
    found = sorted(chosen.collect(), key=lambda r: (str(r.id)[::-1], r.id))  # at most twice max_rows rows
    return fit([r.text for r in found], np.array([r.bad for r in found], bool), (bad + 0.1) / (bad + good + 1))


class Tagger:
    """Scores and spans of texts; remembers the emissions of words."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.remembered: dict[str, float] = {}

    def chances(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = set().union(*cut)
        if len(self.remembered) + len(words) > REMEMBERED:
            self.remembered = {}
        missing = [w for w in words if w not in self.remembered]
        if missing:
            self.remembered.update(zip(missing, self.chain.weights[forms(missing)].sum(1).tolist()))
        sizes = np.array([len(c) for c in cut])
        known = self.remembered.__getitem__
        emission = np.fromiter((x for c in cut for x in map(known, c)), np.float64, int(sizes.sum()))
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        if not len(emission):
            return emission, starts, sizes
        return marginals(emission, starts, self.chain.steps, self.chain.first), starts, sizes

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
        cut = [_words(t.lower()) for t in texts]
        chance, starts, sizes = self.chances(cut)
        score = 1 / (1 + np.exp(-np.clip(_summaries(chance, starts, sizes) @ self.chain.curve, -30, 30)))
        spans: list[list[dict]] = [[] for _ in texts]
        first = np.cumsum(sizes) - sizes
        for i in np.unique(np.searchsorted(first + sizes, np.flatnonzero(chance >= SPAN), "right")):
            own = chance[first[i] : first[i] + sizes[i]]
            places = [m.span() for m in _places(texts[i])]
            if len(places) != sizes[i]:  # lower case has split or joined a word
                places = [m.span() for m in _places(texts[i].lower())]
            at = np.flatnonzero(own >= SPAN)
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                spans[i].append({"start": places[run[0]][0], "stop": places[run[-1]][1], "chance": float(own[run].max())})
        return score, spans


SPANS = "array<struct<start:int,stop:int,chance:double>>"


def score(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `score` (0 to 1), `predicted` (1 from `threshold` on) and `spans`, the offending stretches of the
    text as offsets in characters with their highest chance.

    Null and empty texts have no tokens, no spans and the score of a text without toxic tokens. All rows and other
    columns are kept; columns with the result's names are replaced.
    """
    require(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    result = ["score", "predicted", "spans"]
    others = [c for c in docs.columns if c not in result]
    kind = extended(docs.select(*others), f"score double, predicted int, spans {SPANS}")
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value)
        for batch in pieces(batches, text):
            values, spans = tagger.score([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pa.array(values), pa.array((values >= threshold).astype(np.int32)), pa.array(spans, spans_type)],
                names=[*others, *result],
            )

    return docs.select(*others).mapInArrow(released(run), kind)


def drop_toxic(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """`docs` without the rows that `score` predicts to be toxic; columns are left as they are."""
    columns = docs.columns
    own = {c: free_name(docs, f"_{k}") for k, c in enumerate(columns) if c in ("score", "predicted", "spans")}
    renamed = docs.withColumnsRenamed(own)
    kept = score(renamed, chain, own.get(text, text)).filter("predicted = 0")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in columns])
