"""Vector expressions: hash embedding, normalisation, cosine, distance scores, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

# The hash embedder's size, ignored words, hint words and hint weight.
HASH_DIMENSIONS = 8
STOPWORDS = ("a", "an", "and", "for", "how", "in", "making", "methods", "of", "safe", "the", "to")
WATER_WORDS = ("water", "drinkable", "drinking", "purify", "purification")
BICYCLE_WORDS = ("bicycle", "chain", "repair", "gear", "derailleur")
HINT_WEIGHT = 3.0

_U32 = float(2**32)


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(value) for value in values])


def token_vector(token: Column | str) -> Column:
    """Eight numbers in [-1, 1): the token's SHA-256 read as big-endian unsigned 32-bit words."""
    return tx.let(F.sha2(tx.col(token), 256), lambda digest: F.array(*[
        F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") / F.lit(_U32) * 2.0 - 1.0
        for i in range(HASH_DIMENSIONS)
    ]))


def embedding_tokens(text: Column | str) -> Column:
    """Tokens without stopwords; the whole lowered text where none is left."""
    text = tx.col(text)
    stop = _words(STOPWORDS)
    kept = F.filter(tx.tokenize(text), lambda token: ~F.array_contains(stop, token))
    return tx.let(kept, lambda words: F.when(F.size(words) > 0, words).otherwise(F.array(F.lower(text))))


def hash_embed(text: Column | str, normalize: bool = True) -> Column:
    """Deterministic 8-dimensional embedding, null for empty text.

    Digest words are summed as integers, so the mean does not depend on token order. Two 32-bit
    words are decoded at a time from a signed 64-bit number.
    """
    text = tx.col(text)

    def mean_vector(words: Column) -> Column:
        digests = F.transform(words, lambda word: F.sha2(word, 256))

        def two_sums(hashed: Column, pair: int) -> Column:
            longs = F.transform(
                hashed, lambda digest: F.conv(F.substring(digest, 16 * pair + 1, 16), 16, -10).cast("bigint")
            )
            zero, low = F.lit(0).cast("bigint"), F.lit(2**32 - 1)
            return tx.let(longs, lambda xs: F.array(
                F.aggregate(xs, zero, lambda acc, x: acc + F.shiftrightunsigned(x, 32)),
                F.aggregate(xs, zero, lambda acc, x: acc + x.bitwiseAND(low)),
            ))

        def halves(hashed: Column) -> Column:
            return F.flatten(F.array(*[two_sums(hashed, pair) for pair in range(HASH_DIMENSIONS // 2)]))

        count = F.size(words)
        hints = [F.when(F.arrays_overlap(words, _words(w)), HINT_WEIGHT).otherwise(0.0) for w in (WATER_WORDS, BICYCLE_WORDS)]
        return tx.let(F.array(*hints), lambda boost: F.transform(
            tx.let(digests, halves),
            lambda total, i: (total / F.lit(_U32) * 2.0 - count) / count
            + F.when(i < HASH_DIMENSIONS // 2, boost[0]).otherwise(boost[1]),
        ))

    vector = tx.let(embedding_tokens(text), mean_vector)
    vector = l2_normalize(vector) if normalize else vector
    return F.when(F.length(text) > 0, vector)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vector: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    return tx.let(tx.col(vector), lambda v: tx.let(
        norm(v), lambda n: F.when(n == 0.0, v).otherwise(F.transform(v, lambda x: x / n))
    ))


def dot(left: Column | str, right: Column | str) -> Column:
    products = F.zip_with(tx.col(left), tx.col(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column | str, right: Column | str) -> Column:
    """Cosine similarity, 0.0 when either norm is 0; different sizes are an error."""
    left, right = tx.col(left), tx.col(right)
    lengths = norm(left) * norm(right)
    value = F.when(lengths == 0.0, F.lit(0.0)).otherwise(dot(left, right) / lengths)
    same = F.size(left) == F.size(right)
    return F.when(same, value).otherwise(F.raise_error(F.lit("vectors differ in dimensions")).cast("double"))


def distance_score(distance: Column | str, normalized: bool) -> Column:
    """Higher is better: `1 - d` in cosine space, `-d` in (squared) L2 space."""
    return F.lit(1.0) - tx.col(distance) if normalized else -tx.col(distance)


def vector_error(vector: Column | str, dimensions: int) -> Column:
    """Why a vector is unusable, null when it is fine."""
    vector = tx.col(vector)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        F.when(vector.isNull() | (F.size(vector) == 0), "empty")
        .when(F.size(vector) != dimensions, "dimension_mismatch")
        .when(~finite, "not_finite")
    )
