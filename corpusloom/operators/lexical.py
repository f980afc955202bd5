"""Term tables and term-overlap search.

A query token counts `1 + 0.1 * tf` in every chunk that has it, once per occurrence in the query;
there is no inverse document frequency and no length norm. Ten times that is a whole number, so
scores are added as integers: no summation order can change a tie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import blocked
from corpusloom.session import checked_keys, cut_lineage

# Ten times the base score of a present token, and of one occurrence.
BASE_SCORE_10 = 10
COUNT_SCORE_10 = 1
MAX_PUSHED_WORDS = 500  # so many words are also given to the postings scan, which then skips row groups
MAX_SUMMED_QUERIES = 64  # so many queries are a column of sums each in a look-up
_RUN = r"([^ ]++)(?: \1(?= |\z))*+"
_UNIT_PER_TENTH = blocked.SCORE_UNIT // 10
_PAIRS = 1 << 20  # of rare words, scored at a time
_WHOLE_FLOAT32 = 1 << 23  # whole numbers and halves below it are exact in single precision


def term_counts(tokens: Column) -> Column:
    """`array<struct<token, tf>>` of an array of words without blanks. Per row, so counting needs no shuffle.

    In the sorted words a token and its repeats are one run, so that a pass finds them all.
    """

    def counted(words: Column) -> Column:
        found = [F.regexp_extract_all(words, F.lit(_RUN), F.lit(group)) for group in (1, 0)]
        return F.zip_with(*found, lambda word, run: F.struct(
            word.alias("token"), ((F.length(run) + 1) / (F.length(word) + 1)).cast("int").alias("tf")
        ))

    return F.coalesce(tx.let(F.array_join(F.sort_array(tokens), " "), counted), F.array().cast("array<struct<token:string,tf:int>>"))


def term_table(chunks: DataFrame) -> DataFrame:
    """Forward index `(id, tokens, tfs)`: one narrow row per chunk, map-only."""
    counted = chunks.select("id", F.explode(F.array(term_counts(tx.tokenize("text")))).alias("_terms"))
    return counted.select("id", F.col("_terms.token").alias("tokens"), F.col("_terms.tf").alias("tfs"))


def postings(terms: DataFrame) -> DataFrame:
    """Inverted rows `(token, chunk_id, tf)` of a forward index."""
    return terms.select(F.inline(F.arrays_zip("tokens", "tfs")).alias("token", "tf"), F.col("id").alias("chunk_id")).select(
        "token", "chunk_id", "tf"
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """`(query_id, token, qtf)`: repeated query tokens keep their count."""
    return queries.select("query_id", F.inline(term_counts(tx.tokenize("text"))).alias("token", "qtf"))


def all_scores(posting_rows: DataFrame, query_term_rows: DataFrame, salts: int = 16) -> DataFrame:
    """Every `(query_id, chunk_id, score)` with a positive score.

    The result itself holds all matching pairs; use `search` for the k best. Query words are counted,
    and broadcast while they are few; then postings stay where they are and only partial sums are
    shuffled. Beyond that a frequent token would put its whole posting list into one task, so the token
    key is salted on the posting side (by chunk) and the short query side is repeated per salt.
    """
    asked = checked_keys(query_term_rows)
    if asked.small:
        matched = posting_rows.join(F.broadcast(asked.keys), "token")
    else:
        left = posting_rows.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int"))
        right = asked.keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        matched = left.join(right, ["token", "_salt"])
    tenths = F.sum(F.col("qtf") * (F.lit(BASE_SCORE_10) + F.col("tf") * COUNT_SCORE_10))
    return matched.groupBy("query_id", "chunk_id").agg((tenths / 10).alias("score"))


class TermScorer:
    """Scores a block of forward-index rows against a block of queries `(query_id, tokens, qtfs)`."""

    dense_share = 2000  # a token matching more than 1/2000 of a block's pairs goes through the matrix product

    def __init__(self):
        self._seen = None  # the block that was laid out last, as it meets many blocks of queries

    def learn(self, queries: pa.Table) -> None:
        self._vocabulary = pc.unique(queries.column("tokens").combine_chunks().flatten())

    def affinity(self, rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        """The token that a row has most often; of several the one that most rows have. Texts of a language share it."""
        tokens, counts = (_one(rows.column(name)) for name in ("tokens", "tfs" if "tfs" in rows.schema.names else "qtfs"))
        coded = tokens.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        found = np.full(rows.num_rows, -1)
        if len(code):
            size = _lengths(tokens)
            full = np.flatnonzero(size)
            common = np.bincount(code)
            rank = counts.flatten().to_numpy(zero_copy_only=False) + common[code] / (common.max() + 1)
            most = np.maximum.reduceat(rank, (np.cumsum(size) - size)[full])
            best = np.flatnonzero(rank == np.repeat(most, size[full]))
            found[np.repeat(np.arange(rows.num_rows), size)[best]] = code[best]
        return found

    def prepare(self, queries: pa.Table) -> dict:
        tokens = queries.column("tokens").combine_chunks()
        owner = np.repeat(np.arange(queries.num_rows), _lengths(tokens))
        number = pc.index_in(tokens.flatten(), self._vocabulary).to_numpy(zero_copy_only=False)
        words, term = np.unique(number, return_inverse=True)
        weights = queries.column("qtfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        by_term = np.argsort(term, kind="stable")
        return {
            "n": queries.num_rows,
            "words": words,
            "term": term[by_term],
            "owner": owner[by_term],
            "weight": weights[by_term].astype(np.float64),
            "start": np.searchsorted(term[by_term], np.arange(len(words) + 1)),
            "most": np.bincount(owner, weights, 1).max(),
        }

    def _block(self, items: pa.RecordBatch) -> dict:
        """The postings of a block in the order of its distinct tokens."""
        if self._seen is None or self._seen[0] is not items:
            tokens = items.column("tokens")
            coded = tokens.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            by_code = np.argsort(code, kind="stable")
            value = BASE_SCORE_10 + COUNT_SCORE_10 * items.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            start = np.searchsorted(code[by_code], np.arange(len(coded.dictionary) + 1))
            known = pc.index_in(coded.dictionary, self._vocabulary)
            asked = np.flatnonzero(pc.is_valid(known).to_numpy(zero_copy_only=False))
            code_of = np.full(len(self._vocabulary), -1)
            code_of[known.drop_null().to_numpy(zero_copy_only=False)] = asked
            self._seen = items, {
                "code_of": code_of,
                "words": len(coded.dictionary),
                "code": code[by_code],
                "chunk": np.repeat(np.arange(items.num_rows), _lengths(tokens))[by_code],
                "value": value[by_code],
                "start": start,
                "highest": np.maximum.reduceat(value[by_code], start[:-1]) if len(value) else value,
                "most": value.max(initial=0),
            }
        return self._seen[1]

    def _tenths(self, state: dict, items: pa.RecordBatch) -> np.ndarray:
        """Ten times the scores: whole numbers, in single precision while it holds them exactly."""
        block = self._block(items)
        kind = np.float32 if state["most"] * block["most"] < _WHOLE_FLOAT32 else np.float64
        code = block["code_of"][state["words"]]
        asked = np.diff(state["start"])
        word = np.flatnonzero((code >= 0) & (asked > 0))
        code = code[word]
        pairs = asked[word] * np.diff(block["start"])[code]
        dense = pairs * self.dense_share > state["n"] * items.num_rows
        if dense.any():
            n = int(dense.sum())
            of_term, of_code = np.full(len(state["words"]), -1), np.full(block["words"], -1)
            of_term[word[dense]] = of_code[code[dense]] = np.arange(n)
            left, right = np.zeros((state["n"], n), kind), np.zeros((n, items.num_rows), kind)
            at = of_term[state["term"]]
            left[state["owner"][at >= 0], at[at >= 0]] = state["weight"][at >= 0]
            at = of_code[block["code"]]
            right[at[at >= 0], block["chunk"][at >= 0]] = block["value"][at >= 0]
            tenths = left @ right
        else:
            tenths = np.zeros((state["n"], items.num_rows), kind)
        _add_pairs(tenths, state, block, word[~dense], code[~dense])
        return tenths

    def keys(self, state: dict, items: pa.RecordBatch) -> np.ndarray:
        scored = np.rint(self._tenths(state, items).astype(np.float64))
        return np.where(scored > 0, scored * _UNIT_PER_TENTH, blocked.NO_MATCH)

    def candidates(self, state: dict, items: pa.RecordBatch, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least = np.maximum(floor / _UNIT_PER_TENTH, 1) - 0.5  # scores are whole
        rows = np.flatnonzero(self._bounds(state, items) >= least)
        if not len(rows):
            return rows, rows, np.zeros(0)
        tenths = self._tenths(state if len(rows) == state["n"] else _of_queries(state, rows), items)
        least = least[rows].astype(tenths.dtype)
        reached = np.flatnonzero(tenths.max(axis=1) >= least)
        part = tenths[reached]
        query, column = np.nonzero(part >= least[reached, None])
        key = np.rint(part[query, column].astype(np.float64)) * _UNIT_PER_TENTH
        query = rows[reached[query]]
        enough = key >= floor[query]
        return query[enough], column[enough], key[enough]

    def _bounds(self, state: dict, items: pa.RecordBatch) -> np.ndarray:
        """For each query what no item of the block exceeds: all its words where they count most."""
        block = self._block(items)
        code = block["code_of"][state["words"]]
        there = np.flatnonzero(code >= 0)
        highest = np.zeros(len(code))
        highest[there] = block["highest"][code[there]]
        return np.bincount(state["owner"], state["weight"] * highest[state["term"]], state["n"])


def _of_queries(state: dict, rows: np.ndarray) -> dict:
    """The state of some of its queries."""
    place = np.full(state["n"], -1)
    place[rows] = np.arange(len(rows))
    owner = place[state["owner"]]
    mine = owner >= 0
    term = state["term"][mine]
    start = np.searchsorted(term, np.arange(len(state["words"]) + 1))
    return state | {"n": len(rows), "term": term, "owner": owner[mine], "weight": state["weight"][mine], "start": start}


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _add_pairs(tenths: np.ndarray, state: dict, block: dict, word: np.ndarray, code: np.ndarray) -> None:
    """Add the scores of rare words, pair by pair: every query that has the word by every chunk that has it."""
    begin, width = block["start"][code], np.diff(block["start"])[code]
    sizes = np.diff(state["start"])[word] * width
    ends = np.cumsum(sizes)
    flat, stride = tenths.reshape(-1), tenths.shape[1]
    at = 0
    while at < len(word):  # so many pairs at a time, or one word
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        part = slice(at, stop)
        of = np.repeat(np.arange(at, stop), sizes[part])
        query, chunk = np.divmod(np.arange(len(of)) - np.repeat(ends[part] - sizes[part] - (ends[at] - sizes[at]), sizes[part]), width[of])
        query += state["start"][word[of]]
        chunk += begin[of]
        cell = state["owner"][query] * stride + block["chunk"][chunk]
        np.add.at(flat, cell, (state["weight"][query] * block["value"][chunk]).astype(tenths.dtype))
        at = stop


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def search(
    terms: DataFrame, queries: DataFrame, k: int = 5, **layout: int
) -> tuple[DataFrame, int | None]:
    """The k best chunks of every query in `(query_id, text)`: `(query_id, id, score, rank)` rows.

    A query without tokens has no rows. `layout` goes to `blocked.top_k`.
    """
    check_limit(k)
    tokenized = queries.select("query_id", F.explode(F.array(term_counts(tx.tokenize("text")))).alias("_t"))
    asked = tokenized.filter(F.size("_t") > 0).select(
        "query_id", F.col("_t.token").alias("tokens"), F.col("_t.tf").alias("qtfs")
    )
    size = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda acc, word: acc + F.octet_length(word) + 16)
    return blocked.top_k(terms, asked, TermScorer(), k, size, **layout)


def lookup(posting_rows: DataFrame, queries: DataFrame, k: int = 5) -> tuple[DataFrame, int]:
    """`search` by way of the postings, for few queries.

    Few words become a filter of the postings scan: the table is sorted by token, so most row groups
    are skipped. Few queries are a column each, and a chunk's scores for all of them one row of sums. With more, every
    matching (query, chunk) pair is summed, which a large table of queries cannot afford; the results are those of `search`
    for any number of them.
    """
    check_limit(k)
    asked = cut_lineage(query_terms(queries), "asked")
    words = asked.select("token").distinct().limit(MAX_PUSHED_WORDS + 1).toPandas()["token"].tolist()
    if len(words) <= MAX_PUSHED_WORDS:
        posting_rows = posting_rows.filter(F.col("token").isin(words))
    ids = asked.select("query_id").distinct().limit(MAX_SUMMED_QUERIES + 1).collect()
    bound = queries.count() * k
    if 0 < len(ids) <= MAX_SUMMED_QUERIES and checked_keys(asked).small:
        return _ranked_sums(posting_rows, asked, [row["query_id"] for row in ids], k), bound
    found = all_scores(posting_rows, asked)
    return blocked.rank_rows(found.withColumnRenamed("chunk_id", "id"), k), bound


def _ranked_sums(posting_rows: DataFrame, asked: DataFrame, ids: list, k: int) -> DataFrame:
    """The k best chunks of each of these few queries; a posting meets all queries that ask for its word at once."""
    kind = asked.schema["query_id"].dataType
    known = [F.lit(id).cast(kind) for id in ids]
    number = F.coalesce(*[F.when(F.col("query_id").eqNullSafe(id), n) for n, id in enumerate(known)])
    columns = [f"_{n}" for n in range(len(ids))]
    weights = asked.groupBy("token").agg(*[F.sum(F.when(number == n, F.col("qtf"))).alias(c) for n, c in enumerate(columns)])
    value = F.lit(BASE_SCORE_10) + F.col("tf") * COUNT_SCORE_10
    summed = posting_rows.join(F.broadcast(weights), "token").groupBy(F.col("chunk_id").alias("id")).agg(
        *[F.sum(F.col(c) * value).alias(c) for c in columns]  # null if the query has no word of the chunk
    )
    pairs = summed.unpivot("id", columns, "_column", "tenths").filter(F.col("tenths").isNotNull())
    scored = pairs.select(F.substring("_column", 2, 9).cast("int").alias("_number"), "id", (F.col("tenths") / 10).alias("score"))
    ranked = blocked.rank_rows(scored, k, partition="_number")
    return ranked.select(F.get(F.array(*known), F.col("_number")).alias("query_id"), "id", "score", "rank")


def search_chunks(terms: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 5, **layout: int) -> DataFrame:
    """`search` with the columns of a search result: rank, score, id, title, source, chunk_index, text."""
    return _with_texts(search(terms, queries, k, **layout), chunks)


def lookup_chunks(posting_rows: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """`lookup` with the columns of a search result."""
    return _with_texts(lookup(posting_rows, queries, k), chunks)


def _with_texts(found: tuple[DataFrame, int | None], chunks: DataFrame) -> DataFrame:
    ranked, bound = found
    return blocked.attach(ranked, bound, chunks, ["title", "source", "chunk_index", "text"]).select(
        "query_id", "rank", "score", "id", "title", "source", "chunk_index", "text"
    )


def check_limit(limit: int) -> None:
    if limit <= 0:
        raise ValueError("limit must be greater than 0")


def shape_results(results: DataFrame, queries: DataFrame, mode: str, score_semantics: str) -> DataFrame:
    """Search results as reported to a caller: the query, its result count, mode and score meaning."""
    count = F.max("rank").over(Window.partitionBy("query_id")).cast("bigint")  # the few results of a query
    return (
        results.withColumn("result_count", count)
        .join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        .select(
            "query_id", "query", "rank", "score", "id", "title", "source", "chunk_index",
            tx.snippet("text").alias("snippet"), "result_count",
            F.lit(mode).alias("mode"), F.lit(score_semantics).alias("score_semantics"),
        )
    )
