"""Embedding, vector search, prompt and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    SQL_CHUNKS, chunks, query, scratch, sql_lexical_hits, stored_terms, table, user_turns, vectors,
)
from corpusloom import schemas
from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vx
from corpusloom.operators import cells, evaluate, lexical, rag
from corpusloom.operators import vectors as vec
from corpusloom.plans import index_store, vector_cells
from corpusloom.session import cut_lineage
from corpusloom.sources.lines import with_positions

# SQL twin of the hash embedder -------------------------------------------------------------------
_STOP = "['" + "','".join(vx.STOPWORDS) + "']"
_WATER = "['" + "','".join(vx.WATER_WORDS) + "']"
_BIKE = "['" + "','".join(vx.BICYCLE_WORDS) + "']"


def sql_embedding(tables: str, key: str = "id") -> str:
    """CTEs from a `texts(key, text)` relation to `embedded(key, embedding)`."""
    word = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: NOT list_contains(" + _STOP + ", t))"
    parts = ", ".join(
        f"sum(('0x' || substring(sha256(token), {8 * i + 1}, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1) / count(*)"
        f" + 3.0::DOUBLE * max(list_contains({_WATER if i < 4 else _BIKE}, token)::INT)"
        for i in range(8)
    )
    return f"""{tables}, kept AS (SELECT {key}, text, {word} AS words FROM texts WHERE length(text) > 0),
exploded AS (SELECT {key}, unnest(CASE WHEN len(words) > 0 THEN words ELSE [lower(text)] END) AS token FROM kept),
means AS (SELECT {key}, [{parts}] AS v FROM exploded GROUP BY {key}),
embedded AS (SELECT {key}, v AS raw, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS embedding FROM means)"""


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rounded(column: str, digits: int = 6):
    """One text per vector, so that values compare exactly after rounding."""
    return F.array_join(F.transform(column, lambda x: F.format_string(f"%.{digits}f", F.round(x, digits) + 0.0)), " ")


def sql_rounded(column: str, digits: int = 6) -> str:
    return f"array_to_string(list_transform({column}, lambda x: printf('%.{digits}f', round(x, {digits}) + 0.0)), ' ')"


@query("token_vectors", f"""
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
v AS (SELECT token, [{", ".join(f"('0x' || substring(sha256(token), {8 * i + 1}, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1" for i in range(8))}] AS v FROM t)
SELECT token, {sql_rounded("v", 8)} AS vector FROM v""")
def token_vectors(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(tx.tokenize("text")).alias("token")).distinct()
    return tokens.withColumn("v", vx.token_vector("token")).select("token", rounded("v", 8).alias("vector"))


_TEXTS = "WITH texts AS (SELECT doc_id AS id, text FROM documents)"


@query("hash_embed", f"""
{sql_embedding(_TEXTS)}
SELECT id AS doc_id, {sql_rounded("embedding")} AS unit_vector, {sql_rounded("raw")} AS raw_vector FROM embedded""")
def hash_embed(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", vx.hash_embed("text").alias("unit"), vx.hash_embed("text", normalize=False).alias("raw")
    )
    return rows.select("doc_id", rounded("unit").alias("unit_vector"), rounded("raw").alias("raw_vector"))


_SCALED = "(vec_id % 7)"  # a few zero vectors


@query("l2_normalize", f"""
WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * {_SCALED}) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM s)
SELECT vec_id, {sql_rounded("CASE WHEN n = 0 THEN v ELSE list_transform(v, lambda y: y / n) END")} AS vector FROM n""")
def l2_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (F.col("vec_id") % 7))
    return rows.select("vec_id", vx.l2_normalize(scaled).alias("v")).select("vec_id", rounded("v").alias("vector"))


@query("embed_udf", """SELECT doc_id, length(text) AS first, len(string_split(text, ' ')) AS second FROM documents""")
def embed_udf(spark, sf_dir):
    def load_model():
        return lambda texts: [[float(len(t)), float(t.count(" ") + 1)] for t in texts]

    embed = vec.embed_with(load_model, dimensions=2)
    rows = table(spark, sf_dir, "documents").select("doc_id", embed(F.col("text")).alias("v"))
    return rows.select("doc_id", F.col("v")[0].cast("long").alias("first"), F.col("v")[1].cast("long").alias("second"))


@query("vec_validate", """
SELECT vec_id, CASE WHEN label = 1 THEN 'dimension_mismatch' WHEN label = 2 THEN 'not_finite' WHEN label = 3 THEN 'empty' END AS error
FROM embeddings""")
def vec_validate(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    broken = (
        F.when(F.col("label") == 1, F.slice(v, 1, 10))
        .when(F.col("label") == 2, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan")))))
        .when(F.col("label") == 3, F.array().cast("array<double>"))
        .otherwise(v)
    )
    return rows.select("vec_id", broken.alias("v")).select("vec_id", vx.vector_error("v", 64).alias("error"))


def _followers(rows, key: str, group: str, steps: int):
    """`(key, next_1, ...)`: the rows of a group that follow each in key order, for rows that have so many followers.

    Rows are placed by (group, key) in pieces of a global order and meet by place, so no window holds a group.
    """
    named = rows.select(key, F.to_json(F.struct(group)).alias("_group"))  # never null
    placed = cut_lineage(with_positions(named, [key, "_group"], [F.col("_group"), F.col(key)], "_place"), "placed")
    out = placed
    for n in range(1, steps + 1):
        following = placed.select((F.col("_place") - n).alias("_place"), "_group", F.col(key).alias(f"next_{n}"))
        out = out.join(following, ["_place", "_group"])
    return out.drop("_place", "_group")


@query("cosine_pairs", """
WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS similarity FROM p WHERE b IS NOT NULL""")
def cosine_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    vector = F.col("embedding").cast("array<double>")
    pairs = _followers(rows, "vec_id", "label", 1).join(rows.select("vec_id", vector.alias("a")), "vec_id")
    pairs = pairs.join(rows.select(F.col("vec_id").alias("next_1"), vector.alias("b")), "next_1")
    return pairs.filter(F.col("b").isNotNull()).select("vec_id", F.round(vx.cosine("a", "b"), 6).alias("similarity"))


@query("distance_scores", """
SELECT event_id, round(1 - value, 6) AS cosine_score, round(-value, 6) AS l2_score FROM events""")
def distance_scores(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(vx.distance_score("value", True), 6).alias("cosine_score"),
        F.round(vx.distance_score("value", False), 6).alias("l2_score"),
    )


def _sql_nearest(score: str, order: str) -> str:
    return f"""
WITH v AS (SELECT 'v' || vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.id AS query_id, v.id AS id, round({score}, 9) + 0.0 AS score FROM v, v AS q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rank FROM s QUALIFY rank <= 10)
SELECT query_id, CAST(rank AS BIGINT) AS rank, round(score, 6) + 0.0 AS score, id FROM r"""


_SQUARED = "list_sum(list_transform(list_zip(v.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _nearest(spark, sf_dir, mode):
    stored = vectors(spark, sf_dir)
    asked = stored.select(F.col("id").alias("query_id"), "embedding")
    found, _ = vec.search(stored, asked, 10, mode)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), (F.round("score", 6) + 0.0).alias("score"), "id")


@query("vec_search", _sql_nearest("list_cosine_similarity(v.e, q.e)", "DESC"))
def vec_search(spark, sf_dir):
    return _nearest(spark, sf_dir, vec.COSINE)


@query("vec_search_l2", _sql_nearest(f"-{_SQUARED}", "DESC"))
def vec_search_l2(spark, sf_dir):
    return _nearest(spark, sf_dir, vec.L2)


@query("vec_distance_search", _sql_nearest(_SQUARED, "ASC"))
def vec_distance_search(spark, sf_dir):
    return _nearest(spark, sf_dir, vec.DISTANCE)


def _in_cells(stored):
    rows = stored.select("id", "embedding")
    centres = cells.train(rows)
    placed = cut_lineage(cells.by_cell(cut_lineage(cells.assign(rows, centres), "assigned")), "placed")
    return placed, centres, cells.summary(placed)


@query("vec_search_ann")
def vec_search_ann(spark, sf_dir):
    stored = vectors(spark, sf_dir)
    asked = stored.select(F.col("id").alias("query_id"), "embedding")
    placed, centres, counted = _in_cells(stored)
    return cells.search(placed, asked, centres, counted, 10, exact=False)


@query("vec_search_cells", _sql_nearest("list_cosine_similarity(v.e, q.e)", "DESC"))
def vec_search_cells(spark, sf_dir):
    stored = vectors(spark, sf_dir)
    asked = stored.select(F.col("id").alias("query_id"), "embedding")
    placed, centres, counted = _in_cells(stored)
    found = cells.search(placed, asked, centres, counted, 10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), (F.round("score", 6) + 0.0).alias("score"), "id")


@query("vec_ann_recall", """
SELECT CAST(count_if(vec_id % 20 = 0) AS BIGINT) AS queries, CAST(count_if(vec_id % 20 = 0) * least(10, count(*)) AS BIGINT) AS expected,
       TRUE AS reached FROM embeddings""")
def vec_ann_recall(spark, sf_dir):
    stored = vectors(spark, sf_dir)
    asked = cut_lineage(stored.filter(F.col("position") % 20 == 0).select(F.col("id").alias("query_id"), "embedding"), "asked")
    placed, centres, counted = _in_cells(stored)
    found = cells.search(placed, asked, centres, counted, 10, exact=False)
    measured = cells.recall(found, vec.search(stored, asked, 10)[0])
    return measured.select("queries", "expected", (F.col("found") >= cells.TARGET_RECALL * F.col("expected")).alias("reached"))


_SEMANTIC_TABLES = f"""WITH {SQL_CHUNKS},
texts AS (SELECT 'c' || id AS id, text FROM chunks UNION ALL SELECT 'b' || item_id, text FROM benchmark)"""


@query("semantic_search", f"""
{sql_embedding(_SEMANTIC_TABLES)},
q AS (SELECT CAST(substring(id, 2) AS BIGINT) AS query_id, embedding AS qe FROM embedded WHERE id LIKE 'b%'),
c AS (SELECT substring(id, 2) AS id, embedding AS e FROM embedded WHERE id LIKE 'c%'),
s AS (SELECT query_id, id, round(list_cosine_similarity(e, qe), 9) AS score FROM c, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5)
SELECT query_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score, r.id, c.title, c.source, 'cosine_similarity' AS score_semantics
FROM r JOIN chunks c ON c.id = r.id""")
def semantic_search(spark, sf_dir):
    stored = cut_lineage(vec.hash_vectors(chunks(spark, sf_dir)), "vectors")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = vec.semantic_search(stored, asked, vec.HASH_IDENTITY)
    return found.select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "id", "title", "source",
        "score_semantics",
    )


@query("distance_index", f"""
{sql_embedding(_SEMANTIC_TABLES)},
q AS (SELECT CAST(substring(id, 2) AS BIGINT) AS query_id, embedding AS qe FROM embedded WHERE id LIKE 'b%'),
c AS (SELECT substring(id, 2) AS id, embedding AS e FROM embedded WHERE id LIKE 'c%'),
s AS (SELECT query_id, id, round(list_sum(list_transform(list_zip(e, qe), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS score FROM c, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM s QUALIFY rank <= 5)
SELECT query_id, CAST(rank AS BIGINT) AS rank, round(score, 6) + 0.0 AS score, r.id, c.title, 'distance_lower_is_better' AS score_semantics
FROM r JOIN chunks c ON c.id = r.id""")
def distance_index(spark, sf_dir):
    """A vector index of the first layout, found by the facade from its metadata."""
    path = scratch(spark, "distances")
    index_store.build_distances(chunks(spark, sf_dir).select(*schemas.CHUNK_FIELDS), path)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = index_store.search_index(spark, path, asked)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), (F.round("score", 6) + 0.0).alias("score"), "id", "title", "score_semantics")


@query("semantic_cells", f"""
{sql_embedding(_SEMANTIC_TABLES)},
q AS (SELECT CAST(substring(id, 2) AS BIGINT) AS query_id, embedding AS qe FROM embedded WHERE id LIKE 'b%'),
c AS (SELECT substring(id, 2) AS id, embedding AS e FROM embedded WHERE id LIKE 'c%'),
s AS (SELECT query_id, id, round(list_cosine_similarity(e, qe), 9) AS score FROM c, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5)
SELECT query_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score, id FROM r""")
def semantic_cells(spark, sf_dir):
    """A stored index in two batches, each brought into cells behind its commit."""
    path = scratch(spark, "semantic-cells")
    rows = chunks(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id")).distinct()
    index_store.build_vectors(rows.join(labelled, "document_id", "left_semi").select(*schemas.CHUNK_FIELDS), path)
    vector_cells.refresh(spark, path)
    index_store.append_vectors(rows.select(*schemas.CHUNK_FIELDS), path)
    vector_cells.refresh(spark, path)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), vx.hash_embed("text").alias("embedding"))
    found = vector_cells.search(spark, path, asked, 5)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "id")


_BUILD_TABLES = f"WITH {SQL_CHUNKS}, texts AS (SELECT id, text FROM chunks)"


@query("semantic_build", f"""
{sql_embedding(_BUILD_TABLES)}
SELECT id, sha256, {sql_rounded("embedding")} AS vector FROM embedded JOIN chunks USING (id)""")
def semantic_build(spark, sf_dir):
    path = scratch(spark, "semantic-index")
    rows = cut_lineage(chunks(spark, sf_dir).drop("document_id"), "chunks")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc"))
    first = rows.join(labelled, F.substring_index("id", ":", 1) == F.col("doc"), "left_semi")
    index_store.append_vectors(first, path)
    index_store.append_vectors(rows, path)  # the chunks of the first append are skipped
    stored = index_store.index_table(spark, path, "vectors")
    return stored.select("id", "sha256", rounded("embedding").alias("vector"))


# prompts and answers ------------------------------------------------------------------------------
_SQL_PROMPT = rf"""
squeezed AS (SELECT query_id, rank, id, title, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM results),
context AS (
  SELECT query_id, count(*) AS n, string_agg('[' || rank || '] Title: ' || title || chr(10) || 'Source: ' || source || chr(10) ||
         'Chunk ID: ' || id || chr(10) || 'Text:' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS body
  FROM squeezed GROUP BY query_id),
prompts AS (
  SELECT a.query_id, a.text AS question, coalesce(n, 0) AS retrieved_count, n IS NULL AS no_context,
         {sql_text(rag.DEFAULT_INTRO)} || chr(10) || chr(10) || {sql_text(rag.INSTRUCTIONS)} ||
         chr(10) || chr(10) || 'Context:' || chr(10) || body || chr(10) || 'Question:' || chr(10) ||
         trim(regexp_replace(a.text, '\s+', ' ', 'g')) || chr(10) || chr(10) || 'Answer:' AS prompt
  FROM asked a LEFT JOIN context USING (query_id))"""


def _asked(spark, sf_dir):
    stored, terms = stored_terms(spark, sf_dir)
    questions = user_turns(spark, sf_dir)
    return rag.ask(lexical.search_chunks(terms, stored, questions), questions)


@query("rag_prompts", f"WITH {sql_lexical_hits()}, {_SQL_PROMPT} SELECT query_id, retrieved_count, prompt FROM prompts")
def rag_prompts(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", "retrieved_count", "prompt")


@query("ask_batch", f"""
WITH {sql_lexical_hits()}, {_SQL_PROMPT}
SELECT query_id, trim(question) AS question, retrieved_count, no_context,
       CASE WHEN no_context THEN 'No relevant context found.'
            ELSE 'Mock LLM backend: no real model was called.' || chr(10) || chr(10) || 'Received a prompt with ' ||
                 length(prompt) || ' characters.' || chr(10) ||
                 'This confirms retrieval, prompt assembly, and LLM client wiring are connected.' END AS answer
FROM prompts""")
def ask_batch(spark, sf_dir):
    return rag.mock_answers(_asked(spark, sf_dir)).drop("prompt")


@query("retrieval_smoke", rf"""
WITH {sql_lexical_hits()},
joined AS (SELECT query_id, count(*) AS n, trim(regexp_replace(string_agg(text, ' ' ORDER BY rank), '\s+', ' ', 'g')) AS body FROM results GROUP BY query_id),
p AS (SELECT a.query_id, coalesce(n, 0) AS retrieved_count, coalesce(body, '') AS body,
             coalesce(CASE WHEN length(body) > 200 THEN substring(body, 1, 197) || '...' ELSE body END, '') AS context_preview,
             upper(list_last(string_split_regex(trim(a.text), '\s+'))) AS phrase FROM asked a LEFT JOIN joined USING (query_id))
SELECT query_id, retrieved_count, context_preview, contains(lower(body), lower(phrase)) AS retrieval_ok FROM p""")
def retrieval_smoke(spark, sf_dir):
    """The last word of every question, looked for in the whole retrieved context."""
    stored, terms = stored_terms(spark, sf_dir)
    questions = user_turns(spark, sf_dir)
    expected = questions.select("query_id", F.upper(F.element_at(F.split(F.trim("text"), r"\s+"), -1)).alias("phrase"))
    return rag.retrieval_check(lexical.search_chunks(terms, stored, questions), expected)


_SQL_SCALED = """scaled AS (
  SELECT vec_id, CASE vec_id % 50 WHEN 7 THEN NULL WHEN 8 THEN list_transform(embedding[1:3], lambda x: x::DOUBLE)
         WHEN 9 THEN list_transform(embedding, lambda x: 'nan'::DOUBLE) ELSE list_transform(embedding, lambda x: x::DOUBLE * 100000) END AS v
  FROM embeddings),
usable AS (SELECT vec_id, v FROM scaled WHERE vec_id % 50 NOT IN (7, 8, 9))"""


def _scaled(spark, sf_dir):
    """Long vectors, and in each fifty a null, a short and a NaN one."""
    rows, kind = vectors(spark, sf_dir), F.col("position") % 50
    long = F.transform("embedding", lambda x: x * 100000)
    odd = F.when(kind == 8, F.slice("embedding", 1, 3)).when(kind == 9, F.transform("embedding", lambda x: F.lit(float("nan")))).when(kind != 7, long)
    return vec.usable_vectors(rows.withColumn("embedding", odd), 64)


@query("vec_search_long", f"""WITH {_SQL_SCALED},
s AS (SELECT q.vec_id AS query_id, 'v' || u.vec_id AS id, -list_sum(list_transform(list_zip(u.v, q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS score
      FROM usable u, usable q WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, rank, id, round(score / 1000000, 3) + 0.0 AS millions FROM r WHERE rank <= 5""")
def vec_search_long(spark, sf_dir):
    """Squared distances far beyond nine digits, among vectors of which the unusable ones were set aside."""
    good, _ = _scaled(spark, sf_dir)
    asked = good.filter(F.col("position") % 20 == 0).select(F.col("position").alias("query_id"), "embedding")
    found, _ = vec.search(good, asked, 5, vec.L2)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round(F.col("score") / 1000000, 3).alias("millions"))


@query("vec_errors", """
SELECT 'v' || vec_id AS id, CASE vec_id % 50 WHEN 7 THEN 'empty' WHEN 8 THEN 'dimension_mismatch' ELSE 'not_finite' END AS error_type
FROM embeddings WHERE vec_id % 50 IN (7, 8, 9)""")
def vec_errors(spark, sf_dir):
    return _scaled(spark, sf_dir)[1]


# evaluation ---------------------------------------------------------------------------------------
_SQL_EVAL = """
WITH s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS pos, q.label = v.label AS hit,
         round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score
  FROM embeddings v, embeddings q WHERE v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM s),
e AS (
  SELECT query_id, sum(hit::INT) AS relevant, sum((hit AND rank = 1)::INT) AS top1_hits, sum((hit AND rank <= 3)::INT) AS top3_hits,
         min(CASE WHEN hit THEN rank END) AS first_relevant_rank FROM r GROUP BY query_id)"""


def _evaluated(spark, sf_dir):
    stored = vectors(spark, sf_dir)
    asked = stored.select(F.col("position").alias("query_id"), "embedding", "label", F.col("position").alias("self_position"))
    return evaluate.by_label(stored, asked)


@query("eval_rank", _SQL_EVAL + """
SELECT query_id, CAST(relevant AS BIGINT) AS relevant, CAST(top1_hits AS BIGINT) AS top1_hits, CAST(top3_hits AS BIGINT) AS top3_hits,
       CAST(first_relevant_rank AS BIGINT) AS first_relevant_rank FROM e""")
def eval_rank(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("query_id", "relevant", "top1_hits", "top3_hits", "first_relevant_rank")


@query("eval_metrics", _SQL_EVAL + """
SELECT count(*) AS query_count, count(*) FILTER (relevant = 0) AS queries_without_relevant, round(avg(top1_hits), 6) AS top1_accuracy,
       round(avg(top3_hits / nullif(relevant, 0)::DOUBLE), 6) AS recall_at_3,
       round(avg(coalesce(1.0::DOUBLE / first_relevant_rank, 0)), 6) AS mean_reciprocal_rank FROM e""")
def eval_metrics(spark, sf_dir):
    row = evaluate.metrics(_evaluated(spark, sf_dir))
    names = ("top1_accuracy", "recall_at_3", "mean_reciprocal_rank")
    return row.withColumns({name: F.round(name, 6) for name in names})


@query("eval_fixture", f"""
{sql_embedding("WITH texts AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark)")},
d AS (SELECT doc_id, source, embedding AS e FROM embedded JOIN documents ON id = 'd' || doc_id),
b AS (SELECT item_id, 'src' || (item_id % 20) AS wanted, embedding AS qe FROM embedded JOIN benchmark ON id = 'b' || item_id),
r AS (SELECT item_id AS query_id, source = wanted AS hit, row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(e, qe), 9) DESC, doc_id) AS rank FROM d, b)
SELECT query_id, CAST(sum(hit::INT) AS BIGINT) AS relevant, CAST(sum((hit AND rank <= 3)::INT) AS BIGINT) AS top3_hits,
       CAST(min(CASE WHEN hit THEN rank END) AS BIGINT) AS first_relevant_rank FROM r GROUP BY query_id""")
def eval_fixture(spark, sf_dir):
    """Judgements listed per query, as an evaluation file holds them; what has no text has no vector and is left out."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    records = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("position"), vx.hash_embed("text").alias("embedding"))
    records = cut_lineage(records, "records")
    asked = table(spark, sf_dir, "benchmark").filter(F.length("text") > 0).select(
        F.col("item_id").alias("query_id"), vx.hash_embed("text").alias("embedding"),
        F.concat(F.lit("src"), F.col("item_id") % 20).alias("wanted"),
    )
    judged = asked.select("query_id", "wanted").join(
        docs.select(F.col("source").alias("wanted"), F.col("doc_id").cast("string").alias("id")), "wanted"
    ).select("query_id", "id")
    scored = evaluate.by_judgements(records, asked, judged)
    return scored.select("query_id", "relevant", "top3_hits", "first_relevant_rank")


@query("similarity_triples", f"""
{sql_embedding("WITH texts AS (SELECT doc_id AS id, text FROM documents)")},
o AS (SELECT id, source, embedding AS a, lead(embedding, 1) OVER w AS b, lead(embedding, 2) OVER w AS c
      FROM embedded JOIN documents ON id = doc_id WINDOW w AS (PARTITION BY source ORDER BY id))
SELECT id AS triple_id, round(list_cosine_similarity(a, b), 6) AS related_similarity,
       round(list_cosine_similarity(a, c), 6) AS unrelated_similarity,
       list_cosine_similarity(a, b) > list_cosine_similarity(a, c) AS related_ranks_higher
FROM o WHERE c IS NOT NULL""")
def similarity_triples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    triples = _followers(docs, "doc_id", "source", 2)
    triples = triples.select(F.col("doc_id").alias("triple_id"), F.col("doc_id").alias("anchor"), F.col("next_1").alias("related"), F.col("next_2").alias("unrelated"))
    scored = evaluate.related_ranks_higher(triples, texts=docs.select(F.col("doc_id").alias("id"), "text"))
    return scored.withColumns({n: F.round(n, 6) for n in ("related_similarity", "unrelated_similarity")})
