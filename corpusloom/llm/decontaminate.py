"""Benchmark passages in documents, found by winnowed fingerprints, with DataFrame functions only.

Of the 5-word runs of every 9 that follow each other the one with the least hash is kept, in documents and in
benchmark items alike. Any 13 words that both share hold 9 such runs, so both keep the same one of them: every shared
window meets in the join of the fingerprints. A hit fixes how the two texts lie to each other; the item is then laid
over the document there and compared word by word, which gives all its windows that occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, require, sha256_joined, small_side
from corpusloom.session import cut_lineage, key_bytes, may_broadcast

WINDOW = 13
GRAM = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACE_BITS = 28  # of a fingerprint; more words than that do not fit into a string


def words_of(text: str) -> Column:
    """Words in lower case (A-Z only): runs of ASCII digits, letters and all characters beyond ASCII; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def fingerprints(hashes: str, window: int) -> Column:
    """The kept runs of an array of word hashes: hash bits above, the run's place in the low bits.

    The place decides between equal hashes of a window, so that equal windows keep the same place in themselves.
    """
    gram = min(GRAM, window)
    span = window - gram + 1
    run = ", ".join(f"get({hashes}, i + {k})" for k in range(gram))
    runs = f"transform(sequence(0, size({hashes}) - {gram}), i -> shiftleft(xxhash64({run}), {_PLACE_BITS}) + i)"
    if span == 1:
        kept = runs
    else:
        least = "least(" + ", ".join(f"get(g, i + {k})" for k in range(span)) + ")"
        # the runs come in as the start value of an aggregate, so that they are computed once
        kept = f"aggregate(array(0), {runs}, (g, x) -> array_distinct(transform(sequence(0, size(g) - {span}), i -> {least})))"
    return F.expr(f"CASE WHEN size({hashes}) >= {window} THEN {kept} ELSE array() END").cast("array<bigint>")


def _placed(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each fingerprint: the `keep` columns, `window`, `print` and its place `at`."""
    each = rows.select(*keep, F.explode("prints").alias("p")).select(*keep, "p.window", F.explode("p.kept").alias("x"))
    low = (1 << _PLACE_BITS) - 1
    return each.select(*keep, "window", F.shiftright("x", _PLACE_BITS).alias("print"), F.col("x").bitwiseAND(F.lit(low).cast("long")).cast("int").alias("at"))


def _prints(windows: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(w).alias("window"), fingerprints("hashes", w).alias("kept")) for w in windows])


def _hits(places: DataFrame) -> Column:
    """How many words the windows that begin at `starts` cover; each covers its `window`."""
    return F.aggregate(
        F.array_sort(places), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["window"] - F.greatest(acc["end"], x["start"]))).alias("n"),
            F.greatest(acc["end"], x["start"] + x["window"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row (`id`, `n_words`, `n_hit`, `n_items`, `items`, `contaminated`) for each row of `docs`.

    A window is 13 words of an item that follow each other; an item of fewer, but not none, is one window. `n_hit`
    counts the document's words inside any occurrence of a window, `items` lists, sorted as strings, the ids whose
    windows occur, and `contaminated` says that n_hit > 0 and 20 * n_hit >= n_words.

    Null and empty texts have no words and are clean. Rows go by id and text: repeated rows get the same result, and
    null ids are kept. Items with a null id or without words are left out; items that repeat an id count once. No
    items leave every document clean. Other columns play no part, whatever their names.
    """
    require(docs, id, text)
    require(items, item_id, item_text)
    bench = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words_of(item_text).alias("item_words"))
    bench = cut_lineage(bench.filter(F.size("item_words") > 0).distinct(), "items")
    bench = bench.withColumn("window", F.least(F.size("item_words"), F.lit(WINDOW)))
    windows = sorted(r[0] for r in bench.select("window").distinct().collect())  # 13 values at most
    if not windows:
        windows = [WINDOW]

    rows = docs.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), words_of(text).alias("words"))
    rows = rows.select("id", "key", F.size("words").cast("long").alias("n_words"), F.expr("transform(words, w -> xxhash64(w))").alias("hashes"))
    rows = cut_lineage(rows.select("id", "key", "n_words", _prints(windows).alias("prints")), "fingerprints")

    of_items = bench.withColumn("hashes", F.expr("transform(item_words, w -> xxhash64(w))")).withColumn("prints", _prints(windows))
    own = F.filter("prints", lambda p: p["window"] == F.col("window"))
    of_items = of_items.select("item", "window", F.xxhash64("item_words").alias("version"), F.size("item_words").alias("m"), own.alias("prints"))
    of_items = _placed(of_items.withColumnRenamed("window", "own"), "item", "version", "m").withColumnRenamed("at", "item_at")
    of_items = cut_lineage(of_items, "item-fingerprints")
    count, size = of_items.agg(F.count("*"), F.coalesce(F.sum(key_bytes("item", "version", "print", "item_at")), F.lit(0))).first()
    small = may_broadcast(count, size)

    met = _placed(rows, "id", "key").join(F.broadcast(of_items) if small else of_items, ["window", "print"])
    met = met.select("id", "key", F.struct("item", "version", "m", "window", (F.col("at") - F.col("item_at")).alias("shift")).alias("lie"))
    lies = cut_lineage(met.groupBy("id", "key").agg(F.collect_set("lie").alias("lies")), "lies")
    n_docs, size = lies.agg(F.count("*"), F.coalesce(F.sum(24 + 48 * F.size("lies")), F.lit(0))).first()

    texts = docs.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    narrow = F.broadcast(lies) if may_broadcast(n_docs, size) else lies
    texts = texts.join(narrow, texts["id"].eqNullSafe(narrow["id"]) & (texts["key"] == narrow["key"])).select(texts["id"], texts["key"], "text", "lies")
    texts = texts.select("id", "key", words_of("text").alias("words"), F.size("lies").alias("n"), "lies")
    laid = F.expr("transform(lies, x -> struct(x.item, x.version, x.window, x.shift, slice(words, greatest(x.shift, 0) + 1, x.m + least(x.shift, 0)) AS own))")
    laid = texts.select("id", "key", F.explode(laid).alias("x")).select("id", "key", "x.*")
    keyed = bench.select("item", F.xxhash64("item_words").alias("version"), "item_words")
    laid = laid.join(F.broadcast(keyed) if small else keyed, ["item", "version"])
    same = F.expr("array_join(transform(item_words, (w, j) -> if(get(own, j + least(shift, 0)) <=> w, '1', '0')), '')")
    laid = laid.withColumn("same", same)
    starts = F.expr(
        "transform(filter(sequence(0, size(item_words) - window), j -> substring(same, j + 1, window) = repeat('1', window)),"
        " j -> struct(j + shift AS start, window))"
    )
    found = laid.select("id", "key", "item", starts.alias("starts")).filter(F.size("starts") > 0)
    found = found.groupBy("id", "key").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"), F.sort_array(F.collect_set("item")).alias("items"))
    found = cut_lineage(found.select(F.col("id").alias("of"), F.col("key").alias("of_key"), _hits(F.col("starts")).alias("n_hit"), "items"), "hits")
    out = rows.select("id", "key", "n_words").join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def digests(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """`contamination` with the item ids as a digest."""
    return found.select(id, "n_words", "n_hit", "n_items", sha256_joined(F.col("items")).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows that `contamination` marks; rows go by id and text."""
    key = free_name(docs, "key")
    flagged = docs.withColumn(key, F.struct(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")))
    found = contamination(flagged, items, key, text).filter("contaminated").select(F.col(f"{key}.id").alias("id"), F.col(f"{key}.h").alias("h")).distinct()
    found = cut_lineage(found, "contaminated")
    rows, size = found.agg(F.count("*"), F.coalesce(F.sum(key_bytes("id", "h")), F.lit(0))).first()
    same = flagged[key]["id"].eqNullSafe(found["id"]) & (flagged[key]["h"] == found["h"])
    return flagged.join(small_side(found, rows, size), same, "left_anti").drop(key)
