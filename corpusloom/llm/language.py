"""Language of documents and pages by Bayesian fusion of evidence.

Evidence of a row: its text (letter trigrams of UTF-8 bytes), the language it declares (markup or a column), the last
part of its address, and the languages of its host. The text model is fitted on a bounded sample of texts of each
language that rows declare. What a declared value or an address suffix says is estimated over all rows from the text posteriors, by grouped
sums. A host's prior is smoothed to its domain's, that to its suffix's, that to all rows'; a row's own share is taken out
of each, so that nothing counts twice. The languages are those that LEAST_ROWS different texts or more declare, counted
over all rows, and `und` for none of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, pieces, released, require, text_bytes
from corpusloom.session import checked_keys, cut_lineage, key_bytes, may_broadcast

SAMPLE_ROWS = 3000  # texts of the sample, shared out evenly among the languages
LEAST_SHARE = 100  # texts of the sample for each language, however many languages there are
MAX_CHARS = 8000  # of a text in the sample
LEAST_ROWS = 5  # different texts, of all rows, that a language needs
BUCKETS = 1 << 15
EFFECTIVE = 60  # trigrams overlap and repeat: a text weighs as so many independent ones at most
OTHER = "und"
OTHER_PRIOR = 0.01
OTHER_TRIGRAM = -9.5  # log likelihood of any trigram in a language that is not known
SMOOTHING = 20.0
KEPT = 0.5


class TextModel(NamedTuple):
    languages: list[str]  # the last is OTHER
    table: np.ndarray  # log likelihood, languages x trigram buckets


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all letter trigrams of rows of text, and the row of each. A-Z count as a-z, other ASCII as blanks."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    byte = _CLASS[data].astype(np.uint32)
    inside = np.ones(len(data), bool)
    for back in (1, 2):
        last = offsets[1:] - back
        inside[last[last >= 0]] = False
    inside = inside[:-2] & (byte[1:-1] != 32)
    at = np.flatnonzero(inside)
    code = byte[at] << np.uint32(16) | byte[at + 1] << np.uint32(8) | byte[at + 2]
    return (code * np.uint32(0x9E3779B1) >> np.uint32(17)).astype(np.int64), np.searchsorted(offsets, at, "right") - 1


def fit(sample: Iterable[tuple[str, str]], names: list[str]) -> TextModel:
    """The model of texts and the languages they declare; one text is held at a time."""
    at = {name: k for k, name in enumerate(names)}
    counts = np.full((len(names), BUCKETS), 0.05)
    for text, name in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        bucket, _ = trigrams(raw, np.array([0, len(raw)]))
        # a long text counts as a short one, so that no single text makes the model
        counts[at[name]] += np.bincount(bucket, minlength=BUCKETS) * min(1.0, 1000 / max(1, len(bucket)))
    table = np.log(counts / counts.sum(1, keepdims=True)) if names else counts
    return TextModel([*names, OTHER], np.vstack([table, np.full(BUCKETS, OTHER_TRIGRAM)]).astype(np.float32))


def train(rows: DataFrame, text: str, declared: Column) -> TextModel:
    """The text model of every language that LEAST_ROWS different texts declare.

    All rows are counted; a language then gives its texts of least hashes, about SAMPLE_ROWS over the number of languages
    or LEAST_SHARE, and of each its first MAX_CHARS characters. A frequent language takes no texts from a rare one.
    """
    require(rows, text)
    known = rows.select(F.lower(F.trim(declared)).alias("declared"), F.col(text).alias("text")).filter("declared <> '' AND text <> ''")
    known = known.filter(F.col("declared") != OTHER).withColumn("h", F.xxhash64("text"))
    different = cut_lineage(known.select("declared", "h").distinct(), "declared-texts")
    found = different.groupBy("declared").count().filter(F.col("count") >= LEAST_ROWS).collect()  # one row a language
    if not found:
        return fit([], [])
    share = max(LEAST_SHARE, SAMPLE_ROWS // len(found))
    # hashes are spread evenly, so that a bound gives a language about its share without ranking its texts
    bounds = [(r["declared"], -(1 << 63) + ((1 << 64) * min(share, r["count"]) // r["count"]) - 1) for r in found]
    limits = rows.sparkSession.createDataFrame(bounds, "declared string, bound long")
    sample = different.join(F.broadcast(limits), "declared").filter("h <= bound").select("declared", "h")
    cut = known.withColumn("text", F.substring("text", 1, MAX_CHARS)).join(F.broadcast(sample), ["declared", "h"])
    texts = cut.dropDuplicates(["declared", "h"]).orderBy("declared", "h").select("text", "declared")
    return fit(texts.toLocalIterator(), sorted(r["declared"] for r in found))


def text_evidence(rows: DataFrame, model: TextModel, text: str, keep: list[str]) -> DataFrame:
    """The `keep` columns, `letters` (trigrams of the text) and `text_log` (per language, scaled to EFFECTIVE)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    source = rows.select(*keep, F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.table
        for batch in pieces(batches, "text"):
            bucket, row = trigrams(*text_bytes(batch.column("text")))
            n = np.bincount(row, minlength=batch.num_rows)
            logs = np.stack([np.bincount(row, own[bucket], batch.num_rows) for own in table], 1)
            logs = logs * (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None]
            at = np.arange(0, logs.size + 1, len(table), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, logs.ravel())], names=[*keep, "letters", "text_log"]
            )

    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(released(run), f"{fields}, letters long, text_log array<double>")


def _with_posterior(rows: DataFrame, logs: str, name: str) -> DataFrame:
    """`rows` with the array of logarithms `logs` turned into chances."""
    rows = rows.withColumn("_top", F.array_max(logs)).withColumn("_e", F.transform(logs, lambda x: F.exp(x - F.col("_top"))))
    rows = rows.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))
    return rows.withColumn(name, F.transform("_e", lambda x: x / F.col("_sum"))).drop("_top", "_e", "_sum")


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Summed text posteriors by `keys`; rows without letters give no evidence."""
    sums = [F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(n)]
    return rows.filter("letters > 0").groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"s{k}" for k in range(n)]).alias(name))


def _joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    stored = cut_lineage(table, "evidence")
    count, size = stored.agg(F.count("*"), F.coalesce(F.sum(key_bytes(key) + 16 * F.size(stored.columns[-1])), F.lit(0))).first()
    return rows.join(F.broadcast(stored) if may_broadcast(count, size) else stored, key, "left")


def identify(
    rows: DataFrame, model: TextModel, id: str = "doc_id", text: str = "text",
    declared: Column | None = None, host: Column | None = None, suffix: Column | None = None,
) -> DataFrame:
    """One row (`id`, `declared`, `language`, `posterior`, `text_language`, `kept`) for each row of `rows`.

    `language` has the highest posterior, the first by name of equal ones. `kept` says that the text has letters, its
    language is one of the model's and the posterior is 0.5 or more. Evidence that is not given, null or blank counts
    as none. A null or empty text, or one without letters, goes by the rest and is not kept. Ids may be null or repeat;
    an empty table gives an empty one; other columns play no part.
    """
    require(rows, id, text)
    n = len(model.languages)
    none = F.lit(None).cast("string")

    def clean(x: Column | None) -> Column:
        return none if x is None else F.nullif(F.lower(F.trim(x.cast("string"))), F.lit(""))

    given = rows.select(F.col(id).alias("id"), F.col(text).alias("text"), clean(declared).alias("declared"), clean(host).alias("host"), clean(suffix).alias("suffix"))
    given = given.withColumn("domain", F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1))
    given = given.withColumn("domain", F.nullif(F.coalesce("domain", F.lit("")), F.lit("")))
    prior = F.array(*[F.lit(float(x)) for x in np.log([*[(1 - OTHER_PRIOR) / max(1, n - 1)] * (n - 1), OTHER_PRIOR])])
    plain = text_evidence(given, model, "text", ["id", "declared", "host", "domain", "suffix"])
    plain = _with_posterior(plain.withColumn("logs", F.zip_with("text_log", prior, lambda a, b: a + b)), "logs", "p").drop("logs")
    plain = cut_lineage(plain, "text-evidence")

    whole = cut_lineage(_sums(plain.withColumn("all", F.lit(1)), ["all"], n, "of_all"), "all")
    out = plain.withColumn("all", F.lit(1)).join(F.broadcast(whole), "all", "left")  # one row
    for key in ("declared", "suffix", "domain", "host"):
        out = _joined(out, _sums(plain.filter(F.col(key).isNotNull()), [key], n, f"of_{key}"), key)
    zero = F.array_repeat(F.lit(0.0), n)
    counted = F.when(F.col("letters") > 0, F.col("p")).otherwise(zero)

    def others(name: str) -> Column:  # the sums without the row itself
        return F.zip_with(F.coalesce(name, zero), counted, lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def smoothed(name: str, base: Column) -> Column:
        own = F.coalesce(name, zero)
        return F.zip_with(own, base, lambda a, b: (a + SMOOTHING * b) / (total(own) + SMOOTHING))

    out = out.select("*", *[others(f"of_{k}").alias(f"o_{k}") for k in ("all", "declared", "suffix", "domain", "host")])
    level = F.transform(F.col("o_all"), lambda a: (a + 1.0) / (total(F.col("o_all")) + n))
    out = out.withColumn("l0", level)
    for k, key in enumerate(("suffix", "domain", "host")):  # from the widest to the narrowest
        out = out.withColumn(f"l{k + 1}", smoothed(f"o_{key}", F.col(f"l{k}")))
    # P(declared value | language): the value's rows of that language among all its rows
    says = F.zip_with("o_declared", "o_all", lambda a, b: F.log((a + 0.5) / (b + 0.5 * (n + 1))))
    says = F.when(F.col("declared").isNotNull(), says).otherwise(zero)
    fused = F.zip_with(F.zip_with("text_log", "l3", lambda a, b: a + F.log(b)), says, lambda a, b: a + b)
    out = _with_posterior(out.withColumn("logs", fused), "logs", "final")
    names = F.array(*[F.lit(x) for x in model.languages])
    best = F.array_position("final", F.array_max("final")).cast("int")
    by_text = F.when(F.col("letters") > 0, F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")))
    language = F.element_at(names, best)
    return out.select(
        F.col("id").alias(id), "declared", language.alias("language"), F.array_max("final").alias("posterior"), by_text.alias("text_language"),
        ((F.col("letters") > 0) & (language != OTHER) & (F.array_max("final") >= KEPT)).alias("kept"),
    )


def keep_identified(rows: DataFrame, model: TextModel, id: str = "doc_id", text: str = "text", declared: Column | None = None, host: Column | None = None) -> DataFrame:
    """`rows` without those that `identify` does not keep; rows go by id and text."""
    key = free_name(rows, "key")
    flagged = rows.withColumn(key, F.struct(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")))
    found = identify(flagged, model, key, text, declared, host).filter(~F.col("kept")).select(key).distinct()
    dropped = checked_keys(found.select(F.col(f"{key}.id").alias("id"), F.col(f"{key}.h").alias("h")))
    keys = F.broadcast(dropped.keys) if dropped.small else dropped.keys
    same = flagged[key]["id"].eqNullSafe(keys["id"]) & (flagged[key]["h"] == keys["h"])
    return flagged.join(keys, same, "left_anti").drop(key)


def page_evidence(html: str = "html", url: str = "url") -> dict[str, Column]:
    """What pages say: the text without markup, the markup's language, the host and the last part of its address."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    declared = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#:]*)", 1))
    return {"text": text, "declared": declared, "host": host, "suffix": F.regexp_extract(host, r"([^.]*)$", 1)}
