"""Verdicts on URLs: given rules first, then association rules mined from labelled URLs, with DataFrame functions and Spark ML.

A URL is a set of tokens (scheme, host labels, path words, extension, query names, fragment). FP-growth mines frequent
token sets together with the verdict, which gives rules `tokens -> verdict` with support and confidence. Tokens that the same
labelled URLs have are one token there, as each says what the others say: sets of them would be 2^tokens sets of equal
support. Rules below the bounds, and rules that a more general one makes needless, are pruned. An inverted index posts
each rule under its rarest token; a URL meets a rule there and fits it if it has all its tokens.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import require
from corpusloom.session import checked_keys, cut_lineage, key_bytes, may_broadcast

SUPPORT = 0.01  # share of the labelled URLs that a token set with its verdict needs
CONFIDENCE = 0.8
DEFAULT = "allow"
_VERDICT = "verdict="
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """What is between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end.

    Both are empty for null and for a text without `://`.
    """
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def url_tokens(url: str) -> Column:
    """The distinct tokens of a URL; path words in lower case, digits left out of them."""
    host, path = host_and_path(url)
    text = F.coalesce(F.col(url), F.lit(""))
    named = lambda prefix, words: F.transform(words, lambda w: F.concat(F.lit(prefix), w))
    some = lambda words: F.filter(words, lambda w: w != "")
    labels = some(F.split(F.regexp_replace(host, r"^[^@]*@|:\d*$", ""), r"\."))
    words = some(F.regexp_extract_all(F.translate(path, _UPPER, _LOWER), F.lit(r"[a-z][a-z_-]*"), F.lit(0)))
    query = some(F.regexp_extract_all(F.regexp_replace(text, r"#.*$", ""), F.lit(r"[?&]([^=&#]+)"), F.lit(1)))
    return F.array_distinct(F.concat(
        named("scheme=", F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(r"^([a-z]+)://"), F.lit(1))),
        named("host=", labels), named("top=", F.slice(F.reverse(labels), 1, 1)), named("path=", words),
        named("end=", F.regexp_extract_all(path, F.lit(r"\.([a-z0-9]+)$"), F.lit(1))), named("query=", query),
        named("mark=", F.when(F.contains(text, F.lit("#")), F.array(F.lit("#"))).otherwise(F.array().cast("array<string>"))),
    ))


def given_verdicts(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(`url`, `rule`, `given`) of the different URLs that a rule (`rule_host`, `rule_path`, `rule_verdict`) fits.

    A rule fits its host and all hosts below it if the URL's path starts with the rule's path; the longest rule wins.
    """
    host, path = host_and_path(url)
    each = urls.select(F.col(url).alias("url")).filter(F.col("url").isNotNull()).distinct()
    each = each.select("url", *[c.alias(n) for c, n in zip(host_and_path("url"), ("host", "path"))]).filter("host <> ''")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    stored = cut_lineage(rules.select("rule_host", "rule_path", "rule_verdict").distinct(), "url-rules")
    count, size = stored.agg(F.count("*"), F.coalesce(F.sum(key_bytes("rule_host", "rule_path")), F.lit(0))).first()
    met = each.select("url", "path", F.explode(F.array_distinct(ends)).alias("rule_host")).join(F.broadcast(stored) if may_broadcast(count, size) else stored, "rule_host")
    met = met.filter(F.expr("startswith(path, rule_path)"))
    rule = F.concat("rule_host", "rule_path")
    best = met.groupBy("url").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), F.col("rule_verdict").alias("given"))).alias("x"))
    return best.select("url", "x.rule", "x.given")


class Mined(NamedTuple):
    """Rules (`tokens`, `mined`, `support`, `confidence`) and the tokens that stand for others (`token`, `stands`)."""

    rules: DataFrame
    merged: DataFrame


def together(baskets: DataFrame, least: int) -> DataFrame:
    """(`token`, `stands`): tokens of `items` that the same rows of `baskets` (`basket`, `items`) have, and the least of them.

    Only tokens of `least` rows or more; a token that no other one goes with stands for itself. Rows are told apart by the
    sums of two hashes of `basket`.
    """
    each = baskets.select("basket", F.explode("items").alias("token"))
    marks = [F.sum(F.xxhash64(F.lit(k), "basket").cast("decimal(20,0)")).alias(f"h{k}") for k in (1, 2)]
    seen = each.groupBy("token").agg(F.count("*").alias("n"), *marks).filter(F.col("n") >= least)
    stands = seen.groupBy("n", "h1", "h2").agg(F.min("token").alias("stands"))
    return seen.join(stands, ["n", "h1", "h2"]).select("token", "stands")


def _replaced(rows: DataFrame, items: str, merged: DataFrame, small: bool, *keys: str) -> DataFrame:
    """`rows` with each token of the array `items` replaced by the one that stands for it; tokens without one go."""
    each = rows.select(*keys, F.explode(items).alias("token")).join(F.broadcast(merged) if small else merged, "token")
    return each.groupBy(*keys).agg(F.array_sort(F.collect_set("stands")).alias(items))


def mine(labelled: DataFrame, url: str = "url", verdict: str = "verdict", support: float = SUPPORT, confidence: float = CONFIDENCE) -> Mined:
    """Rules from labelled URLs, all of which count, over tokens that stand for those that always go with them.

    At most tokens-per-URL / `support` tokens can be frequent, so neither the frequent tokens nor the rules grow with the
    number of URLs. Null URLs and verdicts are left out; without any there are no rules.
    """
    require(labelled, url, verdict)
    rows = labelled.filter(F.col(url).isNotNull() & F.col(verdict).isNotNull())
    rows = rows.select(F.col(url).alias("url"), F.col(verdict).alias("verdict"), F.monotonically_increasing_id().alias("basket"))
    baskets = cut_lineage(rows.select("basket", "verdict", url_tokens("url").alias("items")), "baskets")
    total = baskets.count()
    if not total:
        rules = baskets.sparkSession.createDataFrame([], "tokens array<string>, mined string, support double, confidence double")
        return Mined(rules, baskets.sparkSession.createDataFrame([], "token string, stands string"))
    merged = checked_keys(together(baskets, math.ceil(support * total)))
    kept = _replaced(baskets, "items", merged.keys, merged.small, "basket")
    items = baskets.select("basket", "verdict").join(kept, "basket", "left")
    items = items.select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit(_VERDICT), "verdict"))).alias("items"))
    items = cut_lineage(items, "items")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    sets = cut_lineage(model.freqItemsets, "frequent")
    is_verdict = lambda t: t.startswith(_VERDICT)
    own = sets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("all")).filter(~F.exists("tokens", is_verdict) & (F.size("tokens") > 0))
    with_verdict = sets.filter(F.exists("items", is_verdict) & (F.size("items") > 1))
    with_verdict = with_verdict.select(
        F.array_sort(F.filter("items", lambda t: ~is_verdict(t))).alias("tokens"),
        F.expr(f"substring(filter(items, t -> startswith(t, '{_VERDICT}'))[0], {len(_VERDICT) + 1})").alias("mined"), "freq",
    )
    ruled = with_verdict.join(own, "tokens").select("tokens", "mined", (F.col("freq") / F.lit(total)).alias("support"), (F.col("freq") / F.col("all")).alias("confidence"))
    return Mined(_pruned(cut_lineage(ruled, "mined"), confidence), merged.keys)


def _pruned(rules: DataFrame, confidence: float) -> DataFrame:
    """The rules of at least `confidence` beside which no rule with fewer of the tokens, the same verdict and no less
    confidence stands.

    `rules` has all frequent sets, hence all subsets of each: the surest of these is found size by size, from the sets
    that lack one token.
    """
    most = rules.agg(F.coalesce(F.max(F.size("tokens")), F.lit(0))).first()[0]
    level = lambda k: rules.filter(F.size("tokens") == k)
    done = [level(1).withColumn("sure", F.lit(-1.0))]  # `sure`: of the surest rule with fewer tokens
    for k in range(2, most + 1):
        below = done[-1].select(F.col("tokens").alias("fewer"), "mined", F.greatest("confidence", "sure").alias("sure"))
        each = level(k).withColumn("lacks", F.explode("tokens")).withColumn("fewer", F.array_remove("tokens", F.col("lacks")))
        best = each.join(below, ["fewer", "mined"]).groupBy("tokens", "mined").agg(F.max("sure").alias("sure"))
        done.append(cut_lineage(level(k).join(best, ["tokens", "mined"]).select(*rules.columns, "sure"), "rule-level"))
    every = functools.reduce(DataFrame.union, [d.select(*rules.columns, "sure") for d in done])
    return every.filter((F.col("confidence") >= confidence) & (F.col("sure") < F.col("confidence"))).drop("sure")


def mined_verdicts(urls: DataFrame, mined: Mined, url: str = "url") -> DataFrame:
    """(`url`, `mined`, `confidence`) of the different URLs that a mined rule fits: the surest one, of equal ones the
    one with more support, then with more tokens, then `block`. A URL that has one of the tokens that always went
    together among the labelled URLs has the token that stands for them."""
    rules = cut_lineage(mined.rules, "rules")
    merged = checked_keys(mined.merged)
    each = rules.select(F.explode("tokens").alias("token"))
    rare = each.groupBy("token").agg(F.count("*").alias("n"))
    posted = rules.withColumn("token", F.explode("tokens")).join(rare, "token")
    posted = posted.groupBy("tokens", "mined", "support", "confidence").agg(F.min(F.struct("n", "token")).alias("x"))
    index = checked_keys(posted.select("tokens", "mined", "support", "confidence", F.col("x.token").alias("token")))
    own = urls.select(F.col(url).alias("url")).filter(F.col("url").isNotNull()).distinct().withColumn("own", url_tokens("url"))
    own = _replaced(own, "own", merged.keys, merged.small, "url")
    met = own.withColumn("token", F.explode("own")).join(F.broadcast(index.keys) if index.small else index.keys, "token")
    met = met.filter(F.size(F.array_except("tokens", "own")) == 0)
    best = met.groupBy("url").agg(F.max(F.struct("confidence", "support", F.size("tokens").alias("n"), "mined")).alias("x"))
    return best.select("url", "x.mined", "x.confidence")


def judge(pages: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, id: str = "page_id", url: str = "url") -> DataFrame:
    """One row (`id`, `host`, `path`, `rule`, `verdict`, `confidence`) for each row of `pages`.

    The verdict is that of the longest given rule that fits (`rule` names it), else that of the surest mined rule (with
    its `confidence`), else `allow`. `labelled` (`url`, `verdict`) is what rules are mined from; if it is left out,
    the URLs that given rules decide are. Null and odd URLs have an empty host and path and are allowed; ids may be null
    or repeat; rows with the same URL get the same verdict; an empty table gives an empty one.
    """
    require(pages, id, url)
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"))
    given = cut_lineage(given_verdicts(rows, rules), "given")
    if labelled is None:
        labelled = rows.join(given, "url").select("url", F.col("given").alias("verdict"))
    mined = mined_verdicts(rows.join(given, "url", "left_anti"), mine(labelled))
    known = given.select("url", "rule", F.col("given").alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    known = known.union(mined.select("url", F.lit(None).cast("string"), "mined", "confidence"))
    known = cut_lineage(known, "verdicts")
    host, path = host_and_path("url")
    out = rows.select("id", "url", host.alias("host"), path.alias("path")).join(known, "url", "left")
    return out.select(F.col("id").alias(id), "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"), "confidence")
