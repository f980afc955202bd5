"""A Merkle manifest of a dataset: a tree over each source's rows, a tree over the sources, and a proof for every row.

Rows are numbered within their source without gathering it: a range shuffle puts them in order, and sums over its ranges
give where each range starts. The numbers are cut into partitions of fanout^levels rows, so that every partition is a
whole subtree. Its tree is built in memory; the levels above come by a butterfly exchange. In each round the partitions
that lie at the same place of neighbouring subtrees swap the roots of these. Each of them hashes the parent for itself,
which all partitions of a subtree therefore know, and keeps the others' roots as its proof. After the last round
every partition holds its upper proof; nothing is sent down again. Sources are joined by the same exchange.

The last subtree of a tree may have fewer partitions than its neighbours. They then stand in for the missing ones, in
turn, so that every partition of the neighbours has someone to swap with.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import require, small_side
from corpusloom.session import cut_lineage, key_bytes

FANOUT = 3
LEVELS = 7  # of a partition: up to 2,187 rows
RANGE_ROWS = 50_000
_RUN_OF_RANGES = 1024
PROOF = "array<struct<left: string, right: string>>"


# leaves and proofs as expressions -----------------------------------------------------------------
def field(value: Column) -> Column:
    """A field of a leaf: `-` if null, else the number of its bytes as text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, start, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof one after another."""
    return F.array_join(F.transform(proof, lambda run: F.concat(run["left"], run["right"])), "")


# the tree of one partition ------------------------------------------------------------------------
def _parents(nodes: list[str], fanout: int) -> list[str]:
    return [sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def height(leaves: int, fanout: int) -> int:
    """Levels of hashing above the leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // fanout), levels + 1
    return levels


def _levels(table: pa.Table, fanout: int, levels: int) -> list[list[str]]:
    """The nodes of a partition, level by level, up to its root; `table` is in the order of positions."""
    nodes = [table["leaf"].to_pylist()]
    for _ in range(min(levels, height(table["total"][0].as_py(), fanout))):
        nodes.append(_parents(nodes[-1], fanout))
    return nodes


def _root(fanout: int, levels: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        parts = -(-table["total"][0].as_py() // fanout**levels)
        digest = _levels(table, fanout, levels)[-1][0]
        return pa.table({"tree": [key[0].as_py()], "part": [key[1].as_py()], "parts": [parts], "digest": [digest]})

    return run


def _proofs(fanout: int, levels: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        nodes = _levels(table, fanout, levels)
        above = upper["proof"][0].as_py()
        far = [(p["left"], p["right"]) for p in above]
        left, right = [], []
        for i in range(table.num_rows):
            at = i
            for level in nodes[:-1]:
                start = at - at % fanout
                left.append("".join(level[start:at]))
                right.append("".join(level[at + 1 : start + fanout]))
                at //= fanout
            left += [a for a, _ in far]
            right += [b for _, b in far]
        width = len(nodes) - 1 + len(far)
        pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
        proof = pa.ListArray.from_arrays(pa.array(range(0, (table.num_rows + 1) * width, width) if width else [0] * (table.num_rows + 1), pa.int32()), pairs)
        n = table.num_rows
        return pa.table({
            "id": table["id"], "leaf": table["leaf"], "claimed": table["claimed"], "subroot": pa.repeat(upper["subroot"][0], n),
            "root": pa.repeat(upper["root"][0], n), "proof": proof,
        })

    return run


# numbering rows -----------------------------------------------------------------------------------
def _before(n: str, window) -> Column:
    return F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _ranges_before(counts: DataFrame) -> DataFrame:
    """(`range`, `before`): the sum of `n` over all lower ranges, by runs of ranges and over the runs."""
    runs = counts.withColumn("run", F.floor(F.col("range") / _RUN_OF_RANGES))
    inner = runs.withColumn("inner", _before("n", Window.partitionBy("run").orderBy("range")))
    outer = runs.groupBy("run").agg(F.sum("n").alias("n")).select("run", _before("n", Window.orderBy("run")).alias("outer"))
    return inner.join(outer, "run").select("range", (F.col("inner") + F.col("outer")).alias("before"))


def numbered(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(`tree`, `part`, `position`, `total`, `id`, `leaf`, `claimed`) of rows (`source`, `id`, `leaf`, `claimed`).

    `tree` counts the sources in their order, `position` the rows of a source in the order of (id, leaf), `part` its
    partitions. Equal rows are counted before they are dealt, so that copies of one row do not fill a range.
    """
    order = [F.col(c).asc_nulls_first() for c in ("source", "id", "leaf")]
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    copies = rows.groupBy("source", "id", "leaf", "claimed").agg(F.count("*").alias("copies"))
    dealt = cut_lineage(copies.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")

    # a stretch is what one range holds of one source
    counts = cut_lineage(dealt.groupBy("range", "source").agg(F.sum("copies").alias("n")), "stretches")
    of_source = Window.partitionBy("source")
    placed = counts.withColumn("start", _before("n", of_source.orderBy("range"))).withColumn("total", F.sum("n").over(of_source))
    placed = placed.withColumn("begins", (F.col("start") == 0).cast("long"))
    new = placed.groupBy("range").agg(F.sum("begins").alias("n"))
    begun = F.sum("begins").over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    stretches = placed.withColumn("begun", begun).join(_ranges_before(new), "range")
    stretches = cut_lineage(stretches.select("range", "source", "start", "total", (F.col("before") + F.col("begun") - 1).alias("tree")), "starts")
    n, size = stretches.agg(F.count("*"), F.coalesce(F.sum(key_bytes("range", "source", "start", "total", "tree")), F.lit(0))).first()

    inside = Window.partitionBy("range", "source").orderBy(F.col("id").asc_nulls_first(), F.col("leaf"))
    ordered = dealt.withColumn("inside", _before("copies", inside)).withColumnRenamed("range", "r").withColumnRenamed("source", "s")
    known = small_side(stretches, n, size)
    joined = ordered.join(known, (F.col("r") == F.col("range")) & F.col("s").eqNullSafe(F.col("source")))
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    position = F.col("start") + F.col("inside") + F.col("copy")
    return each.select(
        "tree", F.floor(position / F.lit(fanout**levels)).cast("long").alias("part"), position.alias("position"), "total", "id", "leaf", "claimed"
    )


# the levels above ---------------------------------------------------------------------------------
def butterfly(states: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(`tree`, `part`, `digest`, `proof`): each partition's root and the runs of siblings on the way to it.

    `states` has a row (`tree`, `part`, `parts`, `digest`) for each of a tree's `parts` partitions, counted from 0.
    Round r joins subtrees of fanout^r partitions: a partition's lane is its number within its subtree, and those of one
    lane below the same parent meet, at most `fanout` of them. Rounds grow with the logarithm of the largest tree.
    """
    most = states.agg(F.coalesce(F.max("parts"), F.lit(0))).first()[0]
    states = states.withColumn("proof", F.array().cast(PROOF))
    lanes = 1
    while -(-most // lanes) > 1:
        width = F.ceil(F.col("parts") / lanes)
        busy = states.filter(width > 1).withColumn("node", F.floor(F.col("part") / lanes)).withColumn("lane", F.col("part") % lanes)
        own = F.col("parts") - F.col("node") * lanes  # partitions of the last subtree
        digit = F.col("node") % fanout
        stands_in = (F.col("node") == width - 1) & (own < lanes) & (digit > 0)
        served = F.when(stands_in, F.sequence(F.col("lane"), F.lit(lanes - 1).cast("long"), own)).otherwise(F.array("lane"))
        sent = busy.withColumn("served", F.explode(served)).withColumn("mine", F.col("served") == F.col("lane"))
        member = F.struct(
            digit.alias("digit"), "digest", F.when(F.col("mine"), F.col("part")).alias("part"), F.when(F.col("mine"), F.col("proof")).alias("proof"),
        )
        met = sent.groupBy("tree", "parts", F.floor(F.col("node") / fanout).alias("parent"), "served").agg(F.sort_array(F.collect_list(member)).alias("run"))
        parent = F.sha2(F.array_join("run.digest", ""), 256)
        each = met.select("tree", "parts", parent.alias("parent_digest"), "run", F.explode("run").alias("me")).filter("me.part IS NOT NULL")
        joined = lambda side: F.array_join(F.transform(F.filter("run", side), lambda x: x["digest"]), "")
        left, right = joined(lambda x: x["digit"] < F.col("me.digit")), joined(lambda x: x["digit"] > F.col("me.digit"))
        step = F.array(F.struct(left.alias("left"), right.alias("right"))).cast(PROOF)
        risen = each.select("tree", F.col("me.part").alias("part"), "parts", F.col("parent_digest").alias("digest"), F.concat("me.proof", step).alias("proof"))
        states = cut_lineage(states.filter(width <= 1).select(*risen.columns).unionByName(risen), "butterfly")
        lanes *= fanout
    return states.select("tree", "part", "digest", "proof")


def manifest(
    docs: DataFrame, fields: list[str], id: str = "doc_id", source: str = "source", claimed: dict[str, Column] | None = None,
    fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """(`id`, `leaf`, `subroot`, `root`, `proof`, `claimed_leaf`) of every row; the id's column keeps its name.

    A leaf is the hash of `fields` (see `field`). In each source leaves stand in the order of ids, of which equal ones
    are ordered by leaf; runs of `fanout` become the hash of their digests until one is left, the subroot. The subroots,
    in the order of sources, likewise give the root. `proof` has for each level the siblings left and right of the node.
    `claimed_leaf` is the leaf that the columns in `claimed` give in place of the fields of the same names.

    A null source comes first and is a source; null ids come first in theirs. Repeated rows are leaves like others.
    An empty table gives no rows. Other columns are not looked at.
    """
    require(docs, id, source, *fields)
    if fanout < 2 or levels < 0:
        raise ValueError("a tree needs a fanout of 2 or more, and a partition no less than one row")
    values = {f: F.col(f) for f in fields}
    told = leaf(list((values | {k: v for k, v in (claimed or {}).items() if k in values}).values()))
    rows = docs.select(F.col(source).alias("source"), F.col(id).alias("id"), leaf(list(values.values())).alias("leaf"), told.alias("claimed"))
    placed = cut_lineage(numbered(cut_lineage(rows, "leaves"), fanout, levels), "numbered")
    roots = placed.groupBy("tree", "part").applyInArrow(_root(fanout, levels), "tree long, part long, parts long, digest string")
    lower = cut_lineage(butterfly(cut_lineage(roots, "subtrees"), fanout), "lower")
    sources = lower.filter("part = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("part"), F.col("digest").alias("digest"))
    n = sources.count()
    over = butterfly(sources.withColumn("parts", F.lit(n).cast("long")), fanout).select(
        F.col("part").alias("tree"), F.col("digest").alias("root"), F.col("proof").alias("beyond")
    )
    known = cut_lineage(over, "sources")
    rows_, size = known.agg(F.count("*"), F.coalesce(F.sum(key_bytes("root", "beyond")), F.lit(0))).first()
    upper = lower.join(small_side(known, rows_, size), "tree").select(
        "tree", "part", F.col("digest").alias("subroot"), "root", F.concat("proof", "beyond").alias("proof")
    )
    kind = docs.schema[id].dataType.simpleString()
    ddl = f"id {kind}, leaf string, claimed string, subroot string, root string, proof {PROOF}"
    proven = placed.groupBy("tree", "part").cogroup(upper.groupBy("tree", "part")).applyInArrow(_proofs(fanout, levels), ddl)
    return proven.select(F.col("id").alias(id), "leaf", "subroot", "root", "proof", F.col("claimed").alias("claimed_leaf"))


def audit(proven: DataFrame) -> DataFrame:
    """A manifest with `folded_root`, which the claimed leaf and the proof give, and `verified`: whether it is the root."""
    folded = proven.withColumn("folded_root", fold(F.col("claimed_leaf"), F.col("proof")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
