"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

A document's words are cut at blanks, its set is the distinct runs of five words, its signature the least value of
each of 32 hash functions over the set. Documents are posted under each (coordinate, value) pair. Two sets with a
similarity of 0.75 agree in 24 coordinates on average and in fewer than 13 with a chance of about one in 100,000, so
candidates are the pairs that collide at least 13 times:

* prefix: pairs that nobody else has cannot collide; of the others a document posts only its rarest, so many that two
  documents with 13 collisions share a posted one;
* skip: the remaining, longer lists are never merged. For a pair met in a short list the collisions there are looked
  up in the two signatures, and a pair counts only at its first common posted coordinate, so it is met once;
* a list of many documents is cut into tiles of bounded bytes, and tile pairs are spread over tasks.

Candidates are confirmed on the whole sets, then linked documents are joined to components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import shingles as sh
from corpusloom.llm.common import free_name, pieces, released, require, small_side, text_bytes
from corpusloom.llm.components import connected_components
from corpusloom.session import checked_keys, cut_lineage, key_bytes

COORDINATES = 32
MATCHES = 13
PIECE_BYTES = 1 << 20  # of text that are hashed at a time
LIST_ROWS = 64  # longer lists are cut into tiles
TILE_ROWS = 1024
TILE_SHINGLES = 1 << 21

_FACTORS = sh.mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = sh.mixed(np.arange(101, COORDINATES + 101, dtype=np.uint64))


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of coordinates for each row of shingles; rows without any hold -1."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.full((len(offsets) - 1, COORDINATES), -1, np.int32)
    if len(full):
        for k in range(COORDINATES):
            least = np.minimum.reduceat(values * _FACTORS[k] + _SHIFTS[k], offsets[:-1][full])
            out[full, k] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _sets_of(batch: pa.RecordBatch, text: str, words: int):
    hashes, rows = sh.word_hashes(*text_bytes(batch.column(text)))
    values, offsets = sh.shingle_hashes(hashes, rows, words)
    return values, offsets, sh.distinct_sets(values, offsets)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _nodes(digests: list[bytes]) -> pa.Array:
    return pa.array(np.frombuffer(b"".join(d[:8] for d in digests), np.int64))


def with_signatures(docs: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """(`id`, `n_shingles`, `digest` of the set, `node`, its first 64 bits, `signature`) of every row, in one pass over
    the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            values, offsets, sets = _sets_of(batch, "text", words)
            coordinates = signatures(values, offsets)
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _nodes(digests),
                    pa.ListArray.from_arrays(np.arange(0, coordinates.size + 1, COORDINATES, np.int32), coordinates.ravel()),
                ],
                names=["id", "n_shingles", "digest", "node", "signature"],
            )

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"id {kind}, n_shingles long, digest binary, node long, signature array<int>")


def shingle_sets(docs: DataFrame, ids: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """(`id`, `shingles`) of the sets of documents whose ids are in `ids`; here `id` is the set's node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            sets = _sets_of(batch, "text", words)[2]
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([_nodes([_digest(s) for s in sets]), pa.ListArray.from_arrays(at, flat)], names=["id", "shingles"])

    keys = checked_keys(ids.distinct())
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(keys.keys) if keys.small else keys.keys, "id", "left_semi")
    return rows.select("text").mapInArrow(released(run), "id long, shingles array<long>")


def postings(sets: DataFrame) -> DataFrame:
    """The posted coordinates of every set: `coordinate`, `value`, `id`, `n_shingles`, `signature`, `posted`
    (bits of the set's posted coordinates), `n` (documents in the list) and `n_all` (their shingles)."""
    each = sets.select("id", "n_shingles", F.posexplode("signature").alias("coordinate", "value"))
    lists = each.groupBy("coordinate", "value").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("n_all")).filter("n > 1")
    lists = cut_lineage(lists, "lists")  # stored, so that a long list's rows can be split in the join
    shared = each.join(lists, ["coordinate", "value"])
    ranked = shared.groupBy("id", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("n", "coordinate", "value", "n_all"))).alias("lists"))
    ranked = ranked.filter(F.size("lists") >= MATCHES)
    chosen = ranked.select("id", "n_shingles", F.slice("lists", 1, F.size("lists") - (MATCHES - 1)).alias("lists"))
    bits = F.aggregate("lists", F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["coordinate"])))
    return chosen.select("id", "n_shingles", bits.alias("posted"), F.explode("lists").alias("x")).select("id", "n_shingles", "posted", "x.*")


def _bits(equal: np.ndarray) -> np.ndarray:
    return (equal * (np.int64(1) << np.arange(COORDINATES, dtype=np.int64))).sum(-1)


def _colliding(a, b, coordinate, posted, signature, size) -> np.ndarray:
    """Which pairs of rows collide often enough, may be similar enough by size, and meet here first."""
    equal = signature[a] == signature[b]
    common = _bits(equal) & posted[a] & posted[b]
    first = (common & -common) == (np.int64(1) << coordinate[a])
    low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    return (equal.sum(-1) >= MATCHES) & first & (100 * low >= 75 * high)


def _columns(batch: pa.RecordBatch):
    get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    signature = batch.column("signature").flatten().to_numpy().reshape(-1, COORDINATES)
    return get("id"), get("coordinate").astype(np.int64), get("posted"), signature, get("n_shingles")


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group of equal `names` ends; rows come sorted by these."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        same = np.ones(last + 1, bool)
        for name in names:
            same &= batch.column(name).to_numpy(zero_copy_only=False) == batch.column(name)[last].as_py()
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        elif kept and any(kept[-1].column(n)[-1].as_py() != batch.column(n)[0].as_py() for n in names):
            yield pa.Table.from_batches(kept)
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def candidates(lists: DataFrame) -> DataFrame:
    """Pairs (`a`, `b`) of documents of short lists that collide often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["coordinate", "value"]):
            batch = table.combine_chunks().to_batches()[0]
            id, coordinate, posted, signature, size = _columns(batch)
            value = batch.column("value").to_numpy()
            for step in range(1, LIST_ROWS):
                a = np.flatnonzero((coordinate[:-step] == coordinate[step:]) & (value[:-step] == value[step:]))
                if not len(a):
                    break
                a = a[_colliding(a, a + step, coordinate, posted, signature, size)]
                yield pa.RecordBatch.from_arrays([pa.array(id[a]), pa.array(id[a + step])], names=["a", "b"])

    kind = lists.schema["id"].dataType.simpleString()
    dealt = lists.repartition("coordinate", "value").sortWithinPartitions("coordinate", "value")
    return dealt.mapInArrow(released(run), f"a {kind}, b {kind}")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 0.75 or more."""
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(b) else 0
    return 100 * both >= 75 * (len(a) + len(b) - both) > 0


def tile_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (`a`, `b`) among the documents of long lists: of each pair of tiles so many confirmed pairs as join
    what is linked there. `sets` holds the shingles of the lists' documents."""

    def root(of: np.ndarray, i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    def links(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        id, coordinate, posted, signature, size = _columns(batch)
        tile, own = batch.column("tile").to_numpy(), batch.column("i").to_numpy()
        other = batch.column("j").to_numpy()
        members = batch.column("shingles")
        flat, at = members.flatten().to_numpy(), np.asarray(members.offsets) - members.offsets[0].as_py()
        left, right = np.flatnonzero(tile == own), np.flatnonzero(tile == other)
        of, found = np.arange(len(id)), []
        for a in left:
            b = right[right > a] if own[0] == other[0] else right
            for c in b[_colliding(np.full(len(b), a), b, coordinate, posted, signature, size)]:
                x, y = root(of, a), root(of, c)
                if x != y and similar(flat[at[a] : at[a + 1]].view(np.uint64), flat[at[c] : at[c + 1]].view(np.uint64)):
                    of[max(x, y)] = min(x, y)
                    found.append((id[a], id[c]))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], table.schema.field("id").type), pa.array([y for _, y in found], table.schema.field("id").type)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["coordinate", "value", "i", "j"]
        for table in _whole_groups(batches, names):
            keys = [table.column(n).to_numpy() for n in names]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, table.num_rows]):
                yield links(table.slice(start, stop - start))

    kind = lists.schema["id"].dataType.simpleString()
    tiles = F.greatest(F.ceil(F.col("n") / TILE_ROWS), F.ceil(F.col("n_all") / TILE_SHINGLES)).cast("int")
    placed = lists.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("i"), F.greatest(t, "tile").alias("j")))
    spread = placed.join(sets, "id").select("*", F.explode(pairs).alias("pair")).select("coordinate", "value", "pair.i", "pair.j", "tile", "id", "n_shingles", "posted", "signature", "shingles")
    dealt = spread.repartition("coordinate", "value", "i", "j").sortWithinPartitions("coordinate", "value", "i", "j")
    return dealt.mapInArrow(released(run), f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets have a similarity of 0.75 or more."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(100 * common >= 75 * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = sh.WORDS) -> DataFrame:
    """One row (`id`, `n_shingles`, `component_id`, `kept`) for each row of `docs`.

    `component_id` is the least id that a document reaches over links, its own included; `kept` marks the document
    that has it, one of each component. Links join documents with 100 * intersection >= 75 * union of their sets.

    Null and empty texts, and texts of blanks, have no shingles, link with nothing and are kept. Fewer words than
    make a shingle count as one shingle. Each row goes by its own text, also where ids repeat: rows that repeat id
    and text get the same result. A null id cannot be named: its row has a null component and is not kept, and links
    nobody. An empty table gives an empty one; other columns of `docs` play no part.
    """
    require(docs, id, text)
    stored = cut_lineage(with_signatures(docs, id, text, words), "signatures")
    known = stored.filter(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    first = known.groupBy("digest").agg(F.min(F.struct("id", "node", "n_shingles", "signature")).alias("x"))
    first = cut_lineage(first.select("digest", F.col("x.id").alias("doc"), F.col("x.node").alias("id"), "x.n_shingles", "x.signature"), "sets")
    sets = first.drop("doc")
    lists = postings(sets).join(sets.select("id", "n_shingles", "signature"), ["id", "n_shingles"])
    lists = cut_lineage(lists, "postings")
    short, long = lists.filter(F.col("n") <= LIST_ROWS), lists.filter(F.col("n") > LIST_ROWS)
    pairs = cut_lineage(candidates(short).filter("a != b"), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(long.select("id")).distinct()
    members = cut_lineage(shingle_sets(docs, first.join(wanted, "id", "left_semi").select(F.col("doc").alias("id")), id, text, words), "members")
    members = members.dropDuplicates(["id"])
    found = confirmed(pairs, members).union(tile_links(long, members))
    parts = connected_components(found)
    marked = cut_lineage(first.join(parts, first["id"] == parts["node"], "left").select("digest", "doc", "component"), "marked")
    linked = marked.filter(F.col("component").isNotNull())
    least = cut_lineage(linked.groupBy("component").agg(F.min("doc").alias("c")), "least")
    n, size = least.agg(F.count("*"), F.coalesce(F.sum(key_bytes("component", "c")), F.lit(0))).first()
    named = linked.join(small_side(least, n, size), "component").select("digest", "c")
    named = cut_lineage(named.union(marked.filter(F.col("component").isNull()).select("digest", "doc")), "components")
    out = stored.join(named, "digest", "left")
    component = F.coalesce("c", "id")
    return out.select(
        F.col("id").alias(id), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each group of near-duplicates, that of the least id.

    Rows go by id and text: of rows that share an id only those are dropped whose own text is in a group. Of rows equal in
    both one stays, and of linked texts of one id that with the least hash. Null ids come before all others. Rows
    without shingles all stay.
    """
    key = free_name(docs, "key")
    flagged = docs.withColumn(key, F.struct(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")))
    found = near_duplicates(flagged, key, text)
    counted = found.groupBy(key).agg(F.max("kept").alias("kept"), F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    odd = counted.filter(~F.col("kept") | ((F.col("rows") > 1) & (F.col("n") > 0))).select(F.col(f"{key}.id").alias("id"), F.col(f"{key}.h").alias("h"), "kept")
    marks = checked_keys(odd)
    marks = F.broadcast(marks.keys) if marks.small else marks.keys
    mine, h = flagged[key]["id"], flagged[key]["h"]
    rest = flagged.join(marks, mine.eqNullSafe(marks["id"]) & (h == marks["h"]), "left_anti")
    again = marks.filter("kept")
    repeated = flagged.join(again, mine.eqNullSafe(again["id"]) & (h == again["h"]), "left_semi").dropDuplicates([key])
    return rest.unionByName(repeated).select(docs.columns)
