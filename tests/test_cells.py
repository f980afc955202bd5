import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import cells
from corpusloom.operators import vectors as vec
from corpusloom.plans import index_store, vector_cells
from corpusloom.session import cut_lineage, delete_path


def clustered(n, clusters, width, spread, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    rows = [(f"v{i:04d}", (centres[i % clusters] + rng.normal(size=width) * spread).tolist()) for i in range(n)]
    rows += [(f"w{i:04d}", rows[0][1]) for i in range(copies)]  # a third of all in one cell
    return rows + [("zero", [0.0] * width), ("far", (-100 * centres[0]).tolist())]


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<double>").repartition(4)


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6) + 0.0) for r in df.collect())


@pytest.mark.parametrize("spread, layout", [(0.05, {}), (3.0, {}), (0.05, {"cell_items": 20, "cell_queries": 3})])
def test_exact_search_equals_the_scan(spark, monkeypatch, spread, layout):
    monkeypatch.setattr(cells, "FIRST_ROWS", 40)
    stored = table(spark, clustered(300, 12, 10, spread, 1, copies=150))
    centres = cells.train(stored, 20)
    placed = cut_lineage(cells.assign(stored, centres))
    asked = stored.filter("id < 'v0040' or id in ('zero', 'far', 'w0003')").select(F.col("id").alias("query_id"), "embedding")
    found = cells.search(placed, asked, centres, cells.summary(placed), 7, **layout)
    exact, _ = vec.search(stored, asked, 7)
    assert ranked(found) == ranked(exact)


def test_probes_follow_what_was_measured(spark):
    """Clusters are found in a small share of the rows, evenly spread vectors need most of them; both reach the recall."""
    shares = {}
    for name, spread in (("clusters", 0.05), ("even", 50.0)):
        stored = table(spark, clustered(1200, 30, 16, spread, 2))
        centres = cells.train(stored)
        placed = cut_lineage(cells.assign(stored, centres))
        counted = cut_lineage(cells.summary(placed))
        assert counted.agg(F.sum("rows")).first()[0] == 1202
        asked = stored.filter(F.xxhash64("id") % 5 == 0).select(F.col("id").alias("query_id"), "embedding")
        enough = cells.enough_rows(placed, cells.Probes(centres, counted), 10)
        found = cells.search(placed, asked, centres, counted, 10, exact=False, enough=enough)
        row = cells.recall(found, vec.search(stored, asked, 10)[0]).first()
        assert row["found"] >= 0.93 * row["expected"]
        shares[name] = enough / 1202
    assert shares["clusters"] < 0.2 < shares["even"]


@pytest.mark.parametrize("exact", [True, False])
def test_a_query_meets_its_cells_in_place(spark, monkeypatch, exact):
    """One row a query, however many cells it probes, and the same neighbours in slices of the queries."""
    monkeypatch.setattr(cells, "FIRST_ROWS", 40)
    stored = table(spark, clustered(300, 12, 10, 0.5, 1, copies=150))
    centres = cells.train(stored, 20)
    placed = cut_lineage(cells.by_cell(cut_lineage(cells.assign(stored, centres))))
    counted = cut_lineage(cells.summary(placed))
    asked = stored.filter("id < 'v0040' or id in ('zero', 'far', 'w0003')").select(F.col("id").alias("query_id"), "embedding")
    probed = cells.probe(asked, cells.Probes(centres, counted), 200).collect()
    assert len(probed) == 43 and sum(r["probed"] for r in probed) > 43
    assert all(r["probed"] == bin(int.from_bytes(r["cells"])).count("1") for r in probed)
    whole = ranked(cells.search(placed, asked, centres, counted, 7, exact=exact, enough=200))
    sliced = cells.search(placed, asked, centres, counted, 7, exact=exact, enough=200, max_broadcast_queries=10, cell_queries=7)
    assert ranked(sliced) == whole and len(whole) == 43 * 7
    if exact:
        assert whole == ranked(vec.search(stored, asked, 7)[0])


def test_rows_that_repeat_are_one_neighbour(spark, monkeypatch):
    monkeypatch.setattr(cells, "FIRST_ROWS", 40)
    stored = table(spark, clustered(120, 4, 6, 0.5, 3))
    twice = stored.unionByName(stored).unionByName(stored).coalesce(1)
    centres = cells.train(stored, 4)
    placed = cut_lineage(cells.by_cell(cut_lineage(cells.assign(twice, centres))))
    asked = stored.filter("id < 'v0020'").select(F.col("id").alias("query_id"), "embedding")
    found = cells.search(placed, asked, centres, cells.summary(placed), 9)
    assert ranked(found) == ranked(vec.search(stored, asked, 9)[0])


def test_bounds_skip_cells():
    middle = np.eye(4)
    probes = cells.Probes.__new__(cells.Probes)
    probes.cell, probes.rows, probes.radius, probes.centres = np.arange(4, dtype=np.int32), np.array([5, 1, 7, 2]), np.full(4, 0.1), middle
    query = np.array([[1.0, 0, 0, 0]])
    assert probes.nearest(query, 5).tolist() == [[True, False, False, False]]
    assert probes.nearest(query, 6).tolist() == [[True, True, False, False]]
    assert probes.reachable(query, np.array([0.2])).tolist() == [[True, False, False, False]]
    assert probes.reachable(query, np.array([0.1])).tolist() == [[True] * 4]


CHUNK = schemas.CHUNK_DDL


def chunk_rows(spark, start, stop):
    pick = random.Random(start)
    words = "river bicycle lamp stone water wheel quiet seven green roof".split()
    rows = [(f"c{i:03d}", "t", "s", 0, " ".join(pick.choice(words) for _ in range(6)), f"sha{i}") for i in range(start, stop)]
    return spark.createDataFrame(rows, CHUNK)


def test_stored_cells_grow_with_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    index_store.build_vectors(chunk_rows(spark, 0, 60), path)
    assert vector_cells.refresh(spark, path) == [0]
    index_store.append_vectors(chunk_rows(spark, 40, 130), path)
    asked = chunk_rows(spark, 200, 210).select(F.col("id").alias("query_id"), F.col("text"))
    asked = vec.hash_vectors(asked).select("query_id", "embedding")
    with pytest.raises(ValueError, match="not in cells"):
        vector_cells.search(spark, path, asked)
    assert vector_cells.refresh(spark, path) == [1] and vector_cells.refresh(spark, path) == []
    exact = ranked(vec.search(index_store.index_table(spark, path, "vectors"), asked, 6)[0])
    assert ranked(vector_cells.search(spark, path, asked, 6)) == exact
    found = vector_cells.search(spark, path, asked, 6, exact=False).count()
    assert found == 60
    delete_path(spark, f"{index_store.home(spark, path)}/cells/summary/batch=00000001")  # an attempt that died before its end
    assert vector_cells.refresh(spark, path) == [1]
    assert ranked(vector_cells.search(spark, path, asked, 6)) == exact


def test_an_empty_index(spark, tmp_path):
    path = str(tmp_path / "empty")
    index_store.build_vectors(chunk_rows(spark, 0, 0), path)
    assert vector_cells.refresh(spark, path) == [0]
    asked = vec.hash_vectors(chunk_rows(spark, 1, 3)).select(F.col("id").alias("query_id"), "embedding")
    for exact in (True, False):
        assert vector_cells.search(spark, path, asked, exact=exact).collect() == []
    with pytest.raises(FileNotFoundError):
        vector_cells.search(spark, str(tmp_path / "none"), asked)
