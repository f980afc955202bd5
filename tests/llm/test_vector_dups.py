import numpy as np

from corpusloom.llm import vector_dups as vd


def brute(rows, threshold=0.98):
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    near = {i: [] for i, _, _ in rows}
    for i, v, a in rows:
        for j, w, b in rows:
            if i != j and a == b and usable(v, a) and usable(w, b) and len(v) == len(w):
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    near[i].append(j)
    least, changed = {i: i for i in near}, True
    while changed:
        changed = False
        for i in near:
            low = min([least[i], *(least[j] for j in near[i])])
            if low < least[i]:
                least[i], changed = low, True
    return {i: (len(n), least[i], least[i] == i) for i, n in near.items()}


def test_as_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vd, "TILE_ROWS", 40)
    rng = np.random.default_rng(1)
    rows = []
    for k in range(220):
        base = rng.normal(size=8) if k % 3 else np.ones(8)
        v = np.round((base + rng.normal(size=8) * [0, 0.1, 0.3][k % 3 - 1]) * 10 ** (k % 4), 4)
        rows.append((k, v.tolist(), k % 2))
    rows += [(900 + k, rows[0][1], 0) for k in range(4)]
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [None] * 8, 0), (1004, [], 0),
             (1005, rows[0][1], None), (1006, [float("inf")] * 8, 0), (1007, [1.0, 1.0], 0), (1008, [2.0, 2.0], 0), (1009, [1e300] * 8, 1)]
    rows = [r for r in rows if r[0] != 1009]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("weight", vd.F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vd.vector_duplicates(df).collect()}
    assert got == brute(rows)
    assert max(x[0] for x in got.values()) > 10
    assert vd.vector_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (4, [1.0, 2.01], 1)]
    got = [tuple(r) for r in vd.vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, False), (4, 2, 1, False)], key=str)


def test_bound_holds_and_loses_no_pair():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 1500)) * rng.uniform(0.01, 100, size=(300, 1))
    x[150:] = x[:150] * 3 + rng.normal(size=(150, 1500)) * np.linalg.norm(x[:150], axis=1)[:, None] * rng.uniform(0, 0.012, size=(150, 1))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, e = vd.quantised(unit)
    assert (vd.code_products(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()
    off = np.abs(vd.code_products(q, q) * s[:, None] * s[None] - unit @ unit.T)
    assert (off <= (1 + e)[:, None] * e[None] + e[:, None] + 1e-9).all()
    i, j = vd.close_pairs(x, x, 0.95)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(unit @ unit.T >= 0.95))))
