import re

from corpusloom.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        own, hit, named = words(text), set(), set()
        for item, passage in items:
            w = words(passage)
            m = min(13, len(w))
            if not w or item is None:
                continue
            windows = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
            for k in range(len(own) - m + 1):
                if tuple(own[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    named.add(str(item))
        out.append((i, len(own), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=str)


def test_as_by_brute_force(spark):
    item = " ".join(f"Word{k % 11}é{k}" for k in range(40))
    loop = " ".join(["a b c"] * 20)
    items = [(1, item), (2, item), (12, "short One"), (13, loop), (14, None), (15, "..."), (None, item), (16, " ".join(f"z{k}" for k in range(9))), (17, "solo"), (13, "q w e r t y")]
    parts = item.split()
    docs = [
        (1, item.upper().replace("É", "é")), (2, " ".join(parts[:12])), (3, " ".join(parts[5:18])), (4, "x " * 300 + " ".join(parts[5:18]) + " y" * 10),
        (5, " ".join(parts[:13] + ["gap"] + parts[14:30])), (6, "nothing here"), (7, None), (8, ""), (9, "very SHORT one."), (10, loop + " " + loop),
        (11, " ".join(parts[3:20] + parts[3:20])), (12, "z0 z1 z2 z3 z4 z5 z6 z7 z8 and solo"), (13, " ".join(f"t{k}" for k in range(20000)) + " " + item),
        (14, "a b c " * 4 + "a"), (14, "a b c " * 4 + "a"), (None, item), (15, "q\nw-e,r;t(y)"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", dc.F.lit("clash")).withColumn("words", dc.F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in dc.contamination(df, bench).collect()]
    assert sorted(got, key=str) == brute(docs, items)
    clean = dc.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(x[0] or 0 for x in brute(docs, items) if not x[-1])


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in dc.contamination(docs, none).collect()] == [(1, 3, 0, 0, [], False)]
    assert dc.contamination(docs.limit(0), none).count() == 0


def test_plan_has_no_python(spark, capsys):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    found = dc.digests(dc.contamination(docs, docs.withColumnRenamed("doc_id", "item_id")))
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())


def test_only_the_contaminated_text_of_an_id_goes(spark):
    passage = "the answer to this question of the benchmark is a number that nobody would guess at all"
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, passage), (1, "a clean text"), (2, "clean too"), (None, passage), (None, "clean without a name"), (3, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    left = dc.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "clean without a name"), (1, "a clean text"), (2, "clean too"), (3, "")]
