import random

import numpy as np

from corpusloom.llm import language as lg

SYLLABLES = {"en": ["the", "ing", "wh", "tion"], "de": ["sch", "ung", "über", "ein"], "fr": ["eau", "oi", "ç", "que"]}


def texts(n, seed=1):
    pick = random.Random(seed)
    out = []
    for k in range(n):
        name = pick.choice(list(SYLLABLES))
        words = ["".join(pick.choice(SYLLABLES[name]) for _ in range(pick.randrange(1, 4))) for _ in range(pick.randrange(8, 60))]
        out.append((k, " ".join(words), name))
    return out


def test_trigrams_stay_inside_rows():
    raw = "abcab.c".encode()
    whole = lg.trigrams(np.frombuffer(raw, np.uint8), np.array([0, 7]))
    split = lg.trigrams(np.frombuffer(raw, np.uint8), np.array([0, 0, 3, 4, 7]))
    assert len(whole[0]) == 4 and split[1].tolist() == [1] and split[0][0] == whole[0][0]


def test_documents(spark):
    rows = [(k, t, lang if k % 10 else "en", f"h{k % 7}.site.org") for k, t, lang in texts(400)]
    truth = {k: lang for k, _, lang in texts(400)}
    odd = [(1000, None, "en", None), (1001, "", None, "h1.site.org"), (1002, "12 %% 3", "de", "x"), (1003, "日本語テキスト " * 5, None, None),
           (1004, "sch ung " * 20000, "de", "h1.site.org"), (None, "the whing tion the", None, ""), (5, rows[5][1], rows[5][2], rows[5][3])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string").withColumn("p", lg.F.lit("clash"))
    model = lg.train(docs, "text", lg.F.col("lang"))
    assert model.languages == ["de", "en", "fr", "und"]
    found = lg.identify(docs, model, declared=lg.F.col("lang"), host=lg.F.col("source")).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + len(odd)
    assert all(got[k].language == lang and got[k].kept and got[k].text_language == lang for k, lang in truth.items())
    assert not any(got[k].kept for k in (1000, 1001, 1002, 1003)) and got[1003].language == "und" and got[1004].language == "de" and got[1004].kept
    kept = lg.keep_identified(docs, model, declared=lg.F.col("lang"), host=lg.F.col("source"))
    assert kept.columns == docs.columns and kept.count() == len(rows) + len(odd) - 4
    assert lg.identify(docs.limit(0), model).count() == 0


def test_hosts_and_declarations_decide_where_texts_do_not(spark):
    pages = [(k, f'<html lang="{lang}"><script>x</script><p>{t}</p>', f"http://a.{lang}-site.{lang}/{k}") for k, t, lang in texts(300)]
    short = [(900, "<html><p>in</p>", "http://a.de-site.de/"), (901, "<html lang=fr><p>in</p>", "http://b.new-site.fr/q"), (902, None, None)]
    df = spark.createDataFrame(pages + short, "page_id long, html string, url string")
    rows = df.select("page_id", *[c.alias(k) for k, c in lg.page_evidence().items()])
    model = lg.train(rows, "text", lg.F.col("declared"))
    got = {r.page_id: r for r in lg.identify(rows, model, "page_id", declared=lg.F.col("declared"), host=lg.F.col("host"), suffix=lg.F.col("suffix")).collect()}
    assert got[900].language == "de" and got[901].language == "fr" and not got[902].kept
    assert sum(got[k].language == lang for k, _, lang in texts(300)) == 300


def test_nothing_declared(spark):
    docs = spark.createDataFrame([(1, "the thing"), (2, None)], "doc_id long, text string")
    model = lg.train(docs, "text", lg.F.lit(None).cast("string"))
    assert model.languages == ["und"] and {r.kept for r in lg.identify(docs, model).collect()} == {False}


def test_rare_languages_and_long_texts_stay_in_the_model(spark, monkeypatch):
    monkeypatch.setattr(lg, "SAMPLE_ROWS", 40)
    rows = [(k, t, lang) for k, t, lang in texts(1500)]
    pick = random.Random(2)
    rare = [(2000 + k, " ".join(pick.choice(("kzyx", "wqorb", "vlimt", "jupst", "hnaqk")) for _ in range(30)), "zz") for k in range(6)]
    long = [(3000 + k, " ".join(pick.choice(("dåfgø", "bærmk", "cøtlå")) for _ in range(3000)), "yy") for k in range(6)]
    few = [(4000 + k, f"gikmo pedra {k}", "xx") for k in range(4)]
    docs = spark.createDataFrame(rows + rare + long + few, "doc_id long, text string, lang string")
    model = lg.train(docs, "text", lg.F.col("lang"))
    assert model.languages == ["de", "en", "fr", "yy", "zz", "und"]
    got = {r.doc_id: r for r in lg.identify(docs, model, declared=lg.F.col("lang")).collect()}
    assert all(got[k].language == lang and got[k].kept for k, _, lang in rare + long)
    assert sum(got[k].language == lang for k, _, lang in rows) >= 1495
