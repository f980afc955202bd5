import public_tokenizers
import tiktoken
from test_decontaminate import brute as contaminated
from test_minhash import brute as near

import corpus_pipeline
from corpusloom.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.cut_lineage(stage(spark, before, SF), "test")
        kept[name] = (before, docs)
        if name != "byte_level_bpe":
            assert docs.columns == columns
            assert docs.exceptAll(before).count() == 0
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    texts = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    assert len(ids(kept["toxicity"][1])) >= 0.8 * 200
    assert ids(kept["language"][1]) == ids(kept["language"][0])  # all of these are clean
    before, after = kept["near_duplicates"]
    assert ids(after) == {i for i, x in near(texts(before)).items() if x[2]}
    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(after) == {x[0] for x in contaminated(texts(before), items) if not x[-1]}
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    text = dict(texts(after))
    last = kept["byte_level_bpe"][1].collect()
    assert {r.doc_id for r in last} == set(text) and all(r.same_text and r.ids == library.encode_ordinary(text[r.doc_id]) for r in last)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(text)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "plain words here", "en", "s", 16), (2, "", "en", "s", 0), (3, "twice the same", "en", "s", 14), (3, "twice the same", "en", "s", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(3, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, str(tmp_path))
            assert out.columns == given.columns and out.count() <= given.count()
        assert corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path)).count() == given.count()
