import corpus_pipeline
from harrow.llm import decontamination, quality_model, secret_scan, similarity_join
from tests.llm import common
from tests.llm.test_similarity_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near copies", "contamination", "secrets", "pieces"]


def test_each_stage_acts_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        rows = {r.doc_id: r for r in docs.collect()}
        got = {r.doc_id: r for r in out.collect()}
        assert got.keys() <= rows.keys()
        if name == "near copies":
            groups = brute([(i, r.text) for i, r in rows.items()])
            assert sorted(got) == sorted(i for i in rows if groups[i][1] == i)
        elif name == "contamination":
            bad = {r.doc_id for r in decontamination.report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
            assert got.keys() == rows.keys() - bad
        elif name == "secrets":
            enc = secret_scan.encoding(corpus_pipeline.public_tokenizers.path(corpus_pipeline.RANKS))
            assert all(got[i].text == secret_scan.masked(r.text, secret_scan.find(r.text, enc)[1]) for i, r in rows.items())
        else:
            kept = {r.doc_id for r in quality_model.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
            assert got.keys() == kept
        docs = spark.createDataFrame(list(got.values()), docs.schema)
        seen.append(len(got))
    assert seen == sorted(seen, reverse=True) and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == seen[-1]


def test_hard_rows(spark):
    docs = common.hard(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
    assert docs.columns == ["doc_id", "n_tokens", "token_ids"]
    assert similarity_join.SHINGLE == 4


def test_near_copies_are_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(480)]
    near = [w + "x" if i % 48 == 24 else w for i, w in enumerate(words)]  # 0.81 in five words, 0.846 in four
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()] == [1]
