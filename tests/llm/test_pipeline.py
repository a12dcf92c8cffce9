import corpus_pipeline
from plotgrid.llm import bpe
from plotgrid.session import cut_lineage


def test_every_stage_acts_on_what_is_left(spark, sf_dir, word_bpe):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] > counts[0] / 2
    last = {tuple(r) for r in bpe.digests(bpe.with_tokens(docs, word_bpe)).collect()}
    got = corpus_pipeline.run(spark, sf_dir).drop("token_ids")
    assert {tuple(r) for r in got.collect()} == last


def test_stages_on_odd_rows(spark, odd, empty, sf_dir):
    for frame in (odd, empty):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, sf_dir), name)
        assert docs.count() <= frame.count()
