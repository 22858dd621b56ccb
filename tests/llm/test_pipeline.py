"""The pipeline's stages keep the columns of documents and take effect."""

import corpus_pipeline
from tessera.llm.io import keep, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, counts = table(spark, SF, "documents"), []
    counts.append(docs.count())
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = keep(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "token_output":
            assert docs.columns == before.columns
            assert docs.select("doc_id").exceptAll(docs.select("doc_id").limit(0)).join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[5] == counts[4]


def test_empty_input(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF), "empty")
        assert docs.count() == 0
