"""The pipeline's stages against plain versions on a small table."""

import pytest

import corpus_pipeline
from assaybook.llm import toxicity

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    from assaybook.llm.common import stored

    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), f"test-{name}")
        seen.append((name, docs, out))
        docs = out
    return {n: (a, b) for n, a, b in seen}


def test_all_but_the_last_return_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, (_, out) in stages.items() if out.columns != columns] == ["sentencepiece"]


def test_toxic_documents_go_and_only_they(spark, stages):
    before, after = stages["toxicity"]
    found = toxicity.classify(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in found.filter("predicted = 0").collect()}


def test_one_of_each_group_stays(stages):
    from tests.llm.test_operators import linked

    before, after = stages["near_duplicates"]
    classes = linked([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == set(classes.values())


def test_mixing_and_encoding_keep_every_row(stages):
    assert stages["pii"][0].count() == stages["pii"][1].count()
    assert stages["sentencepiece"][0].count() == stages["sentencepiece"][1].count()
    before, after = stages["mixing"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    assert max(r["count"] for r in after.groupBy("doc_id").count().collect()) <= 3


def test_run_returns_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages["sentencepiece"][1].collect()))
