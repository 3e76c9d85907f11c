"""Registered queries against their SQL, and the pipeline stage by stage."""

import os

import pytest

import corpus_pipeline
from compare import difference, duck
from rolefeed.llm import decontaminate, jaccard_join, quality
from rolefeed.llm.queries import ORACLE, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) is None


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, con):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF_DIR).cache()
        assert after.columns == docs.columns and 0 < after.count() <= before.count(), name
        if name == "quality classifier":
            model = quality.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
            kept = {r.doc_id for r in quality.score_documents(docs, model).where("predicted = 1").collect()}
            assert {r.doc_id for r in after.collect()} == kept
        if name == "n-gram Jaccard join":
            again = jaccard_join.near_duplicates(after)
            assert again.where("doc_id <> component_id").count() == 0
        if name == "benchmark decontamination":
            assert decontaminate.contamination_report(after, benchmark).where("contaminated").count() == 0
            assert after.where("n_chars <> length(text)").count() == 0
        before = after
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}
