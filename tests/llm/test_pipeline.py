import os

import pytest

import corpus_pipeline
from siftwell.llm import jaccard, pii


@pytest.fixture(scope="module")
def sf():
    """The smallest table whose labels are enough to learn a rule from (MIN_COVERED rows on the growing part)."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    counts = [docs.count()]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = jaccard.materialize(f(spark, before, sf), f"test-{k}")
        assert after.columns == docs.columns
        counts.append(after.count())
        if k == 0:
            kept = {r["doc_id"] for r in after.select("doc_id").collect()}
            lost = [i for i, q in labels.items() if q == 0 and i in kept]
            assert len(lost) <= 0.2 * sum(q == 0 for q in labels.values())
        if k == 1:
            found = jaccard.components(after, 5, 80).collect()
            assert all(r["doc"] == r["component"] for r in found)
        if k == 2:
            assert all(not any(pii.find_spans(r["text"])[x] for x in pii.BASE_KINDS) for r in after.collect())
        before = after
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert out.count() == counts[4] and out.where("n_tokens <> size(ids)").count() == 0


def test_empty(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        none = f(spark, none, sf)
        assert none.count() == 0
