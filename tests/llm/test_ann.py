import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import ann


def brute(x, ids, q, k):
    s = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [(i, d) for d, i in sorted((s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q])][:k]


def test_few_rows_are_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    bad = [(100, None, "x"), (101, [0.0] * 8, "x"), (102, [float("nan")] + [1.0] * 7, "x"), (103, [float("inf")] * 8, "x"), (104, [None] + [1.0] * 7, "x"), (105, [1.0, 2.0], "x"), (None, x[0].tolist(), "x"), (106, [], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, list string")
    out = ann.search(df.where("vec_id % 10 = 0"), df, 10).collect()
    assert {r["query_id"] for r in out} == {0, 10, 20, 30, 40, 50}
    for q in (0, 30):
        got = [(r["vec_id"], r["score"]) for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
        want = brute(x.astype(float), list(range(60)), q, 10)
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([d for _, d in got], [d for _, d in want], rtol=1e-12)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_recall_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 64)
    monkeypatch.setattr(ann, "PART_ROWS", 100)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[1000:2000] = x[1000]  # a third are exact copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    out = ann.search(df.where(F.col("vec_id") % 100 == 0), df, 10).collect()
    by = {}
    for r in out:
        by.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hit = sum(len({i for i, _ in brute(x.astype(float), list(range(3000)), q, 10)} & set(by[q].values())) for q in range(0, 3000, 100))
    assert hit >= 0.9 * 300 and all(len(v) == 10 for v in by.values())
    assert [by[1500][k] for k in range(1, 11)] == list(range(1000, 1010))


def test_queries_without_copies_among_many_copies():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(80, 16))
    single = rng.normal(size=(400, 16))
    x = np.concatenate([np.repeat(base, 45, axis=0), single])[rng.permutation(4000)]
    index = ann.Index(ann.bisect(x, 32))
    index.measure(x)
    lists = index.lists_of(x)
    u = np.unique(x, axis=0)
    at = {v.tobytes(): set(took) for v, took in zip(x, lists)}
    hit = []
    for q in single[:100]:
        near = u[np.argsort(((u - q) ** 2).sum(1), kind="stable")[1:11]]
        probed = set(index.search(q))
        hit.append(np.mean([bool(at[v.tobytes()] & probed) for v in near]))
    assert index.ratio > 1.01 and np.mean(hit) >= 0.85


def test_probes_on_until_there_are_enough_rows():
    index = ann.Index(np.array([[1.0, 0], [2, 0], [4, 0], [8, 0], [16, 0]]))
    index.sizes[:] = [1, 3, 3, 3, 30]
    index.least = 7
    assert index.search(np.array([1.0, 0])) == [0, 1, 2]
    index.least = 40
    assert index.search(np.array([1.1, 0])) == [0, 1, 2, 3, 4]


def test_length_is_that_of_most_rows(spark):
    rows = [(i, [1.0 + i, 2.0]) for i in range(1200)] + [(i, [1.0 + i, 2.0, 3.0]) for i in range(1200, 3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    out = ann.search(df.where("vec_id in (5, 2000)"), df, 2).collect()
    assert {(r["query_id"], r["vec_id"]) for r in out} == {(2000, 1999), (2000, 2001)}


@pytest.mark.parametrize("kind", ["double", "int"])
def test_other_element_types(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)) if kind == "double" else rng.integers(-50, 50, (300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(400, [None] * 4), (401, [1] * 3 if kind == "int" else [1.0] * 3)], f"vec_id long, embedding array<{kind}>")
    out = ann.search(df.where("vec_id % 100 = 0"), df, 5).collect()
    for q in (0, 100, 200):
        got = [(r["vec_id"], r["score"]) for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
        want = brute(x.astype(float), list(range(300)), q, 5)
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([d for _, d in got], [d for _, d in want], rtol=1e-12)
