import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwell.operators import dense, fusion, lexical, metrics, rerank


def test_bm25_equals_the_formula(spark):
    chunks = {"c1": ("d1", "red fox red"), "c2": ("d1", "blue fox jumps over"), "c3": ("d2", "green dog"), "c4": ("d3", "red red dog fox fox")}
    df = spark.createDataFrame([(c, d, t) for c, (d, t) in chunks.items()], "chunk_id string, document_id string, text string")
    cases = spark.createDataFrame([(1, "red red FOX"), (2, "nothing here")], "case_id long, question string")
    tf = {c: Counter(t.split()) for c, (_, t) in chunks.items()}
    n, avg = len(chunks), sum(len(t.split()) for _, t in chunks.values()) / len(chunks)
    want = {}
    for c, (_, t) in chunks.items():
        s = 0.0
        for q in ("red", "red", "fox"):  # repeated query tokens count repeatedly
            d = sum(q in x for x in tf.values())
            s += math.log(1 + (n - d + 0.5) / (d + 0.5)) * tf[c][q] * 2.5 / (tf[c][q] + 1.5 * (0.25 + 0.75 * len(t.split()) / avg))
        if s > 0:
            want[c] = s
    scores = lexical.bm25_scores(lexical.tokenised(df), cases)
    got = {r["chunk_id"]: r["score"] for r in scores.collect()}
    assert got == pytest.approx(want, abs=1e-8)
    docs = lexical.top_documents(scores).orderBy("rank").collect()
    best = sorted(((-max(s for c, s in want.items() if chunks[c][0] == d), d) for d in ("d1", "d3")))
    assert [r["document_id"] for r in docs] == [d for _, d in best]
    assert {r["document_id"]: r["best_chunk_id"] for r in docs} == {"d1": max(("c1", "c2"), key=want.get), "d3": "c4"}


def test_ties_go_to_smaller_ids(spark):
    s = spark.createDataFrame([(1, "b", "y", 1.0), (1, "a", "y", 1.0), (1, "c", "x", 1.0)], "case_id long, chunk_id string, document_id string, score double")
    assert [(r["document_id"], r["best_chunk_id"]) for r in lexical.top_documents(s).orderBy("rank").collect()] == [("x", "c"), ("y", "a")]


def test_exact_search_in_blocks(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(12)], "id long, v array<float>")
    q = v.where("id < 5").select(F.col("id").alias("case_id"), F.col("v").alias("q"))
    key = lambda d: sorted((r["case_id"], r["rank"], r["id"]) for r in d.collect())
    assert key(dense.nearest(q, v, 3)) == key(dense.nearest(q, v, 3, block=2))
    assert [r["id"] for r in dense.nearest(q.where("case_id = 0"), v, 2).orderBy("rank").collect()] == [6, 7]
    assert dense.vector_literal([1, 0.125, -0.0]) == "[1,0.125,-0]"
    with pytest.raises(ValueError):
        dense.vector_literal([])


def test_cache_computes_only_what_is_missing(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    cache = spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<float>")

    def embed(frames):
        for f in frames:
            assert set(f["chunk_id"]) <= {"b"}
            yield f.assign(embedding=[[2.0]] * len(f))[["chunk_id", "embedding"]]

    assert {r["chunk_id"]: r["embedding"] for r in dense.embed_missing(chunks, cache, embed).collect()} == {"a": [1.0], "b": [2.0]}


def ranking(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "case_id long, rank int, document_id string")


def test_fusion(spark):
    a, b = ranking(spark, [(1, "x"), (2, "both"), (3, "x")]), ranking(spark, [(1, "y"), (2, "both")])
    rows = fusion.fuse(fusion.weighted(a, b), "case_id").orderBy("rank").collect()
    assert rows[0]["document_id"] == "both" and rows[0]["score"] == pytest.approx(2 / 62, abs=1e-9) and rows[0]["ranks"] == {"bm25": 2, "dense": 2}
    assert rows[1]["document_id"] == "x" and rows[1]["score"] == pytest.approx(1 / 61, abs=1e-9)
    heavy = fusion.fuse(fusion.weighted(a, b, dense_weight=4.0), "case_id").orderBy("rank").collect()
    assert heavy[1]["document_id"] == "y"
    for bad in ({"constant": 0}, {"dense_weight": 0.0}):
        with pytest.raises(ValueError):
            fusion.weighted(a, b, **bad)
    assert fusion.grid(a, b).select("trial_constant", "trial_weight").distinct().count() == 20


def test_selection_prefers_the_smaller_weight_on_a_full_tie(spark):
    t = spark.createDataFrame([(60, w, 0.5, 0.5, 0.5) for w in (1.25, 0.75)] + [(20, 0.75, 0.5, 0.5, 0.5)], "trial_constant int, trial_weight double, ndcg_at_10 double, recall_at_5 double, mrr_at_10 double")
    r = fusion.select_config(t).first()
    assert (r["trial_constant"], r["trial_weight"]) == (60, 0.75)


def test_metrics(spark):
    ranked = ranking(spark, [(1, "no"), (2, "a"), (3, "b")])
    rel = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "case_id long, document_id string")
    m = {r["case_id"]: r for r in metrics.case_metrics(ranked, rel, "case_id", ks=(2, 3)).collect()}
    assert (m[1]["recall_at_2"], m[1]["precision_at_2"], m[1]["mrr_at_10"], m[1]["ndcg_at_3"]) == (0.5, 0.5, 0.5, 0.693426)
    assert (m[2]["recall_at_3"], m[2]["mrr_at_10"]) == (0.0, 0.0)
    assert {r["case_id"]: r["first_relevant_rank"] for r in metrics.first_relevant_rank(ranked, rel).collect()} == {1: 2, 2: None}
    with pytest.raises(ValueError):
        metrics.case_metrics(ranked, rel, "case_id", ks=(0,))


def test_summary_skips_nulls_and_deltas_need_both(spark):
    rows = spark.createDataFrame([("dev", "en", 1.0, True), ("dev", "en", None, False), ("test", "pt-BR", 0.5, None)], "split string, language string, m double, b boolean")
    s = metrics.summarise(rows, ["m", "b"])
    by = {r["group"]: r for r in s.collect()}
    assert by["all"]["m"] == 0.75 and by["dev"]["m"] == 1.0 and by["dev"]["b"] == 0.5 and by["test"]["b"] is None and by["language:en"]["case_count"] == 2
    now = metrics.long(s, ["m"], "group")
    assert metrics.deltas(now, now.where("group = 'all'"), "group").collect()[0]["delta"] == 0.0


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (10, 40, 20, 30)] + [("b", 10.0), ("b", 20.0)], "g string, v double")
    r = {x["g"]: x for x in metrics.latency(df, "v", "g").collect()}
    assert (r["a"]["p95"], r["a"]["p50"], r["a"]["total"]) == (40.0, 25.0, 100.0) and r["b"]["p50"] == 15.0


def test_rerank(spark):
    rows = [(1, "d1", 1, "c2", 0.5), (1, "d1", 1, "c1", 0.5), (1, "d2", 2, "c3", 0.9), (1, "d3", 3, "c4", 0.5), (1, "d2", 2, "c3", 0.9)]
    out = rerank.rerank(spark.createDataFrame(rows, "case_id long, document_id string, rank int, chunk_id string, score double")).orderBy("rank").collect()
    assert [(r["document_id"], r["best_chunk_id"]) for r in out] == [("d2", "c3"), ("d1", "c1"), ("d3", "c4")]
