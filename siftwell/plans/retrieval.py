"""Queries of the lexical index, dense search, fusion and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import dense, fusion, lexical, metrics
from siftwell.plans import sql as S
from siftwell.plans.fixtures import Corpus
from siftwell.plans.registry import query

LEX = "WITH " + S.TOKENS + S.CASES + S.BM25
FULL = LEX + S.DENSE + S.HYBRID
VECTORS = """WITH s AS (SELECT q.vec_id AS case_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score, q.label = v.label AS same
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10)
"""


@query("WITH " + S.TOKENS + " SELECT chunk_id, term, tf FROM post")
def term_frequencies(c: Corpus):
    return lexical.term_frequencies(c.tok).select("chunk_id", "term", "tf")


@query("WITH " + S.TOKENS + " SELECT count(*) AS n, round(avg(len), 6) AS avgdl, sum(len)::BIGINT AS total FROM tl")
def corpus_stats(c: Corpus):
    return lexical.tokenised(c.chunks).agg(F.count("*").alias("n"), F.round(F.avg("len"), 6).alias("avgdl"), F.sum("len").alias("total"))


@query("WITH " + S.TOKENS + " SELECT term, count(*) AS df FROM post GROUP BY term")
def document_frequencies(c: Corpus):
    return lexical.document_frequencies(lexical.terms(c.tok))


@query(LEX + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf(c: Corpus):
    found = lexical.with_idf(lexical.document_frequencies(lexical.terms(c.tok)), lexical.corpus_stats(lexical.tokenised(c.chunks)))
    return found.select("term", "df", F.round("idf", 6).alias("idf"))


@query(LEX + " SELECT case_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, chunk_id) AS rank FROM bs) WHERE rank <= 10")
def bm25_chunks(c: Corpus):
    return lexical.top_chunks(lexical.bm25_scores(c.tok, c.questions, k=lexical.DEPTH)).select("case_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


def _documents(df):
    return df.select("case_id", F.col("rank").cast("long").alias("rank"), "document_id", F.round("score", 6).alias("score"), "best_chunk_id")


@query(LEX + " SELECT case_id, rank, document_id, round(score, 6) AS score, best_chunk_id FROM bd")
def bm25_documents(c: Corpus):
    return _documents(c.bm25)


@query(VECTORS + " SELECT case_id, rank, id, round(score, 6) AS score FROM t")
def dense_chunks(c: Corpus):
    e = c.table("embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("q"))
    found = dense.nearest(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10)
    return found.select("case_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query(VECTORS + " SELECT case_id, count(*) FILTER (WHERE same) AS hits, round(count(*) FILTER (WHERE same) / 10.0::DOUBLE, 6) AS precision_at_10 FROM t GROUP BY case_id")
def dense_label_precision(c: Corpus):
    e = c.table("embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("q"))
    found = dense.nearest(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10)
    own, other = e.select(F.col("vec_id").alias("case_id"), F.col("label").alias("a")), e.select(F.col("vec_id").alias("id"), F.col("label").alias("b"))
    same = found.join(own, "case_id").join(other, "id").withColumn("same", F.col("a") == F.col("b"))
    return same.groupBy("case_id").agg(F.count_if("same").alias("hits"), F.round(F.count_if("same") / 10, 6).alias("precision_at_10"))


@query(LEX + S.DENSE + " SELECT case_id, rank, document_id, round(score, 6) AS score, best_chunk_id FROM dd")
def dense_documents(c: Corpus):
    return _documents(c.dense)


@query(FULL + """ SELECT h.case_id, h.rank, h.document_id, round(h.score, 9) AS score, coalesce(b.rank, 0) AS bm25_rank, coalesce(d.rank, 0) AS dense_rank
FROM hy h LEFT JOIN bd b USING (case_id, document_id) LEFT JOIN dd d USING (case_id, document_id)""")
def hybrid_rrf(c: Corpus):
    ranks = lambda s: F.coalesce(F.element_at("ranks", s), F.lit(0)).cast("long").alias(f"{s}_rank")
    return c.hybrid.select("case_id", F.col("rank").cast("long").alias("rank"), "document_id", "score", ranks("bm25"), ranks("dense"))


@query(LEX + S.metrics("m", "bd") + " SELECT * FROM m")
def retrieval_case_metrics(c: Corpus):
    return metrics.case_metrics(c.bm25, c.relevant, "case_id")


@query(LEX + S.metrics("m", "bd") + S.summary("s", "m") + " SELECT * FROM s")
def retrieval_summary(c: Corpus):
    return metrics.summarise(c.metrics_of(c.bm25), metrics.METRICS)


@query(LEX + S.DENSE + S.metrics("m", "dd") + S.summary("s", "m") + " SELECT * FROM s")
def dense_summary(c: Corpus):
    return metrics.summarise(c.metrics_of(c.dense), metrics.METRICS)


@query(FULL + S.metrics("m", "hy") + S.summary("s", "m") + " SELECT * FROM s")
def hybrid_summary(c: Corpus):
    return metrics.summarise(c.metrics_of(c.hybrid), metrics.METRICS)


@query(LEX + """ SELECT case_id, min(rank) FILTER (WHERE e.document_id IS NOT NULL) AS first_relevant_rank
FROM (SELECT DISTINCT case_id FROM rel) r LEFT JOIN bd USING (case_id) LEFT JOIN (SELECT DISTINCT case_id, document_id FROM rel) e USING (case_id, document_id) GROUP BY case_id""")
def first_relevant_rank(c: Corpus):
    found = metrics.first_relevant_rank(c.bm25, c.relevant)
    return found.select("case_id", F.col("first_relevant_rank").cast("long").alias("first_relevant_rank"))


@query(LEX + " SELECT case_id, CASE WHEN answerable THEN 'evaluated' ELSE 'excluded_from_retrieval_metrics' END AS evaluation FROM cases")
def retrieval_exclusions(c: Corpus):
    kept = c.cases.where("answerable").select("case_id", F.lit("evaluated").alias("evaluation"))
    return kept.unionByName(c.cases.where("not answerable").select("case_id", F.lit("excluded_from_retrieval_metrics").alias("evaluation")))


@query(FULL + S.metrics("a", "hy") + S.metrics("b", "bd") + """
SELECT case_id, metric, round(v - o, 6) AS delta FROM (UNPIVOT a ON COLUMNS(* EXCLUDE case_id) INTO NAME metric VALUE v) JOIN (UNPIVOT b ON COLUMNS(* EXCLUDE case_id) INTO NAME metric VALUE o) USING (case_id, metric)""")
def metric_deltas(c: Corpus):
    now, old = (metrics.long(metrics.case_metrics(r, c.relevant, "case_id"), metrics.METRICS, "case_id") for r in (c.hybrid, c.bm25))
    return metrics.deltas(now, old, "case_id")


@query(FULL + S.metrics("a", "hy") + S.metrics("b", "bd") + S.summary("x", "a") + S.summary("y", "b") + """
SELECT "group", metric, round(v - o, 6) AS delta FROM (UNPIVOT (SELECT * EXCLUDE case_count FROM x) ON COLUMNS(* EXCLUDE "group") INTO NAME metric VALUE v)
JOIN (UNPIVOT (SELECT * EXCLUDE case_count FROM y) ON COLUMNS(* EXCLUDE "group") INTO NAME metric VALUE o) USING ("group", metric)""")
def summary_deltas(c: Corpus):
    now, old = (metrics.long(metrics.summarise(c.metrics_of(r), metrics.METRICS), metrics.METRICS, "group") for r in (c.hybrid, c.bm25))
    return metrics.deltas(now, old, "group")


GRID = LEX + S.DENSE + S.RANKS + """
,trials AS (SELECT unnest([10, 20, 40, 60]) AS trial_constant), weights AS (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5])::DOUBLE AS trial_weight),
gs AS (SELECT case_id, trial_constant, trial_weight, document_id, round(sum(CASE WHEN source = 'dense' THEN trial_weight ELSE weight END / (trial_constant + rank)), 9) AS score
  FROM both_ JOIN cases USING (case_id), trials, weights WHERE answerable AND split = 'dev' GROUP BY ALL),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, trial_constant, trial_weight ORDER BY score DESC, document_id) AS rank FROM gs) WHERE rank <= 10)
""" + S.metrics("m", "g", "case_id, trial_constant, trial_weight") + """
,tr AS (SELECT trial_constant, trial_weight, count(*) AS case_count, round(avg(ndcg_at_10), 6) AS ndcg_at_10, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(mrr_at_10), 6) AS mrr_at_10 FROM m GROUP BY ALL)
"""


def _trials(c: Corpus):
    dev = c.cases.where("answerable and split = 'dev'").select("case_id")
    trial = ["trial_constant", "trial_weight"]
    fused = fusion.fuse(fusion.grid(c.bm25, c.dense).join(dev, "case_id", "left_semi"), "case_id", *trial)
    wanted = c.relevant.join(dev, "case_id", "left_semi").crossJoin(F.broadcast(fused.select(*trial).distinct()))  # twenty trials
    m = metrics.case_metrics(fused, wanted, "case_id", *trial)
    return m.groupBy(*trial).agg(F.count("*").alias("case_count"), *(F.round(F.avg(x), 6).alias(x) for x in ("ndcg_at_10", "recall_at_5", "mrr_at_10")))


@query(GRID + " SELECT * FROM tr")
def rrf_tuning(c: Corpus):
    return _trials(c)


@query(GRID + " SELECT * FROM tr ORDER BY ndcg_at_10 DESC, recall_at_5 DESC, mrr_at_10 DESC, abs(trial_weight - 1), trial_constant DESC, trial_weight LIMIT 1")
def rrf_selected_config(c: Corpus):
    return fusion.select_config(_trials(c))


@query("SELECT event_type, round(median(value), 3) AS p50, round(quantile_disc(value, 0.95), 3) AS p95, round(max(value), 3) AS max, count(value) AS n FROM events GROUP BY event_type")
def latency_percentiles(c: Corpus):
    return metrics.latency(c.table("events"), "value", "event_type").select("event_type", "p50", "p95", "max", "n")
