"""Retrieval metrics, grouped summaries, deltas, percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
KS = (1, 3, 5, 10)
METRICS = [f"{m}_at_{k}" for k in KS for m in ("recall", "precision", "ndcg")] + ["mrr_at_10"]


def case_metrics(ranked: DataFrame, relevant: DataFrame, *by: str, ks: Sequence[int] = KS) -> DataFrame:
    """Metrics of every case in ``relevant`` (*by, document_id), by the ranks in ``ranked`` (*by, rank, document_id).

    Cases that have relevant documents but no results get zeros.
    """
    if not ks or min(ks) <= 0:
        raise ValueError("k is above 0")
    sizes = relevant.groupBy(*by).agg(F.count_distinct("document_id").alias("n_relevant"))
    hits = ranked.join(relevant.select(*by, "document_id").distinct(), [*by, "document_id"]).select(*by, "rank")
    r = F.col("rank")
    parts = [F.min(F.when(r <= 10, r)).alias("first")]
    for k in ks:
        parts += [F.count(F.when(r <= k, 1)).alias(f"hits{k}"), F.sum(F.when(r <= k, 1 / F.log2(r + 1))).alias(f"dcg{k}")]
    wide = sizes.join(hits.groupBy(*by).agg(*parts), list(by), "left")
    out: list[Column] = []
    for k in ks:
        n = F.coalesce(F.col(f"hits{k}"), F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
        out += [F.round(n / F.col("n_relevant"), 6).alias(f"recall_at_{k}"), F.round(n / F.lit(float(k)), 6).alias(f"precision_at_{k}"), F.round(F.coalesce(F.col(f"dcg{k}"), F.lit(0.0)) / ideal, 6).alias(f"ndcg_at_{k}")]
    return wide.select(*by, *out, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr_at_10"))


def first_relevant_rank(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    hits = ranked.where("rank <= 10").join(relevant, ["case_id", "document_id"], "left_semi").groupBy("case_id").agg(F.min("rank").alias("first_relevant_rank"))
    return relevant.select("case_id").distinct().join(hits, "case_id", "left")


def summarise(rows: DataFrame, columns: Sequence[str], sums: Sequence[str] = (), *by: str) -> DataFrame:
    """Means of the already rounded columns over all rows, each split and each language (grouping sets).

    Nulls are skipped; booleans count as 0 and 1. rows: *by, split, language, columns.
    """
    label = F.when(F.col("split").isNotNull(), F.col("split")).when(F.col("language").isNotNull(), F.concat(F.lit("language:"), "language")).otherwise(F.lit("all"))
    sets = [[F.col(b) for b in by], [*(F.col(b) for b in by), F.col("split")], [*(F.col(b) for b in by), F.col("language")]]
    grouped = rows.groupingSets(sets, *by, "split", "language")
    out = grouped.agg(F.count("*").alias("case_count"), *(F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in columns), *(F.sum(c).alias(c) for c in sums))
    return out.select(*by, label.alias("group"), "case_count", *columns, *sums)


def long(rows: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
    """(by, metric, value) of the columns; nulls are left out."""
    return rows.select(*by, F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("double") for c in columns)))).alias("metric", "value")).where("value is not null")


def deltas(now: DataFrame, before: DataFrame, *by: str) -> DataFrame:
    """now - before by (by, metric); what the baseline lacks is left out."""
    old = before.select(*by, "metric", F.col("value").alias("baseline"))
    return now.join(old, [*by, "metric"]).select(*by, "metric", F.round(F.col("value") - F.col("baseline"), 6).alias("delta"))


def latency(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Median, nearest-rank 95th percentile, maximum and total."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.round(F.median(v), 3).alias("p50"), F.round(F.expr(f"percentile_disc(0.95) within group (order by {value})"), 3).alias("p95"), F.round(F.max(v), 3).alias("max"), F.round(F.sum(v), 3).alias("total"), F.count(v).alias("n"))
