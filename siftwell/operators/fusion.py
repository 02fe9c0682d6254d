"""Weighted reciprocal rank fusion and the choice of its parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values.
RANK_CONSTANT, DENSE_WEIGHT, BM25_WEIGHT, LIMIT = 60, 1.0, 1.0, 10
CONSTANTS = (10, 20, 40, 60)
DENSE_WEIGHTS = (0.5, 0.75, 1.0, 1.25, 1.5)


def fuse(rankings: DataFrame, *by: str, limit: int = LIMIT) -> DataFrame:
    """Sum of weight / (constant + rank); a document's first place in a source counts.

    rankings: *by, source, rank, document_id, weight, constant. Returns *by, rank, document_id, score, ranks,
    contributions.
    """
    first = rankings.groupBy(*by, "source", "document_id", "weight", "constant").agg(F.min("rank").alias("rank"))
    part = F.col("weight") / (F.col("constant") + F.col("rank"))
    fused = first.groupBy(*by, "document_id").agg(
        F.round(F.sum(part), 9).alias("score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "rank")))).alias("ranks"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", F.round(part, 9).alias("c"))))).alias("contributions"),
    )
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "document_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= limit)


def weighted(bm25: DataFrame, dense: DataFrame, constant: int = RANK_CONSTANT, dense_weight: float = DENSE_WEIGHT) -> DataFrame:
    """The two rankings as one table with source, weight and constant."""
    if constant <= 0 or dense_weight <= 0:
        raise ValueError("the rank constant and the weights are above 0")
    a = bm25.select("case_id", "rank", "document_id", F.lit("bm25").alias("source"), F.lit(BM25_WEIGHT).alias("weight"))
    b = dense.select("case_id", "rank", "document_id", F.lit("dense").alias("source"), F.lit(float(dense_weight)).alias("weight"))
    return a.unionByName(b).withColumn("constant", F.lit(constant))


def grid(bm25: DataFrame, dense: DataFrame) -> DataFrame:
    """Both rankings for every trial (trial_constant, trial_weight): one job for all of them."""
    rows = weighted(bm25, dense)
    trials = rows.sparkSession.createDataFrame([(c, w) for c in CONSTANTS for w in DENSE_WEIGHTS], "trial_constant int, trial_weight double")
    wide = rows.crossJoin(F.broadcast(trials))  # twenty rows
    return wide.withColumn("constant", F.col("trial_constant")).withColumn("weight", F.when(F.col("source") == "dense", F.col("trial_weight")).otherwise(F.col("weight")))


def select_config(trials: DataFrame) -> DataFrame:
    """The best trial: nDCG@10, recall@5, MRR@10, nearness of the weight to 1, constant, smaller weight."""
    key = F.struct("ndcg_at_10", "recall_at_5", "mrr_at_10", (-F.abs(F.col("trial_weight") - 1)).alias("d"), "trial_constant", (-F.col("trial_weight")).alias("w"))
    return trials.agg(F.max_by(F.struct(*trials.columns), key).alias("t")).select("t.*")
