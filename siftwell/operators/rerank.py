"""Aggregation of reranker scores; the offline scorer is token overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions.text import tokens


def overlap_score(question: Column, passage: Column) -> Column:
    """Jaccard similarity of the distinct tokens; stands in for a cross-encoder."""
    a, b = F.array_distinct(tokens(question)), F.array_distinct(tokens(passage))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)), 9)


def rerank(scored: DataFrame) -> DataFrame:
    """Best passage of each document (ties: smaller chunk_id), then by score, original rank, document_id.

    scored: case_id, document_id, rank, chunk_id, score. A chunk given twice counts once.
    """
    best = scored.groupBy("case_id", "document_id", "rank").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("chunk_id").alias("c"))).alias("b"))
    best = best.select("case_id", "document_id", F.col("rank").alias("original_rank"), (-F.col("b.s")).alias("score"), F.col("b.c").alias("best_chunk_id"))
    order = W.partitionBy("case_id").orderBy(F.desc("score"), "original_rank", "document_id")
    return best.withColumn("rank", F.row_number().over(order))


def with_model(pairs: DataFrame, model) -> DataFrame:
    """Scores by a provider: ``model(iterator of pandas frames)`` adds a double column ``score``."""
    return pairs.mapInPandas(model, pairs.schema.add("score", "double"))
