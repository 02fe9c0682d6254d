"""Contracts as queries that return violations: (id, rule)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
LANGUAGES, LABELS = ("en", "pt-BR"), ("pass", "fail", "unsure")
SHA1, SHA256 = r"^[0-9a-f]{40}$", r"^[0-9a-f]{64}$"
AUTHORITIES = ("source_of_truth", "explanatory")


def violations(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """A row (id, rule) for every rule that a row breaks; a rule is the condition that has to hold."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(F.col(key).alias("id"), F.explode(broken).alias("rule"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def golden_rules() -> dict[str, Column]:
    answerable = F.col("answerable")
    return {
        "split": F.col("split").isin("dev", "test"),
        "language": F.col("language").isin(*LANGUAGES),
        "question_length": F.length("question") >= 15,
        "reference_answer_length": F.length("reference_answer") >= 10,
        "answerable_needs_documents": ~answerable | (F.size("relevant_documents") > 0),
        "answerable_needs_facts": ~answerable | (F.size("required_facts") > 0),
        "unanswerable_has_no_documents": answerable | (F.size("relevant_documents") == 0),
    }


def source_rules() -> dict[str, Column]:
    return {"revision": F.col("revision").rlike(SHA1), "authority": F.col("authority").isin(*AUTHORITIES), "include": F.size("include") > 0}


def annotation_rules() -> dict[str, Column]:
    label, flags = F.col("label"), F.size("error_flags")
    return {
        "flags_need_fail_or_unsure": (flags == 0) | F.coalesce(label.isin("fail", "unsure"), F.lit(False)),
        "label_needs_reviewer": label.isNull() | (F.col("reviewer").isNotNull() & F.col("qualification").isNotNull()),
        "unsure_needs_note": ~F.coalesce(label == "unsure", F.lit(False)) | (F.length(F.coalesce("notes", F.lit(""))) > 0),
    }


def adjudication_rules() -> dict[str, Column]:
    votes = F.col("votes")
    return {
        "two_votes": F.size(votes) >= 2,
        "unanimous": F.forall(votes, lambda v: v["label"] == F.col("label")),
        "blind": F.size(F.filter(votes, lambda v: v["blinded"])) >= 2,
        "flags_need_fail_or_unsure": (F.size("error_flags") == 0) | F.col("label").isin("fail", "unsure"),
    }


def verdict_rules() -> dict[str, Column]:
    scores = [F.col(c) for c in ("groundedness", "relevance", "citation_support", "completeness")]
    perfect = (scores[0] + scores[1] + scores[2] + scores[3] == 8) & (F.size("error_flags") == 0)
    inside = scores[0].between(0, 2) & scores[1].between(0, 2) & scores[2].between(0, 2) & scores[3].between(0, 2)
    return {"scores": inside, "pass_needs_full_scores": (F.col("label") == "pass") == perfect}


def coverage(labels: DataFrame, items: DataFrame) -> DataFrame:
    """(id, side): labels without item (extra) and items without label (missing)."""
    a = labels.select(F.col("case_id").alias("id")).distinct()
    b = items.select(F.col("case_id").alias("id")).distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("extra")).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit("missing")))
