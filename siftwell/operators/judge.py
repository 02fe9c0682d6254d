"""Judge statistics: agreement, kappa, confusion, majority, stability, cost; evidence orders and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values.
AGREEMENT, KAPPA, STABILITY = 0.80, 0.60, 0.90
PRICE_IN, PRICE_OUT = 0.75, 4.50
ORDERS = ("retrieval", "reverse", "rotate")


def majority(verdicts: DataFrame) -> DataFrame:
    """case_id, label given most often; null if the first place is shared. verdicts: case_id, label."""
    counts = verdicts.groupBy("case_id", "label").agg(F.count("*").alias("n"))
    place = F.rank().over(W.partitionBy("case_id").orderBy(F.desc("n")))
    first = counts.withColumn("place", place).where("place = 1")
    return first.groupBy("case_id").agg(F.when(F.count("*") == 1, F.min("label")).alias("label"))


def stability(verdicts: DataFrame) -> DataFrame:
    """case_id, stable: all repetitions gave one label."""
    return verdicts.groupBy("case_id").agg((F.count_distinct("label") == 1).alias("stable"))


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: n, agreement, kappa, and the pass/fail confusion. pairs: reference, judge; unsure is left out."""
    rows = pairs.where((F.col("reference") != "unsure") & (F.col("judge") != "unsure"))
    n = rows.agg(F.count("*").alias("n"), F.avg((F.col("reference") == F.col("judge")).cast("double")).alias("observed"), *(F.count_if((F.col("reference") == r) & (F.col("judge") == j)).alias(f"{r}_{j}") for r in ("pass", "fail") for j in ("pass", "fail")))
    by_label = rows.select(F.explode(F.array(F.struct(F.col("reference").alias("label"), F.lit(1).alias("r"), F.lit(0).alias("j")), F.struct(F.col("judge").alias("label"), F.lit(0).alias("r"), F.lit(1).alias("j")))).alias("x"))
    sides = by_label.groupBy("x.label").agg(F.sum("x.r").alias("r"), F.sum("x.j").alias("j")).agg(F.sum(F.col("r") * F.col("j")).alias("product"))
    both = n.crossJoin(F.broadcast(sides))  # one row each
    expected = F.try_divide(F.col("product"), F.col("n") * F.col("n"))
    kappa = F.when((expected == 1) & (F.col("observed") == 1), F.lit(1.0)).otherwise(F.try_divide(F.col("observed") - expected, 1 - expected))
    return both.select("n", F.round("observed", 6).alias("agreement"), F.round(kappa, 6).alias("kappa"), "pass_pass", "pass_fail", "fail_pass", "fail_fail")


def call_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round((tokens_in * PRICE_IN + tokens_out * PRICE_OUT) / 1e6, 8)


def evidence_order(evidence: Column, order: Column) -> Column:
    rotated = F.concat(F.slice(evidence, 2, F.greatest(F.size(evidence), F.lit(1))), F.slice(evidence, 1, 1))
    return F.when(order == "reverse", F.reverse(evidence)).when(order == "rotate", rotated).otherwise(evidence)


def payloads(items: DataFrame, order: str = "retrieval") -> DataFrame:
    """case_id, payload: JSON without phase or labels, evidence in the given order."""
    if order not in ORDERS:
        raise ValueError(f"order is one of {ORDERS}")
    fields = ["question", "answerable", "answer", "citations", "reference_answer", "required_facts", "forbidden_claims"]
    ordered = evidence_order(F.col("evidence"), F.lit(order)).alias("evidence")
    return items.select("case_id", F.to_json(F.struct("case_id", *[f for f in fields if f in items.columns], ordered)).alias("payload"))


VERDICT = "label string, groundedness int, relevance int, citation_support int, completeness int, error_flags array<string>, input_tokens long, output_tokens long, latency_ms double"


def repetitions(items: DataFrame, repeats: int = 3) -> DataFrame:
    """case_id, repetition, evidence_order, payload for each repetition; the orders take turns. Repeats are odd, 3 at least."""
    if repeats < 3 or repeats % 2 == 0:
        raise ValueError("repeats is odd and 3 or more")
    out = None
    for i in range(repeats):
        order = ORDERS[i % len(ORDERS)]
        part = payloads(items, order).withColumn("repetition", F.lit(i)).withColumn("evidence_order", F.lit(order))
        out = part if out is None else out.unionByName(part)
    return out.select("case_id", "repetition", "evidence_order", "payload")


def evaluate(items: DataFrame, model, repeats: int = 3) -> DataFrame:
    """Verdicts of a provider: ``model(iterator of pandas frames)`` adds the columns of VERDICT to its rows."""
    rows = repetitions(items, repeats)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(model, f"{schema}, {VERDICT}")


def promotion(verdicts: DataFrame, reference: DataFrame, safety_case=None) -> DataFrame:
    """gate, observed, passed: agreement, kappa, stability, the safety case's majority, and all of them together.

    Unsure cases are left out of agreement and count for stability. Without a comparable case, or if the safety
    case has no sure verdict, the gate fails instead of raising.
    """
    major = majority(verdicts)
    pairs = reference.select("case_id", F.col("label").alias("reference")).join(major.select("case_id", F.col("label").alias("judge")), "case_id")
    a = agreement(pairs.where("judge is not null"))
    stable = stability(verdicts).agg(F.round(F.avg(F.col("stable").cast("double")), 6).alias("observed"))
    gates = a.select(F.lit("agreement").alias("gate"), F.col("agreement").alias("observed"), (F.col("agreement") >= AGREEMENT).alias("passed"))
    gates = gates.unionByName(a.select(F.lit("kappa").alias("gate"), F.col("kappa").alias("observed"), (F.col("kappa") >= KAPPA).alias("passed")))
    gates = gates.unionByName(stable.select(F.lit("stability").alias("gate"), "observed", (F.col("observed") >= STABILITY).alias("passed")))
    if safety_case is not None:
        same = pairs.where(F.col("case_id") == safety_case).agg(F.max((F.col("reference") == F.col("judge")).cast("double")).alias("observed"))
        gates = gates.unionByName(same.select(F.lit("safety").alias("gate"), "observed", (F.col("observed") == 1).alias("passed")))
    gates = gates.withColumn("passed", F.coalesce("passed", F.lit(False)))
    return gates.unionByName(gates.agg(F.lit("accepted").alias("gate"), F.lit(None).cast("double").alias("observed"), F.bool_and("passed").alias("passed")))
