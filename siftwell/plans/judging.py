"""Queries of judge statistics, contracts, packets and gates. labels stand for reference labels; a rule over the
documents' lengths, in three variants, stands for a judge's repetitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import contracts, gates, judge, metrics
from siftwell.plans import sql as S
from siftwell.plans.fixtures import Corpus
from siftwell.plans.registry import query
from siftwell.plans.retrieval import LEX

VERDICTS = """WITH rf AS (SELECT doc_id AS case_id, CASE WHEN min(quality) = 1 THEN 'pass' ELSE 'fail' END AS reference FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
vd AS (SELECT case_id, rep, CASE WHEN len < 100 * rep THEN 'fail' WHEN len % 17 = rep THEN 'unsure' ELSE 'pass' END AS label, len FROM (SELECT rf.case_id, length(text) AS len, unnest([1, 2, 3]) AS rep FROM rf JOIN documents ON doc_id = case_id)),
mc AS (SELECT case_id, label, count(*) AS n FROM vd GROUP BY ALL), mr AS (SELECT *, rank() OVER (PARTITION BY case_id ORDER BY n DESC) AS r FROM mc),
mj AS (SELECT case_id, CASE WHEN count(*) = 1 THEN min(label) END AS label FROM mr WHERE r = 1 GROUP BY case_id),
pr AS (SELECT reference, label AS judge FROM rf JOIN mj USING (case_id) WHERE label IN ('pass', 'fail')),
ag AS (SELECT count(*) AS n, avg((reference = judge)::INT::DOUBLE) AS observed, count(*) FILTER (WHERE reference = 'pass' AND judge = 'pass') AS pass_pass, count(*) FILTER (WHERE reference = 'pass' AND judge = 'fail') AS pass_fail,
  count(*) FILTER (WHERE reference = 'fail' AND judge = 'pass') AS fail_pass, count(*) FILTER (WHERE reference = 'fail' AND judge = 'fail') AS fail_fail FROM pr),
ak AS (SELECT *, ((pass_pass + pass_fail) * (pass_pass + fail_pass) + (fail_pass + fail_fail) * (pass_fail + fail_fail)) / (n * n)::DOUBLE AS expected FROM ag),
am AS (SELECT n, round(observed, 6) AS agreement, round(CASE WHEN expected = 1 AND observed = 1 THEN 1.0 ELSE (observed - expected) / nullif(1 - expected, 0) END, 6) AS kappa, pass_pass, pass_fail, fail_pass, fail_fail FROM ak),
sb AS (SELECT case_id, count(DISTINCT label) = 1 AS stable FROM vd GROUP BY case_id)
"""


def reference(c: Corpus):
    known = c.table("labels").where("quality is not null").groupBy(F.col("doc_id").alias("case_id"))
    return known.agg(F.when(F.min("quality") == 1, "pass").otherwise("fail").alias("reference"))


def verdicts(c: Corpus):
    docs = c.table("documents").select(F.col("doc_id").alias("case_id"), F.length("text").alias("len"))
    rows = reference(c).join(docs, "case_id").select("case_id", "len", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rep"))
    label = F.when(F.col("len") < 100 * F.col("rep"), "fail").when(F.col("len") % 17 == F.col("rep"), "unsure").otherwise("pass")
    return rows.withColumn("label", label)


def agreed(c: Corpus):
    return judge.agreement(reference(c).join(judge.majority(verdicts(c)).select("case_id", F.col("label").alias("judge")), "case_id").where("judge is not null"))


@query(VERDICTS + " SELECT case_id, label FROM mj")
def judge_majority(c: Corpus):
    return judge.majority(verdicts(c))


@query(VERDICTS + " SELECT n, agreement, kappa FROM am")
def judge_agreement(c: Corpus):
    return agreed(c).select("n", "agreement", "kappa")


@query(VERDICTS + " SELECT pass_pass, pass_fail, fail_pass, fail_fail FROM am")
def judge_confusion(c: Corpus):
    return agreed(c).select("pass_pass", "pass_fail", "fail_pass", "fail_fail")


@query(VERDICTS + " SELECT round(avg(stable::INT::DOUBLE), 6) AS stability, count(*) AS n FROM sb")
def judge_stability(c: Corpus):
    return judge.stability(verdicts(c)).agg(F.round(F.avg(F.col("stable").cast("double")), 6).alias("stability"), F.count("*").alias("n"))


@query(VERDICTS + " SELECT rep, round(sum(round((len * 0.75::DOUBLE + rep * 10 * 4.5::DOUBLE) / 1e6, 8)), 6) AS cost FROM vd GROUP BY rep")
def judge_cost(c: Corpus):
    return verdicts(c).groupBy("rep").agg(F.round(F.sum(judge.call_cost(F.col("len"), F.col("rep") * 10)), 6).alias("cost"))


@query(VERDICTS + """,gt AS (SELECT 'agreement' AS gate, agreement AS observed, coalesce(agreement >= 0.8, false) AS passed FROM am UNION ALL SELECT 'kappa', kappa, coalesce(kappa >= 0.6, false) FROM am
UNION ALL SELECT 'stability', s, coalesce(s >= 0.9, false) FROM (SELECT round(avg(stable::INT::DOUBLE), 6) AS s FROM sb))
SELECT * FROM gt UNION ALL SELECT 'accepted', NULL, bool_and(passed) FROM gt""")
def judge_gates(c: Corpus):
    return judge.promotion(verdicts(c), reference(c).withColumnRenamed("reference", "label"))


@query("WITH x AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(t, ',') AS retrieval, array_to_string(list_reverse(t), ',') AS \"reverse\", array_to_string(list_concat(t[2 : ], t[1 : 1]), ',') AS rotate FROM x")
def evidence_orders(c: Corpus):
    t = c.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return t.select("conv_id", *(F.array_join(judge.evidence_order(F.col("t"), F.lit(o)), ",").alias(o) for o in judge.ORDERS))


@query("""WITH x AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id AS case_id, '{"case_id":' || conv_id || ',"evidence":[' || array_to_string(list_reverse(t), ',') || ']}' AS payload FROM x""")
def judge_payloads(c: Corpus):
    items = c.table("conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.array_sort(F.collect_list("turn")).alias("evidence"), F.lit("calibration").alias("phase"))
    return judge.payloads(items, "reverse")


@query("SELECT conv_id AS case_id, CASE WHEN conv_id % 2 = 0 THEN 'calibration' ELSE 'validation' END AS phase, count(*) AS passages, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def judge_packet(c: Corpus):
    by = c.table("conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.count("*").alias("passages"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    phase = F.when(F.col("case_id") % 2 == 0, "calibration").otherwise("validation")
    return by.select("case_id", phase.alias("phase"), "passages", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))


@query("SELECT DISTINCT doc_id AS id, 'extra' AS side FROM labels ANTI JOIN documents USING (doc_id) UNION ALL SELECT DISTINCT doc_id, 'missing' FROM documents ANTI JOIN labels USING (doc_id)")
def label_coverage(c: Corpus):
    return contracts.coverage(c.table("labels").select(F.col("doc_id").alias("case_id")), c.table("documents").select(F.col("doc_id").alias("case_id")))


#: One valid row and one for each broken rule: (id, label, flags, reviewer, qualification, notes).
ANNOTATIONS = [("ok", "pass", [], "r", "expert", ""), ("flags", "pass", ["unsupported"], "r", "expert", ""), ("reviewer", "fail", [], None, None, ""), ("note", "unsure", [], "r", "expert", ""), ("none", None, [], None, None, None), ("null_flag", None, ["x"], None, None, None)]


@query("SELECT * FROM (VALUES ('flags', 'flags_need_fail_or_unsure'), ('reviewer', 'label_needs_reviewer'), ('note', 'unsure_needs_note'), ('null_flag', 'flags_need_fail_or_unsure')) t(id, rule)")
def annotation_violations(c: Corpus):
    rows = c.spark.createDataFrame(ANNOTATIONS, "id string, label string, error_flags array<string>, reviewer string, qualification string, notes string")
    return contracts.violations(rows, "id", contracts.annotation_rules())


VOTES = [("ok", "fail", ["x"], [("fail", True), ("fail", True)]), ("split", "fail", [], [("fail", True), ("pass", True)]), ("seen", "pass", [], [("pass", True), ("pass", False)]), ("one", "pass", [], [("pass", True)]), ("flag", "pass", ["x"], [("pass", True), ("pass", True)])]


@query("SELECT * FROM (VALUES ('split', 'unanimous'), ('seen', 'blind'), ('one', 'two_votes'), ('one', 'blind'), ('flag', 'flags_need_fail_or_unsure')) t(id, rule)")
def adjudication_violations(c: Corpus):
    rows = c.spark.createDataFrame(VOTES, "id string, label string, error_flags array<string>, votes array<struct<label:string,blinded:boolean>>")
    return contracts.violations(rows, "id", contracts.adjudication_rules())


SCORES = [("ok", "pass", 2, 2, 2, 2, []), ("low", "pass", 2, 1, 2, 2, []), ("flag", "pass", 2, 2, 2, 2, ["x"]), ("full", "fail", 2, 2, 2, 2, []), ("range", "fail", 3, 0, 0, 0, [])]


@query("SELECT * FROM (VALUES ('low', 'pass_needs_full_scores'), ('flag', 'pass_needs_full_scores'), ('full', 'pass_needs_full_scores'), ('range', 'scores')) t(id, rule)")
def verdict_violations(c: Corpus):
    rows = c.spark.createDataFrame(SCORES, "id string, label string, groundedness int, relevance int, citation_support int, completeness int, error_flags array<string>")
    return contracts.violations(rows, "id", contracts.verdict_rules())


CHECKS = [("recall5", "bm25", "all.recall_at_5", "gte", 0.1), ("mrr", "bm25", "all.mrr_at_10", "gte", 0.1), ("precision", "bm25", "dev.precision_at_10", "lte", 0.5), ("hits", "bm25", "all.recall_at_10", "gte", 0.0), ("too_high", "bm25", "all.ndcg_at_10", "gte", 1.1)]
POLICY = LEX + S.metrics("m", "bd") + S.summary("s", "m") + ",facts AS (SELECT \"group\" || '.' || metric AS path, v FROM (UNPIVOT (SELECT * EXCLUDE case_count FROM s) ON COLUMNS(* EXCLUDE \"group\") INTO NAME metric VALUE v)), ck AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{p}', '{o}', {t}::DOUBLE)" for i, _, p, o, t in CHECKS) + ") t(id, path, op, threshold)), pl AS (SELECT id, v AS observed, threshold, CASE op WHEN 'gte' THEN v >= threshold ELSE v <= threshold END AS passed FROM ck LEFT JOIN facts USING (path))"


def policy(c: Corpus):
    facts = metrics.long(metrics.summarise(c.metrics_of(c.bm25), metrics.METRICS), metrics.METRICS, "group")
    facts = facts.select(F.lit("bm25").alias("artifact"), F.concat_ws(".", "group", "metric").alias("path"), "value")
    checks = c.spark.createDataFrame(CHECKS, "id string, artifact string, path string, operator string, threshold double")
    return gates.evaluate_policy(checks, facts)


@query(POLICY + " SELECT * FROM pl")
def regression_gate(c: Corpus):
    return policy(c)


@query(POLICY + " SELECT count(*) AS checks, count(*) FILTER (WHERE passed) AS passed, bool_and(passed) AS accepted FROM pl")
def quality_gates(c: Corpus):
    return policy(c).agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"), F.bool_and("passed").alias("accepted"))
