"""Console entry points: from a source manifest to indexes, evaluation reports, judge packets and the regression gate.

Rankings are kept as Parquet beside each report (``<report>.rankings``), so that later steps read them. An embedder, a
reranker, a generator and a judge are named as ``module:function`` over iterators of pandas frames; stand-ins serve
where none is named. A step whose gates fail ends with exit code 1.
"""

from __future__ import annotations

import argparse
import importlib
import json
import time
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import tokens
from siftwell.operators import answers, contracts, dense, fusion, gates, judge, lexical, metrics, rerank
from siftwell.session import session
from siftwell.sources import corpus

CASE = "id string, question string, split string, language string, category string, answerable boolean, relevant_documents array<string>, reference_answer string, required_facts array<string>, forbidden_claims array<string>"
HEAD = ["recall_at_1", "recall_at_5", "recall_at_10", "precision_at_5", "precision_at_10", "mrr_at_10", "ndcg_at_10"]


def plugin(name: str | None) -> Callable | None:
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def golden(spark: SparkSession, path: str) -> DataFrame:
    return corpus.read_jsonl(spark, path, CASE, "id").withColumnRenamed("id", "case_id")


def relevant(cases: DataFrame) -> DataFrame:
    return cases.where("answerable").select("case_id", F.explode("relevant_documents").alias("document_id"))


def table_of(summary: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[list]]:
    at = {g: i for i, g in enumerate(corpus.GROUPS)}
    rows = sorted((r for r in summary.collect() if r["group"] in at), key=lambda r: at[r["group"]])  # a few groups
    return ["group", "case_count", *columns], [[r["group"], r["case_count"], *(r[c] for c in columns)] for r in rows]


def retrieval_report(spark, name: str, ranked: DataFrame, cases: DataFrame, out: str, again: list[str]) -> DataFrame:
    """Write rankings, report and Markdown; the summary of all groups."""
    ranked.write.mode("overwrite").parquet(out + ".rankings")
    ranked = spark.read.parquet(out + ".rankings")
    by_case = metrics.case_metrics(ranked, relevant(cases), "case_id").join(cases.select("case_id", "split", "language"), "case_id")
    summary = metrics.summarise(by_case, metrics.METRICS).cache()
    head, rows = table_of(summary, HEAD)
    summaries = {r["group"]: r.asDict() for r in summary.collect()}
    report = {"schema_version": "1.0", "experiment": name, "summaries": summaries, "cases": [r.asDict() for r in by_case.orderBy("case_id").collect()]}
    corpus.write_report(report, corpus.render(name, [f"cases: {len(report['cases'])}"], [("Metrics", head, rows)], again), out + ".json", out + ".md")
    return summary


def fetch(spark, a) -> bool:
    made = corpus.acquire(spark, a.manifest, a.out, a.force, dict(x.split("=", 1) for x in a.folder))
    Path(a.derived).parent.mkdir(parents=True, exist_ok=True)
    Path(a.derived).write_text(json.dumps(made, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return True


def validate(spark, a) -> bool:
    bad = contracts.violations(golden(spark, a.cases), "case_id", contracts.golden_rules()).collect()
    print("\n".join(f"{r['id']}: {r['rule']}" for r in bad) or "valid")
    return not bad


def build_index(spark, a) -> bool:
    files = spark.read.parquet(a.corpus)
    manifest = files.select("document_id", F.col("document_id").alias("source_path"), "sha256")
    corpus.build_index(manifest, files.select(F.col("document_id").alias("path"), F.sha2("content", 256).alias("sha256"), "content"), a.out)
    return True


def eval_bm25(spark, a) -> bool:
    cases = golden(spark, a.cases)
    ranked = lexical.top_documents(lexical.bm25_scores(lexical.tokenised(spark.read.parquet(a.index)), cases))
    retrieval_report(spark, "bm25", ranked, cases, a.out, ["siftwell-build-index", "siftwell-eval-bm25"])
    return True


def embedded(chunks: DataFrame, a) -> DataFrame:
    return corpus.embed_with_cache(chunks, a.cache, plugin(a.embedder) or dense.hashed_embedder)


def build_vector_index(spark, a) -> bool:
    vectors = embedded(spark.read.parquet(a.index).select("chunk_id", "document_id", "text"), a)
    chunks = spark.read.parquet(a.index).select("chunk_id", "document_id").join(vectors, "chunk_id", "left")
    corpus.replace_index(chunks, a.index_id, a.dimensions, a.out)
    return True


def eval_vector(spark, a) -> bool:
    cases = golden(spark, a.cases)
    asked = embedded(cases.select(F.concat(F.lit("case:"), "case_id").alias("chunk_id"), F.col("question").alias("text")), a)
    chunks = spark.read.parquet(a.vectors).where(F.col("index_id") == a.index_id)
    found = dense.nearest(asked.select(F.substring("chunk_id", 6, 1 << 30).alias("case_id"), F.col("embedding").alias("q")), chunks.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v")), dense.CANDIDATES)
    ranked = lexical.top_documents(found.select("case_id", F.col("id").alias("chunk_id"), "score").join(chunks.select("chunk_id", "document_id"), "chunk_id"))
    retrieval_report(spark, "dense", ranked, cases, a.out, ["siftwell-build-vector-index", "siftwell-eval-vector"])
    return True


def eval_hybrid(spark, a) -> bool:
    bm25, vector = (spark.read.parquet(x + ".rankings") for x in (a.bm25, a.dense))
    retrieval_report(spark, "hybrid", fusion.fuse(fusion.weighted(bm25, vector), "case_id"), golden(spark, a.cases), a.out, ["siftwell-eval-hybrid"])
    return True


def contexts(spark, a, depth: int, words: int | None = None) -> DataFrame:
    ranks = [spark.read.parquet(x + ".rankings") for x in (a.hybrid, a.bm25, a.dense)]
    return answers.candidates(*ranks, spark.read.parquet(a.index), depth, words)


def eval_reranker(spark, a) -> bool:
    cases, model = golden(spark, a.cases), plugin(a.model)
    rows = contexts(spark, a, lexical.DEPTH).join(cases.select("case_id", "question"), "case_id")
    began = time.monotonic()
    scored = rerank.with_model(rows, model) if model else rows.withColumn("score", rerank.overlap_score(F.col("question"), F.col("text")))
    now = metrics.long(retrieval_report(spark, "reranker", rerank.rerank(scored), cases, a.out, ["siftwell-eval-reranker"]), ["ndcg_at_10"], "group")
    each = (time.monotonic() - began) * 1000 / max(1, cases.count())
    before = json.loads(Path(a.hybrid + ".json").read_text(encoding="utf-8"))["summaries"]
    least = {"dev": 0.01, "test": 0.0}
    new = {r["group"]: r["value"] for r in now.collect()}
    checks = {g: round(new[g] - before[g]["ndcg_at_10"], 6) >= m for g, m in least.items() if g in new and g in before}
    accepted = all(checks.values()) and each <= answers.RERANK_P95_MS
    Path(a.out + ".acceptance.json").write_text(json.dumps({"quality": checks, "mean_ms": round(each, 3), "accepted": accepted}, indent=2) + "\n", encoding="utf-8")
    return accepted


def eval_generation(spark, a) -> bool:
    cases, ctx = golden(spark, a.cases), contexts(spark, a, answers.CONTEXT_DOCUMENTS, answers.PASSAGE_WORDS).cache()
    asked, model = cases.select("case_id", "question"), plugin(a.model)
    began = time.monotonic()
    if model:
        rows = asked.join(answers.source_blocks(ctx), "case_id", "left")
        made = [answers.generate(rows.select("case_id", answers.prompt(F.col("question"), F.coalesce("sources", F.lit("")), g).alias("messages")), model) for g in (True, False)]
        made = [m.withColumn("input_tokens", F.lit(0)).withColumn("output_tokens", F.size(tokens(F.col("raw_output")))) for m in made]
    else:
        made = [m.withColumn("schema_valid", F.lit(True)) for m in (answers.extract_answers(asked, ctx), answers.control_answers(asked))]
    available = ctx.groupBy("case_id").agg(F.collect_set("document_id").alias("available"))
    none, parts = F.array().cast("array<string>"), []
    for mode, rows in zip(("grounded", "no_retrieval"), made):
        rows = rows.drop("raw_output").cache()
        cited = ctx.join(rows.select("case_id", F.explode("citations").alias("document_id")), ["case_id", "document_id"], "left_semi")
        evidence = cited.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ordinal", "text"))), lambda x: x["text"]), " ").alias("evidence"))
        known = cases.select("case_id", F.col("answerable").alias("case_answerable"), F.col("relevant_documents").alias("relevant"), "reference_answer", F.col("required_facts").alias("facts"), F.col("forbidden_claims").alias("claims"))
        wide = rows.join(known, "case_id").join(available, "case_id", "left").join(evidence, "case_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit(""))).withColumn("available", F.coalesce("available", none))
        measured = answers.answer_metrics(wide, mode == "grounded").join(cases.select("case_id", "split", "language"), "case_id")
        parts.append(measured.join(rows.select("case_id", "input_tokens", "output_tokens"), "case_id").withColumn("mode", F.lit(mode)))
    summary = metrics.summarise(parts[0].unionByName(parts[1]), answers.ANSWER_METRICS, ["input_tokens", "output_tokens"], "mode").cache()
    found = [r.asDict() for r in answers.generation_gates(summary.where("mode = 'grounded'"), summary.where("mode = 'no_retrieval'")).collect()]
    each = (time.monotonic() - began) * 1000 / max(1, 2 * cases.count())
    accepted = all(g["passed"] for g in found) and each <= answers.GENERATION_P95_MS
    tables = [(m, *table_of(summary.where(F.col("mode") == m), ["fact_coverage", "token_f1", "citation_precision", "citation_recall", "output_tokens"])) for m in ("grounded", "no_retrieval")]
    tables.append(("Gates", ["gate", "observed", "passed"], [[g["gate"], g["observed"], g["passed"]] for g in found]))
    report = {"schema_version": "1.0", "summaries": [r.asDict() for r in summary.collect()], "gates": found, "mean_ms": round(each, 3), "accepted": accepted}
    corpus.write_report(report, corpus.render("generation", [f"request: {json.dumps(answers.REQUEST)}"], tables, ["siftwell-eval-generation"]), a.out + ".json", a.out + ".md")
    made[0].write.mode("overwrite").parquet(a.out + ".answers")
    return accepted


def build_judge_packet(spark, a) -> bool:
    """Items for annotators and the judge, and the empty labels; the calibration labels are sealed by their hash later."""
    made = spark.read.parquet(a.generation + ".answers").select("case_id", "answer", "citations")
    ctx = contexts(spark, a, answers.CONTEXT_DOCUMENTS, answers.PASSAGE_WORDS)
    evidence = ctx.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ordinal", "text"))), lambda x: x["text"]).alias("evidence"))
    cases = golden(spark, a.cases).drop("relevant_documents", "language", "category")
    items = cases.join(made, "case_id").join(evidence, "case_id", "left").withColumn("phase", F.when(F.col("split") == "dev", "calibration").otherwise("validation")).drop("split")
    corpus.write_jsonl(items, a.out + ".items")
    corpus.write_jsonl(items.select("case_id", "phase", *(F.lit(None).cast("string").alias(c) for c in ("label", "reviewer", "qualification", "notes"))), a.out + ".labels", once=True)
    lines = corpus.render("judge packet", [f"configuration {gates.configuration_sha256({'orders': list(judge.ORDERS), 'verdict': judge.VERDICT})}"], [("Items", ["case", "phase"], [[r["case_id"], r["phase"]] for r in items.select("case_id", "phase").orderBy("case_id").collect()])])
    corpus.write_report({"items": a.out + ".items"}, lines, a.out + ".json", a.out + ".md")
    return True


def eval_judge(spark, a) -> bool:
    """Calibration writes a seal over configuration and labels; validation runs only under the same seal."""
    items = spark.read.json(a.packet + ".items").where(F.col("phase") == a.phase)
    labels = spark.read.json(a.labels).where("label is not null").select("case_id", "label")
    state = {"configuration": gates.configuration_sha256({"orders": list(judge.ORDERS), "verdict": judge.VERDICT, "model": a.model}), "labels": gates.configuration_sha256({r["case_id"]: r["label"] for r in spark.read.json(a.labels).where("phase = 'calibration' and label is not null").collect()})}
    corpus.seal(a.seal, state) if a.phase == "calibration" else corpus.verify_seal(a.seal, state)
    verdicts = judge.evaluate(items, plugin(a.model), a.repeats).cache()
    found = [r.asDict() for r in judge.promotion(verdicts, labels, a.safety_case).collect()]
    corpus.write_report({"phase": a.phase, "gates": found}, corpus.render(f"judge, {a.phase}", [], [("Gates", ["gate", "observed", "passed"], [[g["gate"], g["observed"], g["passed"]] for g in found])]), a.out + ".json", a.out + ".md")
    return all(g["passed"] for g in found)


def check_regressions(spark, a) -> bool:
    """Every check of a YAML policy against its JSON artifacts; a missing metric raises."""
    import yaml

    policy = yaml.safe_load(Path(a.root, a.policy).read_text(encoding="utf-8"))
    docs = spark.createDataFrame([(n, Path(a.root, p).read_text(encoding="utf-8")) for n, p in policy["artifacts"].items()], "artifact string, body string")
    checks = spark.createDataFrame([(c["id"], c["artifact"], c["path"], c["operator"], float(c["threshold"])) for c in policy["checks"]], "id string, artifact string, path string, operator string, threshold double")
    found = [r.asDict() for r in gates.evaluate_policy(checks, gates.facts_from_json(docs, checks.select("artifact", "path").distinct())).collect()]
    passed = all(r["passed"] for r in found)
    print(json.dumps({"policy_id": policy.get("policy_id"), "passed": passed, "checks": found}, indent=2, ensure_ascii=False))
    return passed


#: Command: function and its options; a value is the default, ... must be given.
RANKS = {"hybrid": ..., "bm25": ..., "dense": ..., "index": ...}
VECTORS = {"cache": ..., "embedder": "", "index_id": "dense"}
COMMANDS: dict[str, tuple[Callable, dict]] = {
    "fetch-corpus": (fetch, {"manifest": ..., "out": ..., "derived": ..., "force": False, "folder": []}),
    "validate-evals": (validate, {"cases": ...}),
    "build-index": (build_index, {"corpus": ..., "out": ...}),
    "eval-bm25": (eval_bm25, {"index": ..., "cases": ..., "out": ...}),
    "build-vector-index": (build_vector_index, {"index": ..., "out": ..., "dimensions": dense.BUCKETS, **VECTORS}),
    "eval-vector": (eval_vector, {"vectors": ..., "cases": ..., "out": ..., **VECTORS}),
    "eval-hybrid": (eval_hybrid, {"bm25": ..., "dense": ..., "cases": ..., "out": ...}),
    "eval-reranker": (eval_reranker, {"cases": ..., "out": ..., "model": "", **RANKS}),
    "eval-generation": (eval_generation, {"cases": ..., "out": ..., "model": "", **RANKS}),
    "build-judge-packet": (build_judge_packet, {"cases": ..., "generation": ..., "out": ..., **RANKS}),
    "eval-judge": (eval_judge, {"packet": ..., "labels": ..., "seal": ..., "phase": ..., "model": ..., "out": ..., "repeats": 3, "safety_case": ""}),
    "check-regressions": (check_regressions, {"root": ".", "policy": ...}),
}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siftwell", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        sub = commands.add_parser(name)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if default is False:
                sub.add_argument(flag, action="store_true")
            elif default == []:
                sub.add_argument(flag, action="append", default=[], metavar="ID=FOLDER")
            else:
                sub.add_argument(flag, required=default is ..., default=None if default in (..., "") else default, type=int if isinstance(default, int) else str)
    a = parser.parse_args(argv)
    return 0 if COMMANDS[a.command][0](spark or session("siftwell-" + a.command), a) else 1


if __name__ == "__main__":
    raise SystemExit(main())
