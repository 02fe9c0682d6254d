import json

import pytest
from pyspark.sql import functions as F

from siftwell.operators import answers, contracts, gates, judge
from siftwell.sources import corpus


def test_extractive(spark):
    cases = spark.createDataFrame([(1, "What does the red fox eat?"), (2, "Tell me the password of the fox"), (3, "Qual é?"), (4, "tokens are fine here")], "case_id long, question string")
    ctx = [(1, "d1", 1, 0, "Some blue words are here now. The red fox does eat berries."), (1, "d2", 2, 0, "Too short."), (1, "d3", 3, 0, "What the red fox may eat."), (2, "d1", 1, 0, "The password is a long secret word.")]
    out = {r["case_id"]: r for r in answers.extract_answers(cases, spark.createDataFrame(ctx, "case_id long, document_id string, rank int, ordinal int, text string")).collect()}
    assert out[1]["citations"] == ["d1", "d3"] and out[1]["answer"].startswith("The red fox does eat berries.") and out[1]["answerable"]
    assert out[2]["answer"] == answers.SENSITIVE_REFUSAL and out[2]["citations"] == [] and out[3]["answer"] == answers.NO_EVIDENCE
    assert not out[4]["answerable"]
    assert spark.range(1).select(answers.portuguese(F.lit("What quality"))).first()[0]  # cues match inside words


def test_parse(spark):
    raw = ['```json\n{"answerable": true, "answer": "A", "citations": ["x", "x"]}\n```', "text", "", '{"answerable": true, "answer": "A", "citations": [], "z": 1}', '[1] {"answerable": 1, "answer": "A", "citations": []}', "{broken}"]
    rows = spark.createDataFrame(list(enumerate(raw)), "case_id long, raw_output string")
    out = {r["case_id"]: r for r in answers.parse_generations(rows).collect()}
    assert out[0]["schema_valid"] and out[0]["citations"] == ["x"]
    assert [out[i]["schema_valid"] for i in range(1, 6)] == [False, False, False, True, False] and out[1]["answer"] == "text" and out[2]["answer"] == answers.UNPARSED


def test_answer_metrics(spark):
    schema = "case_id long, case_answerable boolean, relevant array<string>, available array<string>, reference_answer string, facts array<string>, claims array<string>, evidence string, schema_valid boolean, answerable boolean, answer string, citations array<string>"
    rows = [
        (1, True, ["a", "b"], ["a"], "red fox runs", ["red fox", "green dog", ""], ["he re"], "the red fox runs fast", True, True, "The red fox runs", ["a"]),
        (2, False, [], [], "", [], [], "", True, False, "no", []),
        (3, True, ["a"], [], "x", ["y"], [""], "", True, True, "", ["a"]),
    ]
    m = {r["case_id"]: r for r in answers.answer_metrics(spark.createDataFrame(rows, schema)).collect()}
    assert (m[1]["citation_precision"], m[1]["citation_recall"], m[1]["fact_coverage"], m[1]["bigram_support"]) == (1.0, 0.5, 0.333333, 1.0)
    assert m[1]["token_f1"] == pytest.approx(6 / 7, abs=1e-6) and m[1]["forbidden_claim_hits"] == 1 and m[1]["refusal_correct"] is None
    assert m[2]["relevant_citation_hit"] is None and m[2]["fact_coverage"] is None and m[2]["bigram_support"] is None and m[2]["refusal_correct"] and m[2]["citation_valid"]
    assert not m[3]["citation_valid"] and m[3]["token_f1"] == 0.0 and m[3]["forbidden_claim_hits"] == 1
    no = {r["case_id"]: r for r in answers.answer_metrics(spark.createDataFrame(rows, schema), retrieval=False).collect()}
    assert not no[1]["citation_valid"] and no[1]["relevant_citation_hit"] is None and no[2]["citation_valid"]


def test_judge_statistics(spark):
    pairs = spark.createDataFrame([("pass", "pass"), ("fail", "fail"), ("pass", "fail"), ("fail", "fail"), ("unsure", "pass")], "reference string, judge string")
    r = judge.agreement(pairs).first()
    assert (r["n"], r["agreement"], r["kappa"], r["pass_fail"]) == (4, 0.75, 0.5, 1)
    assert judge.agreement(pairs.limit(1)).first()["kappa"] == 1.0 and judge.agreement(pairs.limit(0)).first()["agreement"] is None
    v = spark.createDataFrame([(1, "fail"), (1, "fail"), (1, "pass"), (2, "pass"), (2, "fail")], "case_id long, label string")
    assert {x["case_id"]: x["label"] for x in judge.majority(v).collect()} == {1: "fail", 2: None}
    e = spark.createDataFrame([(1, ["a", "b", "c"], "calibration", "q"), (2, [], "x", "q")], "case_id long, evidence array<string>, phase string, question string")
    assert [x[0] for x in e.select(judge.evidence_order(F.col("evidence"), F.lit("rotate"))).collect()] == [["b", "c", "a"], []]
    p = json.loads(judge.payloads(e, "reverse").where("case_id = 1").first()["payload"])
    assert p["evidence"] == ["c", "b", "a"] and "phase" not in p
    with pytest.raises(ValueError):
        judge.payloads(e, "shuffle")


def test_policy_fault_injection(spark):
    checks = spark.createDataFrame([("a", "r", "all.x", "gte", 0.5), ("b", "r", "all.y", "lte", 0.5)], "id string, artifact string, path string, operator string, threshold double")
    facts = spark.createDataFrame([("r", "all.x", 0.6), ("r", "all.y", 0.5)], "artifact string, path string, value double")
    assert all(r["passed"] for r in gates.evaluate_policy(checks, facts).collect())
    broken = gates.evaluate_policy(checks, facts.withColumn("value", F.when(F.col("path") == "all.x", 0.0).otherwise(F.col("value")))).where("not passed").collect()
    assert [r["id"] for r in broken] == ["a"]
    with pytest.raises(Exception, match="unknown operator"):
        gates.evaluate_policy(checks.withColumn("operator", F.lit("eq")), facts).collect()
    with pytest.raises(Exception, match="missing or not numeric: all.y"):
        gates.evaluate_policy(checks, facts.where("path = 'all.x'")).collect()
    assert gates.configuration_sha256({"b": 1, "a": [2]}) == gates.configuration_sha256({"a": [2], "b": 1}) != gates.configuration_sha256({"a": [2]})
    body = spark.createDataFrame([("r", '{"all": {"x": 0.25, "t": true}}')], "artifact string, body string")
    paths = spark.createDataFrame([("r", "all.x"), ("r", "all.t"), ("r", "no")], "artifact string, path string")
    assert {r["path"]: r["value"] for r in gates.facts_from_json(body, paths).collect()} == {"all.x": 0.25, "all.t": None, "no": None}


def test_provenance(spark):
    import hashlib

    h = hashlib.sha256(b"a\nb\n").hexdigest()
    rows = [("raw", "x", "a\nb\n", h), ("lf", "x", "a\r\nb\r\n", h), ("none", "x", "a", h), ("skip", ".data/x", "a", h), ("crlf", "x", "a\nb\n", hashlib.sha256(b"a\r\nb\r\n").hexdigest())]
    out = {r["id"]: r["matched"] for r in gates.provenance(spark.createDataFrame(rows, "id string, path string, content string, expected string")).collect()}
    assert out == {"raw": "raw", "lf": "lf", "none": None, "crlf": "crlf"}


def test_contracts(spark):
    rows = spark.createDataFrame([("s1", "a" * 40, "explanatory", ["x"]), ("s2", "main", "other", [])], "id string, revision string, authority string, include array<string>")
    assert {(r["id"], r["rule"]) for r in contracts.violations(rows, "id", contracts.source_rules()).collect()} == {("s2", "revision"), ("s2", "authority"), ("s2", "include")}
    assert [r["id"] for r in contracts.duplicates(rows.union(rows.limit(1)), "id").collect()] == ["s1"]


def test_sources(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.md").write_text("x")
    (tmp_path / "in/b.exe").write_text("yy")
    files = corpus.read_files(spark, str(tmp_path / "in"))
    assert {(r["path"], r["bytes"]) for r in files.collect()} == {("sub/a.md", 1), ("b.exe", 2)}
    assert [r["rule"] for r in corpus.file_violations(files, [".md"], 10).collect()] == ["extension"]
    corpus.write_corpus(files, str(tmp_path / "out"))
    with pytest.raises(Exception):
        corpus.write_corpus(files, str(tmp_path / "out"))
    (tmp_path / "g.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n')
    assert corpus.read_jsonl(spark, str(tmp_path / "g.jsonl"), "id string, n long", "id").count() == 2
    (tmp_path / "g.jsonl").write_text('{"id": "a", "n": 1}\n{"id": "a", "n": 2}\n')
    with pytest.raises(ValueError, match="repeated"):
        corpus.read_jsonl(spark, str(tmp_path / "g.jsonl"), "id string, n long", "id")
    (tmp_path / "g.jsonl").write_text("\n{broken\n")
    with pytest.raises(ValueError, match="line 2: not a record"):
        corpus.read_jsonl(spark, str(tmp_path / "g.jsonl"), "id string, n long", "id")
    cache = corpus.ResultCache(str(tmp_path / "c.json"), {"v": 1})
    cache.put("k", [1])
    assert corpus.ResultCache(str(tmp_path / "c.json"), {"v": 1}).get("k") == [1] and corpus.ResultCache(str(tmp_path / "c.json"), {"v": 2}).get("k") is None
    corpus.seal(str(tmp_path / "s"), {"a": "1"})
    corpus.verify_seal(str(tmp_path / "s"), {"a": "1"})
    with pytest.raises(ValueError):
        corpus.verify_seal(str(tmp_path / "s"), {"a": "2"})
    with pytest.raises(ValueError):
        corpus.inside(str(tmp_path), "../x")
    vec = spark.createDataFrame([("c", [1.0, 2.0])], "chunk_id string, embedding array<float>")
    corpus.replace_index(vec, "i", 2, str(tmp_path / "ix"))
    with pytest.raises(ValueError):
        corpus.replace_index(vec, "i", 3, str(tmp_path / "ix"))
    (tmp_path / "m.yaml").write_text("max_file_bytes: 10\nsources:\n- {id: a, revision: " + "a" * 40 + ", include: ['*']}\n")
    assert corpus.load_source_manifest(str(tmp_path / "m.yaml"))["sources"][0]["id"] == "a"


def test_providers(spark):
    items = spark.createDataFrame([(i, ["a", "b"], "q") for i in range(4)], "case_id long, evidence array<string>, question string")

    def model(frames):
        for f in frames:
            first = [json.loads(p)["evidence"][0] for p in f["payload"]]
            label = ["fail" if c == 3 else "pass" for c in f["case_id"]]
            yield f.assign(label=label, groundedness=2, relevance=2, citation_support=2, completeness=2, error_flags=[[x] for x in first], input_tokens=10, output_tokens=5, latency_ms=1.0)

    v = judge.evaluate(items, model)
    assert {(r["evidence_order"], r["error_flags"][0]) for r in v.collect()} == {("retrieval", "a"), ("reverse", "b"), ("rotate", "b")}
    ref = spark.createDataFrame([(0, "pass"), (1, "pass"), (2, "fail"), (3, "fail")], "case_id long, label string")
    g = {r["gate"]: r for r in judge.promotion(v, ref, 3).collect()}
    assert g["agreement"]["observed"] == 0.75 and g["kappa"]["observed"] == 0.5 and g["stability"]["passed"] and g["safety"]["passed"] and not g["accepted"]["passed"]
    assert not {r["gate"]: r["passed"] for r in judge.promotion(v, ref.limit(0), 3).collect()}["safety"]
    for n in (1, 4):
        with pytest.raises(ValueError):
            judge.repetitions(items, n)

    def generator(frames):
        for f in frames:
            yield f.assign(raw_output=['{"answerable": true, "answer": "' + m[-1]["content"] + '", "citations": []}' for m in f["messages"]])

    rows = items.select("case_id", answers.prompt(F.col("question"), F.lit(""), grounded=False).alias("messages"))
    assert {r["answer"] for r in answers.generate(rows, generator).collect()} == {"q"}


def test_build_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# T\nsome words")
    files = corpus.read_files(spark, str(tmp_path / "in"))
    manifest = files.select(F.lit("d").alias("document_id"), F.col("path").alias("source_path"), "sha256")
    assert [r["text"] for r in corpus.build_index(manifest, files, str(tmp_path / "ix")).collect()] == ["T\nsome words"]
    with pytest.raises(ValueError, match="changed"):
        corpus.build_index(manifest.withColumn("sha256", F.lit("0")), files, str(tmp_path / "ix2"))


def test_acquire(spark, tmp_path):
    (tmp_path / "src/sub").mkdir(parents=True)
    (tmp_path / "src/sub/a.md").write_text("# A\ntext")
    (tmp_path / "src/b.txt").write_text("no")
    (tmp_path / "m.yaml").write_text("schema_version: '1.0'\nmax_file_bytes: 100\nallowed_extensions: ['.md']\nsources:\n- {id: s, revision: " + "a" * 40 + ", include: ['*.md'], authority: explanatory}\n")
    out, folders = str(tmp_path / "corpus"), {"s": str(tmp_path / "src")}
    made = corpus.acquire(spark, str(tmp_path / "m.yaml"), out, folders=folders)
    assert made["document_count"] == 1 and made["documents"][0]["document_id"] == "s/sub/a.md" and made["documents"][0]["bytes"] == 8
    with pytest.raises(FileExistsError):
        corpus.acquire(spark, str(tmp_path / "m.yaml"), out, folders=folders)
    assert corpus.acquire(spark, str(tmp_path / "m.yaml"), out, True, folders)["document_count"] == 1
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError, match="refusing"):
        corpus.acquire(spark, str(tmp_path / "m.yaml"), str(tmp_path / "other"), True, folders)
    source = {"id": "s", "include": ["*.rst"]}
    with pytest.raises(ValueError, match="zero files"):
        corpus.collect_source(spark, source, folders["s"], [".md"], 100)
    with pytest.raises(ValueError, match="extension"):
        corpus.collect_source(spark, {"id": "s", "include": ["*"]}, folders["s"], [".md"], 100)
    (tmp_path / "src/link.md").symlink_to(tmp_path / "src/b.txt")
    with pytest.raises(ValueError, match="symlink"):
        corpus.collect_source(spark, {"id": "s", "include": ["*.md"]}, folders["s"], [".md"], 100)


def test_embedding_cache_is_resumed(spark, tmp_path):
    def embedder(frames):
        for f in frames:
            yield f.assign(embedding=[[float(len(t))] for t in f["text"]])[["chunk_id", "embedding"]]

    chunks = spark.createDataFrame([("a", "x"), ("b", "yy")], "chunk_id string, text string")
    path = str(tmp_path / "cache")
    corpus.embed_with_cache(chunks.limit(1), path, embedder)
    got = {r["chunk_id"]: r["embedding"] for r in corpus.embed_with_cache(chunks, path, embedder).collect()}
    assert got == {"a": [1.0], "b": [2.0]} and spark.read.parquet(path).count() == 2


def test_missing_chunks_and_passages_raise(spark):
    ranked = spark.createDataFrame([(1, "d", 1, "c")], "case_id long, document_id string, rank int, best_chunk_id string")
    chunks = spark.createDataFrame([("c", "text")], "chunk_id string, text string")
    assert answers.candidates(ranked, ranked, ranked, chunks, 3).count() == 1
    with pytest.raises(Exception, match="missing from the source index"):
        answers.candidates(ranked, ranked, ranked, chunks.limit(0), 3).collect()
    with pytest.raises(Exception, match="no source chunk"):
        answers.candidates(ranked, ranked.limit(0), ranked.limit(0), chunks, 3).collect()


def test_generation_gates_and_acceptance(spark):
    rows = [("all", 1.0, 1.0, 1.0, 0.9, 0.3), ("dev", 1.0, 1.0, 1.0, 0.9, 0.5)]
    schema = "group string, schema_valid double, citation_valid double, refusal_correct double, relevant_citation_hit double, fact_coverage double"
    grounded = spark.createDataFrame(rows, schema)
    control = grounded.withColumn("fact_coverage", F.lit(0.45))
    gates_ = {r["gate"]: (r["observed"], r["passed"]) for r in answers.generation_gates(grounded, control).collect()}
    assert gates_["fact_delta"] == (0.05, False) and gates_["hit"] == (0.9, True) and len(gates_) == 5
    ok = answers.generation_gates(grounded, grounded.withColumn("fact_coverage", F.lit(0.1)))
    latency = spark.createDataFrame([(20.0,)], "p95 double")
    assert answers.acceptance(ok, latency, 30.0).first()["accepted"] and not answers.acceptance(ok, latency, 10.0).first()["accepted"]
    assert not answers.acceptance(answers.generation_gates(grounded, control), latency, 30.0).first()["accepted"]


def test_sensitive_terms(spark):
    for term in answers.SENSITIVE_TERMS:
        assert spark.range(1).select(answers.sensitive(F.lit(f"the {term.upper()}?"))).first()[0]
    assert not spark.range(1).select(answers.sensitive(F.lit("tokens, api key, customers"))).first()[0]
    out = answers.control_answers(spark.createDataFrame([(1, "Qual?"), (2, "Why?")], "case_id long, question string")).orderBy("case_id").collect()
    assert [r["answer"] for r in out] == [answers.NO_SOURCES_PT, answers.NO_SOURCES_EN] and out[1]["output_tokens"] == 13 and out[0]["input_tokens"] == 0
