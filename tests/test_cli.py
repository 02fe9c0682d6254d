import json

import pytest

from siftwell import cli


def judging(frames):
    for f in frames:
        yield f.assign(label="pass", groundedness=2, relevance=2, citation_support=2, completeness=2, error_flags=[[] for _ in range(len(f))], input_tokens=1, output_tokens=1, latency_ms=1.0)


def test_from_sources_to_gates(spark, tmp_path):
    run = lambda *args: cli.main([str(x) for x in args], spark)
    (tmp_path / "src").mkdir()
    topics = {"fox": "The red fox eats berries in the deep forest every summer.", "ship": "A big ship sails over the wide ocean to the old port.", "bread": "Fresh bread is baked with flour, water, yeast and salt here."}
    for name, text in topics.items():
        (tmp_path / f"src/{name}.md").write_text(f"# About {name}\n{text}\n")
    (tmp_path / "m.yaml").write_text("schema_version: '1.0'\nmax_file_bytes: 1000\nallowed_extensions: ['.md']\nsources:\n- {id: s, revision: " + "a" * 40 + ", include: ['*.md']}\n")
    cases = [{"id": f"q{i}", "question": f"What does the text say about the {n}?", "split": "dev" if i else "test", "language": "en", "category": "c", "answerable": True, "relevant_documents": [f"s/{n}.md"], "reference_answer": topics[n], "required_facts": [topics[n]], "forbidden_claims": []} for i, n in enumerate(topics)]
    cases.append({**cases[0], "id": "secret", "question": "What is the password of the fox?", "answerable": False, "relevant_documents": [], "required_facts": [], "split": "dev"})
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, cases)))
    at = {k: tmp_path / k for k in ("corpus", "index", "bm25", "dense", "hybrid", "vectors", "cache", "rerank", "gen", "packet", "judge", "seal")}
    g = tmp_path / "g.jsonl"
    assert run("fetch-corpus", "--manifest", tmp_path / "m.yaml", "--out", at["corpus"], "--derived", tmp_path / "d.json", "--folder", f"s={tmp_path / 'src'}") == 0
    assert json.loads((tmp_path / "d.json").read_text())["document_count"] == 3
    assert run("validate-evals", "--cases", g) == 0
    assert run("build-index", "--corpus", at["corpus"], "--out", at["index"]) == 0
    assert run("eval-bm25", "--index", at["index"], "--cases", g, "--out", at["bm25"]) == 0
    assert json.loads((tmp_path / "bm25.json").read_text())["summaries"]["all"]["recall_at_1"] == 1.0 and "| all | 3 | 1.000 |" in (tmp_path / "bm25.md").read_text()
    assert run("build-vector-index", "--index", at["index"], "--out", at["vectors"], "--cache", at["cache"]) == 0
    assert run("eval-vector", "--vectors", at["vectors"], "--cases", g, "--cache", at["cache"], "--out", at["dense"]) == 0
    assert run("eval-hybrid", "--bm25", at["bm25"], "--dense", at["dense"], "--cases", g, "--out", at["hybrid"]) == 0
    ranks = ["--hybrid", at["hybrid"], "--bm25", at["bm25"], "--dense", at["dense"], "--index", at["index"]]
    assert run("eval-reranker", "--cases", g, "--out", at["rerank"], *ranks) == 1  # no gain on dev where all is perfect
    assert json.loads((tmp_path / "rerank.acceptance.json").read_text())["quality"] == {"dev": False, "test": True}
    assert run("eval-generation", "--cases", g, "--out", at["gen"], *ranks) == 0
    assert json.loads((tmp_path / "gen.json").read_text())["accepted"]
    assert run("build-judge-packet", "--cases", g, "--generation", at["gen"], "--out", at["packet"], *ranks) == 0
    labels = tmp_path / "labels.jsonl"
    labels.write_text("\n".join(json.dumps({"case_id": c["id"], "phase": "calibration" if c["split"] == "dev" else "validation", "label": "pass"}) for c in cases))
    judge = ["eval-judge", "--packet", at["packet"], "--labels", labels, "--seal", at["seal"], "--model", "tests.test_cli:judging", "--out", at["judge"], "--phase"]
    with pytest.raises(ValueError, match="sealed"):
        run(*judge, "validation")
    assert run(*judge, "calibration") == 0 and run(*judge, "validation") == 0
    (tmp_path / "p.yaml").write_text("policy_id: p\nartifacts: {bm25: bm25.json}\nchecks:\n- {id: r, artifact: bm25, path: summaries.all.recall_at_1, operator: gte, threshold: 0.9}\n")
    assert run("check-regressions", "--root", tmp_path, "--policy", "p.yaml") == 0
    (tmp_path / "p.yaml").write_text((tmp_path / "p.yaml").read_text().replace("0.9", "1.1"))
    assert run("check-regressions", "--root", tmp_path, "--policy", "p.yaml") == 1
