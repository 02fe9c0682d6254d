import duckdb
import pytest

import __spark_entry__

TABLES = "documents benchmark embeddings pages labels conversations events".split()
FAST = ["bm25_documents", "hybrid_summary", "retrieval_case_metrics", "rrf_selected_config", "generation_summary", "generation_gates", "extractive_answers", "prompt_messages", "parse_generation", "sensitive_questions", "no_retrieval_answers", "chunk_openapi", "label_template", "vector_index_stats", "label_coverage", "chunk_markdown", "judge_gates", "regression_gate"]


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    from siftwell.plans import registry

    a, b = registry.QUERIES[name](spark, sf).toPandas(), c.execute(registry.ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (a, b))
    assert a.equals(b)


def test_entry_and_registry(spark, sf):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
