"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.plans.fixtures import Corpus

FLAGSHIP = "hybrid_summary"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Register a function of a Corpus as a query; its name is the function's."""

    def add(f: Callable[[Corpus], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Corpus.of(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


from siftwell.plans import answering, corpus, judging, retrieval  # noqa: E402, F401
