"""Searches keep the k best of each query within the tasks: same rows as a ranking of all pairs, and no shuffle of the pairs."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.functions.text import SPACE, tokens, windows, words
from siftwell.operators import dense, lexical
from siftwell.operators.search import NONE, Top
from siftwell.plans import registry


def exchanged(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("size", [1, 7, 50])
def test_best_of_batches_are_the_best_of_all(size):
    rng = random.Random(size)
    rows = [(rng.choice(["a", "b", "c", "d", "e", None]), f"c{i:03d}", [rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(50)]
    types = pa.schema([("case_id", pa.int64()), ("g", pa.string()), ("i", pa.string()), ("score", pa.float64())])

    def scorer(b):
        s = np.array(b.column(2).to_pylist())
        return np.where(s > 0, s, NONE)

    batches = [pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[at : at + size]], t) for j, t in enumerate((pa.string(), pa.string(), pa.list_(pa.float64())))], names=["g", "i", "s"]) for at in range(0, 50, size)]
    got = [tuple(r.values()) for b in Top(scorer, [0, 1, 2, 3], 3, types)(batches) for r in b.to_pylist()]
    for q in range(4):
        best: dict = {}
        for g, i, s in rows:
            if s[q] > 0:
                best[g] = min(best.get(g, (0, "")), (-s[q], i))
        want = sorted((s, (g is not None, g or ""), i) for g, (s, i) in best.items())[:3]
        assert sorted((-s, (g is not None, g or ""), i) for c, g, i, s in got if c == q) == want


def test_pairs_are_neither_kept_nor_shuffled(spark):
    docs = spark.createDataFrame([(str(i), f"red fox number {i % 7} of {i} foxes") for i in range(300)], "document_id string, text string")
    tok = lexical.tokenised(docs.select(F.concat("document_id", F.lit("::0")).alias("chunk_id"), "document_id", "text")).coalesce(2)
    cases = spark.createDataFrame([(i, f"red fox {i}") for i in range(20)], "case_id long, question string")
    some, every = lexical.bm25_scores(tok, cases, k=3), lexical.bm25_scores(tok, cases)
    assert every.count() == 20 * 300 and some.count() == 20 * 3 * 2 and exchanged(some) == 0
    rank = lambda d: sorted(map(tuple, lexical.top_chunks(d, 3).select("case_id", "rank", "chunk_id", "score").collect()))
    assert rank(some) == rank(every)
    by = lexical.bm25_scores(tok, cases, k=3, by="document_id")
    assert sorted(map(tuple, lexical.top_documents(by, 3).collect())) == sorted(map(tuple, lexical.top_documents(every, 3).collect()))
    assert exchanged(lexical.term_frequencies(tok)) == 0
    asked = cases.select("case_id", tokens(F.col("question")).alias("tokens"))
    near, all_ = dense.hashed_scores(tok, asked, 3), dense.hashed_scores(tok, asked)
    assert exchanged(near) == 0 and rank(near) == rank(all_) and near.count() < all_.count()


def test_questions_in_blocks(spark, monkeypatch):
    tok = lexical.tokenised(spark.createDataFrame([("a", "x", "one two three"), ("b", "y", "two three four four")], "chunk_id string, document_id string, text string"))
    cases = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", "four", "nothing", "three three one"])], "case_id long, question string")
    key = lambda d: sorted(map(tuple, d.collect()))
    whole = key(lexical.bm25_scores(tok, cases))
    monkeypatch.setattr(lexical, "ENTRIES", 2)
    assert key(lexical.bm25_scores(tok, cases)) == whole and len(whole) == 5
    assert lexical.bm25_scores(tok, cases.limit(0)).count() == 0 and lexical.bm25_scores(tok.limit(0), cases).count() == 0
    assert lexical.bm25_scores(tok, cases.where("case_id = 2")).count() == 0


def test_repeated_documents_equal_the_sql(spark, sf, tmp_path):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        more = f" union all select * from '{sf}/documents.parquet' where doc_id % 3 = 0" if t == "documents" else ""
        c.execute(f"copy (select * from '{sf}/{t}.parquet'{more}) to '{tmp_path}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    for name in ("bm25_chunks", "dense_documents", "term_frequencies", "idf", "corpus_stats", "first_relevant_rank"):
        a, b = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(registry.ORACLE_SQL[name]).df()
        cols = sorted(a.columns)
        a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (a, b))
        assert a.equals(b), name


def test_plans_begin_at_what_is_written(spark, sf):
    """The plan of a query over kept relations doesn't hold theirs: else the plans of gates fill the driver's memory."""
    for name in ("metric_deltas", "rerank_gates"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryRelation" not in plan and "MapInArrow" not in plan and plan.count("Exchange") < 60, name


def test_tokens_fold_as_each_by_itself(spark):
    rows = ["İstanbul ΟΔΟΣ's end", "Straße ΟΔΥΣΣΕΥΣ-Σ", "plain Été", None, ""]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    want = df.select(F.transform(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"), F.lit(0)), lambda x: F.replace(F.lower(x), F.lit("ß"), F.lit("ss")))).collect()
    assert df.select(tokens(F.col("t"))).collect() == want


def test_a_long_text_is_split_once(spark):
    text = " ".join(f"w{i}" for i in range(30000))
    import time

    df = spark.createDataFrame([(text,)], "t string").select(windows(F.col("t"), 220, 40).alias("w"))
    began = time.time()
    w = df.first()["w"]
    assert len(w) == 167 and w[-1].split()[-1] == "w29999" and time.time() - began < 5


def test_words_split_at_every_white_space(spark):
    odd = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["\u200b", "\ufeff", "\u180e"]
    rows = [(f" a{c}b c\n\n{c}d{c}",) for c in odd] + [("",), (" \n",), (None,), ("Stra\u00dfe \u00e9t\u00e9",)]
    df = spark.createDataFrame(rows, "t string")
    want = df.select(F.filter(F.split("t", SPACE), lambda w: w != "")).collect()
    assert df.select(words(F.col("t"))).collect() == want


def test_plain_texts_are_split_without_a_regular_expression(spark):
    import time

    df = spark.range(0, 400, 1, 4).select(F.concat(F.repeat(F.lit("some words of a text "), 10000), F.lit("\u00e9")).alias("t")).localCheckpoint()
    took = {}
    for how, c in (("regex", F.split("t", SPACE)), ("words", words(F.col("t")))) * 3:
        began = time.time()
        assert df.select(F.sum(F.size(c))).first()[0] >= 400 * 50001
        took[how] = min(took.get(how, 99), time.time() - began)
    assert took["words"] < 0.7 * took["regex"], took
