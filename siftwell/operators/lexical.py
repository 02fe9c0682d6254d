"""Inverted index and BM25 over chunks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from siftwell.functions.text import tokens
from siftwell.operators.search import ENTRIES, NONE, Top, postings

#: Fixed values.
K1, B = 1.5, 0.75
DEPTH = 10


def tokenised(chunks: DataFrame) -> DataFrame:
    """chunk_id, document_id, tokens, len."""
    return chunks.select("chunk_id", "document_id", tokens(F.col("text")).alias("tokens")).withColumn("len", F.size("tokens"))


def repeated(tok: DataFrame) -> DataFrame:
    """Rows of equal chunk_id as one: its tokens as often as it occurs, and how often that is (times)."""
    return tok.groupBy("chunk_id", "document_id", "len").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.count("*").alias("times")).select("chunk_id", "document_id", "tokens", "len", "times")


class _Terms:
    """Batches (chunk_id, document_id, len, tokens) to one row for each term of a chunk."""

    def __call__(self, batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                terms = pc.unique(part.column(3).flatten())
                row, term, tf = postings(part.column(3), terms) if len(terms) else (np.zeros(0, "int64"),) * 3
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(row)) for i in range(3)), terms.take(pa.array(term)), pa.array(tf, pa.int64())], names=["chunk_id", "document_id", "len", "term", "tf"])


def term_frequencies(tok: DataFrame) -> DataFrame:
    """chunk_id, document_id, len, term, tf. A chunk is one row of ``tok``, so its terms are counted where it stands."""
    return tok.select("chunk_id", "document_id", "len", "tokens").mapInArrow(_Terms(), "chunk_id string, document_id string, len int, term string, tf long")


def terms(tok: DataFrame) -> DataFrame:
    """term: once for each chunk that it occurs in."""
    return tok.select(F.explode(F.array_distinct("tokens")).alias("term"))


def corpus_stats(tok: DataFrame) -> DataFrame:
    return tok.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def with_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", idf.alias("idf"), "avgdl")  # stats is one row


def query_terms(cases: DataFrame) -> DataFrame:
    """case_id, term, qtf: repeated query tokens count repeatedly."""
    return cases.select("case_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("case_id", "term").agg(F.count("*").alias("qtf"))


class _Counts:
    """Batches (tokens, times) to one row for each term of the questions (its place, df) and one (-1, rows, tokens)."""

    def __init__(self, terms: list[str]):
        self.terms = terms

    def __call__(self, batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        terms = pa.array(self.terms, pa.string())
        df, n, total = np.zeros(len(terms), "int64"), 0, 0
        for b in batches:
            df += np.bincount(postings(b.column(0), terms)[1], minlength=len(terms))
            n, total = n + (pc.sum(b.column(1)).as_py() or 0), total + len(b.column(0).flatten())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*df[at].tolist(), n], pa.int64()), pa.array([0] * len(at) + [total], pa.int64())], names=["at", "df", "total"])


class _Bm25:
    """Scores of a batch (group, id, tokens, len): its postings times the terms' weights for each question."""

    def __init__(self, terms: list[str], weights, avgdl: float, k1: float, b: float):
        self.terms, self.weights, self.avgdl, self.k1, self.b = terms, weights, avgdl, k1, b

    def __call__(self, batch):
        import numpy as np
        import pyarrow as pa

        row, term, tf = postings(batch.column(2), pa.array(self.terms, pa.string()))
        length = np.asarray(batch.column(3)).astype("float64")[row]
        part = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.avgdl))
        out = np.zeros((batch.num_rows, self.weights.shape[1]))
        at = np.searchsorted(row, np.arange(batch.num_rows + 1))
        for i in range(batch.num_rows):
            if at[i] < at[i + 1]:
                out[i] = part[at[i] : at[i + 1]] @ self.weights[term[at[i] : at[i + 1]]]
        return np.where(out > 0, np.round(out, 9), NONE)


def bm25_scores(tok: DataFrame, cases: DataFrame, k1: float = K1, b: float = B, k: int | None = None, by: str = "chunk_id") -> DataFrame:
    """case_id, chunk_id, document_id, score of every chunk that shares a term with the question.

    With ``k``, of each question only rows among which its k best by ``by`` are, chunk_id or document_id (then with the
    best chunk); ``top_chunks`` and ``top_documents`` rank them. The questions' terms are collected: questions are a
    curated set. Two passes over ``tok``, one for the counts and one for each block of questions, and no shuffle.
    """
    import numpy as np

    spark = tok.sparkSession
    asked: dict = {}
    for r in query_terms(cases).collect():
        asked.setdefault(r["case_id"], {})[r["term"]] = r["qtf"]
    schema = StructType([StructField("case_id", cases.schema["case_id"].dataType), *(StructField(c, StringType()) for c in ("chunk_id", "document_id")), StructField("score", DoubleType())])
    terms = sorted({t for q in asked.values() for t in q})
    times = F.col("times") if "times" in tok.columns else F.lit(1).cast("long").alias("times")
    counts = tok.select("tokens", times).mapInArrow(_Counts(terms), "at long, df long, total long").groupBy("at").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).collect() if terms else []
    found = {r["at"]: r for r in counts}
    n, total = (found[-1]["df"], found[-1]["total"]) if found else (0, 0)
    if not total:
        return spark.createDataFrame([], schema)
    idf = {t: math.log(1 + (n - found[i]["df"] + 0.5) / (found[i]["df"] + 0.5)) for i, t in enumerate(terms) if i in found}
    group, other = (by, "document_id" if by == "chunk_id" else "chunk_id")
    types = StructType([schema["case_id"], schema[group], schema[other], schema["score"]])
    out = None
    for block in blocks(asked):
        own = sorted({t for c in block for t in asked[c] if t in idf})
        place = {t: i for i, t in enumerate(own)}
        w = np.zeros((len(own), len(block)))
        for j, c in enumerate(block):
            for t, qtf in asked[c].items():
                if t in place:
                    w[place[t], j] = qtf * idf[t]
        if own:
            top = Top(_Bm25(own, w, total / n, k1, b), block, k, to_arrow_schema(types))
            part = tok.select(group, other, "tokens", "len").mapInArrow(top, types).select(*schema.names)
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def blocks(asked: dict) -> list[list]:
    """The cases dealt to blocks of bounded size: terms times cases."""
    out: list[list] = [[]]
    have: set = set()
    for c, own in asked.items():
        if out[-1] and len(have | own.keys()) * (len(out[-1]) + 1) > ENTRIES:
            out.append([])
            have = set()
        out[-1].append(c)
        have |= own.keys()
    return out


def top_chunks(scores: DataFrame, k: int = DEPTH) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("score"), "chunk_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def top_documents(scores: DataFrame, k: int = DEPTH) -> DataFrame:
    """Best chunk of each document, then the best documents: case_id, rank, document_id, score, best_chunk_id."""
    best = scores.groupBy("case_id", "document_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("chunk_id").alias("c"))).alias("b"))
    best = best.select("case_id", "document_id", (-F.col("b.s")).alias("score"), F.col("b.c").alias("best_chunk_id"))
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("score"), "document_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
