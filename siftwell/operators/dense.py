"""Exact cosine search and the hashed bag-of-words stand-in for an embedding model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from siftwell.operators.search import ENTRIES, NONE, NULL, Top

#: Fixed values.
CANDIDATES = 100
BUCKETS = 256
#: Query vectors joined at once with all rows by broadcast; more are taken in several passes.
QUERY_BLOCK = 2000


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


class _Cosine:
    """Scores of a batch (id, id, v) against query vectors; a pair with a null or of unequal lengths has no score."""

    def __init__(self, cases: list, vectors: list):
        import numpy as np

        self.cases, self.n = np.array(cases), len(cases)
        by: dict[int, list] = {}
        for i, v in enumerate(vectors):
            if v is not None and None not in v:
                by.setdefault(len(v), []).append((i, v))
        self.by = {d: (np.array([i for i, _ in own]), np.array([v for _, v in own], "float64").reshape(len(own), d)) for d, own in by.items()}

    def __call__(self, batch):
        import numpy as np
        import pyarrow.compute as pc

        ids, v = batch.column(0), batch.column(2)
        out = np.full((len(ids), self.n), NULL)
        n = np.asarray(pc.fill_null(pc.list_value_length(v), -1))
        holes = np.zeros(len(ids), bool)
        if v.flatten().null_count:
            holes[np.asarray(pc.list_parent_indices(v))[np.asarray(pc.is_null(v.flatten()))]] = True
        for d, (at, q) in self.by.items():
            rows = np.flatnonzero((n == d) & ~holes)
            if len(rows):
                x = np.asarray(v.take(rows).flatten()).astype("float64").reshape(len(rows), d)
                with np.errstate(all="ignore"):
                    s = np.round((x @ q.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((q * q).sum(axis=1))), 9)
                # what isn't a number comes first, as in Spark's order
                out[np.ix_(rows, at)] = np.where(np.isnan(s), np.inf, s)
        out[np.asarray(ids)[:, None] == self.cases] = NONE
        return out


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """case_id, id, score, rank of the k most similar rows. queries: case_id, q; vectors: id, v.

    The exact search compares every query with every row: each task multiplies its rows with a block of queries and
    keeps the k best of each, so the pairs are never rows. The queries are collected and broadcast in blocks of bounded
    size.
    """
    asked = queries.where("case_id is not null").collect()
    kind = {"case_id": queries.schema["case_id"].dataType, "id": vectors.schema["id"].dataType}
    schema = StructType([StructField("case_id", kind["case_id"]), StructField("id", kind["id"]), StructField("score", DoubleType())])
    types = to_arrow_schema(StructType([schema["case_id"], schema["id"], StructField("same", kind["id"]), schema["score"]]))
    rows = vectors.where("id is not null").select("id", "id", "v").toDF("id", "same", "v")
    out = vectors.sparkSession.createDataFrame([], schema)
    for i in range(0, len(asked), block):
        part = asked[i : i + block]
        top = Top(_Cosine([r["case_id"] for r in part], [r["q"] for r in part]), [r["case_id"] for r in part], k, types)
        found = rows.mapInArrow(top, StructType([schema["case_id"], schema["id"], StructField("same", kind["id"]), schema["score"]])).select(*schema.names)
        out = found if i == 0 else out.unionByName(found)
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def bucket(term: Column) -> Column:
    return (F.conv(F.substring(F.md5(term), 1, 4), 16, 10).cast("int") % BUCKETS).cast("int")


def hashed(rows: DataFrame, *key: str) -> DataFrame:
    """(key, bucket, w): normalised hashed term counts of the rows' ``tokens``."""
    tf = rows.select(*key, F.explode("tokens").alias("term")).groupBy(*key, bucket(F.col("term")).alias("bucket")).agg(F.count("*").cast("double").alias("tf"))
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(W.partitionBy(*key)))
    return tf.select(*key, "bucket", (F.col("tf") / norm).alias("w"))


class _Hashed:
    """Scores of a batch (chunk_id, document_id, tokens): normalised hashed term counts times the questions'."""

    def __init__(self, weights):
        self.weights = weights

    def __call__(self, batch):
        import hashlib

        import numpy as np
        import pyarrow.compute as pc

        n = np.asarray(pc.fill_null(pc.list_value_length(batch.column(2)), 0))
        terms = pc.dictionary_encode(batch.column(2).flatten())
        # the first four digits modulo 256 are the second byte
        to = np.array([hashlib.md5(t.encode()).digest()[1] for t in terms.dictionary.to_pylist()], "int64")
        row = np.repeat(np.arange(len(n), dtype="int64"), n)
        tf = np.bincount(row * BUCKETS + to[np.asarray(terms.indices)], minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS) if len(row) else np.zeros((len(n), BUCKETS))
        norm = np.sqrt((tf * tf).sum(axis=1, keepdims=True))
        out = (tf / np.where(norm > 0, norm, 1.0)) @ self.weights
        return np.where(out > 0, np.round(out, 9), NONE)


def hashed_scores(tok: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """case_id, chunk_id, document_id, score by the sparse dot product. queries: case_id, tokens.

    With ``k``, of each query only rows among which its k best chunks are. The queries' vectors are collected.
    """
    import numpy as np

    asked: dict = {}
    for r in hashed(queries, "case_id").collect():
        asked.setdefault(r["case_id"], []).append((r["bucket"], r["w"]))
    schema = StructType([StructField("case_id", queries.schema["case_id"].dataType), *(StructField(c, StringType()) for c in ("chunk_id", "document_id")), StructField("score", DoubleType())])
    cases, out = list(asked), None
    for i in range(0, len(cases), ENTRIES // BUCKETS):
        block = cases[i : i + ENTRIES // BUCKETS]
        w = np.zeros((BUCKETS, len(block)))
        for j, c in enumerate(block):
            for at, x in asked[c]:
                w[at, j] = x
        part = tok.select("chunk_id", "document_id", "tokens").mapInArrow(Top(_Hashed(w), block, k, to_arrow_schema(schema)), schema)
        out = part if out is None else out.unionByName(part)
    return tok.sparkSession.createDataFrame([], schema) if out is None else out


def missing_embeddings(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks that the cache of embeddings doesn't hold."""
    return chunks.join(cache, "chunk_id", "left_anti")


def embed_missing(chunks: DataFrame, cache: DataFrame, embedder) -> DataFrame:
    """Cache united with the embeddings of what it lacks; ``embedder`` maps pandas batches of (chunk_id, text)."""
    todo = missing_embeddings(chunks.select("chunk_id", "text"), cache)
    return cache.select("chunk_id", "embedding").unionByName(todo.mapInPandas(embedder, "chunk_id string, embedding array<float>"))


def vector_literal(values) -> str:
    if not len(values):
        raise ValueError("an empty vector has no literal")
    return "[" + ",".join(format(float(v), ".9g") for v in values) + "]"


def hashed_embedder(frames):
    """Stand-in for an embedding model: normalised hashed token counts of each text of the pandas frames."""
    import hashlib
    import math

    import regex

    from siftwell.functions.text import TOKEN

    for f in frames:
        out = []
        for text in f["text"]:
            v = [0.0] * BUCKETS
            for t in regex.findall(TOKEN, text or ""):
                v[int(hashlib.md5(t.lower().replace("ß", "ss").encode()).hexdigest()[:4], 16) % BUCKETS] += 1
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        yield f.assign(embedding=out)[["chunk_id", "embedding"]]
