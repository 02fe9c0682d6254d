"""Nearest neighbours by balanced posting lists.

Centroids are fitted by balanced bisection on a bounded sample; every valid row is then put on the list of its
nearest centroid and, if it lies near a boundary, on further lists (distance ratio and the rule that a list is
skipped if a list already taken is nearer to its centroid). Long lists, such as one of exact copies, are split
into parts of bounded size by a hash of the id. A query walks a graph of the centroids in memory and takes
the lists whose centroids lie within a ratio of the distance of the nearest that it does not equal, and further
lists until they hold enough rows for ``k`` neighbours; each part of each list gives its best
``k`` by exact double-precision distance, and these are merged.

Bounds: the sample holds at most ``SAMPLE_FLOATS`` numbers and there are at most ``MAX_CENTROIDS`` centroids,
which is what is broadcast; a task holds one part of a list (``PART_ROWS`` rows) and a batch of queries.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components (of any numeric type), or are of another
length than the most frequent (the shorter of several) take no part, neither as queries nor as candidates; null ids take no part;
repeated ids count once, at their nearest row; ties go to the smaller id; an empty table gives an empty
result; with few rows there is one list, and the search is exact.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.common import materialize, require, table

SAMPLE_FLOATS = 4_000_000
MAX_CENTROIDS = 16_384
#: Rows for each centroid aimed at.
LIST_ROWS = 256
PART_ROWS = 2048
REPLICAS = 4
REPLICA_RATIO = 1.1
#: A list is skipped if its centroid is nearer to a list already taken than this share of its distance to the row.
APART = 0.5
#: The probe ratio is measured on the sample so that this share of true neighbours lies on the probed lists.
RECALL = 0.93
MEASURED = 128
#: A query equals a centroid if they lie no further apart than this share of its length.
EQUAL = 1e-9
DEGREE = 24


def element(vectors: DataFrame) -> str:
    return vectors.schema["embedding"].dataType.elementType.simpleString()


def valid(vectors: DataFrame) -> DataFrame:
    kind = element(vectors)
    e = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", e.alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0))


def bisect(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """At most k centroids of near-equal groups: the largest group is halved by two means until there are k."""
    rng = np.random.default_rng(seed)
    heap, n = [(-len(x), 0, np.arange(len(x)))], 1
    done: list[np.ndarray] = []
    while heap and len(heap) + len(done) < k:
        _, _, rows = heapq.heappop(heap)
        v = x[rows]
        if len(rows) < 2 or (v == v[0]).all():
            done.append(rows)
            continue
        a, b = v[rng.choice(len(v), 2, replace=False)]
        if (a == b).all():
            b = v[((v - a) ** 2).sum(1).argmax()]
        for _ in range(6):
            side = v @ (b - a) - (b @ b - a @ a) / 2
            right = side > 0
            if not right.any() or right.all():
                break
            a, b = v[~right].mean(0), v[right].mean(0)
        side = v @ (b - a)
        right = side > (b @ b - a @ a) / 2
        if not 0.2 <= right.mean() <= 0.8:  # balanced: cut at the nearer quantile, unless ties stand there
            cut = np.quantile(side, 0.2 if right.mean() > 0.8 else 0.8)
            right = side > cut
        if not right.any() or right.all():
            right = side > side.min()
            if not right.any():
                done.append(rows)
                continue
        for part in (rows[~right], rows[right]):
            heapq.heappush(heap, (-len(part), n, part))
            n += 1
    return np.stack([x[r].mean(0) for r in [*done, *(h[2] for h in heap)]])


class Index:
    """Centroids and the graph over them."""

    def __init__(self, centroids: np.ndarray):
        self.c = np.ascontiguousarray(centroids, np.float64)
        k = len(self.c)
        self.sq = (self.c**2).sum(1)
        near = []
        for i in range(0, k, 512):
            d = self.distances(self.c[i : i + 512])
            m = min(DEGREE + 1, k)
            near.append(np.argpartition(d, m - 1, axis=1)[:, :m])
        links = [set(map(int, r)) for r in np.concatenate(near)]
        for i in range(k):
            for j in list(links[i]):
                links[j].add(i)
        for i in range(k - 1):  # a ring, so that every centroid is reached
            links[i].add(i + 1)
            links[i + 1].add(i)
        self.links = [np.fromiter(s - {i}, int) for i, s in enumerate(links)]
        self.ratio = 1.0
        self.sizes, self.least = np.zeros(k, np.int64), 0  # rows of each list, and how many rows a query is to meet
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((v**2).sum(1)[:, None] - 2 * v @ self.c.T + self.sq, 0))

    def lists_of(self, v: np.ndarray) -> list[list[int]]:
        """For each row the lists it goes to: its nearest and others near the boundary."""
        d = self.distances(v)
        m = min(4 * REPLICAS, len(self.c))
        cand = np.argpartition(d, m - 1, axis=1)[:, :m]
        out = []
        for i in range(len(v)):
            order = cand[i][np.argsort(d[i, cand[i]], kind="stable")]
            first = d[i, order[0]]
            took = [int(order[0])]
            for j in order[1:]:
                if len(took) == REPLICAS or d[i, j] > REPLICA_RATIO * first:
                    break
                if all(((self.c[j] - self.c[t]) ** 2).sum() >= (APART * d[i, j]) ** 2 for t in took):
                    took.append(int(j))
            out.append(took)
        return out

    def search(self, q: np.ndarray) -> list[int]:
        """Lists for a query: best-first walk over the graph as far as the distance ratio reaches, and until enough rows are met."""
        seen = set(map(int, self.entries))
        d = np.sqrt(((self.c[self.entries] - q) ** 2).sum(1))
        heap = [(float(a), int(i)) for a, i in zip(d, self.entries)]
        heapq.heapify(heap)
        found, first, late, met, equal = [], math.inf, 0, 0, EQUAL * math.sqrt(q @ q)
        while heap:
            a, i = heapq.heappop(heap)
            if a > equal:
                first = min(first, a)
            if a > first * self.ratio and met >= self.least:
                late += 1
                if late > DEGREE:  # walk on a little: nearer centroids may lie behind
                    break
            else:
                found.append((a, i))
                met += int(self.sizes[i])
            new = [j for j in self.links[i].tolist() if j not in seen]
            if new:
                seen.update(new)
                for b, j in zip(np.sqrt(((self.c[new] - q) ** 2).sum(1)).tolist(), new):
                    heapq.heappush(heap, (b, j))
        took, met = [], 0
        for a, i in sorted(found):
            if a > first * self.ratio and met >= self.least:
                break
            took.append(i)
            met += int(self.sizes[i])
        return took

    def measure(self, x: np.ndarray) -> None:
        """Set the probe ratio from the neighbours of the sample's distinct vectors: copies are always on the nearest list."""
        x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
        needed = []
        for q in x[np.linspace(0, len(x) - 1, min(MEASURED, len(x))).astype(int)]:
            s = ((x - q) ** 2).sum(1)
            near = x[np.argsort(s, kind="stable")[1:11]]
            d = np.sqrt(((self.c - q) ** 2).sum(1))
            apart = d[d > EQUAL * math.sqrt(q @ q)]
            if len(near) and len(apart):
                needed += [max(1.0, d[lists].min() / apart.min()) for lists in self.lists_of(near)]
        self.ratio = float(np.quantile(needed, RECALL, method="higher")) * (1 + 1e-9) if needed else 1.0


def fit(vectors: DataFrame) -> Index | None:
    """Centroids for the most frequent length, from a sample of bounded size, taken by a hash of the id."""
    first = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").take(1)
    if not first:
        return None
    d, n = first[0]["d"], first[0]["count"]
    rows = max(1000, SAMPLE_FLOATS // d)
    share = min(1.0, rows / n)
    pick = vectors.where(F.size("embedding") == d)
    if share < 1:
        pick = pick.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    x = np.array([r[0] for r in pick.select("embedding").limit(rows).toPandas().to_numpy()], np.float64)
    k = min(max(1, n // LIST_ROWS), MAX_CENTROIDS, max(1, len(x) // 4))
    index = Index(bisect(x, k)) if k > 1 else Index(x.mean(0)[None])
    index.measure(x)
    return index


def _matrix(column, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


class _Assign:
    def __init__(self, shared, queries: bool):
        self.shared, self.queries = shared, queries

    def __call__(self, batches):
        import pyarrow as pa

        index: Index = self.shared.value
        d = index.c.shape[1]
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1), d)
            lists = [index.search(q) for q in v] if self.queries else index.lists_of(v)
            at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            took = pa.RecordBatch.from_arrays(b.columns, names=b.schema.names).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(x, np.int32) for x in lists])), took.column(0), took.column(1)], names=["list", "vec_id", "embedding"])


class _Search:
    """Best k of each part of a list for each query; rows come sorted by part, candidates before queries."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches):
        import pyarrow as pa

        key, ids, vecs = None, [], []
        out = ([], [], [])
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0).to_numpy()
            query = b.column(1).to_numpy(zero_copy_only=False)
            vid = b.column(2).to_numpy()
            v = _matrix(b.column(3), len(b.column(3)[0]))
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (query[1:] != query[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(part)]):
                if part[lo] != key:
                    key, ids, vecs = part[lo], [], []
                if not query[lo]:
                    ids.append(vid[lo:hi])
                    vecs.append(v[lo:hi])
                elif ids:
                    if len(ids) > 1:
                        ids, vecs = [np.concatenate(ids)], [np.concatenate(vecs)]
                    for i in range(lo, hi):
                        self.best(vid[i], v[i], ids[0], vecs[0], out)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "vec_id", "score"])
                out = ([], [], [])

    def best(self, qid, q, ids, vecs, out) -> None:
        s = np.sqrt(((vecs - q) ** 2).sum(1))
        own = ids != qid
        ids, s = ids[own], s[own]
        if len(s) > self.k:
            limit = np.partition(s, self.k - 1)[self.k - 1]
            keep = s <= limit
            ids, s = ids[keep], s[keep]
        order = np.lexsort((ids, s))
        seen = dict.fromkeys(ids[order].tolist())  # repeated ids count once, at their nearest
        if len(seen) < len(order):
            first = np.unique(ids[order], return_index=True)[1]
            order = order[np.sort(first)]
        order = order[: self.k]
        out[0].append(np.full(len(order), qid))
        out[1].append(ids[order])
        out[2].append(s[order])


EMPTY = "query_id long, rank int, vec_id long, score double"


def search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest rows of ``vectors`` to each of ``queries`` (both: vec_id, embedding), but not itself."""
    require(queries, "vec_id", "embedding")
    require(vectors, "vec_id", "embedding")
    spark = vectors.sparkSession
    rows = valid(vectors)
    index = fit(rows)
    if index is None:
        return spark.createDataFrame([], EMPTY)
    d = index.c.shape[1]
    shared = spark.sparkContext.broadcast(index)
    fitting = rows.where(F.size("embedding") == d)
    lists = materialize(fitting.mapInArrow(_Assign(shared, False), f"list int, vec_id long, embedding array<{element(rows)}>"), "ann-lists")
    counts = lists.groupBy("list").count().collect()  # at most MAX_CENTROIDS rows
    for r in counts:
        index.sizes[r["list"]] = r["count"]
    index.least = REPLICAS * (k + 1)  # a row is on REPLICAS lists at most, and one may be the query itself
    probing = spark.sparkContext.broadcast(index)
    sizes = F.broadcast(spark.createDataFrame([(r["list"], -(-r["count"] // PART_ROWS)) for r in counts], "list int, parts long"))
    wide = F.col("list").cast("long") * F.lit(1 << 32)
    held = lists.join(sizes, "list").select((wide + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("part"), F.lit(False).alias("query"), "vec_id", "embedding")
    wanted = valid(queries)
    asked = wanted.where(F.size("embedding") == d).mapInArrow(_Assign(probing, True), f"list int, vec_id long, embedding array<{element(wanted)}>")
    asked = asked.join(sizes, "list").select("list", "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    asked = asked.select((wide + F.col("p")).alias("part"), F.lit(True).alias("query"), "vec_id", "embedding")
    work = held.unionByName(asked).repartition("part").sortWithinPartitions("part", "query")
    found = work.mapInArrow(_Search(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search(e.where(F.col("vec_id") % 100 == 0), e, 10)
