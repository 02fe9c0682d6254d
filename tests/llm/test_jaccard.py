import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import jaccard


def sets(rows, n):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        out[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    return out


def brute(rows, n, percent):
    s = sets(rows, n)
    at = {d: d for d in s}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = top(a), top(b)
                at[max(x, y)] = min(x, y)
    return {d: (len(s[d]), top(d)) for d in s}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randrange(8, 150))] for _ in range(max(2, n // 12))]
    rows = []
    for d in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(b))
            if rng.random() < 0.5:
                b[k] = rng.choice(words)
            elif len(b) > 2:
                del b[k]
        if rng.random() < 0.3:
            b += [rng.choice(words) for _ in range(rng.randrange(6))]
        rows.append((d, " ".join(b) if rng.random() < 0.9 else " ".join(b).upper()))
    return rows


@pytest.mark.parametrize("n,percent,spare,chunk", [(3, 90, 1, 400_000), (5, 80, 1, 200), (2, 60, 0, 50), (1, 80, 0, 400_000)])
def test_components_equal_brute_force(spark, n, percent, spare, chunk):
    rows = corpus(n * percent, 220)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r["doc"]: (r["n"], r["component"]) for r in jaccard.components(df, n, percent, spare, chunk).collect()}
    assert out == brute(rows, n, percent)


@pytest.mark.parametrize("percent,spare", [(90, 1), (80, 0), (60, 0), (50, 1)])
def test_every_similar_pair_meets_in_an_entry(percent, spare):
    """Pigeonhole: for random pairs at the limit, a probing entry of the larger meets one of the smaller's."""
    rng = np.random.default_rng(percent)
    bands = jaccard.Bands(percent, spare)
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        pool = rng.integers(0, 1 << 63, 2 * n + 4).astype(np.uint64)
        a = np.unique(pool[:n])
        b = a.copy()
        for _ in range(int(rng.integers(0, n))):
            c = np.unique(np.append(b[rng.permutation(len(b))[: len(b) - int(rng.integers(0, 2))]], pool[n + int(rng.integers(0, n + 4))]))
            both = np.intersect1d(a, c).size
            if 100 * both < percent * (len(a) + len(c) - both):
                break
            b = c
        x, y = (a, b) if len(a) >= len(b) else (b, a)
        sx, px = jaccard.entries(x, bands)
        sy, py = jaccard.entries(y, bands)
        assert set(sx[px].tolist()) & set(sy.tolist()), (len(x), len(y))


def test_odd_rows(docs, none):
    out = jaccard.components(docs).collect()
    assert {r["doc"] for r in out if r["n"] == 1} == {4, 5, 6} and not {1, 2, 3} & {r["doc"] for r in out}
    by = {r["doc"]: r["component"] for r in out}
    assert by[6] == 5 and by[5] == 5 and by[4] == 4 and by[jaccard.NO_ID] == jaccard.NO_ID
    assert jaccard.components(none).count() == 0
    kept = jaccard.first_of_each(docs)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and {1, 2, 3, None} <= set(ids) and 50 not in ids and 51 not in ids
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert jaccard.first_of_each(none).count() == 0


def test_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "k1 long, k2 long")
    start = spark.range(0, 41).union(spark.range(100, 103)).select(F.col("id").alias("k"), F.col("id").alias("comp"))
    out = {r["k"]: r["comp"] for r in jaccard.connected(links, start).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[101] == 100 and out[102] == 102


def test_null_and_repeated_ids_lose_only_near_copies(spark):
    rng = random.Random(3)
    a, b, c, d, e, f, g = (" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(7))
    rows = [(3, a), (None, a + " more"), (None, b), (None, c), (None, c), (None, ""), (None, None), (None, " \n"), (5, a + " too"), (5, d), (5, ""), (7, d + " more"), (7, e), (8, f), (8, f), (9, g), (2, g + " near"), (9, " ")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(4)
    kept = jaccard.first_of_each(df)
    assert kept.columns == df.columns
    want = [(3, a), (None, b), (None, c), (None, ""), (None, None), (None, " \n"), (5, d), (5, ""), (7, e), (8, f), (2, g + " near"), (9, " ")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, want))
