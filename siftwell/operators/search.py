"""Exact top-k search of rows against a block of queries, in one pass and without a shuffle of the pairs.

A task scores each Arrow batch against all queries of the block as one matrix, and keeps of every query the k best
that it has seen: what leaves it are at most k rows for each query, and the best of these are the best of all. Built-in
functions can't say this: they make one row of each pair first, which is rows times queries on disk.

Nothing is cut off before it is scored. Order: greater score, then smaller group; of a group its best row counts, of
rows of equal score that of the smaller id. Ids that are null come first, as in Spark's ascending order.
"""

from __future__ import annotations

import numpy as np

#: Numbers of a matrix of queries (terms x queries, or queries x dimensions) taken in one pass; more take several.
ENTRIES = 4 << 20
#: Scores held at once in a task.
SCORES = 2 << 20
#: Not a candidate at all; a candidate without a score, which comes last.
NONE, NULL = -np.inf, -np.finfo("float64").max


def postings(tokens, vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, term, tf of an Arrow list array of tokens, by row and term; terms are places in ``vocabulary``."""
    import pyarrow.compute as pc

    n = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
    at = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1)).astype("int64")
    key = (np.repeat(np.arange(len(n), dtype="int64"), n) * len(vocabulary) + at)[at >= 0]
    key, tf = np.unique(key, return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), tf


def key(x):
    return (0, 0) if x is None else (1, x)


class Top:
    """Arrow batches (group, id, *others) to rows (case_id, group, id, score) of the k best groups of each query.

    ``scorer(batch)`` gives scores (rows x queries), ``NONE`` for pairs that don't count. Without k all pairs are given.
    """

    def __init__(self, scorer, cases: list, k: int | None, types):
        self.scorer, self.cases, self.k, self.types = scorer, cases, k, types

    def batch(self, rows):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, self.types)], schema=self.types)

    def __call__(self, batches):
        best: list[list] = [[] for _ in self.cases]
        floor = np.full(len(self.cases), NULL)
        step = max(1, SCORES // max(1, len(self.cases)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                s = self.scorer(b)
                if self.k is None:
                    r, q = np.nonzero(s > NONE)
                    group, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
                    yield self.batch(([self.cases[i] for i in q], [group[i] for i in r], [ids[i] for i in r], [None if x == NULL else x for x in s[r, q].tolist()]))
                else:
                    self.merge(b, s, best, floor)
        if self.k is not None and any(best):
            rows = [(self.cases[q], g[1] if g[0] else None, i[1] if i[0] else None, None if s == -NULL else float("nan") if s == -np.inf else -s) for q, found in enumerate(best) for s, g, i in found]
            yield self.batch(zip(*rows))

    def merge(self, b, s, best, floor) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        order = np.asarray(pc.sort_indices(pa.table({"g": b.column(0), "i": b.column(1)}), sort_keys=[("g", "ascending"), ("i", "ascending")], null_placement="at_start"))
        code = np.asarray(pc.dictionary_encode(b.column(0), null_encoding="encode").indices)[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        ends = np.r_[starts[1:], len(code)]
        s = s[order]
        m = s if len(starts) == len(s) else np.maximum.reduceat(s, starts, axis=0)
        fits = (m >= floor) & (m > NONE)
        if len(m) > self.k and fits.sum() > 4 * self.k * len(floor):
            fits &= m >= np.partition(m, len(m) - self.k, axis=0)[len(m) - self.k]
        g, q = np.nonzero(fits)
        by = np.lexsort((g, -m[g, q], q))
        g, q = g[by], q[by]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, "int64")
        kept = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < self.k
        new: dict[int, list] = {}
        for i, j in zip(g[kept].tolist(), q[kept].tolist()):
            row = starts[i] + int(np.argmax(s[starts[i] : ends[i], j]))
            at = int(order[row])
            new.setdefault(j, []).append((-float(s[row, j]), key(b.column(0)[at].as_py()), key(b.column(1)[at].as_py())))
        for j, found in new.items():
            one: dict = {}
            for x in sorted(best[j] + found):
                one.setdefault(x[1], x)
                if len(one) == self.k:
                    break
            best[j] = list(one.values())
            if len(one) == self.k:
                floor[j] = -best[j][-1][0]
