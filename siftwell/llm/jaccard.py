"""Exact n-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds the hashes of its distinct word n-grams. Sets are grouped by size band; in band b the
universe of hashes is cut into m_b equal segments. Two sets that reach the threshold differ in at most H
elements, so if the allocations of a probing set add up to H + 1, one of its allocated segments meets the other
set's: allocation 1 finds equal segments, allocation 2 also those one deletion apart, 0 skips. A set probes its own
band and those below that can hold a partner. Allocation goes by cost: segments with many elements are rare
and cheap, small ones dear, empty ones the dearest; the index holds every segment, and the one-deletion
neighbourhoods of the small ones among the first that allocation 2 can ask for. Candidates are checked exactly on the texts.

What is joined are classes of equal sets, not documents. Each class is first checked against one other class of
its entries, the one with which it shares most. Linked classes become components, and only entries that still hold
several components go on, in rounds: every component proposes one pair to another component of an entry, the
nearest by the histograms of the elements; proposals are checked, components merged, refused pairs remembered.
When few proposals are accepted, all pairs of classes between the components that are left are formed, and those
whose histograms allow the threshold are checked. No link between components is lost and no group is squared: a group of
near copies falls into one component after a few rounds, with about one checked pair for each class and round.

Skew: index entries are joined by chunk before they are sent and met as a stream; entries with over ``SPLIT`` members
are dealt anew to parts in every round, and to pairs of parts in the end, so that a task holds two parts at most.

Defined cases: a null or empty text has an empty set and is linked with nothing; with fewer words than n the
whole text is one n-gram; very long texts take n log n time; a null doc_id belongs to a component but never names
one (null if no member has an id); rows of one doc_id are separate documents; an empty table gives an empty
result; other columns, maps included, are kept by ``first_of_each`` and ignored by ``components``. Sets are told
apart by a 64-bit key, elements by 64-bit hashes, rows by a 64-bit tag of doc_id and text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.common import discard, hold, materialize, release, require, table, trim
from siftwell.llm.rlz import Prefixes, _signed, mixed, word_hashes
from siftwell.llm.rlz import _hashes as word_cache

N = 3
PERCENT = 90
#: Segments beyond those that the pigeonhole needs, and one more for each SPARE_OF, so that small ones can be skipped.
SPARE = 1
SPARE_OF = 32
#: One segment in RESERVE, the first ones, may be probed for one deletion, and holds neighbourhoods in the index.
RESERVE = 16
#: Segments up to this size have their one-deletion neighbourhoods in the index.
SMALL = 3
#: Histogram buckets of a set; the sum of their differences is a lower bound of the sets' difference.
BUCKETS = 256
#: Index entries joined in memory before they are sent.
CHUNK = 400_000
#: Texts checked against one copy of a first member.
FAN = 2048
#: Bits of the filter of wanted ids, which is broadcast; ids share bits, so it only ever lets too many through.
FILTER_BITS = 1 << 26
#: Members of an entry that are compared in one task; larger entries are dealt to parts.
SPLIT = 4096
#: Rows compared at once: of one side and of the other.
BLOCK = (32, 1024)
#: Rounds of proposals go on while this share of them is accepted.
ACCEPTED = 0.25
NO_ID = (1 << 63) - 1
DOC, ENTRY, MEMBER, PAIR = 0, 1, 2, 3
PROPOSED, ALIVE = 0, 1
ROWS = "kind tinyint, a long, b long, n int, tag long, histogram binary"


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes([w.decode("utf-8", "surrogatepass") for w in words])
    size = min(n, len(h))
    return np.unique(Prefixes(h).runs(np.arange(len(h) - size + 1), size) ^ np.uint64(size))


def most_apart(a: int, b: int, percent: int) -> int:
    """Elements in which two sets of these sizes may differ and still reach the threshold."""
    return (a + b) * (100 - percent) // (100 + percent)


class Bands:
    """Size bands: band b holds sizes lows[b] .. lows[b + 1] - 1."""

    def __init__(self, percent: int, spare: int):
        self.percent, self.spare, self.lows = percent, spare, [1]

    def of(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.lows.append(max(self.lows[-1] + 1, math.ceil(self.lows[-1] * 100 / self.percent)))
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def segments(self, b: int) -> int:
        high = self.lows[b + 1] - 1
        need = most_apart(high, high * 100 // self.percent, self.percent) + 1
        return need + self.spare * (1 + need // SPARE_OF)

    def probed(self, n: int) -> range:
        return range(self.of(max(1, -(-n * self.percent // 100))), self.of(n) + 1)


SALT = np.uint64(0xA0761D6478BD642F)


def _signature(b: int, segment, content: np.ndarray) -> np.ndarray:
    """content: sum of a segment's mixed elements; 0 for an empty one."""
    return mixed(content + np.asarray(segment, np.uint64) * SALT + np.uint64((b + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def entries(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set and whether it probes with them (else it is only found by them)."""
    n = len(s)
    own = bands.of(n)
    value = mixed(s ^ SALT)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    top = (s >> np.uint64(32)).astype(np.uint64)
    sig, probe = [], []

    def add(x: np.ndarray, p) -> None:
        sig.append(x)
        probe.append(np.broadcast_to(np.asarray(p, bool), x.shape))

    for b in bands.probed(n):
        m = bands.segments(b)
        edges = np.searchsorted((top * np.uint64(m)) >> np.uint64(32), np.arange(m + 1))
        content, sizes = sums[edges[1:]] - sums[edges[:-1]], np.diff(edges)
        whole = _signature(b, np.arange(m), content)
        need = most_apart(n, min(n, bands.lows[b + 1] - 1), bands.percent) + 1
        order = np.argsort(-sizes, kind="stable")
        full = order[sizes[order] > 0]
        one = full[:need]  # allocation 1, the cheapest first
        need -= len(one)
        reserve = 1 + m // RESERVE
        two = [i for i in one.tolist() if i < reserve and 2 <= sizes[i] < SMALL][:need] if need else []  # raised to 2
        need -= len(two)
        empty = np.flatnonzero(sizes == 0)[: max(0, need)]  # nothing cheaper is left
        if b == own:
            probes = np.ones(m, bool)
            probes[sizes == 0] = False
            probes[empty] = True
            add(whole, probes)
            for i in np.flatnonzero((sizes[:reserve] > 0) & (sizes[:reserve] <= SMALL)).tolist():
                add(_signature(b, i, content[i] - value[edges[i] : edges[i + 1]]), i in two)
        else:
            add(whole[one], True)
            add(whole[empty], True)
            for i in two:
                add(_signature(b, i, content[i] - value[edges[i] : edges[i + 1]]), True)
    return np.concatenate(sig), np.concatenate(probe)


def histogram(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def set_key(s: np.ndarray) -> int:
    """Signed 64-bit key of a non-empty set."""
    return int(_signed(mixed(mixed(s).sum(keepdims=True) + np.uint64(len(s))))[0])


class _Index:
    """Pass 1: a DOC row for each document; entries of each class, joined by chunk. Columns: doc_id, text, tag."""

    def __init__(self, n: int, percent: int, spare: int, chunk: int):
        self.n, self.percent, self.spare, self.chunk = n, percent, spare, chunk

    def __call__(self, batches):
        hold("hashes", word_cache.clear)
        bands = Bands(self.percent, self.spare)
        seen, sigs, keys, probes, count = set(), [], [], [], 0
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc, text, tag in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(text, self.n)
                if not len(s):
                    continue
                k = set_key(s)
                for column, x in zip(rows, (NO_ID if doc is None else doc, k, len(s), tag, None if k in seen else histogram(s))):
                    column.append(x)
                if k in seen:
                    continue
                seen.add(k)
                sig, probe = entries(s, bands)
                sigs.append(_signed(sig))
                keys.append(np.full(len(sig), k))
                probes.append(probe)
                count += len(sig)
            yield self.batch(np.full(len(rows[0]), DOC, np.int8), *rows)
            if count >= self.chunk:
                yield from self.flush(sigs, keys, probes)
                seen, sigs, keys, probes, count = set(), [], [], [], 0
        if count:
            yield from self.flush(sigs, keys, probes)
            del sigs, keys, probes
        word_cache.clear()
        trim()

    @staticmethod
    def batch(kind, a, b, n, tags=None, histograms=None):
        import pyarrow as pa

        t = pa.array(tags, pa.int64()) if tags is not None else pa.nulls(len(a), pa.int64())
        h = pa.array(histograms, pa.binary()) if histograms is not None else pa.nulls(len(a), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), t, h], names=["kind", "a", "b", "n", "tag", "histogram"])

    def flush(self, sigs, keys, probes):
        sig, key, probe = np.concatenate(sigs), np.concatenate(keys), np.concatenate(probes)
        order = np.lexsort((key, sig))
        sig, key, probe = sig[order], key[order], probe[order]
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        starts = np.flatnonzero(new)
        lead = np.repeat(starts, np.diff(np.append(starts, len(sig))))
        asks = np.bitwise_or.reduceat(probe, starts).astype(np.int32)
        out = [(ENTRY, sig[starts], key[starts], asks)]
        other = key != key[lead]
        if other.any():
            with_first = np.repeat(np.maximum.reduceat(other, starts), np.diff(np.append(starts, len(sig))))
            out.append((MEMBER, sig[with_first], key[with_first], asks[np.cumsum(new) - 1][with_first]))
            pairs, times = np.unique(np.stack([key[lead][other], key[other]], 1)[asks[np.cumsum(new) - 1][other] > 0], axis=0, return_counts=True)
            out.append((PAIR, pairs[:, 0], pairs[:, 1], times.astype(np.int32)))
        for kind, a, b, n in out:
            for lo in range(0, len(a), 50_000):
                part = slice(lo, lo + 50_000)
                yield self.batch(np.full(len(a[part]), kind, np.int8), a[part], b[part], n[part])


class _Meet:
    """Rows of ROWS sorted by (a, n falling) within a task: of the entries that several classes share and one probes with,
    the rows stay, with the entry's first class in ``first``; rows of other kinds pass through. An entry of any size is a
    stream: what is held is its first row."""

    def __call__(self, batches):
        import pyarrow as pa

        at, first, asked, sent = None, 0, False, False
        for b in batches:
            kind = b.column(0).to_numpy()
            if (other := np.flatnonzero(kind != ENTRY)).size:
                rest = b.take(pa.array(other))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.nulls(rest.num_rows, pa.int64())], names=[*rest.schema.names, "first"])
            own = kind == ENTRY
            if not own.any():
                continue
            a, k, n = (b.column(i).to_numpy()[own] for i in (1, 2, 3))
            new = np.concatenate([[at is None or a[0] != at], a[1:] != a[:-1]])
            starts = np.flatnonzero(new)
            group = np.cumsum(new)  # 0: the entry that the last batch ended with
            firsts = np.concatenate([[first], k[starts]])
            asks = np.concatenate([[asked], n[starts] > 0])
            others = (k != firsts[group]) & asks[group]
            shared = np.bincount(group[others], minlength=len(firsts)) > 0
            leads = starts[shared[1:]]
            out = [(a[leads], k[leads], k[leads]), (a[others], k[others], firsts[group[others]])]
            if shared[0] and not sent:
                out.append(tuple(np.array([x], np.int64) for x in (at, first, first)))
            sent = bool(shared[-1]) or (sent and len(starts) == 0)
            at, first, asked = a[-1], firsts[-1], bool(asks[-1])
            a, k, f = (np.concatenate(x) for x in zip(*out))
            if m := len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, ENTRY, np.int8)), pa.array(a), pa.array(k), pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(f)], names=["kind", "a", "b", "n", "tag", "histogram", "first"])


class _Sieve:
    """Drops pairs whose sizes and histograms rule out the threshold. Columns: k1, k2, n1, n2, h1, h2."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches):
        for b in batches:
            if b.num_rows:
                n1, n2 = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
                h1, h2 = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for i in (4, 5))
                near = np.abs(h1 - h2).sum(1, dtype=np.int64) <= (n1 + n2) * (100 - self.percent) // (100 + self.percent)
                import pyarrow as pa

                yield b.select([0, 1]).filter(pa.array(near))


class _Check:
    """Exact check. Rows sorted by (first, part, not lead): k of the first, part, lead, k, text."""

    def __init__(self, n: int, percent: int):
        self.n, self.percent = n, percent

    def __call__(self, batches):
        import pyarrow as pa

        hold("hashes", word_cache.clear)
        at, held = None, None
        for b in batches:
            k1, k2 = [], []
            for first, part, lead, k, text in zip(*(c.to_pylist() for c in b.columns)):
                s = shingles(text, self.n)
                if not len(s) or set_key(s) != k:  # another row of the same doc_id
                    continue
                if lead:
                    at, held = (first, part), s
                elif at == (first, part):
                    both = np.intersect1d(held, s, assume_unique=True).size
                    if 100 * both >= self.percent * (len(held) + len(s) - both):
                        k1.append(first)
                        k2.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], names=["k1", "k2"])
        word_cache.clear()
        trim()


class _Propose:
    """Pairs between components inside a group of an entry's members that their histograms allow.

    Rows sorted by group: group, side, comp, k, n, histogram, refused (keys it was checked against in vain). Rows of
    different sides are compared, and rows of side 0 among themselves. ``every``: all pairs are PROPOSED (k1, k2);
    else for each component the nearest, and the classes that have a pair at all are ALIVE.
    """

    def __init__(self, percent: int, every: bool):
        self.percent, self.every = percent, every

    def __call__(self, batches):
        key, rows = None, []
        self.best: dict[int, tuple[int, int, int]] = {}
        self.alive: set[int] = set()
        for b in batches:
            if not b.num_rows:
                continue
            group, side, comp, k, n = (b.column(i).to_numpy() for i in range(5))
            h = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(-1, BUCKETS)
            refused = b.column(6).to_pylist()
            cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(group)]):
                if group[lo] != key:
                    if rows:
                        yield from self.pairs(rows)
                    key, rows = group[lo], []
                rows.append((side[lo:hi], comp[lo:hi], k[lo:hi], n[lo:hi].astype(np.int64), h[lo:hi], refused[lo:hi]))
            if len(self.best) + len(self.alive) > 200_000:
                yield from self.flush()
        if rows:
            yield from self.pairs(rows)
        yield from self.flush()

    def pairs(self, rows):
        side, comp, k, n, h = (np.concatenate(c) for c in list(zip(*rows))[:5])
        refused = [x for r in rows for x in r[5]]
        comps, inverse, times = np.unique(comp, return_inverse=True, return_counts=True)
        if len(comps) < 2:
            return
        order = np.argsort(n, kind="stable")
        side, comp, k, n, h = side[order], comp[order], k[order], n[order], h[order].astype(np.int16)
        small = np.flatnonzero(inverse[order] != times.argmax())  # the largest component is only compared with the others
        for at in range(0, len(small), BLOCK[0]):
            x = small[at : at + BLOCK[0]]
            low = int(np.searchsorted(n, -(-n[x[0]] * self.percent // 100)))
            high = int(np.searchsorted(n, n[x[-1]] * 100 // self.percent, side="right"))
            for start in range(low, high, BLOCK[1]):
                y = slice(start, min(start + BLOCK[1], high))
                total = n[x][:, None] + n[y]
                ok = (comp[x][:, None] != comp[y]) & ((side[x][:, None] != side[y]) | (side[y] == 0))
                if not ok.any():
                    continue
                apart = np.abs(h[x][:, None] - h[y]).sum(2, dtype=np.int32)
                ok &= apart <= total * (100 - self.percent) // (100 + self.percent)
                for i, r in enumerate(x.tolist()):
                    if ok[i].any():
                        if refused[order[r]]:
                            ok[i] &= ~np.isin(k[y], refused[order[r]])
                        for j in np.flatnonzero(ok[i]).tolist():
                            if refused[order[start + j]] and int(k[r]) in refused[order[start + j]]:
                                ok[i, j] = False
                if self.every:
                    i, j = np.nonzero(ok)
                    if len(i):
                        yield self.batch(PROPOSED, k[x][i], k[y][j], k[x][i], apart[i, j])
                    continue
                self.alive.update(k[x][ok.any(1)].tolist())
                self.alive.update(k[y][ok.any(0)].tolist())
                nearest = np.where(ok, apart, 1 << 30).argmin(1)
                for i in np.flatnonzero(ok.any(1)).tolist():
                    j = int(nearest[i])
                    found = (int(apart[i, j]), int(k[x[i]]), int(k[start + j]))
                    c = int(comp[x[i]])
                    if c not in self.best or found < self.best[c]:
                        self.best[c] = found

    def flush(self):
        if self.best:
            comps, found = zip(*self.best.items())
            d, k1, k2 = zip(*found)
            yield self.batch(PROPOSED, np.array(k1), np.array(k2), np.array(comps), np.array(d))
        if self.alive:
            k = np.fromiter(self.alive, np.int64, len(self.alive))
            yield self.batch(ALIVE, k, k, k, np.zeros(len(k)))
        self.best, self.alive = {}, set()

    @staticmethod
    def batch(kind, k1, k2, comp, apart):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k1), kind, np.int8)), *(pa.array(x, pa.int64()) for x in (k1, k2, comp)), pa.array(apart.astype(np.int32))], names=["kind", "k1", "k2", "comp", "apart"])


PROPOSALS = "kind tinyint, k1 long, k2 long, comp long, apart int"


def connected(links: DataFrame, start: DataFrame) -> DataFrame:
    """(k, comp) for every k of start (k, comp): least label reachable over links (k1, k2), by hooking and jumping."""
    both = materialize(links.select("k1", "k2").unionByName(links.select(F.col("k2").alias("k1"), F.col("k1").alias("k2"))).where("k1 != k2").distinct(), "join-links")
    labels = start
    while True:
        near = both.join(labels.select(F.col("k").alias("k2"), "comp"), "k2").groupBy("k1").agg(F.min("comp").alias("near"))
        hooked = labels.join(near, F.col("k") == F.col("k1"), "left").select("k", "comp", F.least("comp", "near").alias("new"))
        # a label that lost takes its winner's: all that bear it follow in one step
        moved = hooked.where("new < comp").groupBy(F.col("comp").alias("old")).agg(F.min("new").alias("to"))
        moved = materialize(moved, "join-moved")
        if moved.isEmpty():
            return labels
        for _ in range(3):  # jump along chains of moved labels
            moved = moved.alias("m").join(moved.select(F.col("old").alias("o"), F.col("to").alias("t")).alias("s"), F.col("m.to") == F.col("s.o"), "left").select("m.old", F.coalesce("s.t", "m.to").alias("to"))
        labels = materialize(labels.join(moved, F.col("comp") == F.col("old"), "left").select("k", F.coalesce("to", "comp").alias("comp")), "join-labels")


def in_some(keys: DataFrame) -> Callable[[Column], Column]:
    """Test whether a 64-bit value may be among the values of ``keys`` (one column): a filter of bounded size, broadcast."""
    wide = 1 << 15
    spot = F.pmod(F.xxhash64(keys.columns[0]), F.lit(FILTER_BITS))
    found = keys.select(spot.alias("p")).groupBy((F.col("p") / wide).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.col("p") % wide).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in found:  # at most FILTER_BITS / 2^15 rows of 4 KB
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[r["b"] * wide // 8 : r["b"] * wide // 8 + len(part)] = part
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def held(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)

    return lambda value: held(F.pmod(F.xxhash64(value), F.lit(FILTER_BITS)))


def tag() -> Column:
    return F.xxhash64("doc_id", "text")


def sieved(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (k1, k2) of classes whose sizes and histograms allow the threshold."""
    c1 = classes.select(F.col("k").alias("k1"), F.col("n").alias("n1"), F.col("histogram").alias("h1"))
    c2 = classes.select(F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("histogram").alias("h2"))
    wide = pairs.join(c1, "k1").join(c2, "k2").where(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent)
    return wide.select("k1", "k2", "n1", "n2", "h1", "h2").mapInArrow(_Sieve(percent), "k1 long, k2 long")


def checked(texts: DataFrame, classes: DataFrame, near: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (k1, k2) of classes whose sets reach the threshold, written; texts: (tag, text), k1 may stand in many pairs."""
    fans = near.groupBy("k1").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"))
    ids = classes.select("k", "tag")
    others = near.join(fans.where("fan > 1"), "k1", "left").select(F.col("k1").alias("first"), F.pmod(F.xxhash64("k2"), F.coalesce("fan", F.lit(1)).cast("long")).cast("int").alias("part"), F.lit(False).alias("lead"), F.col("k2").alias("k"))
    leads = fans.select(F.col("k1").alias("first"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"), F.lit(True).alias("lead"), F.col("k1").alias("k"))
    wanted = materialize(others.unionByName(leads).join(ids, "k"), "join-wanted")
    own = texts.where(in_some(wanted.select("tag"))(F.col("tag"))).dropDuplicates(["tag"])
    rows = own.join(wanted, "tag").select("first", "part", "lead", "k", "text").repartition("first", "part").sortWithinPartitions("first", "part", F.desc("lead"))
    links = materialize(rows.mapInArrow(_Check(n, percent), "k1 long, k2 long").distinct(), "join-links")
    discard(wanted)
    return links


def merged(links: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old, new) of the components that links (k1, k2) between classes merge, and labels (k, comp) with them merged."""
    c1, c2 = (labels.select(F.col("k").alias(k), F.col("comp").alias(c)) for k, c in (("k1", "c1"), ("k2", "c2")))
    edges = materialize(links.join(c1, "k1").join(c2, "k2").where("c1 != c2").select(F.col("c1").alias("k1"), F.col("c2").alias("k2")).distinct(), "join-edges")
    ends = edges.select(F.explode(F.array("k1", "k2")).alias("k")).distinct()
    moved = connected(edges, materialize(ends.select("k", F.col("k").alias("comp")), "join-ends")).select(F.col("k").alias("old"), F.col("comp").alias("new"))
    after = materialize(labels.join(moved, F.col("comp") == F.col("old"), "left").select("k", F.coalesce("new", "comp").alias("comp")), "join-labelled")
    discard(labels, edges)
    return moved, after


def still_open(rest: DataFrame, name: str) -> DataFrame:
    """The rows of entries that hold several components; parts: how many parts an entry is dealt to."""
    open_ = rest.groupBy("a").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.ceil(F.count("*") / SPLIT).cast("int").alias("parts")).where("c0 != c1")
    return materialize(rest.drop("parts").join(open_.select("a", "parts"), "a"), name)


def proposals(rest: DataFrame, refused: DataFrame | None, percent: int, turn: int, every: bool) -> DataFrame:
    part = F.pmod(F.xxhash64("k", F.lit(turn)), F.col("parts").cast("long")).cast("int")
    if every:  # pairs of parts, each once; in a pair of one part with itself all are side 0
        rows = rest.withColumn("p", part).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumn("side", F.when(F.col("p") == F.col("q"), 0).when(F.col("p") < F.col("q"), 1).otherwise(2))
        rows = rows.withColumn("group", F.xxhash64("a", F.least("p", "q"), F.greatest("p", "q")))
    else:
        rows = rest.withColumn("side", F.lit(0)).withColumn("group", F.xxhash64("a", part))
    if refused is not None:
        rows = rows.join(refused.groupBy(F.col("k2").alias("k")).agg(F.collect_set("k1").alias("refused")), "k", "left")
    else:
        rows = rows.withColumn("refused", F.lit(None).cast("array<long>"))
    rows = rows.select("group", "side", "comp", "k", "n", "histogram", "refused").repartition("group").sortWithinPartitions("group")
    return materialize(rows.mapInArrow(_Propose(percent, every), PROPOSALS), "join-proposed")


def between(texts: DataFrame, classes: DataFrame, members: DataFrame, labels: DataFrame, n: int, percent: int) -> DataFrame:
    """labels with all links between the components that entries still hold; members: (a, k, asked)."""
    known = members.join(labels, "k")
    open_ = known.groupBy("a").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("asked").alias("asked")).where("c0 != c1 and asked > 0").select("a")
    rest = known.drop("asked").join(open_, "a", "left_semi").join(classes.select("k", "n", "histogram"), "k")
    rest = still_open(rest.withColumn("parts", F.lit(1)), "join-open")
    refused, turn = None, 0
    while True:
        if rest.isEmpty():
            return labels
        found = proposals(rest, refused, percent, turn, False)
        if turn == 0:  # classes without any possible pair take no part from here on; those of dealt entries stay
            alive = found.where(F.col("kind") == ALIVE).select(F.col("k1").alias("k")).unionByName(rest.where("parts > 1").select("k")).distinct()
            alive = materialize(alive, "join-alive")
            before, rest = rest, still_open(rest.join(alive, "k", "left_semi"), "join-open")
            discard(before)
            own = classes.join(alive, "k", "left_semi").select("tag")
            texts = materialize(texts.where(in_some(own)(F.col("tag"))).dropDuplicates(["tag"]), "join-texts")
        best = found.where(F.col("kind") == PROPOSED).groupBy("comp").agg(F.min(F.struct("apart", "k1", "k2")).alias("m"))
        pairs = materialize(best.select(F.col("m.k2").alias("k1"), F.col("m.k1").alias("k2")).distinct(), "join-asked")
        links = checked(texts, classes, pairs, n, percent)
        asked, good = pairs.count(), links.count()
        if good:
            moved, labels = merged(links, labels)
            before, rest = rest, still_open(rest.join(moved, F.col("comp") == F.col("old"), "left").withColumn("comp", F.coalesce("new", "comp")).drop("old", "new"), "join-open")
            discard(before)
        bad = pairs.join(links, ["k1", "k2"], "left_anti")
        refused = bad if refused is None else materialize(refused.unionByName(bad), "join-refused")
        turn += 1
        if good <= ACCEPTED * asked:
            break
    last = proposals(rest, refused, percent, turn, True).select(F.greatest("k1", "k2").alias("k1"), F.least("k1", "k2").alias("k2")).distinct()
    links = checked(texts, classes, materialize(last, "join-asked"), n, percent)
    labels = labels if links.isEmpty() else merged(links, labels)[1]
    discard(rest, texts)
    return labels


def components(docs: DataFrame, n: int = N, percent: int = PERCENT, spare: int = SPARE, chunk: int = CHUNK) -> DataFrame:
    """(doc, k, n, component): a row for each document with a set; doc is NO_ID for a null doc_id."""
    return labelled(docs, n, percent, spare, chunk).select("doc", "k", "n", "component")


def labelled(docs: DataFrame, n: int = N, percent: int = PERCENT, spare: int = SPARE, chunk: int = CHUNK) -> DataFrame:
    """components() with ``tag`` and with ``comp``, which tells components apart where ``component``, a doc_id, does not."""
    require(docs, "doc_id", "text")
    if not 1 <= percent <= 100 or n < 1 or spare < 0:
        raise ValueError("percent is 1 to 100, n 1 or more, spare 0 or more")
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", tag().alias("tag")).mapInArrow(_Index(n, percent, spare, chunk), ROWS)
    # entries meet in one shuffle and are not written; what is written is what several classes share
    dealt = F.when(F.col("kind") == ENTRY, F.col("a")).otherwise(F.xxhash64("a", "b"))
    parsed = materialize(rows.repartition(dealt).sortWithinPartitions("kind", "a", F.desc("n")).mapInArrow(_Meet(), ROWS + ", first long"), "join-index")
    release(spark)
    own = parsed.where(F.col("kind") == DOC)
    named = own.groupBy(F.col("b").alias("k")).agg(F.min(F.struct("a", "tag")).alias("m"), F.max("n").alias("n"), F.max("histogram").alias("histogram"))
    classes = materialize(named.select("k", F.col("m.a").alias("doc"), "m.tag", "n", "histogram"), "join-classes")
    # first round: each class is checked against the one with which it shares most entries
    shared = parsed.where((F.col("kind") == ENTRY) & (F.col("b") != F.col("first"))).select(F.col("first").alias("k1"), F.col("b").alias("k2"), F.lit(1).alias("n"))
    shared = shared.unionByName(parsed.where(F.col("kind") == PAIR).select(F.col("a").alias("k1"), F.col("b").alias("k2"), "n"))
    shared = shared.groupBy("k1", "k2").agg(F.sum("n").alias("n")).groupBy("k2").agg(F.max(F.struct("n", "k1")).alias("m"))
    pairs = sieved(classes, shared.select("m.k1", "k2"), percent)
    texts = docs.select(tag().alias("tag"), "text")
    pairs = materialize(pairs, "join-pairs")
    links = checked(texts, classes, pairs, n, percent)
    members = parsed.where(F.col("kind").isin(ENTRY, MEMBER)).groupBy("a", F.col("b").alias("k")).agg(F.max("n").alias("asked"))
    members = materialize(members, "join-members")
    own = materialize(own.select(F.col("a").alias("doc"), F.col("b").alias("k"), "n", "tag"), "join-rows")
    discard(parsed, pairs)
    release(spark)
    labels = members.select("k", F.col("k").alias("comp")).distinct()
    _, labels = merged(links, materialize(labels, "join-first"))
    labels = between(texts, classes, members, labels, n, percent)
    every = materialize(classes.select("k", "doc").join(labels, "k", "left").withColumn("comp", F.coalesce("comp", "k")), "join-named")
    discard(classes, members, labels)
    release(spark)
    names = every.join(every.groupBy("comp").agg(F.min("doc").alias("component")), "comp").select("k", "comp", "component")
    return own.join(names, "k").select("doc", "k", "n", "tag", "comp", "component")


def wordless() -> Column:
    """Whether a text has no words, and so no set."""
    return F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, one of the least doc_id (then of the least set key, tag and row); all columns stay.

    Rows are told apart by doc_id and text, so null and repeated doc_ids lose nothing but near copies.
    Documents without words are linked with nothing and stay.
    """
    require(docs, "doc_id", "text")
    places = labelled(docs, n, percent).groupBy("tag").agg(F.count("*").alias("rows"), F.min(F.struct("comp", "doc", "k")).alias("m"))
    places = materialize(places.select("tag", "rows", F.col("m.comp").alias("comp"), F.struct("m.doc", "m.k", "tag").alias("place")), "join-places")
    firsts = places.groupBy("comp").agg(F.min("place").alias("f"))
    gone = places.join(firsts, "comp").where("place != f or rows > 1").select("tag", (F.col("place") == F.col("f")).alias("first"))
    gone = materialize(gone, "join-gone")
    suspect = in_some(gone.select("tag"))
    marked = docs.select(F.struct("*").alias("row"), tag().alias("tag"), wordless().alias("bare"))
    marked = marked.withColumn("suspect", ~F.col("bare") & suspect(F.col("tag")))
    clear = marked.where(~F.col("suspect")).select("row.*")
    # only rows that may be in ``gone`` are moved
    asked = marked.where("suspect").join(gone, "tag", "left")
    single = asked.where(F.col("first").isNull()).select("row.*")
    several = asked.where("first").groupBy("tag").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return clear.unionByName(single).unionByName(several)


def op7_jaccard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = components(docs)
    # documents without words: a set of size 0, alone
    empty = docs.where(wordless())
    alone = empty.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(known("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), known("component").alias("component_id")).unionByName(alone)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh),
p AS (SELECT a.doc_id AS d1, b.doc_id AS d2, count(*) AS both_, any_value(a.n) AS n1, any_value(b.n) AS n2 FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT d1, d2 FROM p WHERE 100 * both_ >= 90 * (n1 + n2 - both_)),
l AS (SELECT d1, d2 FROM e UNION ALL SELECT d2, d1 FROM e),
r AS (SELECT DISTINCT d1 AS id, d1 AS m FROM l UNION SELECT l.d2, r.m FROM r JOIN l ON l.d1 = r.id)
SELECT sh.doc_id, len(s)::BIGINT AS n_shingles, coalesce(m, sh.doc_id) AS component_id FROM sh LEFT JOIN (SELECT id, min(m) AS m FROM r GROUP BY id) c ON c.id = sh.doc_id
"""
