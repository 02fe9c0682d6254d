"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

The reference is the whole corpus, cut into blocks that are keyed by anchors: of the ``GRAM``-word grams in a
``WINDOW``-word window, the one with the least hash is its anchor. The windows in a row that share an anchor form a
segment, about seven windows long, so equal passages are cut alike wherever they stand, and every window that a segment
shares with any other text stands in the segment's own block: a document need not be parsed against the other blocks.

A segment that its block already holds as a whole is one factor, copied from its first occurrence. The other segments of a
block are parsed greedily in order of their places: the block's index gives the first occurrence of the window at the
current word, the match is extended word by word as far as both go on alike, and the factor of at least ``WINDOW`` words
becomes a duplicate span. Parsing goes on with the first window that crosses the factor's boundary, so every window there
is checked; a window that the index lacks is added to it. The first occurrence stays, every other is a duplicate span.

Exactness: a window's least gram depends on its words alone, so equal windows always meet in one block. First
means least (doc_id, start). Words are compared by 64-bit hashes.

Skew: each map task joins what it holds in chunks of ``CHUNK`` segments before anything is shuffled, and sends
one row for each different segment; a passage that a third of all documents share arrives as one row for each chunk,
not for each document. Blocks of more than ``BLOCK`` different segments (a common phrase in ever other surroundings) are
split by window: their windows are dealt out by hash and the first of each is found there.

Defined cases: a null text has no words; texts of under WINDOW words lose none; a null doc_id comes first;
rows of one doc_id are separate documents in the order of a 64-bit hash of the text, and equal rows count as one, so
that no row is a copy of itself; an empty table gives an empty result; other columns are kept by
``remove_duplicates`` and ignored by ``digests``.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.common import discard, materialize, require, table, words_of

WINDOW = 20
GRAM = 8
#: Segments joined in memory before they are sent.
CHUNK = 200_000
#: Different segments of a block that one task parses; larger blocks are split by window.
BLOCK = 4096
#: Word hashes that a worker keeps.
CACHE = 200_000

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
NO_ID = -(1 << 63)
MARK, FACTOR, PIECE = 0, 1, 2
ROWS = "kind tinyint, a long, b long, doc long, tie long, at long, n int"


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (BASE, back))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(12, (n + 1).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Hashes of any run of a text's words."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = powers(len(hashes))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])

    def runs(self, start: np.ndarray, size) -> np.ndarray:
        return mixed((self.sums[start + size] - self.sums[start]) * self.down[start])


def segments(p: Prefixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, content hash, first and last window of each segment of a text with at least one window."""
    n = len(p.sums) - 1
    grams = p.runs(np.arange(n - GRAM + 1), GRAM)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
    anchor = np.arange(n - WINDOW + 1) + windows.argmin(axis=1)
    cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [n - WINDOW]])
    return grams[anchor[first]], p.runs(first, last - first + WINDOW), first, last


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


class _Out:
    """Rows of ROWS, gathered as arrays."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, kind, a, b, doc, tie, at, n):
        if len(doc):
            self.parts.append((np.full(len(doc), kind, np.int8), a, b, doc, tie, at, np.broadcast_to(np.asarray(n, np.int32), (len(doc),))))

    def mark(self, doc, tie, at, n):
        """Words that go: of a mark only the place is read."""
        none = np.zeros(len(doc), np.int64)
        self.add(MARK, none, none, doc, tie, at, n)

    def batches(self):
        import pyarrow as pa

        if self.parts:
            cols = [np.concatenate(c) for c in zip(*self.parts)]
            self.parts = []
            for lo in range(0, len(cols[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000]) for c in cols], names=["kind", "a", "b", "doc", "tie", "at", "n"])


def _firsts(a, b, doc, tie, at):
    """Order of rows by (a, b, doc, tie, at); in it: starts of groups (a, b), and rows that repeat a group's first place."""
    order = np.lexsort((at, tie, doc, b, a))
    a, b, doc, tie, at = a[order], b[order], doc[order], tie[order], at[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, new, (doc == doc[lead]) & (tie == tie[lead]) & (at == at[lead])


def _windows(out: _Out, a, whash, doc, tie, at) -> None:
    """Windows held here: losers are marked, the first of each is sent on."""
    order, new, same = _firsts(a, whash, doc, tie, at)
    first = order[new]
    out.add(PIECE, a[first], whash[first], doc[first], tie[first], at[first], WINDOW)
    lost = order[~same]
    out.mark(doc[lost], tie[lost], at[lost], WINDOW)


class _Parse:
    """Pass 1: segments of every text; joined by chunk. Copies are marked, the first of each is sent on."""

    def __init__(self, chunk: int):
        self.chunk = chunk

    def __call__(self, batches):
        held, count, out = [], 0, _Out()
        for b in batches:
            for doc, tie, text in zip(*(c.to_pylist() for c in b.columns)):
                words = words_of(text)
                if len(words) < WINDOW:
                    continue
                anchor, content, first, last = segments(Prefixes(word_hashes(words)))
                held.append((anchor, content, np.full(len(anchor), doc), np.full(len(anchor), tie), first, last - first))
                count += len(anchor)
                if count >= self.chunk:
                    self.flush(held, out)
                    held, count = [], 0
                    yield from out.batches()
        if held:
            self.flush(held, out)
            yield from out.batches()
        _hashes.clear()

    @staticmethod
    def flush(held, out: _Out) -> None:
        a, b, doc, tie, at, more = (np.concatenate(c) for c in zip(*held))
        a, b = _signed(a), _signed(b)
        order, new, same = _firsts(a, b, doc, tie, at)
        lost, first = order[~same], order[new]
        out.mark(doc[lost], tie[lost], at[lost], more[lost] + WINDOW)
        out.add(FACTOR, a[first], b[first], doc[first], tie[first], at[first], more[first])


class _Segments:
    """The words, as hashes, of the segments that were asked for."""

    def __call__(self, batches):
        import pyarrow as pa

        for b in batches:
            rows = ([], [], [], [], [])
            for doc, tie, text, asked in zip(*(c.to_pylist() for c in b.columns)):
                h = word_hashes(words_of(text))
                for x in asked:
                    for column, value in zip(rows, (x["a"], doc, tie, x["at"], h[x["at"] : x["at"] + x["n"] + WINDOW].tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:4]), pa.array(rows[4], pa.binary())], names=["a", "doc", "tie", "at", "words"])
        _hashes.clear()


class _Greedy:
    """Greedy parse of each block's segments, sorted by (a, doc, tie, at), against those before them in the block."""

    def __call__(self, batches):
        key, place, index, out = None, None, {}, _Out()
        for b in batches:
            if not b.num_rows:
                continue
            a, doc, tie, at = (b.column(i).to_numpy() for i in range(4))
            each = [np.frombuffer(x, np.uint64) for x in b.column(4).to_pylist()]
            sizes = np.array([len(x) for x in each])
            flat, ends = np.concatenate(each), np.cumsum(sizes)
            hashes = Prefixes(flat).runs(np.arange(len(flat) - WINDOW + 1), WINDOW).tolist()
            rows, places, lengths = [], [], []
            for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
                if a[i] != key:
                    key, place, index = a[i], None, {}
                if place == (place := (doc[i], tie[i], at[i])):  # an equal row
                    continue
                own, begin, p = each[i], end - size, 0
                while p <= size - WINDOW:
                    known = index.setdefault(hashes[begin + p], (own, p))
                    if known[0] is own and known[1] == p:  # new in this block
                        p += 1
                        continue
                    reference, r = known
                    most = min(size - p, len(reference) - r)
                    differ = np.flatnonzero(own[p : p + most] != reference[r : r + most])
                    length = int(differ[0]) if differ.size else most
                    if length < WINDOW:  # only the hashes are equal
                        p += 1
                        continue
                    rows.append(i)
                    places.append(p)
                    lengths.append(length)
                    p += length - WINDOW + 1  # the first window that crosses the factor's boundary
            if rows:
                out.mark(doc[rows], tie[rows], at[rows] + np.array(places), np.array(lengths))
                yield from out.batches()


class _Expand:
    """Windows of the segments of large blocks; joined by chunk."""

    def __init__(self, chunk: int):
        self.chunk = chunk

    def __call__(self, batches):
        out, held, count = _Out(), [], 0
        for b in batches:
            for a, doc, tie, at, words in zip(*(c.to_pylist() for c in b.columns)):
                h = np.frombuffer(words, np.uint64)
                n = len(h) - WINDOW + 1
                held.append((np.full(n, a), _signed(Prefixes(h).runs(np.arange(n), WINDOW)), np.full(n, doc), np.full(n, tie), at + np.arange(n)))
                count += n
            if count >= self.chunk:
                _windows(out, *(np.concatenate(c) for c in zip(*held)))
                held, count = [], 0
                yield from out.batches()
        if held:
            _windows(out, *(np.concatenate(c) for c in zip(*held)))
            yield from out.batches()


def _keyed(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tie"), *more)


def duplicate_spans(docs: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(doc, tie, spans): for each document with duplicates, the array of (start word, words) that go."""
    parsed = materialize(_keyed(docs, "text").mapInArrow(_Parse(chunk), ROWS), "rlz-segments")
    held = parsed.where(F.col("kind") == FACTOR).repartition("a")
    copy = F.rank().over(W.partitionBy("a", "b").orderBy("doc", "tie", "at"))
    whole = W.partitionBy("a")
    judged = held.withColumn("copy", copy).withColumn("several", F.min("b").over(whole) != F.max("b").over(whole))
    judged = judged.where((F.col("copy") > 1) | F.col("several"))
    judged = materialize(judged.select("a", "doc", "tie", "at", "n", "copy"), "rlz-judged")
    firsts = judged.where("copy = 1")
    ask = firsts.groupBy("doc", "tie").agg(F.collect_list(F.struct("a", "at", "n")).alias("asked"))
    asked = _keyed(docs, "text").join(ask, ["doc", "tie"]).select("doc", "tie", "text", "asked").mapInArrow(_Segments(), "a long, doc long, tie long, at long, words binary")
    asked = materialize(asked, "rlz-asked")
    large = materialize(firsts.groupBy("a").count().where(F.col("count") > block).select("a"), "rlz-large")
    small = asked.join(large, "a", "left_anti").repartition("a").sortWithinPartitions("a", "doc", "tie", "at")
    factors = small.select("a", "doc", "tie", "at", "words").mapInArrow(_Greedy(), ROWS)
    windows = materialize(asked.join(large, "a", "left_semi").select("a", "doc", "tie", "at", "words").mapInArrow(_Expand(chunk), ROWS), "rlz-windows")
    lost = windows.where(F.col("kind") == PIECE).withColumn("copy", F.rank().over(W.partitionBy("a", "b").orderBy("doc", "tie", "at"))).where("copy > 1")
    spans = judged.where("copy > 1").select("doc", "tie", "at", (F.col("n") + WINDOW).alias("n"))
    for more in (lost, factors, *(x.where(F.col("kind") == MARK) for x in (parsed, windows))):
        spans = spans.unionByName(more.select("doc", "tie", "at", "n"))
    place = F.struct(F.col("at").cast("int").alias("start"), F.col("n").cast("int").alias("words"))
    found = materialize(spans.groupBy("doc", "tie").agg(F.collect_set(place).alias("spans")), "rlz-spans")
    discard(parsed, judged, asked, large, windows)
    return found


def kept_words(text: str | None, spans) -> tuple[list[str], int]:
    """The words outside the spans, and how many there were."""
    words = words_of(text)
    if not spans:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        edge[s["start"]] += 1
        edge[s["start"] + s["words"]] -= 1
    stay = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, stay.tolist()) if k], len(words)


def _digest_batches(batches):
    import pyarrow as pa

    for b in batches:
        n_words, n_removed, sha = [], [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            kept, n = kept_words(text, spans)
            n_words.append(n)
            n_removed.append(n - len(kept))
            sha.append(hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _remove_batches(batches):
    import pyarrow as pa

    for b in batches:
        row, spans = b.column(0), b.column(1).to_pylist()
        fields = list(row.type)
        cols = [row.field(i) for i in range(len(fields))]
        at = [f.name for f in fields].index("text")
        texts = [t if not s else " ".join(kept_words(t, s)[0]) for t, s in zip(cols[at].to_pylist(), spans)]
        cols[at] = pa.array(texts, fields[at].type)
        yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])


def remove_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """docs with the words of duplicate spans taken out of ``text``; untouched texts stay as they are."""
    require(docs, "doc_id", "text")
    spans = duplicate_spans(docs, chunk)
    rows = _keyed(docs, F.struct("*").alias("row")).join(spans, ["doc", "tie"], "left")
    return rows.select("row", "spans").mapInArrow(_remove_batches, docs.schema)


def digests(docs: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    require(docs, "doc_id", "text")
    spans = duplicate_spans(docs, chunk, block)
    rows = _keyed(docs, "doc_id", "text").join(spans, ["doc", "tie"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_digest_batches, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op8_rlz(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS body FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
lost AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
c AS (SELECT t.doc_id, word, t.i, coalesce(max(l.i) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS UNBOUNDED PRECEDING) >= t.i - 19, false) AS gone FROM t LEFT JOIN lost l ON l.doc_id = t.doc_id AND l.i = t.i),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
