import hashlib
import random
import zlib

import pytest

from siftwell.llm import rlz
from siftwell.llm.common import words_of


def brute(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = words_of(t)
        gone = set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone.update(range(s, s + 20))
            seen.add(k)
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(18, 70))] for _ in range(6)]
    rows = []
    for d in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            p = rng.choice(passages)
            lo = rng.randrange(len(p) // 2)
            body[at:at] = p[lo : rng.randrange(lo + 1, len(p) + 1)]
        if d % 10 == 3:
            body = ["x"] * rng.randrange(15, 60)
        if d % 10 == 7 and rows:
            body = rows[rng.randrange(len(rows))][1].split() + body[:5]
        rows.append((d, " ".join(body)))
    return rows


@pytest.mark.parametrize("chunk,block", [(1, 4096), (40, 2), (200_000, 4096), (200_000, 1)])
def test_equals_brute_force(spark, chunk, block):
    """Also with blocks that are split by window."""
    rows = corpus(chunk + block, 160)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = {r["doc_id"]: tuple(r)[1:] for r in rlz.digests(df, chunk, block).collect()}
    assert out == brute(rows)


def test_odd_rows(docs, none):
    out = rlz.digests(docs).collect()
    assert len(out) == docs.count()
    assert {r["n_words"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert [r["n_removed"] for r in out if r["doc_id"] == 52][0] >= 60
    clean = rlz.remove_duplicates(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert rlz.digests(none).count() == 0


def test_texts_of_one_id_whose_short_checksums_are_equal(spark):
    rng = random.Random(9)
    held, pair = {}, None
    shared = " ".join(f"s{i}" for i in range(40))
    while not pair:  # two texts of different length, both with the passage, whose crc32 are equal mod 2^16
        text = " ".join([*(f"u{rng.randrange(1 << 30)}" for _ in range(rng.choice((2, 90)))), shared])
        other = held.setdefault(zlib.crc32(text.encode()) & 0xFFFF, text)
        if len(other.split()) != len(text.split()):
            pair = [other, text]
    for doc in (None, 5):
        rows = [(doc, t) for t in [*pair, pair[0]]] + [(9, shared + " end")]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        kept = sorted(r["text"] for r in rlz.remove_duplicates(df).collect())
        cut = [t.removesuffix(" " + shared) for t in pair]
        # one of the two texts keeps the passage; equal rows count as one
        assert kept in (sorted([pair[0], cut[1], pair[0], "end"]), sorted([cut[0], pair[1], cut[0], "end"]))
        assert sorted(r["n_removed"] for r in rlz.digests(df).collect()) in ([0, 0, 40, 40], [0, 40, 40, 40])
