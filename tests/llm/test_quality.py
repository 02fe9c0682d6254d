import random
from collections import Counter

import numpy as np

from siftwell.llm import quality
from siftwell.llm.common import words_of


def brute(text):
    w = words_of(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_counts():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "b ", "c\n", " ", "\n", "\t", "#", "|", "é ", "\u00a0", "\x1c", "\x0b", "a b c ", "İ"]) for _ in range(rng.randrange(40)))
        assert quality.statistics(text)[:5] == brute(text), repr(text)
    assert quality.statistics(None) == (0,) * len(quality.COUNTS)


def test_learns_and_applies(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(500))
    rows, labels = [], []
    for i in range(300):
        junk = i % 5 == 0
        rows.append((i, " ".join(word() + ("###" if junk else "") for _ in range(80)), 1, "x"))
        labels.append((i, 0 if junk else 1))
    rows += [(400, None, 1, "x"), (None, " ".join(word() for _ in range(80)), 1, "x"), rows[0]]
    labels += [(1, 1), (None, 0), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, row string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.judge(docs, lab).collect()
    assert len(out) == len(rows)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] % 5 != 0) for r in out if r["doc_id"] != 400)
    assert [r["base_failed"] for r in out if r["doc_id"] == 400] == [True]
    kept = quality.filter_quality(docs, lab)
    assert kept.columns == docs.columns and kept.count() == 241
    assert quality.judge(docs, lab.limit(0)).where("not base_failed and not kept").count() == 0
    assert quality.judge(docs.limit(0), lab).count() == 0


def test_rule_order_and_pruning():
    x = {k: np.zeros(120) for k in quality.FEATURES}
    x["upper_share"] = np.r_[np.ones(40), np.zeros(80)]
    rules = quality.learn(x, x["upper_share"] > 0)
    assert len(rules) == 1 and rules[0][0][0] == "upper_share" and rules[0][0][1] == ">"
    assert quality.learn(x, np.zeros(120, bool)) == []
