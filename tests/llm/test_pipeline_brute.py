"""The whole pipeline on a small folder with planted cases, against plain Python over all rows and all pairs."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from siftwell.llm import pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PRIVATE = {
    "write to jo.doe@mail.example.org now": "write to <EMAIL> now",
    "from 10.20.30.40 again": "from <IP> again",
    "card 4111 1111 1111 1111 it": "card <CARD> it",
    "call +1 (555) 010-9999 ok": "call <PHONE> ok",
    "pay DE89 3704 0044 0532 0130 00 now": "pay <IBAN> now",
    "password=ab12cd34ef56 x": "password=<SECRET> x",
    "not 999.1.1.1 nor 4111 1111 1111 1112 x": "not 999.1.1.1 nor 4111 1111 1111 1112 x",
}


def text_of(rng, n, mark=""):
    return " ".join(rng.choice("abcdefghKLMN") + rng.choice("aeiou") + str(rng.randrange(400)) + mark for _ in range(n))


def planted():
    """(doc_id, text, source) rows, labels, and the ids of junk."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(300):
        junk = i % 5 == 0
        rows.append((i, text_of(rng, rng.randrange(60, 110), "##" if junk else ""), f"s{i % 4}" if i % 7 else None))
        labels.append((i, 0 if junk else 1))
    good = [r for r in rows if r[0] % 5]
    for j, private in enumerate(PRIVATE):
        rows.append((400 + j, f"{text_of(rng, 40)} {private} {text_of(rng, 40)}", "s1"))
    rows += [(420 + j, text_of(rng, 80, "##"), "s2") for j in range(10)]  # junk without a label
    rows += [(430, text_of(rng, 49), "s0"), (431, " ".join([text_of(rng, 10)] * 9), "s0"), (432, None, "s0"), (433, "", None), (None, None, None)]
    rows += [good[3], good[3], (440, good[3][1], "s3"), (441, good[3][1].upper(), "s3")]
    chain = text_of(rng, 120).split()
    for j in range(12):  # each near the next, the ends far apart
        rows.append((450 + j, " ".join(chain), "s0"))
        chain[5 + 9 * j] = f"new{j}"
    rows += [(None, text_of(rng, 70), "s1"), (None, text_of(rng, 70), "s9"), (None, good[8][1] + " tail", "s1"), (470, text_of(rng, 70), "s1"), (470, text_of(rng, 75), "s1")]
    rows += [(480, text_of(rng, 5000), "s9"), (481, "<|endoftext|> İş é \U0001f600 " + text_of(rng, 60), "s9")]
    return rows, labels, {r[0] for r in rows if r[1] and "##" in r[1]}


def bad_by_base(text):
    w = WORD.findall(text or "")
    times = Counter(zip(w, w[1:], w[2:]))
    again = {k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(w) < 50 or 100 * len(again) > 50 * len(w)


def one_of_each(rows):
    sets = []
    for r in rows:
        w = WORD.findall(r[1].lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    name = list(range(len(rows)))

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * len(sets[i] | sets[j]):
                name[top(i)] = top(j)
    first = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        if top(i) not in first or key < first[top(i)][0]:
            first[top(i)] = (key, r)
    return [r for _, r in first.values()]


def mixed(rows):
    size = {}
    for _, text, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, float(sum(size.values())), set(size)
    while free:  # fill what is over its cap, share the rest again
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit >= 3 * size[s]}
        for s in over or free:
            target[s] = min(3.0 * size[s], weight[s] * unit)
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    out = []
    for s in order:
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(("null" if r[0] is None else str(r[0])).encode()).hexdigest(), len(WORD.findall(r[1]))))
        at = 0
        for r in own * 3:
            n = len(WORD.findall(r[1]))
            if 2 * at + n <= 2 * round(target[s]):
                out.append(r)
            at += n
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("planted")
    rows, labels, _ = planted()
    full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_equals_brute_force(spark, folder):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rows, _, junk = planted()
    clean = [r for r in rows if r[0] not in junk and not bad_by_base(r[1])]
    single = one_of_each(clean)
    hidden = []
    for i, text, s in single:
        for private, shown in PRIVATE.items():
            text = text.replace(private, shown)
        hidden.append((i, text, s))
    assert len(rows) > len(clean) > len(single) > 250
    want = sorted(repr((i, s, x := library.encode(t, add_special_tokens=False).ids, len(x))) for i, t, s in mixed(hidden))
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids"]
    assert sorted(repr((r["doc_id"], r["source"], list(r["ids"]), r["n_tokens"])) for r in got.collect()) == want


def test_planted_text_holds_no_other_personal_data():
    rows, _, _ = planted()
    for i, text, _ in rows:
        assert any(pii.find_spans(text).values()) == any(p in (text or "") and p != s for p, s in PRIVATE.items()), i
    assert quality.MIN_WORDS == 50 and quality.MAX_REPEAT_PERCENT == 50
