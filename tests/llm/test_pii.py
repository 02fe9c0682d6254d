import hashlib
import random
import re

from siftwell.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = {k: [] for k in PATTERNS}
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out[kind].append(m.span())
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a", "Z9", ".", "@", "+", "1", "22", "256", "0", " ", "-", "(", ")", "x@y.z", "4111 1111 1111 1111", "10.0.0.1", "+1 555 0100 99", "é", "%", "://", "token=abcdef12345", "1.2.3.4.5"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        found = pii.find_spans(text)
        assert {k: found[k] for k in PATTERNS} == brute(text), text


def test_added_kinds():
    text = "pay DE89 3704 0044 0532 0130 00 now, password=ab12cd34ef56 at https://joe:hunter22@example.org/x"
    found = {k: [text[a:b] for a, b in v] for k, v in pii.find_spans(text).items()}
    assert found["iban"] == ["DE89 3704 0044 0532 0130 00"] and found["secret"] == ["ab12cd34ef56"] and found["url"] == ["https://joe:hunter22@example.org"]
    assert not any(pii.find_spans("the token of love, a secret garden, 12:30 on 5 May 2020").values())
    assert pii.redacted("write a@b.cd!") == "write <EMAIL>!" and pii.redacted(None) is None


def test_frame(docs, none):
    rows = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    r = rows[54]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[1]["spans"] == ""
    assert pii.find_pii(docs).count() == docs.count() and pii.find_pii(none).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert "<CARD>" in clean.where("doc_id = 54").first()["text"]


def test_hostile_texts_take_linear_time():
    import time

    for text in ("token=" * 170_000, "password: " + "token=a" * 140_000, "1-" * 500_000, "+1(" * 330_000, "a@" * 500_000, "://a:" * 200_000):
        began = time.process_time()
        pii.find_spans(text)
        assert time.process_time() - began < 5, text[:30]


def test_a_secret_behind_a_plain_value_is_found():
    text = "token=aaaatoken: bbbb1234 token=abcdefghtoken=abcdefg1"
    assert [text[a:b] for a, b in pii.find_spans(text)["secret"]] == ["bbbb1234", "abcdefghtoken=abcdefg1"]
