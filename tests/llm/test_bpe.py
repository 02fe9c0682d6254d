import hashlib
import random

from pyspark.sql import functions as F

from siftwell.llm import bpe


def test_ids_equal_the_library(path):
    from tokenizers import Tokenizer

    t, c, rng = Tokenizer.from_file(path), bpe.Coder(path), random.Random(2)
    tokens = [x.replace("</w>", "") for x in c.model.vocab]
    parts = ["'s", "É", "é", "क़", "ß", "Σας", "İ", " ", "\n", "\u00a0", "\x1c", "<|endoftext|>", "<|startoftext|>", "😀", "12", "½", "!!"]
    for _ in range(4000):
        s = "".join(rng.choice([chr(rng.randrange(32, 127)), rng.choice(tokens), rng.choice(parts), rng.choice("aeinorst")]) for _ in range(rng.randrange(1, 12)))
        ids = t.encode(s, add_special_tokens=False).ids
        assert c.encode(s) == ids, s
        assert c.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_last_tokens_are_unique(path):
    """Of all tokens that end at a prefix, exactly one is compatible with the prefix before it."""
    m = bpe.Coder(path).model
    for word in (b"thanedble", b"unhappiness", b"aaaaaaaaaaaaa", b"internationalisation"):
        (_, ids), = m.encode_sorted([word])
        assert "".join(m.tokens[i] for i in ids) == word.decode() + "</w>"
        for a, b in zip(ids, ids[1:]):
            assert m.compatible(a, b)


def test_frame(docs, none, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = bpe.digests(docs, path).collect()
    want = sorted((str(d["doc_id"]), hashlib.sha256(" ".join(map(str, t.encode(d["text"] or "", add_special_tokens=False).ids)).encode()).hexdigest()) for d in docs.collect())
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in rows) == want
    back = bpe.decode(bpe.encode(docs, path), path)
    assert back.where(F.col("row.text").isNull()).first()["decoded"] == ""
    assert bpe.encode(docs, path).select("row.*").columns == docs.columns
    assert bpe.digests(none, path).count() == 0
