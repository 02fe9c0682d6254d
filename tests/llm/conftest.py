import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, target string, n_words int, ids string"


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta.", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Null ids, texts and sources, empty and long texts, equal rows, shared passages, clashing columns."""
    rng = random.Random(5)
    shared = sentence(rng, 60)
    rows = [(None, sentence(rng, 30), "s0"), (1, None, "s0"), (2, "", None), (3, " \n\t ", "s1"), (4, "One", "s1"), (5, "one two", "s1"), (6, "One two", "s2")]
    for i in range(7, 40):
        body = sentence(rng, rng.randrange(5, 120))
        if i % 3 == 0:
            body += " " + shared
        rows.append((i, body, f"s{i % 4}" if i % 5 else None))
    rows += [rows[20], rows[20], (50, rows[20][1], "s9"), (51, rows[20][1] + " more", "s9"), (52, shared + " " + shared, "s3")]
    rows.append((53, " ".join(sentence(rng, 50) for _ in range(200)), "s0"))
    rows.append((54, "mail a.b@c.de or +1 (555) 010-9999, 10.20.30.40 and 4111 1111 1111 1111\u00a0é <|endoftext|>", "s0"))
    full = [(i, t, "en", s, len(t or ""), 1, "r", "t", 2, "x") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(5).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
