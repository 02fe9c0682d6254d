import pytest
from pyspark.sql import functions as F

from siftwell.functions import text
from siftwell.operators import chunking


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="Ação STRASSE straße, it's well-known_x -- 3.5!") == ["ação", "strasse", "strasse", "it's", "well-known", "x", "3", "5"]
    assert one(spark, text.tokens(F.col("t")), t="") == []


def test_words_and_windows(spark):
    assert one(spark, text.words(F.col("t")), t="  a\tb\n\nc\u00a0d ") == ["a", "b", "c", "d"]
    w = lambda t, size=4, over=1: one(spark, text.windows(F.col("t"), size, over), t=t)
    assert w("1 2 3 4 5") == ["1 2 3 4", "4 5"] and w("1 2 3 4") == ["1 2 3 4"] and w("") == [] and w("1 2 3 4 5 6 7") == ["1 2 3 4", "4 5 6 7"]
    with pytest.raises(ValueError):
        text.windows(F.col("t"), 4, 4)


def test_sentences_bigrams_containment(spark):
    assert one(spark, text.sentences(F.col("t")), t="- One two three four five. No! Six seven eight nine ten?\n\nshort") == ["One two three four five.", "Six seven eight nine ten?"]
    assert one(spark, text.bigrams(text.tokens(F.col("t"))), t="a b a b") == ["a b", "b a"]
    assert one(spark, text.bigrams(text.tokens(F.col("t"))), t="a") == []
    assert one(spark, text.contains_normalised(F.col("t"), F.col("c")), t="The cat", c="he CAT") and one(spark, text.contains_normalised(F.col("t"), F.col("c")), t="x", c="")


def test_globs(spark):
    hit = lambda p, g: one(spark, text.matches_any(F.col("p"), [g]), p=p)
    assert hit("docs/a/b.md", "docs/*.md") and not hit("Docs/a.md", "docs/*.md") and hit("a.md", "?.md") and hit("b1", "[!a][0-9]") and not hit("a+b", "a.b")


def test_markdown(spark):
    md = spark.createDataFrame([("d", "my-file", "pre\n# A\n1 2 3 4 5\n\n### B\nx y z\n# C\n\n## D\nend"), ("e", "s", "")], "document_id string, stem string, text string")
    assert [r["breadcrumb"] for r in chunking.heading_paths(md).orderBy("line").collect()] == ["A", "A > B", "C", "C > D"]
    rows = chunking.chunk_markdown(md, 4, 1).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["heading"], r["text"]) for r in rows] == [(0, "my file", "my file\npre"), (1, "A", "A\n1 2 3 4"), (2, "A", "A\n4 5"), (3, "A > B", "A > B\nx y z"), (4, "C > D", "C > D\nend")]
    assert len({r["chunk_id"] for r in rows}) == 5 and rows[0]["chunk_id"].startswith("d::0000::")
    quirk = spark.createDataFrame([("q", "s", "# A\n### B\n### C\nx\x0b# V\r## W")], "document_id string, stem string, text string")
    assert [r["breadcrumb"] for r in chunking.heading_paths(quirk).orderBy("line").collect()] == ["A", "A > B", "A > B > C", "V", "V > W"]


def test_openapi_and_dispatch(spark):
    spec = "paths:\n  /b:\n    post: {summary: P}\n    get: {summary: G, x: 1}\n  /a:\n    get: {summary: A}\ncomponents:\n  schemas:\n    Z: {type: object}\n"
    assert [h for h, _ in chunking.openapi_units(spec)] == ["API information", "GET /a", "GET /b", "POST /b", "components > schemas > Z"]
    assert chunking.openapi_units(spec)[0][1] == "{}\n" and chunking.openapi_units(spec)[2][1] == "GET /b\nsummary: G\n"
    odd = "paths: {/x: {put: {}, GET: {summary: s}, Trace: {}, custom: {}, parameters: [1]}}\ncomponents: {b: {q: 1, p: [2]}, a: 3}\ninfo: 5\n"
    assert chunking.openapi_units(odd) == [("GET /x", "GET /x\nsummary: s\n"), ("TRACE /x", "TRACE /x\n{}\n"), ("PUT /x", "PUT /x\n{}\n"), ("components > b > p", "- 2\n"), ("components > b > q", "1\n...\n")]
    with pytest.raises(ValueError):
        chunking.openapi_units("- a")
    df = spark.createDataFrame([("1", "x/api.YML", spec), ("2", "x/read-me.md", "text")], "document_id string, source_path string, text string")
    assert {(r["document_id"], r["kind"]): r["n"] for r in chunking.chunk_documents(df).groupBy("document_id", "kind").agg(F.count("*").alias("n")).collect()} == {("1", "openapi"): 5, ("2", "markdown"): 1}


def test_chunk_id_keeps_long_ordinals(spark):
    out = spark.range(1).select(chunking.chunk_id(F.lit("d"), F.lit(12345), F.lit("t")).alias("a"), chunking.chunk_id(F.lit("d"), F.lit(7), F.lit("t")).alias("b")).first()
    assert out["a"].split("::")[1] == "12345" and out["b"].split("::")[1] == "0007" and len(out["b"].split("::")[2]) == 12
