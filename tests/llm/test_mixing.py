import pytest
from pyspark.sql import functions as F

from siftwell.llm import mixing


def taken(df):
    return F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])


def test_targets_are_met_and_no_document_is_taken_too_often(docs):
    rows = mixing.mix(docs).select("row.doc_id", "row.source", "size", "source_size", "target", taken(docs).alias("taken")).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(sum(r["size"] for r in rows))
    order = sorted((s for s in by if s is not None)) + [None]
    for source, v in by.items():
        assert sum(r["size"] for r in v) == v[0]["source_size"]
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1
        assert v[0]["target"] <= 3 * v[0]["source_size"] + 1e-9
    free = [(v[0]["target"], (5, 2, 1)[order.index(s) % 3]) for s, v in by.items() if v[0]["target"] < 3 * v[0]["source_size"] - 1e-6]
    assert len({round(t / w, 6) for t, w in free}) <= 1


def test_whole_documents_and_order(docs):
    mixed = mixing.mix(docs, whole_documents=True)
    rows = mixed.select("size", F.explode("copies").alias("c")).collect()
    assert all(r["c"]["words"] == r["size"] for r in rows)
    at = [r["position"] for r in mixing.training_order(mixed).collect()]
    assert at == sorted(at) and len(at) == len(rows)
    assert mixing.training_order(mixed).select("row.*").columns == docs.columns


def test_reruns_agree_and_empty(docs, none):
    key = lambda: sorted(map(str, mixing.mix(docs).select("row.doc_id", "copies").collect()))
    assert key() == key()
    assert mixing.mix(none).count() == 0


def test_demand_time_inverts_the_schedule(spark):
    for knots in mixing.RAMPS:
        assert mixing.integral(knots) == pytest.approx(1)
        for share in (0.0, 0.2, 0.5, 0.9, 1.0):
            t = spark.range(1).select(mixing.demand_time(F.lit(share), knots)).first()[0]
            area = 0.0
            for (t0, a), (t1, b) in zip(knots, knots[1:]):
                u = min(max(t, t0), t1)
                area += (u - t0) * (a + a + (b - a) * (u - t0) / (t1 - t0)) / 2
            assert area == pytest.approx(share, abs=1e-9)
    with pytest.raises(ValueError):
        mixing.check_schedule([(0, 1), (0.5, 1)])


def test_rows_of_one_id_and_size_keep_their_copies_however_they_are_dealt(spark):
    rows = [(None, f"{w} words here", "s0") for w in "abcdefghij"] + [(1, "x y z " * 10, "s1"), (2, "one two", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    dealt = lambda n: sorted(map(str, mixing.mix(df.repartition(n), whole_documents=True).select("row.text", "copies").collect()))
    assert dealt(1) == dealt(7)


def test_columns_that_hold_maps(docs):
    wide = docs.withColumn("m", F.create_map(F.lit("a"), F.col("size"))).withColumn("s", F.struct(F.array("m").alias("in"), "lang"))
    out = mixing.training_order(mixing.mix(wide)).select("row.*")
    assert out.columns == wide.columns and out.count() == mixing.training_order(mixing.mix(docs)).count()
