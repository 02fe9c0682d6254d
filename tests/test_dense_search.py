"""The exact cosine search on odd vectors, without a shuffle of the pairs."""

import numpy as np

from siftwell.operators import dense


def test_cosine_of_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0]), (6, [1.0, 1.0]), (None, [1.0, 0.0])], "id long, v array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "case_id long, q array<float>")
    rows = dense.nearest(q, v, 10).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [2, 6, 3, 4, 5] and np.isnan(rows[0]["score"]) and rows[1]["score"] == round(2**-0.5, 9) and rows[2]["score"] is None
    assert dense.nearest(q.limit(0), v, 3).count() == 0 and dense.nearest(q, v, 3)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
