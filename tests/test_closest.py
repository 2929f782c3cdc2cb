"""The largest similarity of a query's results, from products within the query alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswire.operators import results


@pytest.mark.parametrize("block", [3, 2_000])
def test_closest(spark, block):
    r = np.random.default_rng(2)
    rows = [(q, 100 * q + i, r.normal(size=4).tolist()) for q in range(4) for i in range(11)]
    rows += [(5, 1, [1.0, 0.0]), (5, 2, [0.0, 1.0]), (5, 3, [-1.0, 0.0, 0.0])]  # the third has another length
    rows += [(6, 1, [1.0, 2.0]), (6, 2, [1.0, 2.0]), (7, 1, [0.0, 0.0]), (7, 2, [0.0, 0.0]), (8, 1, [1.0, 0.0]), (8, 2, [-1.0, 0.0]), (9, 1, [1.0, 0.0]), (10, 1, [0.0, 1.0]), (10, 1, [0.0, 1.0])]
    want = {5: 0.0, 6: 1.0, 7: 0.0, 8: -1.0}
    for q in range(4):
        m = np.array([v for k, _, v in rows if k == q])
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        want[q] = (m @ m.T - 3 * np.eye(len(m))).max()
    v = spark.createDataFrame(rows, "query_id long, id long, embedding array<double>").groupBy("query_id", "embedding")
    found = results._closest(v.agg(F.min("id").alias("id"), (F.min("id") != F.max("id")).alias("again")), block).collect()
    assert {x.query_id: x.similarity for x in found} == pytest.approx(want)


def test_snippets_are_cut_before_texts_are_dealt(spark):
    rows = spark.createDataFrame([(1, 2, 0.5, "t", "x" * 900, None)], "query_id long, article_id long, score double, title_norm string, clean_text string, published_at timestamp")
    plan = results.result_snippet(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "clean_text" not in plan[: plan.index("Window")] + plan[plan.index("Window") :].split("\n")[0]
    assert "substring(clean_text" in plan[plan.index("Window") :]
