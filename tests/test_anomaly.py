import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import anomaly


def slow_path(tree, row, at=0, depth=0):
    if tree.feature[at] < 0:
        return tree.path[at]
    side = tree.left if row[tree.feature[at]] <= tree.threshold[at] else tree.right
    return slow_path(tree, row, side[at], depth + 1)


def test_forest_equals_a_slow_one_and_cuts_exactly(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (900, 2)), rng.uniform(5, 9, (40, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(-1, None, 1.0)], "id long, a double, b double").repartition(4)
    forest = anomaly.isolation_forest(df, "id", ["a", "b"], trees=40, size=64, contamination=0.05)
    got = {r.id: r for r in forest.transform(df).collect()}
    assert got[-1].anomaly is None and got[-1].anomaly_score is None
    c = 2 * (np.log(63) + 0.5772156649015329) - 2 * 63 / 64
    for i in [*range(0, 940, 37), 939]:
        assert got[i].anomaly_score == pytest.approx(2 ** (-np.mean([slow_path(t, x[i]) for t in forest.trees]) / c))
    scores = sorted(got[i].anomaly_score for i in range(940))
    cut = np.quantile(scores, 0.95)
    assert {i for i in range(940) if got[i].anomaly == -1} == {i for i in range(940) if got[i].anomaly_score > cut}
    assert sum(got[i].anomaly == -1 for i in range(900, 940)) >= 38
    again = anomaly.isolation_forest(df.repartition(7), "id", ["a", "b"], trees=40, size=64, contamination=0.05)
    assert again.cut == forest.cut
    for t in forest.trees:
        inner = t.feature >= 0
        assert len(t.feature) <= 127 and (t.left[inner] > 0).all() and (t.right[inner] > 0).all()


def test_forest_of_equal_rows_and_refusals(spark):
    df = spark.range(50).withColumn("a", F.lit(1.0))
    forest = anomaly.isolation_forest(df, "id", ["a"], trees=5)
    assert forest.transform(df).where("anomaly = -1").count() == 0
    with pytest.raises(ValueError, match="two rows"):
        anomaly.isolation_forest(df.limit(1), "id", ["a"])
    with pytest.raises(ValueError, match="contamination"):
        anomaly.isolation_forest(df, "id", ["a"], contamination=0.0)
