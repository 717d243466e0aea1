import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import relevance as R


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    y = np.concatenate([rng.normal(10, 1, 180), rng.normal(18, 1.5, 15), rng.normal(2, 1, 9)])
    return spark.createDataFrame([(i, float(rng.normal() + v), float(rng.normal() - v / 2), float(v), "x") for i, v in enumerate(y)], "key long, a double, b double, y double, note string").repartition(4).cache()


def test_relevance_is_a_monotone_cubic(spark):
    r = R.Relevance([(0, 1, 0), (10, 0, 0), (30, 0.8, 0.5), (40, 1, 0)])
    xs = [float(x) / 7 for x in range(-70, 350)]
    rows = spark.createDataFrame([(x,) for x in [*xs, None]], "y double").withColumn("r", r.column(F.col("y"))).collect()
    assert [q.r for q in rows if q.y is not None] == pytest.approx([r.value(q.y) for q in rows if q.y is not None], abs=1e-12) and [q.r for q in rows if q.y is None] == [None]
    v = np.array([r.value(x) for x in xs])
    at = np.array(xs)
    assert (np.diff(v[at <= 10]) <= 1e-12).all() and (np.diff(v[at >= 10]) >= -1e-12).all() and r.value(5.0) == pytest.approx(0.5)
    for x, rising in r.crossings(0.5, -10, 50):
        assert r.value(x) == pytest.approx(0.5) and (r.value(x) >= 0.5) == rising and (r.value(np.nextafter(x, -100)) >= 0.5) != rising
    for bad in ([(0, 1, 0)], [(0, 1, 0), (0, 0, 0)], [(0, 2, 0), (1, 0, 0)], [(0, 1, float("nan")), (1, 0, 0)]):
        with pytest.raises(ValueError, match="control points"):
            R.Relevance(bad)


def test_box_relevance_and_stretches(data):
    y = np.array([r.y for r in data.select("y").collect()])
    q1, m, q3 = np.quantile(y, [0.25, 0.5, 0.75])
    inside = y[(y >= q1 - 1.5 * (q3 - q1)) & (y <= q3 + 1.5 * (q3 - q1))]
    r = R.box_relevance(data, "y")
    assert np.array(r.points) == pytest.approx(np.array([(inside.min(), 1, 0), (m, 0, 0), (inside.max(), 1, 0)]))
    rows, sizes = R.stretches(data, "y", r)
    assert [s["rare"] for s in sizes] == [True, False, True] and sum(s["n"] for s in sizes) == 204
    for q in rows.collect():
        assert (r.value(q.y) >= 0.5) == (q.stretch != 1)
    assert R.box_relevance(data, "y", "high").points[0] == (y.min(), 0, 0)
    assert R.wanted(sizes) == {0: 68, 1: 68, 2: 68}
    extreme = R.wanted(sizes, "extreme")
    assert extreme[0] > extreme[2] > extreme[1] and 200 < sum(extreme.values()) <= 204


def test_over_and_under_keep_rows_whole(data):
    n = {s["stretch"]: s["n"] for s in R.stretches(data, "y", R.box_relevance(data, "y"))[1]}
    over = R.resample_regression(data, "y", "key", ["a", "b"], "over")
    assert {r.stretch: r["count"] for r in over.groupBy("stretch").count().collect()} == {0: 68, 1: n[1], 2: 68}
    copies = [r["count"] for r in over.where("stretch = 0").groupBy("key").count().collect()]
    assert max(copies) - min(copies) <= 1 and over.select("key", "a", "y", "note").subtract(data.select("key", "a", "y", "note")).count() == 0
    under = R.resample_regression(data, "y", "key", ["a", "b"], "under")
    assert {r.stretch: r["count"] for r in under.groupBy("stretch").count().collect()} == {0: n[0], 1: 68, 2: n[2]}
    assert under.groupBy("key").count().where("count > 1").count() == 0


@pytest.mark.parametrize("how", ["smoter", "smogn"])
def test_synthetic_rows(data, how):
    out = R.resample_regression(data, "y", "key", ["a", "b"], how, k=3, seed=4)
    assert {r.stretch: r["count"] for r in out.groupBy("stretch").count().collect()} == {0: 68, 1: 68, 2: 68}
    old = out.where("not synthetic").collect()
    made = out.where("synthetic").collect()
    assert all(r.key is None and r.note is None for r in made) and all(r.note == "x" for r in old)
    on_segment = 0
    for s in (0, 2):
        x = np.array([[r.a, r.b, r.y] for r in old if r.stretch == s])
        d = np.sqrt(((x[:, None, :2] - x[None, :, :2]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        ends = [(i, j) for i in range(len(x)) for j in np.argsort(d[i])[:3]]
        for r in (r for r in made if r.stretch == s):
            v, hit = np.array([r.a, r.b, r.y]), False
            for i, j in ends:
                w = x[j] - x[i]
                u = (v - x[i])[:2] @ w[:2] / (w[:2] @ w[:2])
                # Features and target divide their ways in the same proportion.
                if -1e-9 <= u <= 1 + 1e-9 and np.abs(x[i] + u * w - v).max() < 1e-8 and (how == "smoter" or d[i, j] < np.median(d[i][np.isfinite(d[i])]) / 2):
                    hit = True
            noise = np.abs(x - v).max(axis=1).min() < 0.02 * 6 * x.std(axis=0, ddof=1).max()
            assert hit or how == "smogn" and noise
            on_segment += hit
    assert on_segment == len(made) if how == "smoter" else 0 < on_segment < len(made)
    again = R.resample_regression(data.repartition(3), "y", "key", ["a", "b"], how, k=3, seed=4).where("synthetic")
    assert sorted((round(r.a, 9), round(r.y, 9)) for r in again.collect()) == sorted((round(r.a, 9), round(r.y, 9)) for r in made)


def test_refusals_and_same_place(spark, data):
    f = lambda d, **o: R.resample_regression(d, "y", "key", ["a", "b"], **o)
    hole = data.withColumn("a", F.when(F.col("key") > 0, F.col("a")))
    for bad, d, o in [("three distinct", data.where("key < 2"), {}), ("fill unknown", hole, {}), ("finite target", data.withColumn("y", F.when(F.col("key") > 0, F.col("y"))), {}), ("all rare or all usual", data.where("y between 9 and 11"), {}), ("how", data, {"how": "x"}), ("perturbation", data, {"perturbation": 0.0}), ("threshold", data, {"threshold": 1.0}), ("overwritten", data.withColumn("stretch", F.lit(1)), {})]:
        with pytest.raises(ValueError, match=bad):
            f(d, **o)
    rows = [(i, 1.0, 1.0, 5.0 + i % 3 / 10) for i in range(30)] + [(100, 2.0, 2.0, 50.0), (101, 2.0, 2.0, 60.0)]
    out = f(spark.createDataFrame(rows, "key long, a double, b double, y double"), points=[(5.0, 0, 0), (20.0, 0, 0), (40.0, 1, 0)]).where("synthetic")
    assert {(r.a, r.b, r.y) for r in out.collect()} == {(2.0, 2.0, 55.0)} and out.count() == 14
