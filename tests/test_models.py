import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import metrics as M
from tabloom.operators import models as K
from tabloom.operators import prepare as P
from tabloom.plans import gram as G


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(k, float(m + i % 5), float(-m + i % 3)) for k, m in (("a", 0), ("b", 20), ("c", 40)) for i in range(30)]
    return spark.createDataFrame([*rows, ("a", None, 1.0)], "k string, x double, y double")


@pytest.mark.parametrize("fit", [K.nearest_centroid, K.gaussian_nb, K.linear_discriminant])
def test_classifiers_separate_groups_and_leave_unknown_features(groups, fit):
    out = fit(groups, ["x", "y"], "k").transform(groups)
    assert out.where("x is not null and prediction <> k").count() == 0
    assert out.where("x is null").first().prediction is None


def test_ridge_classifier_equals_one_against_the_rest(spark, groups):
    df = groups.dropna()
    m = K.ridge_classifier(df, ["x", "y"], "k", 2.0)
    for i, c in enumerate("abc"):
        one = G.ridge(G.grams(df.withColumn("t", F.when(F.col("k") == c, 1.0).otherwise(-1.0)), ["x", "y"], "t")[None], 2.0)
        assert m.weights[i] == pytest.approx(one.coefficients, abs=1e-9) and m.intercepts[i] == pytest.approx(one.intercept, abs=1e-9)


def test_baselines(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", None), ("a", 9.0), (None, 4.0)], "k string, v double")
    assert K.dummy_regressor(df, "v").stats["value"] == 4.0
    assert K.dummy_regressor(df, "v", "median").stats["value"] == 3.0
    assert K.dummy_classifier(df, "k").stats["value"] == "a"


def test_yeo_johnson_and_box_cox_find_the_exponent(spark):
    x = np.exp(np.random.default_rng(0).normal(5, 1, 2000))
    assert x.min() > 1  # then Yeo-Johnson of x - 1 is Box-Cox of x
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    assert P.power(df, "v", "box_cox").stats["exponent"] == pytest.approx(0, abs=0.06)
    shifted = P.power(df.select((F.col("v") - 1).alias("v")), "v")
    assert shifted.stats["exponent"] == pytest.approx(0, abs=0.06)
    assert P.power(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").stats["exponent"] is None


def test_quantile_uniform_ties_bounds_and_nulls(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.0, 1.0, 2.0, None)], "v double")
    f = P.quantile_uniform(df, "v", 4)
    new = spark.createDataFrame([(-5.0,), (0.5,), (1.0,), (9.0,), (None,)], "v double")
    assert [r[0] for r in f.transform(new).collect()] == [0.0, 0.125, 0.5, 1.0, None]


def test_mutual_information_of_equal_and_independent_columns(spark):
    df = spark.sql("select id % 2 as a, id % 2 as b, (id div 2) % 2 as c from range(8)")
    assert P.mutual_information(df, "a", "b").first()[0] == pytest.approx(np.log(2))
    assert P.mutual_information(df, "a", "c").first()[0] == pytest.approx(0)


def test_calinski_harabasz(spark, groups):
    df = groups.dropna()
    x = np.array([(r.x, r.y) for r in df.orderBy("k").collect()])
    m, parts = x.mean(axis=0), [x[i * 30 : i * 30 + 30] for i in range(3)]
    between = sum(30 * ((p.mean(axis=0) - m) ** 2).sum() for p in parts)
    within = sum(((p - p.mean(axis=0)) ** 2).sum() for p in parts)
    assert M.calinski_harabasz(df, ["x", "y"], "k").first()[0] == pytest.approx(between / 2 / (within / 87))
    assert M.calinski_harabasz(df.where("k = 'a'"), ["x", "y"], "k").first()[0] is None


@pytest.fixture(scope="module")
def moments(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + r.normal(0, 0.1, 300)
    df = spark.createDataFrame([(*map(float, a), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y double, k int")
    return x - x.mean(axis=0), y - y.mean(), G.grams(df, ["a", "b", "c"], "y")[None], G.grams(df, ["a", "b", "c"], "y", "k")


def test_sqrt_lasso_is_stationary(moments):
    x, y, g, _ = moments
    w = G.sqrt_lasso(g, 3.0).coefficients
    e = y - x @ w
    slope = x.T @ e / np.linalg.norm(e)
    assert np.all(np.abs(slope) <= 3.0 + 1e-4) and slope[w != 0] == pytest.approx(3.0 * np.sign(w[w != 0]), abs=1e-4)


def test_mcp_and_bayesian_ridge(moments):
    x, y, g, _ = moments
    w = G.mcp(g, 0.2).coefficients
    kept = np.linalg.lstsq(x[:, :2], y, rcond=None)[0]
    assert w[2] == 0 and w[:2] == pytest.approx(kept, abs=1e-6)
    assert G.bayesian_ridge(g).coefficients == pytest.approx([3, -2, 0], abs=0.05)


def test_learning_curve_and_loss_surface(moments):
    x, y, g, by = moments
    curve = G.learning_curve({k: by[k] for k in (0, 1)}, by[2], 1.0)
    assert [r["n"] for r in curve] == [100, 200]
    m = G.ridge(g, 1.0)
    surface = G.loss_surface(g, m, 0, 1, 1.0, 3)
    assert min(surface, key=lambda r: r["loss"]) == surface[4]
    assert surface[4]["loss"] == pytest.approx(((y - x @ m.coefficients) ** 2).sum() + m.coefficients @ m.coefficients)
