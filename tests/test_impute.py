import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import impute
from tabloom.plans.gram import Gram, bayesian_ridge


def _slow(x, rounds):
    """The same rounds over a matrix in memory."""
    gap, x = np.isnan(x), x.copy()
    p = x.shape[1]
    for j in range(p):
        x[gap[:, j], j] = np.median(x[~gap[:, j], j])
    for _ in range(rounds):
        for j in sorted(range(p), key=lambda j: (gap[:, j].sum(), j)):
            o, k = [i for i in range(p) if i != j], ~gap[:, j]
            a, y = x[np.ix_(k, o)], x[k, j]
            ac, yc = a - a.mean(axis=0), y - y.mean()
            m = bayesian_ridge(Gram([str(i) for i in o], len(y), a.mean(axis=0), y.mean(), ac.T @ ac, ac.T @ yc, float(yc @ yc)))
            x[gap[:, j], j] = x[np.ix_(gap[:, j], o)] @ m.coefficients + m.intercept
    return x


def test_iterative_imputation_equals_a_slow_one(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 3)) @ np.array([[1.0, 0.5, 0.0, 2.0], [0, 1, 1, 0], [0.2, 0, 1, -1]]) + [10, -5, 0, 1000] + 0.1 * rng.normal(size=(400, 4))
    holes = x.copy()
    for j, share in enumerate((0.2, 0.0, 0.1, 0.3)):
        holes[rng.random(400) < share, j] = np.nan
    rows = [(i, *[None if np.isnan(v) and i % 2 else float(v) for v in r], "kept") for i, r in enumerate(holes)]
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, d double, _v string").withColumnRenamed("_v", "other").repartition(4)
    m = impute.iterative_impute(df, ["a", "b", "c", "d"], rounds=3, tol=0.0)
    m.save(df, str(tmp_path / "m"))
    out = impute.load_imputer(df, str(tmp_path / "m")).transform(df).orderBy("key").collect()
    assert np.array([[r.a, r.b, r.c, r.d] for r in out]) == pytest.approx(_slow(holes, 3), rel=1e-7)
    assert {r.other for r in out} == {"kept"} and len(m.trace) == 3 and m.trace[2] < m.trace[0]
    gap = np.isnan(holes)
    got = np.array([[r.a, r.b, r.c, r.d] for r in out])
    assert np.abs(got - x)[gap].mean() < 0.5 * np.abs(_slow(holes, 0) - x)[gap].mean()


def test_iterative_imputation_learns_from_train_only(spark):
    train = spark.createDataFrame([(float(i), 2.0 * i if i % 3 else None) for i in range(60)], "x double, y double")
    m = impute.iterative_impute(train, ["x", "y"])
    new = spark.createDataFrame([(100.0, None), (None, 40.0), (float("inf"), 40.0), (None, None), (1.0, 7.0)], "x double, y double")
    a, b, c, d, e = m.transform(new).collect()
    assert a.y == pytest.approx(200, rel=1e-3) and b.x == pytest.approx(20, rel=1e-3) and c.x == b.x and d.x is not None and d.y is not None and (e.x, e.y) == (1.0, 7.0)


def test_iterative_imputation_edges(spark):
    df = spark.createDataFrame([(1.0, None, 5.0, None), (2.0, None, 5.0, None), (4.0, 3.0, None, None)], "a double, once double, same double, none double")
    m = impute.iterative_impute(df, ["a", "once", "same", "none"], nearest=1)
    assert m.columns == ["a", "once", "same"] and all(len(s[1]) == 1 for s in m.steps)
    out = m.transform(df).collect()
    assert [r.once for r in out] == [3.0, 3.0, 3.0] and [r.same for r in out] == [5.0, 5.0, 5.0] and [r.none for r in out] == [None] * 3
    empty = impute.iterative_impute(df.where("a > 9"), ["a", "once"])
    assert empty.columns == [] and empty.transform(df).count() == 3
    assert m.transform(df.where(F.lit(False))).count() == 0
    with pytest.raises(ValueError, match="at least"):
        impute.iterative_impute(df, ["a"], nearest=0)
