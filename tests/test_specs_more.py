from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import specs as S


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(21)
    x = rng.gamma(2.0, size=(300, 4)) @ (np.eye(4) + 0.5 * rng.random((4, 4)))
    y = x @ [1.0, 2.0, 0.0, -1.0] + 0.1 * rng.normal(size=300)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "key long, a double, b double, c double, d double, y double").repartition(3).cache()


STEPS = [{"kind": k, "components": 2} for k in ("ica", "nmf", "factor_analysis", "random_projection", "rbf")] + [{"kind": "iterative_impute", "rounds": 2}, {"kind": "power"}, {"kind": "power", "how": "box_cox"}, {"kind": "quantile"}, {"kind": "quantile", "output": "normal"}]


def test_steps_fit_save_and_load(spark, table, tmp_path):
    """All steps side by side in front of one model: predictions survive saving, rows and other columns stay."""
    spec = {"kind": "chain", "steps": [["all", {"kind": "union", "steps": [[f"s{i}", s] for i, s in enumerate(STEPS)]}], ["model", {"kind": "ridge", "alpha": 1.0}]]}
    m = S.SpecEstimator(spec, ["a", "b", "c", "d"], "y").fit(table)
    m.save(table, str(tmp_path / "m"))
    again = S.load_spec_model(table, str(tmp_path / "m"))
    one, two = ({r.key: r.prediction for r in x.transform(table).select("key", "prediction").collect()} for x in (m, again))
    assert one == pytest.approx(two) and len(one) == 300
    assert np.corrcoef([one[k] for k in sorted(one)], [r.y for r in table.orderBy("key").collect()])[0, 1] > 0.95


def _made(spec, df, columns):
    m = S.SpecEstimator(spec, columns).fit(df)
    return m.transform(df), m


def test_quantile_and_rbf_steps(spark):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate([*range(33), 5, 5, None])], "key long, x double").where("key < 33 or key = 35")
    for output in ("uniform", "normal"):
        out, m = _made({"kind": "quantile", "quantiles": 16, "output": output}, df, ["x"])
        name = next(c for c in out.columns if c not in df.columns)
        got = {r["x"]: r[name] for r in out.collect()}
        want = {float(v): v / 32 for v in range(33)}
        if output == "normal":
            want = {v: NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) for v, p in want.items()}
        assert got.pop(None) is None and got == pytest.approx(want)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 2))
    pts = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "key long, a double, b double")
    out, _ = _made({"kind": "rbf", "components": 200, "gamma": 0.5}, pts, ["a", "b"])
    z = np.array([[r[c] for c in out.columns if "rbf" in c] for r in out.orderBy("key").collect()])
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.35 and np.abs(z @ z.T - kernel).mean() < 0.08


def test_models_from_moments(table):
    loss = {}
    for kind in ("nonnegative", "adaptive_lasso", "bayesian_ridge", "ard", "omp", "lars", "lasso_lars", "group_lasso", "sparse_group_lasso", "fused_lasso", "scad", "pls", "ols"):
        m = S.SpecEstimator({"kind": kind, **({"size": 3} if kind in ("omp", "lars") else {"components": 3} if kind == "pls" else {"alpha": 0.01} if "lasso" in kind or kind == "scad" else {})}, ["a", "b", "c", "d"], "y").fit(table)
        loss[kind] = m.transform(table).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    assert all(v >= loss["ols"] * (1 - 1e-9) for v in loss.values()) and all(v < 0.2 for k, v in loss.items() if k not in ("nonnegative", "lars"))


def test_refusals(table):
    for spec, what in (({"kind": "power", "how": "x"}, "power how"), ({"kind": "quantile", "output": "x"}, "quantile"), ({"kind": "nmf", "components": 9}, "components")):
        with pytest.raises(ValueError, match=what):
            S.SpecEstimator(spec, ["a", "b"]).fit(table)
    with pytest.raises(ValueError, match="above 0"):
        S.SpecEstimator({"kind": "power", "how": "box_cox"}, ["a"]).fit(table.withColumn("a", -F.col("a")))
