"""Specifications: fitting, saving, overrides, refusals and search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import specs as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(180):
        a, b = float(rng.normal()), float(rng.normal(5, 3))
        c = "red green blue".split()[int(rng.integers(3))]
        y = 2 * a - b + (3 if c == "red" else 0) + float(rng.normal() * 0.1)
        rows.append((i, None if i % 11 == 0 else a, b, None if i % 13 == 0 else c, y, "big" if y > -4 else "small"))
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y double, cls string").repartition(3).cache()


PREP = ["prep", {"kind": "columns", "remainder": "drop", "parts": [
    ["num", {"kind": "chain", "steps": [["imp", {"kind": "impute", "how": "median"}], ["both", {"kind": "union", "steps": [["scaled", {"kind": "scale"}], ["bins", {"kind": "bins", "count": 3}]]}]]}, "numeric"],
    ["cat", {"kind": "onehot"}, ["c"]],
]}]


def spec(*model):
    return {"kind": "chain", "steps": [PREP, *model]}


@pytest.mark.parametrize("model", [{"kind": "ridge", "alpha": 0.1}, {"kind": "gradient", "loss": "huber", "epsilon": 1.0, "epochs": 8}, {"kind": "forest_regressor", "numTrees": 3, "seed": 1}])
def test_saved_regressions_predict_as_before(data, model, tmp_path):
    fitted = S.SpecEstimator(spec(["model", model]), ["a", "b", "c"], "y").fit(data)
    fitted.save(data, str(tmp_path / "m"))
    again = S.load_spec_model(data, str(tmp_path / "m"))
    one, two = (sorted(tuple(r) for r in m.transform(data).select("id", "prediction").collect()) for m in (fitted, again))
    assert one == two and len(one) == 180
    assert fitted.made == ["prep__num__both__scaled__prep__num__imp__a", "prep__num__both__scaled__prep__num__imp__b", "prep__num__both__bins__prep__num__imp__a", "prep__num__both__bins__prep__num__imp__b", "prep__cat__c_0", "prep__cat__c_1", "prep__cat__c_2"]
    assert S._score(fitted.transform(data), "y", "r2") > (0.9 if model["kind"] == "ridge" else 0.4)
    assert fitted.transform(data).columns[:6] == data.columns


def test_saved_classifier_and_unknown_categories(data, tmp_path):
    fitted = S.SpecEstimator(spec(["model", {"kind": "logistic"}]), ["a", "b", "c"], "cls").fit(data)
    fitted.save(data, str(tmp_path / "m"))
    new = data.withColumn("c", F.lit("violet"))
    one, two = (sorted(tuple(map(str, r)) for r in m.transform(new).select("id", "prediction", "probabilities").collect()) for m in (fitted, S.load_spec_model(data, str(tmp_path / "m"))))
    assert one == two and len(one) == 180


def test_statistics_are_those_of_the_training_rows(data):
    train = data.where("id < 100")
    p = S.SpecEstimator({"kind": "chain", "steps": [["imp", {"kind": "impute", "how": "mean", "indicator": True}], ["std", {"kind": "scale"}]]}, ["a", "b"]).fit(train)
    rows = train.select("a", "b").collect()
    mean = np.mean([r.a for r in rows if r.a is not None])
    a = np.array([mean if r.a is None else r.a for r in rows])
    got = {r.id: r for r in p.transform(data).collect()}
    first = data.where("id = 0").first()
    assert first.a is None and got[0]["std__imp__a"] == pytest.approx(0.0, abs=1e-9)
    assert got[1]["std__imp__a"] == pytest.approx((data.where("id = 1").first().a - mean) / a.std())
    assert p.made == ["std__imp__a", "std__imp__b", "std__imp__a_missing"]


@pytest.mark.parametrize("step", [
    {"kind": "scale", "how": "robust"}, {"kind": "scale", "how": "minmax"}, {"kind": "scale", "how": "maxabs"}, {"kind": "clip"}, {"kind": "normalize"}, {"kind": "binarize", "threshold": 1.0}, {"kind": "math", "function": "square"},
    {"kind": "missing"}, {"kind": "polynomial", "degree": 3}, {"kind": "spline", "knots": 4}, {"kind": "pca", "components": 1}, {"kind": "select", "k": 1}, {"kind": "variance"}, {"kind": "hash", "size": 4}, {"kind": "bins", "how": "uniform"},
])
def test_each_step_keeps_all_rows(data, step):
    p = S.SpecEstimator({"kind": "chain", "steps": [["x", step]]}, ["a", "b"], "y").fit(data)
    out = p.transform(data)
    assert out.count() == 180 and out.columns == [*data.columns, *p.made] and p.made
    if step["kind"] == "spline":
        whole = out.where("a is not null").select(sum((F.col(c) for c in p.made if "__a_" in c), F.lit(0.0)).alias("s")).distinct().collect()
        assert all(r.s == pytest.approx(1.0) for r in whole)
    if step["kind"] == "select":
        assert p.made == ["x__b"]
    assert S.SpecEstimator({"kind": "chain", "steps": [["x", step]]}, ["a", "b"], "y").fit(data).step.state() == p.step.state()


def test_overrides_and_refusals(data):
    s = S.set_options(spec(["model", {"kind": "ridge"}]), {"prep__num__imp__how": "mean", "prep__num__both__bins__count": 7, "model__alpha": 3.0, "prep__remainder": "passthrough"})
    assert s["steps"][1][1]["alpha"] == 3.0 and PREP[1]["remainder"] == "drop"
    assert S.SpecEstimator(s, ["a", "b", "c", "id"], "y").fit(data).made
    for path in ("prep__none__how", "model__x__y", "prep__num__how"):
        with pytest.raises(ValueError):
            S.set_options(spec(["model", {"kind": "ridge"}]), {path: 1})
    twice = {"kind": "columns", "parts": [["p", {"kind": "scale"}, ["a", "b"]], ["q", {"kind": "scale"}, "numeric"]]}
    with pytest.raises(ValueError, match="more than one part: a, b"):
        S.SpecEstimator(twice, ["a", "b"]).fit(data)
    for bad in ({"kind": "what"}, {"kind": "chain", "steps": []}, {"kind": "chain", "steps": [["m", {"kind": "ridge"}], ["s", {"kind": "scale"}]]}, {"kind": "union", "steps": [["a", {"kind": "scale"}], ["a", {"kind": "scale"}]]}, {"kind": "union", "steps": [["a", {"kind": "ridge"}]]}):
        with pytest.raises(ValueError):
            S.SpecEstimator(bad, ["a"])
    with pytest.raises(ValueError, match="unknown columns"):
        S.SpecEstimator({"kind": "columns", "parts": [["p", {"kind": "scale"}, ["zz"]]]}, ["a"]).fit(data)
    with pytest.raises(ValueError, match="target"):
        S.SpecEstimator(spec(["model", {"kind": "ridge"}]), ["a"]).fit(data)


def test_search_halves_and_refits(data):
    s = spec(["model", {"kind": "ridge"}])
    candidates = S.grid({"model__alpha": [0.01, 10.0, 1e3, 1e5]})
    found = S.search(data, s, ["a", "b", "c"], "y", "id", candidates, "rmse", folds=2, halving=2)
    assert found.options == {"model__alpha": 0.01}
    assert [(t["rung"], t["candidate"]) for t in found.trials][:4] == [(0, 0), (0, 1), (0, 2), (0, 3)]
    last = max(t["rung"] for t in found.trials)
    assert {t["rows"] for t in found.trials if t["rung"] == last} == {180} and len([t for t in found.trials if t["rung"] == last]) == 2
    whole = S.SpecEstimator(S.set_options(s, found.options), ["a", "b", "c"], "y").fit(data)
    assert found.model.model.coefficients == pytest.approx(whole.model.coefficients)
    with pytest.raises(ValueError, match="groups or times"):
        S.search(data, s, ["a"], "y", "id", candidates, "rmse", halving=2, group="c")
    with pytest.raises(ValueError, match="fits"):
        S.search(data, s, ["a"], "y", "id", candidates * 50, "rmse")
    with pytest.raises(ValueError, match="no candidate"):
        S.search(data, s, ["a"], "y", "id", [{"model__alpha": float("nan")}], "rmse", folds=2)
    with pytest.raises(ValueError, match="candidates"):
        S.grid({"a": [*range(20)], "b": [*range(20)]})
