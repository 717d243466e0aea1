"""Ensembles against hand calculations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import ensembles as N
from tabloom.operators import learn as L


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(160, 2)).round(3)
    y = x[:, 0] * 2 + np.abs(x[:, 1]) + rng.normal(size=160) * 0.1
    rows = [(i, *map(float, r), float(a), "c" + str(int(a > 0.5) + int(a > 2))) for i, (r, a) in enumerate(zip(x, y, strict=True))] + [(999, None, 0.0, 1.0, "c1")]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, k string").repartition(2).cache()


AB = ["a", "b"]


def test_adaboost_weights_are_those_of_samme(data):
    model = N.adaboost_classifier(data, "id", AB, "k", rounds=3)
    rows = [r for r in data.collect() if r.a is not None]
    preds = [{r.id: r.prediction for r in m.transform(data).collect()} for m in model.members]
    w = {r.id: 1 / len(rows) for r in rows}
    for m, p, alpha in zip(model.trace, preds, model.weights, strict=True):
        e = sum(w[r.id] for r in rows if p[r.id] != r.k) / sum(w.values())
        assert (m["error"], alpha) == (pytest.approx(e), pytest.approx(np.log((1 - e) / e) + np.log(2)))
        w = {r.id: w[r.id] * (np.exp(alpha) if p[r.id] != r.k else 1) for r in rows}
    out = {r.id: r.prediction for r in model.transform(data).collect()}
    assert out[999] is None and len(out) == 161
    for r in rows:
        votes = {c: sum(a for p, a in zip(preds, model.weights, strict=True) if p[r.id] == c) for c in ("c0", "c1", "c2")}
        assert votes[out[r.id]] == pytest.approx(max(votes.values()))


def test_adaboost_regressor_predicts_the_weighted_median(data, tmp_path):
    model = N.adaboost_regressor(data, "id", AB, "y", rounds=3)
    preds = [{r.id: r.prediction for r in m.transform(data).collect()} for m in model.members]
    out = {r.id: r.prediction for r in model.transform(data).collect()}
    assert out[999] is None
    for i in range(0, 160, 7):
        pairs = sorted((p[i], w) for p, w in zip(preds, model.weights, strict=True))
        at = np.searchsorted(np.cumsum([w for _, w in pairs]), sum(model.weights) / 2 * (1 - 1e-12))
        assert out[i] == pytest.approx(pairs[at][0])
    model.save(data, str(tmp_path / "e"))
    again = N.load_ensemble(data, str(tmp_path / "e"))
    assert {r.id: r.prediction for r in again.transform(data).collect()} == out


def test_bagging_averages_members_of_poisson_weights(data):
    model = N.bagging(data, "id", AB, "y", members=3, maxDepth=2)
    preds = [{r.id: r.prediction for r in m.transform(data).collect()} for m in model.members]
    out = {r.id: r.prediction for r in model.transform(data).collect()}
    assert all(out[i] == pytest.approx(np.mean([p[i] for p in preds])) for i in range(160)) and out[999] is None
    assert len({p[0] for p in preds}) > 1
    counts = data.sparkSession.range(20_000).select(N._poisson(N._uniform(0, 1, "id"), 1.0).alias("n")).groupBy("n").count().collect()
    share = {int(r.n): r["count"] / 20_000 for r in counts}
    assert share[0] == pytest.approx(np.exp(-1), abs=0.02) and share[2] == pytest.approx(np.exp(-1) / 2, abs=0.02)
    soft = N.bagging(data, "id", AB, "k", classify=True, members=2, max_samples=0.8, bootstrap=False)
    assert soft.kind == "soft" and soft.transform(data).where("prediction = k").count() > 120


def test_voting(data):
    a, b = L.classifier(data, AB, "k", "logistic"), L.classifier(data, AB, "k", "tree")
    pa, pb = ({r.id: r for r in m.transform(data).collect()} for m in (a, b))
    hard = {r.id: r.prediction for r in N.voting([a, b], [2.0, 1.0], a.classes).transform(data).collect()}
    assert all(hard[i] == pa[i].prediction for i in range(160)) and hard[999] is None
    soft = {r.id: r for r in N.voting([a, b], None, a.classes, soft=True).transform(data).collect()}
    assert all(soft[i].probabilities == pytest.approx((np.array(pa[i].probabilities) + pb[i].probabilities) / 2) for i in range(0, 160, 9))
    with pytest.raises(ValueError, match="same classes"):
        N.voting([a], None, ["x"], soft=True)


def test_stacking_never_sees_its_own_fold(data):
    seen = []

    def member(rows):
        seen.append({r.id for r in rows.select("id").collect()})
        return L.regressor(rows, AB, "y", "tree", maxDepth=2)

    known = data.where("id < 999")
    oof = {r.id: r for r in N.out_of_fold(known, "id", [member], 4).collect()}
    assert len(oof) == 160 and len(seen) == 4
    for i, r in oof.items():
        assert sum(i not in s for s in seen) == 1 and i not in seen[r._fold]
    model = N.stacking(data, "id", [member, lambda d: L.regressor(d, AB, "y", "huber")], "y", folds=3, alpha=0.1)
    out = model.transform(data)
    assert out.count() == 161 and out.where("prediction is null").count() == 1
    assert out.where("id < 999").agg(F.corr("prediction", "y")).first()[0] > 0.9
    classes = N.stacking(data, "id", [lambda d: L.classifier(d, AB, "k", "logistic"), lambda d: L.classifier(d, AB, "k", "tree")], "k", "logistic", True, 3)
    assert classes.transform(data).where("prediction = k").count() > 125


def _equal(spark):
    """2,000 rows of 25 distinct pairs of features and two classes."""
    return spark.range(2000).selectExpr("id", "cast(id % 5 as double) a", "cast(id * 7 % 25 div 5 as double) b", "1e6 + id % 5 * 3.0 + (id % 25 div 5) * 0.5 + id * 37 % 11 y", "if((id % 5 + id * 13 % 4) > 3, 'u', 'v') k")


def _fitted_rows(monkeypatch):
    seen, fit = [], L._fit
    monkeypatch.setattr(L, "_fit", lambda df, *a: (seen.append(df.count()), fit(df, *a))[1])
    return seen


def test_boosting_weighs_equal_rows_once(spark, monkeypatch):
    rows, seen = _equal(spark), _fitted_rows(monkeypatch)
    merged = N.adaboost_classifier(rows, "id", AB, "k", rounds=3)
    assert max(seen) <= 50
    monkeypatch.setattr(L, "mergeable", lambda options: False)
    plain = N.adaboost_classifier(rows, "id", AB, "k", rounds=3)
    assert max(seen) == 2000
    assert [t["error"] for t in merged.trace] == pytest.approx([t["error"] for t in plain.trace]) and merged.weights == pytest.approx(plain.weights)
    assert merged.transform(rows).select("id", "prediction").exceptAll(plain.transform(rows).select("id", "prediction")).isEmpty()


def test_bagged_trees_fit_equal_features_once(spark, monkeypatch):
    rows, seen = _equal(spark), _fitted_rows(monkeypatch)
    merged = {r.id: r.prediction for r in N.bagging(rows, "id", AB, "y", members=2, maxDepth=3).transform(rows).collect()}
    assert max(seen) <= 50
    monkeypatch.setattr(L, "mergeable", lambda options: False)
    plain = {r.id: r.prediction for r in N.bagging(rows, "id", AB, "y", members=2, maxDepth=3).transform(rows).collect()}
    assert max(seen) > 1000
    assert merged == pytest.approx(plain, rel=1e-12)
    with pytest.raises(ValueError, match="bad_target"):
        L.regressor(rows.withColumn("y", F.when(F.col("id") == 3, float("inf")).otherwise(F.col("y"))), AB, "y", "tree")


def test_stacked_huber_fits_equal_rows_once(spark, monkeypatch):
    rows, seen = _equal(spark), _fitted_rows(monkeypatch)
    model = L.regressor(rows.withColumn("w", F.lit(1.0)), AB, "y", "huber", weight="w")
    assert max(seen) <= 275
    plain = L._fit(rows.withColumn("y", F.col("y").cast("double")), AB, "y", L.MR.LinearRegression(loss="huber", regParam=0.0, standardization=False, labelCol="y"))
    assert [c[2] for c in model.coefficients()] == pytest.approx([c[2] for c in plain.coefficients()], abs=1e-5)
