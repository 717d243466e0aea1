"""Gradient fits are stationary points of what they minimise."""

import numpy as np
import pytest

from tabloom.operators import gradient as D


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 3)) * [1, 5, 0.2] + [0, 3, 0]
    y = x @ [1.5, -0.4, 2] + 0.7 + rng.standard_t(3, 240) * 0.5
    z = np.where(y + rng.normal(size=240) > 0, "yes", "no")
    k = np.digitize(y, [-1.5, 1.0])
    w = rng.integers(1, 4, 240).astype(float)
    rows = [(i, *map(float, r), float(a), str(b), f"c{c}", float(d)) for i, (r, a, b, c, d) in enumerate(zip(x, y, z, k, w, strict=True))] + [(999, None, 1.0, 1.0, 1.0, "yes", "c0", 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, z string, k string, w double").repartition(3).cache()
    return df, x, y, np.where(z == "yes", 1.0, -1.0), k, w


F3 = ["a", "b", "c"]


def objective(loss, x, y, w, beta, b, penalty, alpha, width=1e-9, **o):
    value, _ = D.loss_and_slope(loss, x @ beta + b, y, width, **o)
    return np.average(value, weights=w) + alpha * {"none": 0, "l1": np.abs(beta).sum(), "l2": beta @ beta / 2, "elasticnet": 0.15 * np.abs(beta).sum() + 0.85 * beta @ beta / 2}[penalty]


@pytest.mark.parametrize(("loss", "penalty"), [*[(x, "l2") for x in D.LOSSES], ("squared", "l1"), ("hinge", "l1"), ("log", "elasticnet")])
def test_no_nearby_point_is_better(data, loss, penalty):
    df, x, y, z, _, w = data
    classify = loss in D.CLASSIFIERS
    options = {"epsilon": 0.3} if "epsilon" in loss or loss == "huber" else {"quantile": 0.3} if loss == "pinball" else {}
    model = D.gradient_fit(df, F3, "z" if classify else "y", loss, penalty, 0.05, weight="w", epochs=60, smooth=0.02, **options)
    beta, b, t = np.array(model.coefficients[0]), model.intercepts[0], z if classify else y
    here = objective(loss, x, t, w, beta, b, penalty, 0.05, **options)
    slack = 0.02 if loss in D.KINKED else 1e-6
    rng = np.random.default_rng(0)
    for size in (1.0, 0.1, 0.01):
        for d in [*np.eye(4), *-np.eye(4), *rng.normal(size=(40, 4))]:
            assert objective(loss, x, t, w, beta + size * d[:3] / [1, 5, 0.2], b + size * d[3], penalty, 0.05, **options) >= here - slack
    assert model.trace[-1][1] <= model.trace[0][1] + 1e-9
    if loss == "squared" and penalty == "l2":
        x1 = np.column_stack([x, np.ones(len(x))])
        exact = np.linalg.solve((x1 * w[:, None]).T @ x1 / w.sum() + np.diag([0.05] * 3 + [0]), x1.T @ (w * y) / w.sum())
        assert [*beta, b] == pytest.approx(exact, rel=1e-5)


def test_strong_l1_gives_zeros_and_elasticnet_lies_between(data):
    df, *_ = data
    model = D.gradient_fit(df, F3, "y", "squared", "l1", 1e3, epochs=30)
    assert model.coefficients == [[0.0, 0.0, 0.0]]
    model = D.gradient_fit(df, F3, "y", "squared", "elasticnet", 0.1, epochs=60)
    assert all(model.coefficients[0])


def test_batches_trace_and_schedules(data):
    df, x, y, *_ = data
    train, held = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    for schedule in ("constant", "invscaling", "adaptive"):
        model = D.gradient_fit(train, F3, "y", "huber", epochs=8, batches=3, key="id", schedule=schedule, step=0.5, validation=held, epsilon=1.0)
        assert [e for e, *_ in model.trace] == [*range(1, len(model.trace) + 1)]
        assert model.trace[-1][1] < 0.7 * model.trace[0][1] and model.trace[-1][2] < 0.7 * model.trace[0][2]
    with pytest.raises(ValueError, match="key"):
        D.gradient_fit(train, F3, "y", batches=2)
    with pytest.raises(ValueError, match="no rows"):
        D.gradient_fit(train.limit(0), F3, "y")


def test_many_classes_save_and_unknown_features(data, tmp_path):
    df, x, _, _, k, _ = data
    model = D.sgd_classifier(df, F3, "k", "log", alpha=1e-3, epochs=60)
    assert model.classes == ["c0", "c1", "c2"] and len(model.coefficients) == 3
    model.save(df, str(tmp_path / "m"))
    again = D.load_gradient_model(df, str(tmp_path / "m"))
    assert again == model
    out = {r.id: r for r in again.transform(df).collect()}
    assert out[999].prediction is None
    eta = x @ np.array(model.coefficients).T + model.intercepts
    assert [out[i].prediction for i in range(240)] == [f"c{c}" for c in eta.argmax(axis=1)]
    assert np.mean(eta.argmax(axis=1) == k) > 0.6
    two = D.perceptron(df, F3, "z", epochs=40)
    assert len(two.coefficients) == 1 and two.transform(df).where("prediction = z").count() > 190


def test_quantiles_and_one_class(data):
    df, x, y, *_ = data
    for q in (0.2, 0.8):
        model = D.quantile_regression(df, F3, "y", q, epochs=60)
        below = model.transform(df.where("id < 999")).where("y < prediction").count() / 240
        assert below == pytest.approx(q, abs=0.06)
    svr = D.linear_svr(df, F3, "y", 10.0, 0.2, epochs=60)
    assert svr.coefficients[0] == pytest.approx([1.5, -0.4, 2], abs=0.5)
    away = df.selectExpr("id", "a + 6 AS a", "c * 5 + 6 AS c")
    score = D.one_class_svm(away, ["a", "c"], 0.2, epochs=90, smooth=0.01)
    assert score(away).where("anomaly = -1").count() == pytest.approx(0.2 * 240, abs=24)
    assert score(away).where("id = 999").first().anomaly is None
