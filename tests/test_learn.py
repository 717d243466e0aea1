import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import checks, learn, metrics, profile, splits


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=300) > 0.5, "yes", np.where(x[:, 1] > 0.5, "maybe", "no"))
    rows = [(i, *map(float, r), str(c), float(np.exp(0.5 * r[0] + 1))) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "key long, a double, b double, c double, cls string, pos double").cache()


def test_logistic_regression_is_at_the_optimum(spark, data):
    """The gradient of the sum of losses / n + |w|^2 / (2 C n) vanishes; probabilities sum to one."""
    m = learn.classifier(data, ["a", "b", "c"], "cls", C=2.0)
    rows = m.transform(data).collect()
    x, p = np.array([[r.a, r.b, r.c] for r in rows]), np.array([r.probabilities for r in rows])
    y = np.array([[r.cls == c for c in m.classes] for r in rows], float)
    w = np.array([[v for f, c, v in m.coefficients() if c == k] for k in m.classes])
    assert m.classes == ["maybe", "no", "yes"] and p.sum(axis=1) == pytest.approx(np.ones(300))
    gradient = (p - y).T @ x / 300 + w / (2.0 * 300)
    assert np.abs(gradient).max() < 1e-4
    aligned = m.probabilities(data, ["no", "never", "yes"]).first()
    assert len(aligned.probabilities) == 3 and aligned.probabilities[1] == 0.0


def test_balanced_weights_move_the_rare_class(data):
    plain = learn.classifier(data, ["c"], "cls").transform(data).where("prediction = 'maybe'").count()
    balanced = learn.classifier(data, ["c"], "cls", balanced=True).transform(data).where("prediction = 'maybe'").count()
    assert balanced > plain
    with pytest.raises(ValueError, match="either"):
        learn.classifier(data, ["c"], "cls", balanced=True, weight="a")


@pytest.mark.parametrize("kind", ["linear_svc", "mlp", "forest"])
def test_classifiers_learn_the_signal(data, kind):
    out = learn.classifier(data, ["a", "b"], "cls", kind).transform(data)
    assert out.where("prediction = cls").count() > 240


def _fitted_rows(monkeypatch):
    """How many rows each fit of classifier() reads, in a list that fills as it runs."""
    rows, fit = [], learn._fit
    monkeypatch.setattr(learn, "_fit", lambda df, *a, **k: rows.append(df.count()) or fit(df, *a, **k))
    return rows


def test_linear_svc_fits_equal_rows_as_one(spark, monkeypatch):
    """Hinge loss of the copies as of one row with their number: x = -1 no, 0.5 no twice as often as yes, 1 yes."""
    data = spark.range(4000).select((F.col("id") % 4).alias("k")).selectExpr("array(-1.0D, 0.5D, 0.5D, 1.0D)[k] AS x", "CASE WHEN k = 3 OR k = 2 AND rand(1) < 0.6 THEN 'yes' ELSE 'no' END AS y").cache()
    rows = _fitted_rows(monkeypatch)
    m = learn.classifier(data, ["x"], "y", "linear_svc", maxIter=20)
    assert rows == [4]
    weighted = learn.classifier(data.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), ["x"], "y", "linear_svc", weight="n", maxIter=20)
    assert m.coefficients()[0][2] == pytest.approx(weighted.coefficients()[0][2], rel=1e-6)
    low = m.transform(data).groupBy("x").agg(F.max("prediction").alias("p")).orderBy("x").collect()
    assert [r.p for r in low] == ["no", "no", "yes"]


def test_perceptron_fits_equal_rows_as_one(spark, data, monkeypatch):
    """As many copies of every row change nothing but the rows read; the loss is no worse than where Spark's own steps end."""
    copies = data.crossJoin(spark.range(5).select(F.lit(1).alias("one")))
    rows = _fitted_rows(monkeypatch)
    m = learn.classifier(copies, ["a", "b"], "cls", "mlp")
    assert rows and max(rows) == 300
    own = learn._fit(data, ["a", "b"], "cls", learn.MC.MultilayerPerceptronClassifier(labelCol="_label", layers=[2, 8, 3], seed=0), "_label")

    def loss(model):
        return -np.mean([np.log(r.probabilities[model.classes.index(r.cls)]) for r in model.transform(data).collect()])

    assert loss(m) < loss(own) + 0.01
    heavy = learn.classifier(data, ["a", "b"], "cls", "mlp", balanced=True).transform(data).where("prediction = 'maybe'").count()
    assert heavy >= m.transform(data).where("prediction = 'maybe'").count()


def test_saved_models_predict_the_same(spark, data, tmp_path):
    m = learn.classifier(data, ["a", "b"], "cls")
    m.save(str(tmp_path / "m"))
    again = learn.load(str(tmp_path / "m"))
    assert again.features == ["a", "b"] and again.classes == m.classes
    one, two = ({r.key: (r.prediction, r.probabilities) for r in x.transform(data.drop("cls")).collect()} for x in (m, again))
    assert one == two


def test_regressors_and_their_domains(data):
    c = {f: v for f, _, v in learn.regressor(data, ["a", "b"], "pos", "gamma").coefficients()}
    assert c["a"] == pytest.approx(0.5, abs=1e-3) and abs(c["b"]) < 1e-3
    with pytest.raises(ValueError, match="bad_domain"):
        learn.regressor(data, ["a"], "b", "gamma")
    huber = {f: v for f, _, v in learn.regressor(data.withColumn("y", 3 * F.col("a") + F.when(F.col("key") % 50 == 0, 500).otherwise(0)), ["a", "b"], "y").coefficients()}
    assert huber["a"] == pytest.approx(3, abs=0.05)


def test_importance_and_view(data):
    m = learn.classifier(data, ["a", "c"], "cls")
    share = lambda d: d.agg(F.avg((F.col("prediction") == F.col("cls")).cast("int"))).first()[0]
    got = {f: mean for f, mean, _ in learn.permutation_importance(m, data, "key", share, "accuracy", repeats=2)}
    assert got["a"] > 0.1 > abs(got["c"])
    view = learn.prediction_view(m, data, ["a"], 5).orderBy("a").collect()
    ends = data.agg(F.min("a"), F.max("a")).first()
    assert len(view) == 5 and (view[0].a, view[-1].a) == pytest.approx(tuple(ends)) and view[-1].prediction == "yes"


def test_clusters_anomalies_and_decompositions(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(100, 2)) + m for m in ((0, 0), (20, 0), (0, 20))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "key long, a double, b double")
    for kind in ("kmeans", "bisecting", "gaussian_mixture"):
        sizes = sorted(r.n for r in learn.cluster_sizes(learn.clusters(df, ["a", "b"], 3, kind).transform(df)).collect())
        assert sum(sizes) == 300 and (kind == "bisecting" or sizes == [100, 100, 100])
    odd = df.where("key < 100").unionByName(spark.createDataFrame([(1000 + i, 30.0 + i, -30.0) for i in range(5)], df.schema))
    marked = learn.elliptic_envelope(odd, ["a", "b"], 0.05)(odd).where("anomaly = -1").select("key").collect()
    assert {r.key for r in marked} >= {1000, 1001, 1002, 1003, 1004} and len(marked) <= 7
    s, parts, transform = learn.truncated_svd(df, ["a", "b"], 1)
    assert s[0] == pytest.approx(np.linalg.svd(x)[1][0])
    assert learn.reconstruction_mse(df, ["a", "b"], parts).first()[0] == pytest.approx(np.linalg.svd(x)[1][1] ** 2 / x.size)
    assert "d0" in transform(df).columns


def test_search_space_and_scores(spark):
    c = learn.random_candidates({"alpha": (0.01, 10.0, "log"), "depth": (1, 3)}, 20, seed=1)
    assert len(c) == 20 and all(0.01 <= x["alpha"] <= 10 and 1 <= x["depth"] <= 3 for x in c)
    assert len(learn.random_candidates({"k": [1, 2, 3]}, 10)) == 3
    with pytest.raises(ValueError, match="low must be below"):
        learn.random_candidates({"alpha": (1.0, 0.1)}, 2)
    scores = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (2, 0, 0.1), (2, 1, None), (3, 0, 1.0), (3, 1, 1.5)], "candidate int, fold int, score double")
    assert {r.candidate: r.place for r in learn.candidate_scores(scores, 2, "rmse").collect()} == {3: 1, 1: 2, 2: None}
    with pytest.raises(ValueError, match="unknown metric"):
        checks.direction("nope")


def test_checks(spark):
    df = spark.createDataFrame([(1.0, 1.0, "g"), (-1.0, 0.0, None), (float("nan"), -2.0, "h"), (None, 1.0, "h")], "y double, w double, g string")
    r = checks.target_problems(df, "y", weight="w", group="g", model="poisson").first()
    assert (r.bad_target, r.bad_domain, r.bad_weight, r.no_weight, r.null_group) == (2, 1, 1, 0, 1)
    kept, lost = checks.known_target(df, "y")
    assert (kept.count(), lost) == (2, 2)
    assert checks.negative_features(df.where("not isnan(y)"), ["y", "w"]) == ["y"]
    assert checks.select_features(df, "y", drop=["g"]) == ["w"]
    with pytest.raises(ValueError, match="no such columns: z"):
        checks.select_features(df, "y", drop=["z"])
    assert checks.target_problems(spark.createDataFrame([(31.0,), (2.5,), (3.0,)], "y double"), "y", "ranking").first().bad_target == 2


def test_small_measures(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "y")], "r string, l string")
    assert [round(v, 9) for v in metrics.cluster_information(df, "r", "l").first()] == [1, 1, 1, 1, 1]
    with pytest.raises(ValueError, match="two classes"):
        metrics.binary_averages(df.withColumn("l", F.lit("z")), "r", "l", "a")
    texts = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",), (None,)], "v string")
    assert {(r.value, r.n) for r in profile.auto_histogram(texts, "v", top=1).collect()} == {("a", 3), (None, 3)}
    rows = spark.range(1, 16).select(F.col("id"), F.col("id").cast("double").alias("t"))
    parts = splits.ordered_holdout(rows, "t", 0.5, 0.3).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"train": 7, "validation": 5, "test": 3}
    with pytest.raises(ValueError, match="more than"):
        splits.leave_one_out(rows, "id", 10)


def test_equal_rows_are_fitted_as_one(spark, monkeypatch):
    """Copies reach the solver once, with their number; the model is that of all rows."""
    seen, plain = [], learn._fit

    def counted(df, *args):
        seen.append(df.count())
        return plain(df, *args)

    monkeypatch.setattr(learn, "_fit", counted)
    rows = [(float(i % 5), float(i % 3), "yes" if (i % 5) + (i % 7 == 0) * 3 > 2 else "no") for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    got = learn.classifier(df, ["a", "b"], "y")
    assert seen == [len(set(rows))]
    solver = learn.MC.LogisticRegression(regParam=1 / len(rows), standardization=False, maxIter=200, tol=1e-9, labelCol="_label")
    assert [v for _, _, v in got.coefficients()] == pytest.approx([v for _, _, v in plain(df, ["a", "b"], "y", solver, "_label").coefficients()], abs=2e-3)
    with pytest.raises(Exception, match="(?i)weight"):
        learn.classifier(df.withColumn("w", F.when(F.col("a") == 0, -1.0).otherwise(1.0)), ["a", "b"], "y", weight="w")
