import math
from fractions import Fraction
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import columns
from tabloom.functions.columns import shuffled_rank
from tabloom.operators import metrics, models, profile
from tabloom.plans import robust


@pytest.fixture(scope="module")
def spoiled(spark):
    """y = 3 a - 2 b + 5 with small noise; three of ten rows far off, all to one side."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 2))
    y = x @ [3.0, -2.0] + 5 + 0.05 * rng.normal(size=400)
    y[:120] += 60 + 10 * x[:120, 0]
    return spark.createDataFrame([*[(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], (900, None, 1.0, 1.0), (901, 1.0, 1.0, float("nan"))], "key long, a double, b double, y double").repartition(4)


def test_ransac_and_theil_sen_ignore_outliers(spark, spoiled):
    m, out = robust.ransac(spoiled, ["a", "b"], "y", "key", threshold=0.5)
    assert [*m.coefficients, m.intercept] == pytest.approx([3, -2, 5], abs=0.02)
    flags = {r.key: r.inlier for r in out.collect()}
    assert all(flags[i] is (i >= 120) for i in range(400)) and flags[900] is None and flags[901] is None
    t = robust.theil_sen(spoiled, ["a", "b"], "y", "key")
    assert np.abs(np.array([*t.coefficients, t.intercept]) - [3, -2, 5]).max() < 1.0
    clean = robust.theil_sen(spoiled.where("key >= 120"), ["a", "b"], "y", "key", subsets=200)
    assert [*clean.coefficients, clean.intercept] == pytest.approx([3, -2, 5], abs=0.05)
    with pytest.raises(ValueError, match="are needed"):
        robust.theil_sen(spoiled.where("key < 2"), ["a", "b"], "y", "key")
    with pytest.raises(ValueError, match="determines"):
        robust.ransac(spoiled.withColumn("b", F.lit(1.0)), ["a", "b"], "y", "key")
    with pytest.raises(ValueError, match="known"):
        robust.ransac(spoiled.where("key = 900"), ["a", "b"], "y", "key")


def test_spatial_median_is_at_rest(spark, spoiled):
    t = robust.theil_sen(spoiled, ["a", "b"], "y", "key", subsets=50)
    fits = robust._subset_fits(robust._known(spoiled, ["a", "b"], "y", "key"), ["a", "b"], "y", 50, 3, 0)
    d = fits - [*t.coefficients, t.intercept]
    assert np.linalg.norm((d / np.linalg.norm(d, axis=1, keepdims=True)).sum(axis=0)) < 1e-3


def test_quadratic_discriminant(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(200, 2)), rng.normal(size=(100, 2)) @ [[3, 1], [0, 2]] + 1])
    y = np.array(["in"] * 200 + ["out"] * 100)
    df = spark.createDataFrame([*[(*map(float, r), str(c)) for r, c in zip(x, y, strict=True)], (None, 1.0, "in"), (float("nan"), 1.0, "in")], "a double, b double, c string")
    for reg in (0.0, 0.3):
        score = []
        for c in ("in", "out"):
            z = x[y == c]
            cov = (1 - reg) * np.cov(z.T) + reg * np.eye(2)
            d = x - z.mean(axis=0)
            score.append(np.log(len(z) / 300) - np.linalg.slogdet(cov)[1] / 2 - np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) / 2)
        got = [r.prediction for r in models.quadratic_discriminant(df, ["a", "b"], "c", reg).transform(df).collect()]
        assert got == [*np.where(score[0] >= score[1], "in", "out"), None, None]
    flat = df.withColumn("b", F.col("a") * 2)
    with pytest.raises(ValueError, match="no inverse"):
        models.quadratic_discriminant(flat, ["a", "b"], "c")
    assert models.quadratic_discriminant(flat, ["a", "b"], "c", 0.1).transform(flat).count() == 302


def test_silhouette(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(20, 2)), rng.normal(size=(15, 2)) + 4, [[9.0, 9.0]]])
    label = [0] * 20 + [1] * 15 + [2]
    rows = [(i, *map(float, r), c) for i, (r, c) in enumerate(zip(x, label, strict=True))] + [(90, 0.0, 0.0, -1), (91, None, 0.0, 0), (92, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "key long, a double, b double, c int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    label = np.array(label)
    s = []
    for i in range(36):
        a = d[i][(label == label[i]) & (np.arange(36) != i)]
        b = min(d[i][label == c].mean() for c in range(3) if c != label[i])
        s.append((b - a.mean()) / max(a.mean(), b) if len(a) else 0.0)
    got = metrics.silhouette(df, ["a", "b"], "c", "key").first()
    assert got.silhouette == pytest.approx(np.mean(s)) and (got.n, got.clusters) == (36, 3)
    assert metrics.silhouette(df, ["a", "b"], "c", "key", size=10).first().n == 10
    assert metrics.silhouette(df.where("c = 0"), ["a", "b"], "c", "key").first().silhouette is None


def test_adjusted_mutual_information(spark):
    def slow(pairs):
        n = len(pairs)
        a, b = ({v: sum(p[i] == v for p in pairs) for v in {p[i] for p in pairs}} for i in (0, 1))
        mi = sum(k / n * math.log(k * n / (a[p] * b[q])) for p in a for q in b if (k := pairs.count((p, q))))
        h = [-sum(v / n * math.log(v / n) for v in m.values()) for m in (a, b)]
        e = 0.0
        for x in a.values():
            for y in b.values():
                for k in range(max(1, x + y - n), min(x, y) + 1):
                    e += k / n * math.log(n * k / (x * y)) * float(Fraction(math.comb(x, k) * math.comb(n - x, y - k), math.comb(n, y)))
        return (mi - e) / (sum(h) / 2 - e)

    rng = np.random.default_rng(4)
    pairs = [(int(v), int(v) if rng.random() < 0.6 else int(rng.integers(0, 4))) for v in rng.integers(0, 3, 60)]
    df = spark.createDataFrame([*pairs, (None, 1), (1, None)], "r int, l int")
    f = lambda d: metrics.adjusted_mutual_information(d, "r", "l").first()[0]
    assert f(df) == pytest.approx(slow(pairs))
    assert f(df.withColumn("l", F.col("r") * 10)) == pytest.approx(1.0) and f(df.withColumns({"l": F.lit(1), "r": F.lit(1)})) == 1.0
    assert abs(f(spark.range(100000).selectExpr("hash(id) % 5 as r", "hash(id, 7) % 4 as l"))) < 1e-3
    with pytest.raises(ValueError, match="clusters"):
        metrics.adjusted_mutual_information(spark.range(2000).selectExpr("id as r", "1 as l"), "r", "l")


def test_qq(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(3, 2, 200)
    df = spark.createDataFrame([*[(float(x),) for x in v], (None,), (float("nan"),)], "x double").repartition(3)
    got = profile.qq(df, "x").orderBy("rank").collect()
    assert [r.value for r in got] == sorted(v) and [r.rank for r in got] == list(range(1, 201))
    medians = [1 - 0.5 ** (1 / 200), *[(i - 0.3175) / 200.365 for i in range(2, 200)], 0.5 ** (1 / 200)]
    assert [r.theoretical for r in got] == pytest.approx([NormalDist().inv_cdf(m) for m in medians])
    line = profile.qq_line(df, "x").first()
    assert [line.slope, line.intercept] == pytest.approx(np.polyfit([r.theoretical for r in got], sorted(v), 1)) and line.r > 0.98
    with pytest.raises(ValueError, match="three"):
        profile.qq(df.limit(2), "x")


def test_subsets_are_drawn_without_ranking_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    rows = [(i % 250, *map(float, r), float(2 * r[0] - r[1])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "key long, a double, b double, y double").repartition(5)
    known = robust._known(df, ["a", "b"], "y", "key")
    ranked = shuffled_rank(known, 3, "_key", name="_rank").where("_rank <= 30").orderBy("_rank").collect()
    want = np.array([np.linalg.lstsq(np.array([[r.a, r.b, 1.0] for r in ranked[i : i + 3]]), [r.y for r in ranked[i : i + 3]], rcond=None)[0] for i in range(0, 30, 3)])
    jobs = []
    monkeypatch.setattr(columns, "ranked", lambda *a, **k: jobs.append(a))
    assert robust._subset_fits(known, ["a", "b"], "y", 10, 3, 3) == pytest.approx(want) and not jobs
