"""Neighbours, clusters and resampling against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.columns import exact_quantiles, order_statistics
from tabloom.operators import learn, neighbors, prepare, resample, splits


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (120, 3)), rng.normal(4, 0.3, (60, 3)), np.repeat(rng.normal(0, 1, (4, 3)), 6, axis=0)]).round(3)
    rows = [(i * 3 % 1000, *map(float, r), "r" if r[0] > 0.8 else "c", None if i % 9 else 1.0) for i, r in enumerate(x)] + [(5000, None, 1.0, 1.0, "c", None), (5001, math.nan, 1.0, 1.0, "r", None)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label string, extra double").repartition(3).cache()


F3 = ["a", "b", "c"]


def known(points):
    rows = [r for r in points.collect() if r.a is not None and not math.isnan(r.a)]
    return sorted(rows, key=lambda r: r.id)


def dist(r, s):
    return float(np.sqrt(((np.array([r.a, r.b, r.c]) - np.array([s.a, s.b, s.c])) ** 2).sum()))


def brute_near(queries, rows, k):
    return {q.id: sorted((dist(q, s), s.id) for s in rows if s.id != q.id)[:k] for q in queries}


@pytest.mark.parametrize("block", [7, 2048])
@pytest.mark.parametrize("k", [1, 4, 500])
def test_nearest_equals_brute_force(points, k, block, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    got = {}
    for r in neighbors.nearest(points.where("id % 2 = 0"), points, "id", F3, k).collect():
        got.setdefault(r["query"], []).append((r.place, r.distance, r.key))
    rows = known(points)
    want = brute_near([r for r in rows if r.id % 2 == 0], rows, k)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [(d, i) for _, d, i in sorted(got[q])] == near


def test_nearest_of_empty_tables(points):
    none = points.limit(0)
    assert neighbors.nearest(points, none, "id", F3, 3).count() == 0
    assert neighbors.nearest(none, points, "id", F3, 3).count() == 0


@pytest.mark.parametrize("block", [5, 2048])
def test_within_equals_brute_force(points, block, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    rows = known(points)
    got = sorted((r.a, r.b) for r in neighbors.within(points, "id", F3, 0.6).collect())
    assert got == sorted((r.id, s.id) for r in rows for s in rows if r.id < s.id and dist(r, s) <= 0.6)


@pytest.mark.parametrize("members", [2, 1024])
def test_pairs_within_lists_the_rows_of_shared_places(points, members, monkeypatch):
    monkeypatch.setattr(neighbors, "MEMBERS", members)
    rows = known(points)
    got = sorted((r.a, r.b, r.distance) for r in neighbors.pairs_within(points, "id", F3, 0.6, 4).collect())
    want = sorted((r.id, s.id) for r in rows for s in rows if r.id < s.id and dist(r, s) <= 0.6)
    assert [g[:2] for g in got] == want
    at = {r.id: r for r in rows}
    assert [g[2] for g in got] == pytest.approx([dist(at[a], at[b]) for a, b in want], abs=5.1e-5)
    # Places, not rows, meet in the join: the six rows of a place are one.
    same = points.where("id < 5000").select(F.col("id"), F.lit(1.0).alias("a"), F.lit(-0.0).alias("b"))
    assert neighbors.pairs_within(same, "id", ["a", "b"], 0.1).count() == len(rows) * (len(rows) - 1) // 2


def test_pairs_within_deals_the_pairs_of_one_cell_over_tasks(spark, monkeypatch):
    for name, value in {"MEMBERS": 8, "PAIRS": 1 << 12}.items():
        monkeypatch.setattr(neighbors, name, value, raising=False)
    # 10 places of one cell, 60 rows at each, and one row beyond the radius of the rest.
    rows = spark.range(601).selectExpr("id", "if(id = 600, 9.05, id % 10 / 1000) as x", "0.0 as y")
    out = neighbors.pairs_within(rows, "id", ["x", "y"], 0.1, 4).withColumn("task", F.spark_partition_id()).toPandas()
    assert sorted(zip(out.a, out.b, strict=True)) == [(i, j) for i in range(600) for j in range(i + 1, 600)]
    assert out.distance.tolist() == pytest.approx((abs(out.a % 10 - out.b % 10) / 1000).tolist(), abs=5.1e-5)
    # Before, all were listed by one task.
    assert out.groupby("task").size().max() < len(out) / 4


@pytest.mark.parametrize("eps", [0.35, 0.7])
def test_dbscan_equals_brute_force(points, eps):
    rows = known(points)
    near = {r.id: [s.id for s in rows if dist(r, s) <= eps] for r in rows}
    core = {i for i, n in near.items() if len(n) >= 5}
    name = {}
    for i in sorted(core):
        if i not in name:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in name:
                    name[j] = i
                    todo += [x for x in near[j] if x in core]
    at = {r.id: r for r in rows}
    for r in rows:
        cores = sorted((dist(r, at[j]), j) for j in near[r.id] if j in core)
        if r.id not in core:
            name[r.id] = name[cores[0][1]] if cores else None
    got = {r.id: (r.core, r.cluster) for r in neighbors.dbscan(points, "id", F3, eps, 5).collect()}
    assert len(set(name.values())) > 2
    assert got == {i: (i in core, name[i]) for i in near} | {5000: (False, None), 5001: (False, None)}


def test_knn_predictions(points):
    rows = known(points)
    at = {r.id: r for r in rows}
    near = brute_near(rows, rows, 4)
    got = {r.id: r.prediction for r in neighbors.knn_predict(points, points, "id", F3, "c", 4).collect()}
    assert got[5000] is None
    assert all(got[i] == pytest.approx(np.mean([at[j].c for _, j in n])) for i, n in near.items())
    got = {r.id: r.prediction for r in neighbors.knn_predict(points, points, "id", F3, "c", 4, "distance").collect()}
    for i, n in near.items():
        w = [(1.0 if d == 0 else 0.0) if n[0][0] == 0 else 1 / d for d, _ in n]
        assert got[i] == pytest.approx(np.average([at[j].c for _, j in n], weights=w))
    got = {r.id: r.prediction for r in neighbors.knn_predict(points, points, "id", F3, "label", 4, classify=True).collect()}
    for i, n in near.items():
        labels = [at[j].label for _, j in n]
        assert got[i] == min(set(labels), key=lambda x: (-labels.count(x), x))


def test_radius_predictions(points):
    rows = known(points)
    train, rest = points.where("id % 3 = 0 and id % 2 = 0"), points.where("id % 2 = 1")
    got = {r.id: r.prediction for r in neighbors.radius_predict(train, rest, "id", F3, "c", 0.5).collect()}
    for r in rows:
        if r.id % 2 == 1:
            near = [s.c for s in rows if s.id % 3 == 0 and s.id % 2 == 0 and dist(r, s) <= 0.5]
            assert got[r.id] == (pytest.approx(np.mean(near)) if near else None)
    assert neighbors.radius_predict(train, rest, "id", F3, "label", 0.5, classify=True).where("prediction is null").count() == 0


def test_lof_equals_brute_force(points):
    rows = known(points)
    near = brute_near(rows, rows, 8)
    far = {i: n[-1][0] for i, n in near.items()}
    lrd = {i: 1 / (np.mean([max(d, far[j]) for d, j in n]) + 1e-10) for i, n in near.items()}
    got = {r.id: r.lof for r in neighbors.local_outlier_factor(points, "id", F3, 8).collect()}
    assert got == {i: pytest.approx(np.mean([lrd[j] for _, j in n]) / lrd[i]) for i, n in near.items()}


def test_knn_impute_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)).round(2)
    gaps = rng.random((60, 3)) < 0.2
    gaps[0] = True
    rows = [(i, *[None if g else float(v) for v, g in zip(r, m, strict=True)]) for i, (r, m) in enumerate(zip(x, gaps, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    train = df.where("id < 45")
    got = {r.id: (r.a, r.b, r.c) for r in neighbors.knn_impute(train, df, "id", F3, 3).collect()}
    for i, *v in rows:
        for j in range(3):
            if v[j] is not None:
                assert got[i][j] == v[j]
                continue
            cand = []
            for t, *w in rows[:45]:
                both = [q for q in range(3) if v[q] is not None and w[q] is not None]
                if t != i and w[j] is not None and both:
                    cand.append((math.sqrt(sum((w[q] - v[q]) ** 2 for q in both) * 3 / len(both)), t, w[j]))
            best = [c[2] for c in sorted(cand)[:3]] or [w[j] for _, *w in rows[:45] if w[j] is not None]
            assert got[i][j] == pytest.approx(np.mean(best))


def test_cleaning_by_neighbours(points):
    rows = known(points)
    at = {r.id: r for r in rows}
    one = {i: n[0][1] for i, n in brute_near(rows, rows, 1).items()}
    links = sorted((i, j) for i, j in one.items() if one[j] == i and i < j and at[i].label != at[j].label)
    assert sorted(tuple(r) for r in resample.tomek_links(points, "label", "id", F3).collect()) == links and links
    n = {x: sum(r.label == x for r in points.collect()) for x in "rc"}
    least = min(n, key=n.get)
    gone = {i for p in links for i in p if at[i].label != least}
    assert {r.id for r in resample.tomek(points, "label", "id", F3).collect()} == {r.id for r in points.collect()} - gone
    near = brute_near(rows, rows, 3)
    odd = {i for i, m in near.items() if at[i].label != least and any(at[j].label != at[i].label for _, j in m)}
    assert odd and {r.id for r in resample.enn(points, "label", "id", F3).collect()} == {r.id for r in points.collect()} - odd
    small = [r for r in rows if r.label == least]
    far = {i: np.mean([d for d, _ in m]) for i, m in brute_near([r for r in rows if r.label != least], small, 3).items()}
    best = sorted(far, key=lambda i: (far[i], i))[: n[least]]
    assert {r.id for r in resample.near_miss(points, "label", "id", F3).collect()} == set(best) | {r.id for r in points.collect() if r.label == least}


@pytest.mark.parametrize("danger", [None, "borderline", "adaptive"])
def test_smote_rows_lie_between_neighbours(points, danger):
    rows = known(points)
    made = resample.smote(points, "label", "id", F3, 4, 7, danger)
    n = {r.label: r["count"] for r in made.groupBy("label").count().collect()}
    before = {r.label: r["count"] for r in points.groupBy("label").count().collect()}
    least = min(before, key=before.get)
    if danger == "adaptive":
        assert abs(n[least] - max(before.values())) < 15
    else:
        assert n[least] == max(before.values()) == max(n.values())
    pool = [r for r in rows if r.label == least]
    near = brute_near(pool, pool, 4)
    at = {r.id: np.array([r.a, r.b, r.c]) for r in pool}
    new = made.where("synthetic").collect()
    assert new and all(r.label == least and r.id is None and r.extra is None for r in new)
    for r in new:
        p = np.array([r.a, r.b, r.c])
        assert any(np.linalg.norm(at[i] - p) + np.linalg.norm(at[j] - p) <= np.linalg.norm(at[i] - at[j]) + 1e-9 for i, m in near.items() for _, j in m)
    assert sorted(map(str, made.collect())) == sorted(map(str, resample.smote(points.repartition(5), "label", "id", F3, 4, 7, danger).collect()))


@pytest.mark.parametrize("how", ["enn", "tomek"])
def test_smote_with_cleaning(points, how):
    out = resample.smote_clean(points, "label", "id", F3, how)
    assert 0 < out.count() <= resample.smote(points, "label", "id", F3).count()
    assert set(out.columns) == {*points.columns, "synthetic"}


def test_order_statistics(spark, monkeypatch):
    from tabloom.functions import columns

    monkeypatch.setattr(columns, "HELD", 20)
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=3000), rng.integers(0, 7, 3000).astype(float), np.full(500, 2.5), np.r_[np.zeros(2900), rng.normal(size=100)]):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        assert order_statistics(df, "v", [0, 1, len(values) // 2, len(values) - 1]) == [sorted(values)[k] for k in (0, 1, len(values) // 2, len(values) - 1)]
        assert exact_quantiles(df, "v", [0.1, 0.5, 0.999]) == pytest.approx(np.quantile(values, [0.1, 0.5, 0.999]))
    assert exact_quantiles(df.limit(0), "v", [0.5]) == [None]


def test_null_keys_are_kept_or_refused(spark):
    rows = [(i, None if i % 5 == 0 else f"g{i % 6}", float(i), i % 3, i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, y double, fold int, t long")
    assert splits.group_holdout(df, "g").count() == 60
    assert splits.group_shuffle_splits(df, "g", 3).count() == 180
    assert splits.shuffle_splits(df, "id", 3, strata="g").count() == 180
    folds = splits.group_kfold(df.drop("fold"), "g", 3)
    assert folds.count() == 60 and splits.plan_problems(folds, "g").count() == 0
    assert splits.holdout(df, "id", strata="g").count() == 60
    train, model = prepare.target_encode(df, "g", "y", "fold")
    assert train.count() == 60 and train.where("g__target is null").count() == 0
    whole = model.transform(df.where("g is null")).select("g__target").distinct().collect()
    nulls = [r[2] for r in rows if r[1] is None]
    assert [r[0] for r in whole] == [pytest.approx((sum(nulls) + 10 * np.mean([r[2] for r in rows])) / (len(nulls) + 10))]
    over = prepare.random_over(df.where("g is null or g = 'g1'"), "g", "id")
    assert sorted(r["count"] for r in over.groupBy("g").count().collect()) == [12, 12]
    with pytest.raises(ValueError, match="null times"):
        splits.timeseries_splits(df.withColumn("t", F.when(F.col("t") > 3, F.col("t"))), "t")
    with pytest.raises(ValueError, match="5 groups"):
        splits.group_holdout(df.where("g in ('g1', 'g2')"), "g")


def test_envelope_finds_a_cluster_of_outliers(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (700, 2)), rng.normal(12, 0.5, (300, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    out = learn.elliptic_envelope(df, ["a", "b"], 0.3)(df.union(spark.createDataFrame([(-1, None, 1.0)], df.schema)))
    flags = {r.id: r.anomaly for r in out.collect()}
    assert flags[-1] is None and sum(v == -1 for v in flags.values()) == 300
    assert all(flags[i] == -1 for i in range(700, 1000))


def test_random_candidates_end_on_repeated_values():
    assert learn.random_candidates({"k": [1, 1]}, 2) == [{"k": 1}]
    assert len(learn.random_candidates({"k": [1, 1, 2], "m": (1, 3)}, 50)) == 6


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("kind", ["huber", "poisson", "gamma", "tweedie"])
def test_penalties_are_those_asked_for(spark, kind, weight):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = np.exp(0.5 * x[:, 0] - 0.3 * x[:, 1] + 0.4) * rng.gamma(5, 0.2, 300) + 0.01
    w = rng.integers(1, 5, 300).astype(float) if weight else np.ones(300)
    df = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, w, strict=True)], "a double, b double, y double, w double")
    options = {"variancePower": 1.5} if kind == "tweedie" else {"tol": 1e-9, "maxIter": 300} if kind == "huber" else {}
    model = learn.regressor(df, ["a", "b"], "y", kind, alpha=0.5, weight=weight, **options)
    beta = np.array([v for *_, v in model.coefficients()])
    last = model.pipeline.stages[-1]
    eta = x @ beta + last.intercept
    if kind == "huber":
        r = (y - eta) / last.scale
        assert x.T @ (w * np.clip(r, -1.35, 1.35)) * 2 == pytest.approx(2 * 0.5 * beta * last.scale, rel=2e-2, abs=2e-2) or x.T @ (w * np.clip(r, -1.35, 1.35)) == pytest.approx(0.5 * beta, rel=2e-2, abs=2e-2)
    else:
        power = {"poisson": 1, "gamma": 2, "tweedie": 1.5}[kind]
        mu = np.exp(eta)
        assert x.T @ (w * (y - mu) * mu ** (1 - power)) / w.sum() == pytest.approx(0.5 * beta, rel=1e-3, abs=1e-5)


def test_a_vector_is_sent_once_to_a_part_however_many_cells_it_visits(spark, monkeypatch):
    """In many dimensions no cell is excluded; 16 cells are one part here, so each query is sent once."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1100, 24))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    sent, meet = [], neighbors._meet

    def counted(queries, rows, function, schema, size):
        sent.append(queries.count())
        return meet(queries, rows, function, schema, size)

    monkeypatch.setattr(neighbors, "_meet", counted)
    got = {}
    for r in neighbors.nearest(df, df, "id", "v", 3).collect():
        got.setdefault(r["query"], []).append((r.place, r.key))
    assert sent == [1100, 1100]
    for i in range(0, 1100, 50):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = math.inf
        assert [k for _, k in sorted(got[i])] == np.argsort(d)[:3].tolist()


def test_nearest_far_from_the_origin(spark):
    """Products of vectors would lose these differences; plain distances decide."""
    x = [(i, 1e8 + i * 1e-3 * (-1) ** i, 1e-3 * (i % 7)) for i in range(200)] + [(1000 + i, 1e8, 0.0) for i in range(30)]
    df = spark.createDataFrame(x, "id long, a double, b double")
    got = {}
    for r in neighbors.nearest(df, df, "id", ["a", "b"], 4).collect():
        got.setdefault(r["query"], []).append((r.place, r.distance, r.key))
    for i, a, b in x:
        want = sorted((float(np.sqrt(((np.array([a, b]) - np.array([c, d])) ** 2).sum())), j) for j, c, d in x if j != i)[:4]
        assert [(d, j) for _, d, j in sorted(got[i])] == want


def test_knn_impute_searches_instead_of_comparing_all(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "_donors", lambda j, k: pytest.fail("all rows were compared"))
    df = spark.createDataFrame([(i, None if i % 7 == 0 else float(i % 5), float(i % 50)) for i in range(300)], "id long, gap double, b double")
    got = {r.id: r.gap for r in neighbors.knn_impute(df, df, "id", ["gap", "b"], 3).collect()}
    for i in range(0, 300, 7):
        near = sorted((abs(j % 50 - i % 50), j) for j in range(300) if j % 7)[:3]
        assert abs(got[i] - sum(j % 5 for _, j in near) / 3) < 1e-12


def test_copies_meet_once_in_radius_queries(spark, monkeypatch):
    """300 rows at 6 places: joins see the places, results count the rows."""
    seen, plain = [], neighbors.within

    def counted(df, *args, **kw):
        seen.append(df.count())
        return plain(df, *args, **kw)

    monkeypatch.setattr(neighbors, "within", counted)
    place = [(0.0, 0.0), (0.3, 0.0), (0.9, 0.0), (5.0, 5.0), (-0.0, 9.0), (0.0, 9.2)]
    rows = [(i, *place[i % 6], float(i), "x" if i % 12 < 6 else "y") for i in range(300)] + [(900, None, 0.0, 1.0, "x"), (901, 20.0, 20.0, 1.0, "y")]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, cls string")
    near = lambda r, s, d: None not in (r[1], s[1]) and math.dist(r[1:3], s[1:3]) <= d
    train, asked = [r for r in rows if r[0] % 5], [r for r in rows if r[0] % 5 == 0]
    got = {r.id: r.prediction for r in neighbors.radius_predict(df.where("id % 5 <> 0"), df.where("id % 5 = 0"), "id", ["a", "b"], "y", 0.5).collect()}
    assert got.keys() == {r[0] for r in asked}
    for q in asked:
        want = [t[3] for t in train if near(q, t, 0.5)]
        assert got[q[0]] is None if not want else abs(got[q[0]] - np.mean(want)) < 1e-9
    got = {r.id: r.prediction for r in neighbors.radius_predict(df.where("id % 5 <> 0"), df.where("id % 5 = 0"), "id", ["a", "b"], "cls", 0.5, True).collect()}
    for q in asked:
        votes = [t[4] for t in train if near(q, t, 0.5)] or [t[4] for t in train]
        assert got[q[0]] == max("xy", key=lambda c: (votes.count(c), c == "x"))
    out = {r.id: (r.core, r.cluster) for r in neighbors.dbscan(df, "id", ["a", "b"], 0.5, 60).collect()}
    want = {0: 0, 1: 0, 2: None, 3: None, 4: 4, 5: 4}
    assert all(out[i] == (want[i % 6] is not None, want[i % 6]) for i in range(300)) and out[900] == out[901] == (False, None)
    assert max(seen) <= 7


def test_order_statistics_of_weighted_and_infinite_values(spark, monkeypatch):
    from tabloom.functions import columns

    monkeypatch.setattr(columns, "HELD", 5)
    rng = np.random.default_rng(6)
    rows = [(float(v), int(w)) for v, w in zip(np.r_[rng.normal(size=200), rng.normal(size=50) * 1e200, [math.inf, -math.inf, math.inf]], rng.integers(1, 9, 253), strict=True)]
    df = spark.createDataFrame(rows, "v double, w int")
    want = sorted(v for v, w in rows for _ in range(w))
    at = [0, 1, 50, len(want) // 2, len(want) - 20, len(want) - 1]
    assert order_statistics(df, "v", at, "w") == [want[k] for k in at]
    few = df.where("abs(v) < 5")
    assert exact_quantiles(few, "v", [0.3, 0.5], "w") == pytest.approx(np.quantile([v for v, w in rows if abs(v) < 5 for _ in range(w)], [0.3, 0.5]))


def test_envelope_reads_each_place_once(spark, monkeypatch):
    """600 rows at 30 places: the concentration steps see places, with the cut of all rows."""
    seen, plain = [], learn.order_statistics

    def counted(df, *args):
        seen.append(df.count())
        return plain(df, *args)

    monkeypatch.setattr(learn, "order_statistics", counted)
    df = spark.createDataFrame([(i, float(i % 30 % 6), float(i % 30 % 5) + 100 * (i % 30 == 7)) for i in range(600)], "id long, a double, b double")
    out = learn.elliptic_envelope(df, ["a", "b"], 0.04)(df)
    bad = {r.id % 30 for r in out.where("anomaly = -1").collect()}
    assert bad == {7} and max(seen) == 30


def test_radius_means_do_not_depend_on_the_order_of_sums(spark):
    y = [0.1 * 3**i for i in range(25)] + [1 / (i + 3) for i in range(25)]
    train = [(i, 0.001 * i, v) for i, v in enumerate(y)]
    df = spark.createDataFrame([*train, (100, 0.02, 0.0)], "id long, a double, y double").repartition(4)
    got = neighbors.radius_predict(df.where("id < 100"), df.where("id = 100"), "id", ["a"], "y", 1.0).first().prediction
    assert got == pytest.approx(math.fsum(y) / 50, rel=3e-16)


def test_nearest_meets_few_rows_of_a_place(spark, monkeypatch):
    """Three places of 400 rows and 20 rows alone: no more than k + 1 rows of a place are held, and the nearest are those of brute force."""
    rows, assign = [], neighbors._assign
    monkeypatch.setattr(neighbors, "_assign", lambda df, pivots, name: (rows.append((name, df.count())), assign(df, pivots, name))[1])
    data = [(i * 7 % 1200, float(i % 3), 0.0) for i in range(1200)] + [(2000 + i, 0.5 + i, 1.0) for i in range(20)]
    df = spark.createDataFrame(data, "key long, a double, b double")
    found = {(r["query"], r["place"]): (r["key"], r["distance"]) for r in neighbors.nearest(df, df, "key", ["a", "b"], 4).collect()}
    assert dict(rows) == {"key": 3 * 5 + 20, "query": 1220} and len(found) == 4 * 1220
    for key, a, b in [*data[::60], *data[-20:]]:
        best = sorted((((a - x) ** 2 + (b - y) ** 2) ** 0.5, k) for k, x, y in data if k != key)[:4]
        assert [found[key, i + 1] for i in range(4)] == [(k, pytest.approx(d)) for d, k in best]
