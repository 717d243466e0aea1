import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.columns import group_quantiles, ordered_rank, shuffled_rank
from tabloom.operators import metrics as M
from tabloom.operators import prepare as P
from tabloom.operators import profile as E
from tabloom.operators import splits as V
from tabloom.operators import temporal as T
from tabloom.plans import gram as G
from tabloom.queries import QUERIES
from tabloom.sources import tables as S


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_ecdf_histogram_missing(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (4.0,), (None,)], "x double")
    assert rows(E.ecdf(df, "x"), "x") == [(1.0, 0.5), (2.0, 0.75), (4.0, 1.0)]
    assert rows(E.histogram(df, "x", 3), "bin") == [(0, 2), (1, 1), (2, 1)]
    assert rows(E.missing_bar(df)) == [("x", 1, 0.2)]


def test_correlation_uses_known_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1), (2.0, None, 1), (None, 4.0, 1), (4.0, 8.0, 1)], "x double, y double, constant int")
    out = {(r.a, r.b): (r.r, r.n) for r in E.correlation(df, ["x", "y", "constant"]).collect()}
    assert out["x", "y"] == (pytest.approx(1.0), 2)
    assert out["x", "constant"] == (None, 3)


def test_rolling_and_acf(spark):
    df = spark.createDataFrame([(3, 9.0), (1, 1.0), (2, 5.0), (4, 13.0)], "t int, v double")
    assert [r[-1] for r in rows(E.rolling_mean(df, "t", "v", 2), "t")] == [1, 3, 7, 11]
    s = spark.createDataFrame([(i, i + 1.0) for i in range(4)], "t int, x double")
    assert [r[1] for r in rows(E.autocorrelation(s, "t", "x", 3), "lag")] == pytest.approx([1, 0.25, -0.3, -0.45])


def test_temporal_frame_known_first_row(spark):
    df = spark.sql("select timestamp'2020-01-01' + make_interval(0,0,0,cast(id as int)) as time, cast(id as double) as y, cast(2*id as double) as known from range(12)")
    first = T.temporal_frame(df, "y", "time", None, [1, 2], [3], 2, ["known"]).orderBy("origin").first()
    assert (first.known, first.y__lag_1, first.y__lag_2, first.label) == (6, 2, 1, 4)
    assert (first.y__rolling_mean_3, first.y__rolling_std_3, first.y__rolling_min_3, first.y__rolling_max_3) == (1, 1, 0, 2)


def test_panels_never_mix_and_forecast_is_recursive(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.sql("select e, timestamp'2020-01-01' + make_interval(0,0,0,cast(id as int)) as time, cast(id + if(e = 'b', 100, 0) as double) as y from range(5) cross join (select explode(array('a','b')) e)")
    f = T.temporal_frame(df, "y", "time", "e", [1])
    assert f.where("label - y__lag_1 <> 1").count() == 0 and f.count() == 8
    out = T.forecast(df, lambda x: x.withColumn("prediction", F.col("y__lag_1") + 1), "y", "time", "1 day", 3, "e", [1])
    assert [r.y for r in out.where("e = 'a'").orderBy("time").collect()] == [5, 6, 7]
    assert [r.y for r in out.where("e = 'b'").orderBy("time").collect()] == [105, 106, 107]


def test_regular_months(spark):
    df = spark.sql("select add_months(date'2020-01-01', cast(id as int)) :: timestamp as t from range(8)")
    assert T.regular(df, "t").first().regular
    assert not T.regular(df.where("t <> timestamp'2020-03-01'"), "t").first().regular


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a, b = rows(shuffled_rank(df.repartition(1), 3, "id"), "id"), rows(shuffled_rank(df.repartition(7), 3, "id"), "id")
    assert a == b and sorted(r[-1] for r in a) == list(range(1, 1001))
    assert [r[-1] for r in rows(ordered_rank(df, "id"), "id")] == list(range(1, 1001))


def test_groups_stay_together(spark):
    df = spark.range(300).withColumn("g", F.col("id") % 20)
    for out, col in ((V.group_holdout(df, "g"), "split"), (V.group_kfold(df, "g", 4), "fold")):
        assert V.plan_problems(out, "g", col).count() == 0
    assert {r["count"] for r in V.group_kfold(df, "g", 4).groupBy("fold").count().collect()} == {75}


def test_statistics_come_from_training_rows_only(spark):
    train = spark.createDataFrame([(0.0, "red"), (2.0, "blue"), (None, "red")], "x double, c string")
    other = spark.createDataFrame([(None, "green"), (100.0, None)], "x double, c string")
    assert [r.x for r in P.impute(train, ["x"]).transform(other).collect()] == [1.0, 100.0]
    assert [tuple(r)[2:] for r in P.onehot(train, "c").transform(other).collect()] == [(0, 0), (0, 0)]
    assert sorted(r.c__code for r in P.ordinal(train, "c").transform(other).collect()) == [-2, -1]
    freq = {r.c: r.c__freq for r in P.frequency(train, "c").transform(train.unionByName(other)).collect()}
    assert freq["red"] == pytest.approx(2 / 3) and freq["green"] == 0


def test_target_encoding_is_out_of_fold(spark):
    df = spark.createDataFrame([(f"k{i}", float(i), i % 3) for i in range(12)], "c string, y double, fold int")
    enc, _ = P.target_encode(df, "c", "y", "fold", 1.0)
    means = {f: np.mean([i for i in range(12) if i % 3 != f]) for f in range(3)}
    assert all(r.c__target == pytest.approx(means[r.fold]) for r in enc.collect())


def _xy(spark, n=400, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    y = 2 * x[:, 0] - x[:, 1] + 3 + 0.5 * r.normal(size=n)
    return x, y, spark.createDataFrame([(*map(float, a), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y double, fold int")


def test_ridge_and_lasso_meet_their_optimality_conditions(spark):
    x, y, df = _xy(spark)
    g = G.grams(df, ["a", "b", "c"], "y")[None]
    m = G.ridge(g, 5.0)
    e = y - x @ m.coefficients - m.intercept
    assert np.abs(x.T @ e - 5 * m.coefficients).max() < 1e-6 and abs(e.sum()) < 1e-6
    m = G.lasso(g, 0.3)
    grad = (x - x.mean(0)).T @ (y - x @ m.coefficients - m.intercept) / len(y)
    on = m.coefficients != 0
    assert np.allclose(grad[on], 0.3 * np.sign(m.coefficients[on]), atol=1e-6) and (np.abs(grad[~on]) <= 0.3 + 1e-6).all()


def test_folds_from_one_pass_equal_separate_fits(spark):
    x, y, df = _xy(spark)
    by = G.grams(df, ["a", "b", "c"], "y", "fold")
    for r in G.cross_validate(by, [1.0]):
        t = np.arange(len(y)) % 4 != r["fold"]
        xc, yc = x[t] - x[t].mean(0), y[t] - y[t].mean()
        w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
        e = y[~t] - (x[~t] - x[t].mean(0)) @ w - y[t].mean()
        assert r["mse"] == pytest.approx((e**2).mean())


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert r.mape is None and r.r2 is None and r.gamma_deviance is None and r.mae == 1.5


def test_update_rows_refuses_double_edits(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(ValueError):
        S.update_rows(df, "k", twice)
    out = S.update_rows(df, "k", twice.limit(1), spark.createDataFrame([(3, "c")], "k long, v string"), spark.createDataFrame([(2,)], "k long"))
    assert sorted(r.k for r in out.collect()) == [1, 3]


def test_read_delimited_with_decimal_commas(spark, tmp_path):
    (tmp_path / "a.csv").write_text("признак;цель\n1,5;3\n2,5;5\n", encoding="utf-8-sig")
    df = S.coerce(S.read_delimited(spark, str(tmp_path / "a.csv")))
    assert sorted(tuple(r) for r in df.collect()) == [(1.5, 3.0), (2.5, 5.0)]
    (tmp_path / "b.csv").write_text("x,x\n1,2\n")
    with pytest.raises(ValueError):
        S.read_delimited(spark, str(tmp_path / "b.csv"))


def test_snapshots_and_library(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "x double")
    new = S.write_snapshot(df, str(tmp_path), "First", tags=["t"])
    assert S.read_snapshot(spark, str(tmp_path), new).where("x is null").count() == 1
    lib = spark.read.parquet(str(tmp_path / "library"))
    assert S.list_library(lib, "fir", ["t"]).count() == 1 and S.list_library(lib, "zzz").count() == 0


def test_groups_and_categories_beyond_the_limits(spark):
    df = spark.range(101).select(F.col("id"), F.concat(F.lit("g"), F.col("id")).alias("g"))
    with pytest.raises(ValueError, match="more than 100 groups"):
        V.leave_one_group_out(df, "g")
    some = V.leave_one_group_out(df.where("id < 99").unionByName(spark.createDataFrame([(99, None)], "id long, g string")), "g")
    assert some.columns == ["g", "id", "fold"]
    assert some.count() == 100 and sorted(r.fold for r in some.collect()) == list(range(100))
    many = spark.range(2500).select(F.format_string("v%05d", "id").alias("v"))
    assert rows(P.ordinal(many, "v").transform(many), "v") == [(f"v{i:05}", i) for i in range(2500)]
    with pytest.raises(ValueError, match="more than 2000 categories"):
        P.onehot(many, "v")
    assert len(P.categories(many, "v", limit=10)) == 10


def test_tfidf_query_takes_whole_texts(spark, tmp_path):
    from tabloom.queries import QUERIES

    texts = {0: "Größe über Größe été", 1: "привет мир привет", 2: "数据 処理 über", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = {k: re.findall(r"\b\w\w+\b", (v or "").lower()) for k, v in texts.items()}
    df = Counter(w for v in words.values() for w in set(v))
    want = {}
    for k, v in words.items():
        raw = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in Counter(v).items()}
        want |= {(k, w): x / math.sqrt(sum(y * y for y in raw.values())) for w, x in raw.items()}
    got = {(r.doc_id, r.term): r.weight for r in QUERIES["f15b_tfidf_whole_text"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-5) and (0, "größe") in got and (1, "привет") in got


def test_group_quantiles_order_few_values_only(spark):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, null, concat('g', id % 3)) g", "if(id % 11 = 0, null, (id * 7919 % 6007) / 8.0) v").unionByName(spark.createDataFrame([("all_null", None)], "g string, v double"))
    qs = [0.0, 0.1, 0.5, 0.75, 1.0]
    for by in ([], ["g"]):
        found = {tuple(r[:-1]): r[-1] for r in group_quantiles(rows, "v", qs, by).collect()}
        slow = {tuple(r[:-1]): r[-1] for r in rows.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).where("q is not null").collect()}
        assert found == slow
    import inspect

    assert not any("F.percentile" in inspect.getsource(f) for f in (E.box, M.regression_metrics))
    assert {r.g: (r.q50, r.n_out) for r in E.box(rows, "v", ["g"]).collect()}["all_null"] == (None, 0)
    assert group_quantiles(rows.where("v < 0"), "v", [0.5]).isEmpty()
    m = {r.g: (r.medae, r.n) for r in M.regression_metrics(rows.withColumn("p", F.lit(300.0)), "v", "p", ["g"]).collect()}
    slow = {r.g: (r.m, r.n) for r in rows.where("v is not null").groupBy("g").agg(F.percentile(F.abs(F.col("v") - 300), 0.5).alias("m"), F.count("v").alias("n")).collect()}
    assert m == slow


def test_tfidf_deals_chosen_terms_only(spark):
    docs = spark.createDataFrame([(1, "aa bb aa cc"), (1, "bb"), (2, "bb dd aa"), (3, None)], "id long, t string")
    out = P.tfidf(docs, "id", "t", 2, weights=False)
    assert rows(out, "id", "term") == [(1, "aa", 2), (1, "bb", 2), (2, "aa", 1), (2, "bb", 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    first = plan[plan.index("Aggregate [id#") :]
    assert "Join" in first[: first.index("Generate")]
    w = {(r.id, r.term): r.weight for r in P.tfidf(docs, "id", "t", 2).collect()}
    assert w[1, "aa"] == pytest.approx(0.5**0.5) and w[2, "bb"] == pytest.approx(0.5**0.5)


def test_scatter_of_repeated_keys_is_the_same_in_any_order(spark):
    df = spark.range(400).selectExpr("id % 3 as key", "cast(hash(id) as double) as x", "cast(id % 7 as double) as y")
    got = [sorted(map(tuple, E.scatter(d, "key", ["x", "y"], 50).collect())) for d in (df.repartition(5), df.orderBy("x").coalesce(1), df.orderBy(F.desc("x")).coalesce(1))]
    assert got[0] == got[1] == got[2]


def test_moments_of_many_features_are_block_sums(spark, monkeypatch):
    df = spark.range(3000).selectExpr("cast(id % 10 as double) as y", *[f"case when id % 97 = 0 and {i} = 3 then null else 1e3 + hash(id, {i}) % 1000 / 100.0 end as x{i}" for i in range(12)]).repartition(5)
    names = [f"x{i}" for i in range(12)]
    monkeypatch.setattr(G, "WIDE_ALONE", 30)
    want = G.grams(df, names, "y")[None]
    monkeypatch.undo()
    monkeypatch.setattr(G, "gram_table", None)  # one aggregate column for each pair of 12 features took most of a search
    got = G.grams(df, names, "y")[None]
    assert got.n == want.n and got.xx == pytest.approx(want.xx, rel=1e-9, abs=1e-6) and got.xy == pytest.approx(want.xy, rel=1e-9, abs=1e-6)


def test_unknown_predictions_do_not_count(spark):
    rows = [(1.0, 2.0), (2.0, 2.5), (4.0, None), (None, 3.0), (5.0, 4.0), (0.0, 0.0)]
    df = spark.createDataFrame(rows, "y double, p double")
    got = M.regression_metrics(df, "y", "p", medae=False).first().asDict()
    want = M.regression_metrics(df.dropna().withColumn("g", F.lit(1)), "y", "p", ["g"], medae=False).drop("g").first().asDict()
    assert got == want and got["n"] == 4
    made = df.withColumn("q", F.col("p") * 2 + 1)
    plan = M.regression_metrics(made, "y", "q", medae=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan


def test_scatter_takes_rows_that_share_a_key_as_they_are_stored(spark, tmp_path):
    # 500 rows end inside a key of three; later rows have smaller values.
    made = [(k, 1, 1000.0 - 300 * i - k % 7, 5.0 - i) for i in range(3) for k in range(1, 301)]
    spark.createDataFrame(made, "l_orderkey long, l_linenumber long, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    order = sorted(range(len(made)), key=lambda i: (hashlib.md5(f"3|{made[i][0] * 10 + 1}".encode()).hexdigest(), i))[:500]
    got = rows(QUERIES["e8_scatter"](spark, str(tmp_path)))
    assert sorted(got) == sorted((made[i][0] * 10 + 1, *made[i][2:]) for i in order)
