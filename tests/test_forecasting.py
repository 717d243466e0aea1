"""Forecast features, recursion with given inputs, and refusals."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import forecasting as T
from tabloom.operators import temporal


@pytest.fixture(scope="module")
def daily(spark):
    return spark.sql("select timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id as int)) as time, cast(id as double) as y, 2.0 * id as known from range(12)").repartition(3).cache()


@pytest.fixture(scope="module")
def panel(daily):
    return daily.withColumn("e", F.lit("a")).unionByName(daily.withColumn("e", F.lit("b")).withColumn("y", F.col("y") + 100)).cache()


def head(df, n):
    return df.where(F.col("time") < F.expr(f"timestamp'2020-01-01' + make_interval(0, 0, 0, {n})"))


def rows(df, a, b):
    return df.where(F.col("time").between(F.expr(f"timestamp'2020-01-01' + make_interval(0, 0, 0, {a})"), F.expr(f"timestamp'2020-01-01' + make_interval(0, 0, 0, {b - 1})")))


def plus_one(x):
    return x.withColumn("prediction", F.col("y__lag_1") + 1)


def test_recursion_ignores_future_targets(daily):
    for y in (20000.0, -999999.0):
        out = T.forecast(head(daily, 5), rows(daily, 5, 8).withColumn("y", F.lit(y)), plus_one, "y", "time", lags=[1], rolling=[]).orderBy("time").collect()
        assert [r.predicted for r in out] == [5.0, 6.0, 7.0] and [r.time for r in out] == [r.origin for r in out] == [r.time for r in rows(daily, 5, 8).orderBy("time").collect()]


def test_panels_keep_their_own_past_and_use_given_inputs(panel):
    model = lambda x: x.withColumn("prediction", F.col("y__lag_1") + 1 + 0 * F.col("y__rolling_mean_3") + F.col("known") * 0)
    out = T.forecast(head(panel, 5), rows(panel, 5, 8), model, "y", "time", "e", [1, 2], [3], ["known"])
    assert [r.predicted for r in out.where("e = 'a'").orderBy("time").collect()] == [5.0, 6.0, 7.0]
    assert [r.predicted for r in out.where("e = 'b'").orderBy("time").collect()] == [105.0, 106.0, 107.0]
    given = T.forecast(head(panel, 5), rows(panel, 5, 7), lambda x: x.withColumn("prediction", F.col("known") * 10), "y", "time", "e", [1], [], ["known"])
    assert sorted({r.predicted for r in given.collect()}) == [100.0, 120.0]
    uneven = T.forecast(head(panel, 5), rows(panel, 5, 8).where("e = 'a' or known < 12"), plus_one, "y", "time", "e", [1], [])
    assert sorted((r.e, r.predicted) for r in uneven.collect()) == [("a", 5.0), ("a", 6.0), ("a", 7.0), ("b", 105.0)]


def test_features_equal_those_of_training(daily):
    want = temporal.temporal_frame(daily, "y", "time", None, [1, 3], [2, 4], 1, ["known"]).orderBy(F.desc("origin")).first()
    got = T.forecast_features(head(daily, 11), rows(daily, 11, 12).withColumn("y", F.lit(-5.0)), "y", "time", None, [1, 3], [2, 4], ["known"]).first()
    for c in ("known", "y__lag_1", "y__lag_3", *[f"y__rolling_{s}_{n}" for s in ("mean", "std", "min", "max") for n in (2, 4)]):
        assert got[c] == pytest.approx(want[c])


def test_direct_horizon_gives_the_time_of_the_label(daily):
    r = T.forecast(head(daily, 5), rows(daily, 5, 6), plus_one, "y", "time", lags=[1], rolling=[], horizon=3).first()
    assert (r.time - r.origin).days == 2 and r.predicted == 5.0
    with pytest.raises(ValueError, match="horizon 1"):
        T.forecast(head(daily, 5), rows(daily, 5, 7), plus_one, "y", "time", lags=[1], rolling=[], horizon=2)


def test_months_numbers_and_texts_as_times(spark):
    months = spark.sql("select add_months(date'2020-01-01', cast(id as int)) :: timestamp as time, cast(id as double) as y from range(9)")
    out = T.forecast(months.where("y < 7"), months.where("y >= 7"), plus_one, "y", "time", lags=[1], rolling=[]).orderBy("time").collect()
    assert [r.predicted for r in out] == [7.0, 8.0]
    numbers = spark.sql("select cast(id * 3 as int) as time, cast(id as double) as y from range(9)")
    assert T.forecast(numbers.where("y < 7"), numbers.where("y >= 7"), plus_one, "y", "time", lags=[1], rolling=[]).count() == 2
    texts = spark.sql("select concat('2020-01-0', id + 1) as time, cast(id as double) as y from range(8)")
    assert T.forecast(texts.where("y < 7"), texts.where("y >= 7"), plus_one, "y", "time", lags=[1], rolling=[]).first().predicted == 7.0


@pytest.mark.parametrize(("future", "message"), [
    (lambda d: rows(d, 3, 4), "after the last"), (lambda d: rows(d, 7, 8), "next point"), (lambda d: rows(d, 5, 6).drop("known"), "needs known"), (lambda d: rows(d, 5, 6).union(rows(d, 5, 6)), "unique"),
    (lambda d: rows(d, 5, 7), "one row"),
])
def test_refused_futures(daily, future, message):
    with pytest.raises(ValueError, match=message):
        T.forecast_features(head(daily, 5), future(daily), "y", "time", lags=[1], rolling=[], features=["known"])


def test_refused_histories(daily, panel):
    step = rows(daily, 5, 6)
    with pytest.raises(ValueError, match="no history"):
        T.forecast_features(head(panel, 5).where("e = 'a'"), rows(panel, 5, 6), "y", "time", "e", [1], [])
    with pytest.raises(ValueError, match="too few"):
        T.forecast_features(head(daily, 5), step, "y", "time", lags=[9], rolling=[])
    with pytest.raises(ValueError, match="too few"):
        T.forecast_features(head(daily, 5).withColumn("y", F.when(F.col("y") != 4, F.col("y"))), step, "y", "time", lags=[1], rolling=[])
    with pytest.raises(ValueError, match="irregular"):
        T.forecast_features(head(daily, 5).where("y <> 2"), step, "y", "time", lags=[1], rolling=[])
    with pytest.raises(ValueError, match="repeats"):
        T.forecast_features(head(daily, 5).union(head(daily, 1)), step, "y", "time", lags=[1], rolling=[])
    with pytest.raises(ValueError, match="finite"):
        T.forecast(head(daily, 5), step, lambda x: x.withColumn("prediction", F.lit(None)), "y", "time", lags=[1], rolling=[])


@pytest.mark.parametrize(("change", "options", "message"), [
    (lambda d: d.union(d.limit(1)), {}, "repeats"), (lambda d: d.where("y <> 4"), {}, "irregular"), (lambda d: d.withColumn("time", F.lit("bad date")), {}, "no times"),
    (lambda d: d, {"lags": [0]}, "between 1"), (lambda d: d, {"lags": [1, 1]}, "once"), (lambda d: d, {"lags": [], "rolling": []}, "at least one"), (lambda d: d, {"horizon": 0}, "horizon"), (lambda d: d, {"features": ["y"]}, "target"),
    (lambda d: d, {"lags": [60], "rolling": []}, "no row is left"),
])
def test_refused_frames(daily, change, options, message):
    with pytest.raises(ValueError, match=message):
        temporal.temporal_frame(change(daily), "y", "time", **{"lags": [1]} | options)
