"""Registered queries of forecasts, specifications, searches and ensembles; registered by tabloom.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import ensembles as N
from .operators import forecasting as T
from .operators import learn as L
from .operators import specs as S
from .queries import _r, query

_DAYS = "(SELECT event_type, ts::DATE AS day, sum(value) AS y FROM events GROUP BY 1, 2)"


def _days(t, last: int) -> tuple[DataFrame, DataFrame]:
    """Daily sums by event type: all but the last days of each type, and these."""
    d = t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("day"))))
    return d.where(F.col("_r") > last).drop("_r"), d.where(F.col("_r") <= last).drop("_r")


@query(f"""WITH x AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r, lag(y, 1) OVER w AS a, lag(y, 3) OVER w AS b, avg(y) OVER f AS mean, stddev_samp(y) OVER f AS sd, min(y) OVER f AS lo, max(y) OVER f AS hi
  FROM {_DAYS} WINDOW w AS (PARTITION BY event_type ORDER BY day), f AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT event_type, day, {_r('a', 'y__lag_1')}, {_r('b', 'y__lag_3')}, {_r('mean', 'y__rolling_mean_4')}, {_r('sd', 'y__rolling_std_4')}, {_r('lo', 'y__rolling_min_4')}, {_r('hi', 'y__rolling_max_4')} FROM x WHERE r = 1""")
def t5_forecast_features(t):
    history, future = _days(t, 1)
    return T.forecast_features(history, future, "y", "day", "event_type", [1, 3], [4])


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r FROM {_DAYS}), k AS (SELECT event_type, max(y) FILTER (r = 4) AS a, max(y) FILTER (r = 5) AS b FROM d GROUP BY 1),
p AS (SELECT event_type, (a + b) / 2 AS p1, ((a + b) / 2 + a) / 2 AS p2, (((a + b) / 2 + a) / 2 + (a + b) / 2) / 2 AS p3 FROM k)
SELECT event_type, day, day AS origin, {_r('CASE r WHEN 3 THEN p1 WHEN 2 THEN p2 ELSE p3 END', 'predicted')} FROM d JOIN p USING (event_type) WHERE r <= 3""")
def t6_forecast(t):
    """Three days on, each the mean of the two before, of which predictions are part; the future's own sums are not read."""
    history, future = _days(t, 3)
    mean = lambda x: x.withColumn("prediction", (F.col("y__lag_1") + F.col("y__lag_2")) / 2)
    return T.forecast(history, future, mean, "y", "day", "event_type", [1, 2], [])


def _items(t) -> DataFrame:
    return t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), F.col("l_shipdate").cast("string").substr(6, 2).alias("month"), F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / 1000).alias("y"))


@query(f"""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_quantity / 50 AS q, l_extendedprice / 1000 AS y FROM lineitem), m AS (SELECT count(*) AS n, avg(q) AS mq, stddev_pop(q) AS sd, avg(y) AS my, covar_pop(q, y) AS c FROM x)
SELECT key, {_r('my + n * c / sd / (n + 100) * (q - mq) / sd', 'prediction')} FROM x, m""")
def p10_spec_pipeline(t):
    """Scale, then ridge, compiled from a specification."""
    x = _items(t)
    spec = {"kind": "chain", "steps": [["scale", {"kind": "scale"}], ["model", {"kind": "ridge", "alpha": 100.0}]]}
    return S.SpecEstimator(spec, ["q"], "y").fit(x).transform(x).select("key", "prediction")


@query()
def u3_halving_search(t):
    """The trials of a search by halving over a nested specification, whose winner sees all rows."""
    prep = {"kind": "columns", "parts": [["num", {"kind": "chain", "steps": [["scale", {"kind": "scale"}], ["more", {"kind": "polynomial", "degree": 1}]]}, ["q", "d"]], ["cat", {"kind": "onehot"}, ["month"]]]}
    spec = {"kind": "chain", "steps": [["prep", prep], ["model", {"kind": "ridge"}]]}
    x = _items(t)
    found = S.search(x, spec, ["q", "d", "month"], "y", "key", S.grid({"prep__num__more__degree": [1, 2], "model__alpha": [1.0, 1e5]}), "rmse", folds=2, halving=2)
    rows = [(r["rung"], r["rows"], r["candidate"], r["mean"], r["std"]) for r in found.trials]
    return t("lineitem").sparkSession.createDataFrame(rows, "rung int, rows long, candidate int, mean double, std double")


@query()
def a5_adaboost(t):
    x = _items(t)
    return N.adaboost_classifier(x, "key", ["q", "d"], "flag", rounds=3, maxDepth=2).transform(x).select("key", "flag", "prediction")


@query()
def a6_bagging(t):
    x = _items(t)
    return N.bagging(x, "key", ["q", "d"], "y", members=3, maxDepth=4).transform(x).select("key", "y", "prediction")


@query()
def a7_stacking(t):
    x = _items(t)
    members = [lambda rows: L.regressor(rows, ["q", "d"], "y", "tree", maxDepth=3), lambda rows: L.regressor(rows, ["q", "d"], "y", "huber")]
    return N.stacking(x, "key", members, "y", folds=3).transform(x).select("key", "y", "prediction")
