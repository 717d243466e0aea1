"""Forecasts of series and panels from a small state per entity: its last values, its last time and its step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stages import keep
from .temporal import check_policy, normalise_time

MOST_STEPS = 20
_SINGLE = "_series"


def _steps(df: DataFrame, time: str, by: list[str]) -> DataFrame:
    """(by, last, n, step, months, even): the step between times in their own unit (microseconds for timestamps), or in months."""
    stamp = dict(df.dtypes)[time] in ("timestamp", "date", "timestamp_ntz")
    t = F.unix_micros(F.col(time).cast("timestamp")).cast("double") if stamp else F.col(time).cast("double")
    month = (F.year(time) * 12 + F.month(time)) if stamp else F.lit(None).cast("int")
    day = F.dayofmonth(time) if stamp else F.lit(None).cast("int")
    w = Window.partitionBy(*by).orderBy(time)
    x = df.select(*by, F.col(time).alias("at"), (t - F.lag(t).over(w)).alias("d"), (month - F.lag(month).over(w)).alias("m"), day.alias("day"))
    near = F.max("d") - F.min("d") <= 1e-9 * F.abs(F.max("d"))
    monthly = F.coalesce((F.min("m") == F.max("m")) & (F.min("m") > 0) & (F.min("day") == F.max("day")), F.lit(False))
    return x.groupBy(*by).agg(
        F.max("at").alias("last"), F.count(F.lit(1)).alias("n"), F.min("d").alias("step"), F.when(monthly & ~near, F.min("m")).alias("months"),
        F.coalesce(F.min("d") > 0, F.lit(True)).alias("rising"), F.coalesce(near | monthly, F.lit(False)).alias("even"),
    )


def _advance(time: Column, stamp: bool, n: Column | int, step: str = "step", months: str = "months") -> Column:
    """The time n steps on."""
    k = F.lit(n) if isinstance(n, int) else n
    if not stamp:
        return time.cast("double") + F.col(step) * k
    plain = F.timestamp_micros((F.unix_micros(time.cast("timestamp")) + F.col(step) * k).cast("long"))
    return F.when(F.col(months).isNotNull(), time.cast("timestamp") + F.make_ym_interval(F.lit(0), (F.col(months) * k).cast("int"))).otherwise(plain)


def history_state(history: DataFrame, target: str, time: str, entity: str | None, most: int) -> DataFrame:
    """(entity, last, step, months, n, values): the last values of each series, the latest first; refuses repeated or uneven times.

    One row and at most most values an entity: that is all that forecasts carry on. Rows without a time or an entity are refused.
    """
    by = [entity or _SINGLE]
    df = normalise_time(history, time).select(*([F.col(entity)] if entity else [F.lit(0).alias(_SINGLE)]), time, F.col(target).cast("double").alias("_y"))
    steps = keep(_steps(df, time, by))
    bad = steps.agg(F.count_if(F.col("last").isNull() | F.col(by[0]).isNull()), F.count_if(~F.col("rising")), F.count_if(~F.col("even") & (F.col("n") > 1))).first()
    if bad[0] or df.where(F.col(time).isNull()).limit(1).count():
        raise ValueError("history has rows without a time or an entity")
    if bad[1]:
        raise ValueError("history repeats a time of a series")
    if bad[2]:
        raise ValueError("history has a series with irregular times")
    latest = Window.partitionBy(*by).orderBy(F.desc(time))
    last = df.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= most)
    values = last.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_y"))), lambda s: s["_y"]).alias("values"))
    return steps.join(values, by).select(*by, "last", "step", "months", "n", "values")


def _made(target: str, lags: list[int], rolling: list[int]) -> dict[str, Column]:
    out = {f"{target}__lag_{k}": F.get("values", F.lit(k - 1)) for k in lags}
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    spread = lambda a, m: F.transform(a, lambda x: (x - m) * (x - m))
    for n in rolling:
        part = F.slice("values", 1, n)
        mean = total(part) / n
        out |= {
            f"{target}__rolling_mean_{n}": mean, f"{target}__rolling_std_{n}": F.sqrt(total(spread(part, mean)) / (n - 1)),
            f"{target}__rolling_min_{n}": F.array_min(part), f"{target}__rolling_max_{n}": F.array_max(part),
        }
    return out


def _next_rows(state: DataFrame, future: DataFrame, target: str, time: str, key: str, lags: list[int], rolling: list[int], features: list[str], stamp: bool) -> DataFrame:
    """The features of one step for each row of future, with the state's columns; refuses what does not follow from the history."""
    most = max([*lags, *rolling])
    x = future.select(key, time, *features).join(state, key, "left")
    point = _advance(F.col("last"), stamp, 1)
    same = (F.col(time).cast("timestamp") == point) if stamp else (F.abs(F.col(time).cast("double") - point) <= 1e-9 * F.abs(F.col("step")))
    after = F.col(time) > F.col("last")
    finite = (F.size("values") >= most) & F.forall(F.slice("values", 1, most), lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    unknown, enough = F.col("last").isNull(), F.coalesce(finite, F.lit(False))
    bad = x.agg(F.count_if(unknown), F.count_if(~unknown & ~after), F.count_if(~unknown & after & ~F.coalesce(same & (F.col("n") > 1), F.lit(False))), F.count_if(~unknown & ~enough)).first()
    for n, message in zip(bad, ["an entity of the future has no history", "a forecast must come after the last known time", "a forecast must start at the next point of a regular grid", "there are too few finite past values"], strict=True):
        if n:
            raise ValueError(message)
    return x.withColumns(_made(target, lags, rolling))


def _future(future: DataFrame, time: str, entity: str | None, features: list[str]) -> DataFrame:
    missing = [c for c in [time, *([entity] if entity else []), *features] if c not in future.columns]
    if missing:
        raise ValueError(f"the future needs {', '.join(missing)}")
    out = normalise_time(future, time)
    out = out if entity else out.withColumn(_SINGLE, F.lit(0))
    key = entity or _SINGLE
    if out.where(F.col(key).isNull() | F.col(time).isNull()).limit(1).count() or out.groupBy(key, time).count().where("count > 1").limit(1).count():
        raise ValueError("entities and times of the future must be known and unique")
    return out


def forecast_features(history: DataFrame, future: DataFrame, target: str, time: str, entity: str | None = None, lags: list[int] | None = None, rolling: list[int] | None = None, features: list[str] | None = None) -> DataFrame:
    """(entity, time, features, lags, rolling statistics): one row of future per entity, which must be the next point of its grid.

    Lags and windows come from the history alone; a target in future is not read, features are taken from it as given.
    """
    lags, rolling, features = [1, 2, 3] if lags is None else lags, [3] if rolling is None else rolling, features or []
    check_policy(target, lags, rolling, 1, features)
    f, key = _future(future, time, entity, features), entity or _SINGLE
    if f.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("one step needs one row for each entity")
    stamp = dict(f.dtypes)[time] in ("timestamp", "date", "timestamp_ntz")
    state = history_state(history, target, time, entity, max([*lags, *rolling]))
    x = _next_rows(state, f, target, time, key, lags, rolling, features, stamp)
    return x.select(*([entity] if entity else []), time, *features, *_made(target, lags, rolling))


def forecast(history: DataFrame, future: DataFrame, model: Callable[[DataFrame], DataFrame], target: str, time: str, entity: str | None = None, lags: list[int] | None = None, rolling: list[int] | None = None, features: list[str] | None = None, horizon: int = 1) -> DataFrame:
    """(entity, time, origin, predicted) for every row of future: at most 20 steps an entity, each next on its grid.

    model maps the features of forecast_features() to a frame with prediction. With horizon 1 predictions become the past of the
    next step; with a longer one future has one row an entity, the origin, and time is horizon - 1 steps on. Only the last values of each
    entity are carried from step to step, in a table of their own that cuts the lineage.
    """
    lags, rolling, features = [1, 2, 3] if lags is None else lags, [3] if rolling is None else rolling, features or []
    check_policy(target, lags, rolling, horizon, features)
    f, key = _future(future, time, entity, features), entity or _SINGLE
    stamp = dict(f.dtypes)[time] in ("timestamp", "date", "timestamp_ntz")
    f = keep(f.select(key, time, *features).withColumn("_step", F.row_number().over(Window.partitionBy(key).orderBy(time))))
    steps = f.agg(F.max("_step")).first()[0]
    if not steps:
        raise ValueError("the future has no rows")
    if steps > MOST_STEPS:
        raise ValueError(f"more than {MOST_STEPS} steps of an entity")
    if horizon > 1 and steps > 1:
        raise ValueError("steps that feed each other need a model of horizon 1")
    most = max([*lags, *rolling])
    state, out = history_state(history, target, time, entity, most), None
    for s in range(1, steps + 1):
        x = _next_rows(state, f.where(F.col("_step") == s), target, time, key, lags, rolling, features, stamp)
        made = keep(model(x).withColumn("_p", F.col("prediction").cast("double")))
        if made.where(F.col("_p").isNull() | F.isnan("_p") | (F.abs("_p") == float("inf"))).limit(1).count():
            raise ValueError("the model gave a prediction that is no finite number")
        at = _advance(F.col(time), stamp, horizon - 1) if horizon > 1 else F.col(time)
        step = made.select(*([entity] if entity else []), at.alias(time), F.col(time).alias("origin"), F.col("_p").alias("predicted"))
        out = step if out is None else out.unionByName(step)
        if s < steps:
            new = made.select(key, F.col(time).alias("_t"), "_p")
            after = state.join(new, key, "left")
            state = keep(after.select(key, F.coalesce("_t", "last").alias("last"), "step", "months", (F.col("n") + F.col("_t").isNotNull().cast("int")).alias("n"), F.when(F.col("_t").isNotNull(), F.slice(F.concat(F.array("_p"), "values"), 1, most)).otherwise(F.col("values")).alias("values")))
    return out
