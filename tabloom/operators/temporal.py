"""Lags, rolling features and horizons for series and panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stages import keep


def normalise_time(df: DataFrame, time: str) -> DataFrame:
    """Numbers stay, text is parsed as UTC; a value that cannot be read is an error."""
    if dict(df.dtypes)[time] != "string":
        return df
    out = df.withColumn("_t", F.col(time).try_cast("timestamp"))
    if out.where(F.col(time).isNotNull() & F.col("_t").isNull()).limit(1).count():
        raise ValueError(f"{time} has values that are no times")
    return out.withColumn(time, F.col("_t")).drop("_t")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def _grid(df: DataFrame, time: str, entity: str | None = None) -> DataFrame:
    """Per entity the number of rows, whether a time repeats, and whether times step evenly, in seconds or in whole months on the same day."""
    by = [entity] if entity else []
    w = Window.partitionBy(*by).orderBy(time)
    stamp = dict(df.dtypes)[time] in ("timestamp", "date", "timestamp_ntz")
    t = F.unix_micros(F.col(time).cast("timestamp")).cast("double") / 1e6 if stamp else F.col(time).cast("double")
    months = F.year(time) * 12 + F.month(time) if stamp else F.lit(None).cast("int")
    day = F.dayofmonth(time) if stamp else F.lit(0)
    x = df.select(*by, (t - F.lag(t).over(w)).alias("d"), (months - F.lag(months).over(w)).alias("m"), day.alias("day"))
    even = (F.min("d") == F.max("d")) & (F.min("d") > 0)
    monthly = (F.min("m") == F.max("m")) & (F.min("m") > 0) & (F.min("day") == F.max("day"))
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("d") == 0, F.lit(False)).alias("repeats"), F.coalesce(even | F.coalesce(monthly, F.lit(False)), F.lit(False)).alias("regular"))


def regular(df: DataFrame, time: str, entity: str | None = None) -> DataFrame:
    """Per entity whether times step evenly, in seconds or in whole months on the same day."""
    return _grid(df, time, entity).select(*([entity] if entity else []), "regular")


def check_policy(target: str, lags: list[int], rolling: list[int], horizon: int, features: list[str]) -> None:
    """Lags from 1 to 64 and windows from 2 to 32, each once and at least one of them; a horizon of 1 or more; no target among the features."""
    for name, values, low, high in (("lags", lags, 1, 64), ("rolling", rolling, 2, 32)):
        if any(not low <= v <= high for v in values) or len(set(values)) < len(values):
            raise ValueError(f"{name} must lie between {low} and {high}, each once")
    if not lags and not rolling:
        raise ValueError("choose at least one lag or window")
    if horizon < 1:
        raise ValueError("the horizon must be at least 1")
    if target in features:
        raise ValueError("features must not hold the target")


def check_grid(df: DataFrame, time: str, entity: str | None = None) -> None:
    """Refuses repeated times of a series and times that do not step evenly; a series of one row passes."""
    repeats, uneven = _grid(df, time, entity).agg(F.count_if("repeats"), F.count_if(~F.col("regular") & (F.col("n") > 1))).first()
    if repeats:
        raise ValueError("a series repeats a time")
    if uneven:
        raise ValueError("a series has irregular times")


def temporal_frame(df: DataFrame, target: str, time: str, entity: str | None = None, lags: list[int] | None = None, rolling: list[int] | None = None, horizon: int = 1, features: list[str] | None = None) -> DataFrame:
    """One row per forecast origin: lags, rolling statistics of the values before it, and the value horizon - 1 steps on.

    Rolling windows leave the current value out and need all their values. Rows with an unknown generated value or label go.
    Repeated or irregular times are refused, since lags count rows, and so is a frame without any row left.
    """
    by = [entity] if entity else []
    check_policy(target, lags or [], rolling or [], horizon, features or [])
    df = normalise_time(df, time)
    check_grid(df, time, entity)
    w = Window.partitionBy(*by).orderBy(time)
    made = {f"{target}__lag_{k}": F.lag(target, k).over(w) for k in lags or []}
    for n in rolling or []:
        frame = w.rowsBetween(-n, -1)
        whole = F.count(target).over(frame) == n
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            made[f"{target}__rolling_{name}_{n}"] = F.when(whole, f(target).over(frame))
    out = df.select(*by, F.col(time).alias("origin"), F.lead(time, horizon - 1).over(w).alias("target_time") if horizon > 1 else F.col(time).alias("target_time"), *[F.col(c) for c in features or []], *[c.alias(k) for k, c in made.items()], (F.lead(target, horizon - 1).over(w) if horizon > 1 else F.col(target)).alias("label"))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*made, "label"]])
    out = out.where(known)
    if not out.limit(1).count():
        raise ValueError("no row is left: the series are shorter than their lags, windows and horizon")
    return out


def forecast(history: DataFrame, model, target: str, time: str, step: str, steps: int, entity: str, lags: list[int]) -> DataFrame:
    """Recursive forecasts without a future frame (forecasting.forecast() has one): predictions become lags of the next step. model maps a frame with the lag columns to one with prediction.

    Only the last max(lags) values of each entity are carried on. step is an interval such as '1 day'.
    """
    if not 1 <= steps <= 20:
        raise ValueError("1 to 20 steps")
    k = max(lags)
    last = Window.partitionBy(entity).orderBy(F.desc(time))
    state = history.select(entity, time, target).withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= k)
    out = None
    for _ in range(steps):
        row = state.groupBy(entity).agg(F.max(time).alias(time), *[F.max(F.when(F.col("_r") == n, F.col(target))).alias(f"{target}__lag_{n}") for n in lags])
        row = row.withColumn(time, F.col(time) + F.expr(f"interval {step}"))
        made = keep(model(row).select(entity, time, F.col("prediction").cast("double").alias(target)))
        out = made if out is None else out.unionByName(made)
        state = keep(state.select(entity, time, target, (F.col("_r") + 1).alias("_r")).where(F.col("_r") <= k).unionByName(made.withColumn("_r", F.lit(1))))
    return out
