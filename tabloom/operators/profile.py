"""Profiles and analyses of a table; each returns a tidy DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SENT, correlation_of, finite, group_quantiles, is_numeric, ordered_rank, ranked, running_total, shuffle_key, value_bucket
from ..functions.stages import keep


def overview(df: DataFrame) -> DataFrame:
    kinds = [is_numeric(f) for f in df.schema]
    distinct = df.groupBy(*df.columns).count()
    totals = distinct.agg(F.sum("count").alias("n_rows"), F.sum(F.col("count") - 1).alias("duplicate_rows"), *[F.sum(F.when(F.col(c).isNull(), F.col("count")).otherwise(0)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    missing = reduce(lambda a, b: a + b, [F.col(f"m{i}") for i in range(len(df.columns))])
    return totals.select("n_rows", F.lit(len(kinds)).cast("long").alias("n_columns"), F.lit(sum(kinds)).cast("long").alias("n_numeric"), F.lit(len(kinds) - sum(kinds)).cast("long").alias("n_categorical"), missing.alias("missing_cells"), "duplicate_rows")


def missing_bar(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing"), (F.count_if(F.col(c).isNull()) / n).alias("fraction")) for c in df.columns]).alias("x"))
    return row.select(F.inline("x"))


def column_profile(df: DataFrame, column: str) -> DataFrame:
    q = F.percentile(column, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = df.agg(F.count(column).alias("n"), F.count_if(F.col(column).isNull()).alias("missing"), F.countDistinct(column).alias("n_unique"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), q.alias("q"))
    return out.select("n", "missing", "n_unique", "min", "max", "mean", "std", *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("q05", "q25", "q50", "q75", "q95"))])


def _bin(c, lo, hi, bins: int):
    lo2, hi2 = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
    return F.least(F.floor((c - lo2) / (hi2 - lo2) * bins), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, count) with empty bins; the last bin holds the maximum."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    counted = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(_bin(F.col(column).cast("double"), F.col("lo"), F.col("hi"), bins).alias("bin")).count()
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def histogram2d(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = both.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return both.crossJoin(F.broadcast(ends)).groupBy(_bin(F.col("x"), F.col("x0"), F.col("x1"), bins).alias("bx"), _bin(F.col("y"), F.col("y0"), F.col("y1"), bins).alias("by")).count()


def box(df: DataFrame, column: str, groups: list[str] | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR) and the number of values beyond."""
    by = groups or []
    q = keep(group_quantiles(df, column, [0.25, 0.5, 0.75], by)).select(*by, *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("q25", "q50", "q75"))])
    q = q.withColumns({"_lo": F.col("q25") - 1.5 * (F.col("q75") - F.col("q25")), "_hi": F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))})
    # Counted first: few groups are sent to the rows, many meet them.
    joined = df.join(F.broadcast(q) if q.count() <= SENT else q, by, "left").where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])) if by else df.join(F.broadcast(q), how="left")
    inside = F.col(column).between(F.col("_lo"), F.col("_hi"))
    return joined.groupBy(*by, "q25", "q50", "q75").agg(F.min(F.when(inside, F.col(column))).alias("low"), F.max(F.when(inside, F.col(column))).alias("high"), F.count_if(~inside).alias("n_out"))


def outliers(df: DataFrame, column: str) -> DataFrame:
    """Fences and how many values lie beyond them."""
    return box(df, column).select((F.col("q25") - 1.5 * (F.col("q75") - F.col("q25"))).alias("lower"), (F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))).alias("upper"), "n_out")


def ecdf(df: DataFrame, column: str) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).count()
    total = counts.agg(F.sum("count").alias("_all"))
    return running_total(counts, "x", "count", "_c").crossJoin(F.broadcast(total)).select("x", (F.col("_c") / F.col("_all")).alias("y"))


def kde(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """Gaussian kernel density with Scott's factor on an even grid from minimum to maximum."""
    x = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    s = x.agg(F.count("x").alias("n"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("h", F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    grid = df.sparkSession.range(points).crossJoin(F.broadcast(s)).select(F.col("id").cast("int").alias("i"), (F.col("lo") + F.col("id") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("g"), "h")
    # The grid has `points` rows; equal values are counted once before they meet it.
    weighed = x.groupBy("x").count()
    k = weighed.crossJoin(F.broadcast(grid)).groupBy("i", "g", "h").agg((F.sum(F.col("count") * F.exp(-0.5 * F.pow((F.col("g") - F.col("x")) / F.col("h"), F.lit(2.0)))) / F.sum("count")).alias("m"))
    return k.select("i", "g", (F.col("m") / (F.col("h") * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def correlation(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, r, n) over pairs where both are known; constant columns give null."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    known = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    if method == "pearson":
        cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation_of(a, b).alias("r"), F.count_if(known(a, b)).alias("n")) for a, b in pairs]
        return df.agg(F.array(*cells).alias("x")).select(F.inline("x"))
    parts = []
    for a, b in pairs:
        both = df.where(known(a, b)).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).groupBy("a", "b").count()
        for c in ("a", "b"):
            r = running_total(both.groupBy(c).agg(F.sum("count").alias("_n")), c, "_n", "_to").select(c, (F.col("_to") - (F.col("_n") - 1) / 2).alias(f"r{c}"))
            both = both.join(r, c)
        n = F.sum("count")
        s = lambda e: F.sum(e * F.col("count"))
        ra, rb = F.col("ra"), F.col("rb")
        top = s(ra * rb) - s(ra) * s(rb) / n
        parts.append(both.agg((top / F.sqrt((s(ra * ra) - s(ra) * s(ra) / n) * (s(rb * rb) - s(rb) * s(rb) / n))).alias("r"), n.alias("n")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "r", "n"))
    return reduce(DataFrame.unionByName, parts)


def category_counts(df: DataFrame, column: str, top_k: int = 15) -> DataFrame:
    """The top_k values (ties by value), the sum of the others, and the missing."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).count()
    top = counts.orderBy(F.desc("count"), "value").limit(top_k)
    others = counts.join(F.broadcast(top.select("value")), "value", "left_anti").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count")).select(F.lit("(other categories)").alias("value"), "count")
    missing = df.agg(F.count_if(F.col(column).isNull()).alias("count")).select(F.lit("(missing)").alias("value"), "count")
    return top.unionByName(others).unionByName(missing)


def crosstab(df: DataFrame, x: str, y: str, top_k: int = 15) -> DataFrame:
    """Zero-filled counts of the top_k values of x by those of y, in long form."""
    top = {c: df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(n)).count().orderBy(F.desc("count"), n).limit(top_k).select(n) for c, n in ((x, "x"), (y, "y"))}
    counts = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).count()
    return F.broadcast(top[x]).crossJoin(F.broadcast(top[y])).join(counts, ["x", "y"], "left").select("x", "y", F.coalesce("count", F.lit(0)).alias("count"))


def group_mean(df: DataFrame, group: str, column: str, top_k: int = 15) -> DataFrame:
    top = df.groupBy(group).count().where(F.col(group).isNotNull()).orderBy(F.desc("count"), group).limit(top_k).select(group)
    return df.join(F.broadcast(top), group, "left_semi").groupBy(group).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.count(column).alias("n"))


def rolling_mean(df: DataFrame, time: str, column: str, window: int = 10, entity: str | None = None) -> DataFrame:
    """Mean of the last window observations, fewer at the start. Without an entity the series is one ordered unit."""
    w = Window.partitionBy(*([entity] if entity else [])).orderBy(time).rowsBetween(-(window - 1), 0)
    return df.select(*([entity] if entity else []), time, column, F.avg(column).over(w).alias("rolling_mean"))


def autocorrelation(series: DataFrame, index: str, column: str, max_lag: int = 30) -> DataFrame:
    """acf of a regular series whose index counts steps: a self join by index, no window over all rows."""
    mean = series.agg(F.avg(column).alias("_m"))
    c = series.crossJoin(F.broadcast(mean)).select(F.col(index).alias("i"), (F.col(column) - F.col("_m")).alias("c"))
    denominator = c.agg(F.sum(F.col("c") * F.col("c")).alias("d"))
    lags = c.select(F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"), "i", "c")
    pairs = lags.join(c.select((F.col("i")).alias("j"), F.col("c").alias("e")), F.col("i") - F.col("lag") == F.col("j"))
    return pairs.groupBy("lag").agg(F.sum(F.col("c") * F.col("e")).alias("s")).crossJoin(F.broadcast(denominator)).select("lag", (F.col("s") / F.col("d")).alias("acf"))


def time_line(df: DataFrame, time: str, column: str, key: str, sample_size: int = 2000) -> DataFrame:
    """Rows by time, thinned evenly to sample_size positions; unreadable times are dropped."""
    t = df.select(F.col(time).try_cast("timestamp").alias("t"), F.col(column).alias("y"), F.col(key).alias("k")).where("t is not null").withColumn("_s", F.unix_micros("t").cast("double"))
    n = t.count()
    r = ranked(t, [F.col("t"), F.col("k")], value_bucket(t, "_s"))
    if n > sample_size:
        step = (n - 1) / (sample_size - 1)
        p = F.ceil((F.col("rank") - 1) / step)
        r = r.where((F.floor(p * step) == F.col("rank") - 1) & (p < sample_size))
    return r.select("t", "y", "k")


def missing_matrix(df: DataFrame, key: str, columns: list[str], sample_size: int = 1000, seed: int = 0) -> DataFrame:
    """0/1 per cell of a reproducible sample."""
    return df.orderBy(shuffle_key(seed, key), key).limit(sample_size).select(key, *[F.col(c).isNull().cast("int").alias(c) for c in columns])


def scatter(df: DataFrame, key: str, columns: list[str], sample_size: int = 2000, seed: int = 0, ties: list[str] | None = None) -> DataFrame:
    """A reproducible sample of the rows where all columns are known; rows that share a key go by ties, then by their values."""
    return df.dropna(subset=columns).orderBy(shuffle_key(seed, key), key, *(ties or []), *columns).limit(sample_size).select(key, *columns)


def auto_histogram(df: DataFrame, column: str, top: int = 30) -> DataFrame:
    """(bin, low, high, n): min(30, ceil(sqrt n)) equal bins of a numeric column, one bin for a constant; for text (value, n): the most
    frequent values and the rest together as a null value."""
    if not is_numeric(df.schema[column]):
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        first = counts.orderBy(F.desc("n"), "value").limit(top)
        rest = counts.join(first.select("value"), "value", "left_anti").agg(F.lit(None).cast("string").alias("value"), F.sum("n").alias("n")).where("n is not null")
        return first.select(F.col("value").cast("string").alias("value"), "n").unionByName(rest)
    x = finite(F.col(column))
    low, high, n = df.select(x.alias("x")).agg(F.min("x"), F.max("x"), F.count("x")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin long, low double, high double, n long")
    bins = 1 if low == high else min(30, int(-(-(n**0.5) // 1)))
    width = (high - low) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / width)) if width else F.lit(0)
    counts = df.select(x.alias("x")).where("x is not null").groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"), (F.lit(low) + F.col("id") * width).alias("low"), (F.lit(low) + (F.col("id") + 1) * width).alias("high"))
    return every.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def qq(df: DataFrame, column: str) -> DataFrame:
    """(rank, theoretical, value): known values in order against normal quantiles of Filliben's medians of order statistics; at least three values."""
    x = keep(df.select(finite(F.col(column)).alias("value")).where("value is not null"))
    n = x.count()
    if n < 3:
        raise ValueError("fewer than three known values")
    last = 0.5 ** (1.0 / n)

    @F.pandas_udf("double")
    def normal(p):
        from statistics import NormalDist

        import pandas as pd

        inverse = NormalDist().inv_cdf
        return pd.Series([inverse(v) for v in p], index=p.index, dtype=float)

    median = F.when(F.col("rank") == 1, 1 - last).when(F.col("rank") == n, last).otherwise((F.col("rank") - 0.3175) / (n + 0.365))
    return ordered_rank(x, "value").select("rank", normal(median).alias("theoretical"), "value")


def qq_line(df: DataFrame, column: str) -> DataFrame:
    """(slope, intercept, r) of the least-squares line through qq()."""
    return qq(df, column).agg(F.regr_slope("value", "theoretical").alias("slope"), F.regr_intercept("value", "theoretical").alias("intercept"), correlation_of("value", "theoretical").alias("r"))
