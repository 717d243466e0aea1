"""Column recipes shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import keep


def is_numeric(field: T.StructField) -> bool:
    """Booleans are not numeric."""
    return isinstance(field.dataType, T.NumericType)


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clean_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric columns without NaN and infinities, everything else as text."""
    kinds = {f.name: f for f in df.schema}
    return df.select(*[(finite(F.col(c)) if is_numeric(kinds[c]) else F.col(c).cast("string")).alias(c) for c in columns])


def correlation_of(a: str, b: str) -> Column:
    """Pearson's r over rows where both are known; null for a constant (the built-in divides by zero there)."""
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(known, F.col(a))) * F.stddev_pop(F.when(known, F.col(b)))
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))


def select_by_kind(df: DataFrame, numeric: bool | None = None, pattern: str | None = None) -> list[str]:
    import re

    return [f.name for f in df.schema if (numeric is None or is_numeric(f) == numeric) and (pattern is None or re.search(pattern, f.name))]


#: Functions that a column map may name.
MATH = {
    "log1p": F.log1p, "log": F.ln, "log2": F.log2, "log10": F.log10, "exp": F.exp, "expm1": F.expm1, "sqrt": F.sqrt, "square": lambda c: c * c,
    "abs": F.abs, "absolute": F.abs, "sign": F.signum, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "float32": lambda c: c.cast("float"), "float64": lambda c: c.cast("double"), "int32": lambda c: c.cast("int"), "int64": lambda c: c.cast("long"),
}


def apply_math(c: Column, name: str) -> Column:
    if name not in MATH:
        raise ValueError(f"{name} is not an allowed function; choose from {', '.join(MATH)}")
    return MATH[name](c)


def shuffle_key(seed: int | str, *key: str) -> Column:
    """A reproducible random order: the same md5 in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def ranked(df: DataFrame, order: list[Column], bucket: Column, partition: list[str] | None = None, name: str = "rank") -> DataFrame:
    """1-based rank by order without one task for all rows.

    bucket must not fall while order rises. Ranks inside a bucket are windows; what lies before a bucket is summed
    over bucket counts, of which there are as many as buckets.
    """
    by = partition or []
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select(*by, "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    on = [df["_bucket"] == before["_bucket"], *[df[c].eqNullSafe(before[c]) for c in by]]
    joined = df.withColumn("_inside", inside)
    on = [joined["_bucket"] == before["_bucket"], *[joined[c].eqNullSafe(before[c]) for c in by]]
    return joined.join(before, on, "left").select(*[joined[c] for c in df.columns if c != "_bucket"], (F.col("_inside") + F.col("_before")).alias(name))


def shuffled_rank(df: DataFrame, seed: int | str, key: str, partition: list[str] | None = None, name: str = "rank") -> DataFrame:
    h = shuffle_key(seed, key)
    return ranked(df, [h, F.col(key)], F.substring(h, 1, 3), partition, name)


def value_bucket(df: DataFrame, column: str, count: int = 64) -> Column:
    """A monotone bucket of a numeric column from approximate quantiles (only the evenness of buckets depends on them)."""
    bounds = sorted(set(df.approxQuantile(column, [i / count for i in range(1, count)], 0.005)))
    return F.coalesce(sum([(F.col(column) >= b).cast("int") for b in bounds], F.lit(0)), F.lit(-1))


def ordered_rank(df: DataFrame, column: str, ties: list[str] | None = None, name: str = "rank") -> DataFrame:
    return ranked(df, [F.col(column), *map(F.col, ties or [])], value_bucket(df, column), None, name)


def running_total(df: DataFrame, column: str, value: str, name: str, ascending: bool = True) -> DataFrame:
    """Cumulative sum of value over distinct values of a numeric column, in two levels as in ranked()."""
    b = value_bucket(df, column)
    b = b if ascending else -b
    df = df.withColumn("_bucket", b)
    order = F.col(column).asc() if ascending else F.col(column).desc()
    totals = df.groupBy("_bucket").agg(F.sum(value).alias("_t"))
    before = totals.select("_bucket", F.coalesce(F.sum("_t").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.sum(value).over(Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_i", inside).join(F.broadcast(before), "_bucket").withColumn(name, F.col("_i") + F.col("_b")).drop("_bucket", "_i", "_b")


def join_null_safe(df: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """df with the other columns of table, where equal nulls match too; columns of df first."""
    renamed = table.withColumnsRenamed({c: f"_{c}_key" for c in on})
    condition = [df[c].eqNullSafe(renamed[f"_{c}_key"]) for c in on]
    return df.join(renamed, condition, how).drop(*[f"_{c}_key" for c in on])


#: Values that order_statistics may hold on the driver; buckets of one of its counts.
HELD, BUCKETS = 50_000, 4096


def order_statistics(df: DataFrame, column: str, ranks: list[int], weight: str | None = None) -> list[float]:
    """The values of the given 0-based ranks of a numeric column without nulls, exactly; NaN is the greatest.

    The column is counted in equal buckets, and again in those that hold a rank, until they hold few rows or one value: one pass for
    some three digits, and no task sees more than its own share of the column. weight: an integer column, as if a row stood there so often.
    """
    v = F.col("v")
    rows = df.select(F.col(column).cast("double").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    is_finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    first = rows.agg(F.min(F.when(is_finite, v)), F.max(F.when(is_finite, v)), F.count(F.lit(1))).first()
    out: dict[int, float] = {}
    todo = [(rows, first[0] or 0.0, first[1] or 0.0, first[2], 0, sorted(set(ranks)))]
    while todo:
        part, low, high, n, before, wanted = todo.pop()
        if n <= HELD:
            held = sorted(((r["v"], r["w"]) for r in part.collect()), key=lambda x: (x[0] != x[0], x[0]))
            for value, w in held:
                out |= {k: value for k in wanted if before <= k < before + w}
                before += w
            continue
        place = F.floor((v / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2 or 1.0) * BUCKETS)
        bucket = F.when(F.isnan(v), BUCKETS + 1).when(v == float("inf"), BUCKETS).when(v == -float("inf"), -1).otherwise(F.least(place, F.lit(BUCKETS - 1)))
        counts = part.groupBy(bucket.cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in sorted(counts.collect(), key=lambda r: r["b"]):
            here = [k for k in wanted if before <= k < before + r["w"]]
            if here and (r["low"] == r["high"] or r["b"] > BUCKETS):
                out |= dict.fromkeys(here, r["low"])
            elif here:
                todo.append((rows.where(v.between(r["low"], r["high"])), r["low"], r["high"], r["n"], before, here))
            before += r["w"]
    return [out[k] for k in ranks]


def exact_quantiles(df: DataFrame, column: str, qs: list[float], weight: str | None = None) -> list[float | None]:
    """Quantiles with linear interpolation of the known values of a column; null without any. weight as in order_statistics()."""
    known = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias(column), *([weight] if weight else []))
    n = known.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    if not n:
        return [None] * len(qs)
    at = [q * (n - 1) for q in qs]
    ranks = sorted({int(a) for a in at} | {min(int(a) + 1, n - 1) for a in at})
    value = dict(zip(ranks, order_statistics(known, column, ranks, weight), strict=True))
    return [value[int(a)] + (a - int(a)) * (value[min(int(a) + 1, n - 1)] - value[int(a)]) for a in at]


#: Rows of a small table that is sent to all tasks, counted first.
SENT = 100_000


def group_quantiles(df: DataFrame, column: str, qs: list[float], by: list[str] | None = None, name: str = "q") -> DataFrame:
    """(by, name): an array of the quantiles of the known values of each group, exactly and with linear interpolation, as percentile gives them.

    Rows are counted in some 64 buckets of like size; only those that hold a wanted rank are ordered, each by itself, so that no task
    holds the values of a group. A group without a known value has no row.
    """
    by, v = by or [], F.col("_v")
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).where(v.isNotNull())
    rows = rows.withColumn("_bucket", value_bucket(rows, "_v"))
    parts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_t"))
    whole = Window.partitionBy(*by)
    parts = parts.withColumn("_all", F.sum("_t").over(whole)).withColumn("_before", F.coalesce(F.sum("_t").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = [F.lit(float(q)) * (F.col("_all") - 1) for q in qs]
    ranks = F.array_distinct(F.array(*[f(a) for a in at for f in (F.floor, F.ceil)]))
    here = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_t")))
    parts = keep(parts.withColumn("_ranks", here).where(F.size("_ranks") > 0).select(*by, "_bucket", "_all", "_before", "_ranks"))
    near = join_null_safe(rows, F.broadcast(parts) if parts.count() <= SENT else parts, [*by, "_bucket"])
    counts = near.groupBy(*by, "_bucket", "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"))
    inside = F.sum("_n").over(Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_to", F.col("_before") + inside).withColumn("_from", F.col("_to") - F.col("_n"))
    placed = placed.where(F.exists("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_to"))))
    found = lambda a, f: F.max(F.when((f(a) >= F.col("_from")) & (f(a) < F.col("_to")), v))
    ends = placed.groupBy(*by).agg(F.first("_all").alias("_all"), *[found(a, f).alias(f"_{n}{i}") for i, a in enumerate(at) for n, f in (("low", F.floor), ("high", F.ceil))])
    between = lambda i, a: F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise((F.ceil(a) - a) * F.col(f"_low{i}") + (a - F.floor(a)) * F.col(f"_high{i}"))
    return ends.select(*by, F.array(*[between(i, a) for i, a in enumerate(at)]).alias(name)).where(F.col("_all").isNotNull())
