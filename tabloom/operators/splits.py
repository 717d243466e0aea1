"""Holdouts and cross-validation plans as columns; shuffles order rows by md5(seed|key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe, ordered_rank, ranked, shuffled_rank, value_bucket

#: Folds that leave_one_group_out makes.
MOST_GROUPS = 100


def _part(rank: Column, n: Column, train: float, validation: float) -> Column:
    """train = floor(n f), validation = floor(rest f_v / (1 - f)), test the remainder."""
    a = F.floor(n * train + 1e-9)
    b = a + F.floor((n - a) * (validation / (1 - train)) + 1e-9)
    return F.when(rank <= a, "train").when(rank <= b, "validation").otherwise("test")


def _ordered_part(rank: Column, n: Column, train: float, validation: float) -> Column:
    """Cuts at floor(n f) and floor(n (f + f_v))."""
    a, b = F.floor(n * train + 1e-9), F.floor(n * (train + validation) + 1e-9)
    return F.when(rank <= a, "train").when(rank <= b, "validation").otherwise("test")


def holdout(df: DataFrame, key: str, train: float = 0.6, validation: float = 0.2, seed: int = 0, strata: str | None = None) -> DataFrame:
    """df with split; within each stratum if one is given."""
    by = [strata] if strata else []
    r = shuffled_rank(df, seed, key, by, "_rank")
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    r = join_null_safe(r, n, by) if strata else r.crossJoin(F.broadcast(n))
    return r.withColumn("split", _part(F.col("_rank"), F.col("_n"), train, validation)).drop("_rank", "_n")


def group_holdout(df: DataFrame, group: str, train: float = 0.6, validation: float = 0.2, seed: int = 0) -> DataFrame:
    """Whole groups in one part; rows without a group are one group. Refuses fewer than 5 groups."""
    groups = df.select(group).distinct()
    if groups.limit(5).count() < 5:
        raise ValueError("a group holdout needs 5 groups")
    return join_null_safe(df, holdout(groups, group, train, validation, seed), [group])


def ordered_holdout(df: DataFrame, order: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return ordered_rank(df, order, None, "_rank").crossJoin(F.broadcast(n)).withColumn("split", _ordered_part(F.col("_rank"), F.col("_n"), train, validation)).drop("_rank", "_n")


def chronological_holdout(df: DataFrame, origin: str, target_time: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Cuts between unique origins; rows whose label lies in a later part are left out."""
    origins = df.select(origin).distinct().withColumn("_u", F.unix_micros(F.col(origin).cast("timestamp")).cast("double"))
    r = ranked(origins, [F.col(origin)], value_bucket(origins, "_u"), None, "_rank")
    n = origins.count()
    a = int(n * train + 1e-9)
    b = int(n * (train + validation) + 1e-9)
    cut = r.agg(F.min(F.when(F.col("_rank") > a, F.col(origin))).alias("_v"), F.min(F.when(F.col("_rank") > b, F.col(origin))).alias("_t"))
    x = df.crossJoin(F.broadcast(cut))
    split = F.when((F.col(origin) < F.col("_v")) & (F.col(target_time) < F.col("_v")), "train").when((F.col(origin) >= F.col("_v")) & (F.col(origin) < F.col("_t")) & (F.col(target_time) < F.col("_t")), "validation").when(F.col(origin) >= F.col("_t"), "test")
    return x.withColumn("split", split).where("split is not null").drop("_v", "_t")


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 0, strata: str | None = None) -> DataFrame:
    return shuffled_rank(df, seed, key, [strata] if strata else [], "_rank").withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def contiguous_kfold(df: DataFrame, order: str, k: int = 5) -> DataFrame:
    """Blocks in order; the first n % k have one row more."""
    n = df.count()
    size, extra = divmod(n, k)
    i = F.col("_rank") - 1
    fold = F.when(i < extra * (size + 1), F.floor(i / (size + 1))).otherwise(extra + F.floor((i - extra * (size + 1)) / max(size, 1)))
    return ordered_rank(df, order, None, "_rank").withColumn("fold", fold.cast("int")).drop("_rank")


def repeated_kfold(df: DataFrame, key: str, k: int = 5, repeats: int = 2, seed: int = 0, strata: str | None = None) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, [kfold(df, key, k, seed + r, strata).withColumn("repeat", F.lit(r)) for r in range(repeats)])


def shuffle_splits(df: DataFrame, key: str, splits: int = 3, test_size: float = 0.2, seed: int = 0, strata: str | None = None) -> DataFrame:
    """(split_id, ..., role): in each split the first ceil(n x test_size) of its own order are the test part; null strata are one stratum."""
    from functools import reduce

    by = [strata] if strata else []
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    out = []
    for s in range(splits):
        r = shuffled_rank(df, seed + s, key, by, "_rank")
        r = join_null_safe(r, n, by) if strata else r.crossJoin(F.broadcast(n))
        out.append(r.select(F.lit(s).alias("split_id"), *df.columns, F.when(F.col("_rank") <= F.ceil(F.col("_n") * test_size - 1e-9), "test").otherwise("train").alias("role")))
    return reduce(DataFrame.unionByName, out)


def group_shuffle_splits(df: DataFrame, group: str, splits: int = 3, test_size: float = 0.2, seed: int = 0) -> DataFrame:
    """shuffle_splits() of whole groups; rows without a group are one group."""
    return join_null_safe(df, shuffle_splits(df.select(group).distinct(), group, splits, test_size, seed), [group])


def timeseries_splits(df: DataFrame, time: str, splits: int = 3, test_size: int = 1, gap: int = 0, max_train: int | None = None) -> DataFrame:
    """(split_id, ..., role): expanding windows over ranks of unique times. Refuses null times."""
    if df.where(F.col(time).isNull()).limit(1).count():
        raise ValueError(f"{time} has null times")
    times = df.select(time).distinct().withColumn("_u", F.unix_micros(F.col(time).cast("timestamp")).cast("double"))
    n = times.count()
    r = ranked(times, [F.col(time)], value_bucket(times, "_u"), None, "_rank").select(time, (F.col("_rank") - 1).alias("_i"))
    plan = [(i, n - (splits - i) * test_size) for i in range(splits)]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("split_id"), F.lit(s).alias("start")) for i, s in plan])).alias("p")
    x = df.join(r, time).select("*", rows).select("*", "p.*")
    train = (F.col("_i") < F.col("start") - gap) & (F.lit(True) if max_train is None else F.col("_i") >= F.col("start") - gap - max_train)
    role = F.when((F.col("_i") >= F.col("start")) & (F.col("_i") < F.col("start") + test_size), "test").when(train, "train")
    return x.withColumn("role", role).where("role is not null").drop("p", "_i", "start")


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Folds of whole groups, largest first into the emptiest fold; as many greedy steps as there are groups in the largest bucket of sizes.

    Sizes are counted first; groups of one size are dealt round robin, so only distinct sizes reach the driver. Rows without a group are one group.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    r = ranked(sizes, [F.col(group)], F.substring(F.md5(F.coalesce(F.col(group).cast("string"), F.lit(""))), 1, 2), ["_size"], "_i").withColumn("_i", F.col("_i") - 1)
    load, first = [0] * k, {}
    for row in sizes.groupBy("_size").count().orderBy(F.desc("_size")).collect():
        order = sorted(range(k), key=lambda f: (load[f], f))
        first[row["_size"]] = order
        for j, f in enumerate(order):
            load[f] += row["_size"] * (row["count"] // k + (j < row["count"] % k))
    table = df.sparkSession.createDataFrame(list(first.items()), "_size long, _order array<int>")
    folds = r.join(F.broadcast(table), "_size").select(group, F.get("_order", (F.col("_i") % k).cast("int")).alias("fold"))
    return join_null_safe(df, folds, [group])


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """One fold per group, null included as the first; refuses more than MOST_GROUPS."""
    found = df.select(group).distinct().limit(MOST_GROUPS + 1)
    if found.count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    numbered = found.select(F.col(group).alias("_group"), (F.dense_rank().over(Window.orderBy(group)) - 1).cast("int").alias("fold"))
    return df.join(F.broadcast(numbered), F.col(group).eqNullSafe(F.col("_group"))).select(group, *[c for c in df.columns if c != group], "fold")


def stratified_bins(df: DataFrame, target: str, key: str, k: int = 5, bins: int = 5, seed: int = 0) -> DataFrame:
    """Stratified folds over quantile bins of a numeric target."""
    qs = df.agg(F.percentile(target, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0]
    edges = sorted(set(qs))
    b = sum([(F.col(target) > e).cast("int") for e in edges], F.lit(0))
    return kfold(df.withColumn("bin", b), key, k, seed, "bin")


def plan_problems(folds: DataFrame, group: str | None = None, fold: str = "fold") -> DataFrame:
    """Groups that lie in more than one fold."""
    return folds.groupBy(group).agg(F.countDistinct(fold).alias("folds")).where("folds > 1") if group else folds.groupBy(fold).count().where("count < 2")


def fold_summary(scores: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    return scores.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("valid_folds"))



def leave_one_out(df: DataFrame, key: str, most: int = MOST_GROUPS) -> DataFrame:
    """A fold per row, in the order of key; refuses more than most rows."""
    found = df.limit(most + 1)
    if found.count() > most:
        raise ValueError(f"more than {most} rows")
    return found.withColumn("fold", (F.row_number().over(Window.orderBy(key)) - 1).cast("int"))
