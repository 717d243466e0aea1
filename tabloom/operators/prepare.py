"""Feature preparation: statistics are fitted on training rows, frozen in a small model, and applied as columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation_of, join_null_safe, ranked


@dataclass
class Fitted:
    """A frozen transformation: columns that it adds or replaces, and the statistics behind it."""

    apply: Callable[[DataFrame], DataFrame]
    stats: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


def _row(df: DataFrame, aggs: dict[str, Column]) -> dict:
    return df.agg(*[c.alias(k) for k, c in aggs.items()]).first().asDict()


def impute(train: DataFrame, columns: list[str], how: str = "median", value: float | None = None, indicator: bool = False) -> Fitted:
    """median, mean, most_frequent (the smallest on ties) or constant; columns without a known value become 0."""
    if how == "constant":
        stats = dict.fromkeys(columns, value)
    elif how == "most_frequent":
        stats = {c: (r := train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()) and r[0] for c in columns}
    else:
        stats = _row(train, {c: F.percentile(c, F.lit(0.5)) if how == "median" else F.avg(c) for c in columns})
    gaps = [c for c, n in _row(train, {c: F.count_if(F.col(c).isNull()) for c in columns}).items() if n] if indicator else []
    made = {c: F.coalesce(F.col(c), F.lit(0 if v is None else v)) for c, v in stats.items()}
    return Fitted(lambda df: df.withColumns({f"{c}__missing": F.col(c).isNull().cast("int") for c in gaps} | made) if not gaps else df.withColumns({f"{c}__missing": F.col(c).isNull().cast("int") for c in gaps}).withColumns(made), stats)


def scale(train: DataFrame, columns: list[str], how: str = "standard") -> Fitted:
    """standard (population deviation), robust (interpolated quartiles), minmax, maxabs; constant columns are only shifted."""
    ask: dict[str, Column] = {}
    for c in columns:
        a, b = {
            "standard": (F.avg(c), F.stddev_pop(c)), "robust": (F.percentile(c, F.lit(0.5)), F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))),
            "minmax": (F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")), "maxabs": (F.lit(0.0), F.max(F.abs(c)).cast("double")),
        }[how]
        ask |= {f"{c}|a": a, f"{c}|b": b}
    s = _row(train, ask)
    return Fitted(lambda df: df.withColumns({c: (F.col(c) - F.lit(s[f"{c}|a"] or 0.0)) / F.lit(s[f"{c}|b"] or 1.0) for c in columns}), s)


def normalize_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
    return df.withColumn("_norm", F.when(norm == 0, 1.0).otherwise(norm)).withColumns({c: F.col(c) / F.col("_norm") for c in columns}).drop("_norm")


def clip(train: DataFrame, columns: list[str], lower: float = 0.05, upper: float = 0.95) -> Fitted:
    s = _row(train, {c: F.percentile(c, F.array(F.lit(lower), F.lit(upper))) for c in columns})
    return Fitted(lambda df: df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(q[1])), F.lit(q[0]))) for c, q in s.items()}), s)


def signed(c: Column, how: str) -> Column:
    return F.signum(c) * (F.log1p(F.abs(c)) if how == "log1p" else F.sqrt(F.abs(c)))


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = False) -> DataFrame:
    """Products by degree, then in the order of columns."""
    pick = combinations if interaction_only else combinations_with_replacement
    terms = [t for d in range(1, degree + 1) for t in pick(columns, d)]
    if len(terms) > 2000:
        raise ValueError("more than 2000 terms")
    out = {}
    for t in terms:
        c = F.col(t[0])
        for x in t[1:]:
            c = c * F.col(x)
        out["*".join(t)] = c
    return df.select("*", *[c.alias(k) for k, c in out.items() if k not in df.columns])


def bins(train: DataFrame, column: str, count: int = 5, how: str = "quantile") -> Fitted:
    """Ordinal bins; values beyond the fitted range fall into the end bins."""
    if how == "uniform":
        lo, hi = train.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
        edges = [lo + (hi - lo) * i / count for i in range(1, count)]
    else:
        edges = sorted(set(train.agg(F.percentile(column, F.array(*[F.lit(i / count) for i in range(1, count)]))).first()[0]))
    return Fitted(lambda df: df.withColumn(f"{column}__bin", F.when(F.col(column).isNotNull(), sum([(F.col(column) >= e).cast("int") for e in edges], F.lit(0)))), {"edges": edges})


#: Categories that may become columns.
MOST_CATEGORIES = 2000


def _category_counts(train: DataFrame, column: str, min_count: int = 1) -> DataFrame:
    return train.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).count().where(F.col("count") >= min_count)


def categories(train: DataFrame, column: str, min_count: int = 1, limit: int | None = None) -> list[str]:
    """Known values in lexicographic order; the most frequent if there is a limit. Refuses more than MOST_CATEGORIES."""
    top = _category_counts(train, column, min_count).orderBy(F.desc("count"), "v").limit(min(limit or MOST_CATEGORIES + 1, MOST_CATEGORIES + 1)).collect()
    if len(top) > MOST_CATEGORIES:
        raise ValueError(f"{column} has more than {MOST_CATEGORIES} categories; give a limit or a min_count")
    return sorted(r["v"] for r in top)


def onehot(train: DataFrame, column: str, min_count: int = 1, limit: int | None = None) -> Fitted:
    """0/1 columns; values unknown in training give zeros."""
    known = categories(train, column, min_count, limit)
    return Fitted(lambda df: df.select("*", *[F.coalesce((F.col(column).cast("string") == v).cast("int"), F.lit(0)).alias(f"{column}={v}") for v in known]), {"categories": known})


def ordinal(train: DataFrame, column: str, order: list[str] | None = None) -> Fitted:
    """Position in the given or lexicographic order; unknown -1, missing -2. Without an order, every known value is in a table."""
    code = f"{column}__code"
    if order:
        lookup = F.broadcast(train.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], f"`{column}` string, `{code}` int"))
    else:
        values = ranked(_category_counts(train, column).select("v"), [F.col("v")], F.substring("v", 1, 2), None, "_rank")
        lookup = values.select(F.col("v").alias(column), (F.col("_rank") - 1).cast("int").alias(code))
    return Fitted(lambda df: df.join(lookup, column, "left").withColumn(code, F.when(F.col(column).isNull(), -2).otherwise(F.coalesce(code, F.lit(-1)))), {"categories": order or lookup})


def frequency(train: DataFrame, column: str, normalize: bool = True) -> Fitted:
    counts = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    table = counts.crossJoin(F.broadcast(total)).select(column, (F.col("_n") / (F.col("_all") if normalize else F.lit(1.0))).alias(f"{column}__freq"))
    return Fitted(lambda df: df.join(table, column, "left").withColumn(f"{column}__freq", F.coalesce(f"{column}__freq", F.lit(0.0))))


def target_encode(train: DataFrame, column: str, target: str, fold: str, smooth: float = 10.0) -> tuple[DataFrame, Fitted]:
    """(train with out-of-fold encodings, model for other rows): (n mean + smooth global) / (n + smooth). Null is a category."""
    per = train.groupBy(fold, column).agg(F.sum(target).alias("_s"), F.count(target).alias("_c"))
    all_ = per.groupBy(column).agg(F.sum("_s").alias("_as"), F.sum("_c").alias("_ac"))
    by_fold = per.groupBy(fold).agg(F.sum("_s").alias("_fs"), F.sum("_c").alias("_fc"))
    total = per.agg(F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"))
    name = f"{column}__target"
    enc = lambda s, c, g: (s + smooth * g) / (c + smooth)
    table = join_null_safe(join_null_safe(per, all_, [column]), by_fold, [fold]).crossJoin(F.broadcast(total)).select(fold, column, enc(F.col("_as") - F.col("_s"), F.col("_ac") - F.col("_c"), (F.col("_ts") - F.col("_fs")) / (F.col("_tc") - F.col("_fc"))).alias(name))
    whole = all_.crossJoin(F.broadcast(total)).select(column, enc(F.col("_as"), F.col("_ac"), F.col("_ts") / F.col("_tc")).alias(name))

    def apply(df: DataFrame) -> DataFrame:
        return join_null_safe(df, whole, [column], "left").crossJoin(F.broadcast(total.select((F.col("_ts") / F.col("_tc")).alias("_g")))).withColumn(name, F.coalesce(name, "_g")).drop("_g")

    return join_null_safe(train, table, [fold, column]), Fitted(apply)


def tfidf(df: DataFrame, key: str, text: str, max_features: int = 1000, ngrams: int = 1, lowercase: bool = True, weights: bool = True) -> DataFrame:
    """Long form (key, term, weight): counts, or L2-normalised tf x (ln((1 + n) / (1 + df)) + 1), of the most frequent terms."""
    t = F.coalesce(F.lower(text) if lowercase else F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    df2 = df.select(key, words.alias("_w"))
    grams = F.col("_w")
    for n in range(2, ngrams + 1):
        grams = F.concat(grams, F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - n, F.lit(-1))), lambda i, n=n: F.array_join(F.slice("_w", i + 1, n), " ")))
    terms = df2.select(key, F.explode(grams).alias("term"))
    # Frequency alone picks the terms, so only they are counted by key: the pairs of all others are never dealt.
    chosen = terms.groupBy("term").agg(F.count(F.lit(1)).alias("_all")).orderBy(F.desc("_all"), "term").limit(max_features).select("term")
    counts = terms.join(F.broadcast(chosen), "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    kept = counts.join(F.broadcast(counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))), "term")
    if not weights:
        return kept.select(key, "term", F.col("tf").alias("weight"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    raw = kept.crossJoin(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.ln((1 + F.col("_n")) / (1 + F.col("_df"))) + 1)).alias("w"))
    return raw.select(key, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("weight"))


PERIODS = {"month": (12, 1), "weekday": (7, 0), "hour": (24, 0), "minute": (60, 0), "dayofyear": (366, 1)}


def datetime_parts(df: DataFrame, column: str, parts: list[str], cyclic: bool = False, timezone: str = "UTC") -> DataFrame:
    """Parts of a time (Monday is 0); with cyclic, sine and cosine of those that repeat. Unreadable times give null."""
    t = F.from_utc_timestamp(F.col(column).try_cast("timestamp"), timezone)
    fields = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "weekday": F.weekday(t), "hour": F.hour(t), "minute": F.minute(t), "dayofyear": F.dayofyear(t), "weekend": (F.weekday(t) >= 5).cast("int")}
    out: dict[str, Column] = {}
    for p in parts:
        if cyclic and p in PERIODS:
            period, offset = PERIODS[p]
            angle = (fields[p] - offset) * (2 * 3.141592653589793 / period)
            out |= {f"{column}__{p}_sin": F.sin(angle), f"{column}__{p}_cos": F.cos(angle)}
        else:
            out[f"{column}__{p}"] = fields[p]
    return df.withColumns(out)


def variances(train: DataFrame, columns: list[str]) -> DataFrame:
    return train.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.var_pop(c).alias("variance")) for c in columns]).alias("x")).select(F.inline("x"))


def f_regression(train: DataFrame, columns: list[str], target: str) -> DataFrame:
    def cell(c: str) -> Column:
        r2 = F.least(F.pow(correlation_of(c, target), F.lit(2.0)), F.lit(1 - 1e-12))
        return F.struct(F.lit(c).alias("feature"), (r2 / (1 - r2) * (F.count(target) - 2)).alias("score"))

    return train.agg(F.array(*[cell(c) for c in columns]).alias("x")).select(F.inline("x"))


def anova(train: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Between-class over within-class variance for each feature."""
    long = train.select(F.col(label).alias("c"), F.inline(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("v")) for x in columns])))
    per = long.groupBy("feature", "c").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    g = per.groupBy("feature").agg(F.sum("n").alias("rows"), F.sum("s").alias("total"), F.sum("q").alias("squares"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("within_sq"), F.count("c").alias("k"))
    between = F.col("within_sq") - F.col("total") * F.col("total") / F.col("rows")
    within = F.col("squares") - F.col("within_sq")
    return g.select("feature", (between / (F.col("k") - 1) / (within / (F.col("rows") - F.col("k")))).alias("score"))


def chi2(train: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Of nonnegative sums per class against those expected from class shares."""
    n = train.agg(F.count(F.lit(1)).alias("rows"))
    long = train.select(F.col(label).alias("c"), F.inline(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("v")) for x in columns])))
    per = long.groupBy("feature", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("o"))
    tot = per.groupBy("feature").agg(F.sum("o").alias("all"))
    e = F.col("all") * F.col("n") / F.col("rows")
    return per.join(tot, "feature").crossJoin(F.broadcast(n)).groupBy("feature").agg(F.sum(F.pow(F.col("o") - e, F.lit(2.0)) / e).alias("score"))


def random_over(train: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Every class up to the size of the largest: whole copies, and one more for the first rows of its shuffled order. A null label is a class."""
    from ..functions.columns import shuffled_rank

    n = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    top = n.agg(F.max("_n").alias("_top"))
    r = join_null_safe(shuffled_rank(train, seed, key, [label], "_rank"), n.crossJoin(F.broadcast(top)), [label])
    copies = F.floor(F.col("_top") / F.col("_n")) + (F.col("_rank") <= F.col("_top") % F.col("_n")).cast("int")
    return r.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_rank", "_n", "_top")


def random_under(train: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    from ..functions.columns import shuffled_rank

    n = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_low"))
    return shuffled_rank(train, seed, key, [label], "_rank").crossJoin(F.broadcast(n)).where("_rank <= _low").drop("_rank", "_low")


def quantile_uniform(train: DataFrame, column: str, count: int = 32) -> Fitted:
    """Piecewise-linear distribution function through count + 1 quantiles; a value shared by several quantiles gets their middle."""
    q = train.agg(F.percentile(column, F.array(*[F.lit(i / count) for i in range(count + 1)]))).first()[0]
    x = F.col(column)
    total = F.lit(0.0)
    for a, b in zip(q, q[1:], strict=False):
        total = total + (F.least(F.greatest((x - a) / (b - a), F.lit(0.0)), F.lit(1.0)) if b > a else F.when(x > a, 1.0).when(x == a, 0.5).otherwise(0.0))
    return Fitted(lambda df: df.withColumn(column, F.when(x <= q[0], 0.0).when(x >= q[-1], 1.0).when(x.isNotNull(), total / count)), {"quantiles": q})


def _power(x: Column, p: float, how: str) -> Column:
    if how == "box_cox":
        return F.ln(x) if abs(p) < 1e-9 else (F.pow(x, F.lit(p)) - 1) / p
    up = F.log1p(x) if abs(p) < 1e-9 else (F.pow(x + 1, F.lit(p)) - 1) / p
    down = -F.log1p(-x) if abs(p - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - p)) - 1) / (2 - p)
    return F.when(x >= 0, up).otherwise(down)


def power(train: DataFrame, column: str, how: str = "yeo_johnson") -> Fitted:
    """Yeo-Johnson, or Box-Cox for positive values: the exponent of highest likelihood, twenty candidates a pass, four passes."""
    x = F.col(column).cast("double")
    log = F.ln(x) if how == "box_cox" else F.signum(x) * F.log1p(F.abs(x))
    lo, hi = -5.0, 5.0
    for _ in range(4):
        grid = [lo + (hi - lo) * i / 20 for i in range(21)]
        r = train.agg(F.count(column).alias("n"), F.sum(log).alias("log"), *[F.var_pop(_power(x, p, how)).alias(f"v{i}") for i, p in enumerate(grid)]).first()
        best = max((i for i in range(21) if r[f"v{i}"]), key=lambda i: -r["n"] / 2 * math.log(r[f"v{i}"]) + (grid[i] - 1) * r["log"], default=None)
        if best is None:
            return Fitted(lambda df: df, {"exponent": None})
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, 20)]
    p = grid[best]
    return Fitted(lambda df: df.withColumn(column, _power(x, p, how)), {"exponent": p})


def mutual_information(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Of two discrete columns, in nats."""
    joint = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(feature).alias("a"), F.col(label).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    a, b = joint.groupBy("a").agg(F.sum("n").alias("na")), joint.groupBy("b").agg(F.sum("n").alias("nb"))
    total = joint.agg(F.sum("n").alias("all"))
    x = joint.join(a, "a").join(b, "b").crossJoin(F.broadcast(total))
    return x.agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mutual_information"))
