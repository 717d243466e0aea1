"""Checks of inputs and targets before a fit: one aggregate each, an error or a row of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_numeric

#: Domains that a target must lie in, by model.
TARGET_DOMAINS = {"gamma": lambda y: y > 0, "poisson": lambda y: y >= 0}
#: Metric -> whether lower (min) or higher (max) is better, or none.
METRICS = {
    **dict.fromkeys(["mse", "rmse", "mae", "medae", "max_error", "mape", "smape", "msle", "pinball", "poisson_deviance", "gamma_deviance", "tweedie_deviance", "log_loss", "brier", "davies_bouldin", "reconstruction_mse"], "min"),
    **dict.fromkeys(["r2", "explained_variance", "accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "jaccard_macro", "mcc", "kappa", "roc_auc", "average_precision", "silhouette", "calinski_harabasz", "adjusted_rand", "homogeneity", "completeness", "v_measure", "normalized_mutual_info", "ndcg", "map", "mrr"], "max"),
    "anomaly_fraction": "none",
}


def direction(metric: str) -> str:
    """min, max or none; an unknown metric is an error that names the known ones."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; choose from {', '.join(METRICS)}")
    return METRICS[metric]


def select_features(df: DataFrame, target: str, roles: list[str] | None = None, drop: list[str] | None = None) -> list[str]:
    """All columns but the target, those with a role of their own, and dropped ones; dropping an unknown column is an error."""
    unknown = [c for c in [target, *(roles or []), *(drop or [])] if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    gone = {target, *(roles or []), *(drop or [])}
    return [c for c in df.columns if c not in gone]


def known_target(df: DataFrame, target: str) -> tuple[DataFrame, int]:
    """(rows with a known target, how many are left out); NaN is unknown."""
    known = F.col(target).isNotNull() & (~F.isnan(target) if dict(df.dtypes)[target] in ("double", "float") else F.lit(True))
    return df.where(known), df.where(~known).count()


def _count(bad: Column, name: str) -> Column:
    return F.count_if(F.coalesce(bad, F.lit(False))).alias(name)


def target_problems(df: DataFrame, target: str, task: str = "regression", weight: str | None = None, group: str | None = None, model: str | None = None, power: float | None = None) -> DataFrame:
    """One row of counts of bad rows: bad_target, bad_domain, bad_weight, no_weight (1 if no weight is above 0), null_group.

    regression wants finite numbers, ranking whole numbers from 0 to 30. model: gamma, poisson or tweedie with its power.
    """
    y = F.col(target).cast("double")
    infinite = F.isnan(y) | (F.abs(y) == float("inf"))
    bad = infinite if task == "regression" else infinite | (y != F.floor(y)) | (y < 0) | (y > 30) if task == "ranking" else F.lit(False)
    if model == "tweedie" and power is not None and 0 < power < 1:
        raise ValueError("no tweedie distribution has a power between 0 and 1")
    rule = TARGET_DOMAINS.get(model) or (((lambda v: v > 0) if power >= 2 else (lambda v: v >= 0) if power >= 1 else None) if model == "tweedie" and power is not None else None)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.agg(
        _count(y.isNull() | bad, "bad_target"), _count(~rule(y) if rule else F.lit(False), "bad_domain"),
        _count(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")), "bad_weight"),
        (F.count_if(w > 0) == 0).cast("long").alias("no_weight"), _count(F.col(group).isNull() if group else F.lit(False), "null_group"),
    )


def check_target(df: DataFrame, target: str, **how) -> None:
    """Raises with the counts of target_problems() if any is above 0."""
    found = {k: v for k, v in target_problems(df, target, **how).first().asDict().items() if v}
    if found:
        raise ValueError(f"{target} cannot be fitted: {found}")


def negative_features(df: DataFrame, features: list[str]) -> list[str]:
    """Columns with a value below 0, which counts-based models refuse."""
    low = df.agg(*[F.min(f).alias(f) for f in features]).first()
    return [f for f in features if low[f] is not None and low[f] < 0]


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n / (classes x rows of the class)."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return n.crossJoin(F.broadcast(total)).select(label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))  # total is one row


def metadata(df: DataFrame, target: str) -> DataFrame:
    """rows, columns, share of missing cells, unique target values, and its smallest, mean and largest."""
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in df.columns])
    y = F.col(target)
    numeric = is_numeric(df.schema[target])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), (F.sum(missing) / (F.count(F.lit(1)) * len(df.columns))).alias("missing_share"),
        F.countDistinct(y).alias("target_unique"), *([F.min(y).alias("target_min"), F.avg(y).alias("target_mean"), F.max(y).alias("target_max")] if numeric else []),
    )
