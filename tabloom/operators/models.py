"""Classifiers and baselines whose fit is one grouped aggregate and whose prediction is a column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.gram import grams
from .prepare import Fitted

#: Classes that a scoring expression may hold.
MOST_CLASSES = 200


def _classes(df: DataFrame) -> list:
    rows = df.limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    return rows


def _best(scores: list[tuple[Column, object]]) -> Column:
    """The class of the highest score; the first class on ties."""
    return F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (s, c) in enumerate(scores)]))["c"]


def dummy_regressor(train: DataFrame, target: str, how: str = "mean", quantile: float = 0.5) -> Fitted:
    v = train.agg((F.avg(target) if how == "mean" else F.percentile(target, F.lit(0.5 if how == "median" else quantile))).alias("v")).first()[0]
    return Fitted(lambda df: df.withColumn("prediction", F.lit(v)), {"value": v})


def dummy_classifier(train: DataFrame, label: str) -> Fitted:
    """The most frequent class (the smallest on ties)."""
    r = train.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).first()
    return Fitted(lambda df: df.withColumn("prediction", F.lit(r and r[0])), {"value": r and r[0]})


def nearest_centroid(train: DataFrame, features: list[str], label: str, metric: str = "euclidean") -> Fitted:
    """Class means, or medians for manhattan; rows with an unknown feature get null."""
    center = F.avg if metric == "euclidean" else lambda c: F.percentile(c, F.lit(0.5))
    rows = _classes(train.dropna(subset=[*features, label]).groupBy(label).agg(*[center(f).alias(f) for f in features]).orderBy(label))
    part = (lambda d: d * d) if metric == "euclidean" else F.abs
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    scores = [(-sum((part(F.col(f) - F.lit(r[f])) for f in features), F.lit(0.0)), r[label]) for r in rows]
    return Fitted(lambda df: df.withColumn("prediction", F.when(known, _best(scores))), {r[label]: [r[f] for f in features] for r in rows})


def gaussian_nb(train: DataFrame, features: list[str], label: str, smoothing: float = 1e-9) -> Fitted:
    """Normal densities per class and feature; smoothing times the largest feature variance is added to every variance."""
    df = train.dropna(subset=[*features, label])
    widest = max(x or 0.0 for x in df.agg(*[F.var_pop(f) for f in features]).first())
    rows = _classes(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.var_pop(f).alias(f"v_{f}") for f in features]).orderBy(label))
    total, scores = sum(r["_n"] for r in rows), []
    for r in rows:
        s = F.lit(float(np.log(r["_n"] / total)))
        for f in features:
            v = r[f"v_{f}"] + smoothing * widest
            d = F.col(f) - F.lit(r[f"m_{f}"])
            s = s - F.lit(float(0.5 * np.log(2 * np.pi * v))) - d * d / F.lit(2 * v)
        scores.append((s, r[label]))
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    return Fitted(lambda x: x.withColumn("prediction", F.when(known, _best(scores))), {"classes": [r[label] for r in rows]})


@dataclass
class LinearClassifier:
    features: list[str]
    classes: list
    weights: np.ndarray
    intercepts: np.ndarray

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        known, scores = F.lit(True), []
        for f in self.features:
            known = known & F.col(f).isNotNull()
        for c, w, b in zip(self.classes, self.weights, self.intercepts, strict=True):
            scores.append((sum((F.lit(float(x)) * F.col(f) for f, x in zip(self.features, w, strict=True)), F.lit(float(b))), c))
        return df.withColumn(name, F.when(known, _best(scores)))


def _by_class(train: DataFrame, features: list[str], label: str):
    parts = grams(train.where(F.col(label).isNotNull()).withColumn("_zero", F.lit(0.0)), features, "_zero", label)
    classes = sorted(parts)
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    n = np.array([parts[c].n for c in classes], float)
    means = np.array([parts[c].mean for c in classes])
    return classes, n, means, sum(parts[c].xx for c in classes)


def ridge_classifier(train: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> LinearClassifier:
    """One against the rest on targets of -1 and 1, all classes from one pass grouped by class."""
    classes, n, means, within = _by_class(train, features, label)
    mean = n @ means / n.sum()
    xx = within + (means - mean).T @ ((means - mean) * n[:, None])
    y = 2 * np.eye(len(classes)) - 1
    y_mean = n @ y / n.sum()
    w = np.linalg.solve(xx + alpha * np.eye(len(features)), ((means - mean) * n[:, None]).T @ (y - y_mean)).T
    return LinearClassifier(features, classes, w, y_mean - w @ mean)


def linear_discriminant(train: DataFrame, features: list[str], label: str) -> LinearClassifier:
    """Class means under the pooled covariance, with class shares as priors."""
    classes, n, means, within = _by_class(train, features, label)
    w = np.linalg.lstsq(within / n.sum(), means.T, rcond=None)[0].T
    return LinearClassifier(features, classes, w, np.log(n / n.sum()) - 0.5 * (w * means).sum(axis=1))


def tree_ensemble(train: DataFrame, features: list[str], label: str, kind: str = "random_forest_regressor", **params):
    """A fitted pyspark.ml pipeline; params are those of the Spark estimator."""
    from pyspark.ml import Pipeline, classification, regression
    from pyspark.ml.feature import VectorAssembler

    made = {
        "decision_tree_regressor": regression.DecisionTreeRegressor, "random_forest_regressor": regression.RandomForestRegressor, "gradient_boosting_regressor": regression.GBTRegressor,
        "decision_tree_classifier": classification.DecisionTreeClassifier, "random_forest_classifier": classification.RandomForestClassifier, "gradient_boosting_classifier": classification.GBTClassifier,
    }[kind]
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"), made(featuresCol="_features", labelCol=label, **params)]).fit(train)


@dataclass
class QuadraticClassifier:
    """A normal density for each class; the prediction is the class of greatest density times share."""

    features: list[str]
    classes: list
    means: np.ndarray
    inverses: np.ndarray
    offsets: np.ndarray

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        known, scores = F.lit(True), []
        for f in self.features:
            known = known & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
        for c, mean, inverse, offset in zip(self.classes, self.means, self.inverses, self.offsets, strict=True):
            d = [F.col(f).cast("double") - F.lit(float(m)) for f, m in zip(self.features, mean, strict=True)]
            form = sum((d[i] * d[j] * F.lit(float(inverse[i, j])) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
            scores.append((F.lit(float(offset)) - form / 2, c))
        return df.withColumn(name, F.when(known, _best(scores)))


def quadratic_discriminant(train: DataFrame, features: list[str], label: str, reg_param: float = 0.0) -> QuadraticClassifier:
    """Class means and covariances (over n - 1), shrunk by reg_param towards the identity, with class shares as priors."""
    if not 0 <= reg_param <= 1:
        raise ValueError("reg_param must be from 0 to 1")
    parts = grams(train.where(F.col(label).isNotNull()).withColumn("_zero", F.lit(0.0)), features, "_zero", label)
    classes = sorted(parts)
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    total, inverses, offsets = sum(parts[c].n for c in classes), [], []
    for c in classes:
        if parts[c].n < 2:
            raise ValueError(f"class {c} has fewer than two rows with known features")
        cov = (1 - reg_param) * parts[c].xx / (parts[c].n - 1) + reg_param * np.eye(len(features))
        sign, size = np.linalg.slogdet(cov)
        if sign <= 0 or np.linalg.cond(cov) > 1e14:
            raise ValueError(f"the covariance of class {c} has no inverse: set reg_param")
        inverses.append(np.linalg.inv(cov))
        offsets.append(np.log(parts[c].n / total) - size / 2)
    return QuadraticClassifier(features, classes, np.array([parts[c].mean for c in classes]), np.array(inverses), np.array(offsets))
