"""Ensembles of fitted models: bagging, boosting by reweighting, voting and stacking.

A member is anything with transform() that adds prediction (and probabilities, in the order of classes). Weights of bagging are hashes of
seed, member and key; those of boosting are a column of a table written anew after each round, so that lineage does not grow.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_numeric, shuffled_rank
from ..functions.stages import keep
from . import learn as L

FitFunction = Callable[[DataFrame], object]


def _with(df: DataFrame, members: list, probabilities: bool) -> DataFrame:
    """df with p0, p1, ... (and q0, ... if probabilities) of the members."""
    for i, m in enumerate(members):
        given = df.columns
        out = m.transform(df)
        made = [F.col("prediction").alias(f"_p{i}")] + ([F.col("probabilities").alias(f"_q{i}")] if probabilities else [])
        df = out.select(*given, *made)
    return df


def _argmax(classes: list[str], scores: list[Column]) -> Column:
    """The class of the largest score; ties go to the first."""
    a = F.array(*scores)
    return F.get(F.array(*map(F.lit, classes)), (F.array_position(a, F.array_max(a)) - 1).cast("int"))


@dataclass
class Ensemble:
    """kind: mean, median (weighted), hard (weighted votes), soft (mean probabilities) or stack (a meta model on the members' results)."""

    kind: str
    members: list
    weights: list[float]
    classes: list[str] | None = None
    meta: object | None = None
    trace: list[dict] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prediction, and probabilities for soft; null where a feature of a member is unknown."""
        given, n = df.columns, len(self.members)
        x = _with(df, self.members, self.kind == "soft" or (self.kind == "stack" and self.classes is not None))
        p = [F.col(f"_p{i}") for i in range(n)]
        known = reduce(lambda a, b: a & b, [c.isNotNull() for c in p])
        total = float(sum(self.weights))
        if self.kind == "stack":
            made = _meta_features(x, n, self.classes)
            return self.meta.transform(made).select(*given, *(["probabilities"] if self.classes and "probabilities" not in given else []), "prediction")
        if self.kind == "mean":
            return x.withColumn("prediction", sum((c * F.lit(w / total) for c, w in zip(p, self.weights, strict=True)), F.lit(0.0))).select(*given, "prediction")
        if self.kind == "median":
            # The first prediction, in order, at which the weights reach half of their sum.
            pairs = F.array_sort(F.array(*[F.struct(c.alias("p"), F.lit(w).alias("w")) for c, w in zip(p, self.weights, strict=True)]))
            start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
            half = F.lit(total / 2 * (1 - 1e-12))
            step = lambda s, e: F.struct((s["sum"] + e["w"]).alias("sum"), F.when(s["at"].isNull() & (s["sum"] + e["w"] >= half), e["p"]).otherwise(s["at"]).alias("at"))
            return x.withColumn("prediction", F.when(known, F.aggregate(pairs, start, step)["at"])).select(*given, "prediction")
        if self.kind == "hard":
            votes = [sum((F.when(c == k, w).otherwise(0.0) for c, w in zip(p, self.weights, strict=True)), F.lit(0.0)) for k in self.classes]
            return x.withColumn("prediction", F.when(known, _argmax(self.classes, votes))).select(*given, "prediction")
        mean = [sum((F.get(f"_q{i}", F.lit(j)) * F.lit(w / total) for i, w in enumerate(self.weights)), F.lit(0.0)) for j in range(len(self.classes))]
        return x.withColumn("probabilities", F.when(known, F.array(*mean))).withColumn("prediction", F.when(known, _argmax(self.classes, mean))).select(*given, "probabilities", "prediction")

    def save(self, df: DataFrame, path: str) -> None:
        """Members and meta model must be models of the learn module."""
        for i, m in enumerate(self.members):
            m.save(f"{path}/member{i}")
        if self.meta is not None:
            self.meta.save(f"{path}/meta")
        state = {"kind": self.kind, "n": len(self.members), "weights": self.weights, "classes": self.classes, "meta": self.meta is not None, "trace": self.trace}
        df.sparkSession.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/ensemble")


def load_ensemble(df: DataFrame, path: str) -> Ensemble:
    s = json.loads(df.sparkSession.read.text(f"{path}/ensemble").first()[0])
    return Ensemble(s["kind"], [L.load(f"{path}/member{i}") for i in range(s["n"])], s["weights"], s["classes"], L.load(f"{path}/meta") if s["meta"] else None, s["trace"])


def _uniform(seed: int, member: int, key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(f"{seed}|{member}"), F.col(key).cast("string")), F.lit(1 << 52)) / float(1 << 52)


def _poisson(u: Column, mean: float) -> Column:
    """Poisson counts from uniform draws, by the inverse distribution function."""
    out, p, total, k = F.lit(0.0), np.exp(-mean), np.exp(-mean), 0
    while total < 1 - 1e-12 and k < 60:
        k += 1
        out = out + (u >= total).cast("double")
        p *= mean / k
        total += p
    return out


def bagging(train: DataFrame, key: str, features: list[str], target: str, kind: str = "tree", classify: bool = False, members: int = 10, max_samples: float = 1.0, bootstrap: bool = True, seed: int = 0, **options) -> Ensemble:
    """members models of one kind, each on rows weighted by a Poisson count (bootstrap) or drawn with probability max_samples; predictions are averaged.

    Classifiers average probabilities where they have them, else they vote.
    """
    if members < 1 or not 0 < max_samples <= 1:
        raise ValueError("one member at least, and max_samples above 0 and at most 1")
    out = []
    for i in range(members):
        u = _uniform(seed, i, key)
        # A count is above 0 from the first step of the distribution on; asked of u itself, so that a filter works out one hash a row.
        rows = train.where(u >= float(np.exp(-max_samples)) if bootstrap else u < max_samples).withColumn("_weight", _poisson(u, max_samples) if bootstrap else F.lit(1.0))
        out.append(L.classifier(rows, features, target, kind, weight="_weight", **options) if classify else L.regressor(rows, features, target, kind, weight="_weight", **options))
    if not classify:
        return Ensemble("mean", out, [1.0] * members)
    classes = sorted({c for m in out for c in m.classes})
    soft = all(m.classes == classes for m in out) and kind in ("logistic", "naive_bayes", "tree", "forest")
    return Ensemble("soft" if soft else "hard", out, [1.0] * members, classes)


def _start(known: DataFrame, features: list[str], target: str, options: dict) -> DataFrame:
    """The rows that boosting weighs: those with equal features and target are right and wrong together, so one stands for them with their number."""
    if L.mergeable(options) and all(is_numeric(known.schema[f]) for f in features):
        return keep(L.equal_rows(known, [*features, target], None))
    return keep(known.withColumn("_weight", F.lit(1.0)))


def adaboost_classifier(train: DataFrame, key: str, features: list[str], target: str, rounds: int = 10, learning_rate: float = 1.0, **options) -> Ensemble:
    """SAMME over depth-limited trees: after each round a wrong row's weight grows by exp(rate x (ln((1 - e) / e) + ln(K - 1))), e its weighted error.

    Ends early with a member that errs never (it alone decides from then on) or no better than chance (it is left out, unless it is the first, which is refused).
    """
    known = train.dropna(subset=[*features, target]).withColumn(target, F.col(target).cast("string"))
    classes = sorted(r[0] for r in known.select(target).distinct().limit(1001).collect())
    if not 2 <= len(classes) <= 1000:
        raise ValueError("a classifier needs 2 to 1000 classes")
    rows = _start(known, features, target, options)
    members, weights, trace = [], [], []
    for r in range(rounds):
        model = L.classifier(rows, features, target, "tree", weight="_weight", **{"maxDepth": 1} | options)
        scored = model.transform(rows).withColumn("_wrong", (F.col("prediction") != F.col(target)).cast("double")).select(*rows.columns, "_wrong")
        total, wrong = scored.agg(F.sum("_weight"), F.sum(F.col("_weight") * F.col("_wrong"))).first()
        error = wrong / total
        if error >= 1 - 1 / len(classes):
            if not members:
                raise ValueError("the first member is no better than chance")
            break
        alpha = 1.0 if error <= 0 else learning_rate * (np.log((1 - error) / error) + np.log(len(classes) - 1))
        members.append(model)
        weights.append(float(alpha))
        trace.append({"round": r, "error": float(error), "weight": float(alpha)})
        if error <= 0:
            break
        # Weights keep a mean of 1.
        mean = (total - wrong + wrong * np.exp(alpha)) / total
        rows = keep(scored.withColumn("_weight", F.col("_weight") * F.exp(F.lit(float(alpha)) * F.col("_wrong")) / F.lit(float(mean))).drop("_wrong"))
    return Ensemble("hard", members, weights, classes, trace=trace)


def adaboost_regressor(train: DataFrame, key: str, features: list[str], target: str, rounds: int = 10, learning_rate: float = 1.0, loss: str = "linear", **options) -> Ensemble:
    """AdaBoost.R2: losses |error| / largest |error| (linear, square or exponential); weights shrink by beta^(1 - loss), beta = mean loss / (1 - mean loss); the weighted median of the members predicts.

    Rows are weighted, not drawn. Ends at a mean loss of a half or more.
    """
    if loss not in ("linear", "square", "exponential"):
        raise ValueError("loss must be linear, square or exponential")
    known = train.dropna(subset=[*features, target])
    rows, members, weights, trace = _start(known, features, target, options), [], [], []
    for r in range(rounds):
        model = L.regressor(rows, features, target, "tree", weight="_weight", **{"maxDepth": 3} | options)
        scored = model.transform(rows).withColumn("_error", F.abs(F.col(target).cast("double") - F.col("prediction"))).select(*rows.columns, "_error")
        worst = scored.agg(F.max("_error")).first()[0] or 0.0
        if worst <= 0:
            members, weights = [*members, model], [*weights, 1.0]
            break
        e = F.col("_error") / F.lit(worst)
        scored = scored.withColumn("_loss", {"linear": e, "square": e * e, "exponential": 1 - F.exp(-e)}[loss])
        mean = float(scored.agg(F.sum(F.col("_weight") * F.col("_loss")) / F.sum("_weight")).first()[0])
        if mean >= 0.5:
            if not members:
                members, weights = [model], [1.0]
            break
        beta = mean / (1 - mean)
        members.append(model)
        weights.append(float(learning_rate * np.log(1 / beta)))
        trace.append({"round": r, "error": mean, "weight": weights[-1]})
        rows = keep(scored.withColumn("_weight", F.col("_weight") * F.pow(F.lit(beta), (1 - F.col("_loss")) * learning_rate)).drop("_error", "_loss"))
    return Ensemble("median", members, weights, trace=trace)


def voting(models: list, weights: list[float] | None = None, classes: list[str] | None = None, soft: bool = False) -> Ensemble:
    """Mean of regressors; weighted votes of classifiers, or (soft) the mean of their probabilities, which must be in the order of classes."""
    if not models:
        raise ValueError("no models")
    if soft and any(getattr(m, "classes", classes) != classes for m in models):
        raise ValueError("soft voting needs members with the same classes")
    return Ensemble("mean" if classes is None else "soft" if soft else "hard", models, weights or [1.0] * len(models), classes)


def _meta_features(x: DataFrame, n: int, classes: list[str] | None) -> DataFrame:
    """m0, m1, ...: the members' predictions, or their probabilities without the last class."""
    if classes is None:
        return x.withColumns({f"m{i}": F.col(f"_p{i}").cast("double") for i in range(n)})
    return x.withColumns({f"m{i * (len(classes) - 1) + j}": F.get(f"_q{i}", F.lit(j)) for i in range(n) for j in range(len(classes) - 1)})


def out_of_fold(train: DataFrame, key: str, members: list[FitFunction], folds: int = 5, seed: int = 0, probabilities: bool = False) -> DataFrame:
    """train with _fold and the results of members that were fitted without the row's fold; a row per row."""
    ranked = keep(shuffled_rank(train, seed, key, name="_rank").withColumn("_fold", (F.col("_rank") % folds).cast("int")).drop("_rank"))
    parts = [_with(ranked.where(F.col("_fold") == k), [fit(ranked.where(F.col("_fold") != k)) for fit in members], probabilities) for k in range(folds)]
    return keep(reduce(DataFrame.unionByName, parts))


def stacking(train: DataFrame, key: str, members: list[FitFunction], target: str, meta: str = "huber", classify: bool = False, folds: int = 5, seed: int = 0, **options) -> Ensemble:
    """A meta model on out-of-fold results of the members, which are then fitted on all rows. Rows must be independent: no groups, no series.

    members: functions from training rows to a model of the learn module; classifiers need probabilities and all classes in each fold.
    """
    known = train.where(F.col(target).isNotNull())
    oof = out_of_fold(known, key, members, folds, seed, classify)
    final = [fit(known) for fit in members]
    classes = final[0].classes if classify else None
    if classify and any(m.classes != classes for m in final):
        raise ValueError("members differ in their classes")
    made = _meta_features(oof, len(members), classes)
    names = [f"m{i}" for i in range(len(members) * (len(classes) - 1 if classes else 1))]
    model = L.classifier(made, names, target, meta, **options) if classify else L.regressor(made, names, target, meta, **options)
    return Ensemble("stack", final, [1.0] * len(final), classes, model)
