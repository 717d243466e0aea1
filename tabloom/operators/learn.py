"""Estimators with probabilities, weights and saved models: pyspark.ml pipelines on named columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml import clustering as MK
from pyspark.ml import regression as MR
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_quantiles, finite, is_numeric, order_statistics
from ..functions.stages import keep
from .checks import balanced_weights, check_target, direction
from .gradient import _sums, packed

VECTOR = "features_vector"
#: Distinct rows that a task of an iterative fit reads, where there are no more tasks than the rows came in.
TASK_ROWS = 1 << 16


@dataclass
class Model:
    """A fitted pipeline with what it needs to be used again: features, target and, for classifiers, the classes in order."""

    pipeline: PipelineModel
    features: list[str]
    target: str | None
    classes: list[str] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prediction (for classifiers the class) and, where the model has them, probabilities in the order of classes.

        Every row stays; where a feature is unknown, prediction and probabilities are null. df may lack the target.
        """
        known = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in self.features])
        kinds = dict(df.dtypes)
        ready = df.withColumn("_known", known).withColumn("_given", F.struct(*self.features)).withColumns({f: F.when(F.col("_known"), F.col(f)).otherwise(F.lit(0).cast(kinds[f])) for f in self.features})
        stages = [s for s in self.pipeline.stages if not s.uid.startswith("StringIndexer")]
        out = PipelineModel(stages).transform(ready)
        if "probability" in out.columns:
            out = out.withColumn("probabilities", F.when(F.col("_known"), vector_to_array("probability")))
        if self.classes is not None:
            out = out.withColumn("prediction", F.get(F.array(*map(F.lit, self.classes)), F.col("prediction").cast("int")))
        out = out.withColumn("prediction", F.when(F.col("_known"), F.col("prediction"))).withColumns({f: F.col("_given").getField(f) for f in self.features})
        return out.drop(VECTOR, "rawPrediction", "probability", "_known", "_given")

    def probabilities(self, df: DataFrame, classes: list[str]) -> DataFrame:
        """transform() with probabilities aligned to an outer list of classes; classes that the model has not seen get 0."""
        at = {c: i for i, c in enumerate(self.classes or [])}
        return self.transform(df).withColumn("probabilities", F.array(*[F.get("probabilities", F.lit(at[c])) if c in at else F.lit(0.0) for c in classes]))

    def coefficients(self) -> list[tuple[str, str | None, float]]:
        """(feature, class, value): coefficients, or importances of trees."""
        last = self.pipeline.stages[-1]
        if hasattr(last, "coefficientMatrix") and last.numClasses > 2:
            return [(f, self.classes[k], float(last.coefficientMatrix[k, j])) for k in range(last.numClasses) for j, f in enumerate(self.features)]
        values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
        return [(f, None, float(values[j])) for j, f in enumerate(self.features)]

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        row = [(self.features, self.target, self.classes)]
        _session().createDataFrame(row, "features array<string>, target string, classes array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/contract")


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def load(path: str) -> Model:
    """A saved model; it predicts as it did."""
    c = _session().read.schema("features array<string>, target string, classes array<string>").json(f"{path}/contract").first()
    return Model(PipelineModel.load(f"{path}/pipeline"), list(c["features"]), c["target"], list(c["classes"]) if c["classes"] else None)


def _fit(df: DataFrame, features: list[str], target: str | None, estimator, label: str | None = None) -> Model:
    stages = [VectorAssembler(inputCols=features, outputCol=VECTOR)]
    if label:
        stages.append(StringIndexer(inputCol=target, outputCol=label, stringOrderType="alphabetAsc"))
    fitted = Pipeline(stages=[*stages, estimator.setFeaturesCol(VECTOR)]).fit(df)
    return Model(fitted, features, target, list(fitted.stages[1].labels) if label else None)


def mergeable(options: dict) -> bool:
    """Whether a tree's options ask for weights only, not for numbers of rows."""
    return options.get("minInstancesPerNode", 1) == 1


def equal_rows(df: DataFrame, columns: list[str], weight: str | None) -> DataFrame:
    """Distinct rows of columns with the sum of their weights as _weight; a weight that a model would refuse stays one."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    refused = F.count_if(w.isNull() | F.isnan(w) | (w < 0)) > 0
    return df.groupBy(*columns).agg(F.when(refused, -1.0).otherwise(F.sum(w)).alias("_weight"))


def _equal_features(df: DataFrame, features: list[str], target: str, weight: str | None) -> DataFrame:
    """One or two rows for the rows of equal features, with their weight, mean and variance of the target: a tree cannot tell them apart.

    Moments are taken about one of the targets, so that a large mean takes no digits; targets that are all the same stay as they are.
    """
    first = df.select(finite(F.col(target)).alias("y")).first()
    middle = first["y"] or 0.0 if first else 0.0
    w, y = F.col(weight).cast("double") if weight else F.lit(1.0), F.col(target).cast("double")
    d = y - F.lit(middle)
    refused = F.count_if(w.isNull() | F.isnan(w) | (w < 0)) > 0
    cells = df.groupBy(*features).agg(F.when(refused, -1.0).otherwise(F.sum(w)).alias("_w"), F.sum(w * d).alias("_s"), F.sum(w * d * d).alias("_ss"), F.min(y).alias("_low"), F.max(y).alias("_high"))
    mean = F.col("_s") / F.col("_w")
    sd = F.sqrt(F.greatest(F.col("_ss") / F.col("_w") - mean * mean, F.lit(0.0)))
    targets = F.when((F.col("_low") == F.col("_high")) | (F.col("_w") <= 0), F.array("_low")).otherwise(F.array(F.lit(middle) + mean - sd, F.lit(middle) + mean + sd))
    cells = cells.withColumn("_targets", targets).withColumn("_weight", F.col("_w") / F.size("_targets"))
    return cells.select(*features, F.explode("_targets").alias(target), "_weight")


def _minimum(evaluate: Callable, at: np.ndarray, steps: int, tol: float, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS on evaluate(at) -> (loss, slope), with steps that lower the loss and flatten its slope enough.

    Ends after steps, at a slope of no length, or when ten steps gain less than tol of the first loss.
    """
    value, slope = evaluate(at)
    past, values = [], [value]
    for _ in range(steps):
        if np.linalg.norm(slope) <= max(tol * abs(value), 1e-8) or (len(values) > 10 and values[-11] - value <= tol * abs(values[0])):
            break
        move, taken = -slope, []
        for s, y in reversed(past):
            taken.append(s @ move / (s @ y))
            move = move - taken[-1] * y
        if past:
            move = move * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(taken), strict=True):
            move = move + (a - y @ move / (s @ y)) * s
        length, low, high, along = 1.0 if past else 1 / np.linalg.norm(slope), 0.0, np.inf, slope @ move
        for _ in range(20):
            there = at + length * move
            found = evaluate(there)
            if not found[0] <= value + 1e-4 * length * along:
                high = length
            elif found[1] @ move < 0.9 * along:
                low = length
            else:
                break
            length = (low + high) / 2 if high < np.inf else 2 * low
        if not found[0] < value:
            break
        s, y = there - at, found[1] - slope
        if s @ y > 0:
            past = [*past, (s, y)][-memory:]
        at, (value, slope) = there, found
        values.append(value)
    return at


def _perceptron(df: DataFrame, features: list[str], target: str, layers: list[int], maxIter: int = 100, tol: float = 1e-6, **options) -> Model:
    """One hidden layer, fitted to the mean log loss of rows with a _weight from the first weights that Spark draws.

    Spark's own estimator knows no weights and reads each of many equal rows in every step; it makes the first and the fitted model here.
    """
    p, h, k = layers

    def model(**more) -> Model:
        return _fit(df, features, target, MC.MultilayerPerceptronClassifier(labelCol="_label", layers=layers, seed=0, maxIter=0, **more, **options), "_label")

    first = model()
    label = F.array_position(F.array(*map(F.lit, first.classes)), F.col(target)) - 1
    rows = packed(df.select(F.array(*[F.col(f).cast("double") for f in features], label.cast("double"), "_weight").alias("v")))
    least, total = df.agg(F.min("_weight"), F.sum("_weight")).first()
    if least < 0 or not total:
        raise ValueError("weights must be known, not negative and not all 0")
    cuts = np.cumsum([p * h, h, h * k])

    def evaluate(w):
        a, b, c, d = np.split(w, cuts)
        a, c = a.reshape(p, h), c.reshape(h, k)

        def work(block):
            x, y, weights = block[:, :p], block[:, p].astype(int), block[:, p + 1]
            hidden = 1 / (1 + np.exp(-np.clip(x @ a + b, -700, 700)))
            z = hidden @ c + d
            z -= z.max(axis=1, keepdims=True)
            logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            at = np.arange(len(y)), y
            gap = np.exp(logs)
            gap[at] -= 1
            gap *= weights[:, None]
            back = gap @ c.T * hidden * (1 - hidden)
            return np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), (hidden.T @ gap).ravel(), gap.sum(axis=0), [-(weights @ logs[at])]])

        s = _sums(rows, work) / total
        return s[-1], s[:-1]

    fitted = _minimum(evaluate, first.pipeline.stages[-1].weights.toArray(), maxIter, tol)
    return model(initialWeights=Vectors.dense(fitted))


def classifier(train: DataFrame, features: list[str], target: str, kind: str = "logistic", balanced: bool = False, weight: str | None = None, **options) -> Model:
    """kind: logistic (C), linear_svc (C, hinge loss, two classes or one against the rest), naive_bayes (modelType), tree, forest, boosting
    (one against the rest beyond two classes), mlp (hidden). balanced: weights n / (classes x rows of the class); not together with weight.
    """
    if balanced and weight:
        raise ValueError("either balanced or weight")
    df = train.dropna(subset=[*features, target]).withColumn(target, F.col(target).cast("string"))
    steps = kind == "mlp" and options.get("solver", "l-bfgs") == "l-bfgs" and "initialWeights" not in options and all(is_numeric(train.schema[f]) for f in features)
    if (steps or kind in ("logistic", "linear_svc") or (kind == "tree" and mergeable(options))) and all(is_numeric(train.schema[f]) for f in features):
        # The loss of equal rows is that of one with the sum of their weights, and the optimum is the same.
        df = keep(equal_rows(df, [*features, target], weight))
        # Many steps read these rows: few of them need few tasks.
        df = df.coalesce(max(1, -(-df.count() // TASK_ROWS)))
        if balanced:
            per = df.groupBy(target).agg(F.sum("_weight").alias("_rows"))
            n, k = per.agg(F.sum("_rows"), F.count(F.lit(1))).first()
            df = df.join(per, target).withColumn("_weight", F.col("_weight") * F.lit(n) / (F.lit(k) * F.col("_rows"))).drop("_rows")
        weight = "_weight"
    elif balanced:
        # One row per class: few by the nature of a classifier, joined without a hint.
        df, weight = df.join(balanced_weights(df, target).select(target, F.col("weight").alias("_weight")), target), "_weight"
    total = float(df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0] or 0)
    k, c = df.select(target).distinct().count(), float(options.pop("C", 1.0))
    if k < 2:
        raise ValueError("a classifier needs two classes")
    if steps:
        return _perceptron(df, features, target, [len(features), options.pop("hidden", 8), k], **options)
    common = {"labelCol": "_label"} | ({"weightCol": weight} if weight else {})
    makers = {
        "logistic": lambda: MC.LogisticRegression(regParam=1 / (c * total), standardization=False, maxIter=200, tol=1e-9, **common, **options),
        "linear_svc": lambda: MC.LinearSVC(regParam=1 / (c * total), standardization=False, **common, **options),
        "naive_bayes": lambda: MC.NaiveBayes(**common, **options),
        "tree": lambda: MC.DecisionTreeClassifier(**common, **options),
        "forest": lambda: MC.RandomForestClassifier(**common, **options),
        "boosting": lambda: MC.GBTClassifier(**common, **options),
        "mlp": lambda: MC.MultilayerPerceptronClassifier(labelCol="_label", layers=[len(features), options.pop("hidden", 8), k], seed=0, **options),
    }
    est = makers[kind]()
    if k > 2 and kind in ("linear_svc", "boosting"):
        est = MC.OneVsRest(classifier=est, labelCol="_label", **({"weightCol": weight} if weight else {}))
    return _fit(df, features, target, est, "_label")


def regressor(train: DataFrame, features: list[str], target: str, kind: str = "huber", alpha: float = 0.0, weight: str | None = None, **options) -> Model:
    """kind: huber, poisson, gamma, tweedie (variancePower), tree, forest, boosting. alpha: ridge penalty, mean loss + alpha / 2 |w|^2
    for the deviances, sum of losses + alpha |w|^2 for huber. Targets outside the family's domain are refused.
    """
    df, numeric = train.dropna(subset=[*features, target]), all(is_numeric(train.schema[f]) for f in features)
    if kind == "tree" and mergeable(options) and numeric:
        # One pass; the target is looked at again only if something in it cannot be fitted.
        cells = keep(_equal_features(df, features, target, weight))
        if not cells.where(finite(F.col(target)).isNull()).isEmpty():
            check_target(df, target)
        return _fit(cells, features, target, MR.DecisionTreeRegressor(labelCol=target, weightCol="_weight", **options))
    check_target(df, target, model=kind if kind in ("poisson", "gamma", "tweedie") else None, power=options.get("variancePower"))
    common = {"labelCol": target} | ({"weightCol": weight} if weight else {})
    w = F.col(weight) if weight else F.lit(1.0)
    n, mean = df.agg(F.sum(w), F.sum(w * F.col(target)) / F.sum(w)).first()
    n = n or 0
    if kind == "huber" and numeric:
        df = keep(equal_rows(df, [*features, target], weight))
        common["weightCol"] = "_weight"
    makers = {
        "huber": lambda: MR.LinearRegression(loss="huber", regParam=alpha / max(n, 1), standardization=False, **common, **options),
        # The penalty of the family's solver is scaled by the mean working weight, which is the (weighted) mean target for poisson and 1 for gamma.
        "poisson": lambda: MR.GeneralizedLinearRegression(family="poisson", link="log", regParam=alpha / mean if mean else 0.0, **common, **options),
        "gamma": lambda: MR.GeneralizedLinearRegression(family="gamma", link="log", regParam=alpha, **common, **options),
        "tweedie": lambda: MR.GeneralizedLinearRegression(family="tweedie", linkPower=0.0, regParam=penalty, **common, **options),
        "tree": lambda: MR.DecisionTreeRegressor(**common, **options),
        "forest": lambda: MR.RandomForestRegressor(**common, **options),
        "boosting": lambda: MR.GBTRegressor(**common, **options),
    }
    penalty = alpha
    if kind == "tweedie" and alpha:
        # Its working weights are mu^(2 - power), whose mean is known only after a fit: the penalty is set anew until it holds.
        power, penalty = options.get("variancePower", 0.0), alpha / max(mean, 1e-12) ** (2 - options.get("variancePower", 0.0))
        for _ in range(20):
            model = _fit(df, features, target, makers[kind]())
            scale = model.transform(df).agg(F.sum(w * F.pow("prediction", F.lit(2.0 - power))) / F.sum(w)).first()[0]
            if abs(penalty * scale - alpha) <= 1e-6 * alpha:
                return model
            penalty = alpha / scale
    return _fit(df, features, target, makers[kind]())


def clusters(df: DataFrame, features: list[str], k: int, kind: str = "kmeans", seed: int = 0, **options) -> Model:
    """kind: kmeans, bisecting, gaussian_mixture (full covariance); prediction is the cluster."""
    makers = {"kmeans": MK.KMeans, "bisecting": MK.BisectingKMeans, "gaussian_mixture": MK.GaussianMixture}
    return _fit(df.dropna(subset=features), features, None, makers[kind](k=k, seed=seed, **options))


def cluster_sizes(df: DataFrame, label: str = "prediction") -> DataFrame:
    """(label, n); -1 are noise rows."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def elliptic_envelope(df: DataFrame, features: list[str], contamination: float = 0.1, steps: int = 30) -> Callable[[DataFrame], DataFrame]:
    """Robust location and covariance by concentration steps on h = (n + p + 1) / 2 rows, started from medians and median deviations.

    Each step takes the second moments of the h rows nearest so far, with exact cuts, until they stay; so nearly half of the rows
    may be outliers. Returns a function that adds anomaly_score (squared distance, higher is more unusual) and anomaly (-1 for the
    contamination share of the training rows with the largest scores, else 1). Rows with an unknown feature have neither.
    """
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must be above 0 and at most 0.5")
    known = df.dropna(subset=features).select(*[F.col(f).cast("double").alias(f) for f in features])
    # Distinct vectors with the number of their rows: the steps read no row twice.
    known = keep(known.groupBy(*features).agg(F.count(F.lit(1)).alias("_n")))
    n, p = known.agg(F.sum("_n")).first()[0] or 0, len(features)
    if n <= p + 1:
        raise ValueError("too few rows for a covariance")
    h = (n + p + 1) // 2

    def fit(rows, near):
        # Moments about the centre so far, so that large means take no digits.
        d = [F.col(f) - F.lit(float(m)) for f, m in zip(features, near, strict=True)]
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        r = rows.agg(F.sum("_n").alias("n"), *[F.sum(F.col("_n") * x).alias(f"m{i}") for i, x in enumerate(d)], *[F.sum(F.col("_n") * d[i] * d[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        mean = np.array([r[f"m{i}"] / r["n"] for i in range(p)])
        cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] / r["n"] for j in range(p)] for i in range(p)]) - np.outer(mean, mean)
        return [float(c + m) for c, m in zip(near, mean, strict=True)], np.linalg.pinv(cov)

    def distance(center, inverse):
        d = [F.col(f) - F.lit(float(m)) for f, m in zip(features, center, strict=True)]
        return reduce(lambda a, b: a + b, [d[i] * d[j] * F.lit(float(inverse[i, j])) for i in range(len(d)) for j in range(len(d))])

    center = [exact_quantiles(known, f, [0.5], "_n")[0] for f in features]
    spread = [exact_quantiles(known.select(F.abs(F.col(f) - F.lit(m)).alias("d"), "_n"), "d", [0.5], "_n")[0] for f, m in zip(features, center, strict=True)]
    inverse = np.diag([1 / (1.4826 * s) ** 2 if s else 0.0 for s in spread])
    for _ in range(steps):
        scored = known.withColumn("_d", distance(center, inverse))
        new, inverse_new = fit(scored.where(F.col("_d") <= order_statistics(scored, "_d", [h - 1], "_n")[0]), center)
        done = np.allclose(new, center, rtol=1e-9) and np.allclose(inverse_new, inverse, rtol=1e-6)
        center, inverse = new, inverse_new
        if done:
            break
    cut = exact_quantiles(known.withColumn("_d", distance(center, inverse)), "_d", [1 - contamination], "_n")[0]

    def score(rows: DataFrame) -> DataFrame:
        return rows.withColumn("anomaly_score", distance(center, inverse)).withColumn("anomaly", F.when(F.col("anomaly_score") > cut, -1).when(F.col("anomaly_score").isNotNull(), 1))

    return score


def random_projection(df: DataFrame, features: list[str], k: int, seed: int = 0) -> DataFrame:
    """df with k Gaussian projections p0, p1, ...: expected squared lengths are kept."""
    m = np.random.default_rng(seed).normal(size=(k, len(features))) / np.sqrt(k)
    return df.withColumns({f"p{i}": reduce(lambda a, b: a + b, [F.col(f) * F.lit(float(m[i, j])) for j, f in enumerate(features)]) for i in range(k)})


def truncated_svd(df: DataFrame, features: list[str], k: int) -> tuple[np.ndarray, np.ndarray, Callable[[DataFrame], DataFrame]]:
    """(singular values, components, transform): of the rows as they are, without centring, from one pass of products."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    r = df.dropna(subset=features).agg(*[F.sum(F.col(features[i]) * F.col(features[j])).alias(f"s{i}_{j}") for i, j in pairs]).first()
    s = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(len(features))] for i in range(len(features))], float)
    values, vectors = np.linalg.eigh(s)
    order = np.argsort(-values)[:k]
    parts = vectors[:, order].T
    parts *= np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
    singular = np.sqrt(np.maximum(values[order], 0))
    return singular, parts, lambda d: d.withColumns({f"d{i}": reduce(lambda a, b: a + b, [F.col(f) * F.lit(float(parts[i, j])) for j, f in enumerate(features)]) for i in range(len(parts))})


def reconstruction_mse(df: DataFrame, features: list[str], parts: np.ndarray) -> DataFrame:
    """(reconstruction_mse): mean squared difference between rows and their reconstruction from components (rows orthonormal)."""
    m = np.eye(len(features)) - parts.T @ parts
    left = [reduce(lambda a, b: a + b, [F.col(f) * F.lit(float(m[i, j])) for j, f in enumerate(features)]) for i in range(len(features))]
    return df.agg((F.sum(reduce(lambda a, b: a + b, [x * x for x in left])) / (F.count(F.lit(1)) * len(features))).alias("reconstruction_mse"))


def permutation_importance(model: Model, df: DataFrame, key: str, measure: Callable[[DataFrame], float], metric: str, repeats: int = 5, seed: int = 0) -> list[tuple[str, float, float]]:
    """(feature, mean, std) of how much worse a metric gets when one feature's values are dealt anew; the model is not fitted again.

    A permutation joins the rows, ranked by one md5 order, with the values, ranked by another.
    """
    from ..functions.columns import shuffled_rank

    sign, df = 1 if direction(metric) == "max" else -1, keep(df)
    base, drops = sign * measure(model.transform(df)), {f: [] for f in model.features}
    for r in range(repeats):
        # The order of the rows is the same for all features of a repeat.
        ordered = keep(shuffled_rank(df, f"{seed}|{r}", key, name="_rank"))
        for f in model.features:
            values = shuffled_rank(df.select(key, f), f"{seed}|{f}|{r}", key, name="_rank").select("_rank", F.col(f).alias("_value"))
            rows = ordered.join(values, "_rank").withColumn(f, F.col("_value")).drop("_rank", "_value")
            drops[f].append(base - sign * measure(model.transform(rows)))
    return [(f, float(np.mean(d)), float(np.std(d))) for f, d in drops.items()]


def prediction_view(model: Model, train: DataFrame, axes: list[str], points: int = 25) -> DataFrame:
    """Predictions on a grid of one or two features, from their least to their largest value; the others at their median."""
    if not 1 <= len(axes) <= 2:
        raise ValueError("one or two axes")
    rest = [f for f in model.features if f not in axes]
    ends = train.agg(*[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes]).first()
    middle = [exact_quantiles(train, f, [0.5]) for f in rest]
    grid = train.sparkSession.range(points ** len(axes))
    for i, a in enumerate(axes):
        at = F.floor(F.col("id") / points**i) % points
        grid = grid.withColumn(a, F.lit(float(ends[f"lo_{a}"])) + at * ((float(ends[f"hi_{a}"]) - float(ends[f"lo_{a}"])) / (points - 1)))
    grid = grid.withColumns({f: F.lit(m[0] if m else None).cast("double") for f, m in zip(rest, middle, strict=True)})
    return model.transform(grid).drop("id")


def random_candidates(space: dict, n: int, seed: int = 0) -> list[dict]:
    """n distinct draws (fewer if the space has fewer) from lists, (low, high) ranges of int or float, or (low, high, "log")."""
    if not 1 <= len(space) <= 12:
        raise ValueError("a space has 1 to 12 parameters")
    for name, s in space.items():
        if isinstance(s, tuple) and (not s[0] < s[1] or (len(s) > 2 and s[0] <= 0)):
            raise ValueError(f"{name}: low must be below high, and above 0 on a log scale")
        if isinstance(s, list) and not s:
            raise ValueError(f"{name}: no values")
    rng, out = np.random.default_rng(seed), []
    discrete = all(isinstance(s, list) or (isinstance(s[0], int) and isinstance(s[1], int) and len(s) == 2) for s in space.values())
    values = {k: [v for i, v in enumerate(s) if v not in s[:i]] if isinstance(s, list) else s for k, s in space.items()}
    most = int(np.prod([len(s) if isinstance(s, list) else s[1] - s[0] + 1 for s in values.values()], dtype=object)) if discrete else n

    def draw(s):
        if isinstance(s, list):
            return s[int(rng.integers(len(s)))]
        if len(s) > 2:
            return float(np.exp(rng.uniform(np.log(s[0]), np.log(s[1]))))
        return int(rng.integers(s[0], s[1] + 1)) if isinstance(s[0], int) and isinstance(s[1], int) else float(rng.uniform(*s))

    while len(out) < min(n, most):
        c = {k: draw(s) for k, s in values.items()}
        if c not in out:
            out.append(c)
    return out


def candidate_scores(scores: DataFrame, folds: int, metric: str) -> DataFrame:
    """(candidate, mean, std, valid) and place (1 is best) of candidates with a defined score in every fold; others have no place."""
    from pyspark.sql import Window

    s = scores.groupBy("candidate").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), (F.count("score") == folds).alias("valid"))
    order = F.col("mean").desc() if direction(metric) == "max" else F.col("mean").asc()
    # One row per candidate: as many as the search was asked for.
    return s.withColumn("place", F.when(F.col("valid"), F.row_number().over(Window.partitionBy("valid").orderBy(order, "candidate"))))

