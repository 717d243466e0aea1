"""Linear models of any of ten losses by distributed proximal gradient steps, with a loss per epoch.

A step is one aggregate: every task multiplies its rows, block by block, with the current coefficients, and returns the sums of its
gradient; the driver holds coefficients and second moments only. Steps are measured in the second moments of the features,
so that their scales and correlations do not slow them; the penalty's part of a step is solved exactly in that measure.
With one batch, steps are accelerated; with several, each step takes the rows of one batch, dealt by a hash of the key, and
step lengths follow a schedule. Row-by-row order of updates is not reproduced.

Losses with a kink (hinge, perceptron, epsilon_insensitive, pinball) are rounded over a width that shrinks from stage to stage down to
``smooth``; the optimum moves by at most half of it in loss.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import keep

#: Features whose second moments are held whole; beyond it only their diagonal.
WHOLE_MOMENTS = 500
#: Rows of a block in a task; bytes of a piece of packed rows.
BLOCK, PIECE = 4096, 4096
CLASSIFIERS = ("log", "hinge", "squared_hinge", "modified_huber", "perceptron")
KINKED = ("hinge", "perceptron", "epsilon_insensitive", "pinball")
LOSSES = (*CLASSIFIERS, "squared", "huber", "epsilon_insensitive", "squared_epsilon_insensitive", "pinball")


def _rounded(m, width: float):
    """max(0, m) with a quadratic of the given width at its kink, and its slope."""
    return np.where(m <= 0, 0.0, np.where(m >= width, m - width / 2, m * m / (2 * width))), np.clip(m / width, 0.0, 1.0)


def loss_and_slope(loss: str, eta, y, width: float, epsilon: float = 0.1, quantile: float = 0.5):
    """Loss and its derivative by eta; y is the target, or -1 and 1 for classifiers."""
    m = y * eta
    if loss == "log":
        return np.logaddexp(0.0, -m), -y / (1 + np.exp(np.clip(m, -700, 700)))
    if loss in ("hinge", "perceptron"):
        # A perceptron without any margin is already at rest at 0.
        value, slope = _rounded((1.0 if loss == "hinge" else width) - m, width)
        return value, -y * slope
    if loss == "squared_hinge":
        gap = np.maximum(0.0, 1 - m)
        return gap * gap, -2 * y * gap
    if loss == "modified_huber":
        gap = np.maximum(0.0, 1 - m)
        return np.where(m >= -1, gap * gap, -4 * m), np.where(m >= -1, -2 * y * gap, -4 * y)
    r = eta - y
    if loss == "squared":
        return r * r / 2, r
    if loss == "huber":
        return np.where(np.abs(r) <= epsilon, r * r / 2, epsilon * np.abs(r) - epsilon * epsilon / 2), np.clip(r, -epsilon, epsilon)
    if loss == "epsilon_insensitive":
        value, slope = _rounded(np.abs(r) - epsilon, width)
        return value, np.sign(r) * slope
    if loss == "squared_epsilon_insensitive":
        gap = np.maximum(0.0, np.abs(r) - epsilon)
        return gap * gap, 2 * np.sign(r) * gap
    if loss == "pinball":
        up, du = _rounded(-r, width)
        down, dd = _rounded(r, width)
        return quantile * up + (1 - quantile) * down, (1 - quantile) * dd - quantile * du
    raise ValueError(f"loss must be one of {', '.join(LOSSES)}")


def _curvature(loss: str, width: float) -> float:
    return {"log": 0.25, "squared": 1.0, "huber": 1.0}.get(loss, 1 / width if loss in KINKED else 2.0)


@dataclass
class GradientModel:
    """Coefficients (a row per class beyond two classes), intercepts and the trace of (epoch, train_loss, validation_loss)."""

    features: list[str]
    loss: str
    coefficients: list[list[float]]
    intercepts: list[float]
    classes: list[str] | None = None
    trace: list[tuple[int, float, float | None]] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with decision (an array beyond two classes) and prediction; both null where a feature is unknown."""
        etas = [F.lit(b) + sum((F.col(f).cast("double") * F.lit(c) for f, c in zip(self.features, w, strict=True)), F.lit(0.0)) for w, b in zip(self.coefficients, self.intercepts, strict=True)]
        if self.classes is None:
            return df.withColumn("decision", etas[0]).withColumn("prediction", F.col("decision"))
        if len(etas) == 1:
            return df.withColumn("decision", etas[0]).withColumn("prediction", F.when(F.col("decision") > 0, self.classes[1]).when(F.col("decision").isNotNull(), self.classes[0]))
        best = F.array_position("decision", F.array_max("decision")).cast("int") - 1
        out = df.withColumn("decision", F.when(etas[0].isNotNull(), F.array(*etas)))
        return out.withColumn("prediction", F.get(F.array(*map(F.lit, self.classes)), best))

    def save(self, df: DataFrame, path: str) -> None:
        """As one JSON row, through the session of df."""
        df.sparkSession.createDataFrame([(json.dumps(self.__dict__),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load_gradient_model(df: DataFrame, path: str) -> GradientModel:
    state = json.loads(df.sparkSession.read.text(path).first()[0])
    return GradientModel(**{**state, "trace": [tuple(t) for t in state["trace"]]})


def packed(rows: DataFrame) -> DataFrame:
    """(p, v): the arrays v of rows, all of p doubles, in pieces of some PIECE bytes, held for several passes of _sums()."""

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
                p = len(x) // batch.num_rows
                step = max(1, PIECE // (8 * p)) * p
                pieces = [x[a : a + step].tobytes() for a in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(pieces), pa.int32()), pa.array(pieces, pa.binary())], names=["p", "v"])

    return keep(rows.select("v").mapInArrow(task, "p int, v binary"))


def _sums(rows: DataFrame, work: Callable, columns: tuple[str, ...] = ("y", "w", "held")) -> np.ndarray:
    """Sums over tasks of the vectors that work returns for their blocks of the arrays v and the columns; rows may be packed() if there are no columns."""
    whole = "p" in rows.columns

    def blocks(batches):
        for batch in batches:
            if whole and batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("v").to_pylist())).reshape(-1, batch.column("p")[0].as_py())
                for a in range(0, len(x), BLOCK):
                    yield (x[a : a + BLOCK],)
                continue
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                yield (x, *[part.column(c).to_numpy(zero_copy_only=False) for c in columns])

    def task(batches):
        import pyarrow as pa

        total = None
        for block in blocks(batches):
            made = work(*block)
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "s"])

    found = rows.mapInArrow(task, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return np.array([s for _, s in sorted(found)])


def _proximal(h: np.ndarray, g: np.ndarray, at: np.ndarray, l1: float, l2: float, p: int) -> np.ndarray:
    """The minimum over z of <g, z - at> + (z - at) H (z - at) / 2 + l1 |z_p|_1 + l2 / 2 |z_p|^2; the first p entries are penalised."""
    ridge = np.zeros(len(at))
    ridge[:p] = l2
    if h.ndim == 1:
        z = (h * at - g) / (h + ridge)
        if l1:
            z[:p] = (np.sign(h * at - g) * np.maximum(np.abs(h * at - g) - l1, 0) / (h + ridge))[:p]
        return z
    full, c = h + np.diag(ridge), h @ at - g
    if not l1:
        return np.linalg.lstsq(full, c, rcond=None)[0]
    z = at.copy()
    for _ in range(500):
        before = z.copy()
        for j in range(len(z)):
            if full[j, j] <= 0:
                continue
            r = c[j] - full[j] @ z + full[j, j] * z[j]
            z[j] = (np.sign(r) * max(abs(r) - l1, 0.0) if j < p else r) / full[j, j]
        if np.abs(z - before).max() <= 1e-12 * (1 + np.abs(z).max()):
            break
    return z


def gradient_fit(
    train: DataFrame, features: list[str], target: str | None, loss: str = "squared", penalty: str = "l2", alpha: float = 1e-4, l1_ratio: float = 0.15, epochs: int = 200, batches: int = 1, key: str | None = None,
    schedule: str = "adaptive", step: float = 1.0, weight: str | None = None, validation: DataFrame | None = None, epsilon: float = 0.1, quantile: float = 0.5, smooth: float = 0.01, tol: float = 1e-7, intercept_cost: float = 0.0,
) -> GradientModel:
    """Minimises the (weighted) mean loss + alpha x penalty (none, l1: |w|, l2: |w|^2 / 2, elasticnet: l1_ratio of both); intercepts are free.

    schedule (several batches): constant, invscaling (step / sqrt(t)) or adaptive (halved when an epoch does not lower the loss).
    Stops when the coefficients of an epoch move by less than tol. Rows with an unknown feature, target or weight are left out.
    Classifiers take any number of classes: two share one row of coefficients, more are fitted one against the rest in the same
    passes. target None (one-class): every row counts as 1. intercept_cost adds that times the intercept to the loss.
    """
    if penalty not in ("none", "l1", "l2", "elasticnet") or schedule not in ("constant", "invscaling", "adaptive") or loss not in LOSSES:
        raise ValueError("unknown penalty, schedule or loss")
    if batches > 1 and key is None:
        raise ValueError("batches are dealt by a key")
    y = F.lit(1.0) if target is None else F.col(target)
    both = train.withColumn("_held", F.lit(0.0)) if validation is None else train.withColumn("_held", F.lit(0.0)).unionByName(validation.withColumn("_held", F.lit(1.0)), allowMissingColumns=True)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    batch = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(batches)) if batches > 1 else F.lit(0)
    rows = both.select(F.array(*[F.col(f).cast("double") for f in features]).alias("v"), y.alias("y"), w.alias("w"), F.col("_held").alias("held"), batch.alias("batch"))
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e)) & F.col("y").isNotNull() & F.col("w").isNotNull())
    classes = None
    if loss in CLASSIFIERS and target is not None:
        classes = sorted(r[0] for r in rows.where("held = 0").select(F.col("y").cast("string")).distinct().limit(1001).collect())
        if not 2 <= len(classes) <= 1000:
            raise ValueError("a classifier needs 2 to 1000 classes")
        rows = rows.withColumn("y", F.array_position(F.array(*map(F.lit, classes)), F.col("y").cast("string")).cast("double") - 1).where("y >= 0")
    rows = keep(rows.withColumn("y", F.col("y").cast("double")))
    p, outputs = len(features), len(classes) if classes and len(classes) > 2 else 1
    whole = p <= WHOLE_MOMENTS

    def moments(x, y, w, held):
        x1 = np.column_stack([x, np.ones(len(x))])
        ww = w * (held == 0)
        return np.append(((x1 * ww[:, None]).T @ x1).ravel() if whole else (x1 * x1 * ww[:, None]).sum(axis=0), ww.sum())

    found = _sums(rows, moments)
    if not len(found) or found[-1] <= 0:
        raise ValueError("no rows to fit")
    total, m = found[-1], found[:-1] / found[-1]
    metric = m.reshape(p + 1, p + 1) if whole else m * (p + 1)
    l1 = alpha * {"l1": 1.0, "elasticnet": l1_ratio}.get(penalty, 0.0)
    l2 = alpha * {"l2": 1.0, "elasticnet": 1 - l1_ratio}.get(penalty, 0.0)

    def evaluate(b: np.ndarray, width: float, part: int | None):
        """Mean loss, gradient (without penalty), mean validation loss."""

        def work(x, y, w, held):
            eta = x @ b[:, :p].T + b[:, p]
            sign = y[:, None] if classes is None else np.where(y[:, None] == (np.arange(outputs) if outputs > 1 else 1), 1.0, -1.0)
            value, slope = loss_and_slope(loss, eta, sign, width, epsilon, quantile)
            inside, out = w * (held == 0), w * (held == 1)
            slope = slope * inside[:, None]
            grad = np.column_stack([slope.T @ x, slope.sum(axis=0)])
            per = value.sum(axis=1)
            return np.concatenate([grad.ravel(), [inside @ per, inside.sum(), out @ per, out.sum()]])

        s = _sums(rows if part is None else rows.where(F.col("batch") == part), work)
        if not len(s) or s[-3] == 0:
            return None
        grad = s[:-4].reshape(outputs, p + 1) / s[-3]
        grad[:, p] += intercept_cost
        return s[-4] / s[-3], grad, s[-2] / s[-1] if s[-1] else None

    def penalised(b, value):
        return value + l1 * np.abs(b[:, :p]).sum() + l2 / 2 * (b[:, :p] ** 2).sum() + intercept_cost * b[:, p].sum()

    trace: list[tuple[int, float, float | None]] = []
    b = np.zeros((outputs, p + 1))
    widths = [max(smooth, 1.0), max(smooth, 0.1), smooth] if loss in KINKED else [1.0]
    widths = [x for i, x in enumerate(widths) if x not in widths[:i]]
    epoch = 0
    for stage, width in enumerate(widths):
        h, most = metric * _curvature(loss, width), epochs * (stage + 1) // len(widths)
        ahead, momentum, best, rate = b.copy(), 1.0, np.inf, step
        while epoch < most:
            epoch += 1
            before = b.copy()
            if batches == 1:
                value, grad, held = evaluate(ahead, width, None)
                now = penalised(ahead, value)
                if now > best:
                    # Acceleration has gone too far: on from the last point without it.
                    ahead, momentum, best = b.copy(), 1.0, np.inf
                    value, grad, held = evaluate(ahead, width, None)
                    now = penalised(ahead, value)
                best = now
                b = np.array([_proximal(h, g, a, l1, l2, p) for g, a in zip(grad, ahead, strict=True)])
                following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
                ahead, momentum = b + (momentum - 1) / following * (b - before), following
            else:
                values = []
                for t in range(batches):
                    found = evaluate(b, width, (t + epoch) % batches)
                    if found is None:
                        continue
                    value, grad, held = found
                    values.append(penalised(b, value))
                    length = rate / ((epoch - 1) * batches + t + 1) ** 0.5 if schedule == "invscaling" else rate
                    b = np.array([_proximal(h / length, g, a, l1, l2, p) for g, a in zip(grad, b, strict=True)])
                now = float(np.mean(values))
                if schedule == "adaptive" and now >= best:
                    rate /= 2
                best = min(best, now)
            trace.append((epoch, float(now), None if held is None else float(held)))
            if np.abs(b - before).max() <= tol * (1 + np.abs(b).max()) and (batches == 1 or schedule != "invscaling"):
                break
    return GradientModel(features, loss, b[:, :p].tolist(), b[:, p].tolist(), classes, trace)


def sgd_classifier(train: DataFrame, features: list[str], target: str, loss: str = "hinge", **options) -> GradientModel:
    """loss: hinge, log, modified_huber, squared_hinge or perceptron; two classes or one against the rest."""
    if loss not in CLASSIFIERS:
        raise ValueError(f"loss must be one of {', '.join(CLASSIFIERS)}")
    return gradient_fit(train, features, target, loss, **options)


def perceptron(train: DataFrame, features: list[str], target: str, **options) -> GradientModel:
    return gradient_fit(train, features, target, "perceptron", **{"penalty": "none", "alpha": 0.0} | options)


def linear_svr(train: DataFrame, features: list[str], target: str, c: float = 1.0, epsilon: float = 0.0, **options) -> GradientModel:
    """C x sum of epsilon-insensitive losses + |w|^2 / 2."""
    n = train.dropna(subset=[*features, target]).count()
    return gradient_fit(train, features, target, "epsilon_insensitive", "l2", 1 / (c * max(n, 1)), epsilon=epsilon, **options)


def quantile_regression(train: DataFrame, features: list[str], target: str, quantile: float = 0.5, alpha: float = 0.0, **options) -> GradientModel:
    """Mean pinball loss + alpha |w|_1."""
    if not 0 < quantile < 1:
        raise ValueError("quantile must lie between 0 and 1")
    return gradient_fit(train, features, target, "pinball", "l1", alpha, quantile=quantile, **options)


def one_class_svm(train: DataFrame, features: list[str], nu: float = 0.5, **options) -> Callable[[DataFrame], DataFrame]:
    """mean max(0, 1 - (w x + b)) + nu (|w|^2 / 2 + b): a function that adds anomaly_score (1 - w x - b, higher is more unusual) and anomaly (-1 above 0, else 1)."""
    if not 0 < nu <= 1:
        raise ValueError("nu must be above 0 and at most 1")
    model = gradient_fit(train, features, None, "hinge", "l2", nu, intercept_cost=nu, **options)

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df).withColumn("anomaly_score", 1 - F.col("decision")).drop("decision", "prediction")
        return out.withColumn("anomaly", F.when(F.col("anomaly_score") > 0, -1).when(F.col("anomaly_score").isNotNull(), 1))

    score.model = model
    return score
