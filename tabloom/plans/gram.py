"""Linear models from sufficient statistics: one pass over the data, then small solves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stages import ship


@dataclass
class Gram:
    """n, means, and centred second moments of the features and the label."""

    features: list[str]
    n: float
    mean: np.ndarray
    label_mean: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def __sub__(self, other: Gram) -> Gram:
        return Gram.combine(self.features, [(self, 1), (other, -1)])

    def __add__(self, other: Gram) -> Gram:
        return Gram.combine(self.features, [(self, 1), (other, 1)])

    @staticmethod
    def combine(features: list[str], parts: list[tuple[Gram, int]]) -> Gram:
        n = sum(s * g.n for g, s in parts)
        mean = sum(s * g.n * g.mean for g, s in parts) / n
        label = sum(s * g.n * g.label_mean for g, s in parts) / n
        xx = sum(s * (g.xx + g.n * np.outer(g.mean - mean, g.mean - mean)) for g, s in parts)
        xy = sum(s * (g.xy + g.n * (g.mean - mean) * (g.label_mean - label)) for g, s in parts)
        yy = sum(s * (g.yy + g.n * (g.label_mean - label) ** 2) for g, s in parts)
        return Gram(features, n, mean, label, xx, xy, yy)


def gram_table(df: DataFrame, features: list[str], label: str, by: list[str] | None = None, shift: dict[str, float] | None = None) -> DataFrame:
    """One row per group: n and all first and second moments, about shift to limit cancellation."""
    if len(features) > 2000:
        raise ValueError("more than 2000 features")
    names = [*features, label]
    col = {c: F.col(c).cast("double") - F.lit(float((shift or {}).get(c, 0.0))) for c in names}
    aggs: list[Column] = [F.count(F.lit(1)).alias("n"), *[F.sum(col[c]).alias(f"s{i}") for i, c in enumerate(names)]]
    aggs += [F.sum(col[a] * col[b]).alias(f"q{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return df.dropna(subset=names).groupBy(*(by or [])).agg(*aggs)


#: Features beyond which moments are block sums of vectors instead of one aggregate column for each pair: with groups, and without.
WIDE, WIDE_ALONE = 30, 8


def _wide_grams(df: DataFrame, features: list[str], label: str, by: str | None) -> dict:
    """grams() of many features: tasks multiply blocks of rows, and return sums of as many numbers as pairs for each group.

    Rows with a gap are left out inside the tasks: a filter would be moved below the features and repeat what they are made of.
    """
    names = [*features, label]
    k = len(names)
    ship(df.sparkSession)
    v, group = F.array(*[F.col(c).cast("double") for c in names]).alias("v"), F.col(by).alias("by") if by else F.lit(0).alias("by")
    rows = df.select(group, v)
    known = [F.nanvl(F.get("v", F.lit(i)), F.lit(None).cast("double")) for i in range(k)]
    center = np.array(rows.agg(*[F.avg(c) for c in known]).first(), dtype=object)
    if any(c is None for c in center):
        return {}
    center, at = center.astype(float), np.triu_indices(k)

    def task(batches):
        import pyarrow as pa

        sums: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("by").type
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, k) - center
                keys = np.array([*part.column("by").to_pylist(), None], dtype=object)[:-1] if by else None
                for g in set(keys) if by else (0,):
                    z = x[np.array([q == g for q in keys], bool)] if by else x
                    z = z[~np.isnan(z).any(axis=1)]
                    made = np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z)[at]])
                    sums[g] = sums[g] + made if g in sums else made
        for g, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(s), kind), pa.array(np.arange(len(s))), pa.array(s)], names=["by", "i", "s"])

    kind = rows.schema["by"].dataType.simpleString()
    found: dict = {}
    for r in rows.mapInArrow(task, f"by {kind}, i long, s double").groupBy("by", "i").agg(F.sum("s").alias("s")).groupBy("by").agg(F.array_sort(F.collect_list(F.struct("i", "s")))["s"].alias("s")).toLocalIterator():
        found[r["by"]] = np.array(r["s"])
    out = {}
    for g, t in found.items():
        n, s, q = t[0], t[1 : k + 1], np.zeros((k, k))
        if not n:
            continue
        q[at] = t[k + 1 :]
        q = q + np.triu(q, 1).T
        m, c = s / n, q - np.outer(s, s) / n
        out[g if by else None] = Gram(features, n, center[:-1] + m[:-1], center[-1] + m[-1], c[:-1, :-1], c[:-1, -1], c[-1, -1])
    return out


def grams(df: DataFrame, features: list[str], label: str, by: str | None = None) -> dict:
    """Gram of every group (key None without groups); the means of a first, cheap aggregate are the shift."""
    if len(features) > (WIDE if by else WIDE_ALONE):
        return _wide_grams(df, features, label, by)
    names = [*features, label]
    shift = {k: v or 0.0 for k, v in df.dropna(subset=names).agg(*[F.avg(c).alias(c) for c in names]).first().asDict().items()}
    center = np.array([shift[c] for c in names])
    out = {}
    for r in gram_table(df, features, label, [by] if by else None, shift).collect():
        k, n = len(names), r["n"]
        if not n:
            continue
        s = np.array([r[f"s{i}"] for i in range(k)])
        q = np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        m, c = s / n, q - np.outer(s, s) / n
        out[r[by] if by else None] = Gram(features, n, center[:-1] + m[:-1], center[-1] + m[-1], c[:-1, :-1], c[:-1, -1], c[-1, -1])
    return out


@dataclass
class Linear:
    features: list[str]
    coefficients: np.ndarray
    intercept: float

    def column(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(self.features, self.coefficients, strict=True):
            out = out + F.lit(float(w)) * F.col(c)
        return out

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.column())


def _model(g: Gram, w: np.ndarray) -> Linear:
    return Linear(g.features, w, float(g.label_mean - g.mean @ w))


def ols(g: Gram) -> Linear:
    return _model(g, np.linalg.lstsq(g.xx, g.xy, rcond=None)[0])


def ridge(g: Gram, alpha: float) -> Linear:
    """Least squares plus alpha |w|^2."""
    return _model(g, np.linalg.solve(g.xx + alpha * np.eye(len(g.xx)), g.xy))


def tikhonov(g: Gram, alpha: float, order: int = 1) -> Linear:
    """(1/2n) |e|^2 + alpha/2 |D w|^2 with D the identity or a difference of the given order."""
    d = np.diff(np.eye(len(g.xx)), n=order, axis=0) if order else np.eye(len(g.xx))
    return _model(g, np.linalg.solve(g.xx / g.n + alpha * d.T @ d, g.xy / g.n))


def elastic_net(g: Gram, alpha: float, l1_ratio: float = 1.0, positive: bool = False, weights: np.ndarray | None = None, tolerance: float = 1e-10, rounds: int = 10_000) -> Linear:
    """(1/2n) |e|^2 + alpha (r |w|_1 + (1 - r)/2 |w|^2) by coordinate descent on the Gram; weights scale the l1 part per feature."""
    xx, xy = g.xx / g.n, g.xy / g.n
    w, l1 = np.zeros(len(xy)), alpha * l1_ratio * (np.ones(len(xy)) if weights is None else weights)
    ridge_part = alpha * (1 - l1_ratio)
    for _ in range(rounds):
        worst = 0.0
        for j in range(len(w)):
            rho = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1[j], 0.0) / (xx[j, j] + ridge_part) if xx[j, j] + ridge_part > 0 else 0.0
            new = max(new, 0.0) if positive else new
            worst, w[j] = max(worst, abs(new - w[j]) * np.sqrt(max(xx[j, j], 1e-300))), new
        if worst < tolerance * max(1.0, np.sqrt(g.yy / g.n)):
            break
    return _model(g, w)


def lasso(g: Gram, alpha: float, positive: bool = False) -> Linear:
    return elastic_net(g, alpha, 1.0, positive)


def nonnegative(g: Gram) -> Linear:
    return elastic_net(g, 0.0, 1.0, True)


def adaptive_lasso(g: Gram, alpha: float, gamma: float = 1.0, epsilon: float = 1e-3, pilot: float = 1.0) -> Linear:
    return elastic_net(g, alpha, 1.0, weights=(np.abs(ridge(g, pilot).coefficients) + epsilon) ** -gamma)


def weighted_lasso(g: Gram, alpha: float, ratio: float = 2.0) -> Linear:
    return elastic_net(g, alpha, 1.0, weights=np.linspace(1.0, ratio, len(g.xy)))


def best_subset(g: Gram, size: int, alpha: float = 0.0) -> Linear:
    """The least (1/2n) |e|^2 + alpha (number of features) of at most size features; exact, for at most 12 features."""
    from itertools import combinations

    if len(g.xy) > 12:
        raise ValueError("at most 12 features")
    best, least = np.zeros(len(g.xy)), g.yy
    for k in range(1, size + 1):
        for s in combinations(range(len(g.xy)), k):
            i = list(s)
            v = np.linalg.lstsq(g.xx[np.ix_(i, i)], g.xy[i], rcond=None)[0]
            loss = g.yy - v @ g.xy[i] + 2 * g.n * alpha * k
            if loss < least - 1e-12 * g.yy:
                best, least = np.zeros(len(g.xy)), loss
                best[i] = v
    return _model(g, best)


def omp(g: Gram, size: int) -> Linear:
    chosen: list[int] = []
    w = np.zeros(len(g.xy))
    scale = np.sqrt(np.maximum(np.diag(g.xx), 1e-300))
    for _ in range(size):
        r = np.abs(g.xy - g.xx @ w) / scale
        r[chosen] = -1
        chosen.append(int(np.argmax(r)))
        w = np.zeros(len(g.xy))
        w[chosen] = np.linalg.lstsq(g.xx[np.ix_(chosen, chosen)], g.xy[chosen], rcond=None)[0]
    return _model(g, w)


def pca(g: Gram, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(components, explained variance ratio); the largest loading of each component is positive."""
    values, vectors = np.linalg.eigh(g.xx / max(g.n - 1, 1))
    order = np.argsort(-values)[:k]
    v = vectors[:, order].T
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
    return v, values[order] / values.sum()


def path(g: Gram, alphas: list[float], fit=ridge) -> list[Linear]:
    """All models of a regularisation path, without another pass over data."""
    return [fit(g, a) for a in alphas]


def mean_squared_error(model: Linear, g: Gram) -> float:
    """On the rows of g, from its moments alone."""
    w = model.coefficients
    bias = g.label_mean - model.intercept - g.mean @ w
    return float((g.yy - 2 * w @ g.xy + w @ g.xx @ w) / g.n + bias * bias)


def cross_validate(by_fold: dict, alphas: list[float], fit=ridge) -> list[dict]:
    """Every (alpha, fold) from one pass: the training Gram of a fold is the total minus it."""
    parts = list(by_fold.values())
    total = Gram.combine(parts[0].features, [(p, 1) for p in parts])
    return [{"alpha": a, "fold": f, "mse": mean_squared_error(fit(total - g, a), g)} for a in alphas for f, g in by_fold.items()]


def sqrt_lasso(g: Gram, alpha: float, rounds: int = 200) -> Linear:
    """|e|_2 + alpha |w|_1: a lasso whose penalty follows the size of its own residual."""
    size = float(np.sqrt(g.yy))
    for _ in range(rounds):
        m = lasso(g, alpha * size / g.n)
        new = float(np.sqrt(max(mean_squared_error(m, g), 0.0) * g.n))
        if abs(new - size) <= 1e-10 * max(size, 1e-300):
            break
        size = new
    return m


def mcp(g: Gram, alpha: float, gamma: float = 3.0, rounds: int = 10_000) -> Linear:
    """(1/2n) |e|^2 + the minimax concave penalty, by coordinate descent; needs gamma above 1 / variance of each feature."""
    xx, xy = g.xx / g.n, g.xy / g.n
    if np.any(np.diag(xx) * gamma <= 1):
        raise ValueError("gamma must exceed 1 / variance: scale the features")
    w = np.zeros(len(xy))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            c, rho = xx[j, j], xy[j] - xx[j] @ w + xx[j, j] * w[j]
            w[j] = rho / c if abs(rho) > gamma * alpha * c else np.sign(rho) * max(abs(rho) - alpha, 0.0) / (c - 1 / gamma)
        if np.abs(w - before).max() < 1e-12 * max(1.0, np.abs(w).max()):
            break
    return _model(g, w)


def bayesian_ridge(g: Gram, rounds: int = 300, prior: float = 1e-6) -> Linear:
    """Evidence maximisation of the noise and weight precisions."""
    values, vectors = np.linalg.eigh(g.xx)
    values, projected = np.maximum(values, 0.0), vectors.T @ g.xy
    noise, weight, w = g.n / max(g.yy, 1e-300), 1.0, np.zeros(len(g.xy))
    for _ in range(rounds):
        old, w = w, vectors @ (projected / (values + weight / noise))
        rss = max(g.yy - 2 * w @ g.xy + w @ g.xx @ w, 0.0)
        used = float((noise * values / (weight + noise * values)).sum())
        weight, noise = (used + 2 * prior) / (w @ w + 2 * prior), (g.n - used + 2 * prior) / (rss + 2 * prior)
        if np.abs(w - old).sum() < 1e-10 * max(1.0, np.abs(w).sum()):
            break
    return _model(g, w)


def learning_curve(by_bucket: dict, validation: Gram, alpha: float, fit=ridge) -> list[dict]:
    """Nested training sizes: the Gram of size i is the sum of buckets 0..i, from one grouped pass."""
    out, total = [], None
    for b in sorted(by_bucket):
        total = by_bucket[b] if total is None else total + by_bucket[b]
        m = fit(total, alpha)
        out.append({"n": int(total.n), "train_mse": mean_squared_error(m, total), "validation_mse": mean_squared_error(m, validation)})
    return out


def loss_surface(g: Gram, model: Linear, a: int, b: int, alpha: float = 0.0, steps: int = 25, spread: float = 1.0) -> list[dict]:
    """Ridge objective around two coefficients, the intercept following them, from the moments alone."""
    out = []
    for i in np.linspace(-spread, spread, steps):
        for j in np.linspace(-spread, spread, steps):
            w = model.coefficients.copy()
            w[a] += i * max(abs(w[a]), 1.0)
            w[b] += j * max(abs(w[b]), 1.0)
            out.append({"a": float(w[a]), "b": float(w[b]), "loss": float(g.yy - 2 * w @ g.xy + w @ g.xx @ w + alpha * w @ w)})
    return out
