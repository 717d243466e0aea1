"""Decompositions whose rows stay distributed: nonnegative factors, independent components, common factors.

The driver holds component matrices and second moments only. A pass is one aggregate of block sums over the rows; the factors of a row
follow from the row and the components, so they are never stored between passes and a lost executor costs its own task.
Rows with an unknown (null or NaN) feature take no part in a fit and get null factors.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stages import ship
from .gradient import _sums, packed

#: Sweeps of the least squares of one block of rows.
SWEEPS = 2000
#: Most components of which all sets are tried.
FEW = 3


def _rows(df: DataFrame, features: list[str]) -> DataFrame:
    """The features of rows where all are known, packed for several passes: a pass takes few large pieces out of the checkpoint, not rows."""
    ship(df.sparkSession)
    v = df.select(F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    return packed(v.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e))))


def _moments(rows: DataFrame, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, means, covariance over n), about the means of a first pass."""
    first = _sums(rows, lambda x: np.append(x.sum(axis=0), len(x)), ())
    if not len(first) or first[-1] < 2:
        raise ValueError("fewer than two rows with known features")
    n, mean = first[-1], first[:-1] / first[-1]
    return n, mean, _sums(rows, lambda x: ((x - mean).T @ (x - mean)).ravel(), ()).reshape(p, p) / n


def _width(k: int, p: int) -> None:
    if not 1 <= k <= p:
        raise ValueError(f"the number of components must be from 1 to {p}")


def _signed(parts: np.ndarray) -> np.ndarray:
    """The sign of each row by its largest entry, which becomes positive."""
    return np.where(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)] < 0, -1.0, 1.0)


@dataclass
class Factors:
    """components (k x p) with x near mean + factors @ components; ``projection`` (k x p) maps x - mean to factors, null for nmf.

    trace: the loss, log likelihood a row or change of each pass.
    """

    kind: str
    features: list[str]
    mean: list[float]
    components: list[list[float]]
    projection: list[list[float]] | None
    trace: list[float] = field(default_factory=list)
    noise: list[float] | None = None

    def expressions(self) -> list[Column]:
        """The factors of a row as columns; null where a feature is unknown."""
        x = [F.col(f).cast("double") for f in self.features]
        if self.projection is not None:
            known = [F.when(~F.isnan(c), c) - F.lit(float(m)) for c, m in zip(x, self.mean, strict=True)]
            return [sum((c * F.lit(float(w)) for c, w in zip(known, row, strict=True)), F.lit(0.0)) for row in self.projection]
        h = np.array(self.components)

        names = [f"w{i}" for i in range(len(h))]

        @F.pandas_udf(", ".join(f"{n} double" for n in names))
        def solve(*v):  # a batch of rows against the same components
            import pandas as pd

            return pd.DataFrame(_nonnegative_rows(np.column_stack([c.to_numpy(float) for c in v]), h), columns=names)

        whole = F.forall(F.array(*x), lambda e: e.isNotNull() & ~F.isnan(e))
        found = solve(*[F.when(whole, c).otherwise(F.lit(0.0)) for c in x])
        return [F.when(whole, found.getField(n)) for n in names]

    def transform(self, df: DataFrame, name: str = "factor") -> DataFrame:
        """df with name0, name1, ...; null where a feature is unknown."""
        ship(df.sparkSession)
        return df.withColumns({f"{name}{i}": c for i, c in enumerate(self.expressions())})

    def save(self, df: DataFrame, path: str) -> None:
        """As one JSON row, through the session of df."""
        df.sparkSession.createDataFrame([(json.dumps(self.__dict__),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load_factors(df: DataFrame, path: str) -> Factors:
    return Factors(**json.loads(df.sparkSession.read.text(path).first()[0]))


def _best_supports(hh: np.ndarray, xh: np.ndarray) -> np.ndarray:
    """The w of each row from plain least squares on every set of components: of those without a negative weight the one that lowers the loss most.

    Some best w rests on independent components only, so sets that are not are left out.
    """
    out, best = np.zeros_like(xh), np.zeros(len(xh))
    size = np.sqrt(np.diag(hh))
    for n in range(1, len(hh) + 1):
        for s in map(list, combinations(range(len(hh)), n)):
            if not size[s].all():
                continue
            unit = hh[np.ix_(s, s)] / np.outer(size[s], size[s])
            if np.linalg.eigvalsh(unit)[0] <= 1e-12:
                continue
            w = np.linalg.solve(unit, (xh[:, s] / size[s]).T).T / size[s]
            gain = np.where((w >= 0).all(axis=1), (w * xh[:, s]).sum(axis=1), 0.0)
            more = gain > best
            best = np.where(more, gain, best)
            out[more] = 0.0
            out[np.ix_(more, s)] = w[more]
    return out


def _nonnegative_rows(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each row the w >= 0 of least |x - w h|^2: of few components the best set of those above 0, else by coordinate sweeps over the whole block."""
    hh, xh = h @ h.T, x @ h.T
    if len(h) <= FEW:
        return _best_supports(hh, xh)
    w = np.zeros_like(xh)
    live = [j for j in range(len(h)) if hh[j, j] > 0]
    for _ in range(SWEEPS):
        worst = 0.0
        for j in live:
            new = np.maximum(0.0, w[:, j] + (xh[:, j] - w @ hh[:, j]) / hh[j, j])
            worst = max(worst, float(np.abs(new - w[:, j]).max(initial=0.0)) * hh[j, j] ** 0.5)
            w[:, j] = new
        if worst <= 1e-10 * (1e-300 + float(np.abs(x).max(initial=0.0))):
            break
    return w


def nmf(df: DataFrame, features: list[str], k: int, steps: int = 50, tol: float = 1e-5) -> Factors:
    """Nonnegative w (rows) and h (components) of small |x - w h|^2, by alternating nonnegative least squares.

    Start: the signed halves of the leading singular vectors, zeros filled with the mean. A pass solves the rows for the present components and
    returns wᵀx, wᵀw and the loss; the components then follow from these sums. The loss never rises; a pass that lowers it by
    less than tol of the first loss is the last. Negative features are refused.
    """
    p = len(features)
    _width(k, p)
    rows = _rows(df, features)
    least = _sums(rows, lambda x: np.array([float((x < 0).sum()), x.sum(), float(x.size)]), ())
    if not len(least):
        raise ValueError("no rows with known features")
    if least[0]:
        raise ValueError("nmf needs features of at least 0")
    xx = _sums(rows, lambda x: (x.T @ x).ravel(), ()).reshape(p, p)
    values, vectors = np.linalg.eigh(xx)
    order = np.argsort(-values)[:k]
    v, size = vectors[:, order], np.sqrt(np.maximum(values[order], 0.0))

    def halves(x):
        u = x @ v
        return np.concatenate([(np.maximum(u, 0) ** 2).sum(axis=0), (np.maximum(-u, 0) ** 2).sum(axis=0)])

    up, down = np.sqrt(_sums(rows, halves, ())).reshape(2, k)
    h = np.zeros((k, p))
    for j in range(k):
        plus, minus = np.maximum(v[:, j], 0), np.maximum(-v[:, j], 0)
        part = plus if up[j] * np.linalg.norm(plus) >= down[j] * np.linalg.norm(minus) else minus
        h[j] = part * size[j] ** 0.5
    h[h < 1e-12] = max(least[1] / least[2], 1e-12)

    trace: list[float] = []
    for _ in range(steps):

        def sums(x, h=h):
            w = _nonnegative_rows(x, h)
            r = x - w @ h
            return np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel(), [(r * r).sum()]])

        s = _sums(rows, sums, ())
        trace.append(float(s[-1]))
        if len(trace) > 1 and trace[-2] - trace[-1] <= tol * trace[0]:
            break
        wx, ww = s[: k * p].reshape(k, p), s[k * p : -1].reshape(k, k)
        # The same least squares with the roles exchanged, from the sums: coordinate sweeps over the components.
        h = h.copy()
        for _ in range(SWEEPS):
            before = h.copy()
            for j in range(k):
                if ww[j, j] > 0:
                    h[j] = np.maximum(0.0, h[j] + (wx[j] - ww[j] @ h) / ww[j, j])
            if np.abs(h - before).max() <= 1e-12 * (1e-300 + np.abs(h).max()):
                break
    return Factors("nmf", features, [0.0] * p, h.tolist(), None, trace)


def fast_ica(df: DataFrame, features: list[str], k: int | None = None, steps: int = 200, tol: float = 1e-6, seed: int = 0) -> Factors:
    """Independent components of unit variance: whitening from the covariance, then symmetric fixed-point steps with tanh.

    A step is one aggregate of E[g(wᵀz) zᵀ] and E[g'(wᵀz)]; it ends when no direction turns by more than tol. Components go by
    falling share of variance, their largest loading positive. Directions without variance are refused.
    """
    p = len(features)
    k = k or p
    _width(k, p)
    rows = _rows(df, features)
    n, mean, cov = _moments(rows, p)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    if values[order[-1]] <= 1e-12 * max(values[order[0]], 1e-300):
        raise ValueError(f"the features have fewer than {k} directions with variance")
    white = (vectors[:, order] / np.sqrt(values[order])).T

    def even(w):
        a, b = np.linalg.eigh(w @ w.T)
        return b @ np.diag(1 / np.sqrt(a)) @ b.T @ w

    w, trace = even(np.random.default_rng(seed).normal(size=(k, k))), []
    for _ in range(steps):

        def sums(x, w=w):
            z = (x - mean) @ white.T
            g = np.tanh(z @ w.T)
            return np.concatenate([(g.T @ z).ravel(), (1 - g * g).sum(axis=0)])

        s = _sums(rows, sums, ()) / n
        new = even(s[: k * k].reshape(k, k) - s[k * k :, None] * w)
        trace.append(float(np.abs(np.abs((new * w).sum(axis=1)) - 1).max()))
        w = new
        if trace[-1] < tol:
            break
    mixing = np.linalg.pinv(w @ white)  # p x k
    by = np.argsort(-(mixing**2).sum(axis=0), kind="stable")
    sign = _signed(mixing.T[by])
    return Factors("ica", features, mean.tolist(), (mixing.T[by] * sign[:, None]).tolist(), ((w @ white)[by] * sign[:, None]).tolist(), trace)


def factor_analysis(df: DataFrame, features: list[str], k: int, steps: int = 1000, tol: float = 1e-8) -> Factors:
    """Common factors with a noise variance for each feature, by expectation maximisation on the covariance: one pass over the rows.

    The trace is the log likelihood of a row, which never falls; factors are posterior means.
    """
    p = len(features)
    _width(k, p)
    _, mean, cov = _moments(_rows(df, features), p)
    floor = 1e-12 * max(float(np.diag(cov).max()), 1e-300)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    noise = np.maximum(np.diag(cov) / 2, floor)
    load = vectors[:, order] * np.sqrt(np.maximum(values[order], floor) / 2)
    trace: list[float] = []
    for _ in range(steps):
        total = load @ load.T + np.diag(noise)
        inverse = np.linalg.inv(total)
        trace.append(float(-(p * np.log(2 * np.pi) + np.linalg.slogdet(total)[1] + np.trace(inverse @ cov)) / 2))
        if len(trace) > 1 and trace[-1] - trace[-2] < tol:
            break
        b = load.T @ inverse
        second = np.eye(k) - b @ load + b @ cov @ b.T
        load = cov @ b.T @ np.linalg.inv(second)
        noise = np.maximum(np.diag(cov - load @ b @ cov), floor)
    # Rotation fixed by the order of the shares of variance in units of the noise.
    _, turn = np.linalg.eigh(load.T @ (load / noise[:, None]))
    load = load @ turn[:, ::-1]
    load = load * _signed(load.T)
    b = load.T @ np.linalg.inv(load @ load.T + np.diag(noise))
    return Factors("factor_analysis", features, mean.tolist(), load.T.tolist(), b.tolist(), trace, noise.tolist())
