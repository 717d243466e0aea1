"""Round-robin imputation: each column in turn is regressed on the others, and its gaps take the predictions.

A step is one aggregate: the second moments of the present values over the rows where the column is known; the driver solves a Bayesian
ridge from them. Steps of a round are applied inside the tasks; the table is written once a round.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_quantiles, finite
from ..functions.stages import keep, ship
from ..plans.gram import Gram, bayesian_ridge
from .gradient import _sums


def _apply(x: np.ndarray, steps: list[tuple]) -> np.ndarray:
    """Blocks of values beside their gaps (1.0 = unknown), with the gaps of each step's column filled anew."""
    p = x.shape[1] // 2
    v = x[:, :p].copy()
    for j, others, weights, intercept in steps:
        gap = x[:, p + j] == 1
        v[gap, j] = v[np.ix_(gap, others)] @ np.asarray(weights) + intercept
    return v


@dataclass
class IterativeImputer:
    """start: medians; steps: (column, columns it is predicted from, their weights, intercept) in the order of fitting."""

    columns: list[str]
    start: list[float]
    steps: list[tuple]
    trace: list[float] = field(default_factory=list)

    def block(self) -> Column:
        known = [finite(F.col(c)) for c in self.columns]
        return F.array(*[F.coalesce(c, F.lit(m)) for c, m in zip(known, self.start, strict=True)], *[c.isNull().cast("double") for c in known])

    def expressions(self) -> dict[str, Column]:
        """Each column without gaps: medians first, then all steps in their order."""
        steps = self.steps

        @F.pandas_udf("array<double>")
        def fill(v):
            import pandas as pd

            return pd.Series(list(_apply(np.array(v.tolist(), float), steps)) if len(v) else [], index=v.index)

        found = fill(self.block())
        return {c: F.get(found, F.lit(i)) for i, c in enumerate(self.columns)}

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the columns as doubles without gaps."""
        ship(df.sparkSession)
        return df.withColumns(self.expressions()) if self.columns else df

    def save(self, df: DataFrame, path: str) -> None:
        """As one JSON row, through the session of df."""
        df.sparkSession.createDataFrame([(json.dumps(self.__dict__),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load_imputer(df: DataFrame, path: str) -> IterativeImputer:
    return IterativeImputer(**json.loads(df.sparkSession.read.text(path).first()[0]))


def iterative_impute(train: DataFrame, columns: list[str], rounds: int = 10, tol: float = 1e-3, nearest: int | None = None) -> IterativeImputer:
    """Learns from train only; columns go by rising number of gaps, at most rounds times.

    nearest: each column is predicted from so many others of largest absolute correlation (after the medians); None: from all. Ends when no gap
    moves by more than tol of the largest known absolute value. Unknown: null, NaN, infinite. Columns without any known value stay as
    they are; a column known in fewer than two rows keeps its start. The trace is the largest move of each round.
    """
    if rounds < 0 or (nearest is not None and nearest < 1):
        raise ValueError("rounds must be at least 0 and nearest at least 1")
    medians = {c: exact_quantiles(train.select(finite(F.col(c)).alias(c)), c, [0.5])[0] for c in columns}
    used = [c for c in columns if medians[c] is not None]
    model = IterativeImputer(used, [medians[c] for c in used], [])
    p = len(used)
    if p < 2:
        return model
    rows, shift = keep(train.select(model.block().alias("v"))), np.array(model.start)

    def look(x):
        v, gap = x[:, :p] - shift, x[:, p:]
        return np.concatenate([gap.sum(axis=0), [len(x)], v.sum(axis=0), (v.T @ v).ravel()])

    s = _sums(rows, look, ())
    gaps, n, total, square = s[:p], s[p], s[p + 1 : 2 * p + 1], s[2 * p + 1 :].reshape(p, p)
    cov = square / n - np.outer(total, total) / n**2
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
    near = np.abs(cov) / np.maximum(np.outer(spread, spread), 1e-300)
    others = [sorted([i for i in sorted(range(p), key=lambda i, j=j: (-near[j, i], i)) if i != j][:nearest]) for j in range(p)]
    largest = train.agg(*[F.max(F.abs(finite(F.col(c)))).alias(f"m{i}") for i, c in enumerate(used)]).first()
    limit = tol * max(largest)

    for _ in range(rounds):
        steps: list[tuple] = []
        for j in sorted(range(p), key=lambda j: (gaps[j], j)):

            def moments(x, j=j, steps=tuple(steps)):
                v = _apply(x, list(steps))[x[:, p + j] == 0] - shift
                return np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()])

            s = _sums(rows, moments, ())
            m, total, square = s[0], s[1 : p + 1], s[p + 1 :].reshape(p, p)
            mean, o = total / m, others[j]
            c = square - np.outer(total, total) / m
            weights, intercept = np.zeros(len(o)), model.start[j]
            if m >= 2:
                intercept = mean[j] + shift[j]
                if c[j, j] > 0:
                    g = Gram([used[i] for i in o], m, mean[o] + shift[o], intercept, c[np.ix_(o, o)], c[o, j], c[j, j])
                    fitted = bayesian_ridge(g)
                    weights, intercept = fitted.coefficients, fitted.intercept
            steps.append((j, o, [float(w) for w in weights], float(intercept)))
        model.steps += steps

        @F.pandas_udf("array<double>")
        def update(v, steps=tuple(steps)):
            import pandas as pd

            if not len(v):
                return pd.Series([], dtype=object)
            x = np.array(v.tolist(), float)
            new = _apply(x, list(steps))
            return pd.Series(list(np.column_stack([new, x[:, p:], np.abs(new - x[:, :p]).max(axis=1)])), index=v.index)

        made = keep(rows.select(update("v").alias("n")).select(F.slice("n", 1, 2 * p).alias("v"), F.get("n", F.lit(2 * p)).alias("move")))
        model.trace.append(float(made.agg(F.max("move")).first()[0]))
        rows = made.select("v")
        if model.trace[-1] <= limit:
            break
    return model
