"""Linear models that outliers do not move: consensus of random subsets, and the spatial median of their fits.

Subsets are rows in an md5 order, of a number that only the parameters set; every row is asked whether it agrees.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_quantiles, finite, shuffle_key
from ..functions.stages import keep
from ..operators.gradient import _sums
from .gram import Linear, grams, ols


def _known(df: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    """Rows with known values, and ``_key``: the key and the values, so that rows which share it are the same."""
    known = df.select(F.col(key).cast("string").alias("_key"), *[finite(F.col(c)).alias(c) for c in [*features, label]]).dropna(subset=[*features, label])
    return known.withColumn("_key", F.concat_ws("|", F.coalesce("_key", F.lit("")), *[F.col(c).cast("string") for c in [*features, label]]))


def _subset_fits(rows: DataFrame, features: list[str], label: str, subsets: int, size: int, seed: int) -> np.ndarray:
    """(weights, intercept) of least squares on each subset of size rows; subsets without a unique fit are left out."""
    # Every task gives its first rows in md5 order; no row is ranked but these.
    drawn = rows.orderBy(shuffle_key(seed, "_key"), "_key").limit(subsets * size).collect()
    x = np.array([[*(r[f] for f in features), 1.0] for r in drawn])
    y, rng, out = np.array([r[label] for r in drawn]), np.random.default_rng(seed), []
    if len(x) < size:
        raise ValueError(f"{len(x)} rows with known values, {size} are needed")
    # Small tables: rows take part in several subsets.
    deals = [np.arange(i * size, (i + 1) * size) for i in range(subsets)] if len(x) == subsets * size else [rng.choice(len(x), size, replace=False) for _ in range(subsets)]
    for d in deals:
        a = x[d]
        scale = np.abs(a).max(axis=0)
        if scale.all() and np.linalg.matrix_rank(a / scale) == x.shape[1]:
            out.append(np.linalg.lstsq(a / scale, y[d], rcond=None)[0] / scale)
    if not out:
        raise ValueError("no subset determines the weights")
    return np.array(out)


def ransac(df: DataFrame, features: list[str], label: str, key: str, threshold: float | None = None, trials: int = 100, size: int | None = None, seed: int = 0) -> tuple[Linear, DataFrame]:
    """(least squares on the rows that agree, df with ``inlier``): the subset fit with which most rows agree within threshold wins.

    One pass counts for all trials; ties go to the least squared residuals, then the first. threshold None: the median absolute deviation of
    the label. size None: one row more than features. A row with an unknown value has a null inlier.
    Rows that share a key take part like any others.
    """
    keyed = _known(df, features, label, key)
    # Only the draw asks for keys; the passes read the values.
    rows = keep(keyed.drop("_key"))
    if threshold is None:
        middle = exact_quantiles(rows, label, [0.5])[0]
        if middle is None:
            raise ValueError("no rows with known values")
        threshold = exact_quantiles(rows.select(F.abs(F.col(label) - F.lit(middle)).alias("d")), "d", [0.5])[0]
    fits = _subset_fits(keyed, features, label, trials, size or len(features) + 1, seed)

    def agree(x):
        e = np.abs(x[:, -1:] - x[:, :-1] @ fits[:, :-1].T - fits[:, -1])
        inside = e <= threshold
        return np.concatenate([inside.sum(axis=0), (np.where(inside, e, 0.0) ** 2).sum(axis=0)])

    s = _sums(rows.select(F.array(*features, label).alias("v")), agree, ())
    count, square = s[: len(fits)], s[len(fits) :]
    best = min(range(len(fits)), key=lambda i: (-count[i], square[i] / max(count[i], 1), i))
    found = Linear(features, fits[best][:-1], float(fits[best][-1]))
    inlier = lambda d: F.abs(d[label].cast("double") - found.column()) <= F.lit(float(threshold))
    known = finite(F.col(label)).isNotNull()
    for f in features:
        known = known & finite(F.col(f)).isNotNull()
    return ols(grams(rows.where(inlier(rows)), features, label)[None]), df.withColumn("inlier", F.when(known, inlier(df)))


def theil_sen(df: DataFrame, features: list[str], label: str, key: str, subsets: int = 1000, size: int | None = None, seed: int = 0, steps: int = 1000, tol: float = 1e-10) -> Linear:
    """The spatial median of the fits of random subsets (of one row more than features), as weights and intercept."""
    fits = _subset_fits(_known(df, features, label, key), features, label, subsets, size or len(features) + 1, seed)
    at = np.median(fits, axis=0)
    for _ in range(steps):
        far = np.sqrt(((fits - at) ** 2).sum(axis=1))
        on = far <= 1e-12 * (1e-300 + far.max())
        pull = 1 / far[~on]
        if not len(pull):
            break
        new = pull @ fits[~on] / pull.sum()
        if on.any():
            # The median rests on a fit unless the others pull harder than the fits there hold.
            force = np.linalg.norm(((fits[~on] - at) * pull[:, None]).sum(axis=0))
            new = at + max(0.0, 1 - on.sum() / force if force else 0.0) * (new - at)
        done = np.abs(new - at).max() <= tol * (1e-300 + np.abs(new).max())
        at = new
        if done:
            break
    return Linear(features, at[:-1], float(at[-1]))
