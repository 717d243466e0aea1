"""Isolation forest: trees from small hash samples, held as flat arrays; paths of all rows in vectorised batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_quantiles
from ..functions.stages import keep, ship

EULER = 0.5772156649015329


def mean_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows: 2 (ln(n - 1) + Euler's constant) - 2 (n - 1) / n; 1 for two rows, 0 below."""
    n = np.asarray(n, float)
    big = np.maximum(n, 3.0)
    return np.where(n > 2, 2 * (np.log(big - 1) + EULER) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    """Flat arrays by node: the feature split on (-1 in a leaf), the threshold (below or equal goes left), the children, and a leaf's path length."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray

    def paths(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.path[at]
            node = at[inner]
            at[inner] = np.where(x[inner, f[inner]] <= self.threshold[node], self.left[node], self.right[node])


def grow(x: np.ndarray, height: int, rng: np.random.Generator) -> Tree:
    """Splits of random features at random values between their least and largest, down to single rows, equal rows or the height."""
    feature, threshold, left, right, path = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        i = len(feature)
        for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (path, depth + float(mean_path(len(rows))))):
            a.append(v)
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth >= height or len(rows) < 2 or not len(open_):
            return i
        f = int(rng.choice(open_))
        t = float(rng.uniform(low[f], high[f]))
        t = t if t < high[f] else float(low[f])
        feature[i], threshold[i] = f, t
        left[i] = node(rows[x[rows, f] <= t], depth + 1)
        right[i] = node(rows[x[rows, f] > t], depth + 1)
        return i

    node(np.arange(len(x)), 0)
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(path))


def _samples(rows: DataFrame, n: int, trees: int, size: int, seed: int) -> list[np.ndarray]:
    """For each tree the rows of the size smallest hashes of seed, tree and key; one pass that passes on about twice as many."""
    share = 1.0 if n <= 2 * size else 2 * size / n
    seeds = np.random.default_rng(seed).integers(0, 1 << 63, trees, dtype=np.uint64)

    def draw(batches):
        import pandas as pd

        for b in batches:
            h = b["h"].to_numpy().view(np.uint64)
            for t in range(trees):
                z = (h ^ seeds[t]) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                z = (z ^ (z >> np.uint64(29))) >> np.uint64(11)
                at = np.flatnonzero(z < np.uint64(int(share * (1 << 53))))
                if len(at):
                    yield pd.DataFrame({"tree": t, "z": z[at].astype(np.int64), "v": b["v"].to_numpy()[at]})

    drawn: list[list] = [[] for _ in range(trees)]
    for r in rows.mapInPandas(draw, "tree int, z long, v array<double>").collect():
        drawn[r["tree"]].append((r["z"], r["v"]))
    return [np.array([v for _, v in sorted(d)[:size]]) for d in drawn]


@dataclass
class Forest:
    """A fitted forest; the cut is the score above which the contamination share of the training rows lies."""

    features: list[str]
    trees: list[Tree]
    size: int
    cut: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 2.0 ** (-np.mean([t.paths(x) for t in self.trees], axis=0) / mean_path(self.size))

    def scored(self, df: DataFrame) -> DataFrame:
        """df with anomaly_score in (0, 1), higher is more unusual; null where a feature is unknown."""

        @F.pandas_udf("double")
        def score(v):
            import pandas as pd

            return pd.Series(self.scores(np.stack(v)) if len(v) else [], dtype=float)

        known = [F.col(f).cast("double") for f in self.features]
        whole = ~F.exists(F.array(*known), lambda e: e.isNull() | F.isnan(e))
        zeros = F.array(*[F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in known])
        return df.withColumn("anomaly_score", F.when(whole, score(zeros)))

    def transform(self, df: DataFrame) -> DataFrame:
        """scored() with anomaly: -1 above the cut, else 1."""
        out = self.scored(df)
        return out.withColumn("anomaly", F.when(F.col("anomaly_score") > self.cut, -1).when(F.col("anomaly_score").isNotNull(), 1))


def isolation_forest(df: DataFrame, key: str, features: list[str], trees: int = 100, size: int = 256, contamination: float = 0.1, seed: int = 0) -> Forest:
    """Scores 2^(-mean path / mean path among size rows). The sample of each tree is at most size rows: that is the method, and all that reaches the driver.

    Rows with an unknown feature are not sampled; keys need not be unique. The cut is an exact quantile of the training scores.
    """
    if not 0 < contamination <= 0.5 or trees < 1 or size < 2:
        raise ValueError("contamination above 0 and at most 0.5, one tree and two rows at least")
    ship(df.sparkSession)
    known = df.dropna(subset=features)
    rows = known.select(F.xxhash64(F.col(key).cast("string"), *[F.col(f).cast("double") for f in features]).alias("h"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    rows = rows.where(~F.exists("v", lambda e: F.isnan(e)))
    n = rows.count()
    if n < 2:
        raise ValueError("a forest needs two rows")
    rng = np.random.default_rng(seed)
    size = min(size, n)
    grown = [grow(x, int(np.ceil(np.log2(size))), np.random.default_rng(s)) for x, s in zip(_samples(rows, n, trees, size, seed), rng.integers(0, 1 << 62, trees), strict=True) if len(x)]
    forest = Forest(features, grown, size)
    # A distinct vector is scored once, however many rows and passes there are.
    places = known.select(*[F.col(f).cast("double").alias(f) for f in features]).groupBy(*features).agg(F.count(F.lit(1)).alias("_n"))
    forest.cut = exact_quantiles(keep(forest.scored(places).select("anomaly_score", "_n")), "anomaly_score", [1 - contamination], "_n")[0]
    return forest


def flagged(score: Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame:
    """(anomaly, n)."""
    return score(df).groupBy("anomaly").agg(F.count(F.lit(1)).alias("n"))
