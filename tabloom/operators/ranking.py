"""Learning to rank: pairs of rows of one query, and a linear ranker of their differences."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe, shuffle_key
from ..functions.stages import keep
from .gradient import _sums

#: Positions of a query that one window numbers.
PER_BUCKET = 4096


def _positions(rows: DataFrame, query: str, key: str, seed: int) -> DataFrame:
    """rows with their count ``_n`` in their query and their 0-based place ``_p`` in an md5 order; a large query is numbered in buckets of its hashes."""
    counts = rows.groupBy(query).agg(F.count(F.lit(1)).alias("_n"))
    h = shuffle_key(seed, query, key)
    sized = join_null_safe(rows, counts, [query]).withColumn("_h", h)
    # As many buckets as the query needs, at most 16^4, by the first digits of the hash; they rise with it.
    buckets = F.least(F.lit(65536), F.ceil(F.col("_n") / PER_BUCKET))
    sized = keep(sized.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("long") * buckets / 65536)))
    parts = sized.groupBy(query, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(query).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inside = sized.withColumn("_i", F.row_number().over(Window.partitionBy(query, "_b").orderBy("_h", key)) - 1)
    return join_null_safe(inside, before, [query, "_b"]).withColumn("_p", F.col("_i") + F.col("_before")).drop("_b", "_h", "_i", "_before")


def query_pairs(df: DataFrame, query: str, relevance: str, key: str, carry: list[str], opponents: int = 100, seed: int = 0) -> DataFrame:
    """(query, better, worse, carried columns under a_ and b_, weight): pairs of rows of one query of which better has more relevance.

    All pairs of queries of at most 2 x opponents + 1 rows. In a larger query each row meets the opponents after it on a ring in md5 order, so that every
    row takes part in 2 x opponents meetings and pairs grow with the rows, not their square. Weights of the pairs of a query sum to 1.
    Rows without query or relevance are in no pair; keys are unique within a query. Pairs are found by place, one row for
    each join key, so that a query of any size spreads over all tasks.
    """
    if opponents < 1:
        raise ValueError("opponents must be at least 1")
    known = df.where(F.col(query).isNotNull() & F.col(relevance).isNotNull() & ~F.isnan(F.col(relevance).cast("double")))
    rows = known.select(F.col(query).alias("query"), F.col(key).alias("key"), F.col(relevance).cast("double").alias("_rel"), *[F.col(c).alias(f"c_{c}") for c in carry])
    rows = keep(_positions(rows, "query", "key", seed))
    left = rows.select("query", "_n", *[F.col(c).alias(f"a_{c}") for c in ("key", "_rel", *[f"c_{c}" for c in carry])], F.col("_p").alias("_from"))
    # Half a round of the ring is every pair once; of an even number of rows the last step only from the first half.
    reach = F.least(F.lit(opponents), F.floor(F.col("_n") / 2)).cast("int")
    left = left.where("_n > 1").withColumn("_step", F.explode(F.sequence(F.lit(1), reach))).where("2 * _step <> _n or _from < _step")
    left = left.withColumn("_p", F.pmod(F.col("_from") + F.col("_step"), F.col("_n")))
    right = rows.select("query", "_p", *[F.col(c).alias(f"b_{c}") for c in ("key", "_rel", *[f"c_{c}" for c in carry])])
    met = left.join(right, ["query", "_p"]).where("a__rel <> b__rel")
    up = F.col("a__rel") > F.col("b__rel")
    both = lambda c, first: F.when(up == first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    pairs = met.select("query", both("key", True).alias("better"), both("key", False).alias("worse"), *[both(f"c_{c}", True).alias(f"a_{c}") for c in carry], *[both(f"c_{c}", False).alias(f"b_{c}") for c in carry])
    pairs = keep(pairs)
    return pairs.join(pairs.groupBy("query").agg((1.0 / F.count(F.lit(1))).alias("weight")), "query")


@dataclass
class LinearRanker:
    """A score for each row; higher is better. trace: the objective after each step."""

    features: list[str]
    coefficients: list[float]
    trace: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        """df with the score; null where a feature is unknown."""
        known = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in self.features]
        return df.withColumn(name, sum((c * F.lit(w) for c, w in zip(known, self.coefficients, strict=True)), F.lit(0.0)))

    def save(self, df: DataFrame, path: str) -> None:
        """As one JSON row, through the session of df."""
        df.sparkSession.createDataFrame([(json.dumps(self.__dict__),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load_ranker(df: DataFrame, path: str) -> LinearRanker:
    return LinearRanker(**json.loads(df.sparkSession.read.text(path).first()[0]))


def pairwise_ranker(train: DataFrame, features: list[str], relevance: str, query: str, key: str, alpha: float = 1e-3, opponents: int = 100, steps: int = 50, tol: float = 1e-9, seed: int = 0) -> LinearRanker:
    """Minimises the mean over queries of the weighted log loss of the differences of query_pairs() + alpha |w|^2 / 2, by Newton steps.

    A step is one aggregate of gradient and curvature, halved while the objective would rise. Pairs with an unknown feature are left
    out; without any pair the fit is refused.
    """
    if alpha <= 0:
        raise ValueError("alpha must be above 0: separable pairs have no optimum without it")
    pairs = query_pairs(train, query, relevance, key, features, opponents, seed)
    d = [(F.col(f"a_{f}").cast("double") - F.col(f"b_{f}").cast("double")).alias(f"d{i}") for i, f in enumerate(features)]
    # Pairs of equal differences are one with the sum of their weights: the loss is the same.
    names = [f"d{i}" for i in range(len(d))]
    merged = pairs.select(*d, F.col("weight").alias("w")).groupBy(*names).agg(F.sum("w").alias("w")).select(F.array(*names).alias("v"), "w")
    rows = keep(merged.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e))))
    total = rows.agg(F.sum("w")).first()[0]
    if not total:
        raise ValueError("no pair of rows of one query with different relevance and known features")
    p = len(features)

    def evaluate(b):
        def work(x, w):
            m = x @ b
            q = 1 / (1 + np.exp(np.clip(m, -700, 700)))
            return np.concatenate([[w @ np.logaddexp(0.0, -m)], -(w * q) @ x, ((x * (w * q * (1 - q))[:, None]).T @ x).ravel()])

        s = _sums(rows, work, ("w",)) / total
        return s[0] + alpha / 2 * b @ b, s[1 : p + 1] + alpha * b, s[p + 1 :].reshape(p, p) + alpha * np.eye(p)

    b = np.zeros(p)
    value, slope, bend = evaluate(b)
    trace = [float(value)]
    for _ in range(steps):
        move = np.linalg.solve(bend, slope)
        # Newton's decrement bounds what is left to gain.
        if slope @ move < tol:
            break
        length = 1.0
        while True:
            found = evaluate(b - length * move)
            if found[0] <= value or length < 1e-6:
                break
            length /= 2
        if found[0] > value:
            break
        b, (value, slope, bend) = b - length * move, found
        trace.append(float(value))
    return LinearRanker(features, [float(x) for x in b], trace)
