"""Resampling for regression: a relevance of target values, the stretches of rare and usual values it makes, and rows added or removed in them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_quantiles, shuffled_rank
from ..functions.stages import keep, ship
from .resample import _draw, _quota, _towards

#: Rows of a stretch, drawn by hash, that the median distance of a row to its stretch is taken over; all rows of smaller ones.
MEDIAN_ROWS = 1000


@dataclass
class Relevance:
    """A monotone cubic through points (target, relevance in [0, 1], slope), straight outside of them, never outside of [0, 1]."""

    points: list[tuple[float, float, float]]

    def __post_init__(self):
        self.points = [tuple(map(float, p)) for p in self.points]
        ys = [p[0] for p in self.points]
        if any(len(p) != 3 or not all(map(math.isfinite, p)) or not 0 <= p[1] <= 1 for p in self.points) or len(self.points) < 2 or any(b <= a for a, b in zip(ys, ys[1:], strict=False)):
            raise ValueError("control points are (target, relevance from 0 to 1, slope) with rising targets")
        slopes = [p[2] for p in self.points]
        for i, (a, b) in enumerate(zip(self.points, self.points[1:], strict=False)):
            # Slopes that keep the cubic between its ends: none against the secant, none beyond a circle of three secants.
            secant = (b[1] - a[1]) / (b[0] - a[0])
            r, s = (slopes[i] / secant, slopes[i + 1] / secant) if secant else (0.0, 0.0)
            r, s = max(r, 0.0), max(s, 0.0)
            size = max(1.0, math.hypot(r, s) / 3)
            slopes[i], slopes[i + 1] = r / size * secant, s / size * secant
        self.points = [(y, p, s) for (y, p, _), s in zip(self.points, slopes, strict=True)]

    def _piece(self, i: int, y):
        """The cubic of stretch i, for numbers and for columns."""
        (y0, p0, s0), (y1, p1, s1) = self.points[i], self.points[i + 1]
        h = y1 - y0
        t = (y - y0) / h
        return p0 + t * (h * s0 + t * ((3 * (p1 - p0) - h * (2 * s0 + s1)) + t * (2 * (p0 - p1) + h * (s0 + s1))))

    def value(self, y: float) -> float:
        p = self.points
        if y <= p[0][0]:
            out = p[0][1] + p[0][2] * (y - p[0][0])
        elif y >= p[-1][0]:
            out = p[-1][1] + p[-1][2] * (y - p[-1][0])
        else:
            out = self._piece(next(i for i in range(len(p) - 1) if y < p[i + 1][0]), y)
        return min(1.0, max(0.0, out))

    def column(self, y: Column) -> Column:
        p, y = self.points, y.cast("double")
        out = F.when(y <= p[0][0], F.lit(p[0][1]) + F.lit(p[0][2]) * (y - p[0][0]))
        for i in range(len(p) - 1):
            out = out.when(y < p[i + 1][0], self._piece(i, y))
        out = out.when(y.isNotNull(), F.lit(p[-1][1]) + F.lit(p[-1][2]) * (y - p[-1][0]))
        return F.when(y.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), out)))

    def crossings(self, threshold: float, low: float, high: float) -> list[tuple[float, bool]]:
        """(target, rising) of each passage of the threshold between low and high: the first number on the other side."""
        ends = [low, *[p[0] for p in self.points if low < p[0] < high], high]
        out = []
        for a, b in zip(ends, ends[1:], strict=False):
            above = self.value(a) >= threshold
            if (self.value(b) >= threshold) == above:
                continue
            while True:
                mid = a + (b - a) / 2
                if not a < mid < b:
                    break
                a, b = (mid, b) if (self.value(mid) >= threshold) == above else (a, mid)
            out.append((b, not above))
        return out


def box_relevance(train: DataFrame, target: str, focus: str = "both") -> Relevance:
    """Relevance 0 at the median, 1 at the whiskers of a box plot with values beyond them (ends of the range without: 0), flat at all three.

    Whiskers: the extreme values within one and a half box lengths of the box. focus high or low leaves the other side at 0.
    """
    if focus not in ("both", "high", "low"):
        raise ValueError("focus must be both, high or low")
    q1, median, q3 = exact_quantiles(train, target, [0.25, 0.5, 0.75])
    if median is None:
        raise ValueError("no known targets")
    reach, y = 1.5 * (q3 - q1), F.col(target).cast("double")
    inside = (y >= q1 - reach) & (y <= q3 + reach)
    r = train.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.min(F.when(inside, y)).alias("a"), F.max(F.when(inside, y)).alias("b")).first()
    low = (r["a"], 1.0, 0.0) if focus != "high" and r["lo"] < r["a"] else (r["lo"], 0.0, 0.0)
    high = (r["b"], 1.0, 0.0) if focus != "low" and r["hi"] > r["b"] else (r["hi"], 0.0, 0.0)
    if not low[0] < median < high[0]:
        raise ValueError("the median is an end of the box plot: give control points")
    return Relevance([low, (median, 0.0, 0.0), high])


def stretches(train: DataFrame, target: str, relevance: Relevance, threshold: float = 0.5) -> tuple[DataFrame, list[dict]]:
    """train with ``stretch`` (number of passages of the threshold below the target), and {stretch, rare, n} of each stretch with rows."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    y = F.col(target).cast("double")
    r = train.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count_if(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))).alias("unknown")).first()
    if r["unknown"]:
        raise ValueError(f"{r['unknown']} rows have no finite target")
    if r["lo"] is None:
        raise ValueError("no rows to resample")
    found = relevance.crossings(threshold, r["lo"], r["hi"])
    out = train.withColumn("stretch", sum(((y >= c).cast("int") for c, _ in found), F.lit(0)))
    first = relevance.value(r["lo"]) >= threshold
    sizes = {x["stretch"]: x["count"] for x in out.groupBy("stretch").count().collect()}
    return out, [{"stretch": i, "rare": first ^ bool(i % 2), "n": n} for i, n in sorted(sizes.items())]


def wanted(sizes: list[dict], sampling: str = "balance") -> dict[int, int]:
    """Rows that each stretch should have: the same in all (balance) or in inverse proportion to its rows (extreme), as many in all as before."""
    if sampling not in ("balance", "extreme"):
        raise ValueError("sampling must be balance or extreme")
    total = sum(s["n"] for s in sizes)
    share = {s["stretch"]: 1.0 if sampling == "balance" else 1.0 / s["n"] for s in sizes}
    return {i: max(1, int(total * x / sum(share.values()))) for i, x in share.items()}


def _noisy(seeds: DataFrame, pool: DataFrame, target: str, key: str, features: list[str], k: int, seed: int, perturbation: float, n: int) -> DataFrame:
    """Synthetic rows of smogn: towards a neighbour within half the median distance of the stretch, else the row with normal noise."""
    joined = _towards(seeds, pool, key, features, k, seed, (target,))
    share = min(1.0, MEDIAN_ROWS / n)
    drawn = pool.where(_draw(seed, "median", key) < 2 * share).select(_draw(seed, "median", key).alias("z"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    some = np.array([r["v"] for r in drawn.orderBy("z").limit(MEDIAN_ROWS).collect()])
    ship(pool.sparkSession)

    @F.pandas_udf("double")
    def half_median(v):
        import pandas as pd

        x = [np.sort(np.sqrt(((some - np.asarray(r)) ** 2).sum(axis=1))) for r in v]
        # The row itself, at distance 0, is not of its own stretch's distances.
        x = [d[1:] if len(d) > 1 and d[0] == 0 else d for d in x]
        return pd.Series([float(np.median(d)) / 2 for d in x], index=v.index, dtype=float)

    spread = pool.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate([*features, target])]).first()
    joined = joined.withColumn("_safe", half_median(F.array(*[F.col(f).cast("double") for f in features])))
    near, size = F.col("_distance") < F.col("_safe"), F.least(F.col("_safe"), F.lit(perturbation))

    def normal(i: int) -> Column:
        return F.sqrt(-2 * F.ln(1 - _draw(seed, f"radius{i}", key, "_copy"))) * F.cos(2 * math.pi * _draw(seed, f"angle{i}", key, "_copy"))

    def made(i: int, c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(near, _mixed(c, c == target)).otherwise(x + normal(i) * size * F.lit(float(spread[i] or 0.0)))

    return joined.withColumns({c: made(i, c) for i, c in enumerate([*features, target])})


def _mixed(c: str, is_target: bool) -> Column:
    """On the way to the neighbour; a target by the distances to both ends, or the mean of two rows at the same place."""
    x, to = F.col(c).cast("double"), F.col(f"_{c}")
    u = F.when(F.col("_distance") > 0, F.col("_u")).otherwise(0.5) if is_target else F.col("_u")
    return x + u * (to - x)


def resample_regression(
    train: DataFrame, target: str, key: str, features: list[str], how: str = "smoter", focus: str = "both", sampling: str = "balance", threshold: float = 0.5, points: list | None = None, k: int = 5,
    perturbation: float = 0.02, undersample: bool = True, seed: int = 0,
) -> DataFrame:
    """train with ``stretch`` and ``synthetic``, rare stretches brought up and usual ones down to wanted().

    over: copies of rows, none removed; under: rows removed by an md5 order, none added; smoter: new rows between a row and one of its k nearest rows
    of its stretch; smogn: the same while the neighbour is nearer than half the median distance to the rows of the stretch, else
    the row with normal noise of perturbation (or that half distance, if less) standard deviations of the stretch. smoter and smogn remove
    rows only with undersample. Synthetic rows have a null key and null in all other columns; a copy keeps its values. Features and
    targets must be known; fewer than three distinct targets, or no rare or no usual stretch, are refused.
    """
    if how not in ("over", "under", "smoter", "smogn"):
        raise ValueError("how must be over, under, smoter or smogn")
    if k < 1 or not 0 < perturbation <= 1:
        raise ValueError("k must be at least 1 and perturbation in (0, 1]")
    if clash := {"stretch", "synthetic"} & set(train.columns):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    if train.select(target).distinct().limit(3).count() < 3:
        raise ValueError("fewer than three distinct targets")
    new = how in ("smoter", "smogn")
    base = train.withColumns({c: F.col(c).cast("double") for c in ([*features, target] if new else [target])})
    unknown = sum((F.count_if(F.col(f).isNull() | F.isnan(F.col(f))) for f in features), F.lit(0))
    if new and base.agg(unknown.alias("n")).first()[0]:
        raise ValueError("fill unknown features first")
    relevance = Relevance(points) if points is not None else box_relevance(base, target, focus)
    rows, sizes = stretches(base, target, relevance, threshold)
    if len({s["rare"] for s in sizes}) < 2:
        raise ValueError("the targets are all rare or all usual: change the threshold, the focus or the control points")
    rows, goal = keep(rows), wanted(sizes, sampling)
    out = []
    for s in sizes:
        i, n = s["stretch"], s["n"]
        part = rows.where(F.col("stretch") == i)
        if goal[i] < n and (how == "under" or new and undersample):
            kept = shuffled_rank(part, seed, key, name="_rank").where(F.col("_rank") <= goal[i]).drop("_rank")
            out.append(kept.withColumn("synthetic", F.lit(False)))
            continue
        out.append(part.withColumn("synthetic", F.lit(False)))
        if goal[i] <= n or how == "under" or not s["rare"]:
            continue
        seeds = _quota(part, key, goal[i] - n, n, seed)
        if how == "over":
            out.append(seeds.drop("_copy").withColumn("synthetic", F.lit(False)))
            continue
        if n < 2:
            raise ValueError(f"stretch {i} has one row and no neighbours")
        made = _noisy(seeds, part, target, key, features, k, seed, perturbation, n) if how == "smogn" else _towards(seeds, part, key, features, k, seed, (target,)).withColumns({c: _mixed(c, c == target) for c in [*features, target]})
        kinds = dict(base.dtypes)
        out.append(made.select(*[F.col(c) if c in (*features, target) else F.lit(None).cast(kinds[c]).alias(c) for c in base.columns], F.lit(i).alias("stretch"), F.lit(True).alias("synthetic")))
    total = out[0]
    for part in out[1:]:
        total = total.unionByName(part)
    return total
