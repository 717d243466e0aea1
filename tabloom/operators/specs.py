"""Nested specifications of preparation and models: compiled to estimators that can be fitted, saved, loaded, renamed and searched.

A spec is a dict. A step has a kind and its options; three kinds nest:
  {"kind": "chain", "steps": [[name, spec], ...]}        the columns of a step are those that the step before made
  {"kind": "union", "steps": [[name, spec], ...]}        every part sees the same columns, their results stand side by side
  {"kind": "columns", "parts": [[name, spec, columns], ...], "remainder": "drop" or "passthrough"}
columns: a list of names, "numeric", "text" or {"pattern": regex}; parts must be disjoint. The last step of the outermost chain may be
a model. Options are set from outside by path: {"prep__num__scale__how": "robust", "model__alpha": 1.0}.

Statistics come from training rows only and are plain JSON: at most LIMIT categories a column, which the driver may hold. Result
columns are named path__column, so that no two steps write one name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from copy import deepcopy
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations_with_replacement, product

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml import Model as MLModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import apply_math, exact_quantiles, finite, is_numeric, shuffled_rank
from ..functions.stages import keep
from ..plans import gram as G
from ..plans import penalised as N
from . import factors as X
from . import gradient as D
from . import impute as I
from . import learn as L
from . import metrics as M
from . import prepare as P
from .checks import direction

#: Most categories of a column, most columns of a step, most fits of a search.
LIMIT, WIDE, MOST_FITS = 2000, 2000, 500
NESTED = ("chain", "union", "columns")


def _number(c: str) -> Column:
    return finite(F.col(c))


def _aggregates(df: DataFrame, columns: list[str], **aggs: Callable[[Column], Column]) -> dict[str, dict[str, float]]:
    """{name: {column: value}} from one pass."""
    row = df.agg(*[f(_number(c)).alias(f"{name}|{i}") for name, f in aggs.items() for i, c in enumerate(columns)]).first()
    return {name: {c: row[f"{name}|{i}"] for i, c in enumerate(columns)} for name in aggs}


def _categories(df: DataFrame, column: str, least: int = 1) -> list[str]:
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).count().where(F.col("count") >= least).limit(LIMIT + 1).collect()
    if len(counted) > LIMIT:
        raise ValueError(f"{column} has more than {LIMIT} categories")
    return sorted(r["v"] for r in counted)


# Each kind: fit(df, columns, options, target) -> statistics, and make(columns, statistics, options) -> {suffix of the new column: expression}.


def _fit_impute(df, columns, o, target):
    how = o.get("how", "median")
    if how == "mean":
        found = _aggregates(df, columns, v=F.avg)["v"]
    elif how == "median":
        found = {c: exact_quantiles(df.select(_number(c).alias(c)), c, [0.5])[0] for c in columns}
    elif how == "constant":
        found = dict.fromkeys(columns, float(o["value"]))
    else:
        raise ValueError("impute how: mean, median or constant")
    gaps = _aggregates(df, columns, n=lambda c: F.count_if(c.isNull()))["n"] if o.get("indicator") else {}
    return {"value": {c: 0.0 if v is None else float(v) for c, v in found.items()}, "gaps": [c for c, n in gaps.items() if n]}


def _make_impute(columns, s, o):
    return {c: F.coalesce(_number(c), F.lit(s["value"][c])) for c in columns} | {f"{c}_missing": _number(c).isNull().cast("double") for c in s["gaps"]}


def _fit_scale(df, columns, o, target):
    how = o.get("how", "standard")
    if how == "standard":
        s = _aggregates(df, columns, a=F.avg, b=F.stddev_pop)
    elif how == "minmax":
        s = _aggregates(df, columns, a=F.min, b=lambda c: F.max(c) - F.min(c))
    elif how == "maxabs":
        s = {"a": dict.fromkeys(columns, 0.0)} | _aggregates(df, columns, b=lambda c: F.max(F.abs(c)))
    elif how == "robust":
        q = {c: exact_quantiles(df.select(_number(c).alias(c)), c, [0.25, 0.5, 0.75]) for c in columns}
        s = {"a": {c: v[1] for c, v in q.items()}, "b": {c: None if v[0] is None else v[2] - v[0] for c, v in q.items()}}
    else:
        raise ValueError("scale how: standard, minmax, maxabs or robust")
    return {"a": {c: float(v or 0.0) for c, v in s["a"].items()}, "b": {c: float(v or 1.0) for c, v in s["b"].items()}}


def _fit_onehot(df, columns, o, target):
    return {c: _categories(df, c, o.get("min_count", 1)) for c in columns}


def _make_onehot(columns, s, o):
    if sum(map(len, s.values())) > WIDE:
        raise ValueError(f"more than {WIDE} columns")
    return {f"{c}_{i}": F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) for c in columns for i, v in enumerate(s[c])}


def _make_codes(columns, s, o):
    """Places in the list of categories; unknown and null are -1."""
    return {c: (F.coalesce(F.array_position(F.array(*map(F.lit, s[c])).cast("array<string>"), F.col(c).cast("string")), F.lit(0)) - 1).cast("double") for c in columns}


def _make_hash(columns, s, o):
    """Counts of `column=value` in buckets by hash."""
    n = int(o.get("size", 32))
    spots = [F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(F.concat(F.lit(f"{c}="), F.col(c).cast("string"))), F.lit(n))) for c in columns]
    return {f"h{k}": reduce(lambda a, b: a + b, [F.coalesce((p == k).cast("double"), F.lit(0.0)) for p in spots]) for k in range(n)}


def _make_polynomial(columns, s, o):
    degree, alone = int(o.get("degree", 2)), o.get("interaction_only", False)
    terms = [t for d in range(1, degree + 1) for t in combinations_with_replacement(columns, d) if not alone or len(set(t)) == len(t)]
    if len(terms) > WIDE:
        raise ValueError(f"more than {WIDE} columns")
    return {"_x_".join(t): reduce(lambda a, b: a * b, map(_number, t)) for t in terms}


def _fit_spline(df, columns, o, target):
    knots = int(o.get("knots", 5))
    if knots < 2:
        raise ValueError("a spline needs 2 knots")
    found = {c: exact_quantiles(df.select(_number(c).alias(c)), c, [i / (knots - 1) for i in range(knots)]) for c in columns}
    return {c: sorted({float(v) for v in q if v is not None}) for c, q in found.items()}


def _make_spline(columns, s, o):
    """B-splines over quantile knots, evenly continued outside; values beyond the ends are held at them."""
    degree, out = int(o.get("degree", 3)), {}
    for c in columns:
        k = s[c]
        if len(k) < 2:
            out[f"{c}_0"] = F.when(_number(c).isNotNull(), 1.0)
            continue
        t = [k[0] - (k[1] - k[0]) * i for i in range(degree, 0, -1)] + k + [k[-1] + (k[-1] - k[-2]) * i for i in range(1, degree + 1)]
        # The last knot belongs to the last interval.
        x = F.least(F.greatest(_number(c), F.lit(k[0])), F.lit(float(np.nextafter(k[-1], k[0]))))
        x = F.when(_number(c).isNotNull(), x)
        basis = [F.when((x >= a) & (x < b), 1.0).when(x.isNotNull(), 0.0) for a, b in zip(t[:-1], t[1:], strict=True)]
        for d in range(1, degree + 1):
            basis = [(x - t[i]) / (t[i + d] - t[i]) * basis[i] + (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * basis[i + 1] for i in range(len(t) - d - 1)]
        out |= {f"{c}_{i}": b for i, b in enumerate(basis)}
    return out


def _fit_bins(df, columns, o, target):
    n, how = int(o.get("count", 5)), o.get("how", "quantile")
    if how == "quantile":
        found = {c: exact_quantiles(df.select(_number(c).alias(c)), c, [i / n for i in range(1, n)]) for c in columns}
    elif how == "uniform":
        s = _aggregates(df, columns, lo=F.min, hi=F.max)
        found = {c: [s["lo"][c] + (s["hi"][c] - s["lo"][c]) * i / n for i in range(1, n)] if s["lo"][c] is not None else [] for c in columns}
    else:
        raise ValueError("bins how: quantile or uniform")
    return {c: sorted({float(e) for e in v if e is not None}) for c, v in found.items()}


def _fit_pca(df, columns, o, target):
    g = G.grams(df.select(*[_number(c).alias(c) for c in columns]).withColumn("_zero", F.lit(0.0)), columns, "_zero")
    if not g:
        raise ValueError("no rows without gaps")
    vectors = np.linalg.eigh(g[None].xx)[1][:, ::-1][:, : int(o.get("components", 2))].T
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    return {"mean": dict(zip(columns, map(float, g[None].mean), strict=True)), "axes": vectors.tolist()}


def _fit_select(df, columns, o, target):
    """The k columns of largest |correlation| with the target, which is largest F as well."""
    row = df.agg(*[F.abs(F.corr(_number(c), F.col(target).cast("double"))).alias(str(i)) for i, c in enumerate(columns)]).first()
    scores = {c: -1.0 if row[str(i)] is None or np.isnan(row[str(i)]) else row[str(i)] for i, c in enumerate(columns)}
    kept = sorted(columns, key=lambda c: (-scores[c], c))[: int(o.get("k", 10))]
    return {"kept": [c for c in columns if c in kept]}


def _fit_variance(df, columns, o, target):
    v = _aggregates(df, columns, v=F.var_pop)["v"]
    kept = [c for c in columns if (v[c] or 0.0) > o.get("threshold", 0.0)]
    if not kept:
        raise ValueError("no column varies by more than the threshold")
    return {"kept": kept}


def _fit_clip(df, columns, o, target):
    return {c: exact_quantiles(df.select(_number(c).alias(c)), c, [o.get("lower", 0.05), o.get("upper", 0.95)]) for c in columns}


def _fit_factors(df, columns, o, target, fit):
    found = fit(df.select(*[_number(c).alias(c) for c in columns]), columns, int(o.get("components", 2)))
    return {**found.__dict__, "trace": []}


def _make_factors(columns, s, o):
    return {f"{s['kind']}{i}": c for i, c in enumerate(X.Factors(**s).expressions())}


def _fit_iterative(df, columns, o, target):
    found = I.iterative_impute(df, columns, int(o.get("rounds", 10)), o.get("tol", 1e-3), o.get("nearest"))
    return {"columns": found.columns, "start": found.start, "steps": [list(x) for x in found.steps]}


def _make_iterative(columns, s, o):
    """A column without any known value stays null."""
    found = I.IterativeImputer(**s).expressions() if s["columns"] else {}
    return {c: found.get(c, F.lit(None).cast("double")) for c in columns}


def _fit_power(df, columns, o, target):
    how = o.get("how", "yeo_johnson")
    if how not in ("yeo_johnson", "box_cox"):
        raise ValueError("power how: yeo_johnson or box_cox")
    known = df.select(*[_number(c).alias(c) for c in columns])
    if how == "box_cox" and known.agg(*[F.count_if(F.col(c) <= 0).alias(c) for c in columns]).where(" or ".join(f"`{c}` > 0" for c in columns)).count():
        raise ValueError("box_cox needs values above 0")
    return {c: P.power(known, c, how).stats["exponent"] for c in columns}


def _make_power(columns, s, o):
    return {c: _number(c) if s[c] is None else P._power(_number(c), s[c], o.get("how", "yeo_johnson")) for c in columns}


def _fit_quantile(df, columns, o, target):
    n = int(o.get("quantiles", 32))
    if n < 1 or o.get("output", "uniform") not in ("uniform", "normal"):
        raise ValueError("quantile: at least 1 quantile, output uniform or normal")
    return {c: exact_quantiles(df.select(_number(c).alias(c)), c, [i / n for i in range(n + 1)]) for c in columns}


def _make_quantile(columns, s, o):
    """Piecewise linear between quantiles; a value that several share gets their middle. normal: within 1e-7 of either end is moved there."""

    @F.pandas_udf("double")
    def normal(p):
        from statistics import NormalDist

        import pandas as pd

        inverse = NormalDist().inv_cdf
        return pd.Series([None if v != v else inverse(min(max(v, 1e-7), 1 - 1e-7)) for v in p], index=p.index, dtype=float)

    def place(c):
        q, x, total = s[c], _number(c), F.lit(0.0)
        if q[0] is None:
            return F.lit(None).cast("double")
        for a, b in zip(q, q[1:], strict=False):
            total = total + (F.least(F.greatest((x - a) / (b - a), F.lit(0.0)), F.lit(1.0)) if b > a else F.when(x > a, 1.0).when(x == a, 0.5).otherwise(0.0))
        even = F.when(x < q[0], 0.0).when(x > q[-1], 1.0).when(x.isNotNull(), total / (len(q) - 1))
        return F.when(x.isNotNull(), normal(even)) if o.get("output") == "normal" else even

    return {c: place(c) for c in columns}


def _make_projection(columns, s, o):
    """Gaussian directions whose expected squared lengths are kept."""
    k = int(o.get("components", 2))
    m = np.random.default_rng(int(o.get("seed", 0))).normal(size=(k, len(columns))) / np.sqrt(k)
    return {f"rp{i}": sum((_number(c) * F.lit(float(w)) for c, w in zip(columns, row, strict=True)), F.lit(0.0)) for i, row in enumerate(m)}


def _make_rbf(columns, s, o):
    """Random Fourier features of the kernel exp(-gamma |x - y|^2): their products are near it."""
    k, rng = int(o.get("components", 100)), np.random.default_rng(int(o.get("seed", 0)))
    m, shift = rng.normal(size=(k, len(columns))) * np.sqrt(2 * o.get("gamma", 1.0)), rng.uniform(0, 2 * np.pi, k)
    return {f"rbf{i}": F.lit(float(np.sqrt(2 / k))) * F.cos(sum((_number(c) * F.lit(float(w)) for c, w in zip(columns, row, strict=True)), F.lit(float(b)))) for i, (row, b) in enumerate(zip(m, shift, strict=True))}


def _nothing(df, columns, o, target):
    return {}


TRANSFORMERS: dict[str, tuple[Callable, Callable]] = {
    "passthrough": (_nothing, lambda columns, s, o: {c: F.col(c) for c in columns}),
    "impute": (_fit_impute, _make_impute),
    "scale": (_fit_scale, lambda columns, s, o: {c: (_number(c) - F.lit(s["a"][c])) / F.lit(s["b"][c]) for c in columns}),
    "clip": (_fit_clip, lambda columns, s, o: {c: F.when(_number(c).isNotNull(), F.greatest(F.lit(s[c][0]), F.least(F.lit(s[c][1]), _number(c)))) for c in columns}),
    "normalize": (_nothing, lambda columns, s, o: {c: _number(c) / F.coalesce(F.nullif(F.sqrt(sum((_number(x) * _number(x) for x in columns), F.lit(0.0))), F.lit(0.0)), F.lit(1.0)) for c in columns}),
    "binarize": (_nothing, lambda columns, s, o: {c: (_number(c) > o.get("threshold", 0.0)).cast("double") for c in columns}),
    "math": (_nothing, lambda columns, s, o: {c: apply_math(_number(c), o["function"]) for c in columns}),
    "missing": (_nothing, lambda columns, s, o: {c: F.col(c).isNull().cast("double") for c in columns}),
    "onehot": (_fit_onehot, _make_onehot),
    "ordinal": (_fit_onehot, _make_codes),
    "hash": (_nothing, _make_hash),
    "polynomial": (_nothing, _make_polynomial),
    "spline": (_fit_spline, _make_spline),
    "bins": (_fit_bins, lambda columns, s, o: {c: F.when(_number(c).isNotNull(), sum([(_number(c) > e).cast("double") for e in s[c]], F.lit(0.0))) for c in columns}),
    "pca": (_fit_pca, lambda columns, s, o: {f"pc{i}": sum(((_number(c) - F.lit(s["mean"][c])) * F.lit(w) for c, w in zip(columns, axis, strict=True)), F.lit(0.0)) for i, axis in enumerate(s["axes"])}),
    "ica": (lambda df, columns, o, target: _fit_factors(df, columns, o, target, lambda d, c, k: X.fast_ica(d, c, k, seed=int(o.get("seed", 0)))), _make_factors),
    "nmf": (lambda df, columns, o, target: _fit_factors(df, columns, o, target, X.nmf), _make_factors),
    "factor_analysis": (lambda df, columns, o, target: _fit_factors(df, columns, o, target, X.factor_analysis), _make_factors),
    "iterative_impute": (_fit_iterative, _make_iterative),
    "power": (_fit_power, _make_power),
    "quantile": (_fit_quantile, _make_quantile),
    "random_projection": (_nothing, _make_projection),
    "rbf": (_nothing, _make_rbf),
    "select": (_fit_select, lambda columns, s, o: {c: F.col(c) for c in s["kept"]}),
    "variance": (_fit_variance, lambda columns, s, o: {c: F.col(c) for c in s["kept"]}),
}
GRAM = {
    "ols": lambda g, o: G.ols(g), "ridge": lambda g, o: G.ridge(g, o.get("alpha", 1.0)), "lasso": lambda g, o: G.lasso(g, o.get("alpha", 1.0)), "elastic_net": lambda g, o: G.elastic_net(g, o.get("alpha", 1.0), o.get("l1_ratio", 0.5)),
    "nonnegative": lambda g, o: G.nonnegative(g), "adaptive_lasso": lambda g, o: G.adaptive_lasso(g, o.get("alpha", 1.0)), "bayesian_ridge": lambda g, o: G.bayesian_ridge(g), "ard": lambda g, o: N.ard(g), "omp": lambda g, o: G.omp(g, min(int(o.get("size", 1)), len(g.xy))),
    "lars": lambda g, o: N.lars(g, int(o.get("size", 500))), "lasso_lars": lambda g, o: N.lasso_lars(g, o.get("alpha", 1.0)), "group_lasso": lambda g, o: N.group_lasso(g, o.get("alpha", 0.1), int(o.get("group_size", 2))),
    "sparse_group_lasso": lambda g, o: N.sparse_group_lasso(g, o.get("alpha", 0.1), o.get("l1_ratio", 0.5), int(o.get("group_size", 2))), "fused_lasso": lambda g, o: N.fused_lasso(g, o.get("alpha", 0.1), o.get("fusion", 0.1)),
    "scad": lambda g, o: N.scad(g, o.get("alpha", 0.1), o.get("gamma", 3.7)), "pls": lambda g, o: N.pls(g, int(o.get("components", 2))),
}
CLASSIFIERS = ("logistic", "linear_svc", "naive_bayes", "tree_classifier", "forest_classifier", "boosting_classifier")
REGRESSORS = ("tree_regressor", "forest_regressor", "boosting_regressor")
MODELS = (*GRAM, *CLASSIFIERS, *REGRESSORS, "gradient")


def set_options(spec: dict, options: dict) -> dict:
    """A copy of spec with options set by path; a path that names no step is an error."""
    out = deepcopy(spec)
    for path, value in options.items():
        node, names = out, path.split("__")
        for name in names[:-1]:
            inner = {p[0]: p[1] for p in node.get("steps", node.get("parts", []))}
            if name not in inner:
                raise ValueError(f"{path}: no step {name}")
            node = inner[name]
        if node["kind"] in NESTED and names[-1] != "remainder":
            raise ValueError(f"{path}: {node['kind']} has no option {names[-1]}")
        node[names[-1]] = value
    return out


def _check(spec: dict, last: bool = True, top: bool = True) -> None:
    kind = spec.get("kind")
    if kind in MODELS:
        if not last:
            raise ValueError(f"{kind}: a model can only be the last step")
        return
    if kind not in NESTED and kind not in TRANSFORMERS:
        raise ValueError(f"unknown kind {kind}; choose from {', '.join([*NESTED, *TRANSFORMERS, *MODELS])}")
    children = [(p[0], p[1]) for p in spec.get("steps", spec.get("parts", []))] if kind in NESTED else []
    names = [n for n, _ in children]
    if kind in NESTED and not children:
        raise ValueError(f"{kind} without steps")
    if len(set(names)) < len(names) or any("__" in n or not n for n in names):
        raise ValueError("names of steps must differ and hold no __")
    for i, (_, child) in enumerate(children):
        _check(child, last and top and kind == "chain" and i == len(children) - 1, top and kind == "chain")


def _chosen(df: DataFrame, columns: list[str], choice) -> list[str]:
    kinds = {f.name: is_numeric(f) for f in df.schema}
    if isinstance(choice, str):
        if choice not in ("numeric", "text"):
            raise ValueError("columns: a list, numeric, text or a pattern")
        return [c for c in columns if kinds[c] == (choice == "numeric")]
    if isinstance(choice, dict):
        return [c for c in columns if re.search(choice["pattern"], c)]
    unknown = [c for c in choice if c not in columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return list(choice)


@dataclass
class Step:
    """A fitted node: its spec's kind, path, the columns it takes and makes, statistics, and fitted nodes inside."""

    kind: str
    path: str
    columns: list[str]
    made: list[str] = field(default_factory=list)
    stats: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    inner: list[Step] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.kind in NESTED:
            return reduce(lambda d, s: s.apply(d), self.inner, df)
        made = TRANSFORMERS[self.kind][1](self.columns, self.stats, self.options)
        return df.withColumns({f"{self.path}__{k}": c for k, c in made.items()})

    def state(self) -> dict:
        return {**self.__dict__, "inner": [s.state() for s in self.inner]}

    @staticmethod
    def of(state: dict) -> Step:
        return Step(**{**state, "inner": [Step.of(s) for s in state["inner"]]})


def _fit_step(df: DataFrame, spec: dict, columns: list[str], target: str | None, path: str) -> tuple[Step, DataFrame]:
    """The fitted step and df with its columns."""
    kind, at = spec["kind"], lambda name: f"{path}__{name}" if path else name
    step = Step(kind, path or "step", list(columns))
    if kind == "chain":
        for name, child in spec["steps"]:
            fitted, df = _fit_step(df, child, columns, target, at(name))
            step.inner.append(fitted)
            columns = fitted.made
        step.made = list(columns)
    elif kind in ("union", "columns"):
        parts = [(n, s, columns) for n, s in spec["steps"]] if kind == "union" else [(n, s, _chosen(df, columns, c)) for n, s, c in spec["parts"]]
        if kind == "columns":
            taken = [c for *_, cs in parts for c in cs]
            twice = sorted({c for c in taken if taken.count(c) > 1})
            if twice:
                raise ValueError(f"columns in more than one part: {', '.join(twice)}")
            rest = [c for c in columns if c not in taken]
            if spec.get("remainder", "drop") not in ("drop", "passthrough"):
                raise ValueError("remainder: drop or passthrough")
            if rest and spec.get("remainder") == "passthrough":
                parts.append(("rest", {"kind": "passthrough"}, rest))
        for name, child, chosen in parts:
            if child["kind"] != "drop" and chosen:
                fitted, df = _fit_step(df, child, chosen, target, at(name))
                step.inner.append(fitted)
                step.made += fitted.made
    else:
        step.options = {k: v for k, v in spec.items() if k != "kind"}
        step.stats = TRANSFORMERS[kind][0](df, step.columns, step.options, target)
        step.made = [f"{step.path}__{k}" for k in TRANSFORMERS[kind][1](step.columns, step.stats, step.options)]
        df = step.apply(df)
    return step, df


class SpecEstimator(Estimator):
    """A spec over features, with the target of its model if it has one."""

    def __init__(self, spec: dict, features: list[str], target: str | None = None):
        super().__init__()
        _check(spec)
        self.spec, self.features, self.target = spec, features, target

    def _fit(self, dataset: DataFrame) -> SpecModel:
        spec, model = self.spec, None
        if spec["kind"] in MODELS:
            spec, model = {"kind": "passthrough"}, spec
        elif spec["kind"] == "chain" and spec["steps"][-1][1]["kind"] in MODELS:
            model = spec["steps"][-1][1]
            spec = {"kind": "chain", "steps": spec["steps"][:-1] or [["all", {"kind": "passthrough"}]]}
        if model and self.target is None:
            raise ValueError("a model needs a target")
        step, df = _fit_step(dataset, spec, self.features, self.target, "")
        return SpecModel(self.features, self.target, step, _fit_model(df, model, step.made, self.target) if model else None)


def _fit_model(df: DataFrame, spec: dict, columns: list[str], target: str):
    kind, o = spec["kind"], {k: v for k, v in spec.items() if k != "kind"}
    if kind in GRAM:
        g = G.grams(df, columns, target)
        if not g:
            raise ValueError("no rows without gaps")
        return GRAM[kind](g[None], o)
    if kind == "gradient":
        return D.gradient_fit(df, columns, target, **o)
    name = kind.removesuffix("_classifier").removesuffix("_regressor")
    return L.classifier(df, columns, target, name, **o) if kind in CLASSIFIERS else L.regressor(df, columns, target, name, **o)


class SpecModel(MLModel):
    """A fitted spec. made: the columns of the last step before the model."""

    def __init__(self, features: list[str], target: str | None, step: Step, model=None):
        super().__init__()
        self.features, self.target, self.step, self.model = features, target, step, model

    @property
    def made(self) -> list[str]:
        return self.step.made

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """dataset with the made columns, or with prediction instead if there is a model."""
        df = self.step.apply(dataset)
        if self.model is None:
            return df.select(*dataset.columns, *self.made)
        out = self.model.transform(df)
        return out.select(*dataset.columns, *[c for c in ("probabilities", "decision") if c in out.columns and c not in dataset.columns], "prediction")

    def save(self, df: DataFrame, path: str) -> None:
        """Into a folder, through the session of df."""
        state = {"features": self.features, "target": self.target, "step": self.step.state(), "model": None}
        if isinstance(self.model, L.Model):
            self.model.save(f"{path}/model")
            state["model"] = {"of": "pipeline"}
        elif isinstance(self.model, D.GradientModel):
            state["model"] = {"of": "gradient", **self.model.__dict__}
        elif self.model is not None:
            state["model"] = {"of": "linear", "features": self.model.features, "coefficients": [float(x) for x in self.model.coefficients], "intercept": float(self.model.intercept)}
        df.sparkSession.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def load_spec_model(df: DataFrame, path: str) -> SpecModel:
    """A saved model; it gives what it gave."""
    state = json.loads(df.sparkSession.read.text(f"{path}/spec").first()[0])
    m = state["model"]
    if m and m["of"] == "pipeline":
        model = L.load(f"{path}/model")
    elif m and m["of"] == "gradient":
        model = D.GradientModel(**{k: [tuple(t) for t in v] if k == "trace" else v for k, v in m.items() if k != "of"})
    else:
        model = G.Linear(m["features"], np.array(m["coefficients"]), m["intercept"]) if m else None
    return SpecModel(state["features"], state["target"], Step.of(state["step"]), model)


# --- search -----------------------------------------------------------------------------------------------------------


def _score(df: DataFrame, target: str, metric: str) -> float | None:
    if metric in ("mse", "rmse", "mae", "r2", "explained_variance", "max_error", "medae"):
        row = M.regression_metrics(df, target, "prediction", medae=metric == "medae").select(metric).first()
    else:
        row = M.classification_metrics(df.withColumn(target, F.col(target).cast("string")), target, "prediction").select(metric).first()
    return None if row is None or row[0] is None or np.isnan(row[0]) else float(row[0])


def grid(space: dict[str, list], most: int = 100) -> list[dict]:
    """All combinations; refused above most."""
    n = int(np.prod([len(v) for v in space.values()], dtype=object))
    if n > most:
        raise ValueError(f"the grid has {n} candidates, more than {most}")
    return [dict(zip(space, v, strict=True)) for v in product(*space.values())]


@dataclass
class Search:
    """The winner, its model fitted on all training rows, and trials (rung, rows, candidate, options, fold scores, mean, std)."""

    options: dict
    model: SpecModel
    trials: list[dict]


def search(train: DataFrame, spec: dict, features: list[str], target: str, key: str, candidates: list[dict], metric: str, folds: int = 3, halving: int | None = None, group: str | None = None, time: str | None = None, seed: int = 0) -> Search:
    """Fits every candidate on every fold (rows dealt by shuffled rank), disqualifies candidates with a failed or undefined fold, and fits the best on all rows.

    halving (2 to 5): rungs of nested samples by one shuffled order, from at least max(10, 4 x folds x classes) rows to all of them; each
    rung keeps the best 1 / halving of the candidates, and the winner comes from the last rung, which sees all rows. Refused for groups
    and times, whose order a sample of rows does not keep, and above MOST_FITS fits before anything is fitted.
    """
    sign = {"max": 1.0, "min": -1.0}[direction(metric)]
    if not candidates:
        raise ValueError("no candidates")
    if halving is not None and not 2 <= halving <= 5:
        raise ValueError("halving must be 2 to 5")
    if halving and (group or time):
        raise ValueError("halving is not possible with groups or times")
    if group or time:
        raise ValueError("pass folds of groups or times to the splits module")
    rungs, alive = 1, len(candidates)
    while halving and alive > halving:
        alive, rungs = -(-alive // halving), rungs + 1
    counts = [len(candidates)]
    for _ in range(rungs - 1):
        counts.append(-(-counts[-1] // halving))
    if sum(counts) * folds + 1 > MOST_FITS:
        raise ValueError(f"{sum(counts) * folds + 1} fits, more than {MOST_FITS}")
    for c in candidates:
        _check(set_options(spec, c))
    rows = keep(shuffled_rank(train.where(F.col(target).isNotNull()), seed, key, name="_rank"))
    n = rows.count()
    classes = rows.select(target).distinct().count() if metric not in ("mse", "rmse", "mae", "r2", "explained_variance", "max_error", "medae") else 1
    least = max(10, 4 * folds * classes)
    left, trials = list(enumerate(candidates)), []
    for rung in range(rungs):
        size = n if rung == rungs - 1 else min(n, max(least, n // halving ** (rungs - 1 - rung)))
        part, scored = rows.where(F.col("_rank") <= size).withColumn("_fold", F.col("_rank") % folds), []
        for i, options in left:
            scores: list[float | None] = []
            for fold in range(folds):
                try:
                    model = SpecEstimator(set_options(spec, options), features, target).fit(part.where(F.col("_fold") != fold))
                    scores.append(_score(model.transform(part.where(F.col("_fold") == fold)), target, metric))
                except (ValueError, np.linalg.LinAlgError):
                    scores.append(None)
            valid = None not in scores
            trials.append({"rung": rung, "rows": size, "candidate": i, "options": options, "scores": scores, "mean": float(np.mean(scores)) if valid else None, "std": float(np.std(scores)) if valid else None})
            if valid:
                scored.append((-sign * trials[-1]["mean"], i, options))
        if not scored:
            raise ValueError("no candidate has a score in every fold")
        left = [(i, o) for _, i, o in sorted(scored, key=lambda s: s[:2])][: counts[rung + 1] if rung + 1 < rungs else 1]
    winner = left[0][1]
    return Search(winner, SpecEstimator(set_options(spec, winner), features, target).fit(train), trials)
