"""Registered queries of decompositions, imputation, regression resampling, ranking and models from moments; registered by tabloom.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import factors as D
from .operators import impute as I
from .operators import metrics as M
from .operators import models as K
from .operators import profile as E
from .operators import ranking as Q
from .operators import relevance as R
from .plans import gram as G
from .plans import penalised as P
from .plans import robust as B
from .queries import _r, query
from .queries_neighbors import _P, _items, parts


def _numbers(t) -> DataFrame:
    """lineitem with four numbers of like scale; every fifth discount and every seventh price is unknown in d and y."""
    x = _items(t)
    return x.withColumn("d", F.when(F.col("key") % 5 != 0, F.col("d"))).withColumn("y", F.when(F.col("key") % 7 != 0, F.col("y")))


def _events(t) -> DataFrame:
    x = t("events").select("event_id", F.col("value").alias("y"), F.hour("ts").cast("double").alias("hour"), (F.col("user_id") % 10).cast("double").alias("u"))
    return x


@query()
def d6_nmf(t):
    """Two nonnegative factors of every item."""
    x = _items(t)
    return D.nmf(x, ["q", "d", "x", "y"], 2, steps=20).transform(x).select("key", "factor0", "factor1")


@query(places=4)
def d5_fast_ica(t):
    x = _items(t)
    return D.fast_ica(x, ["q", "d", "x"], seed=1).transform(x).select("key", "factor0", "factor1", "factor2")


@query(places=4)
def d3_factor_analysis(t):
    x = _items(t)
    return D.factor_analysis(x, ["q", "d", "x", "y"], 1).transform(x).select("key", "factor0")


@query(places=4)
def f3d_iterative_impute(t):
    """Every item with its gaps filled."""
    x = _numbers(t)
    return I.iterative_impute(x, ["q", "d", "x", "y"], rounds=3).transform(x).select("key", "q", "d", "x", "y")


_STRETCH = """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events),
w AS (SELECT any_value(m) AS m, max(value) FILTER (value <= b + 1.5 * (b - a)) AS whisker FROM events, q), s AS (SELECT event_id, value, CASE WHEN value >= (m + whisker) / 2 THEN 1 ELSE 0 END AS stretch FROM events, w),
n AS (SELECT stretch, count(*) AS n, (SELECT count(*) FROM events) // 2 AS goal FROM s GROUP BY 1)"""


@query(f"{_STRETCH} SELECT stretch, CASE WHEN stretch = 1 THEN greatest(n, goal) ELSE n END AS n FROM n")
def r12_regression_over(t):
    """The relevance is one half midway between the median and the upper whisker; the side without outliers is usual."""
    return R.resample_regression(_events(t), "y", "event_id", ["hour", "u"], "over").groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_STRETCH} SELECT event_id, stretch FROM (SELECT *, row_number() OVER (PARTITION BY stretch ORDER BY md5('0|' || event_id), event_id) AS r FROM s JOIN n USING (stretch)) WHERE r <= greatest(goal, CASE WHEN n < goal THEN n ELSE 0 END)")
def r12_regression_under(t):
    return R.resample_regression(_events(t), "y", "event_id", ["hour", "u"], "under").select("event_id", "stretch")


@query(f"{_STRETCH} SELECT stretch, synthetic, CASE WHEN synthetic THEN goal - n ELSE least(n, goal) END AS n FROM n, (VALUES (false), (true)) v(synthetic) WHERE NOT synthetic OR goal > n")
def r13_smoter_counts(t):
    """Rows by stretch and kind; the tests hold each synthetic row against the segments between neighbours."""
    return R.resample_regression(_events(t), "y", "event_id", ["hour", "u"], "smoter").groupBy("stretch", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_STRETCH} SELECT stretch, synthetic, CASE WHEN synthetic THEN goal - n ELSE least(n, goal) END AS n FROM n, (VALUES (false), (true)) v(synthetic) WHERE NOT synthetic OR goal > n")
def r14_smogn_counts(t):
    return R.resample_regression(_events(t), "y", "event_id", ["hour", "u"], "smogn").groupBy("stretch", "synthetic").agg(F.count(F.lit(1)).alias("n"))


def _lines(t) -> DataFrame:
    x = t("lineitem")
    return x.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), F.floor(F.col("l_extendedprice") / 30000).cast("int").alias("grade"))


@query(f"""WITH x AS (SELECT l_orderkey AS query, l_linenumber AS k, CAST(floor(l_extendedprice / 30000) AS INTEGER) AS g FROM lineitem), p AS (SELECT a.query, a.k AS better, b.k AS worse FROM x a JOIN x b ON a.query = b.query AND a.g > b.g)
SELECT query, better, worse, {_r('1.0 / count(*) OVER (PARTITION BY query)', 'weight')} FROM p""")
def j8_query_pairs(t):
    """Lines of an order of which one has a higher grade of price."""
    return Q.query_pairs(_lines(t), "l_orderkey", "grade", "l_linenumber", [])


@query(places=4)
def a24_pairwise_ranker(t):
    x = _lines(t)
    return Q.pairwise_ranker(x, ["q", "d"], "grade", "l_orderkey", "l_linenumber").transform(x).select("l_orderkey", "l_linenumber", "score")


@query(f"""WITH x AS (SELECT l_quantity / 50 AS a, l_tax * 10 AS b, l_extendedprice / 1000 AS y FROM lineitem), s AS (SELECT stddev_samp(a) AS sa, stddev_samp(b) AS sb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_samp(a, y) / stddev_samp(a) AS ca, covar_samp(b, y) / stddev_samp(b) AS cb, corr(a, b) AS r FROM x),
k AS (SELECT *, (ca * ca + cb * cb) / (ca * ca + cb * cb + 2 * r * ca * cb) AS q FROM s)
SELECT {_r('ca * q / sa', 'a', 4)}, {_r('cb * q / sb', 'b', 4)}, {_r('my - ma * ca * q / sa - mb * cb * q / sb', 'intercept', 4)} FROM k""", places=4)
def l22_pls(t):
    """One component of two features, in closed form."""
    g = G.grams(_items(t), ["q", "x"], "y")[None]
    m = P.pls(g, 1)
    return t("lineitem").sparkSession.createDataFrame([(float(m.coefficients[0]), float(m.coefficients[1]), float(m.intercept))], "a double, b double, intercept double")


@query(f"""WITH x AS (SELECT l_quantity / 50 AS q, l_extendedprice / 1000 AS y FROM lineitem), m AS (SELECT avg(q) AS mq, avg(y) AS my, var_pop(q) AS v, covar_pop(q, y) AS c FROM x)
SELECT model, {_r('w', 'weight', 4)}, {_r('my - mq * w', 'intercept', 4)} FROM (SELECT *, unnest(['fused_lasso', 'group_lasso', 'lasso_lars', 'scad']) AS model, CASE WHEN model = 'scad' THEN c / v ELSE sign(c) * greatest(abs(c) - 0.01, 0) / v END AS w FROM m)""", places=4)
def l14_penalised_models(t):
    """One feature: groups, fused weights and the path agree with the soft threshold; beyond gamma alpha SCAD does not shrink. More features: the tests."""
    g = G.grams(_items(t), ["q"], "y")[None]
    models = {"fused_lasso": P.fused_lasso(g, 0.01, 0.5), "group_lasso": P.group_lasso(g, 0.01), "lasso_lars": P.lasso_lars(g, 0.01), "scad": P.scad(g, 0.001)}
    return t("lineitem").sparkSession.createDataFrame([(n, float(m.coefficients[0]), float(m.intercept)) for n, m in models.items()], "model string, weight double, intercept double")


@query(places=4)
def l20_ransac(t):
    """Every item with whether it agrees with the consensus."""
    return B.ransac(_items(t), ["q", "d"], "y", "key", trials=50)[1].select("key", "inlier")


@query(places=3)
def l21_theil_sen(t):
    x = _items(t)
    return B.theil_sen(x, ["q", "d"], "y", "key", subsets=300).transform(x).select("key", "prediction")


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS a, l_tax * 10 AS b, l_returnflag AS k FROM lineitem), s AS (SELECT k, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM x GROUP BY 1),
d AS (SELECT *, va * vb - c * c AS det, ln(n / (SELECT count(*) FROM x)) AS prior FROM s),
r AS (SELECT x.l_orderkey, x.l_linenumber, x.a, x.b, d.k, d.prior - 0.5 * ln(det) - ((x.a - ma) ** 2 * vb - 2 * (x.a - ma) * (x.b - mb) * c + (x.b - mb) ** 2 * va) / (2 * det) AS score FROM x, d)
SELECT prediction, count(*) AS n FROM (SELECT first(k ORDER BY score DESC, k) AS prediction FROM r GROUP BY l_orderkey, l_linenumber, a, b) GROUP BY 1""")
def l24_quadratic_discriminant(t):
    """How often each flag is predicted for distinct lines."""
    x = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("a"), (F.col("l_tax") * 10).alias("b"), "l_returnflag")
    out = K.quadratic_discriminant(x, ["a", "b"], "l_returnflag").transform(x)
    return out.select("l_orderkey", "l_linenumber", "a", "b", "prediction").distinct().groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS (SELECT * FROM {_P} ORDER BY md5('0|' || p_partkey), p_partkey LIMIT 2000), d AS (SELECT x.p_partkey AS i, x.p_brand AS own, y.p_brand AS other, sum(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) AS total, count(*) AS n FROM s x JOIN s y ON true GROUP BY 1, 2, 3),
v AS (SELECT i, any_value(n) FILTER (own = other) AS size, sum(total / greatest(n - 1, 1)) FILTER (own = other) AS a, min(total / n) FILTER (own <> other) AS b FROM d GROUP BY 1)
SELECT {_r('avg(CASE WHEN size > 1 THEN (b - a) / greatest(a, b) ELSE 0 END)', 'silhouette')}, count(*) AS n, (SELECT count(DISTINCT p_brand) FROM s) AS clusters FROM v""")
def m18_silhouette(t):
    """Of brands; at most 2,000 rows are asked, which is the measure's own limit."""
    return M.silhouette(parts(t), ["a", "b"], "p_brand", "p_partkey")


@query()
def m19_adjusted_mutual_information(t):
    return M.adjusted_mutual_information(t("lineitem"), "l_returnflag", "l_linestatus")


@query(places=4)
def e6_qq(t):
    return E.qq(t("events"), "value")
