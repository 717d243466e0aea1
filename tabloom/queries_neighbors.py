"""Registered queries of neighbours, clusters, resampling, gradient fits and isolation forests; registered by tabloom.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import anomaly as A
from .operators import gradient as D
from .operators import neighbors as N
from .operators import resample as R
from .queries import _r, query

#: embeddings in double precision, with two classes of unequal size.
_E = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label < 3 THEN 'few' ELSE 'many' END AS cls, CAST(label AS DOUBLE) AS y FROM embeddings)"


def _near(k: int, queries: str = "true", rows: str = "true") -> str:
    """The k nearest rows of each row of embeddings, by all distances."""
    return f"""(SELECT * FROM (SELECT q.vec_id AS query, x.vec_id AS key, q.cls AS own, x.cls AS cls, x.y AS y, list_distance(q.v, x.v) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, x.v), x.vec_id) AS place
  FROM {_E} q JOIN {_E} x ON q.vec_id <> x.vec_id WHERE ({queries}) AND ({rows})) WHERE place <= {k})"""


def vectors(t) -> DataFrame:
    return t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.when(F.col("label") < 3, "few").otherwise("many").alias("cls"), F.col("label").cast("double").alias("y"))


def parts(t) -> DataFrame:
    """part with two features of like scale; every seventh size is unknown in gap."""
    return t("part").select("p_partkey", (F.col("p_size") / 5.0).alias("a"), (F.col("p_retailprice") / 100).alias("b"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") / 5.0).alias("gap"), "p_brand")


_P = "(SELECT p_partkey, p_size / 5.0 AS a, p_retailprice / 100 AS b, CASE WHEN p_partkey % 7 <> 0 THEN p_size / 5.0 END AS gap, p_brand FROM part)"


@query(f"SELECT query, key, {_r('distance', 'distance')}, place FROM {_near(5)}")
def j6_nearest(t):
    return N.nearest(vectors(t), vectors(t), "vec_id", "v", 5)


@query(f"SELECT x.p_partkey AS a, y.p_partkey AS b, {_r('sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)', 'distance')} FROM {_P} x JOIN {_P} y ON x.p_partkey < y.p_partkey AND sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) <= 0.25", places=None)
def j7_within_radius(t):
    return N.pairs_within(parts(t), "p_partkey", ["a", "b"], 0.25, 6)


@query(f"SELECT query AS vec_id, {_r('avg(y)', 'prediction')} FROM {_near(5)} GROUP BY 1")
def a9_knn_regressor(t):
    return N.knn_predict(vectors(t), vectors(t), "vec_id", "v", "y", 5)


@query(f"WITH v AS (SELECT query, cls, count(*) AS n FROM {_near(5)} GROUP BY 1, 2) SELECT query AS vec_id, first(cls ORDER BY n DESC, cls) AS prediction FROM v GROUP BY 1")
def a9_knn_classifier(t):
    return N.knn_predict(vectors(t), vectors(t), "vec_id", "v", "cls", 5, classify=True)


@query(f"""WITH q AS (SELECT * FROM {_P} WHERE p_partkey % 5 = 0), x AS (SELECT * FROM {_P} WHERE p_partkey % 5 <> 0)
SELECT q.p_partkey, {_r('avg(x.b)', 'prediction', 4)} FROM q LEFT JOIN x ON sqrt((x.a - q.a) ** 2 + (x.b - q.b) ** 2) <= 0.25 GROUP BY 1""", places=4)
def a9_radius_regressor(t):
    return N.radius_predict(parts(t).where("p_partkey % 5 <> 0"), parts(t).where("p_partkey % 5 = 0"), "p_partkey", ["a", "b"], "b", 0.25)


@query(f"""WITH n AS {_near(10)}, k AS (SELECT query, max(distance) AS far FROM n GROUP BY 1), d AS (SELECT n.query, 1 / (avg(greatest(n.distance, k.far)) + 1e-10) AS lrd FROM n JOIN k ON k.query = n.key GROUP BY 1)
SELECT n.query AS vec_id, {_r('avg(e.lrd) / any_value(d.lrd)', 'lof')} FROM n JOIN d ON d.query = n.query JOIN d AS e ON e.query = n.key GROUP BY 1""")
def n2_local_outlier_factor(t):
    return N.local_outlier_factor(vectors(t), "vec_id", "v", 10)


@query(f"""WITH x AS {_P}, n AS (SELECT * FROM (SELECT q.p_partkey, x.gap, row_number() OVER (PARTITION BY q.p_partkey ORDER BY sqrt((x.b - q.b) ** 2 * 2), x.p_partkey) AS place
  FROM x q JOIN x ON q.p_partkey <> x.p_partkey AND q.gap IS NULL AND x.gap IS NOT NULL) WHERE place <= 5)
SELECT x.p_partkey, {_r('coalesce(x.gap, (SELECT avg(n.gap) FROM n WHERE n.p_partkey = x.p_partkey))', 'gap')} FROM x""")
def f3c_knn_impute(t):
    return N.knn_impute(parts(t), parts(t), "p_partkey", ["gap", "b"], 5).select("p_partkey", "gap")


@query(f"WITH n AS {_near(1)} SELECT p.query AS a, p.key AS b FROM n p JOIN n q ON p.key = q.query AND p.query = q.key WHERE p.query < p.key AND p.own <> p.cls")
def r8_tomek_links(t):
    return R.tomek_links(vectors(t), "cls", "vec_id", "v")


@query(f"SELECT vec_id, cls FROM {_E} WHERE vec_id NOT IN (SELECT query FROM {_near(3)} WHERE own = 'many' AND cls <> own)")
def r9_edited_neighbours(t):
    return R.enn(vectors(t), "cls", "vec_id", "v").select("vec_id", "cls")


@query(f"""WITH f AS (SELECT query, avg(distance) AS far FROM {_near(3, "q.cls = 'many'", "x.cls = 'few'")} GROUP BY 1)
SELECT vec_id, cls FROM {_E} WHERE cls = 'few' UNION ALL (SELECT query, 'many' FROM f ORDER BY far, query LIMIT (SELECT count(*) FROM embeddings WHERE label < 3))""")
def r10_near_miss(t):
    return R.near_miss(vectors(t), "cls", "vec_id", "v").select("vec_id", "cls")


@query(f"SELECT cls, synthetic, n FROM (SELECT cls, false AS synthetic, count(*) AS n FROM {_E} GROUP BY 1 UNION ALL SELECT 'few', true, (SELECT count(*) FROM embeddings WHERE label >= 3) - (SELECT count(*) FROM embeddings WHERE label < 3))")
def r3_smote_counts(t):
    """Rows by class and kind; the tests hold each synthetic row against the segments between neighbours."""
    e = vectors(t).select("vec_id", "cls", *[F.get("v", F.lit(i)).alias(f"x{i}") for i in range(8)])
    return R.smote(e, "cls", "vec_id", [f"x{i}" for i in range(8)]).groupBy("cls", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE p AS {_P}, e AS (SELECT x.p_partkey AS i, y.p_partkey AS j, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) AS d FROM p x JOIN p y ON sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) <= 0.2),
c AS (SELECT i FROM e GROUP BY 1 HAVING count(*) >= 4), g AS (SELECT i, j FROM e WHERE i IN (FROM c) AND j IN (FROM c)),
r AS (SELECT i, i AS m FROM c UNION SELECT g.j, r.m FROM r JOIN g ON g.i = r.i WHERE r.m < g.j OR r.m = g.i), l AS (SELECT i, min(m) AS cluster FROM r GROUP BY 1),
b AS (SELECT e.i, first(l.cluster ORDER BY e.d, e.j) AS cluster FROM e JOIN l ON l.i = e.j WHERE e.i NOT IN (FROM c) GROUP BY 1)
SELECT p.p_partkey, p.p_partkey IN (FROM c) AS core, coalesce(l.cluster, b.cluster) AS cluster FROM p LEFT JOIN l ON l.i = p.p_partkey LEFT JOIN b ON b.i = p.p_partkey""")
def c3_dbscan(t):
    return N.dbscan(parts(t), "p_partkey", ["a", "b"], 0.2, 4)


@query()
def n1_isolation_forest(t):
    """Every part with its score and flag."""
    p = parts(t)
    return A.isolation_forest(p, "p_partkey", ["a", "b"], contamination=0.05).transform(p).select("p_partkey", "anomaly_score", "anomaly")


def _items(t) -> DataFrame:
    x = t("lineitem")
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 10).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_returnflag").alias("flag"))


@query(f"""WITH x AS (SELECT l_quantity / 50 AS q, l_extendedprice / 1000 AS y FROM lineitem), m AS (SELECT avg(q) AS mq, avg(y) AS my, var_pop(q) AS v, covar_pop(q, y) AS c FROM x)
SELECT {_r('c / (v + 0.01)', 'slope', 4)}, {_r('my - mq * c / (v + 0.01)', 'intercept', 4)} FROM m""", places=4)
def a8_gradient_ridge(t):
    """Squared loss: the gradient steps end where the normal equations do."""
    m = D.gradient_fit(_items(t), ["q"], "y", alpha=0.01, epochs=30)
    return t("lineitem").sparkSession.createDataFrame([(m.coefficients[0][0], m.intercepts[0])], "slope double, intercept double")


@query()
def a22_sgd_classifier(t):
    """Predictions of every item from mini-batches of the logistic loss."""
    m = D.sgd_classifier(_items(t), ["q", "d", "x"], "flag", "log", batches=4, key="key", epochs=4)
    return m.transform(_items(t)).select("key", "flag", "prediction")


@query()
def l10_quantile_regression(t):
    m = D.quantile_regression(_items(t), ["q", "d"], "y", 0.9, epochs=30)
    return m.transform(_items(t)).select("key", "y", "prediction")
