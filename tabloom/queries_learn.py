"""Registered queries of checks, estimators, clusterings and their measures; registered by tabloom.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import checks as H
from .operators import learn as L
from .operators import metrics as M
from .operators import profile as E
from .operators import splits as V
from .operators import temporal as T
from .queries import BIN, _r, query
from .sources import tables as S

#: Fixed class probabilities of l_returnflag.
PROBS = "(SELECT l_returnflag AS y, l_quantity / 100 AS pa, (50 - l_quantity) / 100 + 0.25 AS pn, CAST(0.25 AS DOUBLE) + l_discount * 0 AS pr FROM lineitem)"
#: Four features of lineitem without nulls.
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def probs(t) -> DataFrame:
    return t("lineitem").select(F.col("l_returnflag").alias("y"), (F.col("l_quantity") / 100).alias("pa"), ((50 - F.col("l_quantity")) / 100 + 0.25).alias("pn"), (F.lit(0.25) + F.col("l_discount") * 0).alias("pr"))


def binary(t) -> DataFrame:
    return t("lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), ((F.col("l_quantity") + F.col("l_linenumber")) / 60.0 >= 0.5).cast("int").alias("p"))


def items(t) -> DataFrame:
    """lineitem with a key; features on comparable scales and a three-class label with signal."""
    x = t("lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return x.select("key", (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 10).alias("x"), "l_extendedprice", F.when(F.col("l_quantity") + 100 * F.col("l_discount") > 40, "high").when(F.col("l_tax") > 0.04, "taxed").otherwise("low").alias("cls"))


@query(f"SELECT l_returnflag, count(*) AS n, {_r('(SELECT count(*) FROM lineitem) * 1.0 / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*))', 'weight')} FROM lineitem GROUP BY 1")
def a25_balanced_weights(t):
    return H.balanced_weights(t("lineitem"), "l_returnflag")


@query(f"""WITH x AS {BIN}, c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.5) * 1.0 tp, count(*) FILTER (label = 0 AND score >= 0.5) fp, count(*) FILTER (label = 1 AND score < 0.5) fn FROM x)
SELECT {_r('tp / (tp + fp)', 'precision_binary')}, {_r('tp / (tp + fn)', 'recall_binary')}, {_r('2 * tp / (2 * tp + fp + fn)', 'f1_binary')}, {_r('5 * tp / (5 * tp + 4 * fn + fp)', 'fbeta_binary')} FROM c""")
def m13_binary_averages(t):
    return M.binary_averages(binary(t), "label", "p", 1, beta=2.0)


@query(f"SELECT {_r('avg(-ln(CASE y WHEN chr(65) THEN pa WHEN chr(78) THEN pn ELSE pr END))', 'log_loss')} FROM {PROBS}")
def m15_multiclass_log_loss(t):
    return M.multiclass_log_loss(probs(t), "y", {"A": "pa", "N": "pn", "R": "pr"})


def _auc_sql(where: str, positive: str, score: str) -> str:
    """Mann-Whitney by average ranks."""
    return f"""(SELECT (sum(rk) FILTER (y = '{positive}') - count(*) FILTER (y = '{positive}') * (count(*) FILTER (y = '{positive}') + 1.0) / 2) / (count(*) FILTER (y = '{positive}') * 1.0 * count(*) FILTER (y <> '{positive}'))
  FROM (SELECT y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk FROM p WHERE {where}))"""


_OVR = {"A": _auc_sql("true", "A", "pa"), "N": _auc_sql("true", "N", "pn"), "R": _auc_sql("true", "R", "pr")}
_OVO = [_auc_sql(f"y IN ('{a}', '{b}')", a, s) for a, s in (("A", "pa"), ("N", "pn"), ("R", "pr")) for b in "ANR" if a != b]
_SIZE = {c: f"(SELECT count(*) * 1.0 FROM p WHERE y = '{c}')" for c in "ANR"}


@query(f"""WITH p AS {PROBS} SELECT {_r('(' + ' + '.join(_OVR.values()) + ') / 3', 'roc_auc')},
{_r('(' + ' + '.join(f'{_OVR[c]} * {_SIZE[c]}' for c in 'ANR') + ') / (SELECT count(*) FROM p)', 'roc_auc_weighted')}, {_r('(' + ' + '.join(_OVO) + ') / 6', 'roc_auc_ovo')}""")
def m16_multiclass_auc(t):
    return M.multiclass_auc(probs(t), "y", {"A": "pa", "N": "pn", "R": "pr"})


@query(f"""WITH c AS (SELECT l_returnflag r, l_linestatus l, count(*) * 1.0 n FROM lineitem GROUP BY 1, 2), a AS (SELECT r, sum(n) a FROM c GROUP BY 1), b AS (SELECT l, sum(n) b FROM c GROUP BY 1), t AS (SELECT sum(n) t FROM c),
h AS (SELECT (SELECT sum(-a / t * ln(a / t)) FROM a, t) hr, (SELECT sum(-b / t * ln(b / t)) FROM b, t) hl, (SELECT sum(n / t * ln(n * t / (a * b))) FROM c JOIN a USING (r) JOIN b USING (l), t) mi,
(SELECT sum(n * (n - 1) / 2) FROM c) pp, (SELECT sum(a * (a - 1) / 2) FROM a) pr, (SELECT sum(b * (b - 1) / 2) FROM b) pl)
SELECT {_r('mi / hr', 'homogeneity')}, {_r('mi / hl', 'completeness')}, {_r('2 * (mi / hr) * (mi / hl) / (mi / hr + mi / hl)', 'v_measure')}, {_r('mi / ((hr + hl) / 2)', 'normalized_mutual_info')}, {_r('pp / sqrt(pr * pl)', 'fowlkes_mallows')} FROM h""")
def m19_cluster_information(t):
    return M.cluster_information(t("lineitem"), "l_returnflag", "l_linestatus")


@query(f"""WITH x AS (SELECT l_returnflag g, l_quantity / 50 a, l_discount * 10 b FROM lineitem), c AS (SELECT g, avg(a) ca, avg(b) cb FROM x GROUP BY 1),
s AS (SELECT g, ca, cb, avg(sqrt((a - ca) ** 2 + (b - cb) ** 2)) s FROM x JOIN c USING (g) GROUP BY 1, 2, 3), w AS (SELECT x.g, max((x.s + y.s) / sqrt((x.ca - y.ca) ** 2 + (x.cb - y.cb) ** 2)) w FROM s x JOIN s y ON x.g <> y.g GROUP BY 1)
SELECT {_r('avg(w)', 'davies_bouldin', 3)} FROM w""", places=3)
def m18_davies_bouldin(t):
    return M.davies_bouldin(t("lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b")), ["a", "b"], "g")


@query(f"SELECT {_r('avg(CASE WHEN value > 90 THEN 1.0 ELSE 0.0 END)', 'anomaly_fraction')} FROM events")
def m21_anomaly_fraction(t):
    return M.anomaly_fraction(t("events").withColumn("anomaly", F.when(F.col("value") > 90, -1).otherwise(1)))


@query("SELECT l_linenumber AS prediction, count(*) AS n FROM lineitem GROUP BY 1")
def c5_cluster_sizes(t):
    return L.cluster_sizes(t("lineitem").withColumnRenamed("l_linenumber", "prediction"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate, o_orderdate + INTERVAL 30 DAY AS later FROM orders), u AS (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) r, count(*) OVER () n FROM (SELECT DISTINCT o_orderdate FROM orders)),
c AS (SELECT min(o_orderdate) FILTER (r > floor(n * 0.6 + 1e-9)) v, min(o_orderdate) FILTER (r > floor(n * 0.8 + 1e-9)) t FROM u),
s AS (SELECT o_orderkey, CASE WHEN o_orderdate < v AND later < v THEN 'train' WHEN o_orderdate >= v AND o_orderdate < t AND later < t THEN 'validation' WHEN o_orderdate >= t THEN 'test' END split FROM o, c)
SELECT o_orderkey, split FROM s WHERE split IS NOT NULL""")
def v5_chronological_holdout(t):
    o = t("orders").select("o_orderkey", "o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("later"))
    return V.chronological_holdout(o, "o_orderdate", "later").select("o_orderkey", "split")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS fold FROM nation")
def v12_leave_one_out(t):
    return V.leave_one_out(t("nation").select("n_nationkey"), "n_nationkey")


@query()
def v10_group_kfold(t):
    """Rows and groups of each fold of whole nations."""
    return V.group_kfold(t("customer"), "c_nationkey").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("groups"))


@query("""SELECT count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) AS bad_target, count(*) FILTER (value <= 0) AS bad_domain, count(*) FILTER (user_id % 7 - 1 < 0) AS bad_weight,
(count(*) FILTER (user_id % 7 - 1 > 0) = 0)::BIGINT AS no_weight, count(*) FILTER (event_type IS NULL) AS null_group FROM events""")
def p4_target_problems(t):
    return H.target_problems(t("events").withColumn("w", F.col("user_id") % 7 - 1), "value", weight="w", group="event_type", model="gamma")


@query(f"""SELECT count(*) AS n_rows, 5 AS n_columns, {_r('sum(CASE WHEN c_custkey % 7 = 0 THEN 1.0 ELSE 0 END) / (count(*) * 5)', 'missing_share')}, count(DISTINCT CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END) AS target_unique,
{_r('min(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END)', 'target_min')}, {_r('avg(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END)', 'target_mean')}, {_r('max(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END)', 'target_max')} FROM customer""")
def e25_metadata(t):
    c = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"))
    return H.metadata(c, "bal")


@query(f"""WITH x AS (SELECT value v FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)), s AS (SELECT min(v) lo, max(v) hi, least(30, ceil(sqrt(count(*)))) k FROM x),
b AS (SELECT least(k - 1, floor((v - lo) / ((hi - lo) / k))) AS bin, count(*) n FROM x, s GROUP BY 1), e AS (SELECT unnest(range(30)) AS bin)
SELECT e.bin AS bin, {_r('lo + e.bin * ((hi - lo) / k)', 'low')}, {_r('lo + (e.bin + 1) * ((hi - lo) / k)', 'high')}, coalesce(n, 0) AS n FROM e LEFT JOIN b ON e.bin = b.bin, s WHERE e.bin < k""")
def e24_auto_histogram(t):
    return E.auto_histogram(t("events"), "value")


@query("""WITH x AS (SELECT ts AS t, value AS y, event_id AS k, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n FROM events),
p AS (SELECT floor(i * ((n - 1) / 199.0)) AS r FROM (SELECT count(*) n FROM events), (SELECT unnest(range(200)) AS i))
SELECT t, y, k FROM x WHERE n <= 200 OR r IN (SELECT r FROM p)""")
def e18_time_line(t):
    return E.time_line(t("events"), "ts", "value", "event_id", 200)


@query("SELECT p_size, p_type, p_retailprice FROM part")
def s13_resolve(t):
    return S.resolve(t("part"), "p_retailprice", ["p_size", "p_type"])


@query("SELECT o_orderkey, o_orderdate AS when_ FROM orders")
def t1_normalise_time(t):
    return T.normalise_time(t("orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("when_")), "when_").select("o_orderkey", F.col("when_").cast("timestamp").alias("when_"))


@query()
def a20_logistic_regression(t):
    """Share of right classes and mean log loss of three classes on held-out rows, balanced weights."""
    df = V.holdout(items(t), "key")
    m = L.classifier(df.where("split = 'train'"), ["q", "d", "x"], "cls", balanced=True)
    out = m.transform(df.where("split = 'test'"))
    p = {c: F.get("probabilities", F.lit(i)) for i, c in enumerate(m.classes)}
    out = out.withColumns({f"p_{c}": x for c, x in p.items()})
    return M.multiclass_log_loss(out, "cls", {c: f"p_{c}" for c in p}).crossJoin(out.agg(F.avg((F.col("prediction") == F.col("cls")).cast("int")).alias("accuracy")))


@query()
def a21_linear_svc(t):
    df = V.holdout(items(t).withColumn("big", F.when(F.col("cls") == "high", "yes").otherwise("no")), "key")
    out = L.classifier(df.where("split = 'train'"), ["q", "d", "x"], "big", "linear_svc").transform(df.where("split = 'test'"))
    return out.agg(F.avg((F.col("prediction") == F.col("big")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query()
def a23_mlp_classifier(t):
    df = V.holdout(items(t), "key")
    out = L.classifier(df.where("split = 'train'"), ["q", "d", "x"], "cls", "mlp").transform(df.where("split = 'test'"))
    return out.agg(F.avg((F.col("prediction") == F.col("cls")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query()
def l9_huber(t):
    m = L.regressor(items(t), ["q", "d", "x"], "l_extendedprice", "huber")
    return t("lineitem").sparkSession.createDataFrame(m.coefficients(), "feature string, cls string, value double").drop("cls")


@query()
def l11_poisson(t):
    m = L.regressor(items(t).withColumn("y", F.floor(F.col("l_extendedprice") / 10000)), ["q", "d", "x"], "y", "poisson", alpha=0.01)
    return t("lineitem").sparkSession.createDataFrame(m.coefficients(), "feature string, cls string, value double").drop("cls")


@query()
def c1_kmeans(t):
    df = items(t)
    return L.cluster_sizes(L.clusters(df, ["q", "d", "x"], 4).transform(df))


@query()
def c2_gaussian_mixture(t):
    df = items(t)
    return L.cluster_sizes(L.clusters(df, ["q", "d", "x"], 3, "gaussian_mixture").transform(df))


@query()
def n3_elliptic_envelope(t):
    df = items(t)
    return M.anomaly_fraction(L.elliptic_envelope(df, ["q", "d", "x"], 0.05)(df))


@query()
def d4_truncated_svd(t):
    df = items(t)
    singular, parts, _ = L.truncated_svd(df, ["q", "d", "x"], 2)
    return L.reconstruction_mse(df, ["q", "d", "x"], parts).withColumns({f"s{i}": F.lit(float(v)) for i, v in enumerate(singular)})


@query()
def d7_random_projection(t):
    """Mean ratio of squared lengths after and before."""
    out = L.random_projection(items(t), ["q", "d", "x"], 3)
    return out.agg(F.avg((F.col("p0") ** 2 + F.col("p1") ** 2 + F.col("p2") ** 2) / (F.col("q") ** 2 + F.col("d") ** 2 + F.col("x") ** 2)).alias("ratio"))


@query()
def x3_permutation_importance(t):
    df = V.holdout(items(t).withColumn("big", F.when(F.col("cls") == "high", "yes").otherwise("no")), "key")
    m = L.classifier(df.where("split = 'train'"), ["q", "d", "x"], "big")
    share = lambda d: d.agg(F.avg((F.col("prediction") == F.col("big")).cast("int"))).first()[0]
    found = L.permutation_importance(m, df.where("split = 'validation'"), "key", share, "accuracy", repeats=2)
    return df.sparkSession.createDataFrame(found, "feature string, mean double, std double")


@query()
def x4_prediction_view(t):
    df = items(t)
    return L.prediction_view(L.regressor(df, ["q", "d", "x"], "l_extendedprice", "huber"), df, ["q", "d"])
