"""The registered queries of the library and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions.stages import keep
from .operators import metrics as M
from .operators import models as K
from .operators import prepare as P
from .operators import profile as E
from .operators import splits as V
from .operators import temporal as T
from .plans import gram as G
from .sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, places: int | None = 6):
    """Registers a query under its function's name; floating results are rounded (places None: the function has done so), counts are long, as its SQL does."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
            df = f(t)
            kinds = dict(df.dtypes)
            # Adding 0.0 turns a rounded -0.0 into 0.0.
            return df.select(*[(F.round(c, places) + 0.0).alias(c) if kinds[c] in ("double", "float") and places is not None else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else F.col(c) for c in df.columns])

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return run

    return add


def _r(x: str, name: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0 AS {name}"


#: customer with every seventh balance unknown, in SQL and in Spark.
CUST = "(SELECT *, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)"
#: A fixed prediction of l_extendedprice.
PRED = "(SELECT *, l_extendedprice AS y, 1200 * l_quantity + 900 + l_discount * 1000 AS p FROM lineitem)"
#: A fixed binary score: late in the month, scaled to (0, 1).
BIN = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, (l_quantity + l_linenumber) / 60.0 AS score FROM lineitem)"


def customers(t) -> DataFrame:
    return t("customer").withColumn("bal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))


def stored_items(t) -> DataFrame:
    """lineitem with its key, which repeats, and the place of each row in the files."""
    return t("lineitem").withColumns({"key": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})


def predictions(t) -> DataFrame:
    return t("lineitem").withColumns({"y": F.col("l_extendedprice"), "p": 1200 * F.col("l_quantity") + 900 + F.col("l_discount") * 1000})


def scored(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"), ((F.col("l_quantity") + F.col("l_linenumber")) / 60.0).alias("score"))


# --- analyses ---------------------------------------------------------------------------------------------------------


@query(f"""SELECT (SELECT count(*) FROM {CUST}) AS n_rows, 6 AS n_columns, 4 AS n_numeric, 2 AS n_categorical,
 (SELECT count(*) - count(bal) FROM {CUST}) AS missing_cells, (SELECT count(*) FROM {CUST}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {CUST})) AS duplicate_rows""")
def e1_overview(t):
    return E.overview(customers(t))


@query(f"SELECT bin, count(y) AS count FROM range(30) r(bin) LEFT JOIN (SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29) AS b, 1 AS y FROM lineitem, (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem)) ON b = bin GROUP BY bin")
def e2_histogram(t):
    return E.histogram(t("lineitem"), "l_extendedprice", 30)


@query(f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.5) b, quantile_cont(l_extendedprice, 0.75) c FROM lineitem)
SELECT {_r('a', 'q25')}, {_r('b', 'q50')}, {_r('c', 'q75')}, {_r('min(l_extendedprice) FILTER (l_extendedprice BETWEEN a-1.5*(c-a) AND c+1.5*(c-a))', 'low')}, {_r('max(l_extendedprice) FILTER (l_extendedprice BETWEEN a-1.5*(c-a) AND c+1.5*(c-a))', 'high')}, count(*) FILTER (l_extendedprice NOT BETWEEN a-1.5*(c-a) AND c+1.5*(c-a)) AS n_out FROM lineitem, q GROUP BY a, b, c""")
def e3_box(t):
    return E.box(t("lineitem").select("l_extendedprice"), "l_extendedprice")


@query(f"""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.5) b, quantile_cont(l_extendedprice, 0.75) c FROM lineitem GROUP BY 1)
SELECT l_returnflag, {_r('a', 'q25')}, {_r('b', 'q50')}, {_r('c', 'q75')}, {_r('min(l_extendedprice) FILTER (l_extendedprice BETWEEN a-1.5*(c-a) AND c+1.5*(c-a))', 'low')}, {_r('max(l_extendedprice) FILTER (l_extendedprice BETWEEN a-1.5*(c-a) AND c+1.5*(c-a))', 'high')}, count(*) FILTER (l_extendedprice NOT BETWEEN a-1.5*(c-a) AND c+1.5*(c-a)) AS n_out FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag, a, b, c""")
def e16_group_box(t):
    return E.box(t("lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"])


@query(f"SELECT DISTINCT l_quantity::DOUBLE + 0.0 AS x, {_r('cume_dist() OVER (ORDER BY l_quantity)', 'y')} FROM lineitem")
def e5_ecdf(t):
    return E.ecdf(t("lineitem"), "l_quantity")


@query(f"""WITH s AS (SELECT count(bal) n, stddev_samp(bal) sd, min(bal) lo, max(bal) hi FROM {CUST}), g AS (SELECT i, lo + i * (hi - lo) / 49 AS g, sd * pow(n, -0.2) AS h FROM s, range(50) r(i))
SELECT i, {_r('g', 'g')}, {_r('avg(exp(-0.5 * ((g - bal) / h) ** 2)) / (h * sqrt(2 * pi()))', 'density', 9)} FROM g, {CUST} WHERE bal IS NOT NULL GROUP BY i, g, h""", places=9)
def e7_kde(t):
    return E.kde(customers(t), "bal", 50).withColumn("g", F.round("g", 6))


@query("""WITH s AS (SELECT min(l_quantity) x0, max(l_quantity) x1, min(l_extendedprice) y0, max(l_extendedprice) y1 FROM lineitem)
SELECT least(floor((l_quantity - x0) / (x1 - x0) * 10), 9)::BIGINT AS bx, least(floor((l_extendedprice - y0) / (y1 - y0) * 10), 9)::BIGINT AS "by", count(*) AS count FROM lineitem, s GROUP BY 1, 2""")
def e10_histogram2d(t):
    return E.histogram2d(t("lineitem"), "l_quantity", "l_extendedprice", 10)


@query(f"""SELECT 'c_custkey' AS a, 'bal' AS b, {_r('corr(c_custkey, bal)', 'r')}, count(bal) AS n FROM {CUST} UNION ALL SELECT 'c_custkey', 'c_nationkey', round(corr(c_custkey, c_nationkey), 6) + 0.0, count(*) FROM {CUST} UNION ALL SELECT 'bal', 'c_nationkey', round(corr(bal, c_nationkey), 6) + 0.0, count(bal) FROM {CUST}""")
def e11_correlation_pearson(t):
    return E.correlation(customers(t), ["c_custkey", "bal", "c_nationkey"])


@query(f"""WITH k AS (SELECT bal, c_nationkey AS n FROM {CUST} WHERE bal IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY bal) + (count(*) OVER (PARTITION BY bal) - 1) / 2.0 AS ra, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rb FROM k)
SELECT 'bal' AS a, 'c_nationkey' AS b, {_r('corr(ra, rb)', 'r')}, count(*) AS n FROM r""")
def e11_correlation_spearman(t):
    return E.correlation(customers(t), ["bal", "c_nationkey"], "spearman")


@query(f"SELECT * FROM (SELECT 'bal' AS \"column\", count(*) - count(bal) AS missing, {_r('(count(*) - count(bal)) / count(*)', 'fraction')} FROM {CUST} UNION ALL SELECT 'c_name', count(*) - count(c_name), round((count(*) - count(c_name)) / count(*), 6) + 0.0 FROM {CUST})")
def e12_missing_bar(t):
    return E.missing_bar(customers(t).select("bal", "c_name"))


@query("""WITH c AS (SELECT p_type AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) r FROM part GROUP BY 1)
SELECT value, n AS count FROM c WHERE r <= 5 UNION ALL SELECT '(other categories)', coalesce(sum(n), 0)::BIGINT FROM c WHERE r > 5 UNION ALL SELECT '(missing)', count(*) - count(p_type) FROM part""")
def e14_category_counts(t):
    return E.category_counts(t("part"), "p_type", 5)


@query("SELECT x, y, (SELECT count(*) FROM lineitem WHERE l_returnflag = x AND l_linestatus = y) AS count FROM (SELECT DISTINCT l_returnflag AS x FROM lineitem), (SELECT DISTINCT l_linestatus AS y FROM lineitem)")
def e15_crosstab(t):
    return E.crosstab(t("lineitem"), "l_returnflag", "l_linestatus")


@query(f"SELECT l_linestatus, {_r('avg(l_extendedprice)', 'mean')}, {_r('stddev_pop(l_extendedprice)', 'std')}, count(l_extendedprice) AS n FROM lineitem GROUP BY 1")
def e17_group_mean(t):
    return E.group_mean(t("lineitem"), "l_linestatus", "l_extendedprice")


@query(f"WITH d AS (SELECT date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, {_r('avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 'rolling_mean')} FROM d")
def e19_rolling_mean(t):
    return E.rolling_mean(t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")), "day", "n", 7)


@query(f"""WITH d AS (SELECT date_diff('day', DATE '2020-01-01', ts::DATE) AS i, count(*) AS n FROM events GROUP BY 1), c AS (SELECT i, n - avg(n) OVER () AS c FROM d)
SELECT lag, {_r('sum(a.c * b.c) / (SELECT sum(c * c) FROM c)', 'acf')} FROM c a, c b, range(11) r(lag) WHERE b.i = a.i - lag GROUP BY lag""")
def e20_autocorrelation(t):
    days = t("events").groupBy(F.date_diff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    return E.autocorrelation(days, "i", "n", 10)


@query(f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.75) c FROM lineitem) SELECT {_r('a - 1.5 * (c - a)', 'lower')}, {_r('c + 1.5 * (c - a)', 'upper')}, (SELECT count(*) FROM lineitem WHERE l_extendedprice NOT BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)) AS n_out FROM q""")
def e21_outliers(t):
    return E.outliers(t("lineitem").select("l_extendedprice"), "l_extendedprice")


@query(f"SELECT count(bal) AS n, count(*) - count(bal) AS missing, count(DISTINCT bal) AS n_unique, {_r('min(bal)', 'min')}, {_r('max(bal)', 'max')}, {_r('avg(bal)', 'mean')}, {_r('stddev_pop(bal)', 'std')}, " + ", ".join(_r(f"quantile_cont(bal, {q})", k) for q, k in ((0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95"))) + f" FROM {CUST}")
def e23_column_profile(t):
    return E.column_profile(customers(t), "bal")


@query("SELECT l_orderkey * 10 + l_linenumber AS key, l_quantity + 0.0 AS l_quantity, l_extendedprice + 0.0 AS l_extendedprice FROM lineitem ORDER BY md5(concat_ws('|', '3', (l_orderkey * 10 + l_linenumber)::VARCHAR)), 1 LIMIT 500")
def e8_scatter(t):
    return E.scatter(stored_items(t), "key", ["l_quantity", "l_extendedprice"], 500, 3, ["_file", "_row"])


@query("SELECT l_orderkey * 10 + l_linenumber AS key, l_quantity + 0.0 AS l_quantity, l_extendedprice + 0.0 AS l_extendedprice, l_tax + 0.0 AS l_tax FROM lineitem ORDER BY md5(concat_ws('|', '4', (l_orderkey * 10 + l_linenumber)::VARCHAR)), 1 LIMIT 500")
def e9_scatter3d(t):
    return E.scatter(stored_items(t), "key", ["l_quantity", "l_extendedprice", "l_tax"], 500, 4, ["_file", "_row"])


@query("SELECT c_custkey, (bal IS NULL)::BIGINT AS bal FROM (SELECT * FROM " + CUST + " ORDER BY md5(concat_ws('|', '0', c_custkey::VARCHAR)), c_custkey LIMIT 200)")
def e13_missing_matrix(t):
    return E.missing_matrix(customers(t), "c_custkey", ["bal"], 200)


# --- sources ----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 1 THEN 0.0 ELSE round(c_acctbal, 6) + 0.0 END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 2 UNION ALL SELECT c_custkey + 1000000000, c_name, round(c_acctbal, 6) + 0.0 FROM customer WHERE c_custkey % 10 = 3")
def s6_update_rows(t):
    c = t("customer").select("c_custkey", "c_name", "c_acctbal")
    changes = c.where("c_custkey % 10 = 1").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    return S.update_rows(c, "c_custkey", changes, c.where("c_custkey % 10 = 3").withColumn("c_custkey", F.col("c_custkey") + 1000000000), c.where("c_custkey % 10 = 2"))


@query("SELECT o_orderkey, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300")
def s7_viewport(t):
    return S.viewport(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 200)


@query("SELECT c_custkey FROM customer ORDER BY md5(concat_ws('|', '5', c_custkey::VARCHAR)), c_custkey LIMIT 100")
def s12_sample_limit(t):
    return S.sample_limit(t("customer"), "c_custkey", 100, 5).select("c_custkey")


@query("SELECT c_custkey, round(c_acctbal, 6) + 0.0 AS good, c_name AS text FROM customer")
def s5_coerce(t):
    c = t("customer")
    return S.coerce(c.select("c_custkey", F.replace(c.c_acctbal.cast("string"), F.lit("."), F.lit(",")).alias("good"), F.col("c_name").alias("text")))


@query(f"SELECT l_linenumber, {_r('avg(ln(1 + l_quantity))', 'a')}, {_r('avg(log2(l_quantity))', 'b')}, {_r('avg(l_tax * l_tax)', 'c')}, {_r('avg(sin(l_tax))', 'd')} FROM lineitem GROUP BY 1")
def p9_column_maps(t):
    return t("lineitem").groupBy("l_linenumber").agg(*[F.avg(C.apply_math(F.col(c), f)).alias(n) for c, f, n in (("l_quantity", "log1p", "a"), ("l_quantity", "log2", "b"), ("l_tax", "square", "c"), ("l_tax", "sin", "d"))])


# --- time -------------------------------------------------------------------------------------------------------------

_MONTHS = "(SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*)::DOUBLE AS y FROM orders GROUP BY 1)"


@query(f"""WITH x AS (SELECT m AS origin, lead(m, 1) OVER w AS target_time, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, avg(y) OVER f AS mean, stddev_samp(y) OVER f AS sd, min(y) OVER f AS lo, max(y) OVER f AS hi, count(y) OVER f AS c, lead(y, 1) OVER w AS label FROM {_MONTHS} WINDOW w AS (ORDER BY m), f AS (ORDER BY m ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT origin, target_time, l1 AS y__lag_1, l2 AS y__lag_2, {_r('mean', 'y__rolling_mean_3')}, {_r('sd', 'y__rolling_std_3')}, lo AS y__rolling_min_3, hi AS y__rolling_max_3, label FROM x WHERE l1 IS NOT NULL AND l2 IS NOT NULL AND c = 3 AND label IS NOT NULL""")
def t4_temporal_frame(t):
    m = t("orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return T.temporal_frame(m, "y", "m", None, [1, 2], [3], 2)


@query(f"""WITH d AS (SELECT event_type, ts::DATE AS day, sum(value) AS y FROM events GROUP BY 1, 2), x AS (SELECT event_type, day AS origin, day AS target_time, lag(y, 1) OVER w AS a, lag(y, 3) OVER w AS b, y AS label FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, origin, target_time, {_r('a', 'y__lag_1')}, {_r('b', 'y__lag_3')}, {_r('label', 'label')} FROM x WHERE a IS NOT NULL AND b IS NOT NULL""")
def t4_panel_frame(t):
    d = t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    return T.temporal_frame(d, "y", "day", "event_type", [1, 3])


@query("SELECT user_id, ts, count(*) AS count FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def t2_duplicate_times(t):
    return T.duplicates(t("events"), ["user_id", "ts"])


# --- splits -----------------------------------------------------------------------------------------------------------


def _cut(rank: str, n: str) -> str:
    a = f"floor({n} * 0.6 + 1e-9)"
    return f"CASE WHEN {rank} <= {a} THEN 'train' WHEN {rank} <= {a} + floor(({n} - {a}) * 0.5 + 1e-9) THEN 'validation' ELSE 'test' END"


def _h(key: str, seed: int = 0) -> str:
    return f"md5(concat_ws('|', '{seed}', {key}::VARCHAR)), {key}"


@query(f"SELECT o_orderkey, {_cut('r', 'n')} AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_h('o_orderkey')}) r, count(*) OVER () n FROM orders)")
def v1_holdout(t):
    return V.holdout(t("orders").select("o_orderkey"), "o_orderkey")


@query(f"SELECT o_orderkey, o_orderstatus, {_cut('r', 'n')} AS split FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_h('o_orderkey')}) r, count(*) OVER (PARTITION BY o_orderstatus) n FROM orders)")
def v2_stratified_holdout(t):
    return V.holdout(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", strata="o_orderstatus")


@query(f"SELECT o_orderkey, o_custkey, split FROM orders JOIN (SELECT o_custkey, {_cut('r', 'n')} AS split FROM (SELECT o_custkey, row_number() OVER (ORDER BY {_h('o_custkey')}) r, count(*) OVER () n FROM (SELECT DISTINCT o_custkey FROM orders))) USING (o_custkey)")
def v3_group_holdout(t):
    return V.group_holdout(t("orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query(f"SELECT o_orderkey, {_cut('r', 'n')} AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) r, count(*) OVER () n FROM orders)")
def v4_ordered_holdout(t):
    return V.ordered_holdout(t("orders").select("o_orderkey"), "o_orderkey")


@query(f"SELECT o_orderkey, (row_number() OVER (ORDER BY {_h('o_orderkey', 1)}) - 1) % 5 AS fold FROM orders")
def v6_kfold(t):
    return V.kfold(t("orders").select("o_orderkey"), "o_orderkey", 5, 1)


@query("SELECT o_orderkey, CASE WHEN i < e * (s + 1) THEN i // (s + 1) ELSE e + (i - e * (s + 1)) // s END AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () // 7 AS s, count(*) OVER () % 7 AS e FROM orders)")
def v6_contiguous_kfold(t):
    return V.contiguous_kfold(t("orders").select("o_orderkey"), "o_orderkey", 7)


@query(" UNION ALL ".join(f"SELECT o_orderkey, (row_number() OVER (ORDER BY {_h('o_orderkey', r)}) - 1) % 4 AS fold, {r} AS repeat FROM orders" for r in range(2)))
def v7_repeated_kfold(t):
    return V.repeated_kfold(t("orders").select("o_orderkey"), "o_orderkey", 4, 2)


@query(" UNION ALL ".join(f"SELECT {s} AS split_id, o_orderkey, CASE WHEN r <= ceil(n * 0.2 - 1e-9) THEN 'test' ELSE 'train' END AS role FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_h('o_orderkey', s)}) r, count(*) OVER () n FROM orders)" for s in range(3)))
def v8_shuffle_splits(t):
    return V.shuffle_splits(t("orders").select("o_orderkey"), "o_orderkey")


@query("""WITH u AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderdate AS d FROM orders)), x AS (SELECT o_orderkey, o_orderdate, i, n, s, n - (3 - s) * 100 AS start FROM orders JOIN u ON d = o_orderdate, range(3) r(s))
SELECT o_orderdate, o_orderkey, s AS split_id, CASE WHEN i >= start AND i < start + 100 THEN 'test' ELSE 'train' END AS role FROM x WHERE i < start - 5 OR (i >= start AND i < start + 100)""")
def v9_timeseries_splits(t):
    return V.timeseries_splits(t("orders").select("o_orderdate", "o_orderkey"), "o_orderdate", 3, 100, 5)


@query("SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS fold FROM customer")
def v11_leave_one_group_out(t):
    return V.leave_one_group_out(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query(f"""WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders), b AS (SELECT o_orderkey, (o_totalprice > q[1])::INT + (o_totalprice > q[2])::INT + (o_totalprice > q[3])::INT + (o_totalprice > q[4])::INT AS bin FROM orders, q)
SELECT o_orderkey, bin::BIGINT AS bin, (row_number() OVER (PARTITION BY bin ORDER BY {_h('o_orderkey')}) - 1) % 5 AS fold FROM b""")
def v13_stratified_bins(t):
    return V.stratified_bins(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "bin", "fold")


@query(f"SELECT o_orderkey, o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_h('o_orderkey')}) - 1) % 5 AS fold FROM orders")
def v14_stratified_kfold(t):
    return V.kfold(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 5, strata="o_orderstatus")


@query(f"SELECT o_orderstatus AS metric, {_r('avg(o_totalprice)', 'mean')}, {_r('stddev_pop(o_totalprice)', 'std')}, count(o_totalprice) AS valid_folds FROM orders GROUP BY 1", places=4)
def v16_fold_summary(t):
    return V.fold_summary(t("orders").select(F.col("o_orderstatus").alias("metric"), F.col("o_totalprice").alias("value")))


ORACLE["v16_fold_summary"] = f"SELECT o_orderstatus AS metric, {_r('avg(o_totalprice)', 'mean', 4)}, {_r('stddev_pop(o_totalprice)', 'std', 4)}, count(o_totalprice) AS valid_folds FROM orders GROUP BY 1"


# --- preparation ------------------------------------------------------------------------------------------------------


@query(f"SELECT c_custkey, {_r('coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM ' + CUST + '))', 'bal')}, (bal IS NULL)::BIGINT AS bal__missing FROM {CUST}")
def f3_impute_median(t):
    c = customers(t).select("c_custkey", "bal")
    return P.impute(c, ["bal"], "median", indicator=True).transform(c)


@query(f"SELECT c_custkey, {_r('(c_acctbal - a) / s', 'c_acctbal')} FROM customer, (SELECT avg(c_acctbal) a, stddev_pop(c_acctbal) s FROM customer)")
def f4_scale_standard(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    return P.scale(c, ["c_acctbal"]).transform(c)


@query(f"SELECT c_custkey, {_r('(c_acctbal - m) / (b - a)', 'c_acctbal')} FROM customer, (SELECT quantile_cont(c_acctbal, 0.5) m, quantile_cont(c_acctbal, 0.25) a, quantile_cont(c_acctbal, 0.75) b FROM customer)")
def f4_scale_robust(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    return P.scale(c, ["c_acctbal"], "robust").transform(c)


@query(f"SELECT c_custkey, {_r('sign(c_acctbal) * ln(1 + abs(c_acctbal))', 'v')} FROM customer")
def f5_signed_log(t):
    return t("customer").select("c_custkey", P.signed(F.col("c_acctbal"), "log1p").alias("v"))


@query(f"SELECT c_custkey, {_r('CASE WHEN bal IS NOT NULL THEN greatest(least(bal, b), a) END', 'bal')} FROM {CUST}, (SELECT quantile_cont(bal, 0.05) a, quantile_cont(bal, 0.95) b FROM {CUST})")
def f6_clip(t):
    c = customers(t).select("c_custkey", "bal")
    return P.clip(c, ["bal"]).transform(c)


@query(f'SELECT l_orderkey, l_linenumber, l_quantity, l_tax, {_r("l_quantity * l_quantity", chr(34) + "l_quantity*l_quantity" + chr(34))}, {_r("l_quantity * l_tax", chr(34) + "l_quantity*l_tax" + chr(34))}, {_r("l_tax * l_tax", chr(34) + "l_tax*l_tax" + chr(34))} FROM lineitem')
def f7_polynomial(t):
    return P.polynomial(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], 2)


@query("SELECT c_custkey, " + " + ".join(f"(c_acctbal >= lo + (hi - lo) * {i} / 4)::BIGINT" for i in (1, 2, 3)) + " AS c_acctbal__bin FROM customer, (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer)")
def f8_bins_uniform(t):
    return P.bins(t("customer"), "c_acctbal", 4, "uniform").transform(t("customer")).select("c_custkey", "c_acctbal__bin")


@query("SELECT o_orderkey, (o_orderstatus = 'F')::BIGINT AS \"o_orderstatus=F\", (o_orderstatus = 'O')::BIGINT AS \"o_orderstatus=O\", (o_orderstatus = 'P')::BIGINT AS \"o_orderstatus=P\" FROM orders")
def f10_onehot(t):
    o = t("orders").select("o_orderkey", "o_orderstatus")
    return P.onehot(o, "o_orderstatus").transform(o).drop("o_orderstatus")


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment__code FROM customer")
def f11_ordinal(t):
    c = t("customer").select("c_custkey", "c_mktsegment")
    return P.ordinal(c, "c_mktsegment").transform(c).select("c_custkey", "c_mktsegment__code")


@query(f"SELECT p_partkey, {_r('n / (SELECT count(*) FROM part)', 'p_brand__freq')} FROM part JOIN (SELECT p_brand, count(*) n FROM part GROUP BY 1) USING (p_brand)")
def f12_frequency(t):
    p = t("part").select("p_partkey", "p_brand")
    return P.frequency(p, "p_brand").transform(p).select("p_partkey", "p_brand__freq")


@query(f"""WITH x AS (SELECT o_orderkey, o_orderpriority, o_totalprice AS y, o_orderkey % 5 AS fold FROM orders), a AS (SELECT o_orderpriority, fold, sum(y) s, count(y) c FROM x GROUP BY 1, 2), b AS (SELECT o_orderpriority, sum(s) s2, sum(c) c2 FROM a GROUP BY 1), f AS (SELECT fold, sum(s) fs, sum(c) fc FROM a GROUP BY 1), g AS (SELECT sum(s) ts, sum(c) tc FROM a)
SELECT o_orderkey, {_r('(s2 - s + 10 * (ts - fs) / (tc - fc)) / (c2 - c + 10)', 'o_orderpriority__target', 4)} FROM x JOIN a USING (o_orderpriority, fold) JOIN b USING (o_orderpriority) JOIN f USING (fold), g""", places=4)
def f14_target_encoding(t):
    o = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice", (F.col("o_orderkey") % 5).alias("fold"))
    return P.target_encode(o, "o_orderpriority", "o_totalprice", "fold")[0].select("o_orderkey", "o_orderpriority__target")


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{{2,}}')) AS term FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS text FROM documents)), c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), v AS (SELECT term, count(*) AS df FROM c GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 200), r AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term))
SELECT doc_id, term, {_r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 'weight')} FROM r""")
def f15_tfidf(t):
    d = t("documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("text"))
    return P.tfidf(d, "doc_id", "text", 200)


@query()
def f15b_tfidf_whole_text(t):
    """Over the texts as they are; DuckDB's pattern in f15 knows ASCII words only."""
    return P.tfidf(t("documents").select("doc_id", "text"), "doc_id", "text", 200)


@query("SELECT o_orderkey, year(o_orderdate) AS o_orderdate__year, month(o_orderdate) AS o_orderdate__month, isodow(o_orderdate) - 1 AS o_orderdate__weekday, dayofyear(o_orderdate) AS o_orderdate__dayofyear, (isodow(o_orderdate) >= 6)::BIGINT AS o_orderdate__weekend FROM orders")
def f17_datetime_parts(t):
    return P.datetime_parts(t("orders"), "o_orderdate", ["year", "month", "weekday", "dayofyear", "weekend"]).select("o_orderkey", *[f"o_orderdate__{p}" for p in ("year", "month", "weekday", "dayofyear", "weekend")])


@query(f"SELECT 'l_quantity' AS feature, {_r('var_pop(l_quantity)', 'variance')} FROM lineitem UNION ALL SELECT 'l_tax', round(var_pop(l_tax), 6) + 0.0 FROM lineitem")
def f18_variance(t):
    return P.variances(t("lineitem"), ["l_quantity", "l_tax"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(f'pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2)', 'score', 3)} FROM lineitem" for c in ("l_quantity", "l_tax")), places=3)
def f19_f_regression(t):
    return P.f_regression(t("lineitem"), ["l_quantity", "l_tax"], "l_extendedprice")


def _anova(c: str) -> str:
    return f"SELECT '{c}' AS feature, {_r('(sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))', 'score', 4)} FROM (SELECT count(*) n, avg({c}) m, var_pop({c}) v FROM lineitem GROUP BY l_returnflag), (SELECT avg({c}) gm FROM lineitem)"


@query(_anova("l_quantity") + " UNION ALL " + _anova("l_discount"), places=4)
def f19_anova(t):
    return P.anova(t("lineitem"), ["l_quantity", "l_discount"], "l_returnflag")


@query(f"WITH g AS (SELECT l_returnflag, count(*) n, sum(l_quantity) o FROM lineitem GROUP BY 1), s AS (SELECT sum(n) nn, sum(o) oo FROM g) SELECT 'l_quantity' AS feature, {_r('sum(pow(o - oo * n / nn, 2) / (oo * n / nn))', 'score', 4)} FROM g, s", places=4)
def f19_chi2(t):
    return P.chi2(t("lineitem"), ["l_quantity"], "l_returnflag")


@query(f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id')}) r, count(*) OVER (PARTITION BY quality) n FROM labels), m AS (SELECT max(n) top FROM r)
SELECT doc_id, quality::BIGINT AS quality, c AS copy FROM r, m, range(1, 100000) x(c) WHERE c <= top // n + (r <= top % n)::INT""")
def r1_random_over(t):
    return P.random_over(t("labels").select("doc_id", "quality"), "quality", "doc_id")


@query(f"WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id')}) r, count(*) OVER (PARTITION BY quality) n FROM labels) SELECT doc_id, quality::BIGINT AS quality FROM r WHERE r <= (SELECT min(n) FROM r)")
def r2_random_under(t):
    return P.random_under(t("labels").select("doc_id", "quality"), "quality", "doc_id")


# --- metrics ----------------------------------------------------------------------------------------------------------

_E = "(y - p)"


@query(f"""SELECT l_returnflag, count(*) AS n, {_r(f'avg({_E} * {_E})', 'mse', 3)}, {_r(f'sqrt(avg({_E} * {_E}))', 'rmse', 3)}, {_r(f'avg(abs({_E}))', 'mae', 3)}, {_r(f'quantile_cont(abs({_E}), 0.5)', 'medae', 3)}, {_r(f'1 - avg({_E} * {_E}) / var_pop(y)', 'r2', 3)}, {_r(f'1 - var_pop({_E}) / var_pop(y)', 'explained_variance', 3)}, {_r(f'max(abs({_E}))', 'max_error', 3)}, {_r(f'avg(abs({_E} / y))', 'mape', 3)}, {_r(f'200 * avg(abs({_E}) / (abs(y) + abs(p)))', 'smape', 3)}, {_r('avg(pow(ln(1 + y) - ln(1 + p), 2))', 'msle', 3)}, {_r('sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2)))', 'rmsle', 3)}, {_r(f'avg(greatest(0.5 * {_E}, -0.5 * {_E}))', 'pinball', 3)}, {_r('avg(2 * (y * ln(y / p) - y + p))', 'poisson_deviance', 3)}, {_r('avg(2 * (ln(p / y) + y / p - 1))', 'gamma_deviance', 3)}, {_r('avg(2 * (pow(y, 0.5) / (-0.25) - y * pow(p, -0.5) / (-0.5) + pow(p, 0.5) / 0.5))', 'tweedie_deviance', 3)} FROM {PRED} GROUP BY 1""", places=3)
def m1_regression_metrics(t):
    return M.regression_metrics(predictions(t), "y", "p", ["l_returnflag"])


@query("SELECT l_returnflag AS y, p, count(*) AS count FROM (SELECT l_returnflag, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS p FROM lineitem) GROUP BY 1, 2")
def m32_confusion(t):
    q = F.col("l_quantity")
    return M.confusion(t("lineitem").withColumn("p", F.when(q < 15, "A").when(q < 35, "N").otherwise("R")), "l_returnflag", "p")


@query(f"""WITH x AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS p FROM lineitem), c AS (SELECT c, (SELECT count(*) FROM x WHERE y = c) a, (SELECT count(*) FROM x WHERE p = c) s, (SELECT count(*) FROM x WHERE y = c AND p = c) t FROM (SELECT 'A' AS c UNION ALL SELECT 'N' UNION ALL SELECT 'R')), n AS (SELECT sum(a)::DOUBLE n, sum(t)::DOUBLE tt, sum(a * s)::DOUBLE x, sum(a * a)::DOUBLE aa, sum(s * s)::DOUBLE ss FROM c)
SELECT {_r('any_value(tt / n)', 'accuracy')}, {_r('any_value(1 - tt / n)', 'zero_one_loss')}, {_r('avg(t / a)', 'balanced_accuracy')}, {_r('avg(t / s)', 'precision_macro')}, {_r('avg(t / a)', 'recall_macro')}, {_r('avg(2 * t / (s + a))', 'f1_macro')}, {_r('sum(t / s * a) / sum(a)', 'precision_weighted')}, {_r('sum(t / a * a) / sum(a)', 'recall_weighted')}, {_r('sum(2 * t / (s + a) * a) / sum(a)', 'f1_weighted')}, {_r('any_value(tt / n)', 'f1_micro')}, {_r('avg(t / (s + a - t))', 'jaccard_macro')}, {_r('any_value((tt * n - x) / sqrt((n * n - ss) * (n * n - aa)))', 'mcc')}, {_r('any_value((tt / n - x / (n * n)) / (1 - x / (n * n)))', 'kappa')} FROM c, n""")
def m11_classification_metrics(t):
    q = F.col("l_quantity")
    return M.classification_metrics(t("lineitem").withColumn("p", F.when(q < 15, "A").when(q < 35, "N").otherwise("R")), "l_returnflag", "p")


@query(f"WITH g AS (SELECT score s, sum(label) AS p, sum(1 - label) AS n FROM {BIN} GROUP BY 1), c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) tp, sum(n) OVER (ORDER BY s DESC) fp, sum(p) OVER () pp, sum(n) OVER () nn FROM g) SELECT {_r('s', 'threshold')}, {_r('fp / nn', 'fpr')}, {_r('tp / pp', 'tpr')} FROM c")
def m33_roc_curve(t):
    return M.roc_curve(scored(t), "label", "score")


@query(f"WITH g AS (SELECT score s, sum(label) AS p, sum(1 - label) AS n FROM {BIN} GROUP BY 1), c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) tp, sum(n) OVER (ORDER BY s DESC) fp, sum(p) OVER () pp FROM g) SELECT {_r('s', 'threshold')}, {_r('tp / (tp + fp)', 'precision')}, {_r('tp / pp', 'recall')} FROM c")
def m34_pr_curve(t):
    return M.pr_curve(scored(t), "label", "score")


@query(f"""WITH b AS (SELECT label, score, least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS q FROM {BIN}), g AS (SELECT score s, sum(label) AS p, sum(1 - label) AS n FROM b GROUP BY 1), c AS (SELECT s, p, n, sum(p) OVER (ORDER BY s DESC) tp, sum(n) OVER (ORDER BY s DESC) fp FROM g)
SELECT {_r('(SELECT sum(n * (tp - p) + n * p * 0.5) / (sum(p) * sum(n)) FROM c)', 'roc_auc')}, {_r('(SELECT sum(p * tp / (tp + fp)) / sum(p) FROM c)', 'average_precision')}, {_r('avg((label - score) ** 2)', 'brier')}, {_r('-avg(label * ln(q) + (1 - label) * ln(1 - q))', 'log_loss')} FROM b""")
def m16_binary_metrics(t):
    return M.binary_metrics(scored(t), "label", "score")


@query(f"""WITH x AS (SELECT o_custkey AS q, floor(o_totalprice / 100000)::INT AS rel, o_orderkey % 7 AS s, o_orderkey AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), y AS (SELECT q, s, rel, (pow(2, rel) - 1) AS gain, avg(pow(2, rel) - 1) OVER (PARTITION BY q, s) AS g, (rel > 0)::INT AS hit, row_number() OVER (PARTITION BY q ORDER BY s DESC, k) AS r, row_number() OVER (PARTITION BY q ORDER BY rel DESC, k) AS b, sum((rel > 0)::INT) OVER (PARTITION BY q ORDER BY s DESC, k ROWS UNBOUNDED PRECEDING) AS hits FROM x WHERE n > 1),
z AS (SELECT q, sum(g / log2(r + 1)) FILTER (r <= 10) AS dcg, sum(gain / log2(b + 1)) FILTER (b <= 10) AS ideal, sum(hits / r) FILTER (r <= 10 AND hit = 1) AS ap, sum(hit) AS rel, min(r) FILTER (r <= 10 AND hit = 1) AS f FROM y GROUP BY q)
SELECT count(*) AS queries, {_r('avg(coalesce(dcg / nullif(ideal, 0), 0))', 'ndcg')}, {_r('avg(coalesce(ap / nullif(least(rel, 10), 0), 0))', 'map')}, {_r('avg(coalesce(1 / f, 0))', 'mrr')} FROM z""")
def m20_ranking_metrics(t):
    o = t("orders").select("o_custkey", F.floor(F.col("o_totalprice") / 100000).cast("int").alias("rel"), (F.col("o_orderkey") % 7).alias("s"), "o_orderkey")
    return M.ranking_metrics(o, "o_custkey", "rel", "s", "o_orderkey")


@query(f"""WITH c AS (SELECT o_orderstatus a, o_orderpriority b, count(*)::DOUBLE n FROM orders GROUP BY 1, 2), x AS (SELECT sum(n) nn, sum(n * (n - 1) / 2) pj FROM c), a AS (SELECT sum(n * (n - 1) / 2) pa, -sum(n / nn * ln(n / nn)) ha FROM (SELECT sum(n) n FROM c GROUP BY a), x), b AS (SELECT sum(n * (n - 1) / 2) pb, -sum(n / nn * ln(n / nn)) hb FROM (SELECT sum(n) n FROM c GROUP BY b), x), j AS (SELECT -sum(n / nn * ln(n / nn)) hj FROM c, x)
SELECT {_r('(pj - pa * pb / (nn * (nn - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (nn * (nn - 1) / 2))', 'adjusted_rand')}, {_r('(ha + hb - hj) / ha', 'homogeneity')}, {_r('(ha + hb - hj) / hb', 'completeness')}, {_r('2 * ((ha + hb - hj) / ha) * ((ha + hb - hj) / hb) / ((ha + hb - hj) / ha + (ha + hb - hj) / hb)', 'v_measure')}, {_r('pj / sqrt(pa * pb)', 'fowlkes_mallows')} FROM x, a, b, j""")
def m19_cluster_agreement(t):
    return M.cluster_agreement(t("orders"), "o_orderstatus", "o_orderpriority")


@query(f"SELECT {_r('avg(abs(y - p)) / avg(y)', 'value')} FROM {PRED}")
def m10_custom_metric(t):
    return M.custom(predictions(t), "avg(abs(error)) / avg(y)", "y", "p")


# --- linear models ----------------------------------------------------------------------------------------------------


@query(f"SELECT l_orderkey % 5 AS fold, count(*) AS n, {_r('sum(l_quantity)', 's0', 3)}, {_r('sum(l_discount)', 's1', 3)}, {_r('sum(l_tax)', 's2', 3)}, {_r('sum(l_quantity * l_quantity)', 'q0_0', 3)}, {_r('sum(l_quantity * l_discount)', 'q0_1', 3)}, {_r('sum(l_quantity * l_tax)', 'q0_2', 3)}, {_r('sum(l_discount * l_discount)', 'q1_1', 3)}, {_r('sum(l_discount * l_tax)', 'q1_2', 3)}, {_r('sum(l_tax * l_tax)', 'q2_2', 3)} FROM lineitem GROUP BY 1", places=3)
def g1_gram_by_fold(t):
    return G.gram_table(t("lineitem").withColumn("fold", F.col("l_orderkey") % 5), ["l_quantity", "l_discount"], "l_tax", ["fold"])


@query(f"SELECT {_r('regr_slope(l_extendedprice, l_quantity)', 'slope', 4)}, {_r('regr_intercept(l_extendedprice, l_quantity)', 'intercept', 4)} FROM lineitem", places=4)
def l1_ols(t):
    df = t("lineitem")
    m = G.ols(G.grams(df, ["l_quantity"], "l_extendedprice")[None])
    return df.sparkSession.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double")


@query()
def u1_ridge_search(t):
    """Every alpha and fold from one pass."""
    df = t("lineitem").withColumn("fold", F.col("l_orderkey") % 5)
    by = G.grams(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "fold")
    return df.sparkSession.createDataFrame(G.cross_validate(by, [0.1, 1.0, 10.0, 100.0]))


@query()
def x1_lasso_path(t):
    df = t("lineitem")
    g = G.grams(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")[None]
    alphas = [10.0**k for k in range(-2, 5)]
    rows = [(a, f, float(w)) for a, m in zip(alphas, G.path(g, alphas, G.lasso), strict=True) for f, w in zip(m.features, m.coefficients, strict=True)]
    return df.sparkSession.createDataFrame(rows, "alpha double, feature string, coefficient double")



# --- classifiers ------------------------------------------------------------------------------------------------------

_X = "(SELECT l_returnflag, l_quantity AS a, l_extendedprice / 1000 AS b, l_discount * 100 AS c, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem)"


def classified(t) -> DataFrame:
    return t("lineitem").select("l_returnflag", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_discount") * 100).alias("c"))


def _guesses(df: DataFrame) -> DataFrame:
    return df.groupBy("l_returnflag", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH x AS {_X}, m AS (SELECT l_returnflag AS k, avg(a) a, avg(b) b, avg(c) c FROM x GROUP BY 1), p AS (SELECT x.i, x.l_returnflag, arg_min(k, (x.a - m.a) ** 2 + (x.b - m.b) ** 2 + (x.c - m.c) ** 2) AS prediction FROM x, m GROUP BY 1, 2)
SELECT l_returnflag, prediction, count(*) AS n FROM p GROUP BY 1, 2""")
def a11_nearest_centroid(t):
    x = classified(t)
    return _guesses(K.nearest_centroid(x, ["a", "b", "c"], "l_returnflag").transform(x))


@query(f"""WITH x AS {_X}, e AS (SELECT 1e-9 * greatest(var_pop(a), var_pop(b), var_pop(c)) AS e FROM x), m AS (SELECT l_returnflag AS k, count(*) n, avg(a) a, avg(b) b, avg(c) c, var_pop(a) + any_value(e) va, var_pop(b) + any_value(e) vb, var_pop(c) + any_value(e) vc FROM x, e GROUP BY 1),
p AS (SELECT x.i, x.l_returnflag, arg_max(k, ln(n) - 0.5 * (ln(va) + ln(vb) + ln(vc) + (x.a - m.a) ** 2 / va + (x.b - m.b) ** 2 / vb + (x.c - m.c) ** 2 / vc)) AS prediction FROM x, m GROUP BY 1, 2) SELECT l_returnflag, prediction, count(*) AS n FROM p GROUP BY 1, 2""")
def a12_gaussian_nb(t):
    x = classified(t)
    return _guesses(K.gaussian_nb(x, ["a", "b", "c"], "l_returnflag").transform(x))


@query(f"SELECT l_linestatus, {_r('any_value(m)', 'mean')}, {_r('any_value(q)', 'median')}, count(*) AS n FROM lineitem, (SELECT avg(l_tax) m, quantile_cont(l_tax, 0.5) q FROM lineitem) GROUP BY 1")
def a10_dummy_regressor(t):
    x = t("lineitem").select("l_linestatus", "l_tax")
    out = K.dummy_regressor(x, "l_tax").transform(x).withColumnRenamed("prediction", "mean")
    out = K.dummy_regressor(x, "l_tax", "median").transform(out).withColumnRenamed("prediction", "median")
    return out.groupBy("l_linestatus").agg(F.first("mean").alias("mean"), F.first("median").alias("median"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_linestatus, p AS prediction, count(*) AS n FROM lineitem, (SELECT l_returnflag AS p FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY 1, 2")
def a10_dummy_classifier(t):
    x = t("lineitem").select("l_linestatus", "l_returnflag")
    return K.dummy_classifier(x, "l_returnflag").transform(x).groupBy("l_linestatus", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query()
def l23_ridge_classifier(t):
    x = classified(t)
    return _guesses(K.ridge_classifier(x, ["a", "b", "c"], "l_returnflag").transform(x))


@query()
def l24_linear_discriminant(t):
    x = classified(t)
    return _guesses(K.linear_discriminant(x, ["a", "b", "c"], "l_returnflag").transform(x))


@query()
def a2_random_forest(t):
    x = t("lineitem").select("l_linestatus", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    m = K.tree_ensemble(x, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "random_forest_regressor", numTrees=10, maxDepth=5, seed=1)
    return M.regression_metrics(m.transform(x), "l_extendedprice", "prediction", ["l_linestatus"])


@query(f"""WITH c AS (SELECT l_returnflag k, l_linestatus b, count(*)::DOUBLE n FROM lineitem GROUP BY 1, 2), a AS (SELECT k, sum(n) na FROM c GROUP BY 1), d AS (SELECT b, sum(n) nb FROM c GROUP BY 1), t AS (SELECT sum(n) nn FROM c)
SELECT {_r('sum(n / nn * ln(n * nn / (na * nb)))', 'mutual_information')} FROM c JOIN a USING (k) JOIN d USING (b), t""")
def f19b_mutual_information(t):
    return P.mutual_information(t("lineitem"), "l_returnflag", "l_linestatus")


_SEG = " + ".join(f"CASE WHEN q[{i + 2}] > q[{i + 1}] THEN least(greatest((c_acctbal - q[{i + 1}]) / nullif(q[{i + 2}] - q[{i + 1}], 0), 0), 1) WHEN c_acctbal > q[{i + 1}] THEN 1 WHEN c_acctbal = q[{i + 1}] THEN 0.5 ELSE 0 END" for i in range(8))


@query(f"SELECT c_custkey, {_r(f'CASE WHEN c_acctbal <= q[1] THEN 0 WHEN c_acctbal >= q[9] THEN 1 ELSE ({_SEG}) / 8.0 END', 'c_acctbal')} FROM customer, (SELECT quantile_cont(c_acctbal, {[i / 8 for i in range(9)]}) q FROM customer)")
def f5c_quantile_uniform(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    return P.quantile_uniform(c, "c_acctbal", 8).transform(c)


@query()
def f5b_yeo_johnson(t):
    c = t("customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("c_acctbal"))
    return P.power(c, "c_acctbal").transform(c)


@query(f"""WITH x AS {_X}, m AS (SELECT l_returnflag, count(*) n, avg(a) a, avg(b) b, var_pop(a) + var_pop(b) v FROM x GROUP BY 1), g AS (SELECT avg(a) ga, avg(b) gb FROM x)
SELECT {_r('(sum(n * ((a - ga) ** 2 + (b - gb) ** 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))', 'calinski_harabasz', 4)} FROM m, g""", places=4)
def m18_calinski_harabasz(t):
    return M.calinski_harabasz(classified(t), ["a", "b"], "l_returnflag")


@query()
def x2_learning_curve(t):
    """Five nested sizes and a validation part from one grouped pass."""
    df = t("lineitem").withColumn("bucket", (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("0"), "l_orderkey")), 1, 6), 16, 10).cast("long") % 6).cast("int"))
    by = G.grams(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "bucket")
    validation = by.pop(5)
    return df.sparkSession.createDataFrame(G.learning_curve(by, validation, 1.0))


@query()
def x6_loss_surface(t):
    df = t("lineitem")
    g = G.grams(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")[None]
    return df.sparkSession.createDataFrame(G.loss_surface(g, G.ridge(g, 1.0), 0, 1, 1.0))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on lineitem: split by md5, scale and encode from the training part, fit from its Gram, measure by split."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    # Written once: scale, categories, moments and scores read the same split.
    df = keep(V.holdout(df.select("key", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice"), "key", seed=417))
    train = df.where("split = 'train'")
    numeric = ["l_quantity", "l_discount", "l_tax"]
    scale, hot = P.scale(train, numeric), P.onehot(train, "l_returnflag")
    ready = hot.transform(scale.transform(df))
    features = [*numeric, *[f"l_returnflag={v}" for v in hot.stats["categories"]]]
    model = G.ridge(G.grams(ready.where("split = 'train'").withColumnsRenamed({f: f.replace("=", "_") for f in features}), [f.replace("=", "_") for f in features], "l_extendedprice")[None], 1.0)
    named = ready.withColumnsRenamed({f: f.replace("=", "_") for f in features})
    return M.regression_metrics(model.transform(named), "l_extendedprice", "prediction", ["split"], medae=False).select("split", "n", "rmse", "mae", "r2")


@query()
def flagship_ridge(t):
    df = t("lineitem")
    path = df.inputFiles()[0].rpartition("/lineitem.parquet")[0]
    return flagship(df.sparkSession, path)


from . import queries_factors, queries_learn, queries_models, queries_neighbors  # noqa: E402, F401  register their queries with the decorator above
