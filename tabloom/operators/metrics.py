"""Metrics as aggregates over a scored DataFrame; undefined ones are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import group_quantiles, join_null_safe, running_total
from ..functions.stages import keep


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None, quantile: float = 0.5, power: float = 1.5, medae: bool = True) -> DataFrame:
    """All regression metrics in one pass; the median absolute error (null unless medae) takes three more over rows held for it."""
    by = by or []
    if medae:
        # Predictions are worked out once; the median comes from the few buckets of errors that hold it.
        Y, P = F.col("_y"), F.col("_p")
        df = keep(df.select(*by, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p")).where(Y.isNotNull() & P.isNotNull()))
        middle = group_quantiles(df.withColumn("_e", F.abs(Y - P)), "_e", [0.5], by, "_medae").withColumn("_medae", F.get("_medae", F.lit(0)))
        rest = regression_metrics(df, "_y", "_p", by, quantile, power, medae=False)
        out = join_null_safe(rest, middle, by, "left") if by else rest.join(F.broadcast(middle), how="left")
        return out.withColumn("medae", F.col("_medae")).drop("_medae")
    Y, P = F.col(y).cast("double"), F.col(p).cast("double")
    if by:
        df = df.where(Y.isNotNull() & P.isNotNull())
    else:
        # Not a filter, which would be moved below the prediction and repeat what it is made of.
        df = df.select(Y.alias("_y"), P.alias("_p")).select(F.when(F.col("_p").isNotNull(), F.col("_y")).alias("_y"), F.when(F.col("_y").isNotNull(), F.col("_p")).alias("_p"))
        Y, P = F.col("_y"), F.col("_p")
    e = Y - P
    positive, nonneg = (F.count_if(~((Y > 0) & (P > 0))) == 0), (F.count_if((Y < 0) | (P < 0)) == 0)
    n = F.count(e)
    poisson = 2 * (F.when(Y > 0, Y * F.ln(F.try_divide(Y, P))).otherwise(0.0) - Y + P)
    gamma = 2 * (F.ln(F.try_divide(P, Y)) + F.try_divide(Y, P) - 1)
    t = power
    tweedie = 2 * (F.pow(F.greatest(Y, F.lit(0.0)), F.lit(2 - t)) / ((1 - t) * (2 - t)) - Y * F.pow(P, F.lit(1 - t)) / (1 - t) + F.pow(P, F.lit(2 - t)) / (2 - t))
    spread = F.var_pop(Y)
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.lit(None).cast("double").alias("medae"),
        F.when((n > 1) & (spread > 0), 1 - F.avg(e * e) / F.nullif(spread, F.lit(0.0))).alias("r2"), F.when((n > 1) & (spread > 0), 1 - F.var_pop(e) / F.nullif(spread, F.lit(0.0))).alias("explained_variance"), F.max(F.abs(e)).alias("max_error"),
        F.when(F.count_if(Y == 0) == 0, F.avg(F.abs(e / F.nullif(Y, F.lit(0.0))))).alias("mape"), (200 * F.avg(F.when(e.isNotNull(), F.coalesce(F.abs(e) / F.nullif(F.abs(Y) + F.abs(P), F.lit(0.0)), F.lit(0.0))))).alias("smape"),
        F.when(nonneg, F.avg(F.pow(F.log1p(Y) - F.log1p(P), F.lit(2.0)))).alias("msle"), F.when(nonneg, F.sqrt(F.avg(F.pow(F.log1p(Y) - F.log1p(P), F.lit(2.0))))).alias("rmsle"),
        F.avg(F.greatest(quantile * e, (quantile - 1) * e)).alias("pinball"), F.when((F.count_if((Y < 0) | (P <= 0)) == 0), F.avg(poisson)).alias("poisson_deviance"), F.when(positive, F.avg(gamma)).alias("gamma_deviance"), F.when((F.count_if((Y < 0) | (P <= 0)) == 0), F.avg(tweedie)).alias("tweedie_deviance"),
    )


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Zero-filled counts over all classes of y and p."""
    counts = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).count()
    classes = counts.select(F.col("y").alias("c")).union(counts.select("p")).distinct()
    grid = classes.select(F.col("c").alias("y")).crossJoin(classes.select(F.col("c").alias("p")))  # classes squared, not rows
    return grid.join(counts, ["y", "p"], "left").select("y", "p", F.coalesce("count", F.lit(0)).alias("count"))


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """From the confusion table: accuracy, balanced accuracy, macro/weighted/micro precision, recall, f1, jaccard, mcc, kappa."""
    c = confusion(df, y, p)
    per = c.groupBy(F.col("y").alias("c")).agg(F.sum("count").alias("actual"), F.sum(F.when(F.col("y") == F.col("p"), F.col("count")).otherwise(0)).alias("tp")).join(c.groupBy(F.col("p").alias("c")).agg(F.sum("count").alias("said")), "c")
    prec = F.coalesce(F.col("tp") / F.nullif(F.col("said"), F.lit(0)), F.lit(0.0))
    rec = F.coalesce(F.col("tp") / F.nullif(F.col("actual"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(F.col("said") + F.col("actual"), F.lit(0)), F.lit(0.0))
    jac = F.coalesce(F.col("tp") / F.nullif(F.col("said") + F.col("actual") - F.col("tp"), F.lit(0)), F.lit(0.0))
    n, t = F.sum("actual"), F.sum("tp")
    cross = F.sum(F.col("actual") * F.col("said"))
    weighted = lambda x: F.sum(x * F.col("actual")) / F.sum("actual")
    root = F.sqrt((n * n - F.sum(F.col("said") * F.col("said"))).cast("double") * (n * n - F.sum(F.col("actual") * F.col("actual"))).cast("double"))
    return per.agg(
        (t / n).alias("accuracy"), (1 - t / n).alias("zero_one_loss"), F.avg(F.when(F.col("actual") > 0, rec)).alias("balanced_accuracy"),
        F.avg(prec).alias("precision_macro"), F.avg(rec).alias("recall_macro"), F.avg(f1).alias("f1_macro"), weighted(prec).alias("precision_weighted"), weighted(rec).alias("recall_weighted"), weighted(f1).alias("f1_weighted"),
        (t / n).alias("f1_micro"), F.avg(jac).alias("jaccard_macro"), F.coalesce((t * n - cross) / F.nullif(root, F.lit(0.0)), F.lit(0.0)).alias("mcc"), ((t / n - cross / (n * n)) / F.nullif(1 - cross / (n * n), F.lit(0.0))).alias("kappa"),
    )


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """(s, pos, neg, tp, fp): counts at each distinct score and at or above it."""
    g = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    return running_total(running_total(g, "s", "pos", "tp", False), "s", "neg", "fp", False)


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    total = df.agg(F.sum(F.col(label).cast("long")).alias("P"), F.sum(1 - F.col(label).cast("long")).alias("N"))
    return _by_score(df, label, score).crossJoin(F.broadcast(total)).select(F.col("s").alias("threshold"), (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"))


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    total = df.agg(F.sum(F.col(label).cast("long")).alias("P"))
    return _by_score(df, label, score).crossJoin(F.broadcast(total)).select(F.col("s").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("P")).alias("recall"))


def binary_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC AUC (ties count half), average precision, Brier score, log loss."""
    eps = 2.220446049250313e-16
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    plain = df.agg(F.avg(F.pow(y - F.col(score), F.lit(2.0))).alias("brier"), (-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))
    c = _by_score(df, label, score)
    curve = c.agg(
        (F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") * 0.5) / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"),
        (F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("average_precision"),
    )
    return curve.crossJoin(F.broadcast(plain))


def ranking_metrics(df: DataFrame, query: str, relevance: str, score: str, key: str, k: int = 10) -> DataFrame:
    """Mean ndcg@k (gains 2^rel - 1, averaged over tied scores), map@k and mrr@k over queries of at least two rows."""
    w = Window.partitionBy(query)
    by_score = w.orderBy(F.desc(score), key)
    x = df.select(query, F.col(relevance).alias("rel"), F.col(score).alias("s"), key).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n > 1")
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    x = x.withColumns({"r": F.row_number().over(by_score), "g": F.avg(gain).over(Window.partitionBy(query, "s")), "best": F.row_number().over(w.orderBy(F.desc("rel"), key)), "gain": gain, "hit": (F.col("rel") > 0).cast("int")})
    x = x.withColumn("hits", F.sum("hit").over(by_score.rowsBetween(Window.unboundedPreceding, 0)))
    q = x.groupBy(query).agg(
        F.sum(F.when(F.col("r") <= k, F.col("g") / F.log2(F.col("r") + 1.0))).alias("dcg"), F.sum(F.when(F.col("best") <= k, F.col("gain") / F.log2(F.col("best") + 1.0))).alias("ideal"),
        F.sum(F.when((F.col("r") <= k) & (F.col("hit") == 1), F.col("hits") / F.col("r"))).alias("ap"), F.sum("hit").alias("relevant"), F.min(F.when((F.col("r") <= k) & (F.col("hit") == 1), F.col("r"))).alias("first"),
    )
    return q.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce(F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0)), F.lit(0.0))).alias("ndcg"), F.avg(F.coalesce(F.col("ap") / F.nullif(F.least(F.col("relevant"), F.lit(k)), F.lit(0)), F.lit(0.0))).alias("map"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def cluster_agreement(df: DataFrame, reference: str, label: str) -> DataFrame:
    """Adjusted Rand, homogeneity, completeness, v-measure, Fowlkes-Mallows from the contingency table."""
    c = df.groupBy(F.col(reference).alias("a"), F.col(label).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    ent = lambda t: -F.sum(F.col("n") / F.col("rows") * F.ln(F.col("n") / F.col("rows")))
    total = c.agg(F.sum("n").alias("rows"))
    a, b = (c.groupBy(k).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).agg(F.sum(two(F.col("n"))).alias(f"p{k}"), ent(k).alias(f"h{k}")) for k in ("a", "b"))
    j = c.crossJoin(F.broadcast(total)).agg(F.sum(two(F.col("n"))).alias("pj"), ent("j").alias("hj"), F.max("rows").alias("rows"))
    x = j.crossJoin(a).crossJoin(b)
    mi = F.col("ha") + F.col("hb") - F.col("hj")
    h, k = F.when(F.col("ha") > 0, mi / F.col("ha")).otherwise(1.0), F.when(F.col("hb") > 0, mi / F.col("hb")).otherwise(1.0)
    exp = F.col("pa") * F.col("pb") / two(F.col("rows"))
    return x.select(((F.col("pj") - exp) / F.nullif((F.col("pa") + F.col("pb")) / 2 - exp, F.lit(0.0))).alias("adjusted_rand"), h.alias("homogeneity"), k.alias("completeness"), F.coalesce(2 * h * k / F.nullif(h + k, F.lit(0.0)), F.lit(0.0)).alias("v_measure"), (F.col("pj") / F.sqrt(F.col("pa") * F.col("pb"))).alias("fowlkes_mallows"))


def custom(df: DataFrame, formula: str, y: str, p: str) -> DataFrame:
    """A formula in Spark SQL over y, pred and error that aggregates to one number."""
    x = df.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("pred")).withColumn("error", F.expr("y - pred"))
    return x.agg(F.expr(formula).alias("value"))


def trial_curve(trials: DataFrame, trial: str, score: str, maximise: bool = False) -> DataFrame:
    """Best score so far; as many rows as trials (bounded by the search budget)."""
    best: Column = (F.max if maximise else F.min)(score).over(Window.orderBy(trial).rowsBetween(Window.unboundedPreceding, 0))
    return trials.select(trial, score, best.alias("best"))


def calinski_harabasz(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """Between-cluster over within-cluster dispersion; null for fewer than two clusters."""
    per = df.groupBy(cluster).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], sum((F.var_pop(f) for f in features), F.lit(0.0)).alias("v"))
    k, n = F.count(F.lit(1)), F.sum("n")
    between = sum((F.sum(F.col("n") * F.col(f"m{i}") * F.col(f"m{i}")) - F.pow(F.sum(F.col("n") * F.col(f"m{i}")), F.lit(2.0)) / n for i in range(len(features))), F.lit(0.0))
    within = F.sum(F.col("n") * F.col("v"))
    return per.agg(F.when((k > 1) & (within > 0), between / (k - 1) / (within / (n - k))).alias("calinski_harabasz"))


def binary_averages(df: DataFrame, y: str, p: str, positive, beta: float = 1.0) -> DataFrame:
    """precision, recall, f1 and fbeta of the positive class; 0 where undefined. Needs exactly two classes."""
    if not 0 < beta <= 100:
        raise ValueError("beta lies above 0 and at most at 100")
    if df.select(F.col(y).alias("c")).unionByName(df.select(F.col(p).alias("c"))).where("c is not null").distinct().limit(3).count() != 2:
        raise ValueError("binary averages need two classes")
    tp, fp, fn = (F.count_if((F.col(y) == positive) & (F.col(p) == positive)), F.count_if((F.col(y) != positive) & (F.col(p) == positive)), F.count_if((F.col(y) == positive) & (F.col(p) != positive)))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    b2 = beta * beta
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(
        ratio(tp, tp + fp).alias("precision_binary"), ratio(tp, tp + fn).alias("recall_binary"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_binary"), ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp).alias("fbeta_binary"),
    )


def multiclass_log_loss(df: DataFrame, y: str, probabilities: dict, eps: float = 2.220446049250313e-16) -> DataFrame:
    """Mean of -ln of the probability of the true class, clipped; probabilities: class -> column."""
    own = F.coalesce(*[F.when(F.col(y) == c, F.col(q)) for c, q in probabilities.items()])
    return df.agg(F.avg(-F.ln(F.least(F.greatest(own, F.lit(eps)), F.lit(1 - eps)))).alias("log_loss"))


def _auc(df: DataFrame, positive: str, score: str) -> tuple[float | None, int]:
    """(area under the curve, number of positives) by counts over distinct scores; ties count half."""
    from ..functions.columns import running_total

    d = df.select(F.col(score).cast("double").alias("s"), F.col(positive).cast("long").alias("y")).groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    r = running_total(d, "s", "neg", "below").agg(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return (r["won"] / (r["p"] * r["n"]) if r["p"] and r["n"] else None), int(r["p"] or 0)


def multiclass_auc(df: DataFrame, y: str, scores: dict) -> DataFrame:
    """roc_auc (one against the rest, mean over classes), roc_auc_weighted (by class size), roc_auc_ovo (mean over pairs of classes,
    each both ways); null if a class has no rows. scores: class -> column; two jobs per class or pair, whatever the rows."""
    rest = {c: _auc(df.withColumn("_y", (F.col(y) == c).cast("int")), "_y", q) for c, q in scores.items()}
    full = all(a is not None for a, _ in rest.values())
    pairs = []
    for a, qa in scores.items():
        for b in scores:
            if a != b:
                pairs.append(_auc(df.where(F.col(y).isin(a, b)).withColumn("_y", (F.col(y) == a).cast("int")), "_y", qa)[0])
    n = sum(k for _, k in rest.values())
    row = (sum(a for a, _ in rest.values()) / len(rest), sum(a * k for a, k in rest.values()) / n, sum(pairs) / len(pairs)) if full else (None, None, None)
    return df.sparkSession.createDataFrame([row], "roc_auc double, roc_auc_weighted double, roc_auc_ovo double")


def cluster_information(df: DataFrame, reference: str, label: str) -> DataFrame:
    """homogeneity, completeness, v_measure, normalized_mutual_info and fowlkes_mallows of two labellings, from their contingency table."""
    cells = df.where(F.col(reference).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(reference).alias("r"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = cells.groupBy("r").agg(F.sum("n").alias("a")), cells.groupBy("l").agg(F.sum("n").alias("b"))
    total = rows.agg(F.sum("a").alias("t"))
    plogp = lambda c: F.sum(-F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))
    hr = rows.crossJoin(F.broadcast(total)).agg(plogp("a").alias("hr"), F.sum(F.col("a") * (F.col("a") - 1) / 2).alias("pr"))
    hl = cols.crossJoin(F.broadcast(total)).agg(plogp("b").alias("hl"), F.sum(F.col("b") * (F.col("b") - 1) / 2).alias("pl"))
    mi = cells.join(rows, "r").join(cols, "l").crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pp"))
    x = mi.crossJoin(F.broadcast(hr)).crossJoin(F.broadcast(hl))  # one row each
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(1.0))
    h, c = share(F.col("mi"), F.col("hr")), share(F.col("mi"), F.col("hl"))
    return x.select(
        h.alias("homogeneity"), c.alias("completeness"), F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(F.lit(0.0)).alias("v_measure"),
        share(F.col("mi"), (F.col("hr") + F.col("hl")) / 2).alias("normalized_mutual_info"), F.when((F.col("pr") > 0) & (F.col("pl") > 0), F.col("pp") / F.sqrt(F.col("pr") * F.col("pl"))).otherwise(F.lit(0.0)).alias("fowlkes_mallows"),
    )


def davies_bouldin(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / distance of centres; centres, one row per cluster, are compared with each other."""
    known = df.dropna(subset=[*features, label]).where(F.col(label).cast("string") != "-1")
    centers = known.groupBy(label).agg(*[F.avg(f).alias(f"_c_{f}") for f in features])
    if centers.limit(1001).count() > 1000:
        raise ValueError("more than 1000 clusters")
    gap = sum(((F.col(f) - F.col(f"_c_{f}")) ** 2 for f in features), F.lit(0.0))
    spread = known.join(centers, label).groupBy(label).agg(F.avg(F.sqrt(gap)).alias("_s"), *[F.first(f"_c_{f}").alias(f"_c_{f}") for f in features])
    a, b = (spread.select(*[F.col(c).alias(f"{c}_{side}") for c in spread.columns]) for side in ("x", "y"))
    far = F.sqrt(sum(((F.col(f"_c_{f}_x") - F.col(f"_c_{f}_y")) ** 2 for f in features), F.lit(0.0)))
    worst = a.join(b, F.col(f"{label}_x") != F.col(f"{label}_y")).groupBy(f"{label}_x").agg(F.max((F.col("_s_x") + F.col("_s_y")) / far).alias("w"))  # at most 1000 x 1000
    return worst.agg(F.avg("w").alias("davies_bouldin"))


def anomaly_fraction(df: DataFrame, label: str = "anomaly") -> DataFrame:
    return df.agg(F.avg((F.col(label) == -1).cast("double")).alias("anomaly_fraction"))


def silhouette(df: DataFrame, features: list[str], label: str, key: str, size: int = 2000, seed: int = 0) -> DataFrame:
    """(silhouette, n, clusters): the mean over at most size rows, the first in an md5 order, of (b - a) / max(a, b).

    a: mean distance to the other rows of the own cluster, b: the least mean distance to another cluster, all among these rows. Noise (-1), unknown
    labels and features take no part; a row alone in its cluster counts 0; fewer than two clusters give null.
    """
    import numpy as np

    from ..functions.columns import finite, shuffled_rank
    from ..functions.stages import keep, ship

    known = df.select(F.col(key).alias("k"), F.col(label).cast("string").alias("l"), F.array(*[finite(F.col(f)) for f in features]).alias("v"))
    known = known.where(F.col("l").isNotNull() & (F.col("l") != "-1") & F.forall("v", lambda e: e.isNotNull()))
    rows = keep(shuffled_rank(known, seed, "k", name="r").where(F.col("r") <= size))
    held = rows.select("l", "v").collect()
    clusters = sorted({r["l"] for r in held})
    if len(clusters) < 2:
        return rows.agg(F.lit(None).cast("double").alias("silhouette"), F.count(F.lit(1)).alias("n"), F.lit(len(clusters)).cast("long").alias("clusters"))
    at = np.array([r["v"] for r in held])
    own = np.array([[r["l"] == c for c in clusters] for r in held], float)
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def score(v, label):
        import pandas as pd

        out = []
        for x, c in zip(v, label, strict=True):
            total = np.sqrt(((at - np.asarray(x)) ** 2).sum(axis=1)) @ own
            n, i = own.sum(axis=0), clusters.index(c)
            a = total[i] / max(n[i] - 1, 1)
            b = np.delete(total / n, i).min()
            out.append((b - a) / max(a, b) if n[i] > 1 and max(a, b) > 0 else 0.0)
        return pd.Series(out, index=v.index, dtype=float)

    return rows.withColumn("s", score("v", "l")).agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"), F.lit(len(clusters)).cast("long").alias("clusters"))


#: Clusters of a labelling that adjusted_mutual_information takes.
MOST_CLUSTERS = 1000


def adjusted_mutual_information(df: DataFrame, reference: str, label: str) -> DataFrame:
    """(adjusted_mutual_information): (MI - E[MI]) / (mean entropy - E[MI]), the expectation over all tables with these margins.

    One pass makes the contingency table; the margins, at most MOST_CLUSTERS a side, are held by the driver. Counts further than 40 standard
    deviations from their mean, of a probability below 1e-300, are left out of the expectation. Rows with an unknown label take no part; 1.0 if both
    sides are one cluster.
    """
    import math

    import numpy as np

    from ..functions.stages import keep

    cells = keep(df.where(F.col(reference).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(reference).alias("r"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n")))
    margins = [sorted(x["s"] for x in cells.groupBy(c).agg(F.sum("n").alias("s")).limit(MOST_CLUSTERS + 1).collect()) for c in ("r", "l")]
    if max(map(len, margins)) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    spark = df.sparkSession
    if max(map(len, margins)) <= 1:
        return spark.range(1).select(F.lit(1.0).alias("adjusted_mutual_information"))
    total = sum(margins[0])
    entropies = [-sum(x / total * math.log(x / total) for x in m) for m in margins]
    log_factorial = np.vectorize(lambda x: math.lgamma(x + 1), otypes=[float])
    expected = 0.0
    pairs: dict = {}
    for a in margins[0]:
        for b in margins[1]:
            pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), times in pairs.items():
        mean = a * b / total
        reach = 40 * math.sqrt(mean * (1 - a / total) * (1 - b / total) * total / max(total - 1, 1)) + 40
        n = np.arange(max(1, a + b - total, math.floor(mean - reach)), min(a, b, math.ceil(mean + reach)) + 1)
        fixed = math.lgamma(a + 1) + math.lgamma(b + 1) + math.lgamma(total - a + 1) + math.lgamma(total - b + 1) - math.lgamma(total + 1)
        chance = np.exp(fixed - log_factorial(n) - log_factorial(a - n) - log_factorial(b - n) - log_factorial(total - a - b + n))
        expected += times * float((n / total * np.log(total * n / (a * b)) * chance).sum())
    rows, cols = cells.groupBy("r").agg(F.sum("n").alias("a")), cells.groupBy("l").agg(F.sum("n").alias("b"))
    mi = cells.join(rows, "r").join(cols, "l").agg(F.sum(F.col("n") / total * F.ln(F.col("n") * float(total) / (F.col("a") * F.col("b").cast("double")))).alias("mi"))
    bound = sum(entropies) / 2 - expected
    # The library rule: a bound of 0 is moved off it, with its sign.
    bound = min(bound, -2.0**-52) if bound < 0 else max(bound, 2.0**-52)
    return mi.select(((F.col("mi") - expected) / bound).alias("adjusted_mutual_information"))
