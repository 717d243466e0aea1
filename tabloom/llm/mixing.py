"""Mixing sources to target weights by soft membership (operator 1); DataFrame functions and pyspark.ml only.

A classifier trained on a labelled table gives every document a posterior over domains. A document's rate (how often
it is used, 0 or more) is fitted so that the expected tokens of each domain, the sum over documents of rate x tokens x
posterior, meet the targets: least squares by Newton steps in one multiplier per domain, scaled by the Gram of the posteriors
of the documents in use, where a step needs one aggregate over all documents. Of all rates that do so, those nearest to 1 are
taken, so documents move away from plain use only as far as the targets ask.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table, text_of, words_of

#: Domains of the labels table, in the order of the posterior.
DOMAINS = ["good", "low", "toxic"]
FEATURES = 1 << 15
#: Shares of the expected tokens that the queries ask for.
TARGETS = {"good": 0.96, "low": 0.04, "toxic": 0.0}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table with quality and toxic; toxic outweighs quality, several labels of one document count once (the worst)."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    domain = F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).when(F.col("q") == 1, 0)
    return known.select("doc_id", domain.cast("double").alias("domain")).where("domain is not null")


def _vectors(docs: DataFrame, text: str) -> DataFrame:
    """docs with n_tokens (words) and the hashed distinct words of their texts, without punctuation at the ends."""
    words = words_of(F.translate(ascii_lower(text_of(text)), ".,;:!?\"'()", ""))
    df = docs.withColumn("_words", words).withColumn("n_tokens", F.size("_words").cast("long")).withColumn("_distinct", F.array_distinct("_words"))
    return HashingTF(numFeatures=FEATURES, inputCol="_distinct", outputCol="_features", binary=True).transform(df).drop("_words", "_distinct")


def train_domains(docs: DataFrame, labelled: DataFrame, max_labelled: int = 20_000, text: str = "text", iterations: int = 20) -> LogisticRegressionModel | None:
    """Multinomial logistic regression on at most about max_labelled labelled documents, drawn by a hash of doc_id.

    None if fewer than two domains are labelled.
    """
    n = labelled.count()
    drawn = labelled.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) < F.lit(min(1.0, max_labelled / max(1, n)) * (1 << 20))).limit(2 * max_labelled)
    pairs = docs.select("doc_id", text).join(F.broadcast(drawn), "doc_id")  # bounded by max_labelled
    data = materialize(_vectors(pairs, text).select("_features", "domain"), "labelled")
    if data.select("domain").distinct().count() < 2:
        return None
    return LogisticRegression(featuresCol="_features", labelCol="domain", family="multinomial", regParam=3e-4, standardization=False, maxIter=iterations).fit(data)


def posteriors(docs: DataFrame, model: LogisticRegressionModel | None, text: str = "text") -> DataFrame:
    """docs with n_tokens and posterior (array, one entry per domain). Without a model everything is of the first domain."""
    df = _vectors(docs, text)
    if model is None:
        return df.drop("_features").withColumn("posterior", F.array(*[F.lit(float(k == 0)) for k in range(len(DOMAINS))]))
    model = model.copy().setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y")
    p = vector_to_array("_p")
    full = F.array(*[F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)) for k in range(len(DOMAINS))])
    return model.transform(df).withColumn("posterior", full).drop("_features", "_p", "_r", "_y")


def _rate(multipliers: list[float]) -> Column:
    pull = reduce(lambda a, b: a + b, [F.get("posterior", F.lit(k)) * F.lit(float(x)) for k, x in enumerate(multipliers)])
    return F.greatest(F.lit(0.0), F.lit(1.0) + pull)


def _pass(weighed: DataFrame, multipliers: list[float], wanted: list[float]) -> tuple[list[float], list[list[float]], float, float]:
    """Tokens of each domain under the rates, the Gram of the documents in use, half the squared rates, and the tokens of documents
    that most likely belong to a wanted domain but get rate 0. All but the last are sums over tokens."""
    n = len(DOMAINS)
    p = [F.get("posterior", F.lit(k)) for k in range(n)]
    of = weighed.select("n_tokens", *[x.alias(f"p{k}") for k, x in enumerate(p)], _rate(multipliers).alias("r"))
    used, t = (F.col("r") > 0).cast("double"), F.col("n_tokens")
    ours = [F.col(f"p{k}") for k in range(n) if wanted[k] > 0]
    others = [F.col(f"p{k}") for k in range(n) if wanted[k] <= 0]
    likely = F.greatest(*ours, F.lit(0.0)) >= F.greatest(*others, F.lit(0.0), F.lit(0.0))
    row = of.agg(
        *[F.sum(t * F.col("r") * F.col(f"p{k}")).alias(f"d{k}") for k in range(n)],
        *[F.sum(t * used * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}{j}") for i in range(n) for j in range(i, n)],
        F.sum(t * F.col("r") * F.col("r") / 2).alias("half"),
        F.sum(F.when(likely & (used == 0), t)).alias("unused"),
    ).first()
    gram = [[float(row[f"g{min(i, j)}{max(i, j)}"] or 0) for j in range(n)] for i in range(n)]
    return [float(row[f"d{k}"] or 0) for k in range(n)], gram, float(row["half"] or 0), float(row["unused"] or 0)


def fit_rates(weighed: DataFrame, targets: dict[str, float], total: float | None = None, steps: int = 200, tolerance: float = 5e-4, unused: float = 0.1) -> tuple[Column, list[dict]]:
    """The rate of each document as an expression over posterior, and the residuals of each stage; the last are those of the rate.

    Minimises 1/2 sum_k ((sum_d r_d n_d p_dk - T_k) / N)^2 + m/2 sum_d n_d (r_d - 1)^2 / N over r >= 0, with T = targets x total and
    N all tokens; there r_d = max(0, 1 + <p_d, l>) with one multiplier l_k per domain. m falls from stage to stage until every
    residual is within tolerance. total: expected tokens wanted; by default as many as let the domain with the largest target keep
    its own, so that its rates stay near 1.

    A soft posterior leaves some of each domain in every document, so that the last of an unwanted domain is only gone with most
    of the others: m stops falling before more than unused of all tokens, of documents most likely of a wanted domain, would get
    rate 0. Then, or where a domain has too few tokens, residuals stay above the tolerance; callers warn of it.
    """
    import numpy as np

    names, n = DOMAINS, len(DOMAINS)
    share = [targets.get(k, 0.0) for k in names]
    norm = sum(share) or 1.0
    wanted = [s / norm for s in share]
    at = np.zeros(n)
    now, gram, half, idle = _pass(weighed, list(at), wanted)
    all_tokens = sum(now)
    if not all_tokens:
        return F.lit(1.0), []
    lead = max(range(n), key=lambda k: wanted[k])
    goal = np.array(wanted) * (total if total is not None else now[lead] / wanted[lead]) / all_tokens
    residual = np.array(now) / all_tokens - goal
    best, seen = at, [dict(zip(names, map(float, residual), strict=True))]
    m, passes = 1e-2, 1
    while np.abs(residual).max() >= tolerance and m > 1e-9 and passes < steps:
        while passes < steps:
            slope = residual + m * at
            if np.abs(slope).max() < tolerance / 20:
                break
            step = -np.linalg.solve(np.array(gram) / all_tokens + m * np.eye(n), slope)
            value, length = half / all_tokens - at @ goal + m / 2 * at @ at, 1.0
            while passes < steps:
                new = at + length * step
                now, gram, half, idle = _pass(weighed, list(new), wanted)
                passes += 1
                if half / all_tokens - new @ goal + m / 2 * new @ new <= value + 1e-4 * length * (slope @ step) + 1e-12 or length < 1e-3:
                    break
                length /= 2
            at, residual = new, np.array(now) / all_tokens - goal
        if idle > unused * all_tokens:
            break
        best = at
        seen.append(dict(zip(names, map(float, residual), strict=True)))
        m /= 4
    return _rate([float(x) for x in best]), seen


def _fitted(weighed: DataFrame, targets: dict[str, float], total: float | None, residuals: dict[str, float] | None) -> Column:
    """The rate; its residuals go into residuals, and a warning names them where the targets are missed."""
    tolerance = 5e-4
    rate, seen = fit_rates(weighed, targets, total, tolerance=tolerance)
    last = seen[-1] if seen else {}
    if residuals is not None:
        residuals.update(last)
    if any(abs(x) >= tolerance for x in last.values()):
        warnings.warn(f"mixture misses its targets by these shares of all tokens: {last}", stacklevel=3)
    return rate


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, text: str = "text", max_labelled: int = 20_000, reuse: DataFrame | None = None, residuals: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate, copies) for every row of docs; copies rounds the rate by a hash of doc_id.

    Null text has no tokens and the classifier's prior as its posterior. reuse: documents for training, by default docs.
    residuals: a dict to fill with what each domain's expected tokens miss of its target, as a share of all tokens.
    """
    model = train_domains(docs if reuse is None else reuse, label_domains(labels), max_labelled, text)
    weighed = materialize(posteriors(docs.select("doc_id", text), model, text).select("doc_id", "n_tokens", "posterior"), "posteriors")
    rate = _fitted(weighed, targets or TARGETS, total, residuals)
    u = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return weighed.withColumn("rate", rate).withColumn("copies", (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, text: str = "text", max_copies: int | None = None, residuals: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, each as often as its copies; the columns of docs. residuals as in mixture().

    A row without an id takes part like any other, its copies are drawn by its text; rows that repeat both id and text have the
    same copies each. Null and empty texts have no tokens and stay at the classifier's prior. Columns of docs with any name
    pass through; empty docs give an empty result.
    """
    ours = docs.select("doc_id", text)
    model = train_domains(ours, label_domains(labels), text=text)
    weighed = posteriors(ours.withColumn("text_hash", F.xxhash64(text_of(text))), model, text)
    small = materialize(weighed.select("doc_id", "text_hash", "n_tokens", "posterior"), "posteriors")
    rate = _fitted(small, targets or TARGETS, None, residuals)
    drawn = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(5), "text_hash")).otherwise(F.xxhash64(F.lit(5), "doc_id"))
    u = F.pmod(drawn, F.lit(1 << 30)) / F.lit(float(1 << 30))
    counted = small.withColumn("rate", rate).select(F.col("doc_id").alias("_mix_id"), F.col("text_hash").alias("_mix_hash"), (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("_mix_copies")).where("_mix_copies > 0")
    if max_copies:
        counted = counted.withColumn("_mix_copies", F.least("_mix_copies", F.lit(max_copies)))
    counted = materialize(counted.dropDuplicates(["_mix_id", "_mix_hash"]), "copies")
    rows = docs.select(F.struct(*docs.columns).alias("_mix_row"), F.col("doc_id").alias("_mix_doc"), F.xxhash64(text_of(text)).alias("_mix_text"))
    joined = rows.join(counted, F.col("_mix_doc").eqNullSafe(F.col("_mix_id")) & (F.col("_mix_text") == F.col("_mix_hash")))
    return joined.select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select("_mix_row.*")


def op1_mixture_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", *[F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies")
