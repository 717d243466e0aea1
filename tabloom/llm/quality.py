"""Quality rules with risk-controlled thresholds (operator 9); DataFrame functions only.

Base rules work on words ``[^\\x20\\x09-\\x0D]+``. On top of them, each rule of ``RULES`` has a ladder of
cutoffs fixed in advance. Good labelled documents form the holdout. Within a stratum one sequence of sets of
cutoffs is tested, rule after rule and each from its mildest cutoff to its strictest: a set is certified if the exact
(Clopper-Pearson) upper bound on the share of good documents that all its cutoffs together reject is within alpha.
Rules go in the order of how many labelled low documents their strictest cutoff rejects, which does not look at the
holdout. A fixed sequence needs no correction until its first failure; what follows failures is tested at a share of
the error probability divided by the number of ways to come there. Strata share it evenly; those with too few good
labelled documents for a certificate of their own share a coarser one, that of all strata without a name.
"""

from __future__ import annotations

import logging
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_of, words_of

#: rule -> cutoffs from the mildest to the strictest; a document is rejected when its value is at or above the cutoff.
RULES = {
    "upper_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "symbol_share": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05],
    "repeat_share": [0.2, 0.19, 0.17, 0.15, 0.12, 0.1, 0.07, 0.05],
    "bang_share": [0.9, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
}
MAX_STRATA = 32
log = logging.getLogger(__name__)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of the base rules and the values of RULES.

    Null text counts as no words; every share of a text without words is 0. Repeated rows are
    treated row by row. Columns of docs stay, unless one of ours has the same name, which replaces it.
    """
    t = text_of(text)
    df = docs.withColumn("_t", t).withColumn("_w", words_of(F.col("_t")))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    gram = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 5, F.lit(0)).cast("int")), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(5)]))
    df = df.withColumn("_g", F.when(F.col("n_words") > 5, gram))
    df = df.withColumn("_again", F.coalesce(F.size(F.array_distinct("_g")) < F.size("_g"), F.lit(False)))
    pairs = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.col("_again"), pairs))
    seen = F.transform(
        "_s",
        lambda x, j: F.when((x["g"] == F.get("_s", j - 1)["g"]) | (x["g"] == F.get("_s", j + 1)["g"]), x["i"]),
    )
    at = F.sort_array(F.filter(seen, lambda i: i.isNotNull()))
    zero = F.struct(F.lit(-9).cast("int").alias("last"), F.lit(0).cast("int").alias("n"))
    covered = F.aggregate(at, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")), lambda a: a["n"])
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern))
    df = df.withColumns({"word_chars": F.length(F.array_join("_w", "")).cast("long"), "n_symbols": count("[#*$%&|<>]").cast("long"), "_l": lines})
    df = df.withColumns({
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.coalesce(F.when(F.col("_again"), covered), F.lit(0)).cast("long"),
        "_upper": count("[A-ZÀ-ÖØ-Þ]"),
        "_bang": F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit(""))),
    })
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return df.withColumns({
        "upper_share": share(F.col("_upper"), F.col("word_chars")),
        "symbol_share": share(F.col("n_symbols"), F.col("word_chars")),
        "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
        "bang_share": share(F.col("_bang"), F.col("n_words")),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    }).drop("_t", "_w", "_g", "_again", "_s", "_l", "_upper", "_bang")


def upper_bound(k: int, n: int, delta: float) -> float:
    """The Clopper-Pearson bound: the largest share under which k or fewer of n still has probability delta."""
    if n <= 0 or k >= n:
        return 1.0

    def tail(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and tail(mid) > delta else (low, mid)
    return high


#: Share of a stratum's error probability for the sequence up to its first failure; the rest is for what follows failures.
MAIN = 0.9


def _needed(alpha: float, delta: float) -> int:
    """Good documents without which not even a set that rejects none of them is certified."""
    return math.ceil(math.log(MAIN * delta) / math.log1p(-alpha))


def _own_strata(sizes: list[tuple[str, int]], total: int, alpha: float, delta: float) -> list[str]:
    """As many of the largest strata as leave each of them, and the rest together, enough good documents; sizes fall."""
    for m in range(len(sizes), 0, -1):
        rest = total - sum(n for _, n in sizes[:m])
        if min([n for _, n in sizes[:m]] + [rest] * (rest > 0)) >= _needed(alpha, delta / (m + (rest > 0))):
            return [s for s, _ in sizes[:m]]
    return []


def _certify(by: dict[tuple[int, ...], int], order: list[int], alpha: float, delta: float) -> tuple[dict[str, float], int, float | None]:
    """(cutoffs, good documents they reject, its upper bound) of one stratum. by: documents for each tuple of steps, in the order of RULES."""
    names, n = list(RULES), sum(by.values())
    # A sequence after a failure starts at the cutoffs reached by the rules before: at most that many starts.
    starts = sum(len(RULES[names[order[i]]]) * math.prod(len(RULES[names[r]]) + 1 for r in order[:i]) for i in range(len(order) - 1))
    reached = [0] * len(names)
    level, lost, bound = MAIN * delta, 0, None
    for r in order:
        for j in range(1, len(RULES[names[r]]) + 1):
            to = [*reached[:r], j, *reached[r + 1 :]]
            k = sum(v for steps, v in by.items() if any(0 < t <= x for t, x in zip(to, steps, strict=True)))
            u = upper_bound(k, n, level)
            if u > alpha:
                level = (1 - MAIN) * delta / max(1, starts)
                break
            reached, lost, bound = to, k, u
    return {names[r]: RULES[names[r]][reached[r] - 1] for r in order if reached[r]}, lost, bound


def certificates(feats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05, doc_id: str = "doc_id", quality: str = "quality") -> list[dict]:
    """One report for each stratum: stratum, good (labelled documents that pass the base rules), delta, cutoffs (rule -> certified
    cutoff), rejected (good documents that these reject), bound (of the share of good documents they reject; None without cutoffs).

    With probability 1 - delta, the certified cutoffs of every stratum reject at most alpha of its good documents. The stratum ''
    is coarser: it stands for all documents without a stratum of their own in the list, which are null, too small, or beyond the
    MAX_STRATA largest, and its share of good documents is that over all of them together. A document with several labels counts
    once, as good if any label says so. Rules that cannot be certified are left out.
    """
    known = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(quality).alias("_q"))
    held = feats.where(~F.col("base_failed")).join(known, F.col(doc_id) == F.col("_id"))
    steps = [sum(((F.col(r) >= c).cast("int") for c in cuts), F.lit(0)).alias(r) for r, cuts in RULES.items()]
    counts = materialize(held.select((F.col("_q") == 1).alias("good"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("s"), *steps).groupBy("good", "s", *RULES).count(), "steps")
    low = counts.where("not good").agg(*[F.sum(F.when(F.col(r) >= len(cuts), F.col("count"))).alias(r) for r, cuts in RULES.items()]).first()
    order = sorted(range(len(RULES)), key=lambda i: -(low[i] or 0))
    good = counts.where("good")
    total = good.agg(F.sum("count")).first()[0] or 0
    sizes = good.where("s <> ''").groupBy("s").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "s").limit(MAX_STRATA).collect()
    own = _own_strata([(r["s"], r["n"]) for r in sizes], total, alpha, delta)
    named = F.when(F.col("s").isin(*own), F.col("s")).otherwise(F.lit("")) if own else F.lit("")
    # At most one row for each tuple of steps in each of MAX_STRATA + 1 strata.
    by: dict[str, dict[tuple[int, ...], int]] = {}
    for r in good.groupBy(named.alias("s"), *RULES).agg(F.sum("count").alias("n")).collect():
        by.setdefault(r["s"], {})[tuple(r[x] for x in RULES)] = r["n"]
    out = []
    for s in sorted(by):
        cutoffs, lost, bound = _certify(by[s], order, alpha, delta / len(by))
        out.append({"stratum": s, "good": sum(by[s].values()), "delta": delta / len(by), "cutoffs": cutoffs, "rejected": lost, "bound": bound})
        log.info("certified quality rules: %s", out[-1])
    return out


def calibrate(feats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05, doc_id: str = "doc_id", quality: str = "quality") -> dict[str, dict[str, float]]:
    """stratum -> rule -> certified cutoff, as certificates() reports them."""
    return {c["stratum"]: c["cutoffs"] for c in certificates(feats, labels, stratum, alpha, delta, doc_id, quality)}


def verdict(cutoffs: dict[str, dict[str, float]], stratum: str = "lang", prefix: str = "") -> Column:
    """True where no certified rule of the document's stratum rejects it: its own stratum if that has a name in cutoffs, else ''."""
    s = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    names = [name for name in cutoffs if name]
    within = lambda name: s == name if name else ~s.isin(*names) if names else F.lit(True)
    hit = [within(name) & reduce(lambda a, b: a | b, [F.col(prefix + r) >= c for r, c in rules.items()]) for name, rules in cutoffs.items() if rules]
    return ~reduce(lambda a, b: a | b, hit) if hit else F.lit(True)


def _inputs(docs: DataFrame, stratum: str, text: str, *more: Column) -> DataFrame:
    """doc_id, text and stratum of docs (null where docs has no such column), and more."""
    s = F.col(stratum).cast("string") if stratum in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", F.col(text).alias("text"), s.alias(stratum), *more)


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05, text: str = "text") -> DataFrame:
    """doc_id, stratum, all counts and rule values, base_failed and kept, one row per row of docs; other columns are not read.

    Rows without an id or without a label are judged like all others, they only do not take part in the calibration.
    """
    numbers = materialize(features(_inputs(docs, stratum, text)).drop("text"), "quality")
    cutoffs = calibrate(numbers, labels, stratum, alpha, delta)
    return numbers.withColumn("kept", ~F.col("base_failed") & verdict(cutoffs, stratum))


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs as they are, whatever their names; texts are read twice instead of being stored again."""
    used = ["doc_id", stratum, "base_failed", *RULES]
    cutoffs = calibrate(materialize(features(_inputs(docs, stratum, text)).select(*used), "quality"), labels, stratum, alpha, delta)
    feats = features(_inputs(docs, stratum, text, F.struct(*docs.columns).alias("_row")))
    # A filter on computed columns would be pushed below them and compute them once for each mention; a generator stops that.
    row = F.explode(F.array(F.struct(*[F.col(c).alias(f"_f_{c}") for c in used[1:]]))).alias("_f")
    kept = feats.select("_row", row).select("_row", "_f.*")
    passed = kept.where(~F.col("_f_base_failed") & verdict(cutoffs, f"_f_{stratum}", "_f_"))
    return passed.select("_row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return apply_rules(docs, table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
