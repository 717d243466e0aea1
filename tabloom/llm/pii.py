"""Personal data by weak supervision (operator 7); DataFrame functions only.

Candidate spans come from patterns. Three labelers vote on each (1 yes, -1 no, 0 abstain): the exact
rules of its kind, a gazetteer, and its context. Votes are counted by pattern (a small table);
expectation-maximisation estimates how reliable each labeler is and how likely each pattern is, and a
logistic span classifier is trained on those likelihoods. Spans of the exact rules always stay; the
classifier adds others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_of

#: In the order in which spans with equal start are listed.
KINDS = ["email", "ip", "card", "phone"]
#: The same matches as of the plain patterns; possessive, and started only where a match can begin, so that long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Telephone numbers without a country code; only the classifier can add them.
NATIONAL = r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])"
#: What a text must hold before a pattern is tried on it.
NEEDS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]", "national": r"[0-9]{3}[ .-][0-9]{4}"}
#: Endings, leading digits or country codes that are in use (fixed values, public knowledge).
GAZETTEER = {"email": r"\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|us)$", "ip": r"^[1-9][0-9]{0,2}\.", "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)", "phone": r"^(?:\+(?:1|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|\()"}
#: Words just before a span that speak for its kind, and signs that speak against any (fixed values).
CUES = {"email": r"(?i)(?:e-?mail|mail|contact|write)\W{0,3}$", "ip": r"(?i)(?:\bip|address|host|server)\W{0,3}$", "card": r"(?i)(?:card|visa|credit|account|mastercard|amex)\W{0,3}$", "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell)\W{0,3}$"}
AGAINST = r"(?i)(?:version|ver|v|rev|isbn|section|no|#|=|/)[ .:]{0,2}$"


def _matches(text: Column, pattern: str, kind: str, need: str) -> Column:
    """[(start, kind, end, value)]: gaps and matches of the pattern alternate, so their lengths give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    row = "struct<start:int,kind:int,end:int,value:string>"
    empty = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{row}>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return F.when(text.rlike(need), F.aggregate(pairs, empty, step, lambda a: a["out"])).otherwise(F.expr(f"cast(array() as array<{row}>)"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: Column, value: Column) -> Column:
    """The exact rule of each kind on a match of its pattern."""
    parts = F.split(value, r"\.", -1)
    small = F.forall(parts, lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"), F.lit(False)))
    d = _digits(value)
    odd = F.reverse(d)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(odd, i, 1).cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(odd, i, 1).cast("int") + 1)),
    )
    card = F.when(F.length(d).between(14, 19), total % 10 == 0).otherwise(F.lit(False))
    phone = F.substring(value, 1, 1).eqNullSafe("+") & F.length(d).between(10, 15)
    return F.when(kind == 0, F.lit(True)).when(kind == 1, small).when(kind == 2, card).otherwise(phone)


def _by_kind(kind: Column, values: list[Column]) -> Column:
    out = values[-1]
    for k in range(len(values) - 2, -1, -1):
        out = F.when(kind == k, values[k]).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """Spans with the three votes: [(start, kind, end, rule, gaz, ctx, size)], by start and then kind."""
    spans = F.concat(*[_matches(text, PATTERNS[k], k, NEEDS[k]) for k in KINDS], _matches(text, NATIONAL, "phone", NEEDS["national"]))
    long_enough = F.filter(spans, lambda s: (s["kind"] != 2) | (F.length(_digits(s["value"])).between(12, 21)))

    def votes(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - 15, F.lit(1)), F.least(s["start"], F.lit(16)))
        gaz = _by_kind(s["kind"], [F.lower(s["value"]).rlike(GAZETTEER[k]) for k in KINDS])
        cue = _by_kind(s["kind"], [before.rlike(CUES[k]) for k in KINDS])
        return F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
            F.when(_valid(s["kind"], s["value"]), 1).otherwise(-1).alias("rule"),
            F.when(gaz, 1).otherwise(-1).alias("gaz"),
            F.when(cue, 1).when(before.rlike(AGAINST), -1).otherwise(0).alias("ctx"),
            F.length(_digits(s["value"])).alias("size"),
        )

    return F.array_sort(F.transform(long_enough, votes))


def vote_counts(spans: DataFrame, column: str = "spans") -> list[dict]:
    """How often each vote pattern occurs; at most 4 kinds x 2 x 2 x 3 x 23 sizes, whatever the input."""
    # Filters on the column itself would be pushed below it and compute it twice.
    x = spans.select(F.explode_outer(column).alias("x")).where("x is not null")
    rows = x.groupBy("x.kind", "x.rule", "x.gaz", "x.ctx", F.least("x.size", F.lit(22)).alias("size")).count().collect()
    return [r.asDict() for r in rows]


def _clip(p: float, low: float = 0.02, high: float = 0.98) -> float:
    return min(high, max(low, p))


def train(counts: list[dict], rounds: int = 50) -> dict:
    """Labeler reliabilities by EM over pattern counts, then a logistic classifier on the resulting likelihoods.

    counts empty: a model that adds nothing.
    """
    labelers = ("rule", "gaz", "ctx")
    rows = sorted(counts, key=lambda r: (r["kind"], r["rule"], r["gaz"], r["ctx"], r["size"]))
    prior = {k: 0.5 for k in range(len(KINDS))}
    # hit[labeler, kind]: chance of a yes among votes on a true span; false: among votes on others.
    hit = {(v, k): 0.8 for v in labelers for k in prior}
    false = {(v, k): 0.3 for v in labelers for k in prior}
    post = [0.5] * len(rows)
    for _ in range(rounds):
        for i, r in enumerate(rows):
            yes, no = math.log(_clip(prior[r["kind"]])), math.log(1 - _clip(prior[r["kind"]]))
            for v in labelers:
                if r[v]:
                    a, b = hit[v, r["kind"]], false[v, r["kind"]]
                    yes += math.log(a if r[v] > 0 else 1 - a)
                    no += math.log(b if r[v] > 0 else 1 - b)
            post[i] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
        for k in prior:
            mine = [(r, p) for r, p in zip(rows, post, strict=True) if r["kind"] == k]
            prior[k] = (sum(r["count"] * p for r, p in mine) + 1) / (sum(r["count"] for r, _ in mine) + 2)
            for v in labelers:
                on = [(r, p) for r, p in mine if r[v]]
                # A labeler is taken to be better than chance: that keeps the two classes from swapping.
                hit[v, k] = _clip((sum(r["count"] * p for r, p in on if r[v] > 0) + 4) / (sum(r["count"] * p for r, p in on) + 5), 0.5)
                false[v, k] = _clip((sum(r["count"] * (1 - p) for r, p in on if r[v] > 0) + 1) / (sum(r["count"] * (1 - p) for r, p in on) + 5), 0.02, 0.5)
    weights = [[0.0] * 6 for _ in KINDS]
    for k, w in enumerate(weights):
        mine = [(_inputs(r), p, r["count"]) for r, p in zip(rows, post, strict=True) if r["kind"] == k]
        total = sum(n for _, _, n in mine) or 1
        for _ in range(400 if mine else 0):
            g = [1e-3 * x for x in w]
            for x, p, n in mine:
                q = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(w, x, strict=True))))))
                for j, b in enumerate(x):
                    g[j] += n / total * (q - p) * b
            for j in range(len(w)):
                w[j] -= 0.5 * g[j]
        if not mine:
            w[0] = -9.0
    return {"weights": weights, "prior": prior, "hit": hit, "false": false}


def _inputs(r: dict) -> list[float]:
    """Bias, the votes, and whether the number of digits is one that the kind usually has."""
    usual = {0: True, 1: 4 <= r["size"] <= 12, 2: 15 <= r["size"] <= 16, 3: 10 <= r["size"] <= 12}[r["kind"]]
    return [1.0, float(r["rule"]), float(r["gaz"]), float(r["ctx"] > 0), float(r["ctx"] < 0), float(usual)]


def _score(model: dict, s: Column) -> Column:
    usual = _by_kind(s["kind"], [F.lit(True), s["size"].between(4, 12), s["size"].between(15, 16), s["size"].between(10, 12)])

    def logit(w: list[float]) -> Column:
        return F.lit(w[0]) + w[1] * s["rule"] + w[2] * s["gaz"] + w[3] * (s["ctx"] > 0).cast("int") + w[4] * (s["ctx"] < 0).cast("int") + w[5] * usual.cast("int")

    return 1 / (1 + F.exp(-_by_kind(s["kind"], [logit(w) for w in model["weights"]])))


def chosen(model: dict, column: str = "spans", threshold: float = 0.9) -> Column:
    """Exact spans, and those the classifier accepts that do not overlap one of the same kind."""
    exact = F.filter(column, lambda s: s["rule"] == 1)
    more = F.filter(column, lambda s: (s["rule"] != 1) & (_score(model, s) >= threshold) & ~F.exists(exact, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.array_sort(F.concat(exact, more))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, text: str = "text", threshold: float = 0.9) -> DataFrame:
    """docs without its text, plus base (exact spans) and spans (all), each [(start, kind, end, ...)] in code points.

    Null text has no spans. Each row is handled by itself, repeated rows and rows without an id too; empty input gives an empty
    result. Columns of docs called spans or base are replaced, all others stay.
    """
    found = materialize(docs.withColumn("spans", candidates(text_of(text))).drop(text), "pii")
    model = train(vote_counts(found))
    return found.withColumn("base", F.filter("spans", lambda s: s["rule"] == 1)).withColumn("spans", chosen(model, "spans", threshold))


def mask_pii(docs: DataFrame, text: str = "text", threshold: float = 0.9) -> DataFrame:
    """docs with every found span replaced by its kind in brackets; same rows and columns, whatever their names, null text stays null."""
    model = train(vote_counts(docs.select(candidates(text_of(text)).alias("spans"))))
    names = docs.columns
    df = docs.select(F.struct(*names).alias("_row"), F.col(text).alias("_text"))
    df = df.withColumn("_found", candidates(text_of("_text"))).withColumn("_spans", chosen(model, "_found", threshold))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        inside = s["start"] < a["at"]
        put = F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, s["start"] - a["at"]), F.get(tags, s["kind"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["out"]).otherwise(put).alias("out"))

    masked = F.aggregate("_spans", zero, step, lambda a: F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, F.length("_text"))))
    result = F.when(F.col("_text").isNull() | (F.size("_spans") == 0), F.col("_text")).otherwise(masked)
    return df.withColumn("_masked", result).select(*[F.col("_masked").alias(c) if c == text else F.col("_row")[c].alias(c) for c in names])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
