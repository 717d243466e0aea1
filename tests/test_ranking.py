import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import metrics, ranking


def _slow_pairs(rows):
    return sorted((q, a, b) for q, a, x in rows for r, b, y in rows if q is not None and q == r and x is not None and y is not None and x > y)


def test_pairs_are_all_pairs_of_small_queries(spark):
    rng = np.random.default_rng(1)
    rows = [(f"q{q}", i, float(rng.integers(0, 3))) for q, n in enumerate((1, 2, 3, 4, 9, 10, 21)) for i in range(n)]
    rows += [(None, 1, 1.0), (None, 2, 2.0), ("q3", 90, None), ("q3", 91, float("nan")), ("same", 1, 2.0), ("same", 2, 2.0)]
    df = spark.createDataFrame(rows, "q string, i long, rel double").withColumn("x", F.col("i") * 2)
    got = ranking.query_pairs(df, "q", "rel", "i", ["x"], opponents=10).collect()
    known = [(q, i, None if r is None or r != r else r) for q, i, r in rows]
    assert sorted((r.query, r.better, r.worse) for r in got) == _slow_pairs(known)
    assert all(r.a_x == 2 * r.better and r.b_x == 2 * r.worse for r in got)
    for q in {r.query for r in got}:
        assert sum(r.weight for r in got if r.query == q) == pytest.approx(1.0)
    assert ranking.query_pairs(df.where("i < 0"), "q", "rel", "i", ["x"]).count() == 0


def test_pairs_of_a_large_query_grow_with_its_rows(spark):
    df = spark.range(20000).selectExpr("'hot' as q", "id as i", "cast(id as double) as rel")
    pairs = ranking.query_pairs(df, "q", "rel", "i", [], opponents=3)
    assert pairs.count() == 60000 and pairs.select("better", "worse").distinct().count() == 60000 and pairs.where("better <= worse").count() == 0
    ends = pairs.select(F.explode(F.array("better", "worse")).alias("i")).groupBy("i").count()
    assert ends.where("count <> 6").count() == 0 and ends.count() == 20000


def test_ranker_is_at_the_optimum_and_orders_by_relevance(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3)) + np.repeat(rng.normal(size=(60, 3)) * 10, 10, axis=0)  # queries differ far more than their rows
    inside = x - np.repeat(x.reshape(60, 10, 3).mean(axis=1), 10, axis=0)
    rel = np.digitize(2 * inside[:, 0] - inside[:, 1] + 0.3 * rng.normal(size=600), [-1.5, 0, 1.5])
    rows = [(i, i // 10, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, rel, strict=True))]
    df = spark.createDataFrame([*rows, (900, 3, None, 1.0, 1.0, 2)], "key long, q long, a double, b double, c double, rel int").repartition(4)
    m = ranking.pairwise_ranker(df, ["a", "b", "c"], "rel", "q", "key", alpha=0.01)
    m.save(df, str(tmp_path / "r"))
    m = ranking.load_ranker(df, str(tmp_path / "r"))
    w, slope, weight = np.array(m.coefficients), 0.01 * np.array(m.coefficients), 0.0
    pairs = [(p.better, p.worse, p.weight) for p in ranking.query_pairs(df, "q", "rel", "key", []).collect() if 900 not in (p.better, p.worse)]
    total = sum(p[2] for p in pairs)
    for i, j, weight in pairs:
        d = x[i] - x[j]
        slope = slope - weight / total / (1 + np.exp(d @ w)) * d
    assert np.abs(slope).max() < 1e-4 and w[0] > 0 > w[1] and abs(w[2]) < 0.2 * w[0]
    assert all(b <= a for a, b in zip(m.trace, m.trace[1:], strict=False))
    scored = m.transform(df)
    assert scored.where("key = 900").first().score is None
    out = scored.where("score is not null")
    ndcg = lambda c: metrics.ranking_metrics(out.withColumn("s", c), "q", "rel", "s", "key").first()["ndcg"]
    assert ndcg(F.col("score")) > 0.95 > ndcg(F.xxhash64("key").cast("double")) + 0.1
    with pytest.raises(ValueError, match="no pair"):
        ranking.pairwise_ranker(df.withColumn("rel", F.lit(1)), ["a"], "rel", "q", "key")
    with pytest.raises(ValueError, match="alpha"):
        ranking.pairwise_ranker(df, ["a"], "rel", "q", "key", alpha=0.0)


def test_ranker_reads_equal_differences_once(spark, monkeypatch):
    seen, sums = [], ranking._sums
    monkeypatch.setattr(ranking, "_sums", lambda rows, *a: (seen.append(rows.count()), sums(rows, *a))[1])
    df = spark.range(4000).selectExpr("id as key", "id div 4 as q", "cast(id % 4 as double) as a", "cast(id * 7 % 3 as double) as b", "cast(hash(id) % 3 as double) as rel")
    m = ranking.pairwise_ranker(df, ["a", "b"], "rel", "q", "key")
    assert max(seen) <= 7 * 5 and len(m.coefficients) == 2
