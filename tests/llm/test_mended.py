"""Labels of any type, clashing names and crowded ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import lm, mixing, vectors


def test_labels_of_any_type_are_told_apart(spark):
    v = [1.0, 0.5, 0.25]
    for labels, kind in (([1.2, 1.7, 1.2, None, 0.0, -0.0], "double"), (["a", "b", "a", None, "c", "c"], "string"), ([True, False, True, None, None, False], "boolean")):
        df = spark.createDataFrame([(i, v, x, i, 0) for i, x in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}, key int, n_links int")
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
        for i, x in enumerate(labels):
            same = [j for j, y in enumerate(labels) if x is not None and y == x] or [i]
            assert got[i] == (len(same) - 1, same[0], i == same[0])
    huge = spark.createDataFrame([(i, [1e300 * (1 + i % 2), 1e300], "a") for i in range(8)], "vec_id long, embedding array<double>, label string")
    assert {r.n_links for r in vectors.near_duplicates(huge).collect()} == {7}


def test_rows_without_ids_do_not_share_one_block(spark):
    df = spark.createDataFrame([(None, f"word{i} and other words {i % 7}", "x", 1.0) for i in range(300)], "doc_id long, text string, block string, score double")
    out = lm.score_documents(df)
    assert out.count() == 300 and out.where("score < 0 and base_score < 0").count() == 300
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(32))
    assert df.select(block.alias("b")).distinct().count() > 20
    assert lm.score_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.0, 0.2])
def test_rates_reach_what_least_squares_reaches(spark, least):
    """Against projected gradient steps over all rates in numpy; with least, targets are out of reach."""
    rng = np.random.default_rng(3)
    tokens = rng.integers(50, 500, 300)
    p = rng.dirichlet([0.4, 0.3, 0.2], 300) * (1 - least) + least / 3
    weighed = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(tokens, p, strict=True)], "n_tokens long, posterior array<double>").cache()
    targets, total = {mixing.DOMAINS[0]: 0.9, mixing.DOMAINS[1]: 0.1}, float(tokens.sum())
    rate, seen = mixing.fit_rates(weighed, targets, total, unused=1.0)
    a = (p * tokens[:, None]).T / total
    goal = np.array([targets.get(d, 0.0) for d in mixing.DOMAINS])
    r, inverse = np.ones(300), np.linalg.inv(a @ a.T + 1e-12 * np.eye(3))
    for _ in range(20_000):
        r = np.maximum(0, r - 0.5 * a.T @ (inverse @ (a @ r - goal)))
    best = a @ r - goal
    ours = a @ np.array([x[0] for x in weighed.select(rate.alias("r")).collect()]) - goal
    assert ours @ ours <= best @ best + 2e-3
    assert [seen[-1][d] for d in mixing.DOMAINS] == pytest.approx(ours.tolist(), abs=1e-9)
