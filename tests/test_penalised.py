import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.plans import gram as G
from tabloom.plans import penalised as P


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6)) @ (np.eye(6) + 0.3 * rng.normal(size=(6, 6))) + 5
    y = x @ np.array([2.0, 2.0, 0, 0, -1.5, 0.1]) + rng.normal(size=300) + 7
    xc, yc = x - x.mean(axis=0), y - y.mean()
    return x, y, xc, yc, G.Gram(list("abcdef"), 300.0, x.mean(axis=0), float(y.mean()), xc.T @ xc, xc.T @ yc, float(yc @ yc))


def _beats_neighbours(loss, w, rng=None):
    """No small move, along axes, groups or at random, lowers the loss: enough for a convex loss."""
    rng, best = np.random.default_rng(0), loss(w)
    for size in (1e-2, 1e-3, 1e-4):
        for move in [*np.eye(len(w)), *rng.normal(size=(3000, len(w))), *[np.where(m, 1.0, 0.0) * rng.choice([-1, 1], len(w)) for m in rng.random((500, len(w))) < 0.5], np.ones(len(w))]:
            for s in (size, -size):
                assert loss(w + s * move) >= best - 1e-10
    return best


@pytest.mark.parametrize("alpha", [0.02, 0.3, 1.5])
def test_group_and_fused_penalties(data, alpha):
    x, y, xc, yc, g = data
    square = lambda w: ((yc - xc @ w) ** 2).sum() / 600
    groups = lambda w, k: sum(len(w[i : i + k]) ** 0.5 * np.linalg.norm(w[i : i + k]) for i in range(0, 6, k))
    for k in (2, 4):
        m = P.group_lasso(g, alpha, k)
        _beats_neighbours(lambda w, k=k: square(w) + alpha * groups(w, k), m.coefficients)
    m = P.sparse_group_lasso(g, alpha, 0.5, 2)
    _beats_neighbours(lambda w: square(w) + alpha * (0.5 * np.abs(w).sum() + 0.5 * groups(w, 2)), m.coefficients)
    assert m.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ m.coefficients)
    assert P.sparse_group_lasso(g, alpha, 1.0).coefficients == pytest.approx(G.lasso(g, alpha).coefficients, abs=1e-7)
    m = P.fused_lasso(g, alpha, 0.4)
    _beats_neighbours(lambda w: square(w) + alpha * np.abs(w).sum() + 0.4 * np.abs(np.diff(w)).sum(), m.coefficients)
    assert P.fused_lasso(g, alpha, 0.0).coefficients == pytest.approx(G.lasso(g, alpha).coefficients, abs=1e-7)
    assert not P.fused_lasso(g, 1e4, 1.0).coefficients.any() and not P.group_lasso(g, 1e4).coefficients.any()


def test_fused_weights_are_equal_in_runs(data):
    w = P.fused_lasso(data[4], 0.01, 0.8).coefficients
    assert (np.diff(w) == 0).any() and len(set(w)) > 1


def test_paths(data):
    g = data[4]
    turns = P.equiangular_path(g, lasso=True)
    for a, w in turns:
        c = np.abs(g.xy - g.xx @ w) / g.n
        assert c.max() == pytest.approx(a, abs=1e-9) and c[w != 0] == pytest.approx(np.full((w != 0).sum(), a), abs=1e-9)
    assert turns[-1][1] == pytest.approx(G.ols(g).coefficients)
    for alpha in (0.001, 0.05, 0.4, 2.0, 99.0):
        assert P.lasso_lars(g, alpha).coefficients == pytest.approx(G.lasso(g, alpha).coefficients, abs=1e-6)
    for size in range(7):
        assert np.count_nonzero(P.lars(g, size).coefficients) == size
    # A path where a weight returns to 0, and a feature that repeats another.
    rng = np.random.default_rng(3)
    for _ in range(40):
        a = rng.normal(size=(12, 5)) @ rng.normal(size=(5, 5))
        b = rng.normal(size=12)
        h = G.Gram(list("abcde"), 12.0, np.zeros(5), 0.0, a.T @ a, a.T @ b, float(b @ b))
        assert P.equiangular_path(h, lasso=True)[-1][1] == pytest.approx(np.linalg.lstsq(a, b, rcond=None)[0], rel=1e-4, abs=1e-6)
        alpha = np.abs(a.T @ b).max() / 12 * rng.random()
        w = P.lasso_lars(h, alpha).coefficients
        c = (h.xy - h.xx @ w) / 12
        assert np.abs(c).max() <= alpha * (1 + 1e-6) and c[w != 0] == pytest.approx(alpha * np.sign(w[w != 0]), rel=1e-6)
    twice = np.ix_([0, 1, 2, 2], [0, 1, 2, 2])
    t = P.equiangular_path(G.Gram(list("abcd"), g.n, np.zeros(4), 0.0, g.xx[twice], g.xy[[0, 1, 2, 2]], g.yy))
    assert np.isfinite(t[-1][1]).all()


def test_scad_ard_pls_and_subset(data):
    x, y, xc, yc, g = data
    m = P.scad(g, 0.3)

    def loss(w, alpha=0.3, gamma=3.7):
        a = np.abs(w)
        return ((yc - xc @ w) ** 2).sum() / 600 + np.where(a <= alpha, alpha * a, np.where(a <= gamma * alpha, (2 * gamma * alpha * a - a * a - alpha**2) / (2 * gamma - 2), alpha**2 * (gamma + 1) / 2)).sum()

    for j in range(6):  # each coordinate is at its global minimum
        assert all(loss(np.where(np.arange(6) == j, v, m.coefficients)) >= loss(m.coefficients) - 1e-10 for v in np.linspace(-4, 4, 801))
    on = np.abs(m.coefficients) > 3.7 * 0.3
    assert on.sum() == 3 and m.coefficients[on] == pytest.approx(np.linalg.lstsq(xc[:, m.coefficients != 0], yc, rcond=None)[0][on[m.coefficients != 0]], abs=1e-6)
    a = P.ard(g).coefficients
    assert np.abs(a[2:4]).max() < 0.1 and np.abs(a[[0, 1, 4]] - [2, 2, -1.5]).max() < 0.3
    assert P.pls(g, 6).coefficients == pytest.approx(G.ols(g).coefficients, rel=1e-6)
    # Components by deflating the rows themselves.
    size = x.std(axis=0, ddof=1)
    e, f, w = xc / size, yc.copy(), np.zeros(300)
    for _ in range(2):
        t = e @ (e.T @ f / np.linalg.norm(e.T @ f))
        w, f, e = w + t * (t @ f) / (t @ t), f - t * (t @ f) / (t @ t), e - np.outer(t, t @ e) / (t @ t)
    assert xc @ P.pls(g, 2).coefficients == pytest.approx(w, abs=1e-8)
    full = G.best_subset(g, 6)
    assert np.count_nonzero(full.coefficients) == 6 and np.count_nonzero(G.best_subset(g, 6, alpha=0.2).coefficients) == 3 and not G.best_subset(g, 6, alpha=1e3).coefficients.any()


def test_wide_grams(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 121)) + 1000
    rows = [(None if i % 7 == 0 else f"g{i % 3}", None if i == 5 else [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "f string, v array<double>").repartition(3).select("f", *[F.get("v", F.lit(i)).alias(f"x{i}") for i in range(121)])
    features = [f"x{i}" for i in range(120)]
    got = G.grams(df, features, "x120", "f")
    for group in ("g0", "g1", "g2", None):
        z = np.array([r for i, (r, q) in enumerate(zip(x, rows, strict=True)) if q[0] == group and i != 5])
        c = z - z.mean(axis=0)
        g = got[group]
        assert g.n == len(z) and g.mean == pytest.approx(z[:, :-1].mean(axis=0)) and g.xx == pytest.approx(c[:, :-1].T @ c[:, :-1], abs=1e-6) and g.xy == pytest.approx(c[:, :-1].T @ c[:, -1], abs=1e-6) and g.yy == pytest.approx(c[:, -1] @ c[:, -1])
    assert list(G.grams(df, features, "x120")) == [None] and G.grams(df.where("f = 'no'"), features, "x120") == {}
