import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import factors


def _frame(spark, x, extra=()):
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + list(extra)
    names = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame(rows, "key long, " + ", ".join(f"{n} double" for n in names)).repartition(4), names


def test_nmf_loss_falls_and_rows_solve_their_least_squares(spark):
    rng = np.random.default_rng(3)
    w0, h0 = rng.gamma(0.6, size=(300, 2)), np.array([[1.0, 2, 0, 0, 1], [0, 0, 3, 1, 1]])
    x = w0 @ h0 + 0.01 * rng.random((300, 5))
    df, names = _frame(spark, x, [(900, None, 1.0, 1.0, 1.0, 1.0), (901, float("nan"), 1.0, 1.0, 1.0, 1.0)])
    m = factors.nmf(df, names, 2, steps=60)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(m.trace, m.trace[1:], strict=False))
    h = np.array(m.components)
    assert (h >= 0).all() and m.trace[-1] < 0.001 * (x * x).sum()
    out = {r.key: [r.factor0, r.factor1] for r in m.transform(df).collect()}
    assert out[900] == [None, None] and out[901] == [None, None] and len(out) == 302
    w = np.array([out[i] for i in range(300)])
    assert ((x - w @ h) ** 2).sum() == pytest.approx(m.trace[-1], rel=1e-6)
    slope = (w @ h - x) @ h.T  # optimality of each row: no slope where w > 0, none downwards at 0
    assert np.abs(slope[w > 1e-9]).max() < 1e-6 and slope[w <= 1e-9].min(initial=0) > -1e-6
    # The planted components come back up to scale and order.
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    assert (unit(h) @ unit(h0).T).max(axis=0).min() > 0.98
    with pytest.raises(ValueError, match="at least 0"):
        factors.nmf(df.withColumn("x0", -F.col("x0")), names, 2)
    with pytest.raises(ValueError, match="from 1 to 5"):
        factors.nmf(df, names, 6)
    with pytest.raises(ValueError, match="no rows"):
        factors.nmf(df.where("key < 0"), names, 2)


def test_fast_ica_finds_the_sources(spark, tmp_path):
    rng = np.random.default_rng(5)
    s = np.column_stack([rng.uniform(-1, 1, 2000), rng.laplace(size=2000), np.sign(rng.normal(size=2000)) + 0.05 * rng.normal(size=2000)])
    x = s @ np.array([[1.0, 0.5, 0.2], [0.3, 1.0, -0.4], [0.8, -0.2, 1.0]]) + [5, -3, 100]
    df, names = _frame(spark, x, [(9000, None, 0.0, 0.0)])
    m = factors.fast_ica(df, names)
    m.save(df, str(tmp_path / "ica"))
    m = factors.load_factors(df, str(tmp_path / "ica"))
    got = np.array([[r.factor0, r.factor1, r.factor2] for r in m.transform(df).where("key < 9000").orderBy("key").collect()])
    match = np.abs(np.corrcoef(got.T, s.T)[:3, 3:])
    assert match.max(axis=0).min() > 0.99 and sorted(match.argmax(axis=0)) == [0, 1, 2]
    assert got.std(axis=0) == pytest.approx(np.ones(3), abs=1e-6)
    assert got @ np.array(m.components) + m.mean == pytest.approx(x, abs=1e-6)
    assert m.transform(df).where("key = 9000").first().factor0 is None
    with pytest.raises(ValueError, match="directions"):
        factors.fast_ica(df.withColumn("x1", F.col("x0") * 2), names)


def test_factor_analysis_recovers_loadings_and_noise(spark):
    rng = np.random.default_rng(7)
    load = np.array([[2.0, 1.5, 1.0, 0.0, 0.0, 0.2], [0.0, 0.0, 0.3, 1.0, 2.0, 1.0]])
    noise = np.array([0.3, 0.5, 1.0, 0.4, 0.6, 0.8])
    x = rng.normal(size=(6000, 2)) @ load + rng.normal(size=(6000, 6)) * np.sqrt(noise)
    df, names = _frame(spark, x)
    m = factors.factor_analysis(df, names, 2)
    assert all(b >= a - 1e-10 for a, b in zip(m.trace, m.trace[1:], strict=False))
    got = np.array(m.components)
    assert got.T @ got == pytest.approx(load.T @ load, abs=0.25)  # loadings are known up to a rotation
    assert m.noise == pytest.approx(noise, abs=0.12)
    row = m.transform(df).where("key = 3").first()
    b = got @ np.linalg.inv(got.T @ got + np.diag(m.noise))
    assert [row.factor0, row.factor1] == pytest.approx(b @ (x[3] - x.mean(axis=0)))


@pytest.mark.parametrize("h", [[[1.0, 2.0, 0.5]], [[1.0, 2.0, 0.5], [2.0, 0.1, 1.0]], [[1.0, 2.0, 0.5], [2.0, 4.0, 1.0], [0.0, 0.0, 0.0]], [[1.0, 0.9, 0.2], [0.8, 1.0, 0.1], [0.0, 0.2, 3.0]]])
def test_nonnegative_rows_of_few_components_need_no_sweeps(h, monkeypatch):
    x, h = np.random.default_rng(2).normal(0.4, 1.0, (500, 3)), np.array(h)
    loss = lambda w: ((x - w @ h) ** 2).sum(axis=1)
    monkeypatch.setattr(factors, "FEW", 0)
    slow = factors._nonnegative_rows(x, h)
    monkeypatch.setattr(factors, "FEW", 3)
    monkeypatch.setattr(factors, "SWEEPS", 0)
    fast = factors._nonnegative_rows(x, h)
    assert (fast >= 0).all() and loss(fast) == pytest.approx(loss(slow), abs=1e-8) and (loss(fast) <= loss(slow) + 1e-9).all()
    if np.linalg.matrix_rank(h) == len(h):
        assert fast == pytest.approx(slow, abs=1e-6)


def test_rows_are_packed_for_the_passes(spark):
    x = np.random.default_rng(4).normal(size=(1000, 3))
    df, names = _frame(spark, x, [(1000, None, 1.0, 1.0)])
    rows = factors._rows(df, names)
    assert rows.count() < 40
    assert factors._sums(rows, lambda v: np.append(v.sum(axis=0), len(v)), ()) == pytest.approx([*x.sum(axis=0), 1000.0])
    assert not len(factors._sums(factors._rows(df.where("key < 0"), names), lambda v: v.sum(axis=0), ()))
