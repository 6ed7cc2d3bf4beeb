"""NumPy kernels against dense solves, row-by-row twins and invariants."""

import numpy as np
import pytest

from chronoraster.functions import gridkernel, prototypes, spikekernel
from chronoraster.functions import whittaker as W


def dense(y, lam, w):
    d = np.diff(np.eye(len(y)), 2, axis=0)
    return np.linalg.solve(np.diag(w) + lam * d.T @ d, w * y)


@pytest.mark.parametrize("n", [4, 5, 30, 158])
def test_fixed_penalty_equals_dense_solve(n):
    rng = np.random.default_rng(n)
    y, w = rng.normal(size=(n, 5)), (rng.random((n, 5)) > 0.2).astype(float)
    w[:2] = 1
    for lam in (0.1, 10.0):
        z = W.ws2d(y, lam, w)
        for k in range(5):
            assert np.allclose(z[:, k], dense(y[:, k], lam, w[:, k]), atol=1e-9)


def test_line_is_a_fixed_point_and_short_series_raise():
    y = 2 + 3 * np.arange(20.0)[:, None]
    assert np.allclose(W.ws2d(y, 100.0, np.ones_like(y)), y)
    with pytest.raises(ValueError):
        W.ws2d(y[:3], 1.0, np.ones((3, 1)))


def test_symmetric_envelope_is_double_penalty():
    y = np.random.default_rng(1).normal(size=(40, 3))
    w = np.ones_like(y)
    assert np.allclose(W.ws2dp(y, 10.0, w, 0.5), W.ws2d(y, 20.0, w))


def slow_vcurve_p(y, w, llas, p):
    """One series, step by step."""

    def env(lam, z):
        for _ in range(10):
            new = dense(y, lam, w * np.where(y > z, p, 1 - p))
            if np.abs(new - z).sum() == 0:
                break
            z = new
        return z

    z, fits, pens = np.zeros_like(y), [], []
    for x in llas:
        z = env(10**x, z)
        fits.append(np.log(((w * (y - z)) ** 2).sum()))
        pens.append(np.log((np.diff(z, 2) ** 2).sum()))
    v = np.hypot(np.diff(fits), np.diff(pens)) / (np.log(10) * (llas[1] - llas[0]))
    k = int(np.argmin(v))
    opt = 10 ** ((llas[k] + llas[k + 1]) / 2)
    return env(opt, np.zeros_like(y)), opt


def test_asymmetric_vcurve_equals_slow_twin():
    rng = np.random.default_rng(3)
    y = np.sin(np.arange(40) / 5)[:, None] + rng.normal(0, 0.2, (40, 4))
    w = np.ones_like(y)
    w[7] = 0
    z, opt = W.ws2doptvp(y, w, W.AUTO_RANGES[0], 0.9)
    for k in range(4):
        zk, ok = slow_vcurve_p(y[:, k], w[:, k], W.AUTO_RANGES[0], 0.9)
        assert np.isclose(opt[k], ok) and np.allclose(z[:, k], zk, atol=1e-6)


def test_penalty_ranges():
    assert [len(r) for r in W.AUTO_RANGES] == [16, 16, 11]
    assert len(W.penalty_range(0, 4, 0.1)) == 41
    assert W.auto_range(np.array([np.nan, 0.1, 0.8])).tolist() == [2, 1, 0]


def test_lag_correlation():
    y = np.random.default_rng(0).normal(size=(50, 2))
    y[:, 1] = 3.0
    r = W.lag1corr(y, np.ones_like(y, bool))
    assert np.isclose(r[0], np.corrcoef(y[:-1, 0], y[1:, 0])[0, 1]) and np.isnan(r[1])


def flags(values, lo=np.nan, hi=np.nan):
    x = np.array([values], float)
    return spikekernel.flag(x, np.arange(x.shape[1], dtype=float)[None] * 8, np.array([lo]), np.array([hi]))[0]


def test_spikes_runs_and_ranges():
    rng = np.random.default_rng(5)
    base = 5000 + 1500 * np.sin(np.arange(80) / 12) + rng.normal(0, 80, 80)
    v = base.copy()
    v[20] += 1200
    v[40:42] -= 1100
    v[60:66] = v[60]
    v[75] = 20000
    f = flags(v, -2000, 10000)
    assert set(np.flatnonzero(f & 4)) == {20, 40, 41}
    assert set(np.flatnonzero(f & 2)) == set(range(60, 66))
    assert set(np.flatnonzero(f & 1)) == {75}


def test_level_change_and_short_runs_are_no_cases():
    rng = np.random.default_rng(6)
    v = 4000 + rng.normal(0, 60, 60)
    v[30:] += 1500
    v[10:15] = v[10]
    assert not flags(v).any()


def test_degenerate_series():
    assert not flags([5.0]).any() and not flags([1.0, 2.0, 3.0]).any()
    assert (flags([7.0] * 6) == 2).all() and not flags([7.0] * 5).any()


def test_pchip_is_monotone_and_hits_knots():
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.integers(1, 9, 40)).astype(float)
    y = np.cumsum(rng.random(40))
    m = gridkernel.slopes(x, y, np.zeros(40, int))
    at = np.linspace(x[0], x[-1] - 1e-9, 2000)
    k = np.searchsorted(x, at, "right") - 1
    v = gridkernel.evaluate(x, y, m, k, at)
    assert (np.diff(v) >= -1e-9).all()
    assert np.allclose(gridkernel.evaluate(x, y, m, np.arange(39), x[:-1]), y[:-1])


def test_kprototypes_finds_the_groups_and_ignores_unobserved():
    rng = np.random.default_rng(0)
    num = np.concatenate([rng.normal(0, 0.1, (50, 1)), rng.normal(5, 0.1, (50, 1))])
    cat = np.array([["a"]] * 50 + [["b"]] * 50, object)
    p = prototypes.fit(num, cat, np.ones(100), 2, np.array([1.0]))
    at = p.assign(num, cat)
    assert len(set(at[:50])) == 1 and len(set(at[50:])) == 1 and at[0] != at[50]
    assert p.assign(np.array([[np.nan]]), np.array([["b"]], object))[0] == at[50]
    assert p.assign(np.array([[5.0]]), np.array([[None]], object))[0] == at[50]
    prototypes.fit(np.zeros((0, 1)), np.zeros((0, 1), object), np.zeros(0), 2, np.array([1.0]))


def test_spikes_put_into_seasonal_series_are_found():
    rng = np.random.default_rng(11)
    rows, n = 300, 70
    day = np.cumsum(rng.integers(4, 13, (rows, n)), axis=1).astype(float)
    x = 5000 + rng.uniform(200, 1500, (rows, 1)) * np.sin(day / 58) + rng.normal(0, 80, (rows, n))
    truth = np.zeros(x.shape, bool)
    for r in range(rows):
        i, m = rng.integers(4, n - 5), rng.integers(1, 3)
        x[r, i : i + m] += rng.choice([-1, 1]) * rng.uniform(10, 20) * 80
        truth[r, i : i + m] = True
    none = np.full(rows, np.nan)
    got = (spikekernel.flag(np.rint(x), day, none, none) & spikekernel.SPIKE) > 0
    recall, precision = (got & truth).sum() / truth.sum(), (got & truth).sum() / got.sum()
    assert recall > 0.93 and precision > 0.96, (recall, precision)
