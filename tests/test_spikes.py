"""Phase-space thresholding: what it finds, what decides, and how often it is wrong on simulated series."""

import numpy as np
import pytest

from chronoraster.functions import spikekernel as K


def series(rng, rows=400, n=75, kind="gauss", steps=False):
    day = np.cumsum(rng.integers(4, 17, (rows, n)), axis=1).astype(float)
    noise = rng.normal(size=(rows, n)) if kind == "gauss" else rng.laplace(size=(rows, n)) / np.sqrt(2)
    x = 4000 + rng.uniform(100, 800, (rows, 1)) * np.sin(day / 365 * 2 * np.pi + rng.uniform(0, 6, (rows, 1))) + 100 * noise
    if steps:
        x = x + 1500 * (np.arange(n)[None] >= rng.integers(20, 55, size=(rows, 1)))
    return np.rint(x), day


def flagged(x, day):
    none = np.full(len(x), np.nan)
    return (K.flag(x, day, none, none) & K.SPIKE) > 0


def put_in(x, day, rng, scales, width):
    """Spikes of ``scales`` times what the series scatters about its neighbours, one place a series."""
    unit = K.noise(x, day)
    x, truth = x.copy(), np.zeros(x.shape, bool)
    for r in range(len(x)):
        i = rng.integers(4, x.shape[1] - 6)
        x[r, i : i + width] += np.rint(rng.choice([-1, 1]) * scales * unit[r])
        truth[r, i : i + width] = True
    return x, truth


@pytest.mark.parametrize("scales,width,least", [(8, 1, 0.9), (10, 1, 0.95), (12, 1, 0.97), (10, 2, 0.9), (12, 2, 0.95)])
def test_injected_spikes_are_found(scales, width, least):
    rng = np.random.default_rng(scales * 10 + width)
    x, day = series(rng)
    x, truth = put_in(x, day, rng, scales, width)
    got = flagged(x, day)
    recall, precision = (got & truth).sum() / truth.sum(), (got & truth).sum() / got.sum()
    assert recall >= least and precision >= 0.95, (recall, precision)


def test_false_flags_are_rare():
    for kind, most in (("gauss", 5e-5), ("laplace", 2e-3)):
        x, day = series(np.random.default_rng(3), 2000, kind=kind)
        assert flagged(x, day).mean() < most
    x, day = series(np.random.default_rng(4), 1000, steps=True)
    assert flagged(x, day).sum() < 30  # of 1,000 lasting changes of level


def test_the_ellipsoid_decides(monkeypatch):
    """Without it (every reading a candidate) many more readings come out; the check of shape alone finds no spikes."""
    rng = np.random.default_rng(8)
    x, day = series(rng)
    x, truth = put_in(x, day, rng, 12, 1)
    got = flagged(x, day)
    monkeypatch.setattr(K, "candidates", lambda v, first, second, n: np.isfinite(v))
    every = flagged(x, day)
    assert every.sum() > 5 * got.sum() and (every & ~truth).sum() > 5 * (got & ~truth).sum()


def test_scales_are_estimated_again():
    """A spike that others hide at first is found once they are replaced."""
    rng = np.random.default_rng(2)
    x, day = series(rng, 200, 60)
    for k in range(6, 56, 12):
        x[:, k] += 3000  # large spikes widen the ellipsoid
    x[:, 25] += 1200
    rounds = []
    real = K.candidates

    def counting(v, first, second, n):
        rounds.append(len(v))
        return real(v, first, second, n)

    K.candidates = counting
    try:
        got = flagged(x, day)
    finally:
        K.candidates = real
    assert len(rounds) > 2 and got[:, 6:56:12].mean() > 0.9 and got[:, 25].mean() > 0.9
