"""Whittaker smoothers for batches of series, vectorised across series.

Arrays are (time, series).  ``(W + lam D'D) z = W y`` with D the second
difference is solved by an LDL' pass over time for all series at once.  A weight
of 0 makes the value irrelevant; give 0.0 there, not NaN.
"""

from __future__ import annotations

import numpy as np

MIN_LENGTH = 4
ROUNDS = 10  # most iterations of the asymmetric weights


def _edges(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and first off-diagonal of D'D."""
    a, b = np.full(n, 6.0), np.full(n, -4.0)
    a[[0, -1]], a[[1, -2]] = 1.0, 5.0
    b[[0, -2]], b[-1] = -2.0, 0.0
    return a, b


def _factor(w: np.ndarray, lam) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LDL' factors (1/d, c, e) over time, for all columns of ``w``.

    With m = c d, m and e d = lam follow from the steps before by products alone,
    so each step takes one division.
    """
    n = len(w)
    a, b = _edges(n)
    inv, c, e = (np.zeros((n + 2, *w.shape[1:])) for _ in range(3))
    m, d, t = np.zeros(w.shape[1:]), np.empty(w.shape[1:]), np.empty(w.shape[1:])
    for i in range(n):
        np.multiply(lam, a[i], out=d)
        d += w[i]
        np.multiply(c[i - 1], m, out=t)
        d -= t
        np.multiply(e[i - 2], lam, out=t)
        d -= t
        np.divide(1.0, d, out=inv[i])
        m *= e[i - 1]
        np.multiply(lam, b[i], out=t)
        np.subtract(t, m, out=m)
        np.multiply(m, inv[i], out=c[i])
        if i < n - 2:
            np.multiply(inv[i], lam, out=e[i])
    c[n - 1] = 0.0
    return inv, c, e


def ws2d(y: np.ndarray, lam, w: np.ndarray) -> np.ndarray:
    """Fixed penalty; ``lam`` is a number or one number per series.

    Series with equal weights and penalty share their factors.
    """
    n = len(y)
    if n < MIN_LENGTH:
        raise ValueError(f"a series needs {MIN_LENGTH} steps at least")
    lam = np.asarray(lam, float)
    same = lam.ndim == 0 and y.shape[1] > 1 and bool((w == w[:, :1]).all())
    if same:
        inv, c, e = (f[:, 0].tolist() for f in _factor(w[:, :1], lam))
    else:
        inv, c, e = _factor(w, np.broadcast_to(lam, y.shape[1:]))
    z = np.empty((n + 2, *y.shape[1:]))
    z[n:] = 0.0
    np.multiply(w, y, out=z[:n])
    t = np.empty(y.shape[1:])
    for i in range(1, n):
        np.multiply(z[i - 1], c[i - 1], out=t)
        z[i] -= t
        if i > 1:
            np.multiply(z[i - 2], e[i - 2], out=t)
            z[i] -= t
    for i in range(n - 1, -1, -1):
        z[i] *= inv[i]
        np.multiply(z[i + 1], c[i], out=t)
        z[i] -= t
        np.multiply(z[i + 2], e[i], out=t)
        z[i] -= t
    return z[:n]


def _envelope(y, lam, w, p, z):
    """Reweight and solve up to ``ROUNDS`` times; a series whose curve repeats is done."""
    lam = np.asarray(lam, float)
    todo, yy, ww, zz = None, y, w, z
    for _ in range(ROUNDS):
        zz = ws2d(yy, lam, ww * np.where(yy > zz, p, 1 - p))
        old = z if todo is None else z[:, todo]
        moved = (zz != old).any(axis=0)
        if todo is None:
            z = zz.copy()
        else:
            z[:, todo] = zz
        if not moved.any():
            break
        if moved.mean() < 0.6:  # go on with the series that still move
            todo = np.flatnonzero(moved) if todo is None else todo[moved]
            yy, ww, zz = yy[:, moved], ww[:, moved], zz[:, moved]
            lam = lam if lam.ndim == 0 else lam[moved]
    return z


def ws2dp(y: np.ndarray, lam, w: np.ndarray, p: float) -> np.ndarray:
    """Fixed penalty, asymmetric weights: p above the curve, 1 - p below."""
    return _envelope(y, lam, w, p, np.zeros_like(y))


def _fit_and_roughness(y, w, z):
    with np.errstate(divide="ignore"):
        fit = np.log(((w * (y - z)) ** 2).sum(axis=0))
        rough = np.log((np.diff(z, 2, axis=0) ** 2).sum(axis=0))
    return fit, rough


def _v_minimum(fits: np.ndarray, pens: np.ndarray, llas: np.ndarray) -> np.ndarray:
    """10 ** (middle of the first smallest step of the V-curve), per series."""
    with np.errstate(invalid="ignore"):
        v = np.sqrt(np.diff(fits, axis=0) ** 2 + np.diff(pens, axis=0) ** 2) / (np.log(10) * (llas[1] - llas[0]))
    best, k = v[0].copy(), np.zeros(v.shape[1], int)
    for i in range(1, len(v)):
        less = v[i] < best
        best[less], k[less] = v[i][less], i
    return 10.0 ** ((llas[k] + llas[k + 1]) / 2)


def ws2doptv(y: np.ndarray, w: np.ndarray, llas) -> tuple[np.ndarray, np.ndarray]:
    """(z, penalty): the penalty that minimises the V-curve over log10 penalties ``llas``."""
    llas = np.asarray(llas, float)
    curve = [_fit_and_roughness(y, w, ws2d(y, 10.0**x, w)) for x in llas]
    opt = _v_minimum(np.stack([f for f, _ in curve]), np.stack([r for _, r in curve]), llas)
    return ws2d(y, opt, w), opt


def ws2doptvp(y: np.ndarray, w: np.ndarray, llas, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Asymmetric V-curve; each penalty starts from the curve of the one before."""
    llas = np.asarray(llas, float)
    z, curve = np.zeros_like(y), []
    for x in llas:
        z = _envelope(y, 10.0**x, w, p, z)
        curve.append(_fit_and_roughness(y, w, z))
    opt = _v_minimum(np.stack([f for f, _ in curve]), np.stack([r for _, r in curve]), llas)
    return ws2dp(y, opt, w, p), opt


def lag1corr(y: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Population correlation of neighbours that are both valid; NaN where undefined."""
    both = valid[:-1] & valid[1:]
    n = both.sum(axis=0)
    a, b = np.where(both, y[:-1], 0.0), np.where(both, y[1:], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ma, mb = a.sum(axis=0) / n, b.sum(axis=0) / n
        sa = np.sqrt((np.where(both, y[:-1] - ma, 0.0) ** 2).sum(axis=0) / n)
        sb = np.sqrt((np.where(both, y[1:] - mb, 0.0) ** 2).sum(axis=0) / n)
        return ((a * b).sum(axis=0) / n - ma * mb) / (sa * sb)


def penalty_range(low: float, high: float, step: float) -> np.ndarray:
    return np.arange(low, high + step, step).round(2)


#: log10 penalties for a lag-1 correlation above 0.5, up to 0.5, and undefined.
AUTO_RANGES = (np.arange(-2, 1.2, 0.2).round(2), np.arange(0, 3.2, 0.2).round(2), np.arange(-1, 1.2, 0.2).round(2))


def auto_range(corr: np.ndarray) -> np.ndarray:
    """Which of ``AUTO_RANGES`` each series takes."""
    return np.where(np.isnan(corr), 2, np.where(corr > 0.5, 0, 1))
