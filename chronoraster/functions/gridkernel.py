"""NumPy kernel for regular grids (problem 1): monotone cubic interpolation over flat series.

Series are concatenated; ``row`` says which one a reading belongs to, readings
are in time order within a row.  A row is one time shard of a source with up to
two valid readings of its neighbour shards on either side, which is all that
the interpolant's slopes can depend on.
"""

from __future__ import annotations

import numpy as np

EPOCH_YEAR = 1970


def year_of(day: np.ndarray) -> np.ndarray:
    return day.astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + EPOCH_YEAR


def year_start(year: np.ndarray) -> np.ndarray:
    return (np.asarray(year) - EPOCH_YEAR).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)


def per_year(year: np.ndarray, t: np.ndarray) -> np.ndarray:
    return -(-(year_start(year + 1) - year_start(year)) // t)


def slopes(x: np.ndarray, y: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Shape-preserving slopes at each knot (weighted harmonic means), per segment."""
    n = len(x)
    m = np.zeros(n)
    if n < 2:
        return m
    joined = seg[1:] == seg[:-1]
    h = np.where(joined, np.diff(x), 1.0)
    d = np.where(joined, np.diff(y) / h, 0.0)
    left, right = np.append(False, joined), np.append(joined, False)
    hl, hr, dl, dr = np.append(1.0, h), np.append(h, 1.0), np.append(0.0, d), np.append(d, 0.0)
    both = left & right
    up = both & (dl * dr > 0)
    w1, w2 = 2 * hr + hl, hr + 2 * hl
    m[up] = ((w1 + w2)[up]) / (w1[up] / dl[up] + w2[up] / dr[up])

    def end(at: np.ndarray, step: int) -> None:
        near, beyond = at + (0 if step > 0 else -1), at + (step if step > 0 else -2)
        there = (beyond >= 0) & (beyond < n - 1)
        there[there] &= joined[beyond[there]]
        m[at[~there]] = d[near[~there]]
        a, k, k2 = at[there], near[there], beyond[there]
        s = ((2 * h[k] + h[k2]) * d[k] - h[k] * d[k2]) / (h[k] + h[k2])
        s = np.where(s * d[k] <= 0, 0.0, s)
        s = np.where((d[k] * d[k2] <= 0) & (np.abs(s) > 3 * np.abs(d[k])), 3 * d[k], s)
        m[a] = s

    end(np.flatnonzero(right & ~left), 1)
    end(np.flatnonzero(left & ~right), -1)
    return m


def evaluate(x: np.ndarray, y: np.ndarray, m: np.ndarray, k: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic Hermite value at ``at`` between knots k and k + 1."""
    h = x[k + 1] - x[k]
    s = (at - x[k]) / h
    return (1 + 2 * s) * (1 - s) ** 2 * y[k] + s * (1 - s) ** 2 * h * m[k] + s * s * (3 - 2 * s) * y[k + 1] + s * s * (s - 1) * h * m[k + 1]


def grid(day: np.ndarray, value: np.ndarray, valid: np.ndarray, own: np.ndarray, row: np.ndarray, rows: int, t: np.ndarray, before: np.ndarray, max_gap: np.ndarray):
    """Periods of each row: (row, first day as YYYYDDD, value, readings, status).

    before: last day of the source's earlier shards, or a negative sentinel
    ``np.iinfo(np.int64).min`` for none.  status: 0 observed, 1 interpolated,
    2 long gap or no support.
    """
    none = np.iinfo(np.int64).min
    own_at = np.flatnonzero(own)
    if not len(own_at):
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int8))
    r = row[own_at]
    y0 = int(year_of(np.array([min(day[own_at].min(), before[before != none].min(initial=day[own_at].min()))]))[0])
    y1 = int(year_of(np.array([day[own_at].max()]))[0])
    kinds, kind = np.unique(t, return_inverse=True)
    years = np.arange(y0, y1 + 2)
    # periods since the first year, for each resolution in use
    ahead = np.stack([np.append(0, np.cumsum(per_year(years, np.full(len(years), k))))[:-1] for k in kinds])

    def index(days: np.ndarray, rr: np.ndarray) -> np.ndarray:
        y = year_of(days)
        return ahead[kind[rr], y - y0] + (days - year_start(y)) // t[rr]

    p = index(day[own_at], r)
    last = np.full(rows, -1, np.int64)
    np.maximum.at(last, r, p)
    first = np.full(rows, np.iinfo(np.int64).max)
    np.minimum.at(first, r, p)
    with_before = np.flatnonzero((before != none) & (last >= 0))
    first[with_before] = index(before[with_before], with_before) + 1
    size = np.where(last >= 0, np.maximum(last - first + 1, 0), 0)
    total = int(size.sum())
    base = np.cumsum(size) - size
    g_row = np.repeat(np.arange(rows), size)
    g_p = np.repeat(first - base, size) + np.arange(total)
    # day span of each period
    g_year = np.zeros(total, np.int64)
    for i in range(len(kinds)):
        here = kind[g_row] == i
        g_year[here] = np.searchsorted(ahead[i], g_p[here], "right") - 1
    start = year_start(g_year + y0) + (g_p - ahead[kind[g_row], g_year]) * t[g_row]
    end = np.minimum(start + t[g_row], year_start(g_year + y0 + 1))
    label = (g_year + y0) * 1000 + start - year_start(g_year + y0) + 1
    # readings in each period; those in the period of ``before`` belong to the earlier shard's row
    cell = base[r] + p - first[r]
    inside = p >= first[r]
    count = np.bincount(cell[inside], minlength=total).astype(np.int32)
    good = valid[own_at] & inside
    seen = np.bincount(cell[good], minlength=total)
    mean = np.bincount(cell[good], weights=value[own_at][good], minlength=total) / np.maximum(seen, 1)
    out = np.where(seen > 0, mean, np.nan)
    status = np.where(seen > 0, 0, 2).astype(np.int8)
    # interpolation between valid readings no further apart than max_gap
    kx = np.flatnonzero(valid)
    if len(kx) > 1:
        x, y, kr = day[kx].astype(float), value[kx], row[kx]
        seg = np.append(0, np.cumsum((kr[1:] != kr[:-1]) | (np.diff(x) > max_gap[kr[1:]])))
        m = slopes(x, y, seg)
        todo = np.flatnonzero(seen == 0)
        mid = (start[todo] + end[todo] - 1) / 2
        width = float(max(x.max(), mid.max(initial=0)) - min(x.min(), mid.min(initial=0)) + 2)
        low = min(x.min(), mid.min(initial=0))
        k = np.searchsorted(kr * width + (x - low), g_row[todo] * width + (mid - low), "right") - 1
        ok = (k >= 0) & (k < len(kx) - 1)
        ok[ok] = (kr[k[ok]] == g_row[todo[ok]]) & (seg[k[ok]] == seg[k[ok] + 1])
        out[todo[ok]] = evaluate(x, y, m, k[ok], mid[ok])
        status[todo[ok]] = 1
    return g_row, label, out, count, status
