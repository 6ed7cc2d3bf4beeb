"""NumPy kernel that flags implausible readings in batches of series (problem 2).

Input is one row per series, left-aligned and in time order.  Three faults:

* ``range``: outside the physical bounds,
* ``stuck``: a run of ``STUCK_RUN`` or more equal values (first differences of zero),
* ``spike``: phase-space thresholding, as follows.

Each reading is a point of three coordinates: the *value* v, detrended by the
level of its surroundings; the *first difference* of v between its neighbours;
and the *second difference*, its height over the line between its neighbours.
The level is that one of three which lies nearest to the reading: the median of
``NEAR`` readings before it, that of as many after it, or the line between both;
so a lasting change of level leaves no value.  Value and second difference are
turned by the angle of their regression.  A reading is a candidate when its
point lies outside the ellipsoid whose half axes are ``TIMES`` times the
universal threshold sqrt(2 ln n) times the coordinates' robust scales.
Candidates that stand out themselves are replaced by their level, scales, angle
and ellipsoid are estimated again from what is left, and the series is tested
again until no new ones appear.  Every round flags a reading or is the series'
last one, so there are at most n + 1.

The exact check that follows has no scale of its own.  A candidate stands out
if its value is the largest among its neighbours' and not less than ``OWN`` of
its second difference, and if it lies off the medians of both sides and off the
nearest readings on both sides, all to the same side and by ``SHARE`` of its
value; a neighbour that is a candidate to the same side is passed over.  So the
turn of a steep season and the neighbours of a spike are none.  A reading
without readings on both sides is none either.

``TIMES``: the universal threshold is what the largest of n Gaussian readings
comes to; 2.25 times it leaves under 2 flags in 1,000 readings of simulated
seasonal series with Laplace noise, 1 in 20,000 with Gaussian noise
(``tests/test_spikes.py``).
"""

from __future__ import annotations

import warnings

import numpy as np

STUCK_RUN = 6
TIMES = 2.25
OWN = 0.5
SHARE = 0.5
NEAR = 3  # readings looked at on either side
FLOOR = 1.0  # least scale: readings are whole numbers

RANGE, STUCK, SPIKE = 1, 2, 4


def _row_median(a: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Median of each row's finite cells; NaN cells sort last. Rows without cells give NaN."""
    s = np.sort(a, axis=1)
    r = np.arange(len(a))
    c = np.maximum(count, 1)
    return 0.5 * (s[r, (c - 1) // 2] + s[r, c // 2])


def _scale(a: np.ndarray) -> np.ndarray:
    """Robust standard deviation of each row: mean of what three quantiles of the absolute deviations from the median say."""
    count = np.isfinite(a).sum(axis=1)
    s = np.sort(np.abs(a - _row_median(a, count)[:, None]), axis=1)
    r, c = np.arange(len(a)), np.maximum(count, 1)
    # Quantiles of |z| of a standard normal variable
    return sum(s[r, ((c - 1) * share).astype(int)] / z for share, z in ((0.5, 0.6745), (0.6827, 1.0), (0.8, 1.2816))) / 3


def _shift(a: np.ndarray, k: int) -> np.ndarray:
    """out[:, i] = a[:, i + k], NaN beyond the ends."""
    out = np.full_like(a, np.nan)
    if abs(k) < a.shape[1]:
        if k > 0:
            out[:, :-k] = a[:, k:]
        elif k < 0:
            out[:, -k:] = a[:, :k]
        else:
            out[:] = a
    return out


def _stack_median(layers: list[np.ndarray]) -> np.ndarray:
    s = np.sort(np.stack(layers), axis=0)
    n = np.isfinite(s).sum(axis=0)
    lo, hi = np.maximum(n - 1, 0) // 2, n // 2
    hi = np.minimum(hi, len(layers) - 1)
    return 0.5 * (np.take_along_axis(s, lo[None], 0)[0] + np.take_along_axis(s, hi[None], 0)[0])


def _compact(keep: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Move kept cells to the left, in order; the rest becomes NaN. Also gives each cell's source column."""
    order = np.argsort(~keep, axis=1, kind="stable")
    width = max(1, int(keep.sum(axis=1).max(initial=0)))
    order = order[:, :width]
    kept = np.take_along_axis(keep, order, 1)
    return np.where(kept, order, -1), [np.where(kept, np.take_along_axis(a, order, 1), np.nan) for a in arrays]


def runs(x: np.ndarray) -> np.ndarray:
    """Length of the run of equal values that each cell belongs to (NaN cells: runs of one)."""
    rows, width = x.shape
    start = np.ones((rows, width), bool)
    start[:, 1:] = x[:, 1:] != x[:, :-1]
    flat = np.flatnonzero(start.ravel())
    length = np.diff(np.append(flat, rows * width))
    return np.repeat(length, length).reshape(rows, width)


def _side(x: np.ndarray, day: np.ndarray, direction: int) -> tuple[np.ndarray, np.ndarray]:
    """Median value and mean day of the ``NEAR`` readings on one side; NaN where there is none."""
    ks = [direction * k for k in range(1, NEAR + 1)]
    values, days = [_shift(x, k) for k in ks], [_shift(day, k) for k in ks]
    seen = np.isfinite(np.stack(values))
    n = seen.sum(axis=0)
    mean_day = np.where(seen, np.stack(days), 0).sum(axis=0) / np.maximum(n, 1)
    return _stack_median(values), np.where(n > 0, mean_day, np.nan)


def _off_line(x, day, before, day_before, after, day_after):
    return x - (before + (after - before) * (day - day_before) / np.maximum(day_after - day_before, 1e-9))


def coordinates(x: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, first difference, second difference, median before, median after) of each reading."""
    before, day_before = _side(x, day, -1)
    after, day_after = _side(x, day, 1)
    v = _off_line(x, day, before, day_before, after, day_after)
    for off in (x - before, x - after):
        v = np.where(np.abs(off) < np.abs(v), off, v)
    first = (np.nan_to_num(_shift(v, 1)) - np.nan_to_num(_shift(v, -1))) / 2
    second = np.nan_to_num(_off_line(x, day, _shift(x, -1), _shift(day, -1), _shift(x, 1), _shift(day, 1)))
    return v, first, second, before, after


def candidates(v: np.ndarray, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Readings whose point lies outside their series' ellipsoid; n: readings of each series."""
    ok = np.isfinite(v)
    z, second = np.where(ok, v, 0.0), np.where(ok, second, 0.0)
    angle = np.arctan2((z * second).sum(axis=1), np.maximum((z * z).sum(axis=1), 1e-9))[:, None]
    cos, sin = np.cos(angle), np.sin(angle)
    distance = 0.0
    for c in (z * cos + second * sin, first, second * cos - z * sin):
        distance = distance + (c / np.maximum(_scale(np.where(ok, c, np.nan)), FLOOR)[:, None]) ** 2
    limit = TIMES**2 * 2 * np.log(np.maximum(n, 2))
    return ok & (distance > limit[:, None])


def _stands_out(x, v, second, before, after, cand) -> np.ndarray:
    """The check of shape: no scale, only the reading's own value against its surroundings."""
    sign = np.sign(v)

    def off(other):
        return (np.sign(x - other) == sign) & (np.abs(x - other) >= SHARE * np.abs(v))

    mate = np.where(cand, sign, 0.0)
    left = off(_shift(x, -1)), (_shift(mate, -1) == sign) & off(_shift(x, -2))
    right = off(_shift(x, 1)), (_shift(mate, 1) == sign) & off(_shift(x, 2))
    sides = (left[0] & right[0]) | (left[0] & right[1]) | (left[1] & right[0])
    size = np.nan_to_num(np.abs(v))
    largest = (size > np.nan_to_num(_shift(size, -1))) & (size >= np.nan_to_num(_shift(size, 1)))
    return (sign != 0) & off(before) & off(after) & sides & largest & (np.abs(v) >= OWN * np.abs(second))


def spikes(x: np.ndarray, day: np.ndarray) -> np.ndarray:
    n = np.isfinite(x).sum(axis=1)
    found = np.zeros(x.shape, bool)
    left, rows = x.copy(), np.arange(len(x))
    while len(rows):
        now = left[rows]
        v, first, second, before, after = coordinates(now, day[rows])
        cand = candidates(v, first, second, n[rows])
        new = cand & _stands_out(now, v, second, before, after, cand) & ~found[rows]
        r, c = np.nonzero(new)
        found[rows[r], c] = True
        left[rows[r], c] = now[r, c] - v[r, c]
        rows = rows[new.any(axis=1)]  # the others can't change any more
    return found


def noise(x: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Robust scale of a series' readings about the line through their two neighbours; the unit in which tests state spikes."""
    return _scale(_off_line(x, day, _shift(x, -1), _shift(day, -1), _shift(x, 1), _shift(day, 1))) / np.sqrt(1.5)


def flag(x: np.ndarray, day: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Fault bits of each cell. x has NaN where a row has no (more) readings; lo, hi: bounds per row, NaN for none."""
    out = np.zeros(x.shape, np.uint8)
    if not x.size:
        return out
    seen = np.isfinite(x)
    beyond = seen & ((x < lo[:, None]) | (x > hi[:, None]))
    stuck = seen & (runs(x) >= STUCK_RUN)
    out[beyond] |= RANGE
    out[stuck] |= STUCK
    order, (xc, dc) = _compact(seen & ~beyond & ~stuck, x, day)
    with warnings.catch_warnings():  # comparisons with NaN are meant to be false
        warnings.simplefilter("ignore", RuntimeWarning)
        r, c = np.nonzero(spikes(xc, dc))
    out[r, order[r, c]] |= SPIKE
    return out
