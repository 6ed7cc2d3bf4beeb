"""Smoothing, gap filling and temporal interpolation of series in array form."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoraster.functions.axis import target_days
from chronoraster.functions.whittaker import MIN_LENGTH

COVERAGE = 0.2  # least share of valid steps
ROWS = 1000  # series per kernel call; a step's vectors stay in the cache
INTERPOLATION_PENALTY = 1e-4


def coverage(w: Column) -> Column:
    """Number of valid steps."""
    return F.aggregate(w, F.lit(0.0), lambda a, x: a + F.when(x > 0, 1.0).otherwise(0.0)).cast("bigint")


def _matrix(a: pa.Array) -> np.ndarray:
    """(time, series) of equally long lists."""
    n = len(a)
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.ascontiguousarray(flat.reshape(n, -1).T)


def _lists(z: np.ndarray) -> pa.Array:
    rows, width = z.shape[1], z.shape[0]
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(z.T).ravel()))


def _equal_lengths(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose series are equally long, of ``ROWS`` series at most."""
    length = np.diff(batch.column("y").offsets.to_numpy())
    order = np.argsort(length, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(length[order])) + 1, len(order))
    i = 0
    for end in ends:
        while i < end:
            j = min(end, i + ROWS)
            part = batch if j - i == len(order) else batch.take(pa.array(order[i:j]))
            yield part
            i = j


def solve(y: np.ndarray, w: np.ndarray, s: np.ndarray, svalue: float | None, p: float | None, optimise: bool, srange: list[float] | None) -> tuple[np.ndarray, np.ndarray]:
    """(curves, log10 penalties) of a batch: V-curve, fixed penalty, or one penalty per series."""
    from chronoraster.functions import whittaker as k

    if not optimise:
        log = np.full(y.shape[1], svalue, float) if svalue is not None else np.nan_to_num(s)
        lam = 10.0**svalue if svalue is not None else 10.0**log
        return (k.ws2d(y, lam, w) if p is None else k.ws2dp(y, lam, w, p)), log
    one = lambda y, w, r: k.ws2doptv(y, w, r) if p is None else k.ws2doptvp(y, w, r, p)
    if srange is not None:
        z, opt = one(y, w, np.asarray(srange, float))
        return z, np.log10(opt)
    which = k.auto_range(k.lag1corr(y, w > 0))
    z, log = np.empty_like(y), np.empty(y.shape[1])
    for i, r in enumerate(k.AUTO_RANGES):
        here = which == i
        if here.any():
            z[:, here], opt = one(y[:, here], w[:, here], r)
            log[here] = np.log10(opt)
    return z, log


def smooth(
    series: DataFrame,
    keys: list[str],
    svalue: float | None = None,
    p: float | None = None,
    optimise: bool = False,
    srange: list[float] | None = None,
    grid: str | None = None,
    raw_dates: list[date] | None = None,
    raw_step: int | None = None,
    step: int | None = None,
    shift: int = 0,
    start: date | None = None,
    nupdate: int = 0,
) -> DataFrame:
    """(keys, z, log10_s, smoothed) of series (keys, y, w), of one length with interpolation.

    Penalty, in this order: ``optimise`` (V-curve over ``srange`` or, without
    it, the range that the lag-1 correlation asks for), ``svalue`` (log10), or
    the column ``grid`` (log10; null stands for 0).  With ``p`` the weights are
    asymmetric.  log10_s is the penalty used, null where a series was not
    smoothed; grid values are only read.

    Series with less than a fifth of their steps valid are not smoothed: they
    keep their values (null where missing), or are all null with interpolation.

    With ``step`` the curve is set at raw_date + shift on the daily axis, joined
    by a nearly interpolating smoother, and read at the target days (the last
    ``nupdate`` of them, 0 for all).  Without it ``nupdate`` keeps the last steps.
    ``start`` needs ``step``.  Series shorter than 4 steps raise ValueError.
    """
    if start is not None and step is None:
        raise ValueError("a start date needs a target step")
    if not optimise and svalue is None and grid is None:
        raise ValueError("give svalue, optimise or grid")
    interpolate = step is not None
    place = pick = None
    n_daily = 0
    if interpolate:
        daily, target = target_days(raw_dates, raw_step, step, start)
        index = {d: i for i, d in enumerate(daily)}
        place = np.array([index[d + timedelta(shift)] for d in sorted(raw_dates)])
        pick = np.array([index[d] for d in target[-nupdate:]], int)
        n_daily = len(daily)
    cols = [*keys, F.col("y").cast("array<double>").alias("y"), F.col("w").cast("array<double>").alias("w"), (F.col(grid) if grid else F.lit(None)).cast("double").alias("__s")]
    src = series.select(*cols)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chronoraster.functions import whittaker as k

        for whole in batches:
            for b in _equal_lengths(whole):
                y, w = _matrix(b.column("y")), _matrix(b.column("w"))
                if len(y) < MIN_LENGTH:
                    raise ValueError(f"a series needs {MIN_LENGTH} steps at least")
                y = np.where(w > 0, y, 0.0)
                s = b.column("__s").to_numpy(zero_copy_only=False).astype(float)
                enough = (w > 0).sum(axis=0) >= COVERAGE * len(y)
                z, log = np.where(w > 0, y, np.nan), np.full(y.shape[1], np.nan)
                if enough.any():
                    z[:, enough], log[enough] = solve(y[:, enough], w[:, enough], s[enough], svalue, p, optimise, srange)
                if interpolate:
                    out = np.full((len(pick), y.shape[1]), np.nan)
                    if enough.any():
                        d, dw = np.zeros((n_daily, int(enough.sum()))), np.zeros((n_daily, int(enough.sum())))
                        d[place], dw[place] = z[:, enough], 1.0
                        out[:, enough] = k.ws2d(d, INTERPOLATION_PENALTY, dw)[pick]
                    z = out
                elif nupdate:
                    z = z[-nupdate:]
                lists = _lists(z)
                lists = pa.ListArray.from_arrays(lists.offsets, pa.array(lists.values.to_numpy(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], lists, pa.array(log, from_pandas=True), pa.array(enough)], names=[*keys, "z", "log10_s", "smoothed"])

    return src.mapInArrow(run, f"{fields}, z array<double>, log10_s double, smoothed boolean")


def stored(z: Column) -> Column:
    """Rounded half even and kept within the 16-bit range, as cubes hold it; null stays null."""
    return F.when(z.isNotNull(), F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), F.rint(z)))).cast("smallint")


def lag1corr_expr(y: Column, w: Column) -> Column:
    """Lag-1 correlation of array columns, JVM side; null where undefined.

    One pass over moments about the first valid value, which makes them exact
    zeros for a constant series.
    """
    pairs = F.sequence(F.lit(2), F.size(y))
    first = F.aggregate(F.sequence(F.lit(1), F.size(y)), F.lit(None).cast("double"), lambda acc, i: F.coalesce(acc, F.when(F.element_at(w, i) > 0, F.element_at(y, i))))
    names = ("n", "a", "b", "aa", "bb", "ab")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in names])

    def add(origin: Column):
        def step(acc: Column, i: Column) -> Column:
            a, b = F.element_at(y, i - 1) - origin, F.element_at(y, i) - origin
            new = dict(zip(names, (F.lit(1.0), a, b, a * a, b * b, a * b)))
            return F.when((F.element_at(w, i - 1) > 0) & (F.element_at(w, i) > 0), F.struct(*[(acc[k] + new[k]).alias(k) for k in names])).otherwise(acc)

        return step

    def result(m: Column) -> Column:
        va, vb = m["aa"] - m["a"] * F.try_divide(m["a"], m["n"]), m["bb"] - m["b"] * F.try_divide(m["b"], m["n"])
        return F.try_divide(m["ab"] - m["a"] * F.try_divide(m["b"], m["n"]), F.when((va > 0) & (vb > 0), F.sqrt(va) * F.sqrt(vb)))

    # one-element arrays bind a value, so that it is computed once
    moments = F.transform(F.array(first), lambda o: F.aggregate(pairs, zero, add(o)))
    return F.transform(moments, result)[0]


def range_choice(corr: Column) -> Column:
    """Which automatic range a lag-1 correlation asks for."""
    return F.when(corr.isNull() | F.isnan(corr), "-1..1").when(corr > 0.5, "-2..1").otherwise("0..3")


def vcurve_points(series: DataFrame, keys: list[str], srange: list[float]) -> DataFrame:
    """(keys, log10_s, fit, rough): the V-curve's points, penalties as rows."""
    src = series.select(*keys, "y", "w")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keys)
    llas = np.asarray(srange, float)

    def run(batches):
        from chronoraster.functions.whittaker import _fit_and_roughness, ws2d

        for whole in batches:
            for b in _equal_lengths(whole):
                y, w = _matrix(b.column("y")), _matrix(b.column("w"))
                y = np.where(w > 0, y, 0.0)
                for x in llas:
                    f, r = _fit_and_roughness(y, w, ws2d(y, 10.0**x, w))
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], pa.array(np.full(len(f), x)), pa.array(f), pa.array(r)], names=[*keys, "log10_s", "fit", "rough"])

    return src.mapInArrow(run, f"{fields}, log10_s double, fit double, rough double")
