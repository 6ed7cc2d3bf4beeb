"""Weighted K-prototypes: numeric means and categorical modes (problem 3)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoraster.functions.session import written


@dataclass
class Prototypes:
    """Cluster centres. ``gamma`` weighs one categorical mismatch against squared numeric distance."""

    numeric: np.ndarray  # k x p
    categorical: np.ndarray  # k x q, objects
    gamma: np.ndarray  # q

    def assign(self, numeric: np.ndarray, categorical: np.ndarray) -> np.ndarray:
        """Nearest centre; NaN and None are unobserved and add no distance. Ties go to the first centre."""
        n = len(numeric)
        best, where = np.full(n, np.inf), np.zeros(n, np.int64)
        known = np.isfinite(numeric)
        said = categorical != None  # noqa: E711
        for k in range(len(self.numeric)):
            d = np.where(known, (np.where(known, numeric, 0) - self.numeric[k]) ** 2, 0).sum(axis=1)
            d += ((categorical != self.categorical[k]) & said) @ self.gamma
            closer = d < best - 1e-12
            best[closer], where[closer] = d[closer], k
        return where


    def nearest(self, numeric: list[Column], categorical: list[Column]) -> Column:
        """``assign`` as a column, on Arrow batches: 16 centres are too long a method for the JVM to compile
        as one expression, and 20 times slower there as a fold over an array."""
        centres, modes, gamma, n_numeric = self.numeric, self.categorical, self.gamma, len(numeric)

        @F.arrow_udf("int")
        def cluster(*columns: pa.Array) -> pa.Array:
            x = [c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in columns[:n_numeric]]
            known = [np.isfinite(v) for v in x]
            x = [np.where(k, v, 0.0) for k, v in zip(known, x)]
            kinds = [c.dictionary_encode(null_encoding="encode") for c in columns[n_numeric:]]
            codes = [c.indices.to_numpy(zero_copy_only=False) for c in kinds]
            names = [np.array(c.dictionary.to_pylist(), object) for c in kinds]
            best, where = np.full(len(columns[0]), np.inf), np.zeros(len(columns[0]), np.int32)
            for k in range(len(centres)):
                d = sum(there * (v - c) ** 2 for there, v, c in zip(known, x, centres[k]))
                for code, name, mode, g in zip(codes, names, modes[k], gamma):
                    d = d + np.where((name != mode) & (name != None), g, 0.0)[code]  # noqa: E711
                closer = d < best - 1e-12
                best[closer], where[closer] = d[closer], k
            return pa.array(where)

        return cluster(*[c.cast("double") for c in numeric], *[c.cast("string") for c in categorical])


UNIT = float(1 << 20)
BLOCK = 1 << 14  # records worked on at a time
IN_MEMORY = 100_000  # records up to which a table is fitted on the driver, with the same result


@dataclass
class Records:
    """Up to ``BLOCK`` records: numeric columns with NaN where unobserved, and two numbers each, of the record's categories and of its given values."""

    x: list[np.ndarray]
    labels: list[np.ndarray]
    weight: np.ndarray | None = None

    def distances(self, centres: np.ndarray, apart: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Distance of all records to each centre in turn; what is NaN in either adds none. ``apart``: that of the labels."""
        gone = [g if g.any() else None for g in map(np.isnan, self.x)]
        for k, centre in enumerate(centres):
            d = apart[0][k][self.labels[0]]
            d += apart[1][k][self.labels[1]]
            for v, g, c in zip(self.x, gone, centre):
                if not np.isnan(c):
                    step = v - c
                    step *= step
                    if g is not None:
                        step[g] = 0
                    d += step
            yield d

    def farthest(self, picked: np.ndarray, apart: list[np.ndarray]) -> tuple:
        """(score, values..., labels...) of the record farthest, by weight, from those picked (the heaviest without any);
        of several the one with the smallest values, NaN last, and labels."""
        far = np.ones(len(self.labels[0])) if self.weight is None else np.sqrt(self.weight)
        if len(picked):
            far = far * np.minimum.reduce(list(self.distances(picked, apart)))
        top = np.flatnonzero(far == far.max())
        for v in (*self.x, *self.labels):
            if len(top) > 1 and not np.isnan(v[top]).all():
                top = top[v[top] == np.nanmin(v[top])]
        return far[top[0]], *[v[top[0]] for v in (*self.x, *self.labels)]

    def sums(self, centres: np.ndarray, apart: list[np.ndarray]) -> np.ndarray:
        """What the next centres follow from, in one array: records by cluster and label, for both labels; then for each
        numeric column by cluster the records that have it, and its sum in whole units and in parts of a unit.

        All of it are whole numbers (with whole weights), so sums do not depend on the order of records.
        """
        n, k = len(self.labels[0]), len(centres)
        best, where = np.full(n, np.inf), np.zeros(n, np.int64)
        for c, d in enumerate(self.distances(centres, apart)):
            closer = d < best - 1e-12
            np.copyto(best, d, where=closer)
            where[closer] = c
        out = [np.bincount(where * a.shape[1] + label, self.weight, a.size) for label, a in zip(self.labels, apart)]
        for v in self.x:
            known = np.isfinite(v)
            there = known if self.weight is None else known * self.weight
            units = np.where(known, v, 0) * UNIT
            whole = np.floor(units)
            out += [np.bincount(where, w, k) for w in (there, there * whole, there * np.rint((units - whole) * UNIT))]
        return np.concatenate(out).astype(float)


def _first(found: Iterator[tuple]) -> tuple | None:
    return min(found, key=lambda r: (-r[0], *[np.inf if np.isnan(v) else v for v in r[1:]]), default=None)


def _lloyd(farthest, sums, p: int, kinds: list[tuple], given: np.ndarray, k: int, gamma: np.ndarray, rounds: int) -> Prototypes:
    """Lloyd iterations over records that only ``farthest`` and ``sums`` see, in a pass over all of them per call.

    Starts from the heaviest record and adds the one that is farthest, by
    weight, from all centres so far; ends when no centre changes.
    """
    m, q, days = len(kinds), len(gamma), len(given)
    names = [sorted({row[j] for row in kinds} - {None}) for j in range(q)]
    place = [{v: i for i, v in enumerate(c)} | {None: -1} for c in names]
    code = np.array([[place[j][v] for j, v in enumerate(row)] for row in kinds], np.int64).reshape(m, q)

    def apart(centres: np.ndarray, modes: np.ndarray, both: bool) -> list[np.ndarray]:
        """Distance of all kinds and given values to centres; ``both``: a category that a centre lacks adds none."""
        differ = (code[None] != modes[:, None]) & (code >= 0) & ((modes[:, None] >= 0) | (not both))
        return [differ @ gamma, ((given[None] - centres[:, None, p:]) ** 2).sum(axis=2)]

    centres, modes = np.zeros((0, p + given.shape[1])), np.zeros((0, q), np.int64)
    while len(centres) < k:
        found = farthest(centres[:, :p], apart(centres, modes, True))
        if found is None:
            return Prototypes(np.zeros((1, p + given.shape[1])), np.full((1, q), None, object), gamma)
        score, *x, kind, day = found
        if len(centres) and score <= 0:
            break
        centres, modes = np.vstack([centres, [*x, *given[int(day)]]]), np.vstack([modes, code[int(kind)]])
    k, centres = len(centres), np.where(np.isnan(centres), 0, centres)
    for _ in range(rounds):
        by_kind, by_day, rest = np.split(sums(centres[:, :p], apart(centres, modes, False)), [k * m, k * (m + days)])
        by_kind, by_day = by_kind.reshape(k, m), by_day.reshape(k, days)
        new, new_modes = centres.copy(), modes.copy()
        for j, (seen, whole, part) in enumerate(rest.reshape(p, 3, k)):
            new[:, j] = np.where(seen > 0, (whole + part / UNIT) / UNIT / np.where(seen > 0, seen, 1), centres[:, j])
        for c in np.flatnonzero(by_kind.sum(axis=1) > 0):
            new[c, p:] = (by_day[c][:, None] * given).sum(axis=0) / by_day[c].sum()
            for j in range(q):
                said = code[:, j] >= 0
                votes = np.bincount(code[said, j], by_kind[c, said], len(names[j]))
                new_modes[c, j] = np.argmax(votes) if votes.any() else -1
        same = np.array_equal(new, centres) and np.array_equal(new_modes, modes)
        centres, modes = new, new_modes
        if same:
            break
    chosen = [[None if v < 0 else names[j][v] for j, v in enumerate(row)] for row in modes]
    return Prototypes(centres, np.array(chosen, object).reshape(k, q), gamma)


NONE_GIVEN = np.zeros((1, 0))


def fit(numeric: np.ndarray, categorical: np.ndarray, weight: np.ndarray, k: int, gamma: np.ndarray, rounds: int = 20) -> Prototypes:
    """Clusters of weighted records in memory; their order does not matter."""
    number = {row: i for i, row in enumerate(sorted(set(map(tuple, categorical)), key=lambda row: [(v is not None, v or "") for v in row]))}
    kind = np.array([number[tuple(row)] for row in categorical], np.int64)
    x = np.where(np.isfinite(numeric), numeric, np.nan)
    every = [Records(list(x[i].T), [kind[i], np.zeros_like(kind[i])], weight[i]) for i in (slice(a, a + BLOCK) for a in range(0, len(kind), BLOCK))]
    return _in_memory(every, x.shape[1], list(number), NONE_GIVEN, k, gamma, rounds)


def _in_memory(every: list[Records], p: int, *how) -> Prototypes:
    return _lloyd(lambda *at: _first(r.farthest(*at) for r in every), lambda *at: sum(r.sums(*at) for r in every), p, *how)


def fit_table(records: DataFrame, numeric: list[str], kinds: list[tuple], k: int, gamma: np.ndarray, given: np.ndarray = NONE_GIVEN, rounds: int = 20) -> Prototypes:
    """``fit`` on all rows of a table: ``numeric``, then ``given`` values as numeric columns, and categories.

    ``kind`` is the number of a row's categories in ``kinds``, ``day`` that of its
    row of ``given``.  The rows are packed once into blocks of bytes, which keeps
    reading them cheap.  Every centre at the start and every round is a pass over
    all blocks, of which the driver gets one row per task, or one number per
    cluster and kind or day.
    """
    p, labels = len(numeric), {"kind": np.min_scalar_type(len(kinds)), "day": np.min_scalar_type(len(given))}
    columns = {c: np.dtype(float) for c in numeric} | labels

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                rows += b.num_rows
            if rows >= BLOCK or (b is None and rows):
                t = pa.Table.from_batches(held)
                parts = [(t[c].fill_null(np.nan) if c in numeric else t[c]).to_numpy().astype(kind).tobytes() for c, kind in columns.items()]
                yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), *[pa.array([b], pa.binary()) for b in parts]], ["rows", *columns])
                held, rows = [], 0

    def unpacked(b: pa.RecordBatch | pa.Table) -> Iterator[Records]:
        for row in zip(*[b.column(c) for c in columns]):
            x = [np.frombuffer(v.as_buffer(), kind) for v, kind in zip(row, columns.values())]
            yield Records([np.where(np.isfinite(v), v, np.nan) for v in x[:p]], [v.astype(np.int64) for v in x[p:]])

    records = records.select(*[F.col(c).cast("double") for c in numeric], *labels)
    blocks = written(records.mapInArrow(pack, "rows bigint, " + ", ".join(f"`{c}` binary" for c in columns)), "records")
    how = (kinds, given, k, gamma, rounds)
    if (blocks.agg(F.sum("rows")).first()[0] or 0) <= IN_MEMORY:
        return _in_memory(list(unpacked(blocks.toArrow())), p, *how)

    def farthest(*at):
        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _first(r.farthest(*at) for b in batches for r in unpacked(b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in found], ["score", *columns])

        rows = blocks.drop("rows").mapInArrow(of_task, ", ".join(f"`{c}` double" for c in ("score", *columns)))
        return _first(map(tuple, rows.collect()))

    def sums(*at):
        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat = 0
            for b in batches:
                for r in unpacked(b):
                    flat = flat + r.sums(*at)
            slot = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.atleast_1d(flat)[slot].astype(np.int64))], ["slot", "n"])

        rows = blocks.drop("rows").mapInArrow(of_task, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        flat = np.zeros(sum(a.size for a in at[1]) + len(at[0]) * 3 * p)
        flat[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
        return flat

    return _lloyd(farthest, sums, p, *how)
