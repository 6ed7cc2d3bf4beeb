"""Incremental cubes with Structured Streaming: guarded appends and tail smoothing."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoraster.operators.cube import replace_dates


class StoredCube:
    """A long table at ``path``, partitioned by cube and date, that micro-batches are upserted into.

    A batch touches the partitions of its own cubes and dates only, so its cost
    does not grow with the table.  Its rows replace the stored ones of the same
    ``keys`` (pixel); a date's rows may come in several batches, and a repeated
    batch leaves the same rows.  Rows without a cube or a date are no readings.
    ``cube`` None: the table holds one cube and has no such column.
    """

    def __init__(self, spark: SparkSession, path: str, date_col: str = "obs_date", cube: str | None = "cube_id", keys: tuple[str, ...] = ("pixel_id",)):
        self.spark, self.path, self.date_col, self.cube, self.keys = spark, path.rstrip("/"), date_col, cube, keys
        self.partitions = [cube, date_col] if cube else [date_col]
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def dates(self, cube: str | None = None) -> list[date]:
        """The stored axis of a cube, from its partitions' names; without one, of all cubes."""
        if self.cube and cube is None:
            return sorted({d for c in self._cubes() for d in self._dates(f"{self.path}/{c}")})
        return sorted(self._dates(f"{self.path}/{self._folder(cube)}" if self.cube else self.path))

    def _folder(self, cube: str) -> str:
        names = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return names.getPartitionPathString(self.cube, cube)

    def _cubes(self) -> list[str]:
        root = self._path(self.path)
        return [n for s in self._fs.listStatus(root) if (n := s.getPath().getName()).startswith(f"{self.cube}=")] if self._fs.exists(root) else []

    def _dates(self, folder: str) -> list[date]:
        root, head = self._path(folder), f"{self.date_col}="
        names = (s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else ()
        return [date.fromisoformat(n.removeprefix(head)) for n in names if n.startswith(head)]

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if self.dates() else None

    def last(self, cube: str | None = None) -> date | None:
        return max(self.dates(cube), default=None)

    def append(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Upsert one batch. ValueError if a stored date that it does not replace is not before all of its cube's dates."""
        for c in self.partitions:
            batch = batch.where(F.col(c).isNotNull())
        new: dict[str | None, set[date]] = {}
        for r in batch.select(*self.partitions).distinct().collect():  # one per cube and day of the batch
            new.setdefault(r[self.cube] if self.cube else None, set()).add(r[self.date_col])
        again = False
        for cube, days in new.items():
            stored = self.dates(cube)
            kept = [d for d in stored if d not in days]
            if kept and max(kept) >= min(days):
                raise ValueError(f"batch {batch_id}: {f'{cube}: ' if cube else ''}stored date {max(kept)} does not precede the new date {min(days)}")
            again |= len(kept) < len(stored)
        if not new:
            return
        if again:
            old = self.spark.read.schema(batch.schema).parquet(self.path).join(F.broadcast(batch.select(*self.partitions).distinct()), self.partitions, "left_semi")
            kept_rows = old.join(batch.select(*self.partitions, *self.keys), [*self.partitions, *self.keys], "left_anti")
            batch = batch.unionByName(kept_rows.select(*batch.columns))
        replace_dates(batch, self.path, *self.partitions)


def append_stream(stream: DataFrame, store: StoredCube, checkpoint: str, expected_last: date | None = None, then: Callable[[DataFrame, int], None] | None = None):
    """Start a query that upserts each micro-batch and then hands it on.

    ``expected_last``: each stored cube's axis must end there before the stream starts.
    """
    if expected_last is not None:
        ends = {n: max(store._dates(f"{store.path}/{n}"), default=None) for n in store._cubes()} if store.cube else {"the cube": store.last()}
        bad = {n: e for n, e in ends.items() if e != expected_last} or ({} if ends else {"nothing stored": None})
        if bad:
            raise ValueError(f"stored axes do not end at {expected_last}: {bad}")

    def one(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        store.append(batch, batch_id)
        if then is not None:
            then(batch, batch_id)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail_smoother(nsmooth: int, svalue: float, nupdate: int = 1):
    """State function for ``applyInPandasWithState``: smooths a key's last ``nsmooth`` values as they arrive.

    State is the ring of (day number, value); output are the curve's last
    ``nupdate`` values, which replace what earlier batches gave for those days.
    """
    import numpy as np
    import pandas as pd

    from chronoraster.functions.whittaker import MIN_LENGTH, ws2d

    if not 1 <= nupdate <= nsmooth:
        raise ValueError("nsmooth must be at least nupdate, and nupdate at least 1")

    def step(key, batches, state):
        ring = dict(zip(*state.get)) if state.exists else {}
        for pdf in batches:
            for d, v in zip(pdf["day"], pdf["value"]):
                if not pd.isna(d):
                    ring[int(d)] = float("nan") if v is None else float(v)
        days = sorted(ring)[-nsmooth:]
        values = [ring[d] for d in days]
        state.update((days, values))
        y = np.array(values)[:, None]
        w = np.isfinite(y).astype(float)
        if len(days) >= MIN_LENGTH and w.sum() >= 2:
            z = ws2d(np.where(w > 0, y, 0.0), 10.0**svalue, w)[-nupdate:, 0]
            yield pd.DataFrame({"key": [key[0]] * len(z), "day": days[-nupdate:], "z": z})

    return step


def smooth_tail_stream(stream: DataFrame, nsmooth: int, svalue: float, nupdate: int = 1) -> DataFrame:
    """(key, day, z) of a stream (key bigint, day bigint, value double)."""
    return stream.groupBy(F.col("key")).applyInPandasWithState(tail_smoother(nsmooth, svalue, nupdate), "key bigint, day bigint, z double", "days array<bigint>, values array<double>", "update", "NoTimeout")
