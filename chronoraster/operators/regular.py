"""Irregular readings onto a regular grid (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoraster.functions.session import join_small
from chronoraster.operators.standing import MAX_CUBES, PACK, SHIFT, complete_meta, packed, standing_by_pixel

GAP_PERIODS = 5  # longest gap that is interpolated, in periods ...
GAP_DAYS = 180  # ... and in days; two gaps must fit into a shard of one year
STATUS = ("observed", "interpolated", "gap")


def regular_grid(raw: DataFrame, meta: DataFrame, gap_periods: int = GAP_PERIODS) -> DataFrame:
    """(cube_id, pixel_id, period, value, n_readings, status) from a pixel's first to last reading.

    period is the period's first day as YYYYDDD; periods start anew each 1
    January.  status ``observed``: value is the mean of the period's valid
    readings.  ``interpolated``: none, but monotone cubic interpolation at the
    period's middle between valid readings at most ``gap_periods`` periods
    apart.  ``gap``: a longer gap or no valid reading on one side; value null.

    A source's readings are split into shards of one calendar year.  Shards
    exchange their last and first two valid readings, so slopes at shard edges
    are those of the whole series.  Cubes without a temporal resolution, own or
    of their product, give no rows; rows without cube, pixel or date are no
    readings; an empty table gives an empty grid.
    """
    # one partitioning for readings, for shards and for the exchange between them; a pixel has at most one reading a day
    series = standing_by_pixel(raw).select("cube_id", "pixel_id", packed(F.col("obs_date"), F.col("value")).alias("p"))
    shards = series.groupBy("cube_id", "pixel_id", F.year(F.date_from_unix_date(F.floor(F.col("p") / PACK).cast("int"))).alias("shard")).agg(F.sort_array(F.collect_list("p")).alias("own"))
    info = complete_meta(meta).where("t > 0").select("cube_id", "t", F.transform("codes", lambda c: c.cast("bigint") + F.lit(SHIFT)).alias("codes"))
    shards = join_small(shards, info, "cube_id", "inner", MAX_CUBES, ("cube_id", "pixel_id"))
    low = lambda p: F.pmod(p, F.lit(PACK))
    valid = F.filter("own", lambda p: (low(p) != 0) & ~F.array_contains("codes", low(p)))
    shards = shards.withColumn("valid", valid)
    w = Window.partitionBy("cube_id", "pixel_id").orderBy("shard")
    tail = F.expr("slice(valid, greatest(size(valid) - 1, 1), 2)")
    shards = shards.select(
        "cube_id", "pixel_id", "t", "own", "codes",
        F.lag(tail).over(w).alias("halo_before"),
        F.lead(F.slice("valid", 1, 2)).over(w).alias("halo_after"),
        F.lag(F.floor(F.element_at("own", -1) / PACK).cast("bigint")).over(w).alias("before"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from chronoraster.functions.gridkernel import grid

        names = pa.array(STATUS)
        for whole in batches:
            for i in range(0, whole.num_rows, 4000):
                b = whole.slice(i, 4000)
                n = b.num_rows
                t = b.column("t").to_numpy(zero_copy_only=False).astype(np.int64)
                lists = [b.column(c) for c in ("halo_before", "own", "halo_after")]
                length = np.stack([np.nan_to_num(pa.compute.list_value_length(a).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64) for a in lists])
                each = length.sum(axis=0)
                starts = np.cumsum(each) - each
                p = np.zeros(int(each.sum()), np.int64)
                own = np.zeros(len(p), bool)
                for j, a in enumerate(lists):
                    at = starts + length[:j].sum(axis=0)
                    idx = np.repeat(at - (np.cumsum(length[j]) - length[j]), length[j]) + np.arange(int(length[j].sum()))
                    p[idx] = a.flatten().to_numpy(zero_copy_only=False)
                    own[idx] = j == 1
                row = np.repeat(np.arange(n), each)
                day, code = p // PACK, p % PACK
                valid = code != 0
                for k, codes in _codes(b.column("codes")):
                    valid &= ~((code == codes[row]) & (k[row]))
                before = b.column("before").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                g_row, label, value, count, status = grid(day, (code - SHIFT).astype(float), valid, own, row, n, t, before, np.minimum(t * gap_periods, GAP_DAYS))
                at = pa.array(g_row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("cube_id").take(at), b.column("pixel_id").take(at), pa.array(label), pa.array(value, from_pandas=True), pa.array(count), names.take(pa.array(status))],
                    names=["cube_id", "pixel_id", "period", "value", "n_readings", "status"],
                )

    return shards.mapInArrow(run, "cube_id string, pixel_id bigint, period bigint, value double, n_readings int, status string")


def _codes(column):
    """The codes' lists as (present, value) arrays, one pair per position."""
    import numpy as np
    import pyarrow.compute as pc

    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for k in range(int(np.nanmax(n)) if len(n) else 0):
        has = n > k
        values = np.zeros(len(column), np.int64)
        if has.any():
            keep = pa.array(np.flatnonzero(has))
            values[has] = pc.list_element(column.take(keep), k).to_numpy(zero_copy_only=False)
        yield has, values


def missing_periods(grid: DataFrame) -> DataFrame:
    """(cube_id, pixel_id, period) of the grid's periods without a reading."""
    return grid.where("n_readings = 0 and status <> 'observed'").select("cube_id", "pixel_id", "period")
