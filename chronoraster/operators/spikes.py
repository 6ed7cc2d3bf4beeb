"""Implausible readings of each source (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoraster.functions.session import join_small
from chronoraster.operators.standing import MAX_CUBES, complete_meta, is_missing, standing_by_pixel


def flag_readings(raw: DataFrame, meta: DataFrame) -> DataFrame:
    """(obs_id, fault) of standing readings that are not missing; fault 0 is none.

    fault is a sum of 1 (outside vmin..vmax), 2 (one of six or more equal
    readings in a row) and 4 (spike, see ``spikekernel``).  A null bound does
    not bound; cubes without attributes have no bounds and no codes for missing
    data.  A pixel's series has at most one reading a day, so a task's unit of
    work is bounded; copies are reduced before the shuffle.
    """
    info = complete_meta(meta).select("cube_id", "codes", "vmin", "vmax")
    rows = join_small(standing_by_pixel(raw), info, "cube_id", "left", MAX_CUBES, ("cube_id", "pixel_id"))
    rows = rows.where(~is_missing(F.col("value"), F.coalesce("codes", F.array().cast("array<double>"))))
    rows = rows.select(F.col("cube_id").alias("c"), F.col("pixel_id").alias("x"), F.unix_date("obs_date").alias("d"), "obs_id", "value", F.col("vmin").cast("float"), F.col("vmax").cast("float"))
    rows = rows.sortWithinPartitions("c", "x", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from chronoraster.functions.spikekernel import flag

        def series(t: pa.Table):
            """Flags of a table that holds whole series."""
            c = t.column("c").combine_chunks().dictionary_encode()
            c = c.indices.to_numpy(zero_copy_only=False)
            x = t.column("x").to_numpy()
            new = np.append(True, (c[1:] != c[:-1]) | (x[1:] != x[:-1]))
            starts = np.flatnonzero(new)
            size = np.diff(np.append(starts, len(x)))
            day, value = t.column("d").to_numpy().astype(float), t.column("value").to_numpy().astype(float)
            lo, hi = (t.column(k).to_numpy().astype(float)[starts] for k in ("vmin", "vmax"))
            out = np.zeros(len(x), np.uint8)
            order = np.argsort(size, kind="stable")
            i = 0
            while i < len(order):
                j = i + 1
                while j < len(order) and j - i < 256 and (j - i + 1) * size[order[j]] <= 200_000:
                    j += 1
                pick = order[i:j]
                width = int(size[pick].max())
                cell = starts[pick][:, None] + np.arange(width)
                there = np.arange(width) < size[pick][:, None]
                cell = np.where(there, cell, 0)
                f = flag(np.where(there, value[cell], np.nan), np.where(there, day[cell], np.nan), lo[pick], hi[pick])
                out[cell[there]] = f[there]
                i = j
            return pa.RecordBatch.from_arrays([t.column("obs_id").combine_chunks(), pa.array(out.astype(np.int32))], names=["obs_id", "fault"])

        kept: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            kept.append(b)
            held += b.num_rows
            if held < 60_000:
                continue
            t = pa.Table.from_batches(kept)
            # the last series may go on in the next batch
            c, x = t.column("c")[-1].as_py(), t.column("x")[-1].as_py()
            xs = t.column("x").to_numpy()
            cut = len(xs)
            while cut and xs[cut - 1] == x and t.column("c")[cut - 1].as_py() == c:
                cut -= 1
            if cut:
                yield series(t.slice(0, cut))
            kept = t.slice(cut).to_batches()
            held = t.num_rows - cut
        if held:
            yield series(pa.Table.from_batches(kept))

    return rows.mapInArrow(run, "obs_id bigint, fault int")
