"""The three chains end to end: collect granules, smooth cubes, export rasters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoraster.functions.axis import date_label, from_julian, target_days
from chronoraster.functions.session import fetched, join_small, settled, written
from chronoraster.operators import cube, granules, incremental, raster
from chronoraster.operators.cube import pixel_col, pixel_row
from chronoraster.operators.regular import regular_grid
from chronoraster.operators.smooth import COVERAGE, INTERPOLATION_PENALTY, ROWS, solve, stored
from chronoraster.operators.standing import MAX_CUBES, PACK, SHIFT, complete_meta, is_missing, packed, standing

EPOCH = date(1970, 1, 1)


def collect(pixels: DataFrame, code: str | None = None, tiles_required: list[str] | None = None) -> DataFrame:
    """Raw cube rows (cube_id, pixel_id, obs_date, value) from granule pixels (path, pixel_id, value).

    Names are parsed, unsupported products left out, Terra and Aqua vegetation
    indices interleaved, and of several files of a date the newest kept.
    ``tiles_required`` is checked first.
    """
    g = granules.parse_names(pixels.select("path").distinct())
    g = g.where(granules.supported(F.col("product")))
    if tiles_required:
        granules.require_tiles(g, tiles_required)
    mixed = granules.interleave(g)
    name = granules.cube_name(granules.vam_code(F.col("product"), code), F.col("product"), F.col("tile"), F.col("version"))
    chosen = granules.latest_versions(mixed.select("path", "proc_ts", name.alias("cube_id"), "raw_date").where("cube_id is not null"), "cube_id", "raw_date")
    return join_small(pixels, chosen.select("path", "cube_id", "raw_date"), "path", "inner").select("cube_id", "pixel_id", F.col("raw_date").alias("obs_date"), "value")


def require_order(stored_rows: DataFrame, new: DataFrame) -> None:
    cube.require_order(stored_rows, new, "obs_date", ("cube_id",))


def append_cube(stored_rows: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of many cubes as one plan: dates supplied again are replaced, new ones appended, in order."""
    return cube.upsert(stored_rows, new, "obs_date", ("cube_id",))


def smooth_cubes(
    raw: DataFrame,
    meta: DataFrame,
    svalue: float | None = None,
    p: float | None = None,
    optimise: bool = False,
    srange: list[float] | None = None,
    sgrid: DataFrame | None = None,
    step: int | None = None,
    start: date | None = None,
    nsmooth: int = 0,
    nupdate: int = 0,
    is_standing: bool = False,
    regular: bool = False,
) -> DataFrame:
    """(cube_id, pixel_id, target_date, value, log10_s, smoothed) for all cubes at once.

    Each cube has its own axis: the dates of its readings, or with ``regular``
    all periods from its first to its last one (dates are periods' first days);
    the last ``nsmooth`` of them (0 for all).  Every pixel of the cube is joined
    to it, with weight 0 where nothing was observed.  Options as in ``operators.smooth.smooth``; resolution
    and shift come from ``meta``.  ``is_standing``: (cube, pixel, date) is known
    to be unique.  Cubes with fewer than four dates, or fewer
    than ``nsmooth``, give no rows.  ``sgrid`` is (cube_id, pixel_id, log10_s).

    One shuffle brings each pixel's readings together, packed as one number
    each.  The cubes' axes are sent to the tasks once, if their bytes are within
    a bound, else joined.  Pixels of cubes of nearly one length form a kernel batch.
    """
    if nsmooth and nupdate > nsmooth:
        raise ValueError("nsmooth must be at least nupdate")
    if start is not None and step is None:
        raise ValueError("a start date needs a target step")
    if not optimise and svalue is None and sgrid is None:
        raise ValueError("give svalue, optimise or sgrid")
    info = complete_meta(meta).select("cube_id", "codes", "t").join(meta.select("cube_id", "tshift"), "cube_id")
    rows = raw if is_standing else standing(raw)
    if regular:
        ends = rows.groupBy("cube_id").agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("z"))
        axis = ends.join(info.where("t > 0").select("cube_id", "t"), "cube_id").select("cube_id", periods(F.col("a"), F.col("z"), F.col("t")).alias("full"))
    else:
        axis = rows.groupBy("cube_id").agg(F.array_sort(F.collect_set(F.unix_date("obs_date"))).alias("full"))
    last = F.slice("full", F.when(F.lit(nsmooth) > 0, F.size("full") - nsmooth + 1).otherwise(F.lit(1)), F.size("full"))
    axis = axis.where(F.size("full") >= max(4, nsmooth)).select("cube_id", "full", last.alias("axis"))
    axis = settled(axis.join(info, "cube_id"), MAX_CUBES)
    rows = join_small(rows, axis.select("cube_id", "codes", F.element_at("axis", 1).alias("first")), "cube_id", "inner", MAX_CUBES)
    # missing readings and those before the axis are not collected, but their pixels stay
    counts = ~is_missing(F.col("value"), F.col("codes")) & (F.unix_date("obs_date") >= F.col("first"))
    series = rows.groupBy("cube_id", "pixel_id").agg(F.collect_list(F.when(counts, packed(F.col("obs_date"), F.col("value")))).alias("p"))
    if sgrid is not None:
        series = series.join(sgrid.select("cube_id", "pixel_id", F.col("log10_s").cast("double").alias("s")), ["cube_id", "pixel_id"], "left")
    else:
        series = series.withColumn("s", F.lit(None).cast("double"))
    axis = axis.select("cube_id", "full", "axis", "t", F.coalesce("tshift", F.lit(0)).alias("tshift"))
    sent = fetched(axis, MAX_CUBES)
    if sent is None:  # axes beyond the bound travel with each pixel
        series, axes = series.join(axis, "cube_id"), None
    else:
        axes = raw.sparkSession.sparkContext.broadcast({r["cube_id"]: r for r in sent.to_pylist()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict = {}
        for whole in batches:
            names = whole.column("cube_id").to_pylist()
            if axes is None:
                for i, c in enumerate(names):
                    if c not in plans:
                        plans[c] = _axis_plan({k: whole.column(k)[i].as_py() for k in ("full", "axis", "t", "tshift")}, step, start, nupdate)
            else:
                for c in set(names) - plans.keys():
                    plans[c] = _axis_plan(axes.value[c], step, start, nupdate)
            mine = [plans[c] for c in names]
            for at in _alike(np.array([len(p.days) for p in mine]), np.array([p.n_daily for p in mine])):
                yield _smooth_batch(whole.take(pa.array(at)), [mine[i] for i in at], svalue, p, optimise, srange, step is not None)

    out = series.mapInArrow(run, "cube_id string, pixel_id bigint, day int, z double, log10_s double, smoothed boolean")
    return out.select("cube_id", "pixel_id", F.date_from_unix_date("day").alias("target_date"), stored(F.col("z")).alias("value"), "log10_s", "smoothed")


def require_steps(raw: DataFrame, nsmooth: int) -> None:
    """ValueError if a cube has fewer than ``nsmooth`` dates."""
    known = raw.dropna(subset=["cube_id", "pixel_id", "obs_date"])
    short = known.groupBy("cube_id").agg(F.countDistinct("obs_date").alias("n")).where(F.col("n") < nsmooth)
    bad = short.orderBy("cube_id").take(10)
    if bad:
        raise ValueError(f"{nsmooth} steps wanted; too few in " + ", ".join(f"{r['cube_id']} ({r['n']})" for r in bad))


def without_rows(raw: DataFrame, smooth: DataFrame) -> DataFrame:
    """(cube_id): raw cubes that a run gave no rows for: under four dates, or no metadata."""
    return raw.select("cube_id").dropna().distinct().join(smooth.select("cube_id").distinct(), "cube_id", "left_anti")


@dataclass(frozen=True)
class AxisPlan:
    """A cube's days, their places on its daily axis, the places of its target days there, these days, and the daily axis's length."""

    days: np.ndarray
    place: np.ndarray | None
    pick: np.ndarray | None
    target: np.ndarray
    n_daily: int


def _axis_plan(row: dict, step: int | None, start: date | None, nupdate: int) -> AxisPlan:
    days = np.array(row["axis"])
    if step is None:
        return AxisPlan(days, None, None, days[-nupdate:], 0)
    full = [EPOCH + timedelta(int(d)) for d in row["full"]]
    t, shift = int(row["t"] or 1), int(row["tshift"])
    daily, target = target_days(full, t, step, start)
    first = (daily[0] - EPOCH).days
    # the last shifted date may lie beyond the daily axis, which then grows
    n_daily = max(len(daily), int(days[-1]) + shift - first + 1)
    target = np.array([(d - EPOCH).days for d in target[-nupdate:]], int)
    return AxisPlan(days, days + shift - first, target - first, target, n_daily)


CELLS = 2_000_000  # steps times series of a kernel call
PADDING = 1.25  # longest axis of a call over its shortest one


def _alike(steps: np.ndarray, daily: np.ndarray) -> Iterator[np.ndarray]:
    """Series of a batch in groups of axes of nearly one length, up to ``ROWS`` series and ``CELLS`` cells each."""
    order = np.lexsort((daily, steps))
    i = 0
    while i < len(order):
        first, j, most = order[i], i + 1, max(daily[order[i]], steps[order[i]])
        while j < len(order) and j - i < ROWS:
            most = max(most, daily[order[j]], steps[order[j]])
            near = steps[order[j]] <= PADDING * steps[first] and daily[order[j]] <= PADDING * max(daily[first], 1) and daily[first] <= PADDING * max(daily[order[j]], 1)
            if not near or most * (j - i + 1) > CELLS:
                break
            j += 1
        yield order[i:j]
        i = j


def _smooth_batch(b: pa.RecordBatch, plans: list[AxisPlan], svalue, p, optimise, srange, interpolate: bool) -> pa.RecordBatch:
    """Curves of series of several cubes in one kernel call.

    Shorter axes are filled up with steps of weight 0: the curve goes on there as
    a straight line, which costs nothing, so it is the same before.
    """
    from chronoraster.functions.whittaker import ws2d

    n = b.num_rows
    steps = np.array([len(x.days) for x in plans])
    lists = b.column("p")
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    y, w = np.zeros((int(steps.max()), n)), np.zeros((int(steps.max()), n))
    code, day = flat % PACK, flat // PACK
    begin = np.searchsorted(row, np.arange(n + 1))
    for i, x in enumerate(plans):
        k = slice(begin[i], begin[i + 1])
        keep = code[k] != 0
        at = np.searchsorted(x.days, day[k][keep])
        y[at, i], w[at, i] = code[k][keep] - SHIFT, 1.0
    enough = w.sum(axis=0) >= COVERAGE * steps
    z, log = np.where(w > 0, y, np.nan), np.full(n, np.nan)
    if enough.any():
        s = b.column("s").to_numpy(zero_copy_only=False).astype(float)
        z[:, enough], log[enough] = solve(y[:, enough], w[:, enough], s[enough], svalue, p, optimise, srange)
    if interpolate:
        daily = max(x.n_daily for x in plans)
        cols = np.flatnonzero(enough)
        d, dw = np.zeros((daily, len(cols))), np.zeros((daily, len(cols)))
        for j, i in enumerate(cols):
            d[plans[i].place, j], dw[plans[i].place, j] = z[: steps[i], i], 1.0
        if len(cols):
            d = ws2d(d, INTERPOLATION_PENALTY, dw)
        column = np.full(n, -1)
        column[cols] = np.arange(len(cols))
        values = [d[x.pick, column[i]] if enough[i] else np.full(len(x.pick), np.nan) for i, x in enumerate(plans)]
    else:
        values = [z[steps[i] - len(x.target) : steps[i], i] for i, x in enumerate(plans)]
    size = np.array([len(v) for v in values])
    idx = pa.array(np.repeat(np.arange(n), size))
    return pa.RecordBatch.from_arrays(
        [b.column("cube_id").take(idx), b.column("pixel_id").take(idx), pa.array(np.concatenate([x.target for x in plans]), pa.int32()), pa.array(np.concatenate(values), from_pandas=True), pa.array(np.repeat(log, size), from_pandas=True), pa.array(np.repeat(enough, size))],
        names=["cube_id", "pixel_id", "day", "z", "log10_s", "smoothed"],
    )


def periods(first: Column, last: Column, t: Column) -> Column:
    """First days (since 1970) of all periods of ``t`` days from ``first`` to ``last``; they start anew each 1 January."""
    day = lambda y, m, d: F.unix_date(F.make_date(y, F.lit(m), F.lit(d)))
    years = F.transform(F.sequence(F.year(first), F.year(last)), lambda y: F.sequence(day(y, 1, 1), day(y, 12, 31), t.cast("int")))
    return F.filter(F.flatten(years), lambda d: d.between(F.unix_date(first), F.unix_date(last)))


def composites(raw: DataFrame, meta: DataFrame) -> DataFrame:
    """Irregular readings as a raw cube on its regular axis: (cube_id, pixel_id, obs_date, value).

    One row per period from a pixel's first to its last reading; value is null where none is valid.
    """
    grid = regular_grid(raw, meta)
    value = F.when(F.col("status") == "observed", F.col("value"))
    return grid.select("cube_id", "pixel_id", from_julian(F.col("period").cast("string")).alias("obs_date"), stored(value).alias("value"))


def smooth_meta(meta: DataFrame, step: int | None) -> DataFrame:
    """Attributes of the smooth cubes: the raw cube's, under the smooth cube's name, with ``step`` as its temporal resolution if there is one."""
    out = meta.withColumn("cube_id", granules.smooth_name(F.col("cube_id"), step))
    return out if step is None else out.withColumn("temporalresolution", F.lit(step))


def update_sgrid(old: DataFrame | None, smooth: DataFrame) -> DataFrame:
    """Penalties after an optimising run: smoothed pixels get the new one, others keep theirs."""
    new = smooth.where("smoothed").groupBy("cube_id", "pixel_id").agg(F.max("log10_s").cast("float").alias("log10_s"))
    if old is None:
        return new
    both = old.select("cube_id", "pixel_id", F.col("log10_s").alias("old_s")).join(new, ["cube_id", "pixel_id"], "full")
    return both.select("cube_id", "pixel_id", F.coalesce("log10_s", "old_s").cast("float").alias("log10_s"))


RUN_SCHEMA = "run_id bigint, cube_id string, lastrun string, pvalue double, processed_at timestamp, status string, rawdates array<string>"


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """The run log; empty if there is none yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(RUN_SCHEMA).parquet(path) if there else spark.createDataFrame([], RUN_SCHEMA)


def run_rows(raw: DataFrame, smooth: DataFrame, lastrun: str, p: float | None, processed_at: datetime) -> DataFrame:
    """One run log row for each cube with rows in ``smooth``: description, p value, time and the dates in ``raw``."""
    used = raw.dropna(subset=["cube_id", "pixel_id", "obs_date"]).join(smooth.select("cube_id").distinct(), "cube_id", "left_semi")
    rows = used.groupBy("cube_id").agg(F.array_sort(F.collect_set(F.date_format("obs_date", "yyyyDDD"))).alias("rawdates"))
    run = F.xxhash64(F.lit(uuid4().hex), "cube_id").alias("run_id")
    return rows.select(run, "cube_id", F.lit(lastrun).alias("lastrun"), F.lit(p).cast("double").alias("pvalue"), F.lit(processed_at).alias("processed_at"), F.lit("ok").alias("status"), "rawdates")


def publish(log: incremental.CommitLog, out: str) -> None:
    """Bring committed runs that are not there yet into the smooth table and their run log, in order.

    Each commit holds whole partitions and its rows' run_id, so that a failed
    attempt is made good by another one.
    """
    spark = log.spark
    for n, c in log.unpublished():
        cube.replace_dates(spark.read.parquet(f"{log.path}/{c['data']}"), out, *cube.SMOOTH_PARTITIONS)
        if c["run_log"]:
            rows = spark.read.schema(RUN_SCHEMA).parquet(f"{log.path}/{c['manifest']}")
            rows.join(read_run_log(spark, c["run_log"]).select("run_id"), "run_id", "left_anti").select(*rows.columns).write.mode("append").parquet(c["run_log"])
        log.mark_published(n)


def smooth_run(spark: SparkSession, raw_path: str, meta: DataFrame, out: str, lastrun: str, run_log: str | None = None, granules_path: str | None = None, **options) -> None:
    """Smooth raw cubes into the table ``out`` as one commit of rows and run log.

    The time of the run is taken before the raw files are listed, once, and both
    the rows and the logged dates come from that listing: what is collected later
    has a later ``collected_at`` and stays pending.  ``collected_at`` has to be
    taken when a granule's rows are in the raw table.  With ``granules_path``
    only cubes with pending dates are smoothed, whole.  A run that failed after
    its commit in ``out/_runs`` is published first.
    """
    log = incremental.CommitLog(spark, f"{out}/_runs")
    publish(log, out)
    base = len(log.commits())
    started = datetime.now(timezone.utc)
    raw = spark.read.parquet(raw_path)
    if granules_path:
        todo = incremental.pending(spark.read.parquet(granules_path), read_run_log(spark, run_log))
        # rows of dates without a granule stay in the raw cubes: nothing to smooth anew
        todo = settled(todo.where("change <> 'removed'").select("cube_id").distinct(), MAX_CUBES)
        if not todo.take(1):
            print("nothing is pending")
            return
        raw = raw.join(todo, "cube_id", "left_semi")
    if options.get("nsmooth"):
        require_steps(raw, options["nsmooth"])
    rows = written(smooth_cubes(raw, meta, **options), "smooth")
    log.write(cube.with_kept_pixels(rows, out), started.isoformat(), run_rows(raw, rows, lastrun, options.get("p"), started), base, run_log=run_log)
    publish(log, out)
    for r in without_rows(raw, rows).orderBy("cube_id").toLocalIterator():
        print(f"{r['cube_id']}: not smoothed, fewer than four dates or no metadata")


def export(smooth: DataFrame, meta: DataFrame, step: int | None, start: date | None = None, end: date | None = None, clip: bool = True, rounding: int = 0, prefix: str = "") -> DataFrame:
    """Rasters (image, cube_id, row, col, value) of smooth or raw cubes, one image per group of cubes and date.

    Values are clipped to the cube's range and rounded to 10**rounding; cubes
    of one product and version over all tiles share an image, tiles apart.
    """
    day = "target_date" if "target_date" in smooth.columns else "obs_date"
    m = complete_meta(meta).select("cube_id", "vmin", "vmax").join(meta.select("cube_id", "rows", "cols", "vamcode"), "cube_id")
    s = join_small(raster.date_window(smooth, day, start, end), m, "cube_id", "inner", MAX_CUBES)
    v: Column = F.col("value").cast("double")
    if clip:
        v = F.when(v.isNotNull(), F.greatest("vmin", F.least("vmax", v)))
    if rounding:
        v = raster.round_int(v, rounding)
    name = F.concat(F.lit(prefix), F.lower(F.coalesce(F.nullif(F.trim("vamcode"), F.lit("")), F.lit("x"))), date_label(F.col(day), step))
    return s.select(name.alias("image"), "cube_id", pixel_row(F.col("pixel_id"), F.col("cols")).alias("row"), pixel_col(F.col("pixel_id"), F.col("cols")).alias("col"), v.alias("value"))


WORLD = (-180.0, 90.0, 180.0, -90.0)


def window(
    cubes: DataFrame,
    meta: DataFrame,
    box: tuple[float, float, float, float] = WORLD,
    res: tuple[float, float] | None = None,
    step: int | None = None,
    start: date | None = None,
    end: date | None = None,
    clip: bool = True,
    rounding: int = 0,
    prefix: str = "",
    value: str = "value",
) -> DataFrame:
    """(grp, image, trow, tcol, value): one mosaic in degrees per group of cubes and date, nearest, cut to ``box``.

    A group are the cubes of one product and version over all tiles.  Values are
    clipped to their cube's range and rounded to 10**rounding, the tiles warped
    to a grid over ``box`` (ulx, uly, lrx, lry) of ``res`` degrees (the cube's
    pixel size without it), and where tiles overlap the one latest by name wins
    where it has data.  Pixels without data are left out.  Without a date column
    (penalty grids) the image is named ``_sgrid``.

    Pixels find their place in the grid by themselves (``forward_warp``), so the
    one shuffle is the mosaic's.  Cubes without an affine transform or of null
    size give no rows; a null ``is_global`` counts as false.
    """
    day = next((c for c in ("target_date", "obs_date") if c in cubes.columns), None)
    m = complete_meta(meta).select("cube_id", "vmin", "vmax").join(
        meta.select("cube_id", "cols", F.col("geotransform").alias("gt"), "vamcode", F.coalesce("is_global", F.lit(False)).alias("is_global")), "cube_id"
    ).where((F.size("gt") == 6) & (F.col("cols") > 0))
    label = date_label(F.col(day), step) if day else F.lit("_sgrid")
    s = (raster.date_window(cubes, day, start, end) if day else cubes).select("cube_id", "pixel_id", *([day] if day else []), F.col(value).cast("double").alias("v")).where("v is not null")
    s = join_small(s, m, "cube_id", "inner", MAX_CUBES)
    v: Column = F.col("v")
    if clip and day:
        v = F.greatest("vmin", F.least("vmax", v))
    if rounding:
        v = raster.round_int(v, rounding)
    image = F.concat(F.lit(prefix), F.lower(F.coalesce(F.nullif(F.trim("vamcode"), F.lit("")), F.lit("x"))), label)
    s = s.select("cube_id", raster.group_name(F.col("cube_id")).alias("grp"), image.alias("image"), "gt", "is_global", pixel_row(F.col("pixel_id"), F.col("cols")).alias("row"), pixel_col(F.col("pixel_id"), F.col("cols")).alias("col"), v.alias("value"))
    own = lambda i: raster.output_resolution(F.transform(F.array(F.col("gt")[1], F.col("gt")[5]), F.abs), F.col("is_global"))[i]
    xres, yres = (F.lit(float(r)) for r in res) if res else (own(0), own(1))
    return raster.mosaic(raster.forward_warp(s, box, xres, yres), "cube_id", ["grp", "image", "trow", "tcol"], "value")


def check_group(smooth: DataFrame) -> None:
    """ValueError if cubes of one mosaic (same name but for the tile) have different axes."""
    day = "target_date" if "target_date" in smooth.columns else "obs_date"
    axes = smooth.groupBy(raster.group_name(F.col("cube_id")).alias("g"), "cube_id").agg(F.array_sort(F.collect_set(day)).alias("dates"))
    bad = axes.groupBy("g").agg(F.countDistinct("dates").alias("n")).where("n > 1").take(1)
    if bad:
        raise ValueError(f"{bad[0]['g']}: the cubes have {bad[0]['n']} different axes")

