"""Raw cubes: long and array form, upsert, tails, checks."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def to_series(long: DataFrame, keys: list[str], date_col: str, value: str, axis: list[date], unique: bool = False) -> DataFrame:
    """(keys, y, w): one array over ``axis`` per key; a date without a value has y 0 and w 0.

    Of several values of a date the greatest counts; they are reduced before the
    shuffle, which ``unique`` skips where (keys, date) is known to be unique.
    Null and NaN values count as missing, dates off the axis are left out.
    """
    spark = long.sparkSession
    place = F.broadcast(spark.createDataFrame(list(enumerate(axis)), "__i int, __day date"))
    s = long.select(*keys, F.col(date_col).cast("date").alias("__day"), F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    s = s.join(place, "__day").drop("__day")
    if not unique:
        s = s.groupBy(*keys, "__i").agg(F.max("__v").alias("__v"))
    s = s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__i", "__v"))).alias("__o"))
    # each value and the empty steps up to the next one: linear in the axis, where looking up every step in a map is not
    n, nothing = F.lit(len(axis)), F.lit(None).cast("double")
    following = F.concat(F.transform(F.slice("__o", 2, len(axis)), lambda x: x["__i"]), F.array(n))
    steps = F.flatten(F.zip_with("__o", following, lambda x, j: F.concat(F.array(x["__v"]), F.array_repeat(nothing, j - x["__i"] - 1))))
    full = F.concat(F.array_repeat(nothing, F.col("__o")[0]["__i"]), steps)
    s = s.select(*keys, full.alias("__f"))
    return s.select(*keys, F.transform("__f", lambda v: F.coalesce(v, F.lit(0.0))).alias("y"), F.transform("__f", lambda v: F.when(v.isNotNull(), 1.0).otherwise(0.0)).alias("w"))


def to_long(series: DataFrame, keys: list[str], axis: list[date], value: str, out: str = "z", date_name: str = "obs_date") -> DataFrame:
    """Arrays over ``axis`` back to one row per date."""
    spark = series.sparkSession
    days = spark.createDataFrame(list(enumerate(axis)), "pos int, day date")
    long = series.select(*keys, F.posexplode(value).alias("pos", out))
    return long.join(F.broadcast(days), "pos").select(*keys, F.col("day").alias(date_name), out)


def require_order(stored: DataFrame, new: DataFrame, date_col: str = "obs_date", by: tuple[str, ...] = ()) -> None:
    """ValueError if a stored date that ``new`` does not replace is not before all new dates of its cube (``by``)."""
    keys = [*by, date_col]
    fresh = new.select(*keys).distinct()
    kept = stored.select(*keys).distinct().join(fresh, keys, "left_anti")
    last, first = kept.groupBy(*by).agg(F.max(date_col).alias("kept_last")), fresh.groupBy(*by).agg(F.min(date_col).alias("first_new"))
    ends = last.join(first, list(by)) if by else last.crossJoin(first)  # without cubes: one row each
    bad = ends.where("kept_last >= first_new").take(1)
    if bad:
        name = "".join(f"{bad[0][c]}: " for c in by)
        raise ValueError(f"{name}stored date {bad[0]['kept_last']} does not precede the new date {bad[0]['first_new']}")


def upsert(stored: DataFrame, new: DataFrame, date_col: str = "obs_date", by: tuple[str, ...] = ()) -> DataFrame:
    """Append on the time axis: dates supplied again are overwritten, new ones appended, in order.

    ``by`` names what makes a cube; each cube has its own axis.  ValueError if a
    stored date that is kept does not precede every new date of its cube.  An
    empty ``new`` leaves the stored rows as they are.
    """
    require_order(stored, new, date_col, by)
    fresh = new.select(*by, date_col).distinct()
    kept = stored.join(fresh if by else F.broadcast(fresh), [*by, date_col], "left_anti")  # without cubes: days of a calendar
    return kept.unionByName(new.select(*stored.columns))


def tail(df: DataFrame, date_col: str, k: int) -> DataFrame:
    """Rows of the last ``k`` dates of the axis; all for k = 0. ValueError if there are fewer dates."""
    if k == 0:
        return df
    last = df.select(date_col).distinct().orderBy(F.desc(date_col)).limit(k)
    rows = last.collect()  # k dates
    if len(rows) < k:
        raise ValueError(f"{k} steps wanted, {len(rows)} there")
    return df.where(F.col(date_col) >= F.lit(min(r[0] for r in rows)))


def axis_info(df: DataFrame, by: list[str], date_col: str) -> DataFrame:
    """(by, first_date, last_date, n_dates, n_pixels or n_rows)."""
    return df.groupBy(*by).agg(F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"), F.countDistinct(date_col).alias("n_dates"), F.count("*").alias("n_rows"))


def cube_info(raw: DataFrame, meta: DataFrame, run_log: DataFrame) -> DataFrame:
    """Attributes, axis ends, counts and the last run of each cube of ``meta``."""
    info = axis_info(raw, ["cube_id"], "obs_date")
    runs = run_log.groupBy("cube_id").agg(F.max(F.struct("processed_at", "run_id", "lastrun")).alias("r")).select("cube_id", F.col("r.lastrun").alias("lastrun"))
    m = meta.select("cube_id", "rows", "cols", "nodata", "temporalresolution")
    return m.join(info, "cube_id", "left").join(runs, "cube_id", "left")


def last_date(df: DataFrame, date_col: str = "obs_date") -> date | None:
    return df.agg(F.max(date_col).alias("m")).first()["m"]


def require_last(df: DataFrame, expected: date, date_col: str = "obs_date", by: str = "cube_id") -> None:
    """Precondition of a continued run: the stored axis of every cube ends at ``expected``."""
    ends = df.groupBy(*([by] if by in df.columns else [])).agg(F.max(date_col).alias("last"))
    bad = ends.where(~F.col("last").eqNullSafe(F.lit(expected))).take(5)
    if bad:
        raise ValueError(f"stored axes do not end at {expected}: " + ", ".join(f"{r[0]} at {r['last']}" if by in df.columns else str(r["last"]) for r in bad))


def missing_dates(df: DataFrame, by: list[str], date_col: str, start: date, end: date, step: int = 8) -> DataFrame:
    """(by, obs_date): days of the step axis within [start, end] that a cube lacks."""
    from chronoraster.functions.axis import days, on_step

    spark = df.sparkSession
    want = days(spark, start, end, date_col).where(on_step(F.col(date_col), step))
    there = df.select(*by, date_col).distinct()
    return df.select(*by).distinct().crossJoin(F.broadcast(want)).join(there, [*by, date_col], "left_anti")


def contiguous(reference: DataFrame, update: DataFrame, date_col: str = "obs_date") -> DataFrame:
    """One row: do the updated dates that the reference axis holds follow each other there? Null if there are none."""
    numbered = reference.select(date_col).distinct().select(date_col, F.row_number().over(Window.orderBy(date_col)).alias("i"))
    hit = numbered.join(F.broadcast(update.select(date_col).distinct()), date_col, "left_semi")
    return hit.agg((F.max("i") - F.min("i") + 1 == F.count("*")).alias("contiguous"))


def set_range(meta: DataFrame, pattern: str, low: float, high: float) -> DataFrame:
    """Set vmin and vmax of the cubes whose name matches a glob."""
    like = F.col("cube_id").rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in pattern) + "$")
    return meta.withColumn("vmin", F.when(like, F.lit(float(low))).otherwise(F.col("vmin"))).withColumn("vmax", F.when(like, F.lit(float(high))).otherwise(F.col("vmax")))


def run_description(svalue: Column | None, p: Column | None, optimised: bool) -> Column:
    """The text that a run leaves in the log."""
    what = F.lit("V-curve optimization of s") if optimised else F.lit("fixed s from grid") if svalue is None else F.concat(F.lit("fixed s "), svalue.cast("string"), F.lit(" (log10)"))
    return what if p is None else F.concat(what, F.lit(" and with P-value of "), p.cast("string"))


def pixel_row(pixel: Column, cols: Column) -> Column:
    return F.floor(pixel / cols)


def pixel_col(pixel: Column, cols: Column) -> Column:
    return F.pmod(pixel, cols)


CUBE_SCHEMA = "pixel_id bigint, value smallint, cube_id string, obs_date date"


def create_cube(spark: SparkSession, path: str) -> None:
    """An empty raw cube table, partitioned by cube and date; raises if there is one."""
    spark.createDataFrame([], CUBE_SCHEMA).write.partitionBy("cube_id", "obs_date").parquet(path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """A raw cube table, which may be empty."""
    return spark.read.schema(CUBE_SCHEMA).parquet(path)


def replace_dates(df: DataFrame, path: str, *partitions: str) -> None:
    """Write so that only the partitions present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(partitions or ("obs_date",))).parquet(path)


def partition_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the first level of partition folders of a table; none if it is not there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [n for s in fs.listStatus(folder) if "=" in (n := s.getPath().getName())] if fs.exists(folder) else []


SMOOTH_PARTITIONS = ("cube_id", "target_date")


def with_kept_pixels(new: DataFrame, path: str) -> DataFrame:
    """Whole (cube, date) partitions of a smooth table: the rows of ``new`` and the stored ones of pixels that it lacks.

    ValueError if the table at ``path`` is not partitioned by cube and date.
    ``new`` is read several times.
    """
    spark = new.sparkSession
    there = partition_folders(spark, path)
    if any(not n.startswith("cube_id=") for n in there):
        raise ValueError(f"{path} is not partitioned by cube_id and target_date; write it anew")
    if not there:
        return new
    old = spark.read.schema(new.schema).parquet(path)
    old = old.join(new.select(*SMOOTH_PARTITIONS).distinct(), list(SMOOTH_PARTITIONS), "left_semi")
    kept = old.join(new.select("pixel_id", *SMOOTH_PARTITIONS), ["pixel_id", *SMOOTH_PARTITIONS], "left_anti")
    return new.unionByName(kept.select(*new.columns))


def octads(year: int) -> list[date]:
    first = date(year, 1, 1)
    return [d for i in range(0, 366, 8) if (d := first + timedelta(i)).year == year]
