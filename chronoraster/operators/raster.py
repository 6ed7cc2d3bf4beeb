"""Rasters: clipping, rounding, mosaics, nearest warps, windows (exporting side)."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoraster.functions import constants as C


def date_window(df: DataFrame, date_col: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Rows within [start, end]; a missing end is open."""
    if start is not None:
        df = df.where(F.col(date_col) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(date_col) <= F.lit(end))
    return df


def clip(v: Column, low: float, high: float) -> Column:
    """Into [low, high]; null stays null."""
    return F.when(v.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v.cast("double"))))


def mask_range(v: Column, low: float, high: float) -> Column:
    """Null beyond [low, high]: codes for missing data are not stored as values."""
    return F.when(v.between(low, high), v)


def round_int(v: Column, k: int) -> Column:
    """To multiples of 10**k, half to even."""
    return F.bround(v.cast("decimal(18,4)"), -k).cast("double")


def axis_check(df: DataFrame, cube: str, date_col: str) -> DataFrame:
    """(n_cubes, n_axes): a mosaic needs one axis; cubes without dates do not count."""
    axes = df.where(F.col(date_col).isNotNull()).groupBy(cube).agg(F.array_sort(F.collect_set(date_col)).alias("dates"))
    return axes.agg(F.count("*").alias("n_cubes"), F.countDistinct("dates").alias("n_axes"))


def mosaic(tiles: DataFrame, order_col: str, keys: list[str], value: str) -> DataFrame:
    """(keys, value): one value per target pixel; the tile latest in order wins where it has data, as in a stack of layers."""
    top = tiles.groupBy(*keys).agg(F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(order_col).alias("o"), F.col(value).alias("v")))).alias("m"))
    return top.select(*keys, F.col("m.v").alias(value))


def tile_geotransform(tile: Column, pixels: int = C.TILE_PIXELS, metres: float = C.PIXEL_METRES) -> Column:
    """Affine transform of a sinusoidal tile name; null for anything else."""
    h = F.nullif(F.regexp_extract(tile, r"^h(\d{2})v(\d{2})$", 1), F.lit("")).cast("int")
    v = F.nullif(F.regexp_extract(tile, r"^h(\d{2})v(\d{2})$", 2), F.lit("")).cast("int")
    ulx, uly = (h - C.ORIGIN_H) * pixels * F.lit(metres), (v - C.ORIGIN_V) * pixels * F.lit(-metres)
    return F.when(h.isNotNull(), F.array(ulx, F.lit(metres), F.lit(0.0), uly, F.lit(0.0), F.lit(-metres)))


def output_resolution(resolution: Column, is_global: Column) -> Column:
    """Degrees per pixel: metres / 112000 for tiles, untouched for global products."""
    return F.when(is_global, resolution).otherwise(F.transform(resolution, lambda r: r / F.lit(C.METRES_PER_DEGREE)))


def raster_size(low: float, high: float, res: float) -> int:
    return abs(int(round((high - low) / res)))


def target_grid(spark: SparkSession, box: tuple[float, float, float, float], xres: float, yres: float) -> DataFrame:
    """(trow, tcol, lon, lat): pixel centres of a grid over ulx, uly, lrx, lry."""
    ulx, uly, lrx, lry = box
    w, h = raster_size(ulx, lrx, xres), raster_size(uly, lry, yres)
    g = spark.range(h * w).select((F.floor(F.col("id") / w)).cast("int").alias("trow"), (F.col("id") % w).cast("int").alias("tcol"))
    return g.select("trow", "tcol", (F.lit(ulx) + (F.col("tcol") + 0.5) * F.lit(abs(xres))).alias("lon"), (F.lit(uly) - (F.col("trow") + 0.5) * F.lit(abs(yres))).alias("lat"))


def source_pixel(lon: Column, lat: Column, gt: tuple[float, ...], radius: float = C.SPHERE_RADIUS) -> tuple[Column, Column]:
    """(row, col) of the sinusoidal source pixel that holds a point given in degrees."""
    phi = lat * F.lit(math.pi / 180)
    x = F.lit(radius) * (lon * F.lit(math.pi / 180)) * F.cos(phi)
    y = F.lit(radius) * phi
    return F.floor((y - F.lit(gt[3])) / F.lit(gt[5])), F.floor((x - F.lit(gt[0])) / F.lit(gt[1]))


def warp_nearest(raster: DataFrame, gt: tuple[float, ...], box: tuple[float, float, float, float], xres: float, yres: float, value: str = "value", resample: str = "near") -> DataFrame:
    """(trow, tcol, value) of the target grid, nearest source pixel; null outside the source.

    Only nearest from the sinusoidal sphere to degrees; anything else raises.
    """
    if resample not in ("near", "nearest"):
        raise ValueError("only nearest resampling")
    grid = target_grid(raster.sparkSession, box, xres, yres)
    row, col = source_pixel(F.col("lon"), F.col("lat"), gt)
    grid = grid.select("trow", "tcol", row.alias("row"), col.alias("col"))
    return grid.join(raster.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), value), ["row", "col"], "left").select("trow", "tcol", value)


def forward_warp(pixels: DataFrame, box: tuple[float, float, float, float], xres: Column, yres: Column, radius: float = C.SPHERE_RADIUS) -> DataFrame:
    """Adds (trow, tcol) to (row, col, gt, is_global): the pixels of a grid in degrees over ``box`` whose nearest source pixel this is.

    A row for each such target pixel, none for a source pixel that is nearest to
    none or lies outside ``box``.  Neither the grid nor a join is needed: the
    latitudes of a source row span a few target rows, and the longitudes of its
    pixel at each of those a few target columns; of these (with one more at each
    end) the ones are kept whose centre falls into the pixel.  ``gt`` is the
    cube's affine transform, on the sinusoidal sphere, or in degrees where ``is_global``.
    """
    ulx, uly, lrx, lry = box
    deg = F.lit(180 / math.pi)
    gt = lambda i: F.col("gt")[i]
    height, width = F.rint(F.abs((F.lit(uly) - F.lit(lry)) / yres)), F.rint(F.abs((F.lit(lrx) - F.lit(ulx)) / xres))
    north = lambda y: F.when(F.col("is_global"), y).otherwise(y / F.lit(radius) * deg)
    top, bottom = north(gt(3) + F.col("row") * gt(5)), north(gt(3) + (F.col("row") + 1) * gt(5))
    low = F.greatest(F.lit(0.0), F.floor((F.lit(uly) - top) / yres - 0.5)).cast("int")
    high = F.least(height - 1, F.ceil((F.lit(uly) - bottom) / yres - 0.5)).cast("int")
    p = pixels.withColumns({"__xres": xres, "__yres": yres, "__width": width, "__a": low, "__z": high}).where("__a <= __z")
    p = p.withColumn("trow", F.explode(F.sequence("__a", "__z"))).withColumn("__lat", F.lit(uly) - (F.col("trow") + 0.5) * F.col("__yres"))
    east = lambda x: F.when(F.col("is_global"), x).otherwise(x / (F.lit(radius) * F.greatest(F.cos(F.col("__lat") / deg), F.lit(1e-12))) * deg)
    left, right = east(gt(0) + F.col("col") * gt(1)), east(gt(0) + (F.col("col") + 1) * gt(1))
    low = F.greatest(F.lit(0.0), F.floor((left - F.lit(ulx)) / F.col("__xres") - 0.5))
    high = F.least(F.col("__width") - 1, F.ceil((right - F.lit(ulx)) / F.col("__xres") - 0.5))
    p = p.withColumns({"__a": low, "__z": high}).where("__a <= __z")
    p = p.withColumn("tcol", F.explode(F.sequence(F.col("__a").cast("int"), F.col("__z").cast("int"))))
    lon, lat = F.lit(ulx) + (F.col("tcol") + 0.5) * F.col("__xres"), F.col("__lat")
    x = F.when(F.col("is_global"), lon).otherwise(F.lit(radius) * (lon / deg) * F.cos(lat / deg))
    y = F.when(F.col("is_global"), lat).otherwise(F.lit(radius) * (lat / deg))
    hit = (F.floor((y - gt(3)) / gt(5)) == F.col("row")) & (F.floor((x - gt(0)) / gt(1)) == F.col("col"))
    return p.where(hit).drop("__a", "__z", "__lat", "__xres", "__yres", "__width")


def aoi_clip(points: DataFrame, box: tuple[float, float, float, float], x: str = "lon", y: str = "lat") -> DataFrame:
    """Pixels whose centre lies in ulx, uly, lrx, lry, after the warp."""
    ulx, uly, lrx, lry = box
    return points.where(F.col(x).between(ulx, lrx) & F.col(y).between(lry, uly))


def fill_tile(spark: SparkSession, raster: DataFrame, rows: int, cols: int, value: str = "value") -> DataFrame:
    """Every pixel of a tile; null where the raster has none, all null for an empty one."""
    full = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return full.join(raster.select("row", "col", value), ["row", "col"], "left")


def tile_size(raster: DataFrame, rows: int, cols: int) -> tuple[int, int]:
    """(rows, columns) of the smallest raster of whole ``rows`` x ``cols`` tiles from (0, 0) that holds all pixels; (0, 0) for an empty one."""
    m = raster.agg(F.max("row").alias("row"), F.max("col").alias("col")).first()
    return (0, 0) if m["row"] is None else ((m["row"] // rows + 1) * rows, (m["col"] // cols + 1) * cols)


def sgrid_window(sgrid: DataFrame, grid_gt: tuple[float, ...], cube_gt: tuple[float, ...], rows: int, cols: int, grid_rows: int, grid_cols: int, value: str = "log10_s", grid_srs: str | None = None, cube_srs: str | None = None) -> DataFrame:
    """(row, col, value) of a cube, cut out of a larger penalty raster of the same pixel size and, where both are named, reference system."""
    if grid_srs and cube_srs and "".join(grid_srs.split()) != "".join(cube_srs.split()):
        raise ValueError("reference systems differ")
    if abs(grid_gt[1] - cube_gt[1]) > 1e-6 or abs(grid_gt[5] - cube_gt[5]) > 1e-6:
        raise ValueError("pixel sizes differ")
    xoff, yoff = round((cube_gt[0] - grid_gt[0]) / grid_gt[1]), round((cube_gt[3] - grid_gt[3]) / grid_gt[5])
    if xoff < 0 or yoff < 0 or xoff + cols > grid_cols or yoff + rows > grid_rows:
        raise ValueError("the cube lies outside the penalty raster")
    inside = sgrid.where(F.col("row").between(yoff, yoff + rows - 1) & F.col("col").between(xoff, xoff + cols - 1))
    return inside.select((F.col("row") - yoff).cast("int").alias("row"), (F.col("col") - xoff).cast("int").alias("col"), value)


def metadata_options(text: Column) -> Column:
    """``KEY=VALUE&KEY=VALUE`` as a map."""
    return F.str_to_map(text, F.lit("&"), F.lit("="))


def group_name(cube: Column) -> Column:
    """A cube's name with its tile replaced by a wildcard: the cubes of one mosaic."""
    return F.regexp_replace(cube, r"\.h\d{2}v\d{2}\.", ".*.")


def export_raster(df: DataFrame, path: str, overwrite: bool = False, by: tuple[str, ...] = ("image",)) -> None:
    """Write a raster, one folder per image (``by``); images that exist are kept unless ``overwrite``."""
    if overwrite:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        return
    spark = df.sparkSession
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        df = df.join(F.broadcast(spark.read.parquet(path).select(*by).distinct()), list(by), "left_anti")
    df.write.mode("append").partitionBy(*by).parquet(path)
