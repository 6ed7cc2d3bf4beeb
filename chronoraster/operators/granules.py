"""Granule names, versions, groups and axes (collecting side)."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoraster.functions import constants as C
from chronoraster.functions.axis import from_julian


def _part(pattern: str, col: str = "filename") -> Column:
    return F.nullif(F.regexp_extract(F.col(col), pattern, 1), F.lit(""))


def parse_names(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, filename, product, satellite, tile, version, raw_date, julian, proc_ts, is_global).

    Parts that a name lacks are null; a name without tile is a global product's.
    """
    d = paths.select(F.col(path_col).alias("path")).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    d = d.withColumn("product", _part(C.PRODUCT_PART)).withColumn("tile", _part(C.TILE_PART)).withColumn("version", _part(C.VERSION_PART))
    d = d.withColumn("julian", _part(C.DATE_PART)).withColumn("proc_ts", _part(C.PROC_PART).cast("bigint"))
    satellite = F.when(F.col("product").startswith("MOD"), "Terra").when(F.col("product").startswith("MYD"), "Aqua").when(F.col("product").startswith("VNP"), "SNPP")
    return d.select("path", "filename", "product", satellite.alias("satellite"), "tile", "version", from_julian(F.col("julian")).alias("raw_date"), "julian", "proc_ts", F.col("tile").isNull().alias("is_global"))


def temporal_table(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in C.TEMPORAL.items()]
    return spark.createDataFrame(rows, "family string, temporalresolution int, tshift int, mux string, min_date date")


def lst_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*k, v) for k, v in C.LST_NAMES.items()], "code string, prefix string, name string")


def with_temporal(granules: DataFrame) -> DataFrame:
    """Adds the product family's resolution, shift, merged name and first date (left join of six rows)."""
    return granules.join(F.broadcast(temporal_table(granules.sparkSession)), F.substring("product", 1, 5) == F.col("family"), "left").drop("family")


def supported(product: Column) -> Column:
    """Only the 13 (vegetation index) and 11 (temperature) products."""
    return product.rlike(C.SUPPORTED_PATTERN)


def vam_code(product: Column, wanted: str | None = None) -> Column:
    """The code to use: the wanted one if it fits the product, the product's default without one, else null."""
    vi, lst = product.rlike(C.VI_PATTERN), product.rlike(C.LST_PATTERN)
    if wanted is None:
        return F.when(vi, "VIM").when(lst, "LTD")
    fits = vi if wanted in ("VIM", "VEM") else lst if wanted in ("LTD", "LTN") else F.lit(False)
    return F.when(fits, F.lit(wanted))


def cube_name(code: Column, product: Column, tile: Column, version: Column) -> Column:
    """``CODE/PRODUCT.TILE.VERSION.CODE``; temperature cubes carry their satellite's name."""
    name = code
    for (c, prefix), new in C.LST_NAMES.items():
        name = F.when((code == c) & product.startswith(prefix), new).otherwise(name)
    return F.when(name.isNotNull() & product.isNotNull(), F.concat(name, F.lit("/"), F.concat_ws(".", product, tile, version, name)))


def smooth_name(cube: Column, step: int | None) -> Column:
    """The smooth cube's name: ``txn``, ``txp``, ``txd`` or ``txc`` before the code."""
    letter = "n" if step is None else C.STEP_LETTERS.get(step, "c")
    return F.regexp_replace(cube, r"\.([^.]+)$", f".tx{letter}.$1")


def first_reference(granules: DataFrame, *by: str) -> DataFrame:
    """(by, path): the file that a cube's grid is taken from, the first one by file name; ties go to the least path."""
    return granules.groupBy(*by).agg(F.min(F.struct("filename", "path")).alias("m")).select(*by, F.col("m.path").alias("path"))


def not_downloaded(wanted: DataFrame, have: DataFrame, key: str = "filename") -> DataFrame:
    """Wanted files that are not there yet: what the next round of downloads asks for. Rows without a key stay wanted."""
    return wanted.join(have.select(key).distinct(), key, "left_anti")


def latest_versions(granules: DataFrame, *by: str) -> DataFrame:
    """The row with the greatest proc_ts of each key; ties go to the greatest path. Nulls rank last."""
    rest = [c for c in granules.columns if c not in by]
    best = granules.groupBy(*by).agg(F.max(F.struct(F.col("proc_ts").alias("__ts"), F.col("path").alias("__p"), F.struct(*rest).alias("__r"))).alias("__m"))
    return best.select(*by, *[F.col("__m.__r")[c].alias(c) for c in rest])


def equal_versions(granules: DataFrame, *by: str) -> DataFrame:
    """Keys whose greatest proc_ts several files carry: collecting them is an error there."""
    best = granules.groupBy(*by, "proc_ts").agg(F.count("*").alias("n_files"))
    top = best.groupBy(*by).agg(F.max(F.struct("proc_ts", "n_files")).alias("m"))
    return top.select(*by, F.col("m.proc_ts").alias("proc_ts"), F.col("m.n_files").alias("n_files")).where("n_files > 1")


def interleave(granules: DataFrame) -> DataFrame:
    """Terra and Aqua 16-day vegetation indices become one 8-day product.

    MOD13 and MYD13 are renamed to MXD13 and files before its first date left
    out; VNP13 keeps its name and first date.  Other products pass unchanged.
    """
    g = with_temporal(granules)
    renamed = F.when(F.col("mux") == "MXD", F.concat(F.lit("MXD"), F.substring("product", 4, 20))).otherwise(F.col("product"))
    g = g.withColumn("product", renamed).drop("temporalresolution", "tshift", "mux", "min_date")
    g = with_temporal(g)
    return g.where(F.col("min_date").isNull() | (F.col("raw_date") >= F.col("min_date"))).drop("mux", "min_date")


def file_groups(granules: DataFrame, split_satellites: bool = False) -> DataFrame:
    """(group, tile, version, n_files, n_dates, first_date, last_date): one raw cube's files each.

    MOD13 and MYD13 share a group unless ``split_satellites``.
    """
    group = F.col("product") if split_satellites else F.regexp_replace("product", "^M[OY]D13", "M?D13")
    return granules.groupBy(group.alias("product_group"), "tile", "version").agg(
        F.count("*").alias("n_files"), F.countDistinct("raw_date").alias("n_dates"), F.min("raw_date").alias("first_date"), F.max("raw_date").alias("last_date")
    )


def required_tiles(granules: DataFrame, tiles: list[str]) -> DataFrame:
    """(product, missing, axes): required tiles that a product lacks, and how many different date sets the rest have.

    A product can be collected if nothing is missing and axes is 1.
    """
    for t in tiles:
        if not re.match(C.TILE_ARGUMENT, t):
            raise ValueError(f"not a tile: {t}")
    need = granules.sparkSession.createDataFrame([(t,) for t in sorted(set(tiles))], "tile string")
    products = granules.select("product").distinct()
    missing = products.crossJoin(F.broadcast(need)).join(granules.select("product", "tile").distinct(), ["product", "tile"], "left_anti")
    missing = missing.groupBy("product").agg(F.count("*").alias("missing"))
    axis = granules.join(F.broadcast(need), "tile", "left_semi").groupBy("product", "tile").agg(F.array_sort(F.collect_set("raw_date")).alias("dates"))
    axes = axis.groupBy("product").agg(F.countDistinct("dates").alias("axes"))
    return products.join(missing, "product", "left").join(axes, "product", "left").select("product", F.coalesce("missing", F.lit(0)).cast("bigint").alias("missing"), F.coalesce("axes", F.lit(0)).cast("bigint").alias("axes"))


def require_tiles(granules: DataFrame, tiles: list[str]) -> None:
    """Raise ValueError unless every product has all required tiles with equal dates."""
    bad = required_tiles(granules, tiles).where("missing > 0 or axes <> 1").take(1)
    if bad:
        raise ValueError(f"{bad[0]['product']}: {bad[0]['missing']} required tiles are missing, {bad[0]['axes']} different time axes")


def search_filter(results: DataFrame, tiles: list[str] | None = None, begin: date | None = None, end: date | None = None) -> DataFrame:
    """Search results by tile (kept when the tile is unknown) and by start time, ends included."""
    out = results
    if tiles:
        out = out.where(F.col("tile").isNull() | F.col("tile").isin(tiles))
    if begin is not None:
        out = out.where(F.col("time_start") >= F.lit(begin))
    if end is not None:
        out = out.where(F.col("time_start") <= F.lit(end))
    return out


def expand_products(products: DataFrame, col: str = "product") -> DataFrame:
    """``M?D...`` stands for MOD and MYD; names in upper case."""
    p = F.upper(F.trim(col))
    both = F.when(F.contains(p, F.lit("?")), F.array(F.regexp_replace(p, r"\?", "O"), F.regexp_replace(p, r"\?", "Y"))).otherwise(F.array(p))
    return products.select(F.explode(both).alias("product")).distinct()


def check_roi(roi: list[float]) -> tuple[float, ...]:
    """A point (2 numbers) or a box xmin, ymin, xmax, ymax (4), the box as ulx, uly, lrx, lry."""
    if len(roi) == 2:
        return tuple(roi)
    if len(roi) != 4:
        raise ValueError("a region has 2 or 4 numbers")
    xmin, ymin, xmax, ymax = roi
    if xmin >= xmax or ymin >= ymax:
        raise ValueError("a box is xmin, ymin, xmax, ymax")
    return xmin, ymax, xmax, ymin


def check_tiles(tiles: list[str]) -> list[str]:
    bad = [t for t in tiles if not re.match(C.TILE_ARGUMENT, t.lower())]
    if bad:
        raise ValueError(f"not tiles: {bad}")
    return [t.lower() for t in tiles]
