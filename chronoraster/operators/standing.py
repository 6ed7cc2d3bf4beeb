"""Standing readings of raw cubes and completed cube attributes (problems 1 to 3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two codes for missing data of the VNP products.
VNP_CODES = (-15000, -13000)
MAX_CUBES = 100_000  # rows of the attribute table that are broadcast at most


def product_of(cube_id: Column) -> Column:
    """The product in ``CODE/PRODUCT.TILE.VERSION.CODE``; null if there is none."""
    return F.nullif(F.regexp_extract(cube_id, r"^[^/]*/([^./]+)\.", 1), F.lit(""))


def complete_meta(meta: DataFrame) -> DataFrame:
    """(cube_id, product, nodata, t, vmin, vmax, codes, n_filled), gaps filled from the product.

    The fill is the product's most frequent value, the smallest on a tie; an
    attribute that no cube of the product has stays null.  codes are the values
    that stand for missing data.
    """
    m = meta.select("cube_id", product_of(F.col("cube_id")).alias("product"), "nodata", F.col("temporalresolution").alias("t"), "vmin", "vmax")
    m = m.where(F.col("cube_id").isNotNull())
    parts = ("nodata", "t", "vmin", "vmax")
    own = m.groupBy(F.col("product").alias("p_product")).agg(*[F.mode(c, True).alias(f"p_{c}") for c in parts])
    m = m.join(own, F.col("product").eqNullSafe(F.col("p_product")), "left")
    filled = sum(F.col(c).isNull().cast("int") for c in parts)
    m = m.select("cube_id", "product", *[F.coalesce(c, f"p_{c}").alias(c) for c in parts], filled.alias("n_filled"))
    codes = F.when(F.col("product").startswith("VNP"), F.array(*[F.lit(float(c)) for c in VNP_CODES])).otherwise(F.array_compact(F.array("nodata")))
    return m.withColumn("codes", codes)


def standing(raw: DataFrame) -> DataFrame:
    """One reading per (cube, pixel, date): greatest proc_ts, then greatest obs_id.

    Partial aggregation keeps groups of copies small before the shuffle.  A null
    proc_ts ranks last; rows without cube, pixel or date are no readings.
    """
    keys = ["cube_id", "pixel_id", "obs_date"]
    known = raw.select(*keys, F.struct("proc_ts", "obs_id", "value").alias("v")).dropna(subset=keys)
    return known.groupBy(*keys).agg(F.max("v").alias("v")).select(*keys, F.col("v.obs_id").alias("obs_id"), F.col("v.value").alias("value"))


def standing_by_pixel(raw: DataFrame) -> DataFrame:
    """``standing``, with all readings of a pixel in one partition (by cube_id and pixel_id) after one shuffle.

    Copies of a reading are reduced batch by batch before the shuffle, so that a
    group of copies of any size stays small; what is left of them is reduced
    after it, where the partitioning by pixel serves the grouping by date, too.
    """
    keys = ["cube_id", "pixel_id", "obs_date"]
    known = raw.select(*keys, "proc_ts", "obs_id", "value").dropna(subset=keys)

    def last_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            if b.num_rows > 1:
                cube = b.column("cube_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                pixel = b.column("pixel_id").to_numpy()
                day = b.column("obs_date").cast(pa.int32()).to_numpy()
                rank = [x for c in ("obs_id", "proc_ts") for x in (b.column(c).fill_null(0).to_numpy(), b.column(c).is_valid().to_numpy(zero_copy_only=False))]  # null ranks last
                order = np.lexsort((*rank, day, pixel, cube))
                same = (cube[order[1:]] == cube[order[:-1]]) & (pixel[order[1:]] == pixel[order[:-1]]) & (day[order[1:]] == day[order[:-1]])
                if same.any():
                    b = b.take(pa.array(order[np.append(~same, True)]))
            yield b

    near = known.mapInArrow(last_copies, known.schema).repartition("cube_id", "pixel_id")
    one = near.groupBy(*keys).agg(F.max(F.struct("proc_ts", "obs_id", "value")).alias("v"))
    return one.select(*keys, F.col("v.obs_id").alias("obs_id"), F.col("v.value").alias("value"))


def is_missing(value: Column, codes: Column) -> Column:
    """Null, or one of the cube's codes for missing data."""
    return value.isNull() | F.coalesce(F.array_contains(codes, value.cast("double")), F.lit(False))


#: A reading as one number that sorts by date: day * 2**17 + value + 2**16, or + 0 for null.
PACK = 1 << 17
SHIFT = 1 << 16


def packed(date: Column, value: Column) -> Column:
    return F.unix_date(date).cast("bigint") * F.lit(PACK) + F.coalesce(value.cast("bigint") + F.lit(SHIFT), F.lit(0))
