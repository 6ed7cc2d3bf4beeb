"""Filling missing values from similar records by K-prototypes clusters (problem 3)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoraster.functions.prototypes import fit_table
from chronoraster.functions.session import join_small, settled, written
from chronoraster.operators.standing import MAX_CUBES, complete_meta, is_missing, product_of, standing_by_pixel

CLUSTERS = 16
# Weight of a mismatch against squared distance: product, code, tile row
GAMMA = (1.0, 0.5, 0.25)


def _kinds(small: DataFrame, categorical: list[str]) -> tuple[DataFrame, list[tuple]]:
    """``small``, settled, with the number ``kind`` of its categories, and the categories by number; the last one has none."""
    small = settled(small.withColumn("kind", F.dense_rank().over(Window.orderBy(*categorical)) - 1), MAX_CUBES)
    rows = small.select("kind", *categorical).distinct().orderBy("kind").collect()
    return small, [tuple(r[c] for c in categorical) for r in rows] + [(None,) * len(categorical)]


def _features(meta: DataFrame) -> DataFrame:
    info = complete_meta(meta).select("cube_id", "product", "codes", "vmin", "vmax")
    code = F.upper(F.nullif(F.trim(F.regexp_extract("cube_id", r"^([^/]*)/", 1)), F.lit("")))
    band = F.coalesce(F.nullif(F.regexp_extract("cube_id", r"\.h\d\d(v\d\d)\.", 1), F.lit("")), F.lit("global"))
    return info.select("*", code.alias("code"), band.alias("band"))


def fill_missing(raw: DataFrame, meta: DataFrame, clusters: int = CLUSTERS) -> DataFrame:
    """(obs_id, cube_id, pixel_id, obs_date, value, filled, method) of all standing readings.

    Missing are nulls and the cube's codes for missing data.  A record's level
    is what the pixel's other observed readings within the physical range
    suggest at its date: the line between the last one before and the first one
    after it, or the only one of these; without them the pixel's mean.  Records
    are clustered on product, code, tile row, season and level (as a share of
    the range).  A missing value becomes the level plus the median deviation from
    it in the record's cluster: within the cube (method ``cube_cluster``), else the
    product (``product_cluster``), else over the whole product (``product``),
    else over everything (``all``).  A pixel without observed readings takes the
    mean level of its cube, product, or everything, and its method ends in
    ``+level``.  With nothing observed at all the value stays null (``none``).
    Values are rounded half even and kept within the cube's range.

    The clusters are fitted on all observed records, in passes over a copy of
    their features; medians and levels are those of all records, too.  The driver
    gets one row per cube at most, and per pass what ``fit_table`` says.
    """
    info = _features(meta)
    # what belongs to the cube is joined after the shuffle to the pixels, which then carries readings only
    rows = join_small(standing_by_pixel(raw), info, "cube_id", "left", MAX_CUBES, ("cube_id", "pixel_id"))
    rows = rows.withColumn("missing", is_missing(F.col("value"), F.coalesce("codes", F.array().cast("array<double>"))))
    sound = ~F.col("missing") & F.coalesce(F.col("value") >= F.col("vmin"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("vmax"), F.lit(True))
    w = Window.partitionBy("cube_id", "pixel_id")
    known = F.when(F.col("sound"), F.struct(F.unix_date("obs_date").alias("d"), F.col("value").cast("double").alias("v")))
    before, after = (F.last(known, True).over(w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)) for o in (F.asc("obs_date"), F.desc("obs_date")))
    rows = rows.withColumn("sound", sound)
    rows = rows.withColumns({"a": before, "mean": F.avg(F.when(F.col("sound"), F.col("value"))).over(w)}).withColumn("z", after)
    line = F.col("a.v") + (F.col("z.v") - F.col("a.v")) * (F.unix_date("obs_date") - F.col("a.d")) / (F.col("z.d") - F.col("a.d"))
    rows = rows.withColumn("level", F.rint(F.coalesce(line, "a.v", "z.v", "mean")).cast("int"))
    work = written(rows.select("obs_id", "cube_id", "pixel_id", "obs_date", "value", "missing", "sound", "level"), "fill")
    categorical = ["product", "code", "band"]
    of_cube, kinds = _kinds(info.select("cube_id", *categorical, "vmin", "vmax"), categorical)

    angle = F.dayofyear("obs_date") * F.lit(2 * math.pi / 365.25)
    span = F.when(F.col("vmax") > F.col("vmin"), (F.col("level") - F.col("vmin")) / (F.col("vmax") - F.col("vmin")))
    numeric = {"span": span, "season_sin": 0.5 * F.sin(angle), "season_cos": 0.5 * F.cos(angle)}
    seen = join_small(work.where("sound"), of_cube, "cube_id", "left", MAX_CUBES)
    seen = seen.select(span.alias("span"), F.coalesce("kind", F.lit(len(kinds) - 1)).alias("kind"), (F.dayofyear("obs_date") - 1).alias("day"))
    angles = np.arange(1, 367) * (2 * math.pi / 365.25)
    model = fit_table(seen, ["span"], kinds, clusters, np.array(GAMMA), 0.5 * np.column_stack([np.sin(angles), np.cos(angles)]))
    work = join_small(work, of_cube, "cube_id", "left", MAX_CUBES)
    work = work.withColumn("cluster", model.nearest(list(numeric.values()), [F.col(c) for c in categorical])).drop("code", "band", "kind")

    # one histogram of deviations serves the medians of all parents
    hist = work.where("sound").groupBy("cube_id", "product", "cluster", (F.col("value") - F.col("level")).alias("dev")).agg(F.count("*").alias("n"), F.sum("level").alias("levels"))
    hist = written(hist, "fill-medians")
    median, mean = F.percentile("dev", 0.5, F.col("n")), F.sum("levels") / F.sum("n")

    def lookup(key: str, tag: str) -> DataFrame:
        """One row per value of ``key``: its median and mean level, and the medians of its clusters."""
        parts = hist.groupBy(key, "cluster").agg(median.alias("d")).groupBy(F.col(key).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "d"))).alias(f"of_{tag}"))
        whole = hist.groupBy(F.col(key).alias("key")).agg(median.alias(f"d_{tag}"), mean.alias(f"mean_{tag}"))
        return whole.join(parts, F.col("key").eqNullSafe(F.col("k"))).drop("k").withColumnRenamed("key", f"by_{tag}")

    out = work
    for key, tag in (("cube_id", "cube"), ("product", "product")):
        out = join_small(out, lookup(key, tag), F.col(key).eqNullSafe(F.col(f"by_{tag}")), "left", MAX_CUBES)
    whole = hist.agg(median.alias("d"), mean.alias("mean")).first()
    d_all, mean_all = F.lit(whole["d"]).cast("double"), F.lit(whole["mean"]).cast("double")
    steps = {"cube_cluster": F.try_element_at("of_cube", F.col("cluster")), "product_cluster": F.try_element_at("of_product", F.col("cluster")), "product": F.col("d_product")}
    level = F.coalesce(F.col("level").cast("double"), "mean_cube", "mean_product", mean_all)
    guess = F.rint(level + F.coalesce(*steps.values(), d_all))
    # greatest and least skip nulls, so an absent bound does not bound
    kept = F.greatest(F.lit(-32768.0), "vmin", F.least(F.lit(32767.0), "vmax", guess))
    guess = F.when(guess.isNotNull(), kept).cast("smallint")
    method = F.lit("all")
    for t, d in reversed(steps.items()):
        method = F.when(d.isNotNull(), t).otherwise(method)
    method = F.when(guess.isNull(), "none").when(F.col("level").isNull(), F.concat(method, F.lit("+level"))).otherwise(method)
    return out.select(
        "obs_id", "cube_id", "pixel_id", "obs_date",
        F.when(F.col("missing"), guess).otherwise(F.col("value")).alias("value"),
        F.col("missing").alias("filled"),
        F.when(F.col("missing"), method).alias("method"),
    )


META_FIELDS = ("nodata", "temporalresolution", "vmin", "vmax", "vamcode", "projection", "resolution")


def fill_attributes(meta: DataFrame, clusters: int = CLUSTERS) -> DataFrame:
    """(cube_id, attributes..., filled): cubes' missing attributes, with the names of the filled ones.

    nodata, temporalresolution, vmin and vmax are those of the product's other
    cubes, as they define the product.  vamcode (upper case), projection and
    resolution come from the cubes of the same K-prototypes cluster (grid size
    and shift; product, code and tiling), else the product, else all cubes; the
    median of numbers, the mode of strings, smallest on a tie.  Empty strings
    count as missing.  Rows without a cube_id are left out.
    """
    defined = dict(zip(META_FIELDS[:4], ("nodata", "t", "vmin", "vmax")))
    full = complete_meta(meta).select("cube_id", *[F.col(f).alias(f"f_{c}") for c, f in defined.items()])
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    own = {"vamcode": F.upper(text("vamcode")), "projection": text("projection"), "resolution": F.when(F.size("resolution") > 0, F.col("resolution"))}
    feature = {c: F.log1p(F.abs(F.col(c)).cast("double")) for c in ("rows", "cols", "tshift")}
    kinds = {"product": product_of(F.col("cube_id")), "code": text(F.upper(F.regexp_extract("cube_id", r"^([^/]*)/", 1))), "tiling": F.col("is_global").cast("string")}
    df = meta.where("cube_id is not null").select("cube_id", *META_FIELDS[:4], *[v.alias(c) for c, v in own.items()], *[v.alias(f"n_{c}") for c, v in feature.items()], *[v.alias(f"k_{c}") for c, v in kinds.items()])
    num, cat = [f"n_{c}" for c in feature], [f"k_{c}" for c in kinds]
    seen, of_kind = _kinds(df.select(*num, *cat), cat)
    model = fit_table(seen.withColumn("day", F.lit(0)), num, of_kind, clusters, np.array([4.0, 4.0, 1.0]))
    df = df.withColumn("cluster", model.nearest([F.col(c) for c in num], [F.col(c) for c in cat]))

    def common(tag: str) -> list[Column]:
        middle = F.array(*[F.percentile(F.try_element_at("resolution", F.lit(i)), 0.5) for i in (1, 2)])
        return [F.mode("vamcode", True).alias(f"vamcode_{tag}"), F.mode("projection", True).alias(f"projection_{tag}"), F.when(F.count("resolution") > 0, middle).alias(f"resolution_{tag}")]

    out = df.join(full, "cube_id", "left")
    for tag, key in (("cluster", "cluster"), ("product", "k_product")):
        out = join_small(out, df.groupBy(F.col(key).alias(f"by_{tag}")).agg(*common(tag)), F.col(key).eqNullSafe(F.col(f"by_{tag}")), "left", MAX_CUBES)
    out = join_small(out.withColumn("one", F.lit(1)), df.groupBy(F.lit(1).alias("one")).agg(*common("all")), "one", "left", 1)
    new = {c: F.coalesce(c, f"f_{c}") for c in defined} | {c: F.coalesce(c, *[f"{c}_{t}" for t in ("cluster", "product", "all")]) for c in own}
    filled = F.array_compact(F.array(*[F.when(F.col(c).isNull() & v.isNotNull(), F.lit(c)) for c, v in new.items()]))
    return out.select("cube_id", *[v.alias(c) for c, v in new.items()], filled.alias("filled"))
