"""Command line over Parquet tables: ``python -m chronoraster.cli COMMAND``."""

from __future__ import annotations

import argparse
from datetime import datetime


def day(text: str):
    """YYYYDDD or YYYY-MM-DD."""
    return datetime.strptime(text, "%Y%j" if text.isdigit() else "%Y-%m-%d").date()


def numbers(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(","))


def pair(text: str) -> tuple[str, str]:
    key, _, value = text.partition("=")
    return key, value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronoraster")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=text)

    c = add("collect", "granule pixels to a raw cube table")
    c.add_argument("pixels")
    c.add_argument("out")
    c.add_argument("--code", choices=["VIM", "VEM", "LTD", "LTN"])
    c.add_argument("--tiles-required", type=lambda s: s.split(","))
    c.add_argument("--last-collected", type=day)
    s = add("smooth", "raw cubes to smooth cubes")
    s.add_argument("raw")
    s.add_argument("meta")
    s.add_argument("out")
    s.add_argument("--svalue", type=float)
    s.add_argument("--srange", nargs=3, type=float)
    s.add_argument("--pvalue", type=float)
    s.add_argument("--soptimize", action="store_true")
    s.add_argument("--sgrid")
    s.add_argument("--tempint", type=int)
    s.add_argument("--tempint-start", type=day)
    s.add_argument("--nsmooth", type=int, default=0)
    s.add_argument("--nupdate", type=int, default=0)
    s.add_argument("--run-log")
    s.add_argument("--granules", help="smooth only cubes with pending dates of this table")
    w = add("window", "cubes to rasters")
    w.add_argument("cubes")
    w.add_argument("meta")
    w.add_argument("out")
    w.add_argument("--product")
    w.add_argument("--code")
    w.add_argument("--begin-date", type=day)
    w.add_argument("--end-date", type=day)
    w.add_argument("--tempint", type=int)
    w.add_argument("--clip-valid", action="store_true")
    w.add_argument("--round-int", type=int, default=0)
    w.add_argument("--overwrite", action="store_true")
    w.add_argument("--last-smoothed", type=day)
    w.add_argument("--aoi", type=numbers, help="ULX,ULY,LRX,LRY in degrees")
    w.add_argument("--resolution", type=numbers, help="degrees, one number or two")
    w.add_argument("--target-srs", default="EPSG:4326", choices=["EPSG:4326"])
    w.add_argument("--resample", default="near", choices=["near", "nearest"])
    w.add_argument("--sgrid", action="store_true", help="the table holds penalties (cube_id, pixel_id, log10_s)")
    w.add_argument("--geotiff", action="store_true", help="one GeoTIFF per image instead of a Parquet table")
    w.add_argument("--nodata", type=int, default=-3000)
    w.add_argument("--co", type=pair, action="append", default=[], help="creation option KEY=VALUE")
    w.add_argument("--mo", type=pair, action="append", default=[], help="metadata KEY=VALUE")
    o = add("download", "search response and sidecars (Parquet) to validated files in a folder")
    o.add_argument("response")
    o.add_argument("target")
    o.add_argument("--sidecars", help="table (filename, file_size, checksum_type, checksum)")
    o.add_argument("--tile-filter", type=lambda s: s.split(","))
    o.add_argument("--begin-date", type=day)
    o.add_argument("--end-date", type=day)
    o.add_argument("--threads", type=int, default=4)
    o.add_argument("--rounds", type=int, default=5)
    o.add_argument("--mirror")
    i = add("info", "attributes, axis and last run of cubes")
    for a in ("raw", "meta", "run_log"):
        i.add_argument(a)
    v = add("csv-smooth", "smooth the columns of a CSV file")
    v.add_argument("csv")
    v.add_argument("--index")
    v.add_argument("--header-row", type=int, default=0)
    v.add_argument("--svalue", type=float)
    v.add_argument("--srange", nargs=3, type=float)
    v.add_argument("--pvalue", type=float)
    v.add_argument("--nodata", type=float)
    r = add("set-range", "set the valid range of cubes that match a glob")
    r.add_argument("meta")
    r.add_argument("out")
    r.add_argument("glob")
    r.add_argument("low", type=float)
    r.add_argument("high", type=float)
    d = add("check-dates", "missing octad dates of cubes")
    d.add_argument("raw")
    d.add_argument("start", type=day)
    d.add_argument("end", type=day)
    k = add("compact", "join small Parquet files by copying their blocks")
    k.add_argument("folder")
    k.add_argument("out")
    k.add_argument("--target-mb", type=int, default=256)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from chronoraster.functions.whittaker import penalty_range
    from chronoraster.operators import cube, raster
    from chronoraster.plans import pipelines
    from chronoraster.sources import files, parquet_blocks

    spark = SparkSession.builder.appName("chronoraster").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    read = spark.read.parquet
    if a.command == "collect":
        new = pipelines.collect(read(a.pixels), a.code, a.tiles_required)
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(a.out)
        if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
            old = read(a.out)
            if a.last_collected:
                cube.require_last(old, a.last_collected)
            pipelines.require_order(old, new)
        cube.replace_dates(new, a.out, "cube_id", "obs_date")
    elif a.command == "smooth":
        srange = penalty_range(*a.srange).tolist() if a.srange else None
        optimise = a.soptimize or srange is not None
        if a.granules and not a.run_log:
            raise ValueError("pending granules need a run log")
        text = cube.run_description(None if a.svalue is None else F.lit(a.svalue), None if a.pvalue is None else F.lit(a.pvalue), optimise)
        options = {"svalue": a.svalue, "p": a.pvalue, "optimise": optimise, "srange": srange, "sgrid": read(a.sgrid) if a.sgrid else None, "step": a.tempint, "start": a.tempint_start, "nsmooth": a.nsmooth, "nupdate": a.nupdate}
        pipelines.smooth_run(spark, a.raw, read(a.meta), a.out, spark.range(1).select(text).first()[0], a.run_log, a.granules, **options)
    elif a.command == "window":
        cubes = files.filter_cubes(read(a.cubes), a.product, a.code)
        if a.last_smoothed:
            cube.require_last(cubes, a.last_smoothed, "target_date" if "target_date" in cubes.columns else "obs_date")
        if not a.sgrid:
            pipelines.check_group(cubes)
        save_window(a, cubes, read(a.meta))
    elif a.command == "download":
        for name in download(a, read(a.response), read(a.sidecars) if a.sidecars else None):
            print(f"{name}: not downloaded")
    elif a.command == "info":
        cube.cube_info(read(a.raw), read(a.meta), read(a.run_log)).show(1000, False)
    elif a.command == "csv-smooth":
        csv_smooth(spark, a.csv, a.index, a.svalue, penalty_range(*a.srange).tolist() if a.srange else None, a.pvalue, a.nodata, a.header_row)
    elif a.command == "set-range":
        cube.set_range(read(a.meta), a.glob, a.low, a.high).write.mode("overwrite").parquet(a.out)
    elif a.command == "check-dates":
        cube.missing_dates(read(a.raw), ["cube_id"], "obs_date", a.start, a.end).orderBy("cube_id", "obs_date").show(10_000, False)
    elif a.command == "compact":
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(a.folder)
        parquet_blocks.compact_files(spark, listed.select("path"), a.out, a.target_mb << 20).show(1000, False)


def save_window(a, cubes, meta) -> None:
    """Mosaics of the chosen cubes as a table of rasters or as GeoTIFF files."""
    from pyspark.sql import functions as F

    from chronoraster.operators import raster
    from chronoraster.plans import pipelines
    from chronoraster.sources import geotiff

    box = a.aoi or pipelines.WORLD
    if len(box) != 4 or not (box[0] < box[2] and box[1] > box[3]):
        raise ValueError("an area is ULX,ULY,LRX,LRY")
    known = meta.where("size(geotransform) = 6 and cols > 0").select("cube_id")
    for r in cubes.select("cube_id").distinct().join(known, "cube_id", "left_anti").orderBy("cube_id").toLocalIterator():
        print(f"{r['cube_id']}: left out, no affine transform or size")
    res = None if a.resolution is None else (a.resolution * 2)[:2]
    if a.geotiff and res is None:
        own = raster.output_resolution(F.transform(F.array(F.col("geotransform")[1], F.col("geotransform")[5]), F.abs), F.coalesce("is_global", F.lit(False)))
        sizes = meta.join(cubes.select("cube_id").distinct(), "cube_id", "left_semi").where("size(geotransform) = 6").select(own[0].alias("x"), own[1].alias("y")).distinct().take(2)
        if len(sizes) != 1:
            raise ValueError("the cubes have several pixel sizes; give --resolution")
        res = (sizes[0]["x"], sizes[0]["y"])
    out = pipelines.window(cubes, meta, box, res, a.tempint, a.begin_date, a.end_date, a.clip_valid, a.round_int, value="log10_s" if a.sgrid else "value")
    if not a.geotiff:
        raster.export_raster(out, a.out, a.overwrite, ("grp", "image"))
        return
    options = {k.upper(): v.upper() for k, v in a.co}
    if set(options) - {"COMPRESS"}:
        raise ValueError(f"unknown creation options: {', '.join(sorted(set(options) - {'COMPRESS'}))}")
    named = out.withColumn("image", F.concat(F.regexp_replace("grp", r"[^A-Za-z0-9]+", "_"), F.lit("_"), "image"))
    width, height = raster.raster_size(box[0], box[2], res[0]), raster.raster_size(box[1], box[3], res[1])
    for path in geotiff.write_geotiff(named, a.out, box, width, height, a.nodata, options.get("COMPRESS", "DEFLATE"), dict(a.mo), a.overwrite):
        print(path)


def download(a, response, sidecars) -> list[str]:
    """Fetch what a search response lists, once each and checked; names that could not be fetched."""
    from pathlib import Path

    from pyspark.sql import functions as F

    from chronoraster.operators import granules
    from chronoraster.sources import download as d
    from chronoraster.sources import files

    found = granules.search_filter(files.parse_search(response), a.tile_filter, a.begin_date, a.end_date).groupBy("filename").agg(F.max("link").alias("link"))
    checks = ("file_size", "checksum_type", "checksum")
    if sidecars is not None:
        found = found.join(sidecars.select("filename", *checks), "filename", "left")
    wanted = [d.Wanted(r.filename, r.link, *(r[c] for c in checks if sidecars is not None)) for r in found.where("link is not null").toLocalIterator()]
    target = Path(a.target)
    target.mkdir(parents=True, exist_ok=True)
    return d.fetch_all(wanted, target, a.threads, a.rounds, mirror=Path(a.mirror) if a.mirror else None)


def csv_smooth(spark, path: str, index: str | None, svalue: float | None = None, srange: list[float] | None = None, p: float | None = None, nodata: float | None = None, header_row: int = 0) -> str:
    """Smooth each column of a CSV; the penalty, its log10 and the p value follow the curve as further lines.

    A fixed ``svalue``, or the V-curve over ``srange`` (0 to 4 by 0.1).  Missing are empty cells, NaN and ``nodata``.
    """
    from pyspark.sql import functions as F

    from chronoraster.functions.whittaker import penalty_range
    from chronoraster.operators.smooth import smooth
    from chronoraster.sources import files

    long = files.read_csv_series(spark, path, index, header_row)
    v = F.when(F.col("value") != F.lit(nodata), F.col("value")) if nodata is not None else F.col("value")
    s = long.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("pos", v.alias("v")))).alias("o"))
    s = s.select("series", F.transform("o", lambda x: F.coalesce(x["v"], F.lit(0.0))).alias("y"), F.transform("o", lambda x: F.when(x["v"].isNotNull(), 1.0).otherwise(0.0)).alias("w"))
    fixed = svalue is not None
    z = smooth(s, ["series"], svalue=svalue, p=p, optimise=not fixed, srange=None if fixed else srange or penalty_range(0, 4, 0.1).tolist())
    tail = [F.pow(F.lit(10.0), "log10_s"), F.col("log10_s"), *([F.lit(float(p))] if p is not None else [])]
    out = z.select("series", F.posexplode(F.concat(F.transform("z", lambda x: x.cast("float").cast("double")), F.array(*tail))).alias("pos", "value"))
    names = [r[0] for r in s.select("series").orderBy("series").collect()]  # one per column of the file
    return files.write_csv_series(out, path, names, "fixed" if fixed and p is None else "vcurve_p" if p is not None else "vcurve")


if __name__ == "__main__":
    main()
