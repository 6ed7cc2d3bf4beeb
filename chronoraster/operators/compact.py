"""Consolidating tiny files: which ones matter, and their blocks (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoraster.functions.session import remove_at_end, written
from chronoraster.sources.parquet_blocks import _open, assemble, compact_files

BLOCK = 512  # pixels per unit of work
TARGET_RECORDS = 4_000_000  # records per output file


def _intervals(files: DataFrame) -> DataFrame:
    """Distinct (cube, label, first_pixel, n) with their last written file.

    A file whose interval another one repeats later can go at once; partial
    aggregation does this before the shuffle, so a group of retries of any size
    stays small, and a block holds at most BLOCK * (BLOCK + 1) / 2 pieces.
    """
    f = files.select("cube_id", F.rtrim("label").alias("label"), "first_pixel", F.size("vals").cast("bigint").alias("n"), F.struct("written_at", "file_id").alias("v"))
    f = f.where("n > 0").dropna(subset=["cube_id", "label", "first_pixel"])
    return f.groupBy("cube_id", "label", "first_pixel", "n").agg(F.max("v").alias("v"))


def live_runs(files: DataFrame) -> DataFrame:
    """(file_id, cube_id, label, first, n): runs of pixels whose last version the file holds.

    The last version has the greatest written_at (null first), then the greatest
    file_id.  Files without records, or without cube, label or first pixel, have none.
    """
    block = F.explode(F.sequence(F.floor(F.col("first_pixel") / BLOCK), F.floor((F.col("first_pixel") + F.col("n") - 1) / BLOCK)))
    parts = _intervals(files).select("cube_id", "label", block.alias("block"), "first_pixel", "n", F.col("v.written_at").alias("at"), F.col("v.file_id").alias("file_id"))
    lo = F.greatest("first_pixel", F.col("block") * BLOCK)
    hi = F.least(F.col("first_pixel") + F.col("n"), (F.col("block") + 1) * BLOCK)
    parts = parts.select("cube_id", "label", "block", lo.alias("lo"), hi.alias("hi"), "at", "file_id")
    key = ["cube_id", "label", "block"]
    parts = parts.repartition(*key).sortWithinPartitions(*key, F.desc_nulls_last("at"), F.desc("file_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, taken = None, np.zeros(BLOCK, bool)
        for b in batches:
            out: list[tuple] = []
            cubes, labels = b.column("cube_id").to_pylist(), b.column("label").to_pylist()
            cols = [b.column(c).to_pylist() for c in ("block", "lo", "hi", "file_id")]
            for cube, label, blk, a, z, fid in zip(cubes, labels, *cols):
                if (cube, label, blk) != now:
                    now = (cube, label, blk)
                    taken[:] = False
                base = blk * BLOCK
                here = taken[a - base : z - base]
                if here.all():
                    continue
                if not here.any():
                    out.append((fid, cube, label, a, z - a))
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate(([1], here.view(np.int8), [1]))))
                    out.extend((fid, cube, label, a + int(s), int(e - s)) for s, e in zip(edge[::2], edge[1::2]))
                here[:] = True
            if out:
                f, c, lb, s, n = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(c, pa.string()), pa.array(lb, pa.string()), pa.array(s, pa.int64()), pa.array(n, pa.int64())], names=["file_id", "cube_id", "label", "first", "n"])

    return parts.mapInArrow(run, "file_id bigint, cube_id string, label string, first bigint, n bigint")


def copy_plan(files: DataFrame, target_records: int = TARGET_RECORDS) -> DataFrame:
    """(cube_id, out_no, file_id, label, first, n): which block goes into which output file.

    An output holds whole dates of one cube, in order, until ``target_records``.
    """
    runs = live_runs(files)
    size = runs.groupBy("cube_id", "label").agg(F.sum("n").alias("records"))
    before = F.sum("records").over(Window.partitionBy("cube_id").orderBy("label").rowsBetween(Window.unboundedPreceding, -1))
    place = size.select("cube_id", "label", F.floor(F.coalesce(before, F.lit(0)) / target_records).alias("out_no"))
    return runs.join(place, ["cube_id", "label"])


def superfluous_files(files: DataFrame) -> DataFrame:
    """(file_id) of files that can go without loss of a record's last version."""
    needed = live_runs(files).select("file_id").distinct()
    return files.select("file_id").join(needed, "file_id", "left_anti")


def compacted(files: DataFrame) -> DataFrame:
    """(cube_id, label, first_pixel, vals): each record once, in its last written value.

    A file whose records are all live keeps its block of values as it is; of
    others the live runs are cut out.  Runs that a block border separates are
    joined again.  Ordered by cube, label and pixel within range partitions, so
    that a write gives few files of good size.
    """
    vals = files.where(F.size("vals") > 0).select("file_id", "first_pixel", "vals")
    runs = live_runs(files).groupBy("file_id", "cube_id", "label").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("runs"))
    both = runs.join(vals, "file_id")
    merged = F.aggregate(
        "runs",
        F.array().cast("array<struct<first:bigint,n:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["first"] + F.try_element_at(acc, F.lit(-1))["n"] == x["first"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), (F.try_element_at(acc, F.lit(-1))["n"] + x["n"]).alias("n")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    one = both.withColumn("r", F.explode(merged))
    whole = (F.col("r.first") == F.col("first_pixel")) & (F.col("r.n") == F.size("vals"))
    piece = F.when(whole, F.col("vals")).otherwise(F.slice("vals", (F.col("r.first") - F.col("first_pixel") + 1).cast("int"), F.col("r.n").cast("int")))
    out = one.select("cube_id", "label", F.col("r.first").alias("first_pixel"), piece.alias("vals"))
    return out.repartitionByRange("cube_id", "label", "first_pixel").sortWithinPartitions("cube_id", "label", "first_pixel")


def rewrite(files: DataFrame, target_bytes: int = 128 << 20) -> DataFrame:
    """``compacted`` through files: the live blocks as the small Parquet files of its tasks, and those
    copied block by block into few large ones without decoding (see ``parquet_blocks``)."""
    spark = files.sparkSession
    small = written(compacted(files), "tiny")
    paths = small.inputFiles()
    if not paths:
        return small
    folder = paths[0].rsplit("/", 1)[0] + "-large"
    out = [r["path"] for r in compact_files(spark, paths, folder, target_bytes, one_schema=True).select("path").collect()]  # one per large file
    if not out:
        return small
    remove_at_end(spark, folder)
    return spark.read.schema(small.schema).parquet(*out)


def consolidate(files: DataFrame, out_dir: str, pixel: str = "pixel", target_records: int = TARGET_RECORDS) -> DataFrame:
    """Join tiny Parquet files of one schema that overlap, rewrite and repeat each other; the report of ``assemble``.

    ``files``: (file_id, path, cube_id, label, first_pixel, n, written_at), one
    row per file, which holds n rows for the pixels from first_pixel on (column
    ``pixel``, in any order).  The planner (``live_runs``) tells which files hold
    no record's last version: those are left out.  Files that are live as a
    whole are copied as encoded column chunks.  Only files that are live in
    parts are decoded, and their live rows encoded again, alone.  An output
    holds whole dates of one cube until ``target_records``.
    """
    known = files.select("file_id", "path", "n")
    listed = files.select("file_id", "cube_id", "label", "first_pixel", "written_at", F.array_repeat(F.lit(0), F.col("n").cast("int")).alias("vals"))
    plan = copy_plan(listed, target_records)
    per = plan.groupBy("file_id", "cube_id", "out_no", "label").agg(F.sum("n").alias("live"), F.sort_array(F.collect_list(F.struct("first", "n"))).alias("runs"))
    inputs = per.join(known, "file_id").withColumn("runs", F.when(F.col("live") < F.col("n"), F.col("runs")))
    name = F.concat(F.regexp_replace("cube_id", r"[^A-Za-z0-9._-]", "_"), F.lit("-"), F.sha2("cube_id", 256).substr(1, 8), F.lit("-"), F.lpad(F.col("out_no").cast("string"), 5, "0"), F.lit(".parquet"))
    inputs = inputs.select(name.alias("out"), "path", "runs", "label", "file_id").repartition("out").sortWithinPartitions("out", "label", "file_id")

    def load(row: dict) -> bytes | None:
        if row["runs"] is None:
            return None
        import numpy as np
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        filesystem, inner = _open(row["path"])
        source = pq.ParquetFile(filesystem.open_input_file(inner))
        table = source.read()
        at = pc.cast(table.column(pixel), pa.int64()).to_numpy()
        keep = np.zeros(len(at), bool)
        for r in row["runs"]:
            keep |= (at >= r["first"]) & (at < r["first"] + r["n"])
        sink = pa.BufferOutputStream()
        pq.write_table(table.filter(pa.array(keep)), sink, compression=source.metadata.row_group(0).column(0).compression)
        return sink.getvalue().to_pybytes()

    return assemble(inputs, out_dir, load)
