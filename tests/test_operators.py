"""Raster, cube, granule, source and streaming operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoraster.functions import axis as A
from chronoraster.functions.catalyst import ws2d_expr
from chronoraster.functions.whittaker import ws2d
from chronoraster.operators import cube, granules, raster, smooth
from chronoraster.sources import files, parquet_blocks
from chronoraster.streaming import append

VIM = [
    "MYD13A2.A2002177.h18v06.006.2015149071105.hdf",
    "MYD13A2.A2002185.h18v06.006.2015149071113.hdf",
    "MOD13A2.A2002193.h18v06.006.2015149022847.hdf",
    "MYD13A2.A2002201.h18v06.006.2015149071130.hdf",
    "MOD13A2.A2002209.h18v06.006.2015149022858.hdf",
]


def named(spark, names):
    return granules.parse_names(spark.createDataFrame([(f"/in/{n}",) for n in names], "path string"))


def test_names_and_interleaving(spark):
    g = named(spark, [*VIM, "odd.hdf"])
    one = g.where("julian = '2002193'").first()
    assert (one["product"], one.satellite, one.tile, one.version, one.raw_date, one.proc_ts) == ("MOD13A2", "Terra", "h18v06", "006", dt.date(2002, 7, 12), 2015149022847)
    odd = g.where("filename = 'odd.hdf'").first()
    assert odd["product"] is None and odd.raw_date is None and odd.is_global
    mixed = granules.interleave(g.where("product is not null")).collect()
    assert len(mixed) == 4 and {(r["product"], r.temporalresolution) for r in mixed} == {("MXD13A2", 8)}


def test_latest_version_and_ties(spark):
    names = ["MOD11A2.A2002201.h18v06.006.2015149071130.hdf", "MOD11A2.A2002201.h18v06.006.2014149071130.hdf", "MOD11A2.A2002209.h18v06.006.2014149071130.hdf"]
    g = named(spark, names)
    assert {r.filename for r in granules.latest_versions(g, "product", "tile", "raw_date").collect()} == {names[0], names[2]}
    assert granules.equal_versions(named(spark, [*names, names[0].replace("MOD", "MOD")]), "tile", "raw_date").count() == 1
    assert granules.latest_versions(g.limit(0), "product").count() == 0


def test_required_tiles(spark):
    g = named(spark, VIM)
    granules.require_tiles(g.where("product = 'MOD13A2'"), ["h18v06"])
    with pytest.raises(ValueError):
        granules.require_tiles(g, ["h18v06", "h19v06"])
    uneven = named(spark, [VIM[2], VIM[4], VIM[2].replace("h18v06", "h19v06")])
    with pytest.raises(ValueError):
        granules.require_tiles(uneven, ["h18v06", "h19v06"])
    with pytest.raises(ValueError):
        granules.required_tiles(g, ["18v06"])


def test_cube_names(spark):
    r = spark.createDataFrame([("LTD", "MYD11A2", "h01v02", "006"), ("VIM", "MXD13C1", None, "006")], "c string, p string, t string, v string")
    name = granules.cube_name(F.col("c"), F.col("p"), F.col("t"), F.col("v"))
    assert [x.n for x in r.select(name.alias("n")).collect()] == ["TDA/MYD11A2.h01v02.006.TDA", "VIM/MXD13C1.006.VIM"]
    assert [r.select(granules.smooth_name(F.lit("VIM/A.B.VIM"), s).alias("n")).first().n for s in (None, 5, 10, 7)] == ["VIM/A.B.tx" + x + ".VIM" for x in "npdc"]


def test_arguments():
    assert granules.check_roi([1, 2, 3, 4]) == (1, 4, 3, 2) and granules.check_tiles(["H18V06"]) == ["h18v06"]
    for bad in ([1], [3, 2, 1, 4]):
        with pytest.raises(ValueError):
            granules.check_roi(bad)


def test_target_axis_stops_at_the_last_raw_year():
    raw = [dt.date(2020, 1, 1) + dt.timedelta(16 * i) for i in range(23)]  # the last one is day 353
    daily, target = A.target_days(raw, 16, 10)
    assert daily[-1].year == 2021 or daily[-1] == dt.date(2021, 1, 3) or daily[-1] == raw[-1] + dt.timedelta(16)
    assert target[0] == dt.date(2020, 1, 5) and target[-1] == dt.date(2020, 12, 25)
    assert A.target_days(raw, 16, 16)[1] == raw
    assert A.target_days(raw, 16, 7, dt.date(2020, 2, 1))[1][:2] == [dt.date(2020, 2, 1), dt.date(2020, 2, 8)]
    eight = [dt.date(2002, 6, 26) + dt.timedelta(1)]
    assert A.target_days([], 8, 10) == ([], []) and A.target_days(eight, 8, 8)[1] == eight


def test_upsert(spark):
    t = lambda ds, v: spark.createDataFrame([(dt.date(2020, 1, d), v) for d in ds], "obs_date date, v int")
    assert sorted((r.obs_date.day, r.v) for r in cube.upsert(t([1, 2, 3], 0), t([2, 3, 4], 1)).collect()) == [(1, 0), (2, 1), (3, 1), (4, 1)]
    with pytest.raises(ValueError):
        cube.upsert(t([1, 2, 3, 4], 0), t([2, 3], 1))
    assert cube.upsert(t([1], 0), t([1], 0).limit(0)).count() == 1


def test_empty_cube_and_replaced_dates(spark, tmp_path):
    p = str(tmp_path / "cube")
    cube.create_cube(spark, p)
    assert cube.read_cube(spark, p).count() == 0
    t = lambda ds, v: spark.createDataFrame([(1, v, "V/P.h01v01.6.V", dt.date(2020, 1, d)) for d in ds], cube.CUBE_SCHEMA)
    cube.replace_dates(t([1, 2], 0), p, "cube_id", "obs_date")
    cube.replace_dates(t([2, 3], 1), p, "cube_id", "obs_date")
    assert sorted((r.cube_id, r.obs_date.day, r.value) for r in cube.read_cube(spark, p).collect()) == [("V/P.h01v01.6.V", d, v) for d, v in ((1, 0), (2, 1), (3, 1))]
    assert cube.octads(2020)[-1] == dt.date(2020, 12, 26) and len(cube.octads(2019)) == 46


def test_tail_and_contiguity(spark):
    t = spark.createDataFrame([(dt.date(2020, 1, d), d) for d in (1, 3, 5, 7)], "obs_date date, v int")
    assert sorted(r.v for r in cube.tail(t, "obs_date", 2).collect()) == [5, 7] and cube.tail(t, "obs_date", 0).count() == 4
    with pytest.raises(ValueError):
        cube.tail(t, "obs_date", 5)
    assert cube.contiguous(t, t.where("v > 3")).first()[0] and not cube.contiguous(t, t.where("v in (1, 5)")).first()[0]
    assert cube.contiguous(t, t.limit(0)).first()[0] is None
    with pytest.raises(ValueError):
        cube.require_last(t, dt.date(2020, 1, 8))


AXIS = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(12)]


def series(spark):
    rng = np.random.default_rng(0)
    rows = [(k, AXIS[i], float(rng.normal())) for k in range(5) for i in range(12) if rng.random() > 0.2]
    rows += [(9, AXIS[0], 1.0), (9, AXIS[1], 2.0), (8, AXIS[0], None), (7, dt.date(1999, 1, 1), 3.0), (0, AXIS[3], 50.0), (0, AXIS[3], 49.0)]
    return cube.to_series(spark.createDataFrame(rows, "k bigint, d date, v double"), ["k"], "d", "v", AXIS)


def test_series_and_modes(spark):
    s = series(spark).cache()
    got = {r.k: r for r in s.collect()}
    assert set(got) == {0, 1, 2, 3, 4, 9} and got[0].y[3] == 50.0
    z = {r.k: r for r in smooth.smooth(s, ["k"], svalue=1.0).collect()}
    c = {r.k: r.z for r in s.select("k", ws2d_expr(F.col("y"), F.col("w"), F.lit(10.0), 12).alias("z")).collect()}
    for k in range(5):
        y, w = np.array(got[k].y)[:, None], np.array(got[k].w)[:, None]
        assert np.allclose(z[k].z, ws2d(y, 10.0, w)[:, 0]) and np.allclose(c[k], z[k].z)
    assert not z[9].smoothed and z[9].z[:3] == [1.0, 2.0, None] and z[9].log10_s is None
    far = smooth.smooth(s, ["k"], svalue=0.0, raw_dates=AXIS, raw_step=1, step=5, shift=0).collect()
    assert all(len(r.z) == 3 for r in far) and [r.z for r in far if r.k == 9] == [[None] * 3]
    assert all(len(r.z) == 3 for r in smooth.smooth(s, ["k"], svalue=0.0, nupdate=3).collect())
    null_grid = smooth.smooth(s.withColumn("g", F.lit(None).cast("float")), ["k"], grid="g").where("k = 0").first()
    assert np.allclose(null_grid.z, {r.k: r for r in smooth.smooth(s, ["k"], svalue=0.0).collect()}[0].z)
    with pytest.raises(ValueError):
        smooth.smooth(s, ["k"], svalue=0.0, start=AXIS[0])
    with pytest.raises(ValueError):
        smooth.smooth(s, ["k"])
    s.unpersist()


def test_rounding_clipping_storing(spark):
    df = spark.createDataFrame([(3141,), (3150,), (3250,), (-3150,), (50,), (150,), (None,)], "v int")
    assert [r[0] for r in df.select(raster.round_int(F.col("v"), 2)).collect()] == [3100, 3200, 3200, -3200, 0, 200, None]
    assert [r[0] for r in df.select(raster.clip(F.col("v"), 0, 200)).collect()] == [200, 200, 200, 0, 50, 150, None]
    big = spark.createDataFrame([(1e9,), (2.5,), (None,)], "v double")
    assert [r[0] for r in big.select(smooth.stored(F.col("v"))).collect()] == [32767, 2, None]


def test_labels(spark):
    d = spark.createDataFrame([(dt.date(2002, 7, 28),), (dt.date(2002, 7, 5),)], "d date")
    c = F.col("d")
    assert [tuple(r) for r in d.select(A.date_label(c, 8, "vim"), A.date_label(c, 5), A.date_label(c, 10)).collect()] == [("vim2002j209", "200207p6", "2002j209"), ("vim2002j186", "2002j186", "200207d1")]


def test_mosaic_and_windows(spark):
    t = spark.createDataFrame([(0, 0, 1, 5), (0, 0, 2, None), (0, 1, 1, 6), (0, 1, 2, 7), (1, 1, 1, None)], "row int, col int, o int, v int")
    assert sorted((r.row, r.col, r.v) for r in raster.mosaic(t, "o", ["row", "col"], "v").collect() if r.v) == [(0, 0, 5), (0, 1, 7)]
    assert raster.fill_tile(spark, t.limit(0).withColumnRenamed("v", "value"), 2, 3).count() == 6
    with pytest.raises(ValueError):
        raster.sgrid_window(t, (0, 1, 0, 0, 0, -1), (5, 1, 0, 0, 0, -1), 2, 2, 4, 4, "v")
    with pytest.raises(ValueError):
        raster.warp_nearest(t, (0, 1, 0, 0, 0, -1), (0, 1, 1, 0), 1, 1, "v", "bilinear")
    gt = spark.range(1).select(raster.tile_geotransform(F.lit("h16v07"))).first()[0]
    assert math.isclose(gt[0], -2223901.0393329998) and math.isclose(gt[3], 2223901.0393329998)
    assert raster.raster_size(10.0, -5.0, 0.25) == 60


def test_axis_check_and_info(spark):
    t = spark.createDataFrame([("a", AXIS[0]), ("a", AXIS[1]), ("b", AXIS[0]), ("b", AXIS[1]), ("c", None)], "cube string, d date")
    assert tuple(raster.axis_check(t, "cube", "d").first()) == (2, 1)
    assert raster.axis_check(t.limit(0), "cube", "d").first()[0] == 0
    i = cube.axis_info(t, ["cube"], "d").where("cube = 'a'").first()
    assert (i.first_date, i.n_dates) == (AXIS[0], 2)


def test_export_keeps_or_replaces(spark, tmp_path):
    p = str(tmp_path / "out")
    r = lambda v: spark.createDataFrame([("vim1", 0, v)], "image string, row int, v int")
    raster.export_raster(r(1), p)
    raster.export_raster(r(2).union(spark.createDataFrame([("vim2", 0, 3)], "image string, row int, v int")), p)
    assert sorted(x.v for x in spark.read.parquet(p).collect()) == [1, 3]
    raster.export_raster(r(4), p, overwrite=True)
    assert sorted(x.v for x in spark.read.parquet(p).collect()) == [3, 4]


def test_checksums_and_validation(spark):
    assert files.posix_cksum(b"") == 4294967295 and files.posix_cksum(b"123456789") == 930766865
    import hashlib

    rows = [(9, b"123456789", 9, "CKSUM", "930766865"), (9, b"123456789", 8, "CKSUM", "930766865"), (1, b"a", 1, "MD5", hashlib.md5(b"a").hexdigest()), (1, b"a", 1, "SHA256", "00"), (1, b"a", 1, None, None)]
    df = spark.createDataFrame(rows, "length int, content binary, file_size int, checksum_type string, checksum string")
    assert [r.valid for r in files.validate_files(df).collect()] == [True, False, True, False, False]


def test_scan_and_csv(spark, tmp_path):
    with pytest.raises(ValueError):
        (tmp_path / "x.txt").write_text("x")
        files.scan_directory(spark, str(tmp_path))
    (tmp_path / VIM[0]).write_bytes(b"123")
    assert [(r.length) for r in files.scan_directory(spark, str(tmp_path)).collect()] == [3]
    (tmp_path / "s.csv").write_text("id,a,b\n1,1.5,2\n2,,x\n3,NaN,4\n")
    got = {(r.pos, r.series): r.value for r in files.read_csv_series(spark, str(tmp_path / "s.csv"), "id").collect()}
    assert got == {(0, "a"): 1.5, (0, "b"): 2.0, (1, "a"): None, (1, "b"): None, (2, "a"): None, (2, "b"): 4.0}
    (tmp_path / "h.csv").write_text("made by x\n\nid,a\n7,0.5\n8,\"1.5\"\n")
    assert [(r.pos, r.series, r.value) for r in files.read_csv_series(spark, str(tmp_path / "h.csv"), "id", 1).orderBy("pos").collect()] == [(0, "a", 0.5), (1, "a", 1.5)]
    out = files.write_csv_series(files.read_csv_series(spark, str(tmp_path / "s.csv"), "id"), str(tmp_path / "s.csv"), ["a", "b"], "fixed")
    assert out.endswith("s_filt0.csv") and spark.read.csv(out, header=True).count() == 3


def test_streaming_appends_in_order(spark, tmp_path):
    schema = "obs_date date, v int"
    store = append.StoredCube(spark, str(tmp_path / "cube"), cube=None, keys=())

    def push(days, v):
        spark.createDataFrame([(dt.date(2020, 1, d), v) for d in days], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        append.append_stream(s, store, str(tmp_path / "cp")).awaitTermination()

    push([1, 2], 0)
    push([2, 3], 1)  # no keys: one row a date
    assert sorted((r.obs_date.day, r.v) for r in store.read().collect()) == [(1, 0), (2, 1), (3, 1)]
    store.append(store.read())  # a batch that was written already
    store.append(store.read().where("v = 9"))  # an empty one
    assert store.dates() == [dt.date(2020, 1, d) for d in (1, 2, 3)] and store.read().count() == 3
    assert store.last() == dt.date(2020, 1, 3)
    with pytest.raises(Exception):  # noqa: B017
        push([2], 2)
    with pytest.raises(ValueError):
        append.append_stream(None, store, "", expected_last=dt.date(2020, 1, 9))


def test_streams_keep_what_other_batches_and_cubes_wrote(spark, tmp_path):
    """A date over two batches, two cubes in one table, a pixel delivered again, a repeated batch."""
    store = append.StoredCube(spark, str(tmp_path / "cube"))
    batch = lambda *rows: spark.createDataFrame([(c, p, dt.date(2020, 1, d), v) for c, p, d, v in rows], "cube_id string, pixel_id bigint, obs_date date, value smallint")
    rows = lambda: sorted((r.cube_id, r.pixel_id, r.obs_date.day, r.value) for r in store.read().collect())
    store.append(batch(("VIM/a b", 1, 1, 10), ("VIM/a b", 2, 1, 11)))
    store.append(batch(("VIM/a b", 3, 1, 12)))
    store.append(batch(("B", 1, 1, 20)))
    assert rows() == [("B", 1, 1, 20), ("VIM/a b", 1, 1, 10), ("VIM/a b", 2, 1, 11), ("VIM/a b", 3, 1, 12)]
    for _ in range(2):
        store.append(batch(("VIM/a b", 2, 1, 99), ("VIM/a b", 1, 2, 13)))
    assert rows() == [("B", 1, 1, 20), ("VIM/a b", 1, 1, 10), ("VIM/a b", 1, 2, 13), ("VIM/a b", 2, 1, 99), ("VIM/a b", 3, 1, 12)]
    store.append(batch(("B", 1, 2, 21)))  # each cube has its own axis
    with pytest.raises(ValueError, match="a b"):
        store.append(batch(("VIM/a b", 1, 1, 0)).where("false").union(batch(("VIM/a b", 7, 1, 1))))
    assert store.dates("B") == [dt.date(2020, 1, 1), dt.date(2020, 1, 2)] and store.last("none") is None


def test_upsert_guards_each_cube(spark):
    t = lambda *rows: spark.createDataFrame([(c, dt.date(2020, 1, d), v) for c, d, v in rows], "cube_id string, obs_date date, v int")
    old = t(("a", 1, 0), ("a", 2, 0), ("b", 9, 0))
    assert cube.upsert(old, t(("a", 2, 1), ("a", 3, 1)), by=("cube_id",)).count() == 4  # before b's last date
    with pytest.raises(ValueError, match="b: stored"):
        cube.upsert(old, t(("a", 5, 1), ("b", 3, 1)), by=("cube_id",))
    cube.require_last(t(("a", 2, 0), ("b", 2, 0), ("b", 1, 0)), dt.date(2020, 1, 2))
    with pytest.raises(ValueError, match="b at 2020-01-01"):
        cube.require_last(t(("a", 2, 0), ("b", 1, 0)), dt.date(2020, 1, 2))


def test_posix_checksum_by_lanes():
    import random

    def plain(data):
        c = 0
        for byte in [*data, *(len(data) >> 8 * k & 255 for k in range((len(data).bit_length() + 7) // 8))]:
            c ^= byte << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        return c ^ 0xFFFFFFFF

    rnd = random.Random(1)
    assert files.posix_cksum(b"123456789") == 930766865
    for n in (0, 1, 63, 64, 65, 1000, 4097):
        data = rnd.randbytes(n)
        assert files.posix_cksum(data, 64) == files.posix_cksum(data) == plain(data)


def test_streaming_tail_smoother(spark, tmp_path):
    rows = [(k, d, float(d * (k + 1))) for k in range(2) for d in range(10)]
    spark.createDataFrame(rows, "key bigint, day bigint, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("key bigint, day bigint, value double").parquet(str(tmp_path / "in"))
    q = append.smooth_tail_stream(s, 6, 1.0).writeStream.outputMode("update").format("memory").queryName("tails").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted((r.key, r.day, round(r.z, 6)) for r in spark.table("tails").collect()) == [(0, 9, 9.0), (1, 9, 18.0)]
    q = append.smooth_tail_stream(s, 6, 1.0, 3).writeStream.outputMode("update").format("memory").queryName("tails3").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp3")).start()
    q.awaitTermination()
    assert sorted((r.key, r.day, round(r.z, 6)) for r in spark.table("tails3").collect()) == [(k, d, float(d * (k + 1))) for k in range(2) for d in (7, 8, 9)]


def test_parquet_blocks_are_copied(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    paths, rows = [], []
    for i in range(7):
        t = pa.table({"a": pa.array([i * 10 + k if k % 3 else None for k in range(i)], pa.int64()), "s": [f"x{i}-{k}" for k in range(i)], "v": pa.array([[k, None] for k in range(i)], pa.list_(pa.int16()))})
        p = str(tmp_path / f"f{i}.parquet")
        pq.write_table(t, p, compression="zstd")
        paths.append(p)
        rows += t.to_pylist()
    report = parquet_blocks.compact_files(spark, paths, str(tmp_path / "out"), target_bytes=3 * pq.ParquetFile(paths[3]).metadata.row_group(0).total_byte_size + 2000).collect()
    assert 1 <= len(report) < 7 and sum(r.rows for r in report) == len(rows)
    key = lambda r: (r["s"],)
    assert sorted((r for f in report for r in pq.read_table(f.path).to_pylist()), key=key) == sorted(rows, key=key)
    assert spark.read.parquet(*[f.path for f in report]).count() == len(rows)
    pq.write_table(pa.table({"other": [1]}), str(tmp_path / "odd.parquet"))
    with pytest.raises(Exception, match="schema"):
        parquet_blocks.compact_files(spark, [*paths, str(tmp_path / "odd.parquet")], str(tmp_path / "out2"), one_schema=True).collect()


def test_downloads_are_validated_and_retried(tmp_path):
    from chronoraster.sources import download as d

    src, out, mirror = (tmp_path / n for n in ("src", "out", "mirror"))
    for f in (src, out, mirror):
        f.mkdir()
    (src / "a").write_bytes(b"123456789")
    url = (src / "a").as_uri()
    slept = []
    left = d.fetch_all([d.Wanted("a", url, 9, "CKSUM", "930766865"), d.Wanted("b", url, 8), d.Wanted("c", url + "x")], out, rounds=3, sleep=slept.append, mirror=mirror)
    assert left == ["b", "c"] and slept == [2, 4] and (out / "a").is_symlink() and not list(mirror.glob("*.part"))
    assert [w for w, _ in zip(d.waits(), range(10))][-1] == 450
    assert d.search_parameters(["mod13a2"], "006", dt.date(2020, 1, 1), None, (1, 2)) == [{"short_name": "MOD13A2", "version": "006", "temporal": "2020-01-01T00:00:00Z,", "point": "1,2"}]
    with pytest.raises(ValueError):
        d.search_parameters(["x"], "1", aoi=(1, 2, 3))


def test_granule_source_needs_gdal():
    from chronoraster.sources.granule_source import GranuleSource

    src = GranuleSource({"path": "x.hdf"})
    assert src.name() == "granule" and "pixel_id" in src.schema()
    try:
        import osgeo  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="GDAL"):
            src.reader(None).partitions()


def test_search_response_and_sidecar(spark):
    e = spark.createDataFrame([("MOD13A2.A2020001.h01v02.006.2020010101010.hdf", "2020-01-01T00:00:00.000Z", "2020-01-16T23:59:59.000Z", "u", [("L",)]), ("MOD13C1.A2020001.006.2020010101010.hdf", "2020-01-17T00:00:00.000Z", None, None, [("K",)])], "producer_granule_id string, time_start string, time_end string, updated string, links array<struct<href:string>>")
    r = files.parse_search(e).collect()
    assert (r[0].tile, r[0].time_start, r[0].link, r[1].tile) == ("h01v02", dt.date(2020, 1, 1), "L", None)
    assert granules.search_filter(files.parse_search(e), ["h09v09"]).count() == 1
    x = spark.createDataFrame([("<a><FileSize>7526571</FileSize><ChecksumType>CKSUM</ChecksumType><Checksum>1534015008</Checksum></a>",)], "xml string")
    s = files.parse_sidecars(x).first()
    assert (s.file_size, s.checksum_type, s.checksum, s.file_name) == (7526571, "CKSUM", "1534015008", None)


def test_whole_raster_is_filled(spark, tmp_path):
    from chronoraster.plans import catalogue

    rows = [(i, [float(i), 0.5, -1.0]) for i in (0, 299, 300, 701)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = {(r.row, r.col): r.value for r in catalogue.queries()["fill_raster"](spark, str(tmp_path)).collect()}
    assert out.keys() == {(r, c) for r in range(1200) for c in range(64)}
    assert {k: v for k, v in out.items() if v is not None} == {(i, c): round(10000 * v) for i, e in rows for c, v in enumerate(e)}
    empty = spark.createDataFrame([], "row bigint, col bigint, value bigint")
    assert raster.tile_size(empty, 600, 64) == (0, 0) and raster.fill_tile(spark, empty, 0, 64).count() == 0
