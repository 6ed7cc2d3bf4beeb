"""The window chain: mosaics in degrees against brute force, GeoTIFF files, the command."""

import datetime as dt
import math
import random
import struct
import zlib

import pytest

from chronoraster import cli
from chronoraster.operators import raster
from chronoraster.plans import pipelines
from chronoraster.sources import geotiff

META = "cube_id string, rows int, cols int, geotransform array<double>, projection string, resolution array<double>, nodata double, temporalresolution int, tshift int, is_global boolean, vamcode string, vmin double, vmax double"
M = 926.6254330558334
DAY = dt.date(2020, 1, 1)


def cube_meta(spark, cells):
    """cells: (cube, rows, cols, ulx, uly, pixel size, global)"""
    rows = [(c, r, k, [x, s, 0.0, y, 0.0, -s], "P", [s, -s], -3000.0, 16, 8, g, "VIM", -2000.0, 10000.0) for c, r, k, x, y, s, g in cells]
    return spark.createDataFrame(rows, META)


def brute(cells, values, box, res):
    """Target pixel by target pixel: the source pixel its centre falls into; the last cube by name wins."""
    out, radius = {}, 6371007.181
    for t in range(round((box[1] - box[3]) / res)):
        lat = box[1] - (t + 0.5) * res
        for k in range(round((box[2] - box[0]) / res)):
            lon = box[0] + (k + 0.5) * res
            for c, rows, cols, ulx, uly, size, globe in sorted(cells):
                x, y = (lon, lat) if globe else (radius * math.radians(lon) * math.cos(math.radians(lat)), radius * math.radians(lat))
                row, col = math.floor((y - uly) / -size), math.floor((x - ulx) / size)
                if 0 <= row < rows and 0 <= col < cols and (v := values.get((c, row * cols + col))) is not None:
                    out[t, k] = float(max(-2000, min(10000, v)))
    return out


@pytest.mark.parametrize("globe", [False, True])
def test_window_equals_brute_force(spark, globe):
    rnd = random.Random(1)
    size = 0.05 if globe else M * 10
    names = ["VIM/MOD13C1.006.VIM"] if globe else ["VIM/MXD13A2.h18v04.006.VIM", "VIM/MXD13A2.h19v04.006.VIM", "VIM/MXD13A2.h20v04.006.VIM"]
    cells = [(n, 30, 40, (5.0 if globe else 300_000.0) + i * 35 * size, 47.0 if globe else 5_200_000.0, size, globe) for i, n in enumerate(names)]
    values = {(n, p): rnd.choice([None, rnd.randint(-4000, 12000)]) for n in names for p in range(1200)}
    rows = [(n, p, DAY, v) for (n, p), v in values.items()] + [("unknown", 1, DAY, 5)]
    cubes = spark.createDataFrame(rows, "cube_id string, pixel_id bigint, obs_date date, value smallint").selectExpr("*", "1 as row", "2 as gt", "3 as trow")
    box, res = (4.0, 47.5, 13.0, 44.0), 0.08
    got = pipelines.window(cubes, cube_meta(spark, cells), box, (res, res)).collect()
    assert {(r.trow, r.tcol): r.value for r in got} == brute(cells, values, box, res) and len(got) > 200
    assert {(r.grp, r.image) for r in got} == {(names[0] if globe else "VIM/MXD13A2.*.006.VIM", "vim2020j001")}
    assert pipelines.window(cubes.limit(0), cube_meta(spark, cells)).count() == 0


def test_own_resolution_and_area_outside(spark):
    cells = [("VIM/MXD13A2.h18v04.006.VIM", 10, 10, 0.0, 0.0, M, False)]
    cubes = spark.createDataFrame([(cells[0][0], p, DAY, p) for p in range(100)], "cube_id string, pixel_id bigint, obs_date date, value smallint")
    got = pipelines.window(cubes, cube_meta(spark, cells))
    assert 90 <= got.count() <= 121
    assert pipelines.window(cubes, cube_meta(spark, cells), (10.0, 60.0, 11.0, 59.0)).count() == 0


def read_tiff(raw):
    """(tags, samples) of a little-endian TIFF of 16-bit samples."""
    assert raw[:4] == b"II*\0"
    at = struct.unpack("<I", raw[4:8])[0]
    tags = {}
    for i in range(struct.unpack("<H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack("<HHI", raw[at + 2 + 12 * i :][:8])
        size = {2: 1, 3: 2, 4: 4, 12: 8}[kind] * n
        where = raw[at + 10 + 12 * i :][:4]
        data = where[:size] if size <= 4 else raw[struct.unpack("<I", where)[0] :][:size]
        tags[tag] = data.rstrip(b"\0").decode() if kind == 2 else struct.unpack(f"<{n}{ {3: 'H', 4: 'I', 12: 'd'}[kind] }", data)
    strips = [raw[o : o + n] for o, n in zip(tags[273], tags[279])]
    data = b"".join(zlib.decompress(s) if tags[259] == (8,) else s for s in strips)
    return tags, struct.unpack(f"<{len(data) // 2}h", data)


@pytest.mark.parametrize("compression", ["DEFLATE", "NONE"])
def test_geotiff_files(spark, tmp_path, compression):
    rows = [("a", 0, 0, 5.0), ("a", 63, 2, 6.5), ("a", 64, 1, -7.0), ("a", 149, 2, 8.0), ("b", 100, 1, 1.0), ("b", 5000, 1, 1.0), ("b", 3, 1, None)]
    df = spark.createDataFrame(rows, "image string, trow int, tcol int, value double")
    out = geotiff.write_geotiff(df, str(tmp_path / "o"), (10.0, 50.0, 13.0, -100.0), 3, 150, -3000, compression, {"A": "x & y"})
    assert [p.rsplit("/", 1)[1] for p in out] == ["a.tif", "b.tif"]
    tags, data = read_tiff((tmp_path / "o" / "a.tif").read_bytes())
    assert tags[256] == (3,) and tags[257] == (150,) and tags[33550] == (1.0, 1.0, 0.0) and tags[33922][3:5] == (10.0, 50.0) and tags[42113] == "-3000" and "x &amp; y" in tags[42112]
    assert len(data) == 450 and {i: v for i, v in enumerate(data) if v != -3000} == {0: 5, 63 * 3 + 2: 6, 64 * 3 + 1: -7, 149 * 3 + 2: 8}
    assert [v for v in read_tiff((tmp_path / "o" / "b.tif").read_bytes())[1] if v != -3000] == [1]
    assert geotiff.write_geotiff(df, str(tmp_path / "o"), (10.0, 50.0, 13.0, -100.0), 3, 150, 0, compression) == []  # kept
    assert geotiff.write_geotiff(df.limit(0), str(tmp_path / "e"), (10.0, 50.0, 13.0, -100.0), 3, 150, 0) == []


def test_window_command(spark, tmp_path):
    cells = [("VIM/MXD13A2.h18v04.006.VIM", 10, 10, 0.0, 0.0, M * 10, False)]
    cube_meta(spark, cells).write.parquet(str(tmp_path / "meta"))
    rows = [(cells[0][0], p, DAY, 100 + p) for p in range(100)]
    spark.createDataFrame(rows, "cube_id string, pixel_id bigint, obs_date date, value smallint").write.parquet(str(tmp_path / "raw"))
    spark.createDataFrame([(c, p, 0.5) for c, p, _, _ in rows], "cube_id string, pixel_id bigint, log10_s float").write.parquet(str(tmp_path / "sgrid"))
    area = ["--aoi", "0,0,1,-1", "--resolution", "0.1"]
    cli.main(["window", str(tmp_path / "raw"), str(tmp_path / "meta"), str(tmp_path / "t"), *area])
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.select("image").distinct().first()[0] == "vim2020j001" and 60 < got.count() <= 100
    cli.main(["window", str(tmp_path / "raw"), str(tmp_path / "meta"), str(tmp_path / "g"), *area, "--geotiff", "--co", "COMPRESS=NONE", "--mo", "K=V"])
    assert [p.name for p in (tmp_path / "g").glob("*.tif")] == ["VIM_MXD13A2_006_VIM_vim2020j001.tif"]
    cli.main(["window", str(tmp_path / "sgrid"), str(tmp_path / "meta"), str(tmp_path / "s"), *area, "--sgrid"])
    assert {r.value for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {0.5}
    with pytest.raises(ValueError, match="creation"):
        cli.main(["window", str(tmp_path / "raw"), str(tmp_path / "meta"), str(tmp_path / "x"), *area, "--geotiff", "--co", "TILED=YES"])
    with pytest.raises(ValueError, match="reference systems"):
        raster.sgrid_window(got, (0, 1, 0, 0, 0, -1), (0, 1, 0, 0, 0, -1), 1, 1, 1, 1, grid_srs="A", cube_srs="B")


def test_download_command(spark, tmp_path):
    name = "MOD13A2.A2020001.h01v02.006.2020010101010.hdf"
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / name).write_bytes(b"123456789")
    schema = "producer_granule_id string, time_start string, time_end string, updated string, links array<struct<href:string>>"
    entry = lambda n, url: (n, "2020-01-01T00:00:00.000Z", "2020-01-16T23:59:59.000Z", "u", [(url,)])
    spark.createDataFrame([entry(name, (tmp_path / "src" / name).as_uri()), entry(name.replace("2020001", "2020017"), "file:///nowhere")], schema).write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([(name, 9, "CKSUM", "930766865")], "filename string, file_size bigint, checksum_type string, checksum string").write.parquet(str(tmp_path / "s"))
    a = cli.parser().parse_args(["download", str(tmp_path / "r"), str(tmp_path / "out"), "--sidecars", str(tmp_path / "s"), "--rounds", "1", "--tile-filter", "h01v02"])
    left = cli.download(a, spark.read.parquet(a.response), spark.read.parquet(a.sidecars))
    assert left == [name.replace("2020001", "2020017")] and (tmp_path / "out" / name).read_bytes() == b"123456789"
