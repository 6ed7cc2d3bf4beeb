"""Chains end to end, SQL functions and the command line."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoraster import cli
from chronoraster.functions.register import register
from chronoraster.functions.whittaker import ws2d
from chronoraster.operators import incremental
from chronoraster.plans import pipelines
from tests.test_problems import META, A, G, meta, raw

D0 = dt.date(2020, 1, 1)


def sample(spark, pixels=3, n=23):
    rng = np.random.default_rng(0)
    return raw(spark, [(A, p, D0 + dt.timedelta(16 * i), int(4000 + 1000 * np.sin(i / 3) + rng.normal(0, 50))) for p in range(pixels) for i in range(n) if (p, i) != (0, 5)] + [(A, 9, D0, 5), (A, 9, D0 + dt.timedelta(16), -3000)])


def test_smooth_cubes_equal_the_kernel(spark):
    r = sample(spark)
    out = pipelines.smooth_cubes(r, meta(spark), svalue=1.0).collect()
    y, w = np.zeros((23, 1)), np.zeros((23, 1))
    for x in r.where("pixel_id = 0").collect():
        y[(x.obs_date - D0).days // 16], w[(x.obs_date - D0).days // 16] = x.value, 1
    want = np.rint(ws2d(y, 10.0, w)[:, 0])
    got = [x.value for x in sorted((x for x in out if x.pixel_id == 0), key=lambda x: x.target_date)]
    assert got == want.tolist()
    skipped = {x.target_date: x.value for x in out if x.pixel_id == 9}
    assert skipped[D0] == 5 and skipped[D0 + dt.timedelta(16)] is None and not [x for x in out if x.pixel_id == 9][0].smoothed


def test_interpolated_targets_and_tail(spark):
    r = sample(spark)
    out = pipelines.smooth_cubes(r, meta(spark), optimise=True, p=0.9, step=10)
    days = {x.target_date for x in out.collect()}
    assert all(d.day in (5, 15, 25) for d in days) and max(d.year for d in days) == 2020
    assert {x.value for x in out.where("pixel_id = 9").collect()} == {None}
    tail = pipelines.smooth_cubes(r, meta(spark), svalue=0.0, nsmooth=12, nupdate=3).where("pixel_id = 1").collect()
    assert sorted(x.target_date for x in tail) == [D0 + dt.timedelta(16 * i) for i in (20, 21, 22)]
    assert pipelines.smooth_cubes(r, meta(spark), svalue=0.0, nsmooth=99).count() == 0
    assert pipelines.smooth_cubes(r.limit(0), meta(spark), svalue=0.0).count() == 0
    for bad in ({"svalue": 0.0, "nsmooth": 3, "nupdate": 5}, {}, {"svalue": 0.0, "start": D0}):
        with pytest.raises(ValueError):
            pipelines.smooth_cubes(r, meta(spark), **bad)


def test_sgrid_is_only_changed_by_new_penalties(spark):
    old = spark.createDataFrame([(A, 0, 0.5), (A, 77, 1.5)], "cube_id string, pixel_id bigint, log10_s float")
    run = pipelines.smooth_cubes(sample(spark), meta(spark), optimise=True)
    new = {x.pixel_id: x.log10_s for x in pipelines.update_sgrid(old, run).collect()}
    assert new[77] == 1.5 and new[0] != 0.5 and 9 not in new
    same = pipelines.smooth_cubes(sample(spark), meta(spark), sgrid=old).where("pixel_id = 0").first()
    assert same.log10_s == 0.5


def test_append_many_cubes(spark):
    t = lambda rows: spark.createDataFrame([(c, 1, D0 + dt.timedelta(d), v) for c, d, v in rows], "cube_id string, pixel_id bigint, obs_date date, value int")
    out = pipelines.append_cube(t([("a", 1, 0), ("a", 2, 0), ("b", 9, 0)]), t([("a", 2, 1), ("a", 3, 1), ("c", 1, 1)])).collect()
    assert sorted((x.cube_id, x.obs_date.day, x.value) for x in out) == [("a", 2, 0), ("a", 3, 1), ("a", 4, 1), ("b", 10, 0), ("c", 2, 1)]
    with pytest.raises(ValueError, match="b"):
        pipelines.append_cube(t([("b", 9, 0)]), t([("b", 5, 1)]))


def test_groups_need_one_axis(spark):
    t = spark.createDataFrame([("V/P.h01v01.6.V", D0), ("V/P.h02v01.6.V", D0 + dt.timedelta(1)), ("V/Q.h02v01.6.V", D0)], "cube_id string, obs_date date")
    pipelines.check_group(t.where("cube_id like '%h02%'"))
    with pytest.raises(ValueError):
        pipelines.check_group(t)


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("select ws2d(array(1d, 2d, 3d, 4d), array(1d, 1d, 1d, 1d), 1d) z, lag1corr(array(1d, 2d, 1d, 2d), array(1d, 1d, 1d, 1d)) c, posix_cksum('123456789') k, ws2d(null, null, 1d) n, size(ws2dp(array(1d, 2d, 3d, 9d), array(1d, 1d, 1d, 1d), 1d, 0.9d)) s").first()
    assert np.allclose(r.z, [1, 2, 3, 4]) and np.isclose(r.c, -1) and r.k == 930766865 and r.n is None and r.s == 4


def test_command_line(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    names = [f"M{'OY'[i % 2]}D13A2.A{(dt.date(2003, 1, 1) + dt.timedelta(8 * i)).strftime('%Y%j')}.h01v01.006.20200010000{i:02d}.hdf" for i in range(12)]
    px = [(f"/in/{n}", k, 1000 + 10 * i + k) for i, n in enumerate(names) for k in range(4)]
    schema = "path string, pixel_id bigint, value smallint"
    spark.createDataFrame(px[:40], schema).write.parquet(p("px1"))
    spark.createDataFrame(px[36:], schema).write.parquet(p("px2"))
    cli.main(["collect", p("px1"), p("raw"), "--code", "VIM"])
    last = (dt.date(2003, 1, 1) + dt.timedelta(72)).isoformat()
    cli.main(["collect", p("px2"), p("raw"), "--code", "VIM", "--last-collected", last])
    rows = spark.read.parquet(p("raw"))
    assert rows.count() == 48 and rows.select("obs_date").distinct().count() == 12
    spark.createDataFrame([(A, 2, 2, [0.0, 926.625, 0.0, 0.0, 0.0, -926.625], "P", [926.625, -926.625], -3000.0, 8, 8, False, "VIM", -2000.0, 1050.0)], META).write.parquet(p("meta"))
    full = rows.withColumn("obs_id", F.monotonically_increasing_id()).withColumn("proc_ts", F.lit(1).cast("bigint"))
    full.write.parquet(p("full"))
    cli.main(["smooth", p("full"), p("meta"), p("smooth"), "--soptimize", "--run-log", p("runs")])
    assert spark.read.parquet(p("runs")).first().lastrun == "V-curve optimization of s"
    cli.main(["window", p("smooth"), p("meta"), p("tif"), "--clip-valid", "--round-int", "1", "--begin-date", "2003009"])
    out = spark.read.parquet(p("tif"))
    assert out.select("image").distinct().count() == 11 and out.agg(F.max("value")).first()[0] == 1050.0
    (tmp_path / "s.csv").write_text("id,a\n" + "".join(f"{i},{v}\n" for i, v in enumerate([1, 2, 3, 4, -9, 6])))
    cli.main(["csv-smooth", p("s.csv"), "--index", "id", "--svalue", "1", "--nodata", "-9"])
    assert [float(x.a) for x in spark.read.csv(p("s_filt0.csv"), header=True).orderBy(F.col("pos").cast("int")).collect()] == pytest.approx([1, 2, 3, 4, 5, 6, 10, 1])
    cli.main(["set-range", p("meta"), p("meta2"), "VIM/*", "0", "5"])
    assert spark.read.parquet(p("meta2")).first().vmax == 5.0
    cli.main(["check-dates", p("raw"), "2003001", "2003100"])
    cli.main(["compact", p("full"), p("joined")])
    assert spark.read.parquet(p("joined")).count() == 48


def smooth_tables(spark, tmp_path, rows, name="raw"):
    """Paths of raw rows (cube, pixel, step of 16 days, value) and of metadata for cubes A and B."""
    B = A.replace("h01v01", "h02v01")
    raw(spark, [(c, p, D0 + dt.timedelta(16 * i), v) for c, p, i, v in rows]).write.mode("overwrite").parquet(str(tmp_path / name))
    spark.createDataFrame([(c, 2, 2, None, "P", [1.0, -1.0], -3000.0, 8, 8, False, "VIM", -2000.0, 1050.0) for c in (A, B)], META).write.mode("overwrite").parquet(str(tmp_path / "meta"))
    return B, str(tmp_path / name), str(tmp_path / "meta"), str(tmp_path / "smooth")


def test_smoothing_some_cubes_keeps_the_others(spark, tmp_path):
    B = A.replace("h01v01", "h02v01")
    rows = [(c, p, i, 100 * p + i) for c in (A, B) for p in (0, 1) for i in range(6)]
    _, r, m, out = smooth_tables(spark, tmp_path, rows)
    cli.main(["smooth", r, m, out, "--svalue", "1"])
    stored = lambda: {(x.cube_id, x.pixel_id, x.target_date): x.value for x in spark.read.parquet(out).collect()}
    first = stored()
    assert len(first) == 24
    # only cube A, and of it only pixel 0 with other values
    _, r, _, _ = smooth_tables(spark, tmp_path, [(A, 0, i, 500 + i) for i in range(6)], "part")
    cli.main(["smooth", r, m, out, "--svalue", "1"])
    second = stored()
    assert second.keys() == first.keys()
    assert {k for k in first if first[k] != second[k]} == {k for k in first if k[:2] == (A, 0)}
    # a cube shorter than nsmooth is an error, and nothing is written
    _, r, _, _ = smooth_tables(spark, tmp_path, [(A, 0, i, 9) for i in range(6)] + [(B, 0, i, 9) for i in range(5)], "short")
    with pytest.raises(ValueError, match=r"h02v01.*\(5\)"):
        cli.main(["smooth", r, m, out, "--svalue", "1", "--nsmooth", "6"])
    assert stored() == second


def test_runs_log_what_they_read_and_commit_it_with_the_rows(spark, tmp_path, monkeypatch):
    rows = [(c, 0, i, 100 + i) for c in (A, A.replace("h01v01", "h02v01")) for i in range(6)]
    B, r, m, out = smooth_tables(spark, tmp_path, rows)
    runs = str(tmp_path / "runs")
    args = ["smooth", r, m, out, "--svalue", "1", "--run-log", runs]
    real, times = pipelines.smooth_cubes, []

    def collect_meanwhile(*a, **k):
        times.append(dt.datetime.now(dt.timezone.utc))
        raw(spark, [(A, 0, D0 + dt.timedelta(96), 7)]).write.mode("append").parquet(r)
        return real(*a, **k)

    monkeypatch.setattr(pipelines, "smooth_cubes", collect_meanwhile)
    # the run fails between its output and its log
    monkeypatch.setattr(pipelines.cube, "replace_dates", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        cli.main(args)
    monkeypatch.undo()
    granule = lambda c, i, t: (i, f"X.A{(D0 + dt.timedelta(16 * i)).strftime('%Y%j')}.h.hdf", D0 + dt.timedelta(16 * i), 1, c, i, t)
    early, late = dt.datetime(2020, 1, 1), times[0]
    g = [granule(c, i, early) for c in (A, B) for i in range(6)] + [granule(A, 6, late)]
    spark.createDataFrame(g, G).write.parquet(str(tmp_path / "granules"))
    left = lambda: [(x.cube_id, x.label) for x in incremental.pending(spark.read.parquet(str(tmp_path / "granules")), pipelines.read_run_log(spark, runs)).collect()]
    log = incremental.CommitLog(spark, out + "/_runs")
    pipelines.publish(log, out)
    assert left() == [(A, "2020097")]
    log._fs.delete(log._path(log.path + "/_published"), True)  # it failed before it was marked
    pipelines.publish(log, out)
    assert spark.read.parquet(out).count() == 12 and pipelines.read_run_log(spark, runs).count() == 2
    # only the pending cube is smoothed
    cli.main([*args, "--granules", str(tmp_path / "granules")])
    assert left() == [] and spark.read.parquet(out).count() == 13
    assert sorted(x.cube_id for x in pipelines.read_run_log(spark, runs).collect()) == [A, A, B]
    cli.main([*args, "--granules", str(tmp_path / "granules")])
    assert len(log.commits()) == 2


def test_smooth_queries_take_all_pixels_and_periods(spark, tmp_path):
    from chronoraster.plans import catalogue

    first = lambda i: dt.date(2019 + i // 46, 1, 1) + dt.timedelta(8 * (i % 46))
    gap, n = (30, 31, 32), 60
    rows = [(A, 0, first(i), 4000 + 50 * (i % 7)) for i in range(n) if i not in gap]
    rows += [(A, 1, first(2), 7), (A, 2, first(40), -3000), (A, 2, first(59), -3000)]  # not in the tail; never valid
    raw(spark, rows).write.parquet(str(tmp_path / "raw.parquet"))
    META_ROW = (A, 2, 2, None, "P", [1.0, -1.0], -3000.0, 8, 8, False, "VIM", -2000.0, 10000.0)
    spark.createDataFrame([META_ROW], META).write.parquet(str(tmp_path / "cube_meta.parquet"))
    tail = catalogue.queries()["smooth_tail"](spark, str(tmp_path)).collect()
    assert {(r.pixel_id, r.target_date) for r in tail} == {(k, first(i)) for k in (0, 1, 2) for i in range(54, 60)}
    assert {(r.pixel_id, r.smoothed, r.value is None) for r in tail} == {(0, True, False), (1, False, True), (2, False, True)}
    assert {r.pixel_id: r.smoothed for r in catalogue.queries()["smooth_raw"](spark, str(tmp_path)).collect()} == {0: True, 1: False, 2: False}
    r, m = spark.read.parquet(str(tmp_path / "raw.parquet")), spark.read.parquet(str(tmp_path / "cube_meta.parquet"))
    out = pipelines.smooth_cubes(pipelines.composites(r, m), m, svalue=1.0, is_standing=True, regular=True).where("pixel_id = 0").collect()
    y, w = np.zeros((n, 1)), np.ones((n, 1))
    y[:, 0] = [4000 + 50 * (i % 7) for i in range(n)]
    y[list(gap)], w[list(gap)] = 0, 0
    assert [x.value for x in sorted(out, key=lambda x: x.target_date)] == np.rint(ws2d(y, 10.0, w)[:, 0]).tolist()
    assert sorted(x.target_date for x in out) == [first(i) for i in range(n)]
