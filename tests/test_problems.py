"""Data-preparation operators on small hand-made tables, against brute force."""

import datetime as dt
import random

import pytest

from chronoraster.operators import compact, fill, incremental, regular, spikes
from chronoraster.operators.standing import complete_meta, standing, standing_by_pixel

RAW = "obs_id bigint, cube_id string, pixel_id bigint, obs_date date, value smallint, proc_ts bigint, loaded_at timestamp"
META = "cube_id string, rows int, cols int, geotransform array<double>, projection string, resolution array<double>, nodata double, temporalresolution int, tshift int, is_global boolean, vamcode string, vmin double, vmax double"
A, B, V = "VIM/MXD13A2.h01v01.006.VIM", "VIM/MXD13A2.h01v02.006.VIM", "VIM/VNP13A2.h01v02.001.VIM"


def meta(spark, extra=()):
    rows = [
        (A, 10, 10, None, "P", [1.0, -1.0], -3000.0, 16, 8, False, "VIM", -2000.0, 10000.0),
        (B, 10, 10, None, None, None, None, None, 8, False, "vim", None, None),
        (V, 10, 10, None, "", [1.0, -1.0], -15000.0, 8, 8, False, None, -10000.0, 10000.0),
        *extra,
    ]
    return spark.createDataFrame(rows, META)


def raw(spark, rows):
    """rows: (cube, pixel, date, value[, proc_ts])"""
    full = [(i + 1, c, p, d, v, (rest[0] if rest else 1), None) for i, (c, p, d, v, *rest) in enumerate(rows)]
    return spark.createDataFrame(full, RAW)


def day(doy, year=2020):
    return dt.date(year, 1, 1) + dt.timedelta(doy - 1)


def test_standing_takes_latest_then_greatest_id_and_drops_null_keys(spark):
    r = raw(spark, [(A, 1, day(1), 10, 1), (A, 1, day(1), 20, 2), (A, 1, day(1), 30, 2), (A, 1, day(1), 40, None), (None, 1, day(1), 5, 1), (A, None, day(1), 5, 1), (A, 1, None, 5, 1)])
    assert [(x.obs_id, x.value) for x in standing(r).collect()] == [(3, 30)]
    assert standing(r.limit(0)).count() == 0
    assert [tuple(x) for x in standing_by_pixel(r).collect()] == [tuple(x) for x in standing(r).collect()] and standing_by_pixel(r.limit(0)).count() == 0
    rnd = random.Random(6)
    many = spark.createDataFrame([(rnd.choice([None, i]), rnd.choice([A, B]), rnd.randint(0, 3), day(rnd.randint(1, 9)), i % 100, rnd.choice([None, 1, 2, 3]), None) for i in range(3000)], RAW)
    assert sorted(map(tuple, standing_by_pixel(many).collect()), key=str) == sorted(map(tuple, standing(many).collect()), key=str)


def test_meta_is_completed_from_the_product(spark):
    m = {x.cube_id: x for x in complete_meta(meta(spark)).collect()}
    assert (m[B].nodata, m[B].t, m[B].vmin, m[B].vmax) == (-3000.0, 16, -2000.0, 10000.0)
    assert m[V].codes == [-15000.0, -13000.0]


def slow_gaps(rows, t):
    def start(d):
        y = dt.date(d.year, 1, 1)
        return y + dt.timedelta(((d - y).days // t) * t)

    have = {}
    for c, p, d, *_ in rows:
        have.setdefault((c, p), set()).add(start(d))
    out = set()
    for k, s in have.items():
        d = min(s)
        while d < max(s):
            if start(d) == d and d not in s:
                out.add((*k, int(d.strftime("%Y%j"))))
            d += dt.timedelta(1)
    return out


def test_grid_finds_every_empty_period_across_years(spark):
    rnd = random.Random(1)
    rows = []
    for pixel in range(20):
        d = day(rnd.randint(1, 300), 2019)
        for _ in range(rnd.randint(1, 40)):
            rows.append((A, pixel, d, rnd.choice([None, -3000, 100, 2000])))
            d += dt.timedelta(rnd.choice([3, 10, 16, 40, 120, 500]))
    grid = regular.regular_grid(raw(spark, rows), meta(spark)).cache()
    got = [tuple(r) for r in regular.missing_periods(grid).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_gaps(rows, 16)
    assert grid.count() == grid.select("cube_id", "pixel_id", "period").distinct().count()
    assert grid.where("status = 'gap' and value is not null or status <> 'gap' and value is null").count() == 0
    grid.unpersist()


def test_halo_makes_shards_agree_with_the_whole_series(spark):
    import numpy as np

    from chronoraster.functions import gridkernel

    rnd = random.Random(3)
    d, rows = day(200, 2019), []
    while d < day(200, 2021):
        rows.append((A, 1, d, rnd.randint(0, 9000)))
        d += dt.timedelta(rnd.choice([9, 20, 33, 60]))
    got = {r.period: r for r in regular.regular_grid(raw(spark, rows), meta(spark)).collect()}
    x = np.array([(r[2] - dt.date(1970, 1, 1)).days for r in rows])
    y = np.array([float(r[3]) for r in rows])
    n = len(x)
    one = np.zeros(n, int)
    _, label, value, _, status = gridkernel.grid(x, y, np.ones(n, bool), np.ones(n, bool), one, 1, np.array([16]), np.array([np.iinfo(np.int64).min]), np.array([80]))
    assert sorted(got) == label.tolist()
    for p, v, s in zip(label.tolist(), value, status):
        assert got[p].status == regular.STATUS[s]
        assert got[p].value == pytest.approx(v) if s < 2 else got[p].value is None


def test_grid_edge_cases(spark):
    assert regular.regular_grid(raw(spark, []), meta(spark)).count() == 0
    lone = regular.regular_grid(raw(spark, [(A, 1, day(20), 5), ("X/UNKNOWN.1.X", 1, day(20), 5), (A, 2, day(20), None)]), meta(spark)).collect()
    assert sorted((r.pixel_id, r.period, r.value, r.status) for r in lone) == [(1, 2020017, 5.0, "observed"), (2, 2020017, None, "gap")]
    wide = raw(spark, [(A, 1, day(20), 5)]).selectExpr("*", "1 as t", "2 as codes", "3 as shard", "4 as valid", "5 as own", "6 as p")
    assert regular.regular_grid(wide, meta(spark).selectExpr("*", "1 as t", "2 as codes", "'x' as product")).count() == 1


def test_flags_cover_all_series_across_batches(spark):
    rnd = random.Random(4)
    rows, bad = [], set()
    for pixel in range(30):
        for i in range(60):
            v = 3000 + int(rnd.gauss(0, 40)) + i * 10
            if i == 30:
                v += 900
                bad.add(len(rows) + 1)
            if i == 50 and pixel == 3:
                v = 32000
                bad.add(len(rows) + 1)
            rows.append((A, pixel, day(1 + 3 * i), v))
    rows.append((V, 1, day(3), -13000))
    rows.append(("X/UNKNOWN.1.X", 1, day(3), 9))
    got = {r.obs_id: r.fault for r in spikes.flag_readings(raw(spark, rows), meta(spark)).collect()}
    assert {k for k, f in got.items() if f} == bad and len(got) == len(rows) - 1
    assert spikes.flag_readings(raw(spark, []), meta(spark)).count() == 0


def test_fill_marks_exactly_the_missing_and_beats_the_global_median(spark):
    import numpy as np

    rnd = random.Random(7)
    rows, truth = [], {}
    for pixel in range(40):
        level = rnd.choice([1500, 4000, 7000])
        for i in range(46):
            v = int(level + 1200 * np.sin(i / 46 * 6.28) + rnd.gauss(0, 80))
            if rnd.random() < 0.15:
                truth[len(rows) + 1] = v
                v = rnd.choice([None, -3000])
            rows.append((A, pixel, day(1 + 8 * i), v))
    rows += [(B, 5, day(1), None), (V, 9, day(1), -13000), ("X/UNKNOWN.1.X", 1, day(3), None)]
    out = {r.obs_id: r for r in fill.fill_missing(raw(spark, rows), meta(spark)).collect()}
    assert {k for k, r in out.items() if r.filled} == {*truth, len(rows) - 2, len(rows) - 1, len(rows)}
    err = np.median([abs(out[k].value - v) for k, v in truth.items()])
    flat = np.median([abs(4000 - v) for v in truth.values()])
    assert err < 300 < flat
    assert out[len(rows) - 2].method.endswith("+level") and out[len(rows)].value is not None
    assert fill.fill_missing(raw(spark, []), meta(spark)).count() == 0
    alone = fill.fill_missing(raw(spark, [(A, 1, day(1), None)]), meta(spark)).first()
    assert (alone.value, alone.filled, alone.method) == (None, True, "none")


def test_held_out_readings_are_filled_better_than_by_plain_averages(spark):
    """Error of the filled values against what a product median, a pixel mean and linear interpolation give."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows, truth, plain, line = [], {}, {}, {}
    for pixel in range(80):
        level, swing = rng.choice([1500, 3500, 6000]), rng.choice([300, 1200])
        t = np.arange(0, 360, 6)
        v = np.rint(level + swing * np.sin(t / 365 * 2 * np.pi) + rng.normal(0, 60, len(t))).astype(int)
        gone = np.zeros(len(t), bool)
        i = rng.integers(2, len(t) - 14)
        gone[i : i + 12] = True  # a gap of more than two months
        for k in range(len(t)):
            if gone[k]:
                truth[len(rows) + 1] = v[k]
                plain[len(rows) + 1] = v[~gone].mean()
                line[len(rows) + 1] = np.interp(t[k], t[~gone], v[~gone])
            rows.append((A, pixel, day(1 + int(t[k])), None if gone[k] else int(v[k])))
    every = [r[3] for r in rows if r[3] is not None]
    out = {r.obs_id: r.value for r in fill.fill_missing(raw(spark, rows), meta(spark)).where("filled").collect()}
    error = lambda guess: np.mean([abs(guess(k) - v) for k, v in truth.items()])
    ours, mean, median = error(out.get), error(plain.get), error(lambda k: np.median(every))
    assert ours < 0.8 * mean and ours < 0.3 * median, (ours, mean, median, error(line.get))


def test_clusters_are_assigned_alike_in_a_plan(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from chronoraster.functions.prototypes import fit

    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, rnd.random(), float("nan")]), rnd.random(), rnd.choice(["a", "b", None])) for i in range(400)]
    num = np.array([[np.nan if r[1] is None else r[1], r[2]] for r in rows])
    cat = np.array([[r[3]] for r in rows], object)
    model = fit(num, cat, np.ones(len(rows)), 6, np.array([0.3]))
    df = spark.createDataFrame(rows, "i int, a double, b double, c string")
    got = [r.k for r in df.select("i", model.nearest([F.col("a"), F.col("b")], [F.col("c")]).alias("k")).orderBy("i").collect()]
    assert got == model.assign(num, cat).tolist()


def test_clusters_are_fitted_on_all_observed_records(spark, monkeypatch):
    """More records than were once sampled, in memory and in passes over blocks, against the fit of all of them."""
    import numpy as np
    from pyspark.sql import functions as F

    from chronoraster.functions import prototypes

    pixels, days = 50, 500
    rnd = random.Random(3)
    value = [rnd.randint(-1500, 9500) for _ in range(pixels)]  # constant by pixel, so that it is the level, too
    r = spark.range(pixels * days).select(
        (F.col("id") + 1).alias("obs_id"),
        F.when(F.col("id") % pixels < 49, A).otherwise(V).alias("cube_id"),
        (F.col("id") % pixels).alias("pixel_id"),
        F.date_add(F.lit(day(1)), (F.col("id") / pixels).cast("int")).alias("obs_date"),
        F.element_at(F.array(*[F.lit(v) for v in value]), (F.col("id") % pixels + 1).cast("int")).cast("smallint").alias("value"),
        F.lit(1).cast("bigint").alias("proc_ts"), F.lit(None).cast("timestamp").alias("loaded_at"),
    )
    r = r.unionByName(raw(spark, [(A, pixels, day(1), -1990)]))  # the one lowest record, at which the fit starts
    value.append(-1990)
    at = [(p, day(1) + dt.timedelta(d)) for d in range(days) for p in range(pixels)] + [(pixels, day(1))]
    span = [(value[p] + 2000) / 12000 if p != 49 else (value[p] + 10000) / 20000 for p, _ in at]
    angle = np.array([d.timetuple().tm_yday for _, d in at]) * (2 * np.pi / 365.25)
    num = np.column_stack([span, 0.5 * np.sin(angle), 0.5 * np.cos(angle)])
    cat = np.array([("MXD13A2", "VIM", "v01") if p != 49 else ("VNP13A2", "VIM", "v02") for p, _ in at], object)
    want = prototypes.fit(num, cat, np.ones(len(at)), fill.CLUSTERS, np.array(fill.GAMMA))
    models, nearest = [], prototypes.Prototypes.nearest
    monkeypatch.setattr(prototypes.Prototypes, "nearest", lambda self, *a: models.append(self) or nearest(self, *a))
    for bound in (100_000, 0):
        monkeypatch.setattr(prototypes, "IN_MEMORY", bound, raising=False)
        fill.fill_missing(r, meta(spark))
    for got in models:
        assert np.allclose(got.numeric, want.numeric, atol=1e-9) and (got.categorical == want.categorical).all()
    assert len(models) == 2 and np.array_equal(models[0].numeric, models[1].numeric)


def test_a_table_in_blocks_is_fitted_as_its_records_in_memory(spark, monkeypatch):
    import numpy as np

    from chronoraster.functions import prototypes

    monkeypatch.setattr(prototypes, "IN_MEMORY", 0)
    monkeypatch.setattr(prototypes, "BLOCK", 64)
    rnd = random.Random(4)
    kinds = [(None, "x"), ("a", "x"), ("b", None), (None, None)]
    rows = [(rnd.choice([None, rnd.random(), float("nan")]), -rnd.random(), rnd.randrange(4), 0) for _ in range(900)]
    num = np.array([[np.nan if a is None else a, b] for a, b, *_ in rows])
    cat = np.array([kinds[k] for *_, k, _ in rows], object)
    want = prototypes.fit(num, cat, np.ones(len(rows)), 6, np.array([0.3, 0.2]))
    df = spark.createDataFrame(rows, "a double, b double, kind int, day int")
    got = prototypes.fit_table(df, ["a", "b"], kinds, 6, np.array([0.3, 0.2]))
    assert np.array_equal(got.numeric, want.numeric) and (got.categorical == want.categorical).all()
    none = prototypes.fit_table(df.limit(0), ["a", "b"], kinds, 6, np.array([0.3, 0.2]))
    assert none.numeric.shape == (1, 2) and none.categorical.tolist() == [[None, None]]


def test_attributes_are_completed_and_named(spark):
    m = {r.cube_id: r for r in fill.fill_attributes(meta(spark)).collect()}
    assert m[B].projection == "P" and m[B].resolution == [1.0, -1.0] and m[B].temporalresolution == 16
    assert set(m[B].filled) == {"nodata", "temporalresolution", "vmin", "vmax", "projection", "resolution"}
    assert m[V].vamcode == "VIM" and m[A].filled == []
    assert fill.fill_attributes(meta(spark).limit(0)).count() == 0


G = "granule_id bigint, filename string, raw_date date, proc_ts bigint, cube_id string, cksum bigint, collected_at timestamp"
R = "run_id bigint, cube_id string, processed_at timestamp, status string, rawdates array<string>"


def test_pending_dates(spark):
    t = lambda h: dt.datetime(2020, 3, 1, h)
    g = [
        (1, "X.A2020001.h.hdf", day(1), 1, "a", 11, t(1)),
        (2, "X.A2020009.h.hdf", None, 1, "a", 12, t(1)),  # date from the name
        (3, "X.A2020017.h.hdf", day(17), 1, "a", 13, t(1)),
        (4, "X.A2020017.h.hdf", day(17), 2, "a", 13, t(9)),  # newer, same content
        (5, "X.A2020025.h.hdf", day(25), 1, "a", 14, t(1)),
        (6, "X.A2020025.h.hdf", day(25), 2, "a", 15, t(9)),  # newer, other content
        (7, "X.A2020033.h.hdf", day(33), 1, "a", 16, t(9)),  # late
        (8, "X.A2020041.h.hdf", day(41), 1, "a", 17, None),
        (9, "X.A2020001.h.hdf", day(1), 1, "b", 18, t(1)),
        (10, "nothing", None, 1, "a", 19, t(1)),
    ]
    r = [
        (1, "a", t(5), "OK", ["2020025 ", "2020009", "", None, "2020009", "2020017", "2020041"]),
        (2, "a", t(8), "failed", ["2020001"]),
        (3, "b", t(8), None, ["2020001"]),
    ]
    got = {(x.cube_id, x.label): x.change for x in incremental.pending(spark.createDataFrame(g, G), spark.createDataFrame(r, R)).collect()}
    assert got == {("a", "2020001"): "added", ("a", "2020025"): "replaced", ("a", "2020033"): "added", ("a", "2020041"): "added", ("b", "2020001"): "added"}
    gone = incremental.pending(spark.createDataFrame([], G), spark.createDataFrame(r, R)).collect()
    assert {(x.label, x.change, x.granule_id) for x in gone} == {(k, "removed", None) for k in ("2020025", "2020009", "2020017", "2020041")}
    assert incremental.pending(spark.createDataFrame(g, G), spark.createDataFrame([], R)).count() == 7


def test_manifest_delta_with_deletion_vectors(spark):
    v = lambda *files: spark.createDataFrame(list(files), incremental.MANIFEST)
    old, new = v(("a", 3, []), ("b", 4, [1]), ("c", 2, []), ("e", 2, [0, 1])), v(("a", 3, [0]), ("b", 4, [2]), ("d", 2, [1]), ("f", 0, None))
    got = {(r.op, r.path, None if r.rows is None else tuple(r.rows), tuple(r.skip)) for r in incremental.manifest_delta(old, new).collect()}
    assert got == {("insert", "d", None, (1,)), ("insert", "b", (1,), ()), ("delete", "c", None, ()), ("delete", "a", (0,), ()), ("delete", "b", (2,), ())}
    assert incremental.manifest_delta(old, old).count() == 0


def test_manifest_delta_against_brute_force(spark):
    rnd = random.Random(5)

    def version():
        return {f"f{i}": (6, sorted(rnd.sample(range(6), rnd.choice([0, 0, 1, 3, 6])))) for i in range(40) if rnd.random() < 0.7}

    def live(v):
        return {(p, k) for p, (n, gone) in v.items() for k in range(n) if k not in gone}

    for _ in range(3):
        a, b = version(), version()
        frames = [spark.createDataFrame([(p, n, d) for p, (n, d) in v.items()], incremental.MANIFEST) for v in (a, b)]
        got = {"insert": set(), "delete": set()}
        for r in incremental.manifest_delta(*frames).collect():
            rows = [k for k in range(6) if k not in r.skip] if r.rows is None else r.rows
            got[r.op] |= {(r.path, k) for k in rows}
        assert got == {"insert": live(b) - live(a), "delete": live(a) - live(b)}


def test_a_run_that_dies_between_write_and_commit_is_made_good(spark, tmp_path, monkeypatch):
    """Nothing of it is read, its version is not processed, and the next run does all of the work once."""
    log = incremental.CommitLog(spark, str(tmp_path / "out"))
    assert log.write(spark.range(3), "v1", manifest=spark.range(1))

    class Dies:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "rename":
                raise OSError("the driver is gone")
            return getattr(self.fs, name)

    with monkeypatch.context() as m:
        m.setattr(log, "_fs", Dies(log._fs))
        with pytest.raises(OSError):
            log.write(spark.range(3, 9), "v2", manifest=spark.range(1))
    again = incremental.CommitLog(spark, str(tmp_path / "out"))
    assert again.processed_version() == "v1" and again.read().count() == 3
    assert again.write(spark.range(3, 9), "v2", manifest=spark.range(1)) and not again.write(spark.range(3, 9), "v2")
    assert sorted(r.id for r in again.read().collect()) == list(range(9))


def test_commit_log_is_exactly_once(spark, tmp_path):
    log = incremental.CommitLog(spark, str(tmp_path / "out"))
    assert log.processed_version() is None and log.read() is None
    assert log.write(spark.range(3), 1)
    assert not log.write(spark.range(9), 1)
    spark.range(5).write.parquet(str(tmp_path / "out" / "data-left-behind"))  # a run that died before its commit
    assert log.write(spark.range(3, 5), 2) and log.processed_version() == 2
    assert sorted(r.id for r in log.read().collect()) == [0, 1, 2, 3, 4]


FILES = "file_id bigint, path string, cube_id string, label string, first_pixel bigint, vals array<smallint>, size_bytes int, written_at timestamp"


def test_compaction_against_brute_force(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(300):
        n = rnd.choice([0, 1, 5, 40, 700])
        vals = None if rnd.random() < 0.05 else [rnd.randint(-100, 100) if rnd.random() < 0.95 else None for _ in range(n)]
        at = None if rnd.random() < 0.05 else dt.datetime(2020, 1, rnd.randint(1, 3))
        rows.append((i, "p", rnd.choice("ab"), rnd.choice(["2020001", "2020001  ", "2020009"]), rnd.choice([0, 10, 500, 1020]), vals, 1, at))
    df = spark.createDataFrame(rows, FILES)
    last = {}
    for r in rows:
        for k, v in enumerate(r[5] or []):
            key = (r[2], r[3].rstrip(), r[4] + k)
            rank = (r[7] or dt.datetime.min, r[0])
            if key not in last or rank > last[key][0]:
                last[key] = (rank, r[0], v)
    assert {x.file_id for x in compact.superfluous_files(df).collect()} == {r[0] for r in rows} - {f for _, f, _ in last.values()}
    got = {}
    for r in compact.compacted(df).collect():
        for k, v in enumerate(r.vals):
            key = (r.cube_id, r.label, r.first_pixel + k)
            assert key not in got
            got[key] = v
    assert got == {k: v for k, (_, _, v) in last.items()}
    assert compact.superfluous_files(df.limit(0)).count() == 0


def test_tiny_files_are_joined_by_copying_their_encoded_blocks(spark, tmp_path):
    """Only files that are live in parts are decoded; bytes and records are counted."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from chronoraster.sources import parquet_blocks

    (tmp_path / "in").mkdir()
    rnd, rows, last = random.Random(4), [], {}
    for i in range(250):
        cube, label, first, n = rnd.choice(["VIM/a.1", "VIM_a.1"]), rnd.choice(["2020001", "2020009 "]), rnd.choice([0, 0, 40, 500, 2000 + 10 * i]), rnd.choice([10, 40])
        at = dt.datetime(2020, 1, rnd.randint(1, 3))
        vals = [rnd.choice([None, rnd.randint(-9, 9)]) for _ in range(n)]
        path = str(tmp_path / "in" / f"f{i}.parquet")
        pq.write_table(pa.table({"cube_id": [cube] * n, "label": [label.strip()] * n, "pixel": pa.array(range(first, first + n), pa.int64()), "value": pa.array(vals, pa.int16())}), path, compression="zstd")
        rows.append((i, path, cube, label, first, n, at))
        for k, v in enumerate(vals):
            key = (cube, label.strip(), first + k)
            if key not in last or (at, i) > last[key][0]:
                last[key] = ((at, i), i, v, n)
    df = spark.createDataFrame(rows, "file_id bigint, path string, cube_id string, label string, first_pixel bigint, n bigint, written_at timestamp")
    report = compact.consolidate(df, str(tmp_path / "out"), target_records=1500).collect()
    assert 2 <= len(report) <= 8
    got = [tuple(r.values()) for f in report for r in pq.read_table(f.path).to_pylist()]
    assert len(got) == len(set(got)) == len(last) and set(got) == {(*k, v) for k, (_, _, v, _) in last.items()}
    live = {}
    for _, i, _, n in last.values():
        live[i] = (live.get(i, (0, n))[0] + 1, n)
    whole = sum(sum(parquet_blocks._span(c)[1] for c in g[1][1][1]) for i, (k, n) in live.items() if k == n for g in parquet_blocks.read_footer(rows[i][1])[0][parquet_blocks.FILE_GROUPS][1][1])
    assert sum(f.copied for f in report) == whole and 0 < sum(f.encoded for f in report) < whole
    assert sum(f.files for f in report) == len(live) and compact.consolidate(df.limit(0), str(tmp_path / "none")).count() == 0
