"""What the physical plans must look like."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from chronoraster.functions.session import bounded_rows, join_small, written
from chronoraster.operators import compact, incremental, raster, regular, spikes, standing
from tests.test_problems import FILES, RAW, A, G, R, day, meta, raw


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def raw_path(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("t") / "raw")
    raw(spark, [(A, i, day(1 + i), i) for i in range(50)]).write.parquet(p)
    return p


def test_only_needed_columns_are_read(spark, raw_path):
    df = spark.read.parquet(raw_path)
    for out in (standing.standing(df), regular.regular_grid(df, meta(spark)), spikes.flag_readings(df, meta(spark))):
        assert "loaded_at" not in "".join(re.findall(r"ReadSchema: .*", plan(out)))


def test_date_filter_reaches_the_scan(spark, raw_path):
    out = raster.date_window(spark.read.parquet(raw_path), "obs_date", dt.date(2020, 1, 3), dt.date(2020, 1, 9))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(obs_date.*LessThanOrEqual\(obs_date", plan(out)) and out.count() == 7


def test_standing_readings_are_reduced_before_the_one_shuffle(spark, raw_path):
    p = plan(standing.standing(spark.read.parquet(raw_path)))
    tree = p.split("\n\n")[0]
    assert len(re.findall(r"\bExchange\b", tree)) == 1 and len(re.findall("Aggregate", tree)) == 2


def test_one_shuffle_of_readings(spark, raw_path):
    df = spark.read.parquet(raw_path)
    for out in (regular.regular_grid(df, meta(spark)), spikes.flag_readings(df, meta(spark))):
        tree = plan(out).split("\n\n")[0]
        assert len(re.findall(r"(?<!Broadcast)Exchange\b", tree)) == 1, tree


def test_no_cross_joins(spark, raw_path):
    df = spark.read.parquet(raw_path)
    outs = [regular.regular_grid(df, meta(spark)), spikes.flag_readings(df, meta(spark)), incremental.pending(spark.createDataFrame([], G), spark.createDataFrame([], R)), compact.superfluous_files(spark.createDataFrame([], FILES))]
    for out in outs:
        assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)


def test_small_sides_are_checked(spark):
    big, small = spark.range(100), spark.createDataFrame([(i, str(i)) for i in range(20)], "id bigint, s string")
    few, many = join_small(big, small, "id", "left", 20), join_small(big, small, "id", "left", 19)
    assert "Broadcast" in plan(few)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Broadcast" not in plan(join_small(big, small, "id", "left", 19))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(few.collect()) == sorted(many.collect())
    assert len(bounded_rows(small, 20, "x")) == 20
    with pytest.raises(ValueError, match="x has more"):
        bounded_rows(small, 19, "x")


def test_small_sides_are_bounded_in_bytes(spark, monkeypatch):
    from chronoraster.functions import session

    wide = spark.range(20).select("id", F.sequence(F.lit(1), F.lit(1000)).alias("a"))
    assert session.fetched(wide, 20) is not None and session.fetched(wide, 19) is None
    monkeypatch.setattr(session, "MAX_BYTES", 100_000)
    assert session.fetched(wide, 20, 100_000) is None and session.fetched(spark.range(20), 20, 10) is None
    assert session.fetched(spark.range(20), 20, 100_000).num_rows == 20


def test_written_tables_read_back(spark):
    df = spark.range(5).withColumn("a", F.array(F.col("id")))
    assert sorted(r.id for r in written(df, "t").collect()) == list(range(5))
    assert written(spark.createDataFrame([], RAW), "empty").count() == 0
