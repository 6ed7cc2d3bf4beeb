"""Date axes and labels as Spark columns and tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoraster.functions.constants import DEKAD_LABELS, PENTAD_LABELS


def from_julian(label: Column) -> Column:
    """YYYYDDD to date."""
    return F.to_date(label, "yyyyDDD")


def to_julian(d: Column) -> Column:
    return F.date_format(d, "yyyyDDD")


def on_step(d: Column, step: int) -> Column:
    """Is this day on the axis that starts each 1 January and takes ``step`` days?"""
    return (F.dayofyear(d) - 1) % step == 0


def on_pentad(d: Column) -> Column:
    return F.dayofmonth(d).isin(list(PENTAD_LABELS))


def on_dekad(d: Column) -> Column:
    return F.dayofmonth(d).isin(list(DEKAD_LABELS))


def on_axis(d: Column, step: int) -> Column:
    return on_pentad(d) if step == 5 else on_dekad(d) if step == 10 else on_step(d, step)


def days(spark: SparkSession, first: date, last: date, name: str = "day") -> DataFrame:
    return spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias(name))


def daily_axis(raw_dates: DataFrame, date_col: str, raw_step: int) -> DataFrame:
    """Every day from the first raw date to the last one plus ``raw_step``."""
    ends = raw_dates.agg(F.min(date_col).alias("a"), F.max(date_col).alias("z")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", F.date_add("z", raw_step))).alias("day"))


def target_axis(raw_dates: DataFrame, date_col: str, raw_step: int, step: int, start: date | None = None) -> DataFrame:
    """Target days (column ``day``), unordered.

    With ``start``: every ``step`` days from it on the daily axis.  Equal steps:
    the raw dates.  Otherwise the pentad (5), dekad (10) or step axis on the
    daily axis, up to the last raw date's year.
    """
    if start is not None:
        d = daily_axis(raw_dates, date_col, raw_step)
        return d.where((F.col("day") >= F.lit(start)) & (F.datediff("day", F.lit(start)) % step == 0))
    if step == raw_step:
        return raw_dates.select(F.col(date_col).alias("day")).distinct()
    last = raw_dates.agg(F.max(F.year(date_col)).alias("last_year"))
    return daily_axis(raw_dates, date_col, raw_step).where(on_axis(F.col("day"), step)).join(F.broadcast(last), F.year("day") <= F.col("last_year"), "left_semi")


def target_days(raw: list[date], raw_step: int, step: int, start: date | None = None) -> tuple[list[date], list[date]]:
    """(daily axis, target axis) of a cube's few raw dates, for use inside a kernel."""
    raw = sorted(set(raw))
    if not raw:
        return [], []
    daily = [raw[0] + timedelta(i) for i in range((raw[-1] - raw[0]).days + raw_step + 1)]
    if start is not None:
        return daily, [d for d in daily if d >= start and (d - start).days % step == 0]
    if step == raw_step:
        return daily, raw

    def there(d: date) -> bool:
        if step == 5:
            return d.day in PENTAD_LABELS
        if step == 10:
            return d.day in DEKAD_LABELS
        return (d.timetuple().tm_yday - 1) % step == 0

    return daily, [d for d in daily if d.year <= raw[-1].year and there(d)]


def date_label(d: Column, step: int | None, prefix: str = "") -> Column:
    """YYYYMM and the pentad's or dekad's label; YYYYjDDD for other steps and other days."""
    labels = {5: PENTAD_LABELS, 10: DEKAD_LABELS}.get(step, {})
    doy = F.concat(F.date_format(d, "yyyy"), F.lit("j"), F.date_format(d, "DDD"))
    out = doy
    for day, name in labels.items():
        out = F.when(F.dayofmonth(d) == day, F.concat(F.date_format(d, "yyyyMM"), F.lit(name))).otherwise(out)
    return F.concat(F.lit(prefix), out) if prefix else out
