"""Queries of the data-preparation operators (problems 1 to 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoraster.functions.session import table
from chronoraster.operators import compact, fill, incremental, regular, spikes


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return regular.missing_periods(p1_grid(spark, d))


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular.regular_grid(table(spark, d, "raw"), table(spark, d, "cube_meta"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return p1_grid(spark, d).select("cube_id", "pixel_id", "period", F.col("n_readings").cast("bigint").alias("n_readings"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_flags(spark, d).where("fault > 0").select("obs_id")


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_readings(table(spark, d, "raw"), table(spark, d, "cube_meta"))


def p2_exact(spark: SparkSession, d: str) -> DataFrame:
    """Readings out of range or in a run of equal values: the faults that SQL can state."""
    return p2_flags(spark, d).where("fault & 3 > 0").selectExpr("obs_id", "fault & 3 as fault")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_filled(spark, d).where("filled").select("obs_id")


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    return fill.fill_missing(table(spark, d, "raw"), table(spark, d, "cube_meta"))


def p3_attributes(spark: SparkSession, d: str) -> DataFrame:
    return fill.fill_attributes(table(spark, d, "cube_meta"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Of granules' dates; dates that the last run used and that no granule has any more are in ``p4_changes``."""
    return p4_changes(spark, d).where("change <> 'removed'").select("cube_id", "label")


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending(table(spark, d, "granules"), table(spark, d, "run_log"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return compact.superfluous_files(table(spark, d, "chunk_files"))


def p5_compacted(spark: SparkSession, d: str) -> DataFrame:
    return compact.compacted(table(spark, d, "chunk_files"))


def p5_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = compact.copy_plan(table(spark, d, "chunk_files"))
    return plan.groupBy("cube_id", "out_no").agg(F.countDistinct("file_id").alias("n_files"), F.sum("n").alias("n_records"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the rewritten files."""
    out = compact.rewrite(table(spark, d, "chunk_files"))
    return out.select("cube_id", "label", "first_pixel", F.posexplode("vals").alias("i", "value")).select("cube_id", "label", (F.col("first_pixel") + F.col("i")).alias("pixel"), "value")


META_SQL = r"""
b AS (SELECT *, nullif(regexp_extract(cube_id, '^[^/]*/([^./]+)\.', 1), '') AS product FROM cube_meta),
pm AS (SELECT product, max(nodata) AS nd, max(temporalresolution) AS tr, max(vmin) AS lo, max(vmax) AS hi FROM b GROUP BY 1),
m AS (SELECT b.cube_id, b.product, coalesce(nodata, nd) AS nodata, coalesce(temporalresolution, tr)::BIGINT AS t,
             coalesce(vmin, lo) AS vmin, coalesce(vmax, hi) AS vmax
      FROM b LEFT JOIN pm ON b.product IS NOT DISTINCT FROM pm.product),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cube_id, pixel_id, obs_date ORDER BY proc_ts DESC, obs_id DESC) AS rn FROM raw) WHERE rn = 1)
"""

P1_SQL = (
    "WITH "
    + META_SQL
    + """,
p AS (SELECT s.cube_id, s.pixel_id, t, obs_date,
             make_date(year(obs_date), 1, 1) + ((((dayofyear(obs_date) - 1) // t) * t)::INTEGER) AS start
      FROM s JOIN m ON s.cube_id = m.cube_id WHERE t > 0),
e AS (SELECT cube_id, pixel_id, t, min(start) AS lo, max(start) AS hi FROM p GROUP BY ALL),
cal AS (SELECT t, unnest(generate_series(DATE '1990-01-01', DATE '2040-12-31', INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT t FROM e)),
starts AS (SELECT t, day FROM cal WHERE (dayofyear(day) - 1) % t = 0)
SELECT e.cube_id, e.pixel_id, (year(day) * 1000 + dayofyear(day))::BIGINT AS period
FROM e JOIN starts ON starts.t = e.t AND day > lo AND day < hi
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.cube_id = e.cube_id AND p.pixel_id = e.pixel_id AND p.start = starts.day)
"""
)

P1_COUNTS_SQL = P1_SQL.split("SELECT e.cube_id")[0] + """
SELECT e.cube_id, e.pixel_id, (year(day) * 1000 + dayofyear(day))::BIGINT AS period, count(p.start) AS n_readings
FROM e JOIN starts ON starts.t = e.t AND day BETWEEN lo AND hi
LEFT JOIN p ON p.cube_id = e.cube_id AND p.pixel_id = e.pixel_id AND p.start = starts.day
GROUP BY ALL
"""

P2_SQL = (
    "WITH "
    + META_SQL
    + """,
v AS (SELECT s.*, vmin, vmax FROM s LEFT JOIN m ON s.cube_id = m.cube_id
      WHERE NOT (value IS NULL OR CASE WHEN product LIKE 'VNP%' THEN value IN (-15000, -13000) ELSE coalesce(value = nodata, FALSE) END)),
c AS (SELECT *, sum(CASE WHEN value = prev THEN 0 ELSE 1 END) OVER (PARTITION BY cube_id, pixel_id ORDER BY obs_date) AS run
      FROM (SELECT *, lag(value) OVER (PARTITION BY cube_id, pixel_id ORDER BY obs_date) AS prev FROM v)),
n AS (SELECT *, count(*) OVER (PARTITION BY cube_id, pixel_id, run) AS len FROM c),
f AS (SELECT obs_id, (CASE WHEN value < vmin OR value > vmax THEN 1 ELSE 0 END + CASE WHEN len >= 6 THEN 2 ELSE 0 END)::INTEGER AS fault FROM n)
SELECT obs_id, fault FROM f WHERE fault > 0
"""
)

P3_SQL = (
    "WITH "
    + META_SQL
    + """
SELECT obs_id FROM s LEFT JOIN m ON s.cube_id = m.cube_id
WHERE value IS NULL OR CASE WHEN product LIKE 'VNP%' THEN value IN (-15000, -13000) ELSE coalesce(value = nodata, FALSE) END
"""
)

P4_SQL = r"""
WITH g AS (SELECT *, coalesce(strftime(raw_date, '%Y%j'), nullif(regexp_extract(filename, '\.A(\d{7})\.', 1), '')) AS label FROM granules),
cur AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY cube_id, label ORDER BY proc_ts DESC, granule_id DESC) = 1),
r AS (SELECT * FROM run_log WHERE lower(trim(status)) = 'ok' QUALIFY row_number() OVER (PARTITION BY cube_id ORDER BY processed_at DESC, run_id DESC) = 1),
u AS (SELECT DISTINCT cube_id, processed_at, trim(x) AS label FROM (SELECT cube_id, processed_at, unnest(rawdates) AS x FROM r) WHERE trim(x) <> ''),
used AS (SELECT g.* FROM g JOIN u ON g.cube_id = u.cube_id AND g.label = u.label AND g.collected_at <= u.processed_at
         QUALIFY row_number() OVER (PARTITION BY g.cube_id, g.label ORDER BY proc_ts DESC, granule_id DESC) = 1)
SELECT cur.cube_id, cur.label FROM cur LEFT JOIN used ON cur.cube_id = used.cube_id AND cur.label = used.label
WHERE used.granule_id IS NULL OR used.cksum IS DISTINCT FROM cur.cksum
"""

P4_CHANGES_SQL = (
    P4_SQL.replace("SELECT cur.cube_id, cur.label FROM", "SELECT cur.cube_id, cur.label, CASE WHEN used.granule_id IS NULL THEN 'added' ELSE 'replaced' END AS change, cur.granule_id FROM")
    + """UNION ALL
SELECT cube_id, label, 'removed', NULL FROM u WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.cube_id = u.cube_id AND g.label = u.label)
"""
)

P5_SQL = """
WITH r AS (SELECT file_id, cube_id, rtrim(label) AS label, written_at, first_pixel + unnest(range(len(vals))) AS pixel FROM chunk_files WHERE len(vals) > 0),
k AS (SELECT file_id FROM r QUALIFY row_number() OVER (PARTITION BY cube_id, label, pixel ORDER BY written_at DESC NULLS LAST, file_id DESC) = 1)
SELECT file_id FROM chunk_files WHERE file_id NOT IN (SELECT file_id FROM k)
"""


P5_RECORDS_SQL = """
WITH r AS (SELECT file_id, cube_id, rtrim(label) AS label, written_at, first_pixel + unnest(range(len(vals))) AS pixel, unnest(vals) AS value FROM chunk_files WHERE len(vals) > 0)
SELECT cube_id, label, pixel, value FROM r QUALIFY row_number() OVER (PARTITION BY cube_id, label, pixel ORDER BY written_at DESC NULLS LAST, file_id DESC) = 1
"""


P5_LIVE_SQL = """
WITH r AS (SELECT file_id, cube_id, rtrim(label) AS label, written_at, first_pixel + unnest(range(len(vals))) AS pixel, unnest(vals) AS value FROM chunk_files WHERE len(vals) > 0),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY cube_id, label, pixel ORDER BY written_at DESC NULLS LAST, file_id DESC) = 1)
"""
P5_COMPACTED_SQL = (
    P5_LIVE_SQL
    + """, i AS (SELECT *, pixel - row_number() OVER (PARTITION BY file_id ORDER BY pixel) AS island FROM k)
SELECT cube_id, label, min(pixel) AS first_pixel, list(value ORDER BY pixel) AS vals FROM i GROUP BY cube_id, label, file_id, island
"""
)
P5_PLAN_SQL = (
    P5_LIVE_SQL
    + """, n AS (SELECT cube_id, label, count(*) AS records FROM k GROUP BY 1, 2),
o AS (SELECT cube_id, label, (coalesce(sum(records) OVER (PARTITION BY cube_id ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4000000)::BIGINT AS out_no FROM n)
SELECT cube_id, out_no, count(DISTINCT file_id) AS n_files, count(*) AS n_records FROM k JOIN o USING (cube_id, label) GROUP BY 1, 2
"""
)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_grid, p1_counts, p2_found, p2_flags, p2_exact, p3_found, p3_filled, p3_attributes, p4_found, p4_changes, p5_found, p5_compacted, p5_plan, p5_records)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p1_counts": P1_COUNTS_SQL, "p2_exact": P2_SQL, "p3_found": P3_SQL, "p4_found": P4_SQL, "p4_changes": P4_CHANGES_SQL, "p5_found": P5_SQL, "p5_records": P5_RECORDS_SQL, "p5_compacted": P5_COMPACTED_SQL, "p5_plan": P5_PLAN_SQL}
