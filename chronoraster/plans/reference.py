"""Queries of the raster operators over the test tables, each with its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoraster.functions import axis as A
from chronoraster.functions.catalyst import ws2d_expr
from chronoraster.functions.session import table, written
from chronoraster.functions.whittaker import AUTO_RANGES
from chronoraster.operators import cube, granules, raster, smooth
from chronoraster.operators.standing import complete_meta, standing
from chronoraster.plans import pipelines
from chronoraster.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- fixtures: E, daily means per user; L, 16-day means per supplier

E_AXIS = [date(2024, 1, 1) + timedelta(i) for i in range(30)]

E_SQL = """
e AS (SELECT user_id AS k, CAST(ts AS DATE) AS day,
             (sum(CAST(round(value * 100) AS BIGINT))::BIGINT)::DOUBLE / count(*)::DOUBLE / 100::DOUBLE AS v
      FROM events {where} GROUP BY 1, 2),
cal AS (SELECT i, DATE '2024-01-01' + i::INTEGER AS day FROM range(30) t(i)),
g AS (SELECT ks.k, cal.i, cal.day, coalesce(e.v, 0::DOUBLE) AS y, CASE WHEN e.v IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END AS w
      FROM (SELECT DISTINCT k FROM e) ks CROSS JOIN cal LEFT JOIN e ON e.k = ks.k AND e.day = cal.day)
"""
E_ALL = E_SQL.format(where="")

L_SQL = """
c AS (SELECT l_suppkey AS k, make_date(year(l_shipdate), 1, 1) + ((((dayofyear(l_shipdate) - 1) // 16) * 16)::INTEGER) AS day, l_quantity AS q FROM lineitem),
e AS (SELECT k, day, (sum(CAST(round(q) AS BIGINT))::BIGINT)::DOUBLE / count(*)::DOUBLE AS v FROM c GROUP BY 1, 2),
ends AS (SELECT min(day) AS lo, max(day) AS hi FROM e),
cal AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, day
        FROM (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM ends) WHERE (dayofyear(day) - 1) % 16 = 0),
g AS (SELECT ks.k, cal.i, cal.day, coalesce(e.v, 0::DOUBLE) AS y, CASE WHEN e.v IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END AS w
      FROM (SELECT DISTINCT k FROM e) ks CROSS JOIN cal LEFT JOIN e ON e.k = ks.k AND e.day = cal.day)
"""


def e_long(spark: SparkSession, d: str, event_type: str | None = None) -> DataFrame:
    ev = table(spark, d, "events")
    if event_type:
        ev = ev.where(F.col("event_type") == event_type)
    cents = F.round(F.col("value") * 100).cast("bigint")
    return ev.groupBy("user_id", F.to_date("ts").alias("day")).agg((F.sum(cents).cast("double") / F.count("*") / 100).alias("v"))


def e_series(spark: SparkSession, d: str, event_type: str | None = None) -> DataFrame:
    return cube.to_series(e_long(spark, d, event_type), ["user_id"], "day", "v", E_AXIS, unique=True)


def l_long(spark: SparkSession, d: str) -> DataFrame:
    ship = F.col("l_shipdate").cast("date")
    day = F.date_add(F.trunc(ship, "year"), (F.floor((F.dayofyear(ship) - 1) / 16) * 16).cast("int"))
    li = table(spark, d, "lineitem").select("l_suppkey", day.alias("day"), F.round("l_quantity").cast("bigint").alias("q"))
    return li.groupBy("l_suppkey", "day").agg((F.sum("q").cast("double") / F.count("*")).alias("v"))


def l_axis(spark: SparkSession, d: str) -> list[date]:
    ship = F.col("l_shipdate").cast("date")
    lo, hi = table(spark, d, "lineitem").agg(F.min(ship), F.max(ship)).first()
    first = date(lo.year, 1, 1) + timedelta((lo.timetuple().tm_yday - 1) // 16 * 16)
    return [x for i in range((hi - first).days + 1) if ((x := first + timedelta(i)).timetuple().tm_yday - 1) % 16 == 0]


def l_series(spark: SparkSession, d: str) -> tuple[DataFrame, list[date]]:
    dates = l_axis(spark, d)
    return cube.to_series(l_long(spark, d), ["l_suppkey"], "day", "v", dates, unique=True), dates


def solver(name: str, src: str, n: str) -> str:
    """SQL of one solve for all (k, l) of ``src`` (k, l, lam, i, y, w): a relation ``name`` (k, l, i, x). n: steps, as SQL."""
    return f"""
{name}_a AS (SELECT *, CASE WHEN i IN (0, {n} - 1) THEN 1::DOUBLE WHEN i IN (1, {n} - 2) THEN 5::DOUBLE ELSE 6::DOUBLE END AS a,
             CASE WHEN i IN (0, {n} - 2) THEN -2::DOUBLE WHEN i = {n} - 1 THEN 0::DOUBLE ELSE -4::DOUBLE END AS b FROM {src}),
{name}_f AS (SELECT k, l, i, w + a * lam AS d, b * lam / (w + a * lam) AS c, lam / (w + a * lam) AS e, w * y AS z, 0::DOUBLE AS d1, 0::DOUBLE AS e1, 0::DOUBLE AS z1 FROM {name}_a WHERE i = 0
  UNION ALL SELECT k, l, i, nd, (b * lam - d * c * e) / nd, CASE WHEN i < {n} - 2 THEN lam / nd ELSE 0::DOUBLE END, w * y - c * z - e1 * z1, d, e, z
  FROM (SELECT s.k, s.l, s.i, s.lam, s.w, s.y, s.b, f.d, f.c, f.e, f.z, f.d1, f.e1, f.z1, s.w + s.a * s.lam - f.c * f.c * f.d - f.e1 * f.e1 * f.d1 AS nd
        FROM {name}_f f JOIN {name}_a s ON s.k = f.k AND s.l = f.l AND s.i = f.i + 1)),
{name} AS (SELECT k, l, i, z / d AS x, 0::DOUBLE AS x1 FROM {name}_f WHERE i = {n} - 1
  UNION ALL SELECT f.k, f.l, f.i, f.z / f.d - f.c * q.x - f.e * q.x1, q.x FROM {name} q JOIN {name}_f f ON f.k = q.k AND f.l = q.l AND f.i = q.i - 1)
"""


def asymmetric(name: str, src: str, n: str, p: float, start: str | None = None) -> str:
    """Ten reweighted solves; start: a relation (k, l, i, x) or None for zeros."""
    parts, prev = [], start
    for r in range(1, 11):
        x = "q.x" if prev else "0::DOUBLE"
        join = f"JOIN {prev} q ON q.k = s.k AND q.l = s.l AND q.i = s.i" if prev else ""
        parts.append(f"{name}_w{r} AS (SELECT s.k, s.l, s.lam, s.i, s.y, s.w * CASE WHEN s.y > {x} THEN {p}::DOUBLE ELSE 1::DOUBLE - {p}::DOUBLE END AS w FROM {src} s {join})")
        parts.append(solver(f"{name}_{r}", f"{name}_w{r}", n))
        prev = f"{name}_{r}"
    return ",".join(parts) + f", {name} AS (SELECT k, l, i, x FROM {name}_10)"


def with_sql(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts[:-1]) + " " + parts[-1]


def e_out(s: DataFrame) -> DataFrame:
    long = cube.to_long(s, ["user_id"], E_AXIS, "z")
    return long.select("user_id", "obs_date", F.round("z", 6).alias("z"))


E_OUT = "SELECT r.k AS user_id, cal.day AS obs_date, round(r.x, 6) AS z FROM {r} r JOIN cal ON cal.i = r.i"
ONE = "s AS (SELECT k, 0 AS l, {lam}::DOUBLE AS lam, i, y, w FROM g)"


# ---- granules

PARSED_SQL = r"""
p AS (SELECT path, split_part(path, '/', -1) AS filename FROM granules),
n AS (SELECT path, filename, nullif(regexp_extract(filename, '^(?:VNP|M[OYX]D)\d{2}\w\d', 0), '') AS product, nullif(regexp_extract(filename, 'h\d+v\d+', 0), '') AS tile,
        nullif(regexp_extract(filename, '.+\.(\d{3})\..+', 1), '') AS version, nullif(regexp_extract(filename, '.+A(\d{7}).+', 1), '') AS julian,
        CAST(nullif(regexp_extract(filename, '.+(\d{13}).+', 1), '') AS BIGINT) AS proc_ts FROM p),
pg AS (SELECT path, filename, product, CASE WHEN product LIKE 'MOD%' THEN 'Terra' WHEN product LIKE 'MYD%' THEN 'Aqua' WHEN product LIKE 'VNP%' THEN 'SNPP' END AS satellite,
        tile, version, CAST(strptime(julian, '%Y%j') AS DATE) AS raw_date, julian, proc_ts, tile IS NULL AS is_global FROM n)
"""


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return granules.parse_names(table(spark, d, "granules"))


@query(with_sql(PARSED_SQL, "SELECT * FROM pg"))
def granule_parse(spark, d):
    return parsed(spark, d)


@query(
    with_sql(
        PARSED_SQL,
        r"""q AS (SELECT DISTINCT product FROM pg UNION SELECT unnest(['MOD14A1', 'MOD35L2', 'MXD13C1']))""",
        r"""SELECT product, regexp_matches(product, '^(?:VNP13|M[OYX]D13|M[YO]D11).+') AS supported,
        CASE WHEN regexp_matches(product, '^(?:VNP|M[OYX]D)13.+') THEN 'VIM' WHEN regexp_matches(product, '^M[YO]D11.+') THEN 'LTD' END AS code,
        CASE WHEN regexp_matches(product, '^(?:VNP|M[OYX]D)13.+') THEN 'VEM' END AS vem FROM q""",
    )
)
def product_gate(spark, d):
    p = parsed(spark, d).select("product").union(spark.createDataFrame([("MOD14A1",), ("MOD35L2",), ("MXD13C1",)], "product string")).distinct()
    c = F.col("product")
    return p.select("product", granules.supported(c).alias("supported"), granules.vam_code(c).alias("code"), granules.vam_code(c, "VEM").alias("vem"))


@query(
    with_sql(
        PARSED_SQL,
        """k AS (SELECT DISTINCT product, tile, version, code FROM pg, (SELECT unnest(['VIM', 'VEM', 'LTD', 'LTN']) AS code)
        WHERE (product LIKE '___11%') = (code LIKE 'L%')),
        nm AS (SELECT *, CASE WHEN code = 'LTD' AND product LIKE 'MOD%' THEN 'TDT' WHEN code = 'LTD' AND product LIKE 'MYD%' THEN 'TDA'
               WHEN code = 'LTN' AND product LIKE 'MOD%' THEN 'TNT' WHEN code = 'LTN' AND product LIKE 'MYD%' THEN 'TNA' ELSE code END AS nm FROM k)""",
        """SELECT nm || '/' || concat_ws('.', product, tile, version, nm) AS cube_id, nm || '/' || concat_ws('.', product, tile, version, 'txd', nm) AS smooth_id FROM nm""",
    )
)
def cube_naming(spark, d):
    codes = spark.createDataFrame([("VIM",), ("VEM",), ("LTD",), ("LTN",)], "code string")
    k = parsed(spark, d).select("product", "tile", "version").distinct().crossJoin(F.broadcast(codes))
    k = k.where(F.col("product").rlike("^...11") == F.col("code").startswith("L"))
    name = granules.cube_name(F.col("code"), F.col("product"), F.col("tile"), F.col("version"))
    return k.select(name.alias("cube_id"), granules.smooth_name(name, 10).alias("smooth_id"))


@query(
    with_sql(PARSED_SQL, "SELECT product, tile, version, raw_date, proc_ts, path FROM pg QUALIFY row_number() OVER (PARTITION BY product, tile, version, raw_date ORDER BY proc_ts DESC, path DESC) = 1")
)
def granule_latest(spark, d):
    g = parsed(spark, d).select("product", "tile", "version", "raw_date", "proc_ts", "path")
    return granules.latest_versions(g, "product", "tile", "version", "raw_date")


@query(
    with_sql(
        PARSED_SQL,
        """b AS (SELECT product, tile, version, raw_date, proc_ts, count(*) AS n_files FROM pg GROUP BY ALL)""",
        """SELECT * FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY product, tile, version, raw_date ORDER BY proc_ts DESC) = 1) WHERE n_files > 1""",
    )
)
def granule_ties(spark, d):
    return granules.equal_versions(parsed(spark, d), "product", "tile", "version", "raw_date")


@query(
    with_sql(
        PARSED_SQL,
        """r AS (SELECT * REPLACE (CASE WHEN product LIKE 'MOD13%' OR product LIKE 'MYD13%' THEN 'MXD' || substr(product, 4) ELSE product END AS product) FROM pg)""",
        """SELECT path, product, tile, version, raw_date, CASE WHEN product LIKE '___11%' THEN 4 ELSE 8 END::INTEGER AS tshift, 8::INTEGER AS temporalresolution FROM r
        WHERE CASE WHEN product LIKE 'MXD13%' THEN raw_date >= DATE '2002-07-04' WHEN product LIKE 'VNP13%' THEN raw_date >= DATE '2012-01-17' ELSE TRUE END""",
    )
)
def interleave(spark, d):
    return granules.interleave(parsed(spark, d)).select("path", "product", "tile", "version", "raw_date", "tshift", "temporalresolution")


@query(
    with_sql(
        PARSED_SQL,
        """SELECT regexp_replace(product, '^M[OY]D13', 'M?D13') AS product_group, tile, version, count(*) AS n_files, count(DISTINCT raw_date) AS n_dates,
        min(raw_date) AS first_date, max(raw_date) AS last_date FROM pg GROUP BY 1, 2, 3""",
    )
)
def file_groups(spark, d):
    return granules.file_groups(parsed(spark, d))


REQUIRED = ["h08v11", "h05v02"]


@query(
    with_sql(
        PARSED_SQL,
        """need AS (SELECT unnest(['h08v11', 'h05v02']) AS tile), pr AS (SELECT DISTINCT product FROM pg),
        miss AS (SELECT product, count(*) AS missing FROM (SELECT product, tile FROM pr, need EXCEPT SELECT product, tile FROM pg) GROUP BY 1),
        ax AS (SELECT product, tile, list(DISTINCT raw_date ORDER BY raw_date) AS dates FROM pg WHERE tile IN (SELECT tile FROM need) GROUP BY 1, 2),
        axes AS (SELECT product, count(DISTINCT dates) AS axes FROM ax GROUP BY 1)""",
        """SELECT pr.product, coalesce(missing, 0)::BIGINT AS missing, coalesce(axes, 0)::BIGINT AS axes FROM pr LEFT JOIN miss USING (product) LEFT JOIN axes USING (product)""",
    )
)
def required_tiles(spark, d):
    return granules.required_tiles(parsed(spark, d), REQUIRED)


@query(
    with_sql(
        PARSED_SQL,
        """SELECT path, tile, raw_date AS time_start FROM pg WHERE (tile IS NULL OR tile IN ('h08v11', 'h05v02')) AND raw_date BETWEEN DATE '2007-01-01' AND DATE '2014-12-31'""",
    )
)
def search_filter(spark, d):
    r = parsed(spark, d).select("path", "tile", F.col("raw_date").alias("time_start"))
    return granules.search_filter(r, REQUIRED, date(2007, 1, 1), date(2014, 12, 31))


@query("SELECT DISTINCT unnest(CASE WHEN p LIKE '%?%' THEN [replace(p, '?', 'O'), replace(p, '?', 'Y')] ELSE [p] END) AS product FROM (SELECT upper(trim(unnest(['m?d13a2', ' VNP13A2', 'MOD13A2']))) AS p)")
def product_wildcard(spark, d):
    return granules.expand_products(spark.createDataFrame([("m?d13a2",), (" VNP13A2",), ("MOD13A2",)], "product string"))


@query("SELECT DISTINCT path FROM granules WHERE filename NOT IN (SELECT filename FROM granules WHERE collected_at < TIMESTAMP '2013-01-01')")
def retry_difference(spark, d):
    g = table(spark, d, "granules")
    return granules.not_downloaded(g.select("path", "filename"), g.where("collected_at < timestamp '2013-01-01'")).select("path").distinct()


@query(with_sql(PARSED_SQL, "SELECT product, tile, version, arg_min(path, filename || ' ' || path) AS path FROM pg GROUP BY 1, 2, 3"))
def reference_file(spark, d):
    return granules.first_reference(parsed(spark, d), "product", "tile", "version")


@query(
    """SELECT regexp_replace(cube_id, '\\.([^.]+)$', '.txd.\\1') AS cube_id, rows, cols, nodata, 10::INTEGER AS temporalresolution, tshift, vmin, vmax FROM cube_meta"""
)
def smooth_attributes(spark, d):
    return pipelines.smooth_meta(table(spark, d, "cube_meta"), 10).select("cube_id", "rows", "cols", "nodata", "temporalresolution", "tshift", "vmin", "vmax")


# ---- axes

YEARS_SQL = "dd AS (SELECT unnest(generate_series(DATE '2003-01-01', DATE '2004-12-31', INTERVAL 1 DAY))::DATE AS day)"


def two_years(spark):
    return A.days(spark, date(2003, 1, 1), date(2004, 12, 31))


@query(with_sql(YEARS_SQL, "SELECT day, strftime(day, '%Y%j') AS label FROM dd WHERE (dayofyear(day) - 1) % 8 = 0"))
def axis_step(spark, d):
    return two_years(spark).where(A.on_step(F.col("day"), 8)).select("day", A.to_julian(F.col("day")).alias("label"))


@query(with_sql(YEARS_SQL, "SELECT day, strftime(day, '%Y%j') AS label FROM dd WHERE day(day) IN (3, 8, 13, 18, 23, 28)"))
def axis_pentad(spark, d):
    return two_years(spark).where(A.on_pentad(F.col("day"))).select("day", A.to_julian(F.col("day")).alias("label"))


@query(with_sql(YEARS_SQL, "SELECT day, strftime(day, '%Y%j') AS label FROM dd WHERE day(day) IN (5, 15, 25)"))
def axis_dekad(spark, d):
    return two_years(spark).where(A.on_dekad(F.col("day"))).select("day", A.to_julian(F.col("day")).alias("label"))


@query(
    with_sql(
        L_SQL,
        """dl AS (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP + INTERVAL 16 DAY, INTERVAL 1 DAY))::DATE AS day FROM ends)""",
        "SELECT day FROM dl, ends WHERE day(day) IN (5, 15, 25) AND year(day) <= year(hi)",
    )
)
def target_axis(spark, d):
    return A.target_axis(l_long(spark, d).select("day").distinct(), "day", 16, 10)


@query(
    with_sql(
        YEARS_SQL,
        """SELECT day, CASE day(day) WHEN 5 THEN strftime(day, '%Y%m') || 'd1' WHEN 15 THEN strftime(day, '%Y%m') || 'd2' WHEN 25 THEN strftime(day, '%Y%m') || 'd3' ELSE strftime(day, '%Yj%j') END AS dekad,
        CASE WHEN day(day) IN (3, 8, 13, 18, 23, 28) THEN strftime(day, '%Y%m') || 'p' || ((day(day) + 2) // 5)::VARCHAR ELSE strftime(day, '%Yj%j') END AS pentad,
        'vim' || strftime(day, '%Yj%j') AS doy FROM dd""",
    )
)
def date_labels(spark, d):
    c = F.col("day")
    return two_years(spark).select("day", A.date_label(c, 10).alias("dekad"), A.date_label(c, 5).alias("pentad"), A.date_label(c, 8, "vim").alias("doy"))


@query(
    with_sql(
        L_SQL,
        """ax AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM e)), up AS (SELECT * FROM ax WHERE day >= DATE '1999-01-01')""",
        "SELECT max(i) - min(i) + 1 = count(*) AS contiguous FROM up",
    )
)
def contiguity(spark, d):
    days = l_long(spark, d).select(F.col("day").alias("obs_date")).distinct()
    return cube.contiguous(days, days.where(F.col("obs_date") >= F.lit(date(1999, 1, 1))))


@query(
    with_sql(
        L_SQL,
        """SELECT ks.k AS l_suppkey, cal.day FROM (SELECT DISTINCT k FROM e) ks CROSS JOIN (SELECT day FROM cal WHERE day BETWEEN DATE '1997-01-01' AND DATE '1999-12-31') cal
        WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.k = ks.k AND e.day = cal.day)""",
    )
)
def missing_dates(spark, d):
    return cube.missing_dates(l_long(spark, d), ["l_suppkey"], "day", date(1997, 1, 1), date(1999, 12, 31), 16)


# ---- cubes


@query(with_sql(E_ALL, "SELECT k AS user_id, day, CASE WHEN day >= DATE '2024-01-20' THEN round(v, 6) + 1 ELSE round(v, 6) END AS v FROM e"))
def cube_upsert(spark, d):
    e = e_long(spark, d).withColumn("v", F.round("v", 6))
    new = e.where(F.col("day") >= F.lit(date(2024, 1, 20))).withColumn("v", F.col("v") + 1)
    return cube.upsert(e.where(F.col("day") < F.lit(date(2024, 1, 25))), new, "day", ("user_id",))


@query(
    """WITH i AS (SELECT cube_id, min(obs_date) AS first_date, max(obs_date) AS last_date, count(DISTINCT obs_date) AS n_dates, count(*) AS n_rows FROM raw GROUP BY 1),
    r AS (SELECT cube_id, lastrun FROM run_log QUALIFY row_number() OVER (PARTITION BY cube_id ORDER BY processed_at DESC, run_id DESC) = 1)
    SELECT m.cube_id, rows, cols, nodata, temporalresolution, strftime(first_date, '%Y%j') AS first_date, strftime(last_date, '%Y%j') AS last_date, n_dates, n_rows, lastrun FROM cube_meta m LEFT JOIN i USING (cube_id) LEFT JOIN r USING (cube_id)"""
)
def cube_info(spark, d):
    info = cube.cube_info(table(spark, d, "raw"), table(spark, d, "cube_meta"), table(spark, d, "run_log"))
    return info.withColumns({c: A.to_julian(F.col(c)) for c in ("first_date", "last_date")})


@query(with_sql(E_SQL.format(where="WHERE event_type = 'purchase'"), "SELECT k AS user_id, sum(w)::BIGINT AS valid, sum(w) >= 6 AS enough FROM g GROUP BY 1"))
def coverage(spark, d):
    n = smooth.coverage(F.col("w"))
    return e_series(spark, d, "purchase").select("user_id", n.alias("valid"), (n >= smooth.COVERAGE * len(E_AXIS)).alias("enough"))


LAG_SQL = """
pr AS (SELECT k, y AS a, lead(y) OVER o AS b, w * lead(w) OVER o AS ok FROM g WINDOW o AS (PARTITION BY k ORDER BY i)),
mo AS (SELECT k, count(*)::DOUBLE AS n, sum(a) AS sa, sum(b) AS sb FROM pr WHERE ok > 0 GROUP BY 1),
mv AS (SELECT pr.k, any_value(n) AS n, any_value(sa / n) AS ma, any_value(sb / n) AS mb, sum((a - sa / n) * (a - sa / n)) AS va, sum((b - sb / n) * (b - sb / n)) AS vb, sum(a * b) AS ab FROM pr JOIN mo ON mo.k = pr.k WHERE ok > 0 GROUP BY 1),
lc AS (SELECT ks.k, (ab / n - ma * mb) / nullif(sqrt(va / n) * sqrt(vb / n), 0::DOUBLE) AS corr FROM (SELECT DISTINCT k FROM g) ks LEFT JOIN mv ON mv.k = ks.k)
"""


@query(with_sql(E_ALL, LAG_SQL, "SELECT k AS user_id, round(corr, 6) AS corr FROM lc"))
def lag1_corr(spark, d):
    return e_series(spark, d).select("user_id", F.round(smooth.lag1corr_expr(F.col("y"), F.col("w")), 6).alias("corr"))


@query(with_sql(E_ALL, LAG_SQL, "SELECT k AS user_id, CASE WHEN corr IS NULL THEN '-1..1' WHEN corr > 0.5 THEN '-2..1' ELSE '0..3' END AS srange FROM lc"))
def srange_choice(spark, d):
    return e_series(spark, d).select("user_id", smooth.range_choice(smooth.lag1corr_expr(F.col("y"), F.col("w"))).alias("srange"))


# ---- smoothing


@query(with_sql(E_ALL, ONE.format(lam=10), solver("r", "s", "30"), E_OUT.format(r="r")))
def ws2d_fixed(spark, d):
    return e_out(smooth.smooth(e_series(spark, d), ["user_id"], svalue=1.0))


@query(with_sql(E_ALL, ONE.format(lam=10), solver("r", "s", "30"), E_OUT.format(r="r")))
def ws2d_catalyst(spark, d):
    return e_out(e_series(spark, d).select("user_id", ws2d_expr(F.col("y"), F.col("w"), F.lit(10.0), len(E_AXIS)).alias("z")))


@query(
    with_sql(L_SQL, ONE.format(lam=10), "m AS (SELECT count(*) AS n FROM cal)", solver("r", "s", "(SELECT n FROM m)"), "SELECT r.k AS l_suppkey, cal.day AS obs_date, round(r.x, 6) AS z FROM r JOIN cal ON cal.i = r.i")
)
def ws2d_long(spark, d):
    s, dates = l_series(spark, d)
    return cube.to_long(smooth.smooth(s, ["l_suppkey"], svalue=1.0), ["l_suppkey"], dates, "z").select("l_suppkey", "obs_date", F.round("z", 6).alias("z"))


@query(with_sql(E_ALL, ONE.format(lam=10), asymmetric("r", "s", "30", 0.9), E_OUT.format(r="r")))
def ws2dp(spark, d):
    return e_out(smooth.smooth(e_series(spark, d), ["user_id"], svalue=1.0, p=0.9))


def _lambdas(values) -> str:
    return f"lam AS (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in values)}]) AS s, unnest(range({len(values)})) AS l), s AS (SELECT k, l, pow(10::DOUBLE, s) AS lam, i, y, w FROM g, lam)"


POINTS = """
d2 AS (SELECT k, l, i, x, x - 2::DOUBLE * lag(x, 1) OVER o + lag(x, 2) OVER o AS dd FROM {r} WINDOW o AS (PARTITION BY k, l ORDER BY i)),
pt AS (SELECT d2.k, d2.l, ln(nullif(sum(pow(s.w * (s.y - d2.x), 2)), 0::DOUBLE)) AS fit, ln(nullif(sum(dd * dd), 0::DOUBLE)) AS rough FROM d2 JOIN s ON s.k = d2.k AND s.l = d2.l AND s.i = d2.i GROUP BY 1, 2)
"""
BEST = """
vv AS (SELECT k, l, sqrt(pow(lead(fit) OVER o - fit, 2) + pow(lead(rough) OVER o - rough, 2)) AS v, (lam.s + lead(lam.s) OVER o) / 2 AS mid FROM pt JOIN lam USING (l) WINDOW o AS (PARTITION BY k ORDER BY l)),
op AS (SELECT k, mid FROM vv WHERE mid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY v, l) = 1),
s2 AS (SELECT g.k, 0 AS l, pow(10::DOUBLE, mid) AS lam, i, y, w FROM g JOIN op USING (k))
"""
FULL = [float(x) for x in AUTO_RANGES[0]]


@query(with_sql(E_ALL, _lambdas(FULL), solver("r", "s", "30"), POINTS.format(r="r"), "SELECT pt.k AS user_id, lam.s AS log10_s, round(fit, 6) AS fit, round(rough, 6) AS rough FROM pt JOIN lam USING (l)"))
def vcurve_points(spark, d):
    p = smooth.vcurve_points(e_series(spark, d), ["user_id"], FULL)
    return p.select("user_id", "log10_s", F.round("fit", 6).alias("fit"), F.round("rough", 6).alias("rough"))


@query(
    with_sql(
        E_ALL, _lambdas(FULL), solver("r", "s", "30"), POINTS.format(r="r"), BEST, solver("f", "s2", "30"),
        "SELECT f.k AS user_id, cal.day AS obs_date, round(f.x, 6) AS z, round(mid, 6) AS log10_s FROM f JOIN cal ON cal.i = f.i JOIN op ON op.k = f.k",
    )
)
def vcurve_opt(spark, d):
    s = smooth.smooth(e_series(spark, d), ["user_id"], optimise=True, srange=FULL)
    return cube.to_long(s, ["user_id", "log10_s"], E_AXIS, "z").select("user_id", "obs_date", F.round("z", 6).alias("z"), F.round("log10_s", 6).alias("log10_s"))


RANGE = AUTO_RANGES[1].tolist()  # 16 penalties, 0 to 3


def _warm() -> str:
    """Asymmetric solves penalty by penalty, each from the curve of the one before."""
    parts, prev = [], None
    for i, x in enumerate(RANGE):
        parts.append(f"s_{i} AS (SELECT k, 0 AS l, pow(10::DOUBLE, {x}::DOUBLE) AS lam, i, y, w FROM g)")
        parts.append(asymmetric(f"z{i}", f"s_{i}", "30", 0.9, prev))
        prev = f"z{i}"
    parts.append("za AS (" + " UNION ALL ".join(f"SELECT k, {i} AS l, i, x FROM z{i}" for i in range(len(RANGE))) + ")")
    return ",".join(parts)


@query(
    with_sql(
        E_ALL, _lambdas(RANGE), _warm(), POINTS.format(r="za"), BEST, asymmetric("f", "s2", "30", 0.9),
        "SELECT f.k AS user_id, cal.day AS obs_date, round(f.x, 6) AS z, round(mid, 6) AS log10_s FROM f JOIN cal ON cal.i = f.i JOIN op ON op.k = f.k",
    )
)
def ws2doptvp(spark, d):
    s = smooth.smooth(e_series(spark, d), ["user_id"], optimise=True, srange=RANGE, p=0.9)
    return cube.to_long(s, ["user_id", "log10_s"], E_AXIS, "z").select("user_id", "obs_date", F.round("z", 6).alias("z"), F.round("log10_s", 6).alias("log10_s"))


@query(None)
def ws2doptvp_auto(spark, d):
    """Asymmetric V-curve over the automatic ranges."""
    return smooth.smooth(e_series(spark, d), ["user_id"], optimise=True, p=0.9).select("user_id", "log10_s", "z")


@query(
    with_sql(
        E_ALL, "s AS (SELECT k, 0 AS l, pow(10::DOUBLE, CASE WHEN k % 7 = 0 THEN 0::DOUBLE ELSE (k % 5)::DOUBLE / 2 END) AS lam, i, y, w FROM g)", solver("r", "s", "30"), E_OUT.format(r="r")
    )
)
def sgrid_apply(spark, d):
    s = e_series(spark, d)
    sgrid = s.select("user_id", F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 5).cast("double") / 2).cast("float").alias("log10_s"))
    return e_out(smooth.smooth(s.join(sgrid, "user_id", "left"), ["user_id"], grid="log10_s"))


@query(
    with_sql(
        L_SQL, ONE.format(lam=10), "m AS (SELECT count(*) AS n FROM cal)", solver("r", "s", "(SELECT n FROM m)"),
        """dl AS (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP + INTERVAL 16 DAY, INTERVAL 1 DAY))::DATE AS day FROM ends),
        di AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, day FROM dl), md AS (SELECT count(*) AS n FROM di),
        s2 AS (SELECT ks.k, 0 AS l, 1e-4::DOUBLE AS lam, di.i, coalesce(q.x, 0::DOUBLE) AS y, CASE WHEN q.x IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END AS w
               FROM (SELECT DISTINCT k FROM g) ks CROSS JOIN di LEFT JOIN (SELECT r.k, cal.day + 8 AS day, r.x FROM r JOIN cal ON cal.i = r.i) q ON q.k = ks.k AND q.day = di.day)""",
        solver("f", "s2", "(SELECT n FROM md)"),
        "SELECT f.k AS l_suppkey, di.day AS target_date, round(f.x, 4) AS z FROM f JOIN di ON di.i = f.i, ends WHERE day(di.day) IN (5, 15, 25) AND year(di.day) <= year(hi)",
    )
)
def tinterp_dekad(spark, d):
    s, dates = l_series(spark, d)
    z = smooth.smooth(s, ["l_suppkey"], svalue=1.0, raw_dates=dates, raw_step=16, step=10, shift=8)
    _, target = A.target_days(dates, 16, 10)
    return cube.to_long(z, ["l_suppkey"], target, "z", date_name="target_date").select("l_suppkey", "target_date", F.round("z", 4).alias("z"))


@query(
    with_sql(
        L_SQL, "t AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT day FROM cal ORDER BY day DESC LIMIT 36))",
        "s AS (SELECT g.k, 0 AS l, 10::DOUBLE AS lam, t.i, g.y, g.w FROM g JOIN t ON t.day = g.day WHERE g.k IN (SELECT k FROM e JOIN t USING (day)))", solver("r", "s", "36"),
        "SELECT r.k AS l_suppkey, t.day AS obs_date, round(r.x, 6) AS z FROM r JOIN t ON t.i = r.i WHERE r.i >= 30",
    )
)
def tail_update(spark, d):
    dates = l_axis(spark, d)[-36:]
    s = cube.to_series(cube.tail(l_long(spark, d).join(F.broadcast(spark.createDataFrame([(x,) for x in dates], "day date")), "day", "left_semi"), "day", 0), ["l_suppkey"], "day", "v", dates, unique=True)
    z = smooth.smooth(s, ["l_suppkey"], svalue=1.0, nupdate=6)
    return cube.to_long(z, ["l_suppkey"], dates[-6:], "z").select("l_suppkey", "obs_date", F.round("z", 6).alias("z"))


@query(None)
def smooth_raw(spark, d):
    """All raw cubes at once: readings on each cube's regular axis, V-curve smoothing of each pixel, values at dekads."""
    raw, meta = table(spark, d, "raw"), table(spark, d, "cube_meta")
    return pipelines.smooth_cubes(written(pipelines.composites(raw, meta), "composites"), meta, optimise=True, step=10, is_standing=True, regular=True)


@query(None)
def smooth_tail(spark, d):
    """The last 36 periods of each raw cube in, the last 6 out, fixed penalty and envelope."""
    raw, meta = table(spark, d, "raw"), table(spark, d, "cube_meta")
    return pipelines.smooth_cubes(written(pipelines.composites(raw, meta), "composites"), meta, svalue=1.0, p=0.9, nsmooth=36, nupdate=6, is_standing=True, regular=True)


@query(
    """WITH b AS (SELECT *, nullif(regexp_extract(cube_id, '^[^/]*/([^./]+)\\.', 1), '') AS product FROM cube_meta),
    pm AS (SELECT product, max(vmin) AS lo, max(vmax) AS hi FROM b GROUP BY 1),
    m AS (SELECT cube_id, cols, vamcode, coalesce(vmin, lo) AS vmin, coalesce(vmax, hi) AS vmax FROM b LEFT JOIN pm USING (product)),
    s AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY cube_id, pixel_id, obs_date ORDER BY proc_ts DESC, obs_id DESC) = 1)
    SELECT lower(coalesce(nullif(trim(vamcode), ''), 'x')) || strftime(obs_date, '%Yj%j') AS image, s.cube_id, (pixel_id // cols)::BIGINT AS row, (pixel_id % cols)::BIGINT AS col,
    round_even(greatest(vmin, least(vmax, value::DOUBLE)) / 10::DOUBLE, 0) * 10::DOUBLE + 0.0::DOUBLE AS value
    FROM s JOIN m ON s.cube_id = m.cube_id WHERE value IS NOT NULL"""
)
def export_raw(spark, d):
    s = standing(table(spark, d, "raw")).where("value is not null").drop("obs_id")
    out = pipelines.export(s, table(spark, d, "cube_meta"), None, rounding=1)
    return out.select("image", "cube_id", "row", F.col("col").cast("bigint").alias("col"), (F.col("value") + F.lit(0.0)).alias("value"))


WINDOW_SQL = """WITH b AS (SELECT *, nullif(regexp_extract(cube_id, '^[^/]*/([^./]+)\\.', 1), '') AS product FROM cube_meta),
    pm AS (SELECT product, max(vmin) AS lo, max(vmax) AS hi FROM b GROUP BY 1),
    m AS (SELECT cube_id, cols, vamcode, geotransform AS gt, coalesce(is_global, FALSE) AS isg, coalesce(vmin, lo) AS vmin, coalesce(vmax, hi) AS vmax,
          abs(geotransform[2]) / CASE WHEN is_global THEN 1::DOUBLE ELSE 112000::DOUBLE END AS res, 6371007.181::DOUBLE * pi() / 180 AS k FROM b LEFT JOIN pm USING (product)),
    s AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY cube_id, pixel_id, obs_date ORDER BY proc_ts DESC, obs_id DESC) = 1),
    p AS (SELECT m.*, pixel_id, pixel_id // cols AS r, pixel_id % cols AS c FROM (SELECT DISTINCT cube_id, pixel_id FROM s) JOIN m USING (cube_id)),
    t AS (SELECT *, unnest(range(greatest(0, floor((90 - (gt[4] + r * gt[6]) / CASE WHEN isg THEN 1 ELSE k END) / res))::BIGINT - 2, floor((90 - (gt[4] + (r + 1) * gt[6]) / CASE WHEN isg THEN 1 ELSE k END) / res)::BIGINT + 3)) AS trow FROM p),
    l AS (SELECT *, 90 - (trow + 0.5::DOUBLE) * res AS lat, CASE WHEN isg THEN 1 ELSE k * greatest(cos((90 - (trow + 0.5::DOUBLE) * res) * (pi() / 180)), 1e-12) END AS kx FROM t),
    u AS (SELECT *, unnest(range(greatest(0, floor(((gt[1] + c * gt[2]) / kx + 180) / res)::BIGINT - 2), least(round(360 / res)::BIGINT, floor(((gt[1] + (c + 1) * gt[2]) / kx + 180) / res)::BIGINT + 3))) AS tcol FROM l WHERE floor(((CASE WHEN isg THEN 1 ELSE k END) * lat - gt[4]) / gt[6]) = r AND trow BETWEEN 0 AND round(180 / res) - 1),
    w AS (SELECT cube_id, pixel_id, vamcode, vmin, vmax, trow, tcol FROM u WHERE floor(((-180 + (tcol + 0.5::DOUBLE) * res) * kx - gt[1]) / gt[2]) = c)
    SELECT regexp_replace(cube_id, '\\.h\\d{2}v\\d{2}\\.', '.*.') AS grp, lower(coalesce(nullif(trim(vamcode), ''), 'x')) || strftime(obs_date, '%Yj%j') AS image, trow::INTEGER AS trow, tcol::INTEGER AS tcol,
    arg_max(round_even(greatest(vmin, least(vmax, value::DOUBLE)) / 10::DOUBLE, 0) * 10::DOUBLE + 0.0::DOUBLE, cube_id) AS value
    FROM s JOIN w USING (cube_id, pixel_id) WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4"""


@query(WINDOW_SQL)
def window_mosaic(spark, d):
    """All raw cubes: tiles of a group as one image a date in degrees, clipped and rounded."""
    s = standing(table(spark, d, "raw")).drop("obs_id")
    return pipelines.window(s, table(spark, d, "cube_meta"), rounding=1).withColumn("value", F.col("value") + F.lit(0.0))


@query(
    with_sql(
        PARSED_SQL,
        """px AS (SELECT path, i::BIGINT AS pixel_id, ((granule_id * 7 + i) % 1000)::SMALLINT AS value FROM granules, range(3) t(i)),
        r AS (SELECT path, 'VIM/' || concat_ws('.', CASE WHEN product LIKE 'VNP%' THEN product ELSE 'MXD' || substr(product, 4) END, tile, version, 'VIM') AS cube_id, raw_date, proc_ts FROM (SELECT DISTINCT * FROM pg)
              WHERE product LIKE '___13%' AND (product LIKE 'VNP%' AND raw_date >= DATE '2012-01-17' OR product NOT LIKE 'VNP%' AND raw_date >= DATE '2002-07-04')),
        f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY cube_id, raw_date ORDER BY proc_ts DESC, path DESC) = 1)""",
        "SELECT cube_id, pixel_id, raw_date AS obs_date, value FROM px JOIN f ON f.path = px.path",
    )
)
def collect_cubes(spark, d):
    g = table(spark, d, "granules").select("path", "granule_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    pixels = g.select("path", F.col("i").cast("bigint").alias("pixel_id"), ((F.col("granule_id") * 7 + F.col("i")) % 1000).cast("smallint").alias("value"))
    return pipelines.collect(pixels, "VIM")


# ---- rasters: rows are vectors, columns their positions

R_SQL = "rr AS (SELECT vec_id AS row, unnest(range(len(embedding)))::BIGINT AS col, round_even(10000::DOUBLE * unnest(embedding)::DOUBLE, 0)::BIGINT AS value FROM embeddings)"


def r_raster(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "x"))
    return e.select("row", F.col("col").cast("bigint").alias("col"), F.rint(F.col("x").cast("double") * 10000).cast("bigint").alias("value"))


@query(with_sql(R_SQL, "SELECT row, col, greatest(-2000::DOUBLE, least(10000::DOUBLE, value::DOUBLE)) AS value FROM rr"))
def clip_valid(spark, d):
    return r_raster(spark, d).select("row", "col", raster.clip(F.col("value"), -2000, 10000).alias("value"))


@query(with_sql(R_SQL, "SELECT row, col, CASE WHEN value BETWEEN -2000 AND 10000 THEN value END AS value FROM rr"))
def range_mask(spark, d):
    return r_raster(spark, d).select("row", "col", raster.mask_range(F.col("value"), -2000, 10000).alias("value"))


@query(with_sql(R_SQL, "SELECT row, col, round_even(value::DOUBLE / 100::DOUBLE, 0) * 100::DOUBLE + 0.0::DOUBLE AS value FROM rr"))
def round_int(spark, d):
    return r_raster(spark, d).select("row", "col", (raster.round_int(F.col("value"), 2) + F.lit(0.0)).alias("value"))


@query(with_sql(R_SQL, "SELECT row, col, greatest(-32767::DOUBLE, least(32767::DOUBLE, round_even(value::DOUBLE * 7.5::DOUBLE, 0)))::SMALLINT AS value FROM rr"))
def rint_store(spark, d):
    return r_raster(spark, d).select("row", "col", smooth.stored(F.col("value") * 7.5).alias("value"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1998-06-30'")
def date_window(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return raster.date_window(o, "day", date(1997, 3, 1), date(1998, 6, 30))


@query(with_sql(L_SQL, "ax AS (SELECT k, list(DISTINCT day ORDER BY day) AS dates FROM e GROUP BY 1)", "SELECT count(*) AS n_cubes, count(DISTINCT dates) AS n_axes FROM ax"))
def mosaic_axis_check(spark, d):
    return raster.axis_check(l_long(spark, d), "l_suppkey", "day")


@query(
    with_sql(
        R_SQL,
        "tl AS (SELECT row % 400 AS row, col, row // 400 AS o, CASE WHEN value > -5000 THEN value END AS value FROM rr)",
        "SELECT row, col, arg_max(value, o) FILTER (value IS NOT NULL) AS value FROM tl GROUP BY 1, 2",
    )
)
def mosaic_overlap(spark, d):
    r = r_raster(spark, d)
    tiles = r.select((F.col("row") % 400).alias("row"), "col", F.floor(F.col("row") / 400).alias("o"), F.when(F.col("value") > -5000, F.col("value")).alias("value"))
    return raster.mosaic(tiles, "o", ["row", "col"], "value")


GRID_GT = (0.0, 1000.0, 0.0, 500000.0, 0.0, -1000.0)
CUBE_GT = (10000.0, 1000.0, 0.0, 380000.0, 0.0, -1000.0)


def raster_rows(spark, d) -> int:
    return table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1


@query(with_sql(R_SQL, "SELECT (row - 120)::INTEGER AS row, (col - 10)::INTEGER AS col, value FROM rr WHERE row >= 120 AND col BETWEEN 10 AND 49"))
def sgrid_window(spark, d):
    """A cube of 40 columns from row 120 to the raster's last one."""
    n = raster_rows(spark, d)
    return raster.sgrid_window(r_raster(spark, d), GRID_GT, CUBE_GT, n - 120, 40, n, 64, "value")


BOX = (-20.0, 20.0, 10.0, -20.0)
WARP_SQL = """
nn AS (SELECT (max(vec_id) + 1)::BIGINT AS n, 6371007.181::DOUBLE * (pi() / 180) AS k FROM embeddings),
tg AS (SELECT n, k, (id // 120)::INTEGER AS trow, (id % 120)::INTEGER AS tcol FROM (SELECT n, k, unnest(range(n * 120)) AS id FROM nn)),
ll AS (SELECT n, k, trow, tcol, -20::DOUBLE + (tcol + 0.5::DOUBLE) * 0.25::DOUBLE AS lon, 20::DOUBLE - (trow + 0.5::DOUBLE) * (40::DOUBLE / n) AS lat FROM tg)
"""


@query(
    with_sql(
        R_SQL,
        WARP_SQL,
        """px AS (SELECT trow, tcol, floor((k * lat - 20 * k) / (-40::DOUBLE / n * k))::BIGINT AS row, floor((k * lon * cos(lat * (pi() / 180)) + 20 * k) / (30 * k / 64))::BIGINT AS col FROM ll)""",
        "SELECT trow, tcol, value FROM px LEFT JOIN rr ON rr.row = px.row AND rr.col = px.col",
    )
)
def warp_nearest(spark, d):
    """The whole raster, laid over 40 degrees of latitude, on a grid of its own height."""
    n, k = raster_rows(spark, d), raster.C.SPHERE_RADIUS * (math.pi / 180)
    return raster.warp_nearest(r_raster(spark, d), (-20 * k, 30 * k / 64, 0.0, 20 * k, 0.0, -40 / n * k), BOX, 0.25, 40 / n)


@query(with_sql(WARP_SQL, "SELECT trow, tcol, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ll WHERE lon BETWEEN -12.3 AND 4.1 AND lat BETWEEN 1.2 AND 9.9"))
def aoi_clip(spark, d):
    g = raster.target_grid(spark, BOX, 0.25, 40 / raster_rows(spark, d))
    return raster.aoi_clip(g, (-12.3, 9.9, 4.1, 1.2)).select("trow", "tcol", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(
    with_sql(
        PARSED_SQL,
        "tt AS (SELECT DISTINCT tile FROM pg WHERE tile IS NOT NULL), hv AS (SELECT tile, CAST(substr(tile, 2, 2) AS INTEGER) - 18 AS h, CAST(substr(tile, 5, 2) AS INTEGER) - 9 AS v FROM tt)",
        "SELECT tile, round(h * 1200 * 926.6254330558334::DOUBLE, 3) + 0.0::DOUBLE AS ulx, round(v * 1200 * -926.6254330558334::DOUBLE, 3) + 0.0::DOUBLE AS uly FROM hv",
    )
)
def tile_geotransform(spark, d):
    gt = raster.tile_geotransform(F.col("tile"))
    return parsed(spark, d).select("tile").where("tile is not null").distinct().select("tile", (F.round(gt[0], 3) + F.lit(0.0)).alias("ulx"), (F.round(gt[3], 3) + F.lit(0.0)).alias("uly"))


@query("SELECT cube_id, round(resolution[1] / CASE WHEN is_global THEN 1::DOUBLE ELSE 112000::DOUBLE END, 12) AS xres, regexp_replace(cube_id, '\\.h\\d{2}v\\d{2}\\.', '.*.') AS grp FROM cube_meta")
def output_resolution(spark, d):
    m = table(spark, d, "cube_meta")
    return m.select("cube_id", F.round(raster.output_resolution(F.col("resolution"), F.col("is_global"))[0], 12).alias("xres"), raster.group_name(F.col("cube_id")).alias("grp"))


@query(
    with_sql(
        R_SQL,
        "n AS (SELECT (max(row) // 600 + 1) * 600 AS h, (max(col) // 64 + 1) * 64 AS w FROM rr)",
        "f AS (SELECT (id // w)::INTEGER AS row, (id % w)::INTEGER AS col FROM (SELECT w, unnest(range(h * w)) AS id FROM n))",
        "SELECT f.row, f.col, rr.value FROM f LEFT JOIN rr ON rr.row = f.row AND rr.col = f.col",
    )
)
def fill_raster(spark, d):
    """Every pixel of the whole tiles of 600 x 64 that the raster reaches; null where it has none."""
    r = r_raster(spark, d)
    return raster.fill_tile(spark, r, *raster.tile_size(r, 600, 64))


# ---- sources, sinks, runs


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def checksums(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query(None)
def posix_checksums(spark, d):
    return files.cksum_column(table(spark, d, "documents"), "text", ["doc_id"])


SIDECAR = "<GranuleMetaDataFile><GranuleURMetaData><DataFiles><DataFileContainer><DistributedFileName>{f}</DistributedFileName><FileSize>{n}</FileSize><ChecksumType>CKSUM</ChecksumType><Checksum>{c}</Checksum></DataFileContainer></DataFiles></GranuleURMetaData></GranuleMetaDataFile>"


@query("SELECT granule_id, filename AS file_name, (granule_id * 1000)::BIGINT AS file_size, 'CKSUM' AS checksum_type, cksum::VARCHAR AS checksum FROM granules")
def xml_sidecar(spark, d):
    head, a = SIDECAR.split("{f}")
    mid, b = a.split("{n}")
    end, tail = b.split("{c}")
    xml = F.concat(F.lit(head), "filename", F.lit(mid), (F.col("granule_id") * 1000).cast("string"), F.lit(end), F.col("cksum").cast("string"), F.lit(tail))
    return files.parse_sidecars(table(spark, d, "granules").select("granule_id", xml.alias("xml"))).drop("xml")


@query(
    with_sql(
        E_ALL, ONE.format(lam=10), solver("r", "s", "30"),
        "SELECT i::BIGINT AS pos, 'u' || k AS series, round(x::FLOAT::DOUBLE, 3) AS value FROM r UNION ALL SELECT 30::BIGINT, 'u' || k, 10::DOUBLE FROM (SELECT DISTINCT k FROM g) UNION ALL SELECT 31::BIGINT, 'u' || k, 1::DOUBLE FROM (SELECT DISTINCT k FROM g)",
    )
)
def csv_smooth(spark, d):
    """A CSV with a column per series, smoothed by the command; its file has the penalty and its log10 as two more lines."""
    import uuid

    from chronoraster.cli import csv_smooth as command
    from chronoraster.functions.session import checkpoint_dir

    base = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    s = e_series(spark, d).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("series"), F.posexplode(F.zip_with("y", "w", lambda y, w: F.when(w > 0, y))).alias("pos", "value"))
    names = [r[0] for r in s.select("series").distinct().orderBy("series").collect()]  # one per column of the file
    out = command(spark, files.write_csv_series(s, f"{base}/in.csv", names, "fixed"), "pos", svalue=1.0)
    return files.read_csv_series(spark, out, "pos").withColumn("value", F.round("value", 3))


@query(
    """SELECT cube_id, CASE WHEN s IS NULL THEN 'V-curve optimization of s' ELSE 'fixed s ' || s || ' (log10)' END || CASE WHEN pvalue IS NULL OR isnan(pvalue) THEN '' ELSE ' and with P-value of ' || pvalue::VARCHAR END AS lastrun
    FROM (SELECT cube_id, pvalue, nullif(regexp_extract(lastrun, 'fixed s (-?[0-9.]+)', 1), '') AS s FROM run_log WHERE lastrun NOT LIKE '%grid%')"""
)
def run_description(spark, d):
    r = table(spark, d, "run_log").where("lastrun not like '%grid%'")
    s = F.nullif(F.regexp_extract("lastrun", r"fixed s (-?[0-9.]+)", 1), F.lit(""))
    text = F.when(s.isNull(), cube.run_description(None, None, True)).otherwise(cube.run_description(s, None, False))
    full = F.when(s.isNull(), cube.run_description(None, F.col("pvalue"), True)).otherwise(cube.run_description(s, F.col("pvalue"), False))
    return r.select("cube_id", F.when(F.col("pvalue").isNull() | F.isnan("pvalue"), text).otherwise(full).alias("lastrun"))


@query(with_sql(E_ALL, "SELECT k AS user_id, day, round(v, 6) AS v FROM e"))
def stream_append(spark, d):
    """Daily means replayed as three micro-batches in date order through a guarded append."""
    import uuid

    from chronoraster.functions.session import checkpoint_dir
    from chronoraster.streaming.append import StoredCube, append_stream

    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    e = e_long(spark, d).withColumn("v", F.round("v", 6))
    part = F.when(F.col("day") < F.lit(date(2024, 1, 11)), 0).when(F.col("day") < F.lit(date(2024, 1, 21)), 1).otherwise(2)
    for i in range(3):
        e.where(part == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{base}/in")
        append_stream(stream, StoredCube(spark, f"{base}/cube", "day", None, ("user_id",)), f"{base}/checkpoint").awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return StoredCube(spark, f"{base}/cube", "day", None, ("user_id",)).read()


@query(
    """WITH b AS (SELECT *, nullif(regexp_extract(cube_id, '^[^/]*/([^./]+)\\.', 1), '') AS product FROM cube_meta),
    pm AS (SELECT product, max(nodata) AS nd, max(temporalresolution) AS tr, max(vmin) AS lo, max(vmax) AS hi FROM b GROUP BY 1)
    SELECT b.cube_id, b.product, coalesce(nodata, nd) AS nodata, coalesce(temporalresolution, tr) AS t, coalesce(vmin, lo) AS vmin, coalesce(vmax, hi) AS vmax FROM b LEFT JOIN pm ON b.product IS NOT DISTINCT FROM pm.product"""
)
def meta_complete(spark, d):
    return complete_meta(table(spark, d, "cube_meta")).select("cube_id", "product", "nodata", "t", "vmin", "vmax")


@query("SELECT cube_id, pixel_id, obs_date, obs_id, value FROM raw QUALIFY row_number() OVER (PARTITION BY cube_id, pixel_id, obs_date ORDER BY proc_ts DESC, obs_id DESC) = 1")
def standing_readings(spark, d):
    return standing(table(spark, d, "raw"))


@query(
    """WITH m AS (SELECT cube_id, cols FROM cube_meta), s AS (SELECT DISTINCT cube_id, pixel_id FROM raw)
    SELECT s.cube_id, pixel_id, (pixel_id // cols)::BIGINT AS row, (pixel_id % cols)::BIGINT AS col FROM s JOIN m USING (cube_id)"""
)
def pixel_positions(spark, d):
    m = F.broadcast(table(spark, d, "cube_meta").select("cube_id", "cols"))
    s = table(spark, d, "raw").select("cube_id", "pixel_id").distinct().join(m, "cube_id")
    return s.select("cube_id", "pixel_id", cube.pixel_row(F.col("pixel_id"), F.col("cols")).alias("row"), cube.pixel_col(F.col("pixel_id"), F.col("cols")).cast("bigint").alias("col"))


@query("SELECT cube_id, CASE WHEN cube_id LIKE 'VIM/VNP%' THEN -5000::DOUBLE ELSE vmin END AS vmin, CASE WHEN cube_id LIKE 'VIM/VNP%' THEN 9000::DOUBLE ELSE vmax END AS vmax FROM cube_meta")
def set_range(spark, d):
    return cube.set_range(table(spark, d, "cube_meta"), "VIM/VNP*", -5000, 9000).select("cube_id", "vmin", "vmax")


@query(
    with_sql(
        E_ALL,
        "SELECT k AS user_id, count(*) AS n_tail, max(day) AS last_day FROM (SELECT *, dense_rank() OVER (ORDER BY day DESC) AS r FROM e) WHERE r <= 10 GROUP BY 1",
    )
)
def tail_read(spark, d):
    return cube.tail(e_long(spark, d), "day", 10).groupBy("user_id").agg(F.count("*").alias("n_tail"), F.max("day").alias("last_day"))


@query("SELECT cube_id FROM cube_meta WHERE contains(cube_id, 'MXD13A2') AND contains(cube_id, 'VIM')")
def cube_filter(spark, d):
    return files.filter_cubes(table(spark, d, "cube_meta"), "mxd13a2", "vim").select("cube_id")


@query("SELECT * FROM (VALUES ('CONSOLIDATION_RULE', 'VIM'), ('SOURCE', 'cube'), ('EMPTY', '')) t(key, value)")
def metadata_options(spark, d):
    text = spark.range(1).select(raster.metadata_options(F.lit("CONSOLIDATION_RULE=VIM&SOURCE=cube&EMPTY=")).alias("m"))
    return text.select(F.explode("m").alias("key", "value"))


@query("SELECT granule_id, list_element(string_split(path, '/'), -1) AS name, sha256(path) AS sha256 FROM granules")
def cleanup_trace(spark, d):
    g = table(spark, d, "granules").select("granule_id", "path", F.col("path").cast("binary").alias("content"))
    return files.trace(g, keep=["granule_id"]).drop("at")
