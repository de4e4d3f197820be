"""Named queries over the driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timeaxis, units
from ..operators import align, ensemble, linop, metrics, normalize, regress, spectra
from ..sources import files
from ..sources.cubes import MONTHS, complete_orders_cube, drivers, events_cube, members_cube, months_since, orders_cube, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The cubes in SQL.
CUBE = """
cube AS (
  SELECT CAST(n_nationkey AS BIGINT) AS cell, CAST(n_regionkey AS BIGINT) AS region, -60.0 + 5 * n_nationkey AS lat, CAST(x.t AS INT) AS t, 1995 + x.t // 12 AS year, x.t % 12 + 1 AS month, g.value
  FROM nation CROSS JOIN (SELECT unnest(range(72)) AS t) x
  LEFT JOIN (SELECT c_nationkey AS c, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS t, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1, 2) g ON g.c = n_nationkey AND g.t = x.t
)"""
DRIVERS = """
raw AS (
  SELECT CAST(x.t AS INT) AS t, a.enso, a.pdo, a.amo, b.gmt FROM (SELECT unnest(range(72)) AS t) x
  LEFT JOIN (SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, avg(l_discount * l_extendedprice) AS enso, avg(l_quantity) AS pdo, avg(l_tax) AS amo FROM lineitem GROUP BY 1) a ON a.t = x.t
  LEFT JOIN (SELECT (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS t, CAST(count(*) AS DOUBLE) AS gmt FROM orders GROUP BY 1) b ON b.t = x.t
), drivers0 AS (
  SELECT t, 1995 + t // 12 AS year, t % 12 + 1 AS month, coalesce(enso, avg(enso) OVER ()) - avg(enso) OVER () AS enso, coalesce(pdo, avg(pdo) OVER ()) - avg(pdo) OVER () AS pdo, coalesce(amo, avg(amo) OVER ()) - avg(amo) OVER () AS amo, coalesce(gmt, avg(gmt) OVER ()) - avg(gmt) OVER () AS gmt FROM raw
), drivers1 AS (
  SELECT *, pdo - sum(pdo * enso) OVER () / sum(enso * enso) OVER () * enso AS pdo_orth FROM drivers0
), drivers AS (
  SELECT t, year, month, gmt, enso / stddev_pop(enso) OVER () AS enso, pdo_orth / stddev_pop(pdo_orth) OVER () AS pdo_orth, amo / stddev_pop(amo) OVER () AS amo FROM drivers1
)"""
SEASON_OF = "CASE WHEN {m} IN (12, 1, 2) THEN 'DJF' WHEN {m} < 6 THEN 'MAM' WHEN {m} < 9 THEN 'JJA' ELSE 'SON' END"
SEASONS = f"""
seasons AS (
  SELECT cell, region, CAST(date_trunc('quarter', make_date(year, month, 1) + INTERVAL 1 MONTH) - INTERVAL 1 MONTH AS DATE) AS label, avg(value) AS value FROM cube GROUP BY ALL
), seasonal AS (
  SELECT cell, region, label, {SEASON_OF.format(m="month(label)")} AS season, year(label) + CASE WHEN month(label) = 12 THEN 1 ELSE 0 END AS season_year, value FROM seasons
)"""
#: Least squares on a constant and two predictors, from moments.
FIT = """
xy AS (SELECT cell, c.month, value AS y, enso AS a, pdo_orth AS b FROM cube c JOIN drivers d USING (t)),
moments AS (
  SELECT cell, month, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, count(y) = count(*) AS ok FROM xy GROUP BY ALL
), betas AS (
  SELECT cell, month, CASE WHEN ok THEN (say * sbb - sby * sab) / (saa * sbb - sab * sab) END AS enso, CASE WHEN ok THEN (sby * saa - say * sab) / (saa * sbb - sab * sab) END AS pdo_orth, ma, mb, my FROM moments
), fit AS (
  SELECT cell, month, unnest(['constant', 'enso', 'pdo_orth']) AS predictor, unnest([my - enso * ma - pdo_orth * mb, enso, pdo_orth]) AS beta FROM betas
)"""
#: The weights from the calendar of a common year: mean, annual and semi-annual harmonics at the months' mean days.
SMOOTH = """
mid AS (SELECT month(d) AS m, avg(dayofyear(d)) / 365 AS x FROM (SELECT unnest(generate_series(TIMESTAMP '1950-01-01', TIMESTAMP '1950-12-31', INTERVAL 1 DAY)) AS d) GROUP BY 1),
s AS (SELECT o.m AS m_out, i.m AS m_in, 1 / 12.0::DOUBLE + 2 / 12.0::DOUBLE * (cos(2 * pi() * (o.x - i.x)) + cos(4 * pi() * (o.x - i.x))) AS w FROM mid o CROSS JOIN mid i),
smooth AS (SELECT cell, predictor, m_out AS month, CASE WHEN count(beta) = 12 THEN sum(beta * w) END AS beta FROM fit JOIN s ON m_in = fit.month GROUP BY ALL),
wide AS (SELECT cell, month, max(CASE WHEN predictor = 'constant' THEN beta END) AS b0, max(CASE WHEN predictor = 'enso' THEN beta END) AS b1, max(CASE WHEN predictor = 'pdo_orth' THEN beta END) AS b2 FROM smooth GROUP BY ALL),
fits AS (SELECT cell, t, cube.month, value, b0 + b1 * enso + b2 * pdo_orth AS fitted, value - (b0 + b1 * enso + b2 * pdo_orth) AS residual FROM cube JOIN wide USING (cell, month) JOIN drivers USING (t))"""
BLOCK, MEMBERS = 24, 4
DRAWS = f"""
draws AS (
  SELECT m.m AS member, b.b AS block, CAST(CAST('0x' || substr(md5(concat_ws('-', 123, m.m, b.b)), 1, 8) AS BIGINT) % 6 * 12 AS INT) AS start FROM (SELECT unnest(range({MEMBERS})) AS m) m CROSS JOIN (SELECT unnest(range(3)) AS b) b
), idx AS (
  SELECT member, block * {BLOCK} + k AS t, (start + k) % 72 AS from_t FROM draws CROSS JOIN (SELECT unnest(range({BLOCK})) AS k) WHERE block * {BLOCK} + k < 72
), noise AS (SELECT cell, member, idx.t, residual AS noise FROM fits JOIN idx ON fits.t = from_t)"""
PREDICTORS = ["constant", "enso", "pdo_orth"]


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Registers a query; sql with the common tables that it needs."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = ("WITH " + ",".join(ctes) if ctes else "") + "\n" + sql
        return f

    return add


def r(c, d: int = 6):
    return F.round(c, d)


# -- shared plans --------------------------------------------------------------------------------------


def seasonal(cube: DataFrame) -> DataFrame:
    label = timeaxis.quarter_label(timeaxis.month_start(F.col("year"), F.col("month")))
    keys = [c for c in ("cell", "region") if c in cube.columns]
    out = cube.groupBy(*keys, label.alias("label")).agg(F.avg("value").alias("value"))
    return out.withColumns({"season": timeaxis.season(F.month("label")), "season_year": timeaxis.season_year(F.year("label"), F.month("label"))})


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regress.standardised(regress.orthogonalised(drivers(spark, sf_dir), "pdo", "enso", "pdo_orth"), ["enso", "pdo_orth", "amo"])


def monthly_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regress.monthly_fit(orders_cube(spark, sf_dir), regress.hat_table(modes(spark, sf_dir), PREDICTORS))


def all_fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fit = regress.smoothed(monthly_fit(spark, sf_dir))
    return fit, regress.fitted(orders_cube(spark, sf_dir), fit, modes(spark, sf_dir), PREDICTORS)


def noise(spark: SparkSession, fits: DataFrame) -> DataFrame:
    return ensemble.bootstrapped(fits, ensemble.resampling(ensemble.hashed_starts(spark, MEMBERS, MONTHS, BLOCK), MONTHS, BLOCK))


# -- climatology, seasons, metrics -----------------------------------------------------------------------

LEVEL_RANK = "CASE WHEN abs((n + 0.12) / (least(n, k1 + 1) - 0.44) - p) < abs((n + 0.12) / (k1 - 0.44) - p) THEN least(n, k1 + 1) ELSE k1 END"


def _levels(keys: str, source: str) -> str:
    return f"""
ranked AS (SELECT {keys}, value, count(*) OVER (PARTITION BY {keys}) AS n, row_number() OVER (PARTITION BY {keys} ORDER BY value DESC) AS k FROM {source} WHERE value IS NOT NULL),
wanted AS (SELECT *, greatest(1, least(n, CAST(floor(0.44 + (n + 0.12) / p) AS BIGINT))) AS k1 FROM ranked CROSS JOIN (VALUES (3), (33), (150)) v(p)),
levels AS (SELECT {keys}, p AS return_period, value AS level FROM wanted WHERE k = {LEVEL_RANK})"""


@query(
    "season_summary",
    "SELECT s.cell, s.season, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iq_range, round(max(value), 6) AS max_val, round(any_value(level), 6) AS level_33 FROM seasonal s LEFT JOIN levels l ON l.cell = s.cell AND l.season = s.season AND return_period = 33 GROUP BY s.cell, s.season",
    (CUBE, SEASONS, _levels("cell, season", "seasonal")),
)
def season_summary(spark, sf_dir):
    rows = seasonal(orders_cube(spark, sf_dir))
    level = metrics.return_levels(rows, ["cell", "season"], [33]).select("cell", "season", "level")
    both = metrics.spread(rows, ["cell", "season"]).join(level, ["cell", "season"], "left")
    return both.select("cell", "season", r("iq_range").alias("iq_range"), r("max_val").alias("max_val"), r("level").alias("level_33"))


@query("return_levels", "SELECT cell, season, CAST(return_period AS INT) AS return_period, round(level, 6) AS level FROM levels", (CUBE, SEASONS, _levels("cell, season", "seasonal")))
def return_levels(spark, sf_dir):
    return metrics.return_levels(seasonal(orders_cube(spark, sf_dir)), ["cell", "season"], [3, 33, 150]).select("cell", "season", "return_period", r("level").alias("level"))


@query("pooled_return_levels", "SELECT region, season, CAST(return_period AS INT) AS return_period, round(level, 6) AS level FROM levels", (CUBE, SEASONS, _levels("region, season", "seasonal")))
def pooled_return_levels(spark, sf_dir):
    return metrics.return_levels(seasonal(orders_cube(spark, sf_dir)), ["region", "season"], [3, 33, 150]).select("region", "season", "return_period", r("level").alias("level"))


@query("monthly_climatology", "SELECT cell, CAST(month AS INT) AS month, round(avg(value), 6) AS mean FROM cube GROUP BY ALL", (CUBE,))
def monthly_climatology(spark, sf_dir):
    return orders_cube(spark, sf_dir).groupBy("cell", "month").agg(r(F.avg("value")).alias("mean"))


@query("monthly_anomaly", "SELECT cell, t, round(value - avg(value) OVER (PARTITION BY cell, month), 6) AS anomaly FROM cube", (CUBE,))
def monthly_anomaly(spark, sf_dir):
    cube = orders_cube(spark, sf_dir)
    return cube.select("cell", "t", r(F.col("value") - F.avg("value").over(Window.partitionBy("cell", "month"))).alias("anomaly"))


@query("seasonal_mean_qsdec", "SELECT cell, label, season, CAST(season_year AS INT) AS season_year, round(value, 6) AS value FROM seasonal", (CUBE, SEASONS))
def seasonal_mean_qsdec(spark, sf_dir):
    return seasonal(orders_cube(spark, sf_dir)).select("cell", "label", "season", "season_year", r("value").alias("value"))


@query("season_year_filter", "SELECT cell, CAST(season_year AS INT) AS season_year, round(value, 6) AS value FROM seasonal WHERE season = 'DJF' AND season_year BETWEEN 1996 AND 2000", (CUBE, SEASONS))
def season_year_filter(spark, sf_dir):
    return seasonal(orders_cube(spark, sf_dir)).where((F.col("season") == "DJF") & F.col("season_year").between(1996, 2000)).select("cell", "season_year", r("value").alias("value"))


@query("metric_pivot", f"SELECT cell, {', '.join(f'round(max(CASE WHEN season = {s!r} THEN value END), 6) AS max_{s.lower()}' for s in timeaxis.SEASONS)} FROM seasonal GROUP BY cell", (CUBE, SEASONS))
def metric_pivot(spark, sf_dir):
    rows = metrics.spread(seasonal(orders_cube(spark, sf_dir)), ["cell", "season"])
    return align.to_columns(rows, ["cell"], "season", "max_val", list(timeaxis.SEASONS)).select("cell", *[r(s).alias(f"max_{s.lower()}") for s in timeaxis.SEASONS])


@query("stacked_metrics", "SELECT cell, season, 'iq_range' AS metric, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS value FROM seasonal GROUP BY ALL UNION ALL SELECT cell, season, 'max_val', round(max(value), 6) FROM seasonal GROUP BY ALL", (CUBE, SEASONS))
def stacked_metrics(spark, sf_dir):
    rows = metrics.spread(seasonal(orders_cube(spark, sf_dir)), ["cell", "season"])
    return align.stacked({m: rows.select("cell", "season", r(m).alias("value")) for m in ("iq_range", "max_val")}, "metric")


@query("hourly_climatology", "SELECT event_type AS cell, CAST(hour(ts) AS INT) AS phase, round(avg(value), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, ts, avg(value) AS value FROM (SELECT event_type, date_trunc('hour', ts) AS ts, value FROM events WHERE ts < TIMESTAMP '2024-01-31') GROUP BY ALL) GROUP BY ALL")
def hourly_climatology(spark, sf_dir):
    return events_cube(spark, sf_dir).groupBy("cell", "phase").agg(r(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


# -- alignment ---------------------------------------------------------------------------------------------


@query("lagged_predictors", "SELECT t, round(gmt, 6) AS gmt, round(lag(enso, 3) OVER (ORDER BY t), 6) AS enso, round(lag(pdo, 3) OVER (ORDER BY t), 6) AS pdo FROM drivers1 QUALIFY row_number() OVER (ORDER BY t) > 3", (DRIVERS,))
def lagged_predictors(spark, sf_dir):
    rows = drivers(spark, sf_dir).select("t", "enso", "pdo", "gmt")
    return align.lagged(rows, 3, ["gmt"]).select("t", r("gmt", 6).alias("gmt"), r("enso", 6).alias("enso"), r("pdo", 6).alias("pdo"))


@query("gram_schmidt_index", "SELECT t, round(pdo_orth, 6) AS pdo_orth FROM drivers1", (DRIVERS,))
def gram_schmidt_index(spark, sf_dir):
    return regress.orthogonalised(drivers(spark, sf_dir), "pdo", "enso", "pdo_orth").select("t", r("pdo_orth", 6).alias("pdo_orth"))


@query("standardised_modes", "SELECT t, round(enso, 6) AS enso, round(pdo_orth, 6) AS pdo_orth, round(amo, 6) AS amo FROM drivers", (DRIVERS,))
def standardised_modes(spark, sf_dir):
    return modes(spark, sf_dir).select("t", *[r(c, 6).alias(c) for c in ("enso", "pdo_orth", "amo")])


@query("nearest_cell_series", "SELECT cell, t, round(value, 6) AS value FROM cube WHERE cell = (SELECT n_nationkey FROM nation ORDER BY abs(-60 + 5 * n_nationkey - 13.2), n_nationkey LIMIT 1)", (CUBE,))
def nearest_cell_series(spark, sf_dir):
    cube = orders_cube(spark, sf_dir)
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("cell"), (F.lit(-60.0) + 5 * F.col("n_nationkey")).alias("lat"), F.lit(0.0).alias("lon"))
    return cube.join(align.nearest_cell(cells, 13.2, 0.0).select("cell"), "cell", "left_semi").select("cell", "t", r("value").alias("value"))


@query("area_weighted_region_mean", "SELECT region, t, round(sum(value * cos(radians(lat))) / sum(cos(radians(lat))), 6) AS mean, round(sum(value * cos(radians(lat))) / sum(CASE WHEN value IS NOT NULL THEN cos(radians(lat)) END), 6) AS strict_mean FROM cube GROUP BY ALL", (CUBE,))
def area_weighted_region_mean(spark, sf_dir):
    cube = orders_cube(spark, sf_dir)
    w = align.cos_weight(F.col("lat"))
    strict = align.weighted_mean(cube, ["region", "t"], "value", w, True).withColumnRenamed("mean", "strict_mean")
    return align.weighted_mean(cube, ["region", "t"], "value", w).join(strict, ["region", "t"]).select("region", "t", r("mean").alias("mean"), r("strict_mean").alias("strict_mean"))


#: A region on the stand-in grid, as (lon, lat); its longitudes are moved by 360.
RING = [(-340.0, -45.0), (-250.0, -45.0), (-300.0, 7.0), (-250.0, 52.0), (-350.0, 31.0)]


@query("cells_in_region", "SELECT CAST(n_nationkey AS BIGINT) AS cell FROM (SELECT n_nationkey, -60.0 + 5 * n_nationkey AS y, (n_nationkey * 37) % 120 AS x FROM nation) n WHERE (SELECT count(*) FROM (VALUES " + ", ".join(f"({a + 360}, {b}, {c + 360}, {d})" for (a, b), (c, d) in zip(RING, RING[1:] + RING[:1])) + ") e(x1, y1, x2, y2) WHERE (y1 > n.y) <> (y2 > n.y) AND n.x < (x2 - x1) * (n.y - y1) / (y2 - y1) + x1) % 2 = 1")
def cells_in_region(spark, sf_dir):
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("cell"), (F.lit(-60.0) + 5 * F.col("n_nationkey")).alias("lat"), (F.col("n_nationkey") * 37 % 120).cast("double").alias("lon"))
    return cells.where(align.in_polygon(cells, RING, 360.0)).select("cell")


@query("component_sum", "SELECT t, CASE WHEN count(value) = 2 THEN round(sum(value), 6) END AS total FROM (SELECT r_name, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT) AS t, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY ALL) GROUP BY t")
def component_sum(spark, sf_dir):
    regions = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    parts = table(spark, sf_dir, "orders").join(regions, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", months_since(F.col("o_orderdate")).alias("t")).agg(F.avg("o_totalprice").alias("value"))
    return align.component_sum(parts, ["t"], "r_name", "value", ["ASIA", "EUROPE"]).select("t", r("total").alias("total"))


@query("masked_band", "SELECT cell, t, CASE WHEN abs(lat) > 30 OR abs(lat) < 10 THEN round(value, 6) END AS value FROM cube", (CUBE,))
def masked_band(spark, sf_dir):
    return align.masked(orders_cube(spark, sf_dir), "value", align.outside_subtropics(F.col("lat"))).select("cell", "t", r("value").alias("value"))


@query("trimmed_series", "SELECT cell, t, round(value, 6) AS value FROM cube WHERE t BETWEEN 5 AND 66", (CUBE,))
def trimmed_series(spark, sf_dir):
    return align.trimmed(orders_cube(spark, sf_dir), "t", 5, 5, ["cell"]).select("cell", "t", r("value").alias("value"))


@query("misaligned_steps", "(SELECT cell, t FROM cube WHERE value IS NOT NULL EXCEPT SELECT CAST(r_regionkey AS BIGINT), CAST(x.t AS INT) FROM region CROSS JOIN (SELECT unnest(range(72)) AS t) x)", (CUBE,))
def misaligned_steps(spark, sf_dir):
    full = complete_orders_cube(spark, sf_dir).select("cell", "t")
    return align.misaligned(orders_cube(spark, sf_dir).where("value is not null or cell < 5"), full, ["cell", "t"])


@query(
    "unit_conversion",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'C' ELSE 'mm/day' END AS unit, round(CASE o_orderkey % 3 WHEN 0 THEN o_totalprice - 273.15 WHEN 1 THEN o_totalprice * 1e-9 * 86400000 ELSE o_totalprice / day(last_day(o_orderdate)) END, 6) AS value FROM orders",
)
def unit_conversion(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    unit = F.get(F.array(F.lit("K"), F.lit("m/s"), F.lit("mm/month")), (F.col("o_orderkey") % 3).cast("int"))
    rows = orders.select("o_orderkey", unit.alias("unit"), F.when(unit == "m/s", F.col("o_totalprice") * 1e-9).otherwise(F.col("o_totalprice")).alias("value"), F.col("o_orderdate").cast("date").alias("ts"))
    return rows.select("o_orderkey", units.converted_unit(F.col("unit")).alias("unit"), r(units.converted(F.col("value"), F.col("unit"), F.col("ts"))).alias("value"))


@query(
    "calendar_columns",
    "SELECT o_orderkey, CAST(last_day(o_orderdate) AS DATE) AS month_end, CAST(CAST(o_orderdate AS DATE) - 1 AS DATE) AS before, " + SEASON_OF.format(m="month(o_orderdate)") + " AS season, CAST(1920 + (o_orderkey % 600) // 12 AS INT) AS counter_year, CAST((o_orderkey % 600) % 12 + 1 AS INT) AS counter_month, CAST(year(o_orderdate) AS INT) AS decimal_year, CAST(month(o_orderdate) AS INT) AS decimal_month FROM orders",
)
def calendar_columns(spark, sf_dir):
    day, counter = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 600
    decimal = timeaxis.from_decimal_year(F.year(day) + (F.month(day) - 0.5) / 12)
    made = timeaxis.from_counter(counter)
    return table(spark, sf_dir, "orders").select("o_orderkey", timeaxis.month_end(F.year(day), F.month(day)).alias("month_end"), timeaxis.previous_day(day).alias("before"), timeaxis.season(F.month(day)).alias("season"), made[0].alias("counter_year"), made[1].alias("counter_month"), decimal[0].alias("decimal_year"), decimal[1].alias("decimal_month"))


# -- regression ----------------------------------------------------------------------------------------------


@query("monthly_ols_coeffs", "SELECT cell, CAST(month AS INT) AS month, predictor, round(beta, 3) AS beta FROM fit", (CUBE, DRIVERS, FIT))
def monthly_ols_coeffs(spark, sf_dir):
    return monthly_fit(spark, sf_dir).select("cell", "month", "predictor", r("beta", 3).alias("beta"))


@query("harmonic_smoothed_coeffs", "SELECT cell, CAST(month AS INT) AS month, predictor, round(beta, 3) AS beta FROM smooth", (CUBE, DRIVERS, FIT, SMOOTH))
def harmonic_smoothed_coeffs(spark, sf_dir):
    return regress.smoothed(monthly_fit(spark, sf_dir)).select("cell", "month", "predictor", r("beta", 3).alias("beta"))


@query("fitted_residuals", "SELECT cell, t, round(fitted, 3) AS fitted, round(residual, 3) AS residual FROM fits", (CUBE, DRIVERS, FIT, SMOOTH))
def fitted_residuals(spark, sf_dir):
    return all_fitted(spark, sf_dir)[1].select("cell", "t", r("fitted", 3).alias("fitted"), r("residual", 3).alias("residual"))


@query("forced_component", "SELECT cell, c.t, round(CASE WHEN ok THEN slope * gmt END, 3) AS forced FROM (SELECT cell, c.month, regr_slope(value, gmt) AS slope, count(value) = count(*) AS ok FROM cube c JOIN drivers d USING (t) GROUP BY ALL) f JOIN drivers c ON c.month = f.month", (CUBE, DRIVERS))
def forced_component(spark, sf_dir):
    own = modes(spark, sf_dir)
    fit = regress.monthly_fit(orders_cube(spark, sf_dir), regress.hat_table(own, ["constant", "gmt"]))
    return regress.forced(fit, own, "gmt").select("cell", "t", r("forced", 3).alias("forced"))


@query("origin_regression_pattern", "SELECT cell, CAST(c.month AS INT) AS month, round(sum(value * enso) / sum(enso * enso), 3) AS slope FROM cube c JOIN drivers d USING (t) WHERE value IS NOT NULL GROUP BY ALL", (CUBE, DRIVERS))
def origin_regression_pattern(spark, sf_dir):
    return regress.through_origin(orders_cube(spark, sf_dir), modes(spark, sf_dir), "enso", ["cell", "month"]).select("cell", "month", r("slope", 3).alias("slope"))


# -- normalisation -----------------------------------------------------------------------------------------

BOXCOX = """
x AS (SELECT cell, month, t, CASE WHEN value <= 0 THEN 1e-24 ELSE value END / 1000 AS x FROM cube),
llf AS (
  SELECT cell, month, lam, (lam - 1) * sum(ln(x)) - count(x) / 2.0 * ln(nullif(var_pop((pow(x, lam) - 1) / lam), 0)) AS llf FROM x CROSS JOIN (VALUES """ + ", ".join(f"({g!r}::DOUBLE)" for g in normalize.GRID) + """) g(lam) GROUP BY cell, month, lam
), best AS (SELECT cell, month, arg_max(lam, llf) AS lam FROM llf GROUP BY ALL)"""


@query("boxcox_lambda_grid", "SELECT cell, CAST(month AS INT) AS month, lam FROM best", (CUBE, BOXCOX))
def boxcox_lambda_grid(spark, sf_dir):
    return normalize.best_exponents(orders_cube(spark, sf_dir).withColumn("value", F.col("value") / 1000), ["cell", "month"]).select("cell", "month", "lam")


@query("boxcox_roundtrip", "SELECT x.cell, x.t, round((pow(x, lam) - 1) / lam, 6) AS normal, abs(pow(lam * ((pow(x, lam) - 1) / lam) + 1, 1 / lam) / x - 1) < 1e-9 AS comes_back FROM x JOIN best USING (cell, month)", (CUBE, BOXCOX))
def boxcox_roundtrip(spark, sf_dir):
    cube = orders_cube(spark, sf_dir).withColumn("value", F.col("value") / 1000)
    both = cube.join(normalize.best_exponents(cube, ["cell", "month"]), ["cell", "month"]).withColumn("normal", normalize.forward(normalize.cleared(F.col("value")), F.col("lam")))
    return both.select("cell", "t", r("normal", 6).alias("normal"), (F.abs(normalize.inverse(F.col("normal"), F.col("lam")) / F.col("value") - 1) < 1e-9).alias("comes_back"))


# -- bootstrap and synthesis ----------------------------------------------------------------------------------

LENGTHS = """
lags AS (SELECT cell, region, lat, month, value, lag(value) OVER (PARTITION BY cell, month ORDER BY year) AS last FROM cube),
rho AS (SELECT cell, region, lat, month, count(*) AS n, corr(value, last) AS rho FROM lags GROUP BY ALL),
lengths AS (SELECT cell, region, lat, CAST(month AS INT) AS month, rho, CASE WHEN rho IS NULL OR isnan(rho) OR rho <= -1 THEN floor(sqrt(n)) ELSE list_max(list_filter(range(0, n + 1), lambda l: l <= pow(n - l + 1, 2.0 / 3 * (1 - (1 - rho) / (1 + rho))))) END AS length FROM rho)"""


@query("wilks_block_size", "SELECT cell, month, CAST(length AS INT) AS length FROM lengths", (CUBE, LENGTHS))
def wilks_block_size(spark, sf_dir):
    rho = ensemble.lag_correlation(orders_cube(spark, sf_dir), ["cell", "month"])
    return rho.select("cell", "month", ensemble.block_length(F.col("n"), F.col("rho")).alias("length"))


@query("block_to_use", "SELECT CAST(greatest(1, max(q)) * 12 AS INT) AS block FROM (SELECT region, CAST(trunc(quantile_cont(length, 0.97)) AS INT) AS q FROM lengths WHERE abs(lat) > 30 OR abs(lat) < 10 GROUP BY region)", (CUBE, LENGTHS))
def block_to_use(spark, sf_dir):
    rho = ensemble.lag_correlation(orders_cube(spark, sf_dir), ["cell", "region", "lat", "month"])
    lengths = rho.withColumn("length", ensemble.block_length(F.col("n"), F.col("rho")))
    return ensemble.block_to_use(lengths, "region", align.outside_subtropics(F.col("lat")))


@query("bootstrap_members", "SELECT cell, CAST(member AS INT) AS member, CAST(t AS INT) AS t, round(noise, 3) AS noise FROM noise", (CUBE, DRIVERS, FIT, SMOOTH, DRAWS))
def bootstrap_members(spark, sf_dir):
    return noise(spark, all_fitted(spark, sf_dir)[1]).select("cell", "member", "t", r("noise", 3).alias("noise"))


SURROGATES = """
shifted AS (SELECT i.m AS member, d.t, d.month, e.enso, e.pdo_orth FROM (SELECT unnest(range(4)) AS m) i CROSS JOIN drivers d JOIN drivers e ON e.t = (d.t + 12 * (i.m + 1)) % 72),
surr AS (SELECT member, t, month, enso / stddev_pop(enso) OVER (PARTITION BY member) AS enso, pdo_orth / stddev_pop(pdo_orth) OVER (PARTITION BY member) AS pdo_orth FROM shifted)"""


def shifted_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for surrogates that SQL can make as well: the modes, moved round by whole years."""
    own = modes(spark, sf_dir)
    moved = own.select("t", "enso", "pdo_orth").withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1))))
    moved = moved.withColumn("t", F.pmod(F.col("t") - 12 * (F.col("member") + 1), F.lit(MONTHS)))
    return ensemble.rescaled(moved.withColumn("month", (F.col("t") % 12 + 1).cast("int")), ["enso", "pdo_orth"])


@query("synthetic_members", "SELECT 'full' AS kind, cell, CAST(member AS INT) AS member, CAST(noise.t AS INT) AS t, round(b0 + noise + b1 * enso + b2 * pdo_orth, 5) AS value FROM noise JOIN surr USING (member, t) JOIN wide USING (cell, month) UNION ALL SELECT 'noise', cell, CAST(member AS INT), CAST(noise.t AS INT), round(fitted + noise, 5) FROM noise JOIN fits USING (cell, t)", (CUBE, DRIVERS, FIT, SMOOTH, DRAWS, SURROGATES))
def synthetic_members(spark, sf_dir):
    fit, fits = all_fitted(spark, sf_dir)
    own = noise(spark, fits)
    full = ensemble.members(own, fit, shifted_modes(spark, sf_dir), ["enso", "pdo_orth"])
    kinds = align.stacked({"full": full, "noise": ensemble.noise_members(own, fits)}, "kind")
    return kinds.select("kind", "cell", "member", "t", r("value", 5).alias("value"))


@query("ensemble_mean_signal", "SELECT region, t, round(m - avg(m) OVER (PARTITION BY region), 3) AS mean FROM (SELECT region, t, avg(value) AS m FROM cube GROUP BY ALL)", (CUBE,))
def ensemble_mean_signal(spark, sf_dir):
    return ensemble.ensemble_mean(orders_cube(spark, sf_dir), ["region", "t"], demean_by=["region"]).select("region", "t", r("mean", 3).alias("mean"))


# -- filters -----------------------------------------------------------------------------------------------


@query("hann_smooth", "SELECT t, round(0.25 * lag(v) OVER w + 0.5 * v + 0.25 * lead(v) OVER w, 6) AS smooth FROM (SELECT t, amo AS v FROM drivers) WINDOW w AS (ORDER BY t) QUALIFY lag(v, 2) OVER w IS NOT NULL AND lead(v, 2) OVER w IS NOT NULL", (DRIVERS,))
def hann_smooth(spark, sf_dir):
    return linop.hann_smoothed(modes(spark, sf_dir).select("t", "amo"), 4, "amo").select("t", r("smooth", 6).alias("smooth"))


def _values(matrix) -> str:
    return "w AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {float(x)!r}::DOUBLE)" for i, row in enumerate(matrix) for j, x in enumerate(row)) + ") v(t_out, t_in, w))"


@query("lowpass_index", "SELECT CAST(t_out AS INT) AS t, round(sum(amo * w), 6) AS low FROM drivers JOIN w ON t_in = t GROUP BY t_out", (DRIVERS, _values(linop.filter_matrix(MONTHS, 3, 0.1))))
def lowpass_index(spark, sf_dir):
    rows = modes(spark, sf_dir).select(F.lit(0).alias("cell"), "t", "amo")
    return linop.applied(rows, linop.weight_table(spark, linop.filter_matrix(MONTHS, 3, 0.1)), ["cell"], "amo").select("t", r("filtered", 6).alias("low"))


@query("band_variance", "SELECT l.cell, round(var_low, 2) AS var_low, round(var_high, 2) AS var_high FROM (SELECT cell, var_pop(f) AS var_low FROM (SELECT cell, t_out, CASE WHEN count(value) = 72 THEN sum(value * w) END AS f FROM cube JOIN w ON t_in = t WHERE t_out BETWEEN 5 AND 66 GROUP BY ALL) GROUP BY cell) l JOIN (SELECT cell, var_pop(f) AS var_high FROM (SELECT cell, t_out, CASE WHEN count(value) = 72 THEN sum(value * w) END AS f FROM cube JOIN high ON t_in = t WHERE t_out BETWEEN 5 AND 66 GROUP BY ALL) GROUP BY cell) h ON h.cell = l.cell", (CUBE, _values(linop.filter_matrix(MONTHS, 3, 0.2, reflect=True)), _values(linop.filter_matrix(MONTHS, 3, 0.2, "high", reflect=True)).replace("w AS", "high AS", 1)))
def band_variance(spark, sf_dir):
    return metrics.band_variance(orders_cube(spark, sf_dir), ["cell"], MONTHS).select("cell", r("var_low", 2).alias("var_low"), r("var_high", 2).alias("var_high"))


# -- surrogates, spectra, components (no SQL) --------------------------------------------------------------


def mode_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = modes(spark, sf_dir)
    return align.stacked({m: own.select("t", F.col(m).alias("value")) for m in ("enso", "pdo_orth", "amo")}, "mode")


@query("iaaft_surrogates")
def iaaft_surrogates(spark, sf_dir):
    return spectra.surrogates(mode_series(spark, sf_dir), MEMBERS, cycle={"enso": 12})


@query("multitaper_spectrum")
def multitaper_spectrum(spark, sf_dir):
    return spectra.spectra(mode_series(spark, sf_dir), {"mode": "string"}, 1 / 12)


@query("surrogate_envelope")
def surrogate_envelope(spark, sf_dir):
    own = spectra.surrogates(mode_series(spark, sf_dir), 20)
    return spectra.envelope(spectra.spectra(own, {"mode": "string", "member": "int"}, 1 / 12), ["mode", "k", "frequency"])


@query("lfca_components")
def lfca_components(spark, sf_dir):
    cube = orders_cube(spark, sf_dir)
    rows = cube.select("cell", "t", F.lit(0).alias("member"), F.sqrt(align.cos_weight(F.col("lat"))).alias("weight"), (F.col("value") - F.avg("value").over(Window.partitionBy("cell", "month"))).alias("value"))
    patterns, series = spectra.low_frequency_components(rows, ["member"], MONTHS, 10, 3, 0.05)
    return align.stacked({"pattern": patterns.select("component", F.col("cell").alias("at"), F.col("pattern").alias("value")), "series": series.select("component", F.col("t").cast("long").alias("at"), "value")}, "kind")


# -- members, exponents, runs ---------------------------------------------------------------------------------

MEMBERS_CUBE = """
members AS (
  SELECT CAST(k.m AS INT) AS member, CAST(r_regionkey AS BIGINT) AS cell, CAST(x.t AS INT) AS t, 1995 + x.t // 12 AS year, x.t % 12 + 1 AS month, g.value
  FROM region CROSS JOIN (SELECT unnest(range(1, 6)) AS m) k CROSS JOIN (SELECT unnest(range(72)) AS t) x
  LEFT JOIN (SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS m, n_regionkey AS c, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS t, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1, 2, 3) g ON g.m = k.m AND g.c = r_regionkey AND g.t = x.t
)"""


@query("forced_signal", "SELECT cell, t, round(m - avg(m) OVER (PARTITION BY cell), 3) AS forced FROM (SELECT cell, t, avg(value - 273.15) AS m FROM members WHERE member IN (1, 2, 3, 5) GROUP BY ALL)", (MEMBERS_CUBE,))
def forced_signal(spark, sf_dir):
    cube = members_cube(spark, sf_dir)
    runs = ensemble.continued(cube.where("year < 1998"), cube.where("year >= 1998"), ensemble.member_ids((1, 3), (5, 5)))
    kelvin = lambda v: units.converted(v, F.lit("K"), F.lit("2000-01-01").cast("date"))
    return ensemble.forced_signal(runs, ["cell"], kelvin).select("cell", "t", r("forced", 3).alias("forced"))


@query("nested_metric_mean", "SELECT cell, metric, round(avg(value), 6) AS value FROM (SELECT member, cell, 'IQ_range' AS metric, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS value FROM members GROUP BY ALL UNION ALL SELECT member, cell, 'max_val', max(value) FROM members GROUP BY ALL) GROUP BY ALL", (MEMBERS_CUBE,))
def nested_metric_mean(spark, sf_dir):
    own = metrics.named(members_cube(spark, sf_dir), ["member", "cell"], ["IQ_range", "max_val"])
    return ensemble.nested_mean(own, ["cell", "metric"]).select("cell", "metric", r("value").alias("value"))


@query("named_metrics", "SELECT cell, season, 'IQ_range' AS metric, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS value FROM seasonal GROUP BY ALL UNION ALL SELECT cell, season, 'max_val', round(max(value), 6) FROM seasonal GROUP BY ALL UNION ALL SELECT cell, season, return_period || 'yr_event', round(level, 6) FROM levels WHERE return_period <> 3", (CUBE, SEASONS, _levels("cell, season", "seasonal")))
def named_metrics(spark, sf_dir):
    return metrics.named(seasonal(orders_cube(spark, sf_dir)), ["cell", "season"], ["IQ_range", "max_val", "33yr_event", "150yr_event"]).select("cell", "season", "metric", r("value").alias("value"))


REFINED = BOXCOX.replace("best AS (", "best0 AS (") + "".join(f""", near{k} AS (
  SELECT x.cell, x.month, g.lam, (g.lam - 1) * sum(ln(x)) - count(x) / 2.0 * ln(nullif(var_pop((pow(x, g.lam) - 1) / g.lam), 0)) AS llf
  FROM x JOIN (SELECT DISTINCT cell, month, greatest(0.001::DOUBLE, least(1.0::DOUBLE, lam + {step}::DOUBLE * (k / 10.0::DOUBLE))) AS lam FROM best{k} CROSS JOIN (SELECT unnest(range(-10, 11)) AS k)) g ON g.cell = x.cell AND g.month = x.month GROUP BY x.cell, x.month, g.lam
), best{k + 1} AS (SELECT cell, month, arg_max(lam, llf) AS lam FROM near{k} GROUP BY ALL)""" for k, step in enumerate((0.05, 0.005)))


@query("boxcox_refined", "SELECT cell, CAST(month AS INT) AS month, round(lam, 4) AS lam FROM best2", (CUBE, REFINED))
def boxcox_refined(spark, sf_dir):
    cube = orders_cube(spark, sf_dir).withColumn("value", F.col("value") / 1000)
    return normalize.best_exponents(cube, ["cell", "month"], refine=2).select("cell", "month", r("lam", 4).alias("lam"))


MEMBER_BOXCOX = BOXCOX.replace("SELECT cell, month, t, CASE", "SELECT member, cell, month, t, CASE").replace("FROM cube)", "FROM members)").replace("SELECT cell, month, lam, (lam", "SELECT cell, month, lam, (lam").replace("FROM x CROSS JOIN", "FROM (SELECT * FROM x WHERE member = 1) x CROSS JOIN")


@query("borrowed_exponents", "SELECT member, x.cell, x.t, round((pow(x, lam) - 1) / lam, 6) AS value FROM x JOIN best USING (cell, month)", (MEMBERS_CUBE, MEMBER_BOXCOX))
def borrowed_exponents(spark, sf_dir):
    cube = members_cube(spark, sf_dir).withColumn("value", F.col("value") / 1000)
    lam = normalize.borrowed(normalize.best_exponents(cube, ["member", "cell", "month"]), 1, ["cell", "month"])
    return normalize.transform(cube, lam, ["cell", "month"], "boxcox").select("member", "cell", "t", r("value").alias("value"))


NORMAL_FIT = FIT.replace("value AS y", "(pow(CASE WHEN value <= 0 THEN 1e-24 ELSE value END / 1000, lam) - 1) / lam AS y").replace("cube c JOIN drivers d USING (t)", "cube c JOIN best USING (cell, month) JOIN drivers d USING (t)")
NORMAL_SMOOTH = SMOOTH.replace("cube.month, value, b0", "cube.month, (pow(value / 1000, lam) - 1) / lam AS value, b0").replace("value - (b0", "(pow(value / 1000, lam) - 1) / lam - (b0").replace("FROM cube JOIN wide USING (cell, month)", "FROM cube JOIN best USING (cell, month) JOIN wide USING (cell, month)")
INVERSE = "CASE WHEN v IS NOT NULL THEN CASE WHEN isnan(pow(lam * v + 1, 1 / lam)) THEN 0 ELSE pow(lam * v + 1, 1 / lam) END END"


@query(
    "transformed_members",
    f"SELECT cell, CAST(member AS INT) AS member, CAST(t AS INT) AS t, round({INVERSE}, 3) AS value FROM (SELECT cell, member, noise.t, lam, b0 + noise + b1 * enso + b2 * pdo_orth + f.slope * d.gmt AS v FROM noise JOIN surr USING (member, t) JOIN wide USING (cell, month) JOIN best USING (cell, month) JOIN (SELECT cell, month, slope FROM forcing) f USING (cell, month) JOIN (SELECT t, gmt FROM drivers) d ON d.t = noise.t)",
    (CUBE, DRIVERS, BOXCOX, NORMAL_FIT, NORMAL_SMOOTH, DRAWS, SURROGATES, "forcing AS (SELECT cell, c.month, CASE WHEN count(value) = count(*) THEN regr_slope((pow(value / 1000, lam) - 1) / lam, gmt) END AS slope FROM cube c JOIN best USING (cell, month) JOIN drivers d USING (t) GROUP BY ALL)"),
)
def transformed_members(spark, sf_dir):
    """The chain of a transformed variable: exponents, fit, residuals, draws, members with the forced term, transformed back."""
    cube = orders_cube(spark, sf_dir).withColumn("value", F.col("value") / 1000)
    lam = normalize.best_exponents(cube, ["cell", "month"])
    normal = normalize.transform(cube, lam, ["cell", "month"], "boxcox")
    own = modes(spark, sf_dir)
    fit = regress.smoothed(regress.monthly_fit(normal, regress.hat_table(own, PREDICTORS)))
    forced = regress.forced(regress.monthly_fit(normal, regress.hat_table(own, ["constant", "gmt"])), own, "gmt")
    draws = noise(spark, regress.fitted(normal, fit, own, PREDICTORS))
    full = ensemble.members(draws, fit, shifted_modes(spark, sf_dir), ["enso", "pdo_orth"], forced)
    back = normalize.transform(full.withColumn("month", (F.col("t") % 12 + 1).cast("int")), lam, ["cell", "month"], "boxcox", back=True)
    return back.select("cell", "member", "t", r("value", 3).alias("value"))


RESIDUAL_LENGTHS = """
rlags AS (SELECT f.cell, f.month, f.t, residual, lag(residual) OVER (PARTITION BY f.cell, f.month ORDER BY f.t) AS last FROM fits f JOIN (SELECT cell FROM cube GROUP BY cell HAVING arg_max_null(value, t) IS NOT NULL) h ON h.cell = f.cell),
rrho AS (SELECT cell, month, count(*) AS n, corr(residual, last) AS rho FROM rlags GROUP BY ALL)"""


@query("residual_block_length", "SELECT cell, CAST(month AS INT) AS month, CAST(CASE WHEN rho IS NULL OR isnan(rho) OR rho <= -1 THEN floor(sqrt(n)) ELSE list_max(list_filter(range(0, n + 1), lambda l: l <= pow(n - l + 1, 2.0 / 3 * (1 - (1 - rho) / (1 + rho))))) END AS INT) AS length FROM rrho", (CUBE, DRIVERS, FIT, SMOOTH, RESIDUAL_LENGTHS))
def residual_block_length(spark, sf_dir):
    """Lengths from residuals, for cells whose last step has a value."""
    there = align.ends(orders_cube(spark, sf_dir), ["cell"]).where("has_data").select("cell")
    residuals = all_fitted(spark, sf_dir)[1].join(there, "cell", "left_semi")
    rho = ensemble.lag_correlation(residuals, ["cell", "month"], order="t", value="residual")
    return rho.select("cell", "month", ensemble.block_length(F.col("n"), F.col("rho")).alias("length"))


# -- ends, heads, keys, regions -------------------------------------------------------------------------------


@query("series_ends", "SELECT cell, round(arg_min_null(value, t), 6) AS first_value, round(arg_max_null(value, t), 6) AS last_value, arg_max_null(value, t) IS NOT NULL AS has_data, count(value) AS n_values, count(DISTINCT CASE WHEN value IS NOT NULL THEN year END) AS n_years FROM cube GROUP BY cell", (CUBE,))
def series_ends(spark, sf_dir):
    cube = orders_cube(spark, sf_dir)
    years = cube.where("value is not null").select("cell", "year").distinct().groupBy("cell").agg(F.count("*").alias("n_years"))
    return align.ends(cube, ["cell"]).join(years, "cell", "left").select("cell", r("first_value").alias("first_value"), r("last_value").alias("last_value"), "has_data", "n_values", F.coalesce("n_years", F.lit(0).cast("long")).alias("n_years"))


@query("aligned_head", "SELECT cell, CAST(t - 3 AS INT) AS t, CAST(month AS INT) AS month, round(value, 6) AS value FROM cube WHERE t BETWEEN 3 AND 26", (CUBE,))
def aligned_head(spark, sf_dir):
    return align.from_first(orders_cube(spark, sf_dir), F.col("month") == 4, 24, by=["cell"]).select("cell", "t", "month", r("value").alias("value"))


@query("climatology_added_back", "SELECT cell, t, round(value - avg(value) OVER (PARTITION BY cell, month) + avg(value) OVER (PARTITION BY cell, month), 4) AS value FROM cube", (CUBE,))
def climatology_added_back(spark, sf_dir):
    cube = orders_cube(spark, sf_dir)
    mean = cube.groupBy("cell", "month").agg(F.avg("value").alias("mean"))
    departures = cube.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("cell", "month")))
    return units.with_climatology(departures, mean, ["cell"]).select("cell", "t", r("value", 4).alias("value"))


@query("month_end_range", "SELECT CAST(n_nationkey AS BIGINT) AS cell, CAST(last_day(DATE '1999-11-15' + to_months(CAST(k AS INT))) AS DATE) AS month_end FROM nation CROSS JOIN (SELECT unnest(range(25)) AS k) WHERE k < n_nationkey + 1")
def month_end_range(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("cell"), F.explode(timeaxis.month_ends(F.lit("1999-11-15").cast("date"), F.col("n_nationkey") + 1)).alias("month_end"))


@query("half_even_rounding", "SELECT o_orderkey, round_even(o_orderkey * 0.125::DOUBLE, 2) AS value, o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1997-12-31' AS inside FROM orders")
def half_even_rounding(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", timeaxis.rounded(F.col("o_orderkey") * F.lit(0.125), 2).alias("value"), timeaxis.within(F.col("o_orderdate"), "1996-03", "1997").alias("inside"))


@query("rounded_key_join", "SELECT CAST(n_nationkey AS BIGINT) AS cell, t, round(value, 6) AS value FROM cube JOIN nation ON cell = n_nationkey WHERE year IN (SELECT DISTINCT year(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')", (CUBE,))
def rounded_key_join(spark, sf_dir):
    """Two grids whose latitudes differ in the last digits, joined; years by a semi-join to the years that there are."""
    cells = align.rounded_keys(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("own"), (F.lit(-60.0) + 5 * F.col("n_nationkey") + 1e-7).alias("lat")), "lat")
    years = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select(F.year("o_orderdate").alias("year"))
    cube = align.in_years(align.rounded_keys(orders_cube(spark, sf_dir), "lat"), years)
    return cube.join(cells, "lat").select(F.col("own").alias("cell"), "t", r("value").alias("value"))


@query("merged_variables", "SELECT CAST(coalesce(f.cell, o.cell) AS BIGINT) AS cell, CAST(coalesce(f.t, o.t) AS INT) AS t, f.n AS filled, o.n AS open FROM (SELECT c_nationkey AS cell, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS t, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL) f FULL JOIN (SELECT c_nationkey AS cell, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS t, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY ALL) o ON o.cell = f.cell AND o.t = f.t")
def merged_variables(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("long").alias("cell"), months_since(F.col("o_orderdate")).alias("t"), "o_orderstatus").agg(F.count("*").alias("value"))
    return files.merged({name: rows.where(F.col("o_orderstatus") == s) for name, s in (("filled", "F"), ("open", "O"))}, ["cell", "t"])


@query(
    "regional_season_mean",
    "SELECT label, round(sum(value * w) / sum(w), 6) AS mean FROM (SELECT label, value, least(greatest(cos(radians(-60.0 + 5 * cell)), 0), 1) AS w FROM seasonal n WHERE season = 'DJF' AND season_year BETWEEN 1996 AND 2000 AND (SELECT count(*) FROM (VALUES " + ", ".join(f"({a + 360}, {b}, {c + 360}, {d})" for (a, b), (c, d) in zip(RING, RING[1:] + RING[:1])) + ") e(x1, y1, x2, y2) WHERE (y1 > -60.0 + 5 * n.cell) <> (y2 > -60.0 + 5 * n.cell) AND (n.cell * 37) % 120 < (x2 - x1) * (-60.0 + 5 * n.cell - y1) / (y2 - y1) + x1) % 2 = 1) GROUP BY label",
    (CUBE, SEASONS),
)
def regional_season_mean(spark, sf_dir):
    """Seasonal means over the cells in a polygon, weighted by the cosine of latitude."""
    rows = seasonal(orders_cube(spark, sf_dir)).where((F.col("season") == "DJF") & F.col("season_year").between(1996, 2000)).withColumns({"lat": F.lit(-60.0) + 5 * F.col("cell"), "lon": (F.col("cell") * 37 % 120).cast("double")})
    inside = rows.where(align.in_polygon(rows, RING, 360.0))
    return align.weighted_mean(inside, ["label"], "value", align.cos_weight(F.col("lat"))).select("label", r("mean").alias("mean"))


HANN21 = """
hann AS (SELECT k, (0.5 - 0.5 * cos(2 * pi() * (k + 10) / 20)) / 10 AS w FROM (SELECT unnest(range(-10, 11)) AS k)),
smooth_amo AS (SELECT d.t, sum(e.amo * w) AS x FROM drivers d JOIN hann ON TRUE JOIN drivers e ON e.t = d.t + k GROUP BY d.t HAVING count(*) = 21),
index21 AS (SELECT t, x / stddev_pop(x) OVER () AS x FROM smooth_amo)"""


@query("mode_pattern", "SELECT cell, lon, CAST(month AS INT) AS month, round(sum(a * x) / sum(x * x), 3) AS slope FROM (SELECT cell, (cell * 37 - 180 + 360) % 360 AS lon, t, month, CASE WHEN avg(value) OVER (PARTITION BY cell, month) >= 140000 THEN value - avg(value) OVER (PARTITION BY cell, month) END AS a FROM cube) c JOIN index21 USING (t) WHERE a IS NOT NULL GROUP BY ALL", (CUBE, DRIVERS, HANN21))
def mode_pattern(spark, sf_dir):
    """Regression through the origin of departures on a smoothed index of unit deviation, without the cells and months whose climatology is below a threshold, on longitudes from 0 to 360."""
    mean = F.avg("value").over(Window.partitionBy("cell", "month"))
    cube = orders_cube(spark, sf_dir).withColumn("_mean", mean)
    own = align.masked(cube.withColumn("value", F.col("value") - F.col("_mean")), "value", F.col("_mean") >= 140000)
    smooth = linop.hann_smoothed(modes(spark, sf_dir).select("t", "amo"), 21, "amo").select("t", F.col("smooth").alias("index"))
    slope = regress.through_origin(own, regress.standardised(smooth, ["index"]), "index", ["cell", "month"])
    return slope.select("cell", align.recentred(F.col("cell") * 37 - 180).alias("lon"), "month", r("slope", 3).alias("slope"))


@query("surrogate_modes")
def surrogate_modes(spark, sf_dir):
    """Surrogates of all modes; the slow one is filtered again."""
    return spectra.low_passed(spectra.surrogates(mode_series(spark, sf_dir), MEMBERS, cycle={"enso": 12}), ["amo"], MONTHS, 0.05)


#: The survey's inventory numbers that each query exercises. Unit tests alone cover A4, A6 to A12, A14, B1 to B7, C1, D13, G1, L2, N8 (sources, store, runs, transforms).
COVERS = {
    "season_summary": "A1 A2 A3 E6 E7 E11 F8",
    "return_levels": "F8 F11 G3 G4 D7",
    "pooled_return_levels": "E15 C19",
    "monthly_climatology": "E3",
    "monthly_anomaly": "D4 E2",
    "seasonal_mean_qsdec": "E11 I9 I10 I11",
    "season_year_filter": "C5 C8 I11",
    "metric_pivot": "C20 D7",
    "stacked_metrics": "H2 H3",
    "hourly_climatology": "A1 E3",
    "lagged_predictors": "F1 D1 C12 C4",
    "gram_schmidt_index": "N1 E10",
    "standardised_modes": "E4",
    "nearest_cell_series": "C16 N17",
    "area_weighted_region_mean": "E9 I3",
    "cells_in_region": "D10",
    "component_sum": "D6 D7",
    "masked_band": "C9 C10",
    "trimmed_series": "C12 C15 F7",
    "misaligned_steps": "D11",
    "unit_conversion": "I16 I18 I20",
    "calendar_columns": "I1 I5 I9 I12 I13 I14 I15",
    "monthly_ols_coeffs": "N2 E17 C6",
    "harmonic_smoothed_coeffs": "N3 I6 I17 C3",
    "fitted_residuals": "N4 D2 D3 D5 D12 C2",
    "forced_component": "N5",
    "origin_regression_pattern": "N19",
    "boxcox_lambda_grid": "N6 I4 I8 E12",
    "boxcox_roundtrip": "N7 I2 I7",
    "wilks_block_size": "N10 E8 F2",
    "block_to_use": "E14 N10",
    "bootstrap_members": "N13 D9 F10 L1",
    "synthetic_members": "N14 C13 C21",
    "ensemble_mean_signal": "E1 E2",
    "hann_smooth": "F3",
    "lowpass_index": "F4",
    "band_variance": "F6 F7 E5 N20",
    "iaaft_surrogates": "N11 F9 L3 L4",
    "multitaper_spectrum": "N15",
    "surrogate_envelope": "E16",
    "lfca_components": "N16 E18 F5 G6",
    "forced_signal": "N18 H4 H5 E1 E2",
    "nested_metric_mean": "E19 I24",
    "named_metrics": "N20 I22 I23 I24",
    "boxcox_refined": "N6",
    "borrowed_exponents": "N9 N7",
    "transformed_members": "N14 N5 N7 N9",
    "residual_block_length": "N10 C11",
    "series_ends": "C11 E13 F12 F13",
    "aligned_head": "C14 G5",
    "climatology_added_back": "I21",
    "month_end_range": "I15",
    "half_even_rounding": "I1 C7",
    "rounded_key_join": "C17 D8",
    "merged_variables": "A5",
    "regional_season_mean": "N21 E9 D10 E11",
    "mode_pattern": "N19 F3 G2 B9",
    "surrogate_modes": "N12 L3",
}
