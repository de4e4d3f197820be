"""More queries with their SQL, registered in the catalogue when this is imported: joint variables, order statistics, regions, nearest cells, spectra, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import units
from ..operators import align, ensemble, linop, metrics, normalize, regress, spectra
from ..sources import regions
from ..sources.cubes import MONTHS, events_cube, members_cube, orders_cube, table
from . import products
from .catalogue import COVERS, CUBE, DRIVERS, FIT, MEMBERS, MEMBERS_CUBE, PREDICTORS, RESIDUAL_LENGTHS, SMOOTH, _values, mode_series, modes, query, r

# -- several variables in one plan ------------------------------------------------------------------------------

#: Two variables under one key: mean values as logarithms, and counts as they are.
JOINT = CUBE.replace("cube AS", "cube0 AS", 1) + """, counts AS (
  SELECT c_nationkey AS cell, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS t, CAST(count(*) AS DOUBLE) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1, 2
), cube AS (
  SELECT 'order_value/' || cell AS cell, lat, t, year, month, ln(CASE WHEN value <= 0 THEN 1e-24 ELSE value / 1000 END) AS value FROM cube0
  UNION ALL SELECT 'order_count/' || c.cell, lat, c.t, year, month, n FROM cube0 c LEFT JOIN counts k ON k.cell = c.cell AND k.t = c.t
)"""
JOINT_BLOCK = """
jlengths AS (
  SELECT split_part(r.cell, '/', 1) AS variable, CASE WHEN rho IS NULL OR isnan(rho) OR rho <= -1 THEN floor(sqrt(n)) ELSE list_max(list_filter(range(0, n + 1), lambda l: l <= pow(n - l + 1, 2.0 / 3 * (1 - (1 - rho) / (1 + rho))))) END AS length FROM rrho r JOIN (SELECT DISTINCT cell, lat FROM cube) USING (cell) WHERE abs(lat) > 30 OR abs(lat) < 10
), jblock AS (SELECT least(72, CAST(greatest(1, max(q)) * 12 AS INT)) AS block FROM (SELECT variable, CAST(trunc(quantile_cont(length, 0.97)) AS INT) AS q FROM jlengths GROUP BY variable))"""
JOINT_NOISE = f"""
draws AS (
  SELECT m.m AS member, b.b AS block_no, block, CAST(CAST('0x' || substr(md5(concat_ws('-', 123, m.m, b.b)), 1, 8) AS BIGINT) % 6 * 12 AS INT) AS start FROM jblock CROSS JOIN (SELECT unnest(range({MEMBERS})) AS m) m CROSS JOIN (SELECT unnest(range(72)) AS b) b WHERE b.b < ceil(72 / block)
), idx AS (SELECT member, block_no * block + k AS t, (start + k) % 72 AS from_t FROM draws CROSS JOIN (SELECT unnest(range(72)) AS k) WHERE k < block AND block_no * block + k < 72),
noise AS (SELECT cell, member, idx.t, residual AS noise FROM fits JOIN idx ON fits.t = from_t),
turned AS (SELECT i.m AS member, (d.t + 12 * (i.m + 1) + 2) % 72 AS t, enso, pdo_orth FROM drivers d CROSS JOIN (SELECT unnest(range({MEMBERS})) AS m) i),
surr AS (SELECT member, t, enso / stddev_pop(enso) OVER (PARTITION BY member) AS enso, pdo_orth / stddev_pop(pdo_orth) OVER (PARTITION BY member) AS pdo_orth FROM turned)"""
LAG = 2


def joint_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (a struct of variable and cell), lat, t, month, value."""
    cube = orders_cube(spark, sf_dir)
    parts = {"order_value": normalize.log_forward(F.col("value") / 1000), "order_count": F.col("n_orders").cast("double")}
    return align.stacked({v: cube.select("cell", "lat", "t", "month", c.alias("value")) for v, c in parts.items()}, "variable").select(F.struct("variable", "cell").alias("series"), "lat", "t", "month", "value")


@query(
    "joint_members",
    "SELECT split_part(cell, '/', 1) AS variable, CAST(split_part(cell, '/', 2) AS BIGINT) AS cell, kind, CAST(member AS INT) AS member, CAST(t AS INT) AS t, round(CASE WHEN cell LIKE 'order_value%' THEN coalesce(exp(v), 0) ELSE v END, 2) AS value FROM (SELECT cell, 'full' AS kind, member, noise.t, b0 + noise + b1 * enso + b2 * pdo_orth AS v FROM noise JOIN surr USING (member, t) JOIN wide ON wide.cell = noise.cell AND month = noise.t % 12 + 1 UNION ALL SELECT cell, 'noise', member, noise.t, fitted + noise FROM noise JOIN fits USING (cell, t))".replace("SELECT cell, 'full'", "SELECT noise.cell, 'full'"),
    (JOINT, DRIVERS, FIT, SMOOTH, RESIDUAL_LENGTHS, JOINT_BLOCK, JOINT_NOISE),
)
def joint_members(spark, sf_dir):
    """Members of two variables: own transforms, the larger block of the two, one draw and one set of lagged modes for both."""
    cube, own = joint_cube(spark, sf_dir), modes(spark, sf_dir)
    fit = regress.smoothed(regress.monthly_fit(cube, regress.hat_table(own, PREDICTORS), "series"), "series")
    fits = regress.fitted(cube.drop("lat"), fit, own, PREDICTORS, "series")
    there = align.ends(cube, ["series"]).where("has_data").select("series")
    rho = ensemble.lag_correlation(fits.join(there, "series", "left_semi"), ["series", "month"], order="t", value="residual").join(cube.select("series", "lat").distinct(), "series")
    lengths = rho.select("series.variable", "lat", ensemble.block_length(F.col("n"), F.col("rho")).alias("length"))
    block = min(MONTHS, ensemble.block_to_use(lengths, "variable", align.outside_subtropics(F.col("lat"))).first()["block"])
    noise = ensemble.bootstrapped(fits, ensemble.resampling(ensemble.hashed_starts(spark, MEMBERS, MONTHS, block), MONTHS, block), "series")
    names = ["enso", "pdo_orth"]
    moved = own.select("t", *names).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1)))).withColumn("t", F.pmod(F.col("t") + 12 * (F.col("member") + 1), F.lit(MONTHS)))
    surrogates = ensemble.rescaled(ensemble.turned(moved, LAG, MONTHS).withColumn("month", (F.col("t") % 12 + 1).cast("int")), names)
    kinds = align.stacked({"full": ensemble.members(noise, fit, surrogates, names, cell="series"), "noise": ensemble.noise_members(noise, fits, "series")}, "kind")
    value = F.when(F.col("series.variable") == "order_value", normalize.log_inverse(F.col("value"))).otherwise(F.col("value"))
    return kinds.select("series.variable", "series.cell", "kind", "member", "t", r(value, 2).alias("value"))


# -- order statistics of pooled values --------------------------------------------------------------------------

POOLED = """
pooled AS (SELECT n_regionkey AS region, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
POOLED_LEVELS = """
ranked AS (SELECT region, value, count(*) OVER (PARTITION BY region) AS n, row_number() OVER (PARTITION BY region ORDER BY value DESC) AS k FROM pooled),
wanted AS (SELECT *, greatest(1, least(n, CAST(floor(0.44 + (n + 0.12) / p) AS BIGINT))) AS k1 FROM ranked CROSS JOIN (VALUES (3), (33), (150), (100000)) v(p))"""


def pooled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("long").alias("region"))
    return table(spark, sf_dir, "orders").join(nations, F.col("o_custkey") == F.col("c_custkey")).select("region", F.col("o_totalprice").alias("value"))


@query("pooled_order_levels", "SELECT CAST(region AS BIGINT) AS region, CAST(p AS INT) AS return_period, round(value, 6) AS level FROM wanted WHERE k = CASE WHEN abs((n + 0.12) / (least(n, k1 + 1) - 0.44) - p) < abs((n + 0.12) / (k1 - 0.44) - p) THEN least(n, k1 + 1) ELSE k1 END", (POOLED, POOLED_LEVELS))
def pooled_order_levels(spark, sf_dir):
    """Return levels of all orders of a region, none of which has its orders in one task."""
    return metrics.pooled_return_levels(pooled_orders(spark, sf_dir), ["region"], [3, 33, 150, 100_000]).select("region", "return_period", r("level").alias("level"))


@query("pooled_order_quantiles", "SELECT CAST(region AS BIGINT) AS region, p AS probability, round(v, 6) AS quantile FROM (SELECT region, unnest([0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]::DOUBLE[]) AS p, unnest(quantile_cont(value, [0, 0.025, 0.25, 0.5, 0.75, 0.975, 1])) AS v FROM pooled GROUP BY region)", (POOLED,))
def pooled_order_quantiles(spark, sf_dir):
    return metrics.pooled_quantiles(pooled_orders(spark, sf_dir), ["region"], [0, 0.025, 0.25, 0.5, 0.75, 0.975, 1]).select("region", "probability", r("quantile").alias("quantile"))


# -- regions and nearest cells ------------------------------------------------------------------------------------

#: Two regions as (region, ring, vertices): one of two polygons, the first with a hole; longitudes are moved by 360.
RINGS = [
    ("basin", 0, [(-350.0, -50.0), (-250.0, -50.0), (-240.0, 10.0), (-300.0, 55.0), (-355.0, 20.0)]),
    ("basin", 1, [(-320.0, -20.0), (-290.0, -20.0), (-290.0, 5.0), (-320.0, 5.0)]),
    ("basin", 2, [(-200.0, -30.0), (-160.0, 0.0), (-200.0, 30.0)]),
    ("coast", 0, [(-270.0, -60.0), (-210.0, -60.0), (-210.0, 60.0), (-240.0, 60.0), (-255.0, 0.0)]),
]
EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"('{name}', {a + 360}, {b}, {c + 360}, {d})" for name, _, ring in RINGS for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])) + ") e(region, x1, y1, x2, y2))"
#: Customers as cells of a fine grid.
GRID = "grid AS (SELECT CAST(c_custkey AS BIGINT) AS cell, -60 + (c_custkey * 7919 % 1200) / 10.0 AS lat, (c_custkey * 104729 % 2400) / 10.0 AS lon, c_acctbal AS value, c_nationkey AS nation FROM customer)"
INSIDE = "inside AS (SELECT region, cell FROM (SELECT region, cell, count(*) AS n FROM grid g JOIN edges e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL) WHERE n % 2 = 1)"


def region_edges(spark: SparkSession) -> DataFrame:
    vertices = [(name, ring, k, *at) for name, ring, points in RINGS for k, at in enumerate(points)]
    return regions.edges(spark.createDataFrame(vertices, "region string, ring int, seq int, lon double, lat double"), 360.0)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(key.alias("cell"), (F.lit(-60) + key * 7919 % 1200 / F.lit(10.0)).alias("lat"), (key * 104729 % 2400 / F.lit(10.0)).alias("lon"), F.col("c_acctbal").alias("value"), F.col("c_nationkey").alias("nation"))


@query("cells_in_regions", "SELECT region, cell FROM inside", (EDGES, GRID, INSIDE))
def cells_in_regions(spark, sf_dir):
    return regions.cells_in(grid(spark, sf_dir), region_edges(spark))


@query("region_means_by_nation", "SELECT region, CAST(nation AS BIGINT) AS nation, round(sum(value * w) / sum(w), 6) AS mean FROM (SELECT *, least(greatest(cos(radians(lat)), 0), 1) AS w FROM grid) JOIN inside USING (cell) GROUP BY ALL", (EDGES, GRID, INSIDE))
def region_means_by_nation(spark, sf_dir):
    own = grid(spark, sf_dir)
    found = regions.region_means(own.select("cell", "nation", "value"), own.select("cell", "lat", "lon"), region_edges(spark), ["nation"], align.cos_weight(F.col("lat")))
    return found.select("region", F.col("nation").cast("long").alias("nation"), r("mean").alias("mean"))


#: Suppliers as points, nations as a grid of five latitudes (not evenly apart) and five longitudes.
POINTS = """points AS (SELECT CAST(s_suppkey AS BIGINT) AS point, -75 + (s_suppkey * 37 % 151) AS lat, (s_suppkey * 59 % 130) * 1.0 AS lon FROM supplier),
axes AS (SELECT CAST(n_nationkey AS BIGINT) AS cell, [-50.0, -30.0, 0.0, 40.0, 60.0][n_nationkey // 5 + 1] AS lat, 20.0 * (n_nationkey % 5) AS lon FROM nation),
near AS (SELECT point, (SELECT arg_min(cell, (abs(a.lat - p.lat) * 1e6 + a.lat + 90) * 1e9 + abs(a.lon - p.lon) * 1e5 + a.lon) FROM axes a) AS cell FROM points p)"""


def points_and_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key, n = F.col("s_suppkey").cast("long"), F.col("n_nationkey").cast("int")
    points = table(spark, sf_dir, "supplier").select(key.alias("point"), (F.lit(-75) + key * 37 % 151).cast("double").alias("lat"), (key * 59 % 130).cast("double").alias("lon"))
    lats = F.array(*[F.lit(x) for x in (-50.0, -30.0, 0.0, 40.0, 60.0)])
    return points, table(spark, sf_dir, "nation").select(n.cast("long").alias("cell"), F.get(lats, F.floor(n / 5).cast("int")).alias("lat"), (n % 5 * 20.0).alias("lon"))


@query("nearest_cells", "SELECT point, cell FROM near", (POINTS,))
def nearest_cells(spark, sf_dir):
    return align.nearest_cells(*points_and_grid(spark, sf_dir)).select("point", "cell")


@query("point_series_with_modes", "SELECT point, near.cell, CAST(cube.t AS INT) AS t, round(value, 6) AS value, round(enso, 6) AS enso, round(pdo_orth, 6) AS pdo_orth, round(amo, 6) AS amo FROM near JOIN cube USING (cell) JOIN drivers d ON d.t = cube.t", (POINTS, CUBE, DRIVERS))
def point_series_with_modes(spark, sf_dir):
    """The series of each point's nearest cell, with the modes of its steps."""
    found = align.nearest_cells(*points_and_grid(spark, sf_dir)).select("point", "cell")
    own = modes(spark, sf_dir).select("t", *[r(m).alias(m) for m in ("enso", "pdo_orth", "amo")])
    return found.join(orders_cube(spark, sf_dir).select("cell", "t", r("value").alias("value")), "cell").join(own, "t").select("point", "cell", "t", "value", "enso", "pdo_orth", "amo")


# -- metrics, spectra, components -------------------------------------------------------------------------------


@query(
    "named_band_metrics",
    "SELECT * FROM (SELECT member, cell, 'var_low' AS metric, round(var_pop(f), 2) AS value FROM (SELECT member, cell, t_out, CASE WHEN count(value) = 72 THEN sum(value * w) END AS f FROM members JOIN w ON t_in = t WHERE t_out BETWEEN 5 AND 66 GROUP BY ALL) GROUP BY ALL UNION ALL SELECT member, cell, 'max_val', round(max(value), 2) FROM members GROUP BY ALL)",
    (MEMBERS_CUBE, _values(linop.filter_matrix(MONTHS, 3, 0.2, "low", reflect=True))),
)
def named_band_metrics(spark, sf_dir):
    found = metrics.named(members_cube(spark, sf_dir), ["member", "cell"], ["var_low", "max_val"], MONTHS)
    return found.select("member", "cell", "metric", r("value", 2).alias("value"))


MEMBER_SEASONS = """
mseasons AS (
  SELECT member, cell, CAST(date_trunc('quarter', make_date(year, month, 1) + INTERVAL 1 MONTH) - INTERVAL 1 MONTH AS DATE) AS label, avg(value) AS value FROM members GROUP BY ALL
), mseasonal AS (
  SELECT member, cell, CASE WHEN month(label) = 12 THEN 'DJF' WHEN month(label) = 3 THEN 'MAM' WHEN month(label) = 6 THEN 'JJA' ELSE 'SON' END AS season, value FROM mseasons WHERE year(label) + CASE WHEN month(label) = 12 THEN 1 ELSE 0 END BETWEEN 1995 AND 2000
), mranked AS (SELECT cell, season, value, count(*) OVER (PARTITION BY cell, season) AS n, row_number() OVER (PARTITION BY cell, season ORDER BY value DESC) AS k FROM mseasonal WHERE value IS NOT NULL),
mwanted AS (SELECT *, greatest(1, least(n, CAST(floor(0.44 + (n + 0.12) / p) AS BIGINT))) AS k1 FROM mranked CROSS JOIN (VALUES (5), (33)) v(p))"""


@query(
    "seasonal_member_metrics",
    "SELECT cell, season, metric, round(avg(value), 6) AS value FROM (SELECT member, cell, season, 'IQ_range' AS metric, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS value FROM mseasonal GROUP BY ALL UNION ALL SELECT member, cell, season, 'max_val', max(value) FROM mseasonal GROUP BY ALL) GROUP BY ALL UNION ALL SELECT cell, season, p || 'yr_event', round(value, 6) FROM mwanted WHERE k = CASE WHEN abs((n + 0.12) / (least(n, k1 + 1) - 0.44) - p) < abs((n + 0.12) / (k1 - 0.44) - p) THEN least(n, k1 + 1) ELSE k1 END",
    (MEMBERS_CUBE, MEMBER_SEASONS),
)
def seasonal_member_metrics(spark, sf_dir):
    """Metrics by season: means over members, but events pool the years of all members."""
    rows = products.seasonal(members_cube(spark, sf_dir), ["member", "cell"], 1995, 2000)
    found = products.seasonal_metrics(rows, ["cell"], ["IQ_range", "max_val", "5yr_event", "33yr_event"])
    return found.select("cell", "season", "metric", r("value").alias("value"))


@query("member_envelope", "SELECT cell, CAST(t AS INT) AS t, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM members GROUP BY ALL", (MEMBERS_CUBE,))
def member_envelope(spark, sf_dir):
    """The envelope that spectra of surrogates get, over members' values."""
    found = spectra.envelope(members_cube(spark, sf_dir).withColumnRenamed("value", "power"), ["cell", "t"])
    return found.select("cell", "t", *[r(c).alias(c) for c in ("mean", "low", "high")])


@query("cell_spectra")
def cell_spectra(spark, sf_dir):
    """The spectra of all cells' departures; missing months count as no departure."""
    cube = orders_cube(spark, sf_dir)
    rows = cube.select("cell", "t", F.coalesce(F.col("value") - F.avg("value").over(Window.partitionBy("cell", "month")), F.lit(0.0)).alias("value"))
    return spectra.spectra(rows, {"cell": "bigint"}, 1 / 12)


@query("mode_spectra_with_range")
def mode_spectra_with_range(spark, sf_dir):
    """Each mode's own spectrum with its 95 % range, beside the envelope of its surrogates' spectra."""
    own = mode_series(spark, sf_dir)
    found = spectra.spectra(own, {"mode": "string"}, 1 / 12).select("mode", "k", "frequency", "power", (F.col("power") * F.col("lower")).alias("power_low"), (F.col("power") * F.col("upper")).alias("power_high"))
    drawn = spectra.spectra(spectra.surrogates(own, MEMBERS), {"mode": "string", "member": "int"}, 1 / 12)
    around = spectra.envelope(drawn, ["mode", "k"]).select("mode", "k", F.col("mean").alias("surrogate_mean"), F.col("low").alias("surrogate_low"), F.col("high").alias("surrogate_high"))
    return found.join(around, ["mode", "k"])


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, t, weight, x: departures of cells without a missing month between 40 S and 40 N (a mask), as series."""
    cube = orders_cube(spark, sf_dir).where("abs(lat) <= 40")
    rows = cube.select("cell", "t", F.sqrt(align.cos_weight(F.col("lat"))).alias("weight"), (F.col("value") - F.avg("value").over(Window.partitionBy("cell", "month"))).alias("value"))
    series = rows.groupBy("cell", "weight").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("s"), F.count("value").alias("n")).where(F.col("n") == MONTHS)
    return series.select(F.lit(0).alias("member"), "cell", "weight", F.col("s.value").alias("x"))


@query(
    "step_products",
    "SELECT CAST(a.t AS INT) AS i, CAST(b.t AS INT) AS j, round(sum(a.v * b.v * w) / 1e6, 3) AS mixed, round(sum(a.v * b.v * w * w) / 1e6, 3) AS gram FROM dep a JOIN dep b USING (cell) JOIN (SELECT cell, any_value(sqrt(least(greatest(cos(radians(lat)), 0), 1))) AS w FROM cube GROUP BY cell HAVING count(value) = 72) USING (cell) GROUP BY ALL",
    (CUBE, "dep AS (SELECT cell, t, value - avg(value) OVER (PARTITION BY cell, month) AS v FROM cube WHERE abs(lat) <= 40)"),
)
def step_products(spark, sf_dir):
    """Sums over masked cells of the products of any two steps: what low-frequency components are made from."""
    found = spectra.step_products(departures(spark, sf_dir), ["member"], MONTHS)
    pairs = found.select("i", F.posexplode(F.arrays_zip("mixed", "gram")).alias("j", "of"))
    return pairs.select("i", "j", r(F.col("of.mixed") / 1e6, 3).alias("mixed"), r(F.col("of.gram") / 1e6, 3).alias("gram"))


@query("masked_components_by_phase")
def masked_components_by_phase(spark, sf_dir):
    """Low-frequency components of hourly values, filtered for each hour of the day alone, over the types that have at least as many events as the mean type."""
    cube = events_cube(spark, sf_dir)
    seen = cube.groupBy("cell").agg(F.count("value").alias("n"))
    mask = seen.join(seen.agg((F.avg("n") * 0.9).alias("enough"))).where("n >= enough").select("cell")
    rows = cube.select(F.lit(0).alias("member"), "cell", "t", F.lit(1.0).alias("weight"), F.coalesce(F.col("value") - F.avg("value").over(Window.partitionBy("cell", "phase")), F.lit(0.0)).alias("value"))
    patterns, series = spectra.low_frequency_components(rows, ["member"], 720, 5, 2, 0.1, phases=24, mask=mask)
    return align.stacked({"pattern": patterns.select("component", F.col("cell").alias("at"), F.col("pattern").alias("value")), "series": series.select("component", F.col("t").cast("string").alias("at"), "value")}, "kind")


# -- rows whose SQL would notice a step left out ------------------------------------------------------------------


@query("later_climatology_added", "SELECT cell, t, round(value - avg(value) OVER (PARTITION BY cell, month) + avg(CASE WHEN year >= 1998 THEN value END) OVER (PARTITION BY cell, month), 4) AS value FROM cube", (CUBE,))
def later_climatology_added(spark, sf_dir):
    """Departures from all years' climatology, put on that of the later years."""
    cube = orders_cube(spark, sf_dir)
    later = cube.where("year >= 1998").groupBy("cell", "month").agg(F.avg("value").alias("mean"))
    own = cube.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("cell", "month")))
    return units.with_climatology(own, later, ["cell"]).select("cell", "t", r("value", 4).alias("value"))


@query("forced_precipitation", "SELECT cell, t, round(m - avg(m) OVER (PARTITION BY cell), 4) AS forced FROM (SELECT cell, t, avg(value * 1e-9 * 86400000 * day(last_day(make_date(year, month, 1)))) AS m FROM members WHERE member IN (1, 2, 3, 5) GROUP BY ALL)", (MEMBERS_CUBE,))
def forced_precipitation(spark, sf_dir):
    """A forced signal in mm a month from parts in m/s, whose conversion depends on the month."""
    runs = members_cube(spark, sf_dir).where(F.col("member").isin(ensemble.member_ids((1, 3), (5, 5))))
    rate = units.converted(F.col("value") * 1e-9, F.lit("m/s"), F.make_date("year", "month", F.lit(1)), to_month=True)
    return ensemble.forced_signal(runs.withColumn("value", rate), ["cell"]).select("cell", "t", r("forced", 4).alias("forced"))


COVERS |= {
    "joint_members": "D13 L1 E14 N9 N14 F1",
    "pooled_order_levels": "E15 F8",
    "pooled_order_quantiles": "E7",
    "cells_in_regions": "D10 A9",
    "region_means_by_nation": "N21 E9",
    "nearest_cells": "C16",
    "point_series_with_modes": "N17 C16",
    "named_band_metrics": "N20 I24",
    "seasonal_member_metrics": "E15 E19 I23 I24 E11 B5",
    "member_envelope": "E16",
    "cell_spectra": "N15",
    "mode_spectra_with_range": "N15 E16 B9",
    "step_products": "N16",
    "masked_components_by_phase": "N16 E18 F5 G6",
    "later_climatology_added": "I21",
    "forced_precipitation": "N18 I19",
}
