"""Series as tables: cell, t, year, month (or cycle, phase), value; every step of every cell has a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST_YEAR, MONTHS = 1995, 72


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def densified(keys: DataFrame, filled: DataFrame, by: list[str], steps: int) -> DataFrame:
    """A row for every key and step; value is null where filled has none. Steps are made next to each key, without a join."""
    return keys.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).join(filled, [*by, "t"], "left")


def months_since(ts: Column, first_year: int = FIRST_YEAR) -> Column:
    return ((F.year(ts) - first_year) * 12 + F.month(ts) - 1).cast("int")


def _calendar(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": (F.lit(FIRST_YEAR) + F.floor(F.col("t") / 12)).cast("int"), "month": (F.col("t") % 12 + 1).cast("int")})


def orders_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean order value by nation, 1995 to 2000: cell, region, lat (a stand-in), t, value, n_orders, year, month."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("2000-12-31 23:59:59.999999").cast("timestamp_ntz")))
    filled = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("long").alias("cell"), months_since(F.col("o_orderdate")).alias("t")).agg(F.avg("o_totalprice").alias("value"), F.count("*").alias("n_orders"))
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("cell"), F.col("n_regionkey").cast("long").alias("region"), (F.lit(-60.0) + 5 * F.col("n_nationkey")).alias("lat"))
    return _calendar(densified(keys, filled, ["cell"], MONTHS))


def complete_orders_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by region: cell is the region."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("2000-12-31 23:59:59.999999").cast("timestamp_ntz")))
    nations = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("long").alias("cell"))
    filled = orders.join(nations, F.col("o_custkey") == F.col("c_custkey")).groupBy("cell", months_since(F.col("o_orderdate")).alias("t")).agg(F.avg("o_totalprice").alias("value"))
    return _calendar(densified(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("cell")), filled, ["cell"], MONTHS))


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, year, month, enso, pdo, amo, gmt: stand-ins for climate indices, as departures from their means. One row for each step."""
    items = table(spark, sf_dir, "lineitem").groupBy(months_since(F.col("l_shipdate")).alias("t")).agg(F.avg(F.col("l_discount") * F.col("l_extendedprice")).alias("enso"), F.avg("l_quantity").alias("pdo"), F.avg("l_tax").alias("amo"))
    orders = table(spark, sf_dir, "orders").groupBy(months_since(F.col("o_orderdate")).alias("t")).agg(F.count("*").cast("double").alias("gmt"))
    axis = spark.range(MONTHS).select(F.col("id").cast("int").alias("t"))
    both = axis.join(items, "t", "left").join(orders, "t", "left")
    mean = lambda c: F.avg(c).over(Window.partitionBy())  # noqa: E731  the axis has 72 rows
    return _calendar(both.select("t", *[(F.coalesce(F.col(c), mean(c)) - mean(c)).alias(c) for c in ("enso", "pdo", "amo", "gmt")]))


def events_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by type and hour of 30 days: cell (the type), t, cycle (the day), phase (the hour), value."""
    events = table(spark, sf_dir, "events").where(F.col("ts").between(F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-01-30 23:59:59.999999").cast("timestamp_ntz")))
    filled = events.groupBy(F.col("event_type").alias("cell"), ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("int").alias("t")).agg(F.avg("value").alias("value"))
    keys = events.select(F.col("event_type").alias("cell")).distinct()
    return densified(keys, filled, ["cell"], 720).withColumns({"cycle": F.floor(F.col("t") / 24).cast("int"), "phase": (F.col("t") % 24).cast("int")})


def members_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean order value by region for each order priority, as the members 1 to 5 of an ensemble: member, cell, t, value, year, month."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("2000-12-31 23:59:59.999999").cast("timestamp_ntz")))
    nations = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("long").alias("cell"))
    member = F.substring("o_orderpriority", 1, 1).cast("int").alias("member")
    filled = orders.join(nations, F.col("o_custkey") == F.col("c_custkey")).groupBy(member, "cell", months_since(F.col("o_orderdate")).alias("t")).agg(F.avg("o_totalprice").alias("value"))
    keys = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("cell"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("member"))
    return _calendar(densified(keys, filled, ["member", "cell"], MONTHS))
