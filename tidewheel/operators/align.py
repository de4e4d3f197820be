"""Alignment of keyed series: lags, nearest cells, regions, components, pivots, masks, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of the names that df has, under its own name: aliases of one coordinate or variable."""
    return F.col(next(n for n in names if n in df.columns))


def lagged(df: DataFrame, shift: int, lead: list[str], order: str = "t", by: list[str] | None = None) -> DataFrame:
    """Columns of lead stay; all others come from shift rows earlier, and the first rows, which have none, go. lead comes first."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(order)
    others = [c for c in df.columns if c not in (*lead, order, *by)]
    moved = df.select(*by, *lead, order, F.row_number().over(w).alias("_n"), *[(F.lag(c, shift).over(w) if shift else F.col(c)).alias(c) for c in others])
    return moved.where(F.col("_n") > shift).select(*by, *lead, *others, order)


def nearest_cell(cells: DataFrame, lat: float, lon: float) -> DataFrame:
    """The row of the cell nearest along each axis; ties to the smaller coordinate."""
    return cells.orderBy(F.abs(F.col("lat") - lat), "lat", F.abs(F.col("lon") - lon), "lon").limit(1)


def nearest_on_axis(points: DataFrame, axis: DataFrame, column: str) -> DataFrame:
    """points with nearest_<column>: the axis's value (axis has the same column) that is nearest to each; of two as near the smaller.

    Values and points meet in buckets as wide as the axis's largest step, where a point's nearest value is
    in its own bucket or one beside it. Points beyond the ends go to the buckets of the ends. Only the
    axis, a grid's coordinates along one direction, is ever sorted whole. Points without a coordinate have null.
    """
    values = axis.select(F.col(column).cast("double").alias("_v")).where("_v is not null").distinct()
    step = F.col("_v") - F.lag("_v").over(Window.orderBy("_v"))
    width, low, high = values.withColumn("_step", step).agg(F.coalesce(F.max("_step"), F.lit(1.0)), F.min("_v"), F.max("_v")).first()
    name = f"nearest_{column}"
    if low is None:
        return points.withColumn(name, F.lit(None).cast("double"))
    bucket = lambda x: F.floor((x - low) / width).cast("long")
    around = values.select("_v", F.explode(F.sequence(bucket(F.col("_v")) - 1, bucket(F.col("_v")) + 1)).alias("_b"))
    asked = points.select(F.col(column).cast("double").alias("_p")).where("_p is not null").distinct()
    near = asked.withColumn("_b", bucket(F.least(F.greatest(F.col("_p"), F.lit(low)), F.lit(high)))).join(around, "_b")
    found = near.groupBy("_p").agg(F.min(F.struct(F.abs(F.col("_v") - F.col("_p")).alias("far"), "_v"))["_v"].alias(name))
    return points.join(found, F.col(column).cast("double").eqNullSafe(F.col("_p")), "left").drop("_p")


def nearest_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (with lat and lon) and the cell of a grid that is nearest along each axis."""
    found = nearest_on_axis(nearest_on_axis(points, cells, "lat"), cells, "lon")
    at = cells.select("cell", F.col("lat").cast("double").alias("nearest_lat"), F.col("lon").cast("double").alias("nearest_lon"))
    return found.join(at, ["nearest_lat", "nearest_lon"], "left").select(*points.columns, "cell")


def in_polygon(cells: DataFrame, ring: list[tuple[float, float]], shift: float = 0.0) -> Column:
    """Even-odd rule for (lon, lat) against a closed ring of vertices, as one expression; shift is added to the ring's longitudes. A cell on an edge belongs to one side of it."""
    x, y = F.col("lon"), F.col("lat")
    moved = [(a + shift, b) for a, b in ring]
    crossings = []
    for (x1, y1), (x2, y2) in zip(moved, moved[1:] + moved[:1]):
        if y1 != y2:
            crossings.append(F.when(((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0))
    return reduce(lambda a, b: a + b, crossings, F.lit(0)) % 2 == 1


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: Column, strict: bool = False) -> DataFrame:
    """mean over keys. Weights of missing values count in the denominator unless strict."""
    below = F.when(F.col(value).isNotNull(), weight) if strict else weight
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * weight), F.sum(below)).alias("mean"))


def cos_weight(lat: Column) -> Column:
    return F.least(F.greatest(F.cos(F.radians(lat)), F.lit(0.0)), F.lit(1.0))


def component_sum(df: DataFrame, keys: list[str], component: str, value: str, names: list[str]) -> DataFrame:
    """The sum of all named components; null where any is missing."""
    found = df.where(F.col(component).isin(*names)).groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    return found.select(*keys, F.when(F.col("n") == len(names), F.col("total")).alias("total"))


def masked(df: DataFrame, value: str, keep: Column) -> DataFrame:
    """Values outside the mask become null; rows stay."""
    return df.withColumn(value, F.when(keep, F.col(value)))


def outside_subtropics(lat: Column) -> Column:
    return (F.abs(lat) > 30) | (F.abs(lat) < 10)


def trimmed(df: DataFrame, order: str, head: int, tail: int, by: list[str] | None = None) -> DataFrame:
    """Without the first head and the last tail rows of each series."""
    w = Window.partitionBy(*(by or []))
    numbered = df.withColumns({"_n": F.row_number().over(w.orderBy(order)), "_m": F.row_number().over(w.orderBy(F.desc(order)))})
    return numbered.where((F.col("_n") > head) & (F.col("_m") > tail)).drop("_n", "_m")


def misaligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has; aligned series give no rows."""
    return a.select(keys).join(b, keys, "left_anti").unionByName(b.select(keys).join(a, keys, "left_anti"))


def stacked(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Tables with the same columns, one below the other, with their names in a column."""
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(k)) for k, df in parts.items()])


def to_columns(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value, ignorenulls=True))


def ends(df: DataFrame, keys: list[str], value: str = "value", order: str = "t") -> DataFrame:
    """keys, first_value, last_value, has_data (whether the last step has a value), steps with a value."""
    return df.groupBy(*keys).agg(
        F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"),
        F.max_by(value, order).isNotNull().alias("has_data"), F.count(value).alias("n_values"),
    )


def from_first(df: DataFrame, match: Column, rows: int, order: str = "t", by: list[str] | None = None) -> DataFrame:
    """Each series from the first row that matches on, so many rows of it, numbered anew from 0."""
    w = Window.partitionBy(*(by or []))
    begun = df.withColumn("_from", F.min(F.when(match, F.col(order))).over(w)).where(F.col(order) >= F.col("_from"))
    return begun.withColumn(order, (F.row_number().over(w.orderBy(order)) - 1).cast("int")).where(F.col(order) < rows).drop("_from")


def recentred(lon: Column) -> Column:
    """Longitudes from 0 to 360."""
    return (lon % 360 + 360) % 360


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Sorted, for a sink that wants an order."""
    return df.orderBy(*columns)


def rounded_keys(df: DataFrame, *columns: str, digits: int = 3) -> DataFrame:
    """Coordinates rounded, so that they can be joined."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def in_years(df: DataFrame, years: DataFrame, year: str = "year") -> DataFrame:
    """The rows of the years (a table with a column year) that there are."""
    return df.join(years.select(F.col("year").alias(year)).distinct(), year, "left_semi")
