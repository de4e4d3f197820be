"""Unit conversions as one expression on a value, its unit and its month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeaxis import days_in_month

#: Fixed values.
KELVIN = 273.15
MM_A_DAY = 1000 * 86400.0


def converted(value: Column, unit: Column, ts: Column, to_month: bool = False) -> Column:
    """K to degrees C; m/s and mm/month to mm/day (to_month: m/s to mm/month); Pa and target units stay. Any other unit raises an error."""
    precipitation = value * MM_A_DAY * days_in_month(ts) if to_month else value * MM_A_DAY
    known = F.when(unit == "K", value - KELVIN).when(unit == "m/s", precipitation).when(unit == "mm/month", value if to_month else value / days_in_month(ts))
    return known.when(unit.isin("C", "Pa", "mm/day"), value).otherwise(F.raise_error(F.concat(F.lit("unknown unit "), F.coalesce(unit, F.lit("null")))).cast("double"))


def converted_unit(unit: Column, to_month: bool = False) -> Column:
    return F.when(unit == "K", "C").when(unit.isin("m/s", "mm/month"), "mm/month" if to_month else "mm/day").otherwise(unit)


def with_climatology(series, climatology, keys: list[str], value: str = "value"):
    """Departures plus the climatology (keys, month, mean) of their month."""
    both = series.join(climatology.select(*keys, "month", F.col("mean").alias("_mean")), [*keys, "month"])
    return both.withColumn(value, F.col(value) + F.col("_mean")).drop("_mean")
