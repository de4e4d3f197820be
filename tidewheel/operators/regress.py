"""Regressions of each cell's months on driver indices.

The drivers are the same for all cells, so least squares is one linear operator on the time axis: the
rows of (X'X)^-1 X' for each month, a table with one row for each month, predictor and step. Cells
meet it in one join and one sum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linop import applied, harmonic_matrix, weight_table


def orthogonalised(df: DataFrame, name: str, against: str, out: str) -> DataFrame:
    """name without its part along against; nothing is demeaned."""
    everything = Window.partitionBy()
    return df.withColumn(out, F.col(name) - F.try_divide(F.sum(F.col(name) * F.col(against)).over(everything), F.sum(F.col(against) * F.col(against)).over(everything)) * F.col(against))


def standardised(df: DataFrame, names: list[str]) -> DataFrame:
    """Divided by the population's standard deviation over the whole table."""
    return df.withColumns({n: F.try_divide(F.col(n), F.stddev_pop(n).over(Window.partitionBy())) for n in names})


def hat_table(drivers: DataFrame, predictors: list[str], worst: float = 1e8) -> DataFrame:
    """(month, predictor, t, h): least squares as weights. drivers has a row for each step of the time axis, which comes to the driver. 'constant' is a column of ones; predictors that are nearly dependent raise an error."""
    rows = drivers.select("t", "month", *[p for p in predictors if p != "constant"]).orderBy("t").collect()
    out = []
    for month in sorted({r["month"] for r in rows}):
        own = [r for r in rows if r["month"] == month]
        x = np.array([[1.0 if p == "constant" else r[p] for p in predictors] for r in own])
        if np.linalg.cond(x) > worst:
            raise ValueError(f"the predictors of month {month} are nearly dependent")
        h = np.linalg.solve(x.T @ x, x.T)
        out += [(month, p, r["t"], float(w)) for p, row in zip(predictors, h) for r, w in zip(own, row)]
    return drivers.sparkSession.createDataFrame(out, "month int, predictor string, t int, h double")


def monthly_fit(series: DataFrame, hat: DataFrame, cell: str = "cell") -> DataFrame:
    """cell, month, predictor, beta; null where the cell misses a value of the month."""
    rows = series.select(cell, "t", "value").join(hat, "t")
    found = rows.groupBy(cell, "month", "predictor").agg(F.sum(F.col("value") * F.col("h")).alias("beta"), F.count("value").alias("_n"), F.count("*").alias("_all"))
    return found.select(cell, "month", "predictor", F.when(F.col("_n") == F.col("_all"), F.col("beta")).alias("beta"))


def smoothed(fit: DataFrame, cell: str = "cell") -> DataFrame:
    """Coefficients over the year's cycle by two harmonics; one missing month makes all twelve missing."""
    weights = weight_table(fit.sparkSession, harmonic_matrix(), 1)
    return applied(fit, weights, [cell, "predictor"], "beta", "month", 12).withColumnRenamed("filtered", "beta")


def fitted(series: DataFrame, fit: DataFrame, drivers: DataFrame, predictors: list[str], cell: str = "cell") -> DataFrame:
    """cell, t, month, value, fitted, residual."""
    wide = fit.groupBy(cell, "month").pivot("predictor", predictors).agg(F.first("beta")).select(cell, "month", *[F.col(p).alias(f"_b_{p}") for p in predictors])
    x = drivers.select("t", *[(F.lit(1.0) if p == "constant" else F.col(p)).alias(f"_x_{p}") for p in predictors])
    both = series.join(wide, [cell, "month"]).join(x, "t")
    total = sum((F.col(f"_b_{p}") * F.col(f"_x_{p}") for p in predictors[1:]), F.col(f"_b_{predictors[0]}") * F.col(f"_x_{predictors[0]}"))
    return both.withColumn("fitted", total).select(cell, "t", "month", "value", "fitted", (F.col("value") - F.col("fitted")).alias("residual"))


def forced(fit: DataFrame, drivers: DataFrame, name: str, cell: str = "cell") -> DataFrame:
    """cell, t, month, forced: the coefficient of the month times the driver."""
    return fit.where(F.col("predictor") == name).join(drivers.select("t", "month", F.col(name).alias("_x")), "month").select(cell, "t", "month", (F.col("beta") * F.col("_x")).alias("forced"))


def through_origin(series: DataFrame, drivers: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Sum of xy over sum of xx, by keys."""
    both = series.join(drivers.select("t", F.col(name).alias("_x")), "t").where(F.col("value").isNotNull())
    return both.groupBy(*keys).agg(F.try_divide(F.sum(F.col("value") * F.col("_x")), F.sum(F.col("_x") * F.col("_x"))).alias("slope"))


