"""Block bootstrap of residuals and the synthesis of ensemble members."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lag_correlation(series: DataFrame, keys: list[str], order: str = "year", value: str = "value") -> DataFrame:
    """keys, n, rho: the correlation of a series with itself one step earlier."""
    w = Window.partitionBy(*keys).orderBy(order)
    return series.withColumn("_last", F.lag(value).over(w)).groupBy(*keys).agg(F.count("*").cast("int").alias("n"), F.corr(value, "_last").alias("rho"))


def block_length(n: Column, rho: Column) -> Column:
    """The largest whole L with L <= (n - L + 1)^(2/3 (1 - n_eff / n)), n_eff = n (1 - rho) / (1 + rho); the root of n where rho is missing."""
    power = F.lit(2.0) / 3 * (1 - F.try_divide(1 - rho, 1 + rho))
    fits = F.filter(F.sequence(F.lit(0), n), lambda x: x <= F.pow((n - x + 1).cast("double"), power))
    return F.when(rho.isNull() | F.isnan(rho) | (rho <= -1), F.floor(F.sqrt(n))).otherwise(F.coalesce(F.array_max(fits), F.lit(0))).cast("int")


def block_to_use(lengths: DataFrame, by: str, keep: Column, quantile: float = 0.97, steps_a_cycle: int = 12) -> DataFrame:
    """One row: the quantile of the kept lengths, at least one cycle, largest over the variables in by, in steps."""
    each = lengths.where(keep).groupBy(by).agg(F.percentile("length", F.lit(quantile)).alias("q"))
    return each.agg((F.greatest(F.lit(1), F.max(F.col("q").cast("int"))) * steps_a_cycle).alias("block"))


def hashed_starts(spark: SparkSession, members: int, steps: int, block: int, seed: int = 123, cycle: int = 12) -> DataFrame:
    """(member, block, start): starts of whole cycles, drawn by md5, so that any engine can draw them alike. One draw serves all variables."""
    blocks = -(-steps // block)
    draws = spark.range(members * blocks).select((F.col("id") / blocks).cast("int").alias("member"), F.pmod("id", F.lit(blocks)).cast("int").alias("block"))
    number = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "member", "block")), 1, 8), 16, 10).cast("long")
    return draws.select("member", "block", (F.pmod(number, F.lit(steps // cycle)) * cycle).cast("int").alias("start"))


def seeded_starts(spark: SparkSession, members: int, steps: int, block: int, seed: int = 123, cycle: int = 12) -> DataFrame:
    """The same from numpy's legacy generator, one member after the other."""
    draw = np.random.RandomState(seed)
    rows = [(m, b, int(s)) for m in range(members) for b, s in enumerate(draw.choice(np.arange(0, steps, cycle), -(-steps // block)))]
    return spark.createDataFrame(rows, "member int, block int, start int")


def resampling(starts: DataFrame, steps: int, block: int) -> DataFrame:
    """(member, t, from_t): each block runs on from its start, round the end of the axis."""
    each = starts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    return each.select("member", (F.col("block") * block + F.col("k")).alias("t"), F.pmod(F.col("start") + F.col("k"), F.lit(steps)).alias("from_t")).where(F.col("t") < steps)


def bootstrapped(residuals: DataFrame, index: DataFrame, cell: str = "cell") -> DataFrame:
    """cell, member, t, noise."""
    return residuals.select(cell, F.col("t").alias("from_t"), "residual").join(index, "from_t").select(cell, "member", "t", F.col("residual").alias("noise"))


def members(noise: DataFrame, fit: DataFrame, surrogates: DataFrame, modes: list[str], forcing: DataFrame | None = None, cell: str = "cell") -> DataFrame:
    """cell, member, t, value: constant + noise + each mode's coefficient times its surrogate (+ forced). surrogates: member, t, month and modes."""
    wide = fit.groupBy(cell, "month").pivot("predictor", ["constant", *modes]).agg(F.first("beta")).select(cell, "month", "constant", *[F.col(m).alias(f"_b_{m}") for m in modes])
    both = noise.join(surrogates, ["member", "t"]).join(wide, [cell, "month"])
    total = F.col("constant") + F.col("noise")
    for m in modes:
        total += F.col(f"_b_{m}") * F.col(m)
    if forcing is not None:
        both = both.join(forcing.select(cell, "t", "forced"), [cell, "t"])
        total += F.col("forced")
    return both.select(cell, "member", "t", total.alias("value"))


def noise_members(noise: DataFrame, fits: DataFrame, cell: str = "cell") -> DataFrame:
    """cell, member, t, value: what was fitted plus noise."""
    return noise.join(fits.select(cell, "t", "fitted"), [cell, "t"]).select(cell, "member", "t", (F.col("fitted") + F.col("noise")).alias("value"))


def turned(surrogates: DataFrame, lag: int, steps: int) -> DataFrame:
    """(member, mode, t, value) with every series lag steps later, round the end of its axis."""
    return surrogates if not lag else surrogates.withColumn("t", F.pmod(F.col("t") + lag, F.lit(steps)).cast("int"))


def rescaled(surrogates: DataFrame, modes: list[str]) -> DataFrame:
    """Every member's modes with a standard deviation of one."""
    return surrogates.withColumns({m: F.try_divide(F.col(m), F.stddev_pop(m).over(Window.partitionBy("member"))) for m in modes})


def ensemble_mean(df: DataFrame, keys: list[str], value: str = "value", demean_by: list[str] | None = None) -> DataFrame:
    """keys, mean over members; demean_by: without the mean over time of each of these keys."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return out if demean_by is None else out.withColumn("mean", F.col("mean") - F.avg("mean").over(Window.partitionBy(*demean_by)))


def member_ids(*ranges: tuple[int, int]) -> list[int]:
    """The numbers of members, from several ranges with both ends."""
    return [m for low, high in ranges for m in range(low, high + 1)]


def continued(history: DataFrame, scenario: DataFrame, members: list[int], member: str = "member") -> DataFrame:
    """A past run and its continuation as one series for each of the members."""
    return history.unionByName(scenario).where(F.col(member).isin(members))


def forced_signal(runs: DataFrame, keys: list[str], convert=lambda value: value, value: str = "value") -> DataFrame:
    """keys, t, forced: the mean over members in the wanted unit, without its mean over time. The unit is converted first, so that an offset doesn't come back."""
    mean = runs.withColumn(value, convert(F.col(value))).groupBy(*keys, "t").agg(F.avg(value).alias("_mean"))
    return mean.select(*keys, "t", (F.col("_mean") - F.avg("_mean").over(Window.partitionBy(*keys))).alias("forced"))


def nested_mean(metric: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """A metric of each inner member, averaged over those of an outer one: keys leave the inner member out."""
    return metric.groupBy(*keys).agg(F.avg(value).alias(value))
