"""Metrics of keyed series: quantile range, maximum, return levels, band variance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection
from .linop import band_filter, several_filtered

#: Fixed value: Gringorten's plotting position.
B = 0.44


def recurrence_rank(n: Column, years: Column) -> Column:
    """The rank from the top whose recurrence interval (n + 1 - 2b) / (k - b) is nearest to years; the smaller of two that are as near."""
    span = n + 1 - 2 * B
    low = F.greatest(F.lit(1).cast("bigint"), F.least(n.cast("bigint"), F.floor(B + span / years)))
    high = F.least(n.cast("bigint"), low + 1)
    far = lambda k: F.abs(span / (k - B) - years)
    return F.when(far(high) < far(low), high).otherwise(low)


def return_levels(df: DataFrame, keys: list[str], years: list[int], value: str = "value") -> DataFrame:
    """keys, return_period, level: the value of that rank; missing values don't rank. Pool members by leaving them out of keys. Ranks come from one window by keys; the wanted ones are few."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(F.desc(value)))})
    # most rows have a rank that no interval asks for; they go before rows are made for each interval
    deepest = reduce(F.greatest, [recurrence_rank(F.col("_n"), F.lit(y)) for y in years]) if len(years) > 1 else recurrence_rank(F.col("_n"), F.lit(years[0]))
    wanted = ranked.where(F.col("_k") <= deepest).withColumn("return_period", F.explode(F.array(*[F.lit(y) for y in years])))
    return wanted.where(F.col("_k") == recurrence_rank(F.col("_n"), F.col("return_period"))).select(*keys, "return_period", F.col(value).alias("level"))


def wanted_ranks(counts: DataFrame, years: list[int]) -> DataFrame:
    """counts (keys, n) with return_period and rank (from the smallest value)."""
    each = counts.withColumn("return_period", F.explode(F.array(*[F.lit(y) for y in years])))
    return each.withColumn("rank", F.col("n") + 1 - recurrence_rank(F.col("n"), F.col("return_period")))


def pooled_return_levels(df: DataFrame, keys: list[str], years: list[int], value: str = "value") -> DataFrame:
    """The same rows as ``return_levels`` by distributed selection, for keys that pool more values than a task should have."""
    dealt = selection.dealt(df, keys, value)
    wanted = wanted_ranks(dealt.counts(), years).select(*keys, "return_period", "rank")
    return dealt.at_ranks(wanted).select(*keys, "return_period", F.col(value).alias("level"))


def pooled_quantiles(df: DataFrame, keys: list[str], probabilities: list[float], value: str = "value") -> DataFrame:
    """keys, probability, quantile (linear between ranks) by distributed selection."""
    dealt = selection.dealt(df, keys, value)
    at = F.col("probability") * (F.col("n") - 1)
    counts = dealt.counts().withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    wanted = counts.select(*keys, "probability", (at - F.floor(at)).alias("part"), F.explode(F.array_distinct(F.array(F.floor(at) + 1, F.ceil(at) + 1))).alias("rank"))
    low, high = F.min_by(value, "rank"), F.max_by(value, "rank")
    return dealt.at_ranks(wanted).groupBy(*keys, "probability").agg((low + F.max("part") * (high - low)).alias("quantile"))


def spread(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, iq_range, max_val, var: of the values that are there."""
    return df.groupBy(*keys).agg((F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("iq_range"), F.max(value).alias("max_val"), F.var_pop(value).alias("var"))


def band_variance(df: DataFrame, keys: list[str], steps: int, cutoff: float = 0.1, order: int = 3, value: str = "value") -> DataFrame:
    """keys, var_low, var_high: variance below and above cutoff (in cycles a step), of the series between its mirror images, without int(1 / (2 cutoff)) steps at each end."""
    edge = int(1 / (2 * cutoff))
    bands = {kind: band_filter(steps, order, 2 * cutoff, kind, reflect=True) for kind in ("low", "high")}
    own = several_filtered(df, bands, keys, value, first=edge, last=steps - 1 - edge, steps=steps)
    return own.groupBy(*keys).agg(*[F.var_pop(kind).alias(f"var_{kind}") for kind in bands])


def recurrence_years(name: str) -> int:
    """33 of "33yr_event"."""
    return int(name.split("yr")[0])


def named(df: DataFrame, keys: list[str], names: list[str], steps: int | None = None, value: str = "value") -> DataFrame:
    """keys, metric, value of metrics by name: IQ_range, max_val, <n>yr_event, var_low, var_high (these need the number of steps and a column t). Another name is an error."""
    plain = {"IQ_range": "iq_range", "max_val": "max_val"}
    unknown = [n for n in names if n not in plain and not n.endswith("yr_event") and n not in ("var_low", "var_high")]
    if unknown:
        raise ValueError(f"no metric {unknown[0]!r}")
    parts = []
    if own := [n for n in names if n in plain]:
        wide = spread(df, keys, value)
        parts.append(wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(plain[n]).alias("value")) for n in own])).alias("of")).select(*keys, "of.*"))
    if own := [n for n in names if n.endswith("yr_event")]:
        levels = return_levels(df, keys, [recurrence_years(n) for n in own], value)
        parts.append(levels.select(*keys, F.concat(F.col("return_period").cast("string"), F.lit("yr_event")).alias("metric"), F.col("level").alias("value")))
    if own := [n for n in names if n.startswith("var_")]:
        bands = band_variance(df, keys, steps, value=value)
        parts.append(bands.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in own])).alias("of")).select(*keys, "of.*"))
    return reduce(DataFrame.unionByName, parts)
