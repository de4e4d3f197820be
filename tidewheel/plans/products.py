"""Products derived from stored members: seasonal metrics, pooled extremes, regional series and components, each a stage of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeaxis
from ..operators import align, metrics, spectra
from ..sources import regions
from ..sources.store import Stage, Stages


def seasonal(members: DataFrame, keys: list[str], first_year: int, last_year: int, value: str = "value") -> DataFrame:
    """keys, season, season_year, value of monthly series (keys, t from January of first_year): means of the months that are there, December with the next year; only whole numbers of years from first_year to last_year."""
    year, month = F.lit(first_year) + F.floor(F.col("t") / 12).cast("int"), (F.col("t") % 12 + 1).cast("int")
    label = timeaxis.quarter_label(timeaxis.month_start(year, month))
    means = members.groupBy(*keys, label.alias("_label")).agg(F.avg(value).alias(value))
    named = means.withColumns({"season": timeaxis.season(F.month("_label")), "season_year": timeaxis.season_year(F.year("_label"), F.month("_label"))})
    return named.where(F.col("season_year").between(first_year, last_year)).select(*keys, "season", "season_year", value)


def seasonal_metrics(rows: DataFrame, keys: list[str], names: list[str], steps: int | None = None, member: str = "member") -> DataFrame:
    """keys, season, metric, value. Events of so many years pool years and members, by distributed selection; other metrics are means over members of each member's own."""
    own = [n for n in names if not n.endswith("yr_event")]
    pooled = [n for n in names if n.endswith("yr_event")]
    by, parts = [*keys, "season"], []
    if own:
        stepped = rows.withColumn("t", (F.col("season_year") - F.min("season_year").over(Window.partitionBy("season"))).cast("int")) if any(n.startswith("var_") for n in own) else rows
        parts.append(metrics.named(stepped, [*by, member], own, steps).groupBy(*by, "metric").agg(F.avg("value").alias("value")))
    if pooled:
        levels = metrics.pooled_return_levels(rows, by, [metrics.recurrence_years(n) for n in pooled])
        parts.append(levels.select(*by, F.concat(F.col("return_period").cast("string"), F.lit("yr_event")).alias("metric"), F.col("level").alias("value")))
    return reduce(DataFrame.unionByName, parts)


KEYS = ["variable", "kind", "cell"]


def write_all(stages: Stages, members: Stage, cells: DataFrame, edges: DataFrame, first_year: int, last_year: int, names: list[str], return_periods: list[int], components: int = 3) -> dict[str, Stage]:
    """All products of a run's members (variable, kind, member, cell, t, value). cells: cell, lat, lon. A product is kept by what it depends on, and partitioned by what it is read by."""
    span = [first_year, last_year]
    steps = 12 * (last_year - first_year + 1)
    seasons = stages.kept("seasons", lambda: seasonal(members.rows, ["variable", "kind", "member", "cell"], first_year, last_year), members, span, partition=("variable", "kind", "season"))
    out = {"seasons": seasons}
    out["metrics"] = stages.kept("seasonal-metrics", lambda: seasonal_metrics(seasons.rows, KEYS, names, last_year - first_year + 1), seasons, names, partition=("variable", "metric"))
    out["extremes"] = stages.kept("pooled-extremes", lambda: metrics.pooled_return_levels(seasons.rows, [*KEYS, "season"], return_periods), seasons, return_periods, partition=("variable", "season"))
    shape = [str(sorted(map(str, edges.collect())))]  # the vertices of the regions asked for, not of the cells
    out["regional"] = stages.kept("regional-series", lambda: regions.region_means(seasons.rows, cells, edges, ["variable", "kind", "member", "season", "season_year"], align.cos_weight(F.col("lat"))), seasons, shape, partition=("variable", "season"))

    def decomposed() -> DataFrame:
        month = (F.col("t") % 12).alias("_month")
        rows = members.rows.where("kind = 'full'").select("variable", "member", "cell", "t", month, "value").join(cells.select("cell", F.sqrt(align.cos_weight(F.col("lat"))).alias("weight")), "cell")
        rows = rows.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("variable", "member", "cell", "_month"))).drop("_month")
        patterns, series = spectra.low_frequency_components(rows, ["variable", "member"], steps, 10, components, 0.05)
        return align.stacked({"pattern": patterns.select("variable", "member", "component", F.col("cell").alias("at"), F.col("pattern").alias("value")), "series": series.select("variable", "member", "component", F.col("t").cast("long").alias("at"), "value")}, "part")

    out["components"] = stages.kept("components", decomposed, members, components, partition=("variable", "part"))
    return out
