"""Regions as tables of edges: GeoJSON features with any number of polygons and holes, and which cells are in them.

A cell is in a region if a ray from it crosses the region's edges an odd number of times; holes are
edges like any others. Cells and edges meet by bands of latitude, so a cell is compared with the
edges that reach its band and not with all, and neither side has to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import weighted_mean

#: Degrees of latitude in a band.
BAND = 5.0


def features(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """region, ring (a number within the region), seq, lon, lat: the vertices of all polygons of a GeoJSON file's features."""
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    each = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.posexplode("features").alias("place", "f"))
    shape, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygons = F.when(shape == "Polygon", F.array(F.from_json(text, one))).when(shape == "MultiPolygon", F.from_json(text, many))
    rings = each.select(F.coalesce(F.col("f.properties")[name], F.col("place").cast("string")).alias("region"), F.posexplode(F.flatten(polygons)).alias("ring", "points"))
    return rings.select("region", "ring", F.posexplode("points").alias("seq", "at")).select("region", "ring", "seq", F.col("at")[0].alias("lon"), F.col("at")[1].alias("lat"))


def edges(vertices: DataFrame, shift: float = 0.0) -> DataFrame:
    """vertices (region, ring, seq, lon, lat) to region, x1, y1, x2, y2. Rings are closed; shift is added to longitudes. Level edges, which no ray crosses, are left out. A ring's points are the input's own arrays."""
    points = vertices.groupBy("region", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))).alias("p"))
    ends = points.select("region", F.inline(F.transform("p", lambda a, i: F.struct((a["lon"] + shift).alias("x1"), a["lat"].alias("y1"), (F.get("p", (i + 1) % F.size("p"))["lon"] + shift).alias("x2"), F.get("p", (i + 1) % F.size("p"))["lat"].alias("y2")))))
    return ends.where("y1 <> y2")


def _band(lat: Column) -> Column:
    return F.floor(lat / BAND).cast("int")


def cells_in(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """cells (cell, lon, lat) to region, cell for each region that a cell is in. A cell on an edge belongs to one side of it."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    reaching = edges.withColumn("band", F.explode(F.sequence(_band(low), _band(high))))
    both = cells.select("cell", "lon", "lat", _band(F.col("lat")).alias("band")).join(reaching, "band")
    crossed = both.where(((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")))
    return crossed.groupBy("region", "cell").agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select("region", "cell")


def region_means(series: DataFrame, cells: DataFrame, edges: DataFrame, by: list[str], weight: Column, value: str = "value", strict: bool = False) -> DataFrame:
    """region, by, mean: weighted means of series (cell, by, value) over the cells of each region. Weights of missing values count in the denominator unless strict."""
    own = series.join(cells_in(cells, edges), "cell").join(cells.select("cell", weight.alias("_w")), "cell")
    return weighted_mean(own, ["region", *by], value, F.col("_w"), strict)
