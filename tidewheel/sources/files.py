"""Series from files: lists of files along time, variables beside each other, members by path, regions, archives."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, and one slash after that."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub(ONE_SLASH, r"\1:/", own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toUri().toString()).rstrip("/")


ONE_SLASH = r"^([A-Za-z][A-Za-z0-9+.-]*):/+"


def overlaps(ranges: list[tuple]) -> list[tuple]:
    """The stretches that two or more of the ranges (first, last) have, joined where they touch."""
    out: list[list] = []
    reach = None
    for first, last in sorted(ranges):
        if reach is not None and first <= reach:
            stretch = [first, min(last, reach)]
            if out and stretch[0] <= out[-1][1]:
                out[-1][1] = max(out[-1][1], stretch[1])
            else:
                out.append(stretch)
        reach = last if reach is None else max(reach, last)
    return [tuple(x) for x in out]


def along_time(spark: SparkSession, paths: list[str], order: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """All files' rows as one series, whose order comes from order and not from the files. Steps that two files have keep the value of the later path.

    One scan has all files; a file's place in the list comes from its name by a join with the list. Only
    rows of stretches that two files' times share are shuffled for precedence; others are read as they are.
    """
    by = [*(keys or []), order]
    listed = spark.createDataFrame([(_qualified(spark, p), k) for k, p in enumerate(paths)], "_path string, _file int")
    rows = spark.read.parquet(*paths)
    others = [c for c in rows.columns if c not in by]
    named = rows.select(*by, *others, F.regexp_replace("_metadata.file_path", ONE_SLASH, "$1:/").alias("_from"))
    # a path is a file or the folder of its parts
    folder = F.regexp_replace("_from", "/[^/]*$", "")
    found = named.select("_from").distinct().withColumn("_path", F.explode(F.array("_from", folder))).join(F.broadcast(listed), "_path").groupBy("_from").agg(F.max("_file").alias("_file"))
    placed = named.join(F.broadcast(found), "_from", "left").withColumn("_file", F.coalesce("_file", F.raise_error(F.concat(F.lit("no path of the list has the file "), "_from")).cast("int")))
    ranges = [tuple(r) for r in placed.groupBy("_file").agg(F.min(order), F.max(order)).where(F.col(f"min({order})").isNotNull()).collect()]  # a row for each path
    shared = overlaps([(first, last) for _, first, last in ranges])
    own = [(k, [(max(a, first), min(b, last)) for a, b in shared if a <= last and b >= first]) for k, first, last in ranges]
    kind = rows.schema[order].dataType.simpleString()
    stretches = spark.createDataFrame([x for x in own if x[1]], f"_file int, _shared array<struct<a:{kind},b:{kind}>>")
    placed = placed.join(F.broadcast(stretches), "_file", "left")
    within = F.coalesce(F.exists("_shared", lambda x: F.col(order).between(x["a"], x["b"])), F.lit(False)) | F.col(order).isNull()
    alone = placed.where(~within).select(*by, *others)
    last = placed.where(within).groupBy(*by).agg(F.max_by(F.struct(*others), "_file").alias("_last"))
    return alone.unionByName(last.select(*by, *[F.col("_last")[c].alias(c) for c in others]))


def merged(variables: dict[str, DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """keys and a column for each variable: all coordinates that any of them has, null where one has none."""
    parts = [df.select(*keys, F.lit(name).alias("_name"), F.col(value).alias("_value")) for name, df in variables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).pivot("_name", list(variables)).agg(F.first("_value", ignorenulls=True))


def member_of(path: Column, pattern: str = r"member=?_?(\d+)") -> Column:
    """The member's number in a file's path."""
    return F.regexp_extract(path, pattern, 1).try_cast("int")


def matching(spark: SparkSession, folder: str, glob: str = "*.parquet", member_pattern: str = r"member=?_?(\d+)") -> DataFrame:
    """All files below a folder whose name fits glob, with the member that their path names. Other files aren't opened."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(folder)
    return rows.withColumn("member", member_of(F.col("_metadata.file_path"), member_pattern))


def polygon(spark: SparkSession, path: str, shift: float = 360.0) -> list[tuple[float, float]]:
    """The outer ring of the first feature of a GeoJSON file as (lon, lat), longitudes moved by shift. A ring is a handful of vertices."""
    read = spark.read.option("multiLine", "true").schema("features array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>>>").json(path)
    ring = read.select(F.posexplode(F.col("features")[0]["geometry"]["coordinates"][0]).alias("seq", "at")).orderBy("seq").select((F.col("at")[0] + shift).alias("lon"), F.col("at")[1].alias("lat")).collect()
    vertices = [(r["lon"], r["lat"]) for r in ring]
    return vertices[:-1] if len(vertices) > 1 and vertices[0] == vertices[-1] else vertices


def surrogate_archive(spark: SparkSession, paths: list[str], members_a_file: int) -> DataFrame:
    """Surrogates kept in several tables (t, n, and modes): member is counted on from file to file."""
    parts = [spark.read.parquet(p).withColumn("member", (F.col("n") + k * members_a_file).cast("int")).drop("n") for k, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def with_unit(df: DataFrame, value: str, unit: str) -> DataFrame:
    """The unit goes with the column, as metadata."""
    return df.withMetadata(value, {"unit": unit})


def unit_of(df: DataFrame, value: str, known: tuple[str, ...] = ("K", "C", "m/s", "mm/month", "mm/day", "Pa")) -> str:
    """A column's unit; one that isn't known is an error."""
    unit = df.schema[value].metadata.get("unit")
    if unit not in known:
        raise ValueError(f"{value} has the unit {unit!r}")
    return unit
