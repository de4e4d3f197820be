"""Products as partitioned Parquet, a run's parameters, and results kept by a digest of what they depend on."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Variable:
    """A variable of a run: its name, its transform, and the member whose exponents all members use (None: its own)."""

    name: str
    transform: str | None = None
    exponents_of: int | None = None


@dataclass(frozen=True)
class Parameters:
    variables: tuple[Variable, ...] = (Variable("order_value"),)
    #: The member of the source ensemble, where the cube has several.
    source_member: int | None = None
    first_year: int = 1995
    last_year: int = 2000
    predictors: tuple[str, ...] = ("constant", "enso", "pdo_orth")
    low_pass_cutoff: float = 0.0
    #: Modes act on what comes so many months later.
    lag: int = 0
    members: int = 4
    seed: int = 123


def write_parameters(spark: SparkSession, parameters: Parameters, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(parameters), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_members(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Partitioned by variable, kind and member; an existing product stays unless overwrite."""
    df.write.mode("overwrite" if overwrite else "ignore").partitionBy("variable", "kind", "member").parquet(path)


def read_members(spark: SparkSession, path: str, members: list[int] | None = None) -> DataFrame:
    """Only the folders of the wanted members are read."""
    df = spark.read.parquet(path)
    return df if members is None else df.where(F.col("member").isin(members))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode a temporary one where it is unset, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "tidewheel"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and rows stay as they are."""
    path = f"{shared_dir(df.sparkSession)}/tidewheel-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the files below paths: their names, sizes and times. No column of theirs is read, and the names don't come to the driver."""
    files = reduce(DataFrame.unionByName, [spark.read.parquet(p).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time") for p in paths]).distinct()
    told = files.select(F.xxhash64(F.lit(1), "*").alias("a"), F.xxhash64(F.lit(2), "*").alias("b")).agg(F.count("*"), F.bit_xor("a"), F.bit_xor("b")).first()
    return hashlib.sha256(json.dumps([sorted(paths), *told]).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Stage:
    """A stored result and the digest of all that it depends on."""

    rows: DataFrame
    digest: str


class Stages:
    """Results below a folder, each named by a digest of its name, its parameters and the digests of what it was made from.

    Other parameters, other input files or another upstream stage give another folder, so nothing is
    ever read that was made from something else. A result counts from when Spark's job committed it,
    which leaves a marker; a folder without one was interrupted and is made anew.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder, []

    def path(self, name: str, digest: str) -> str:
        return f"{self.folder}/{name}-{digest}"

    def committed(self, path: str) -> bool:
        marker = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)

    def kept(self, name: str, make: Callable[[], DataFrame], *depends: object, partition: tuple[str, ...] = ()) -> Stage:
        """What make gives, read if an earlier run has made it from the same. depends: stages, digests and parameters."""
        told = [d.digest if isinstance(d, Stage) else d for d in depends]
        digest = hashlib.sha256(json.dumps([name, *told], sort_keys=True).encode()).hexdigest()[:16]
        path = self.path(name, digest)
        if not self.committed(path):
            make().write.mode("overwrite").partitionBy(*partition).parquet(path)
            self.made.append(name)
        return Stage(self.spark.read.parquet(path), digest)
