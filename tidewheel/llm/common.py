"""What the operators of this subpackage share: the folder all executors see, and word splitting."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of anything but a space and the bytes 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Tables written by operators in this process, for ``release``.
_WRITTEN: list[str] = []


def tidy() -> None:
    """Memory that a task no longer uses goes back to the system: a Python worker waits for more tasks and would keep it beside theirs."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@functools.cache
def _trim() -> Callable | None:
    """That of the GNU C library, where it is the one in use."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over a partition's batches, tidy at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one in local mode; on a cluster that is an error, as executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "tidewheel"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidewheel-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here and lost executors cost nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    _WRITTEN.append(path)
    tidy()  # the driver's Python, too, would keep what it had collected for earlier tables
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder, whatever store it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written_so_far() -> int:
    """To be given to ``release``."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes all tables that operators have written in this process, or those since a number of them: to be called once results are stored, as they are read lazily."""
    while len(_WRITTEN) > since:
        dropped(spark, _WRITTEN.pop())
