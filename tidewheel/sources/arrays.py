"""Array archives (.npz and .npy) as a data source: a row for each value.

``spark.read.format("arrays").option("paths", ...)`` gives file (the place of the file in the list),
name (of the array; a file's name for .npy), row, step and value. Arrays have one axis (one row of
steps) or two. Planning reads the headers alone; a task has a range of an array's rows and seeks to it
where the archive isn't compressed. Filters on file, name and row leave out partitions before any
task starts. Paths may be local or URIs that Arrow's file systems open.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "file int, name string, row int, step int, value double"
#: Values of a partition, about.
VALUES_A_TASK = 4_000_000


@dataclass
class Rows(InputPartition):
    path: str
    file: int
    name: str
    first: int
    last: int


def _opened(path: str):
    """A seekable file of any file system that Arrow knows."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether columns come first, and kind of the array that begins here."""
    read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(stream) == (1, 0) else np.lib.format.read_array_header_2_0
    return read(stream)


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".npy")


class ArrayReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths, self.wanted = paths, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of file, name and row with a value are settled here; the rest go back."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column in (("file",), ("name",), ("row",)) and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.wanted.append(f)
            else:
                yield f

    def _range(self, column: str, n: int) -> tuple[int, int]:
        """The first and last of n numbers that filters let through, at most."""
        first, last = 0, n - 1
        for f in self.wanted:
            if f.attribute == (column,):
                low, high = {EqualTo: lambda v: (v, v), In: lambda v: (min(v, default=n), max(v, default=-1)), GreaterThan: lambda v: (v + 1, last), GreaterThanOrEqual: lambda v: (v, last), LessThan: lambda v: (first, v - 1), LessThanOrEqual: lambda v: (first, v)}[type(f)](f.value)
                first, last = max(first, low), min(last, high)
        return first, last

    def _passes(self, column: str, value: object) -> bool:
        test = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        return all(test[type(f)](value, f.value) for f in self.wanted if f.attribute == (column,))

    def partitions(self) -> list[Rows]:
        out = []
        for k, path in enumerate(self.paths):
            if not self._passes("file", k):
                continue
            with _opened(path) as stream:
                if path.endswith(".npy"):
                    shapes = {_stem(path): _header(stream)[0]}
                else:
                    with zipfile.ZipFile(io.BufferedReader(stream)) as archive:
                        shapes = {}
                        for member in archive.namelist():
                            with archive.open(member) as own:
                                shapes[_stem(member)] = _header(own)[0]
            for name, shape in shapes.items():
                if not self._passes("name", name):
                    continue
                if len(shape) not in (1, 2):
                    raise ValueError(f"{name} of {path} has {len(shape)} axes")
                rows, steps = (1, shape[0]) if len(shape) == 1 else shape
                first, last = self._range("row", rows)
                size = max(1, VALUES_A_TASK // max(steps, 1))
                out += [Rows(path, k, name, a, min(a + size - 1, last)) for a in range(first, last + 1, size)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as stream:
            if partition.path.endswith(".npy"):
                yield from self._batches(stream, partition)
            else:
                with zipfile.ZipFile(io.BufferedReader(stream)) as archive, archive.open(f"{partition.name}.npy") as own:
                    yield from self._batches(own, partition)

    def _batches(self, stream, at: Rows) -> Iterator[pa.RecordBatch]:
        shape, by_column, kind = _header(stream)
        if kind.hasobject:
            raise ValueError(f"{at.name} of {at.path} holds objects")
        rows, steps = (1, shape[0]) if len(shape) == 1 else shape
        if by_column and len(shape) == 2:
            block = np.frombuffer(stream.read(), kind).reshape(steps, rows).T[at.first : at.last + 1]
        else:
            stream.seek(stream.tell() + at.first * steps * kind.itemsize)
            block = np.frombuffer(stream.read((at.last + 1 - at.first) * steps * kind.itemsize), kind).reshape(-1, steps)
        for k, values in enumerate(block):
            if self._passes("row", at.first + k):
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at.file, np.int32)), pa.array([at.name] * n, pa.string()), pa.array(np.full(n, at.first + k, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(values.astype(np.float64))], ["file", "name", "row", "step", "value"])


class ArrayFiles(DataSource):
    """format("arrays"); option paths: file names, one a line."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        paths = [p for p in self.options.get("paths", "").split("\n") if p]
        if odd := [p for p in paths if not p.endswith((".npz", ".npy"))]:
            raise ValueError(f"{odd[0]} is no array file")
        return ArrayReader(paths)


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, name, row, step, value of the arrays in paths. NaN stays NaN."""
    spark.dataSource.register(ArrayFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("arrays").option("paths", "\n".join(paths)).load()


def surrogate_archive(spark: SparkSession, paths: list[str], members_a_file: int, names: dict[str, str] | None = None) -> DataFrame:
    """member, mode, t, value of surrogates kept in several archives: member is counted on from file to file. names: modes by the names of their arrays; others are left out."""
    rows = read(spark, paths)
    if names:
        rows = rows.where(F.col("name").isin(list(names)))
        mode = F.coalesce(*[F.when(F.col("name") == a, F.lit(m)) for a, m in names.items()])
    else:
        mode = F.col("name")
    return rows.select((F.col("file") * members_a_file + F.col("row")).cast("int").alias("member"), mode.alias("mode"), F.col("step").alias("t"), "value")
