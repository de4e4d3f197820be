"""Functions of whole series for SQL: table functions over partitions, by name.

After ``register(spark)``::

    SELECT * FROM surrogates(TABLE(series) PARTITION BY mode ORDER BY t, members => 4)
    SELECT * FROM spectrum(TABLE(series) PARTITION BY mode ORDER BY t, dt => 0.0833)

The table has the columns mode (any type, text in the result), t and value; a partition is one series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators import spectra


def _checked(table: AnalyzeArgument, *names: str) -> None:
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    missing = set(names) - {f.name for f in table.dataType.fields}
    if missing:
        raise ValueError(f"the table has no column {sorted(missing)[0]}")


class Surrogates:
    """member, mode, t, value: random series with the values and nearly the spectrum of each mode's."""

    def __init__(self):
        self.rows, self.members, self.seed, self.cycle = [], 1, 456, 0

    @staticmethod
    def analyze(table: AnalyzeArgument, members: AnalyzeArgument, seed: AnalyzeArgument | None = None, cycle: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(table, "mode", "t", "value")
        schema = StructType().add("member", IntegerType()).add("mode", StringType()).add("t", IntegerType()).add("value", DoubleType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("mode")], orderBy=[OrderingColumn("t")])

    def eval(self, table: Row, members: int, seed: int = 456, cycle: int = 0) -> None:
        self.rows.append((table["mode"], table["t"], table["value"]))
        self.members, self.seed, self.cycle = members, seed, cycle

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            mode, x = str(self.rows[0][0]), np.array([v for _, _, v in self.rows], float)
            for member in range(self.members):
                for (_, t, _), value in zip(self.rows, spectra.settled(x, self.seed, member, mode, self.cycle or None).tolist()):
                    yield member, mode, int(t), value


class Spectrum:
    """mode, k, frequency, power, upper, lower of each series."""

    def __init__(self):
        self.rows, self.dt = [], 1.0

    @staticmethod
    def analyze(table: AnalyzeArgument, dt: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(table, "mode", "t", "value")
        schema = StructType().add("mode", StringType()).add("k", IntegerType())
        for name in ("frequency", "power", "upper", "lower"):
            schema = schema.add(name, DoubleType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("mode")], orderBy=[OrderingColumn("t")])

    def eval(self, table: Row, dt: float = 1.0) -> None:
        self.rows.append((table["mode"], table["value"]))
        self.dt = float(dt)

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            found = spectra.multitaper(np.array([v for _, v in self.rows], float), self.dt)
            for k, row in enumerate(zip(*(found[c].tolist() for c in ("frequency", "power", "upper", "lower")))):
                yield str(self.rows[0][0]), k, *row


#: Table functions by their names in SQL.
TABLES = {"surrogates": Surrogates, "spectrum": Spectrum}


def register(spark: SparkSession) -> None:
    for name, function in TABLES.items():
        spark.udtf.register(name, udtf(function))
