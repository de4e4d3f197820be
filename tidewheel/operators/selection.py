"""Values of given ranks by key, without any key's values in one task.

Rows are dealt into ranges of (keys, value) and sorted within them. How many rows of a key stand in
each range, and from which row on, is a table with no more rows than there are keys and ranges; running
sums over it say in which range a rank is and at which row. A key may span any number of ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Up to so many wanted rows go to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass
class Dealt:
    rows: DataFrame
    keys: list[str]
    value: str

    def pieces(self) -> DataFrame:
        """keys, part, n, first (number of the range's first row of the key), before (rows of the key in earlier ranges)."""
        found = self.rows.groupBy(*self.keys, "_part").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
        earlier = Window.partitionBy(*self.keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        return found.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    def counts(self) -> DataFrame:
        """keys, n."""
        return self.rows.groupBy(*self.keys).agg(F.count("*").alias("n"))

    def at_ranks(self, wanted: DataFrame) -> DataFrame:
        """wanted (keys, rank from 1, and other columns) with the value of that rank; ranks that a key doesn't have are left out."""
        found = wanted.join(self.pieces(), self.keys).where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n")))
        at = written(found.select(*wanted.columns, (F.col("first") + F.col("rank") - F.col("before") - 1).alias("_row")), "ranks")
        at = F.broadcast(at) if at.count() <= BROADCAST_ROWS else at.hint("merge")
        return self.rows.select("_row", self.value).join(at, "_row").select(*wanted.columns, self.value)


def dealt(df: DataFrame, keys: list[str], value: str = "value") -> Dealt:
    """df's values that are there, in ranges. The table is written, so that rows keep their numbers."""
    by = [*keys, value]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(value).isNotNull()).select(*by).repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    return Dealt(written(rows.select(*by, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "ranges"), keys, value)
