"""Sharding by fixed virtual slots.

Rows are hashed into thousands of virtual slots. Bytes are added up per slot (a table of at most
``vslots`` rows), and a stored map from slots to shards is edited until the shards hold nearly equal
bytes. The map is a table of versions: a later run loads the last one and edits that, so few slots
move. Only DataFrame functions touch rows; the driver sees the slot table alone, whose size is fixed
by ``vslots``.

Rows that are equal in id, checksum and size are told apart by a number each, which is hashed as
well, so repeated rows spread over the slots like any others. Groups (equal texts) are not kept
together: the law is that of bytes, and a group may hold a third of all rows.

Null ids are values like any other; a null text has size 1 (no bytes plus one) and a null checksum;
repeated rows are all placed, each with a place of its own; texts of any length count whole; an
empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, table

VSLOTS = 4096
#: Slots are swapped until shards' loads differ by this share of their mean at most, or no swap helps.
EVEN = 0.001
#: Rows of a bucket, within which places are counted; and equal rows that are numbered at once.
BUCKET_ROWS, AT_ONCE = 20_000, 4096


def first_map(vslots: int, shards: int) -> list[int]:
    """Version 1: slots dealt round."""
    return [v % shards for v in range(vslots)]


def rebalanced(slot_shard: list[int], slot_bytes: list[int], shards: int) -> list[int]:
    """The map edited so that shards hold nearly equal bytes.

    An edit moves one slot from the heaviest shard to the lightest, the slot whose bytes come closest
    to half of the difference. Where no move makes the difference smaller and it is over EVEN of the
    mean load, two slots of these shards are swapped that do. The sum of the shards' squared loads
    falls with every edit, so it comes to an end. Slots of a shard that no longer exists are moved first.
    """
    out = [s if s < shards else v % shards for v, s in enumerate(slot_shard)]
    held: list[set[int]] = [set() for _ in range(shards)]
    load = [0] * shards
    for slot, shard in enumerate(out):
        held[shard].add(slot)
        load[shard] += slot_bytes[slot]
    while True:
        high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        fit = min((v for v in held[high] if 0 < slot_bytes[v] < gap), key=lambda v: (abs(2 * slot_bytes[v] - gap), v), default=None)
        back = None
        if fit is None:
            if gap <= EVEN * sum(load) / shards or (swap := _best_swap(held[high], held[low], slot_bytes, gap)) is None:
                return out
            fit, back = swap
        for slot, there, here in ((fit, high, low), (back, low, high)):
            if slot is not None:
                held[there].remove(slot)
                held[here].add(slot)
                load[there] -= slot_bytes[slot]
                load[here] += slot_bytes[slot]
                out[slot] = here


def _best_swap(high: set[int], low: set[int], slot_bytes: list[int], gap: int) -> tuple[int, int] | None:
    """A slot of each shard whose bytes differ by nearly half of gap."""
    others = sorted((slot_bytes[v], v) for v in low)
    best = None
    for v in high:
        at = bisect_left(others, (slot_bytes[v] - gap / 2,))
        for b, w in others[max(0, at - 1) : at + 1]:
            more = slot_bytes[v] - b
            if 0 < more < gap:
                best = min(best or (gap, 0, 0), (abs(2 * more - gap), v, w))
    return best and best[1:]


def _numbers(values: list[int], kind: str) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def add_version(spark: SparkSession, path: str, version: int, slot_shard: list[int]) -> None:
    """One more version of the stored map: rows (version, vslot, shard)."""
    rows = spark.range(0, len(slot_shard), 1, 1).select(F.lit(version).alias("version"), F.col("id").alias("vslot"), F.get(_numbers(slot_shard, "int"), F.col("id").cast("int")).alias("shard"))
    rows.write.mode("append").parquet(path)


def last_version(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The number of the stored map's last version, and its shards by slot."""
    stored = spark.read.parquet(path)
    last = stored.agg(F.max("version")).first()[0]
    return last, [r["shard"] for r in stored.where(F.col("version") == last).orderBy("vslot").collect()]


def told_apart(sized: DataFrame) -> DataFrame:
    """sized (doc_id, size, text_crc32), with a number for each of equal rows: a row for each group and count crosses the network, and large groups are dealt out before they are numbered."""
    groups = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    few = groups.where(F.col("n") <= AT_ONCE).select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("number"))
    parts = groups.where(F.col("n") > AT_ONCE).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / AT_ONCE)))).repartition("doc_id", "text_crc32", "part")
    first = F.col("part") * AT_ONCE
    many = parts.select("doc_id", "size", "text_crc32", F.explode(F.sequence(first, F.least(first + AT_ONCE, F.col("n")) - 1)).alias("number"))
    return few.unionByName(many)


def shard(df: DataFrame, shards: int = 8, vslots: int = VSLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (place in the shard, from 0 without gaps), grown_shard (null), vslot.

    map_path: where the map is stored. If it has versions, the last one is loaded and edited; each
    call that changes it adds a version, and rows are placed by the version then stored.
    """
    spark, text = df.sparkSession, F.col(text_col).cast("string")
    sized = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = told_apart(sized).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "number"), F.lit(vslots)).cast("int"))
    slot_bytes, slot_rows = [0] * vslots, [0] * vslots
    for v, b, n in placed.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect():  # at most vslots rows
        slot_bytes[v], slot_rows[v] = b, n
    if map_path is None:
        map_path = new_path(spark, "slot-map")
        add_version(spark, map_path, 1, first_map(vslots, shards))
    version, now = last_version(spark, map_path)
    edited = rebalanced(now, slot_bytes, shards)
    if edited != now:
        add_version(spark, map_path, version + 1, edited)
    _, now = last_version(spark, map_path)
    filled, before = [0] * shards, [0] * vslots
    for v, s in enumerate(now):
        before[v] = filled[s]
        filled[s] += slot_rows[v]
    # places are counted within buckets of bounded size; what comes before a bucket follows from the buckets' row counts
    buckets = max(1, -(-max(slot_rows, default=0) // bucket_rows))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "number", F.lit(3)), F.lit(buckets)).cast("int"))
    within = F.row_number().over(Window.partitionBy("vslot", "bucket").orderBy("doc_id", "text_crc32", "size", "number"))
    numbered = placed.withColumn("within", within)
    if buckets > 1:
        counts = placed.groupBy("vslot", "bucket").agg(F.count("*").alias("n"))
        bases = counts.select("vslot", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("vslot").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        numbered = numbered.join(bases.hint("merge"), ["vslot", "bucket"])
    else:
        numbered = numbered.withColumn("base", F.lit(0))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        F.get(_numbers(now, "int"), F.col("vslot")).alias("shard"),
        (F.get(_numbers(before, "bigint"), F.col("vslot")) + F.col("base") + F.col("within") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )


def op10_fixed_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
