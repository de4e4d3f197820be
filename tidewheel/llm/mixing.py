"""Mixing sources to target weights.

The words of a source, document after document, are packed into blocks of fixed length (64 words;
fewer in sources that would have less than 64 blocks). Each source gets as many slots as its target asks
for. Its slots are drawn to the output shards one by one, so a source's counts over the shards are
multinomial given its total, which stays exact (and no block is taken more often than passes allow). A shard's slots of a source are a range of the source's slots;
slots are mapped to blocks through a keyed pseudorandom permutation of the source's block indexes (a
Feistel network over a grid just larger than their number, walked until it hits an index), one for
every pass over the source, and joined with the blocks by index. ``assembled`` is the mix itself;
``mix`` says how many words of each document it has. Only DataFrame functions are used.

Sources are ordered by code point, null last; they weigh 1, 2, 3, 1, 2, 3 and so on and share 100 %
of all words. A target stops at three times its source's words and the excess is shared again by
weight. Null and empty texts have size 0 and are never taken. Null ids are ordinary values;
repeated rows are separate rows with words of their own. An empty table gives no rows.

The result is a pure function of the rows and the seed. Ids are bucketed by hash, so no window ever
holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

BLOCK_WORDS = 64
#: A source has so many blocks at least, or a block for each word: small sources are packed into smaller blocks, so that whole blocks come near their targets too.
LEAST_BLOCKS = 64
OUTPUT_SHARDS = 16
MOST_PASSES = 3
BUCKET_ROWS = 20_000
SLOTS_A_CHUNK = 4096
#: Rounds of the permutation, and steps after which a walk over its grid has left it: fewer than one in 31^24 starts go on for longer, and those raise an error.
ROUNDS, MOST_STEPS = 6, 24


def source_targets(sizes: DataFrame, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Sharing the excess again and again ends where every source has min(most * size, weight * level).
    With sources sorted by the level at which they fill up, the level follows from running sums.
    The table has one row per source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", F.pmod(F.col("place") - 1, F.lit(3)) + 1)
    by_full = Window.orderBy("full_at", "place")
    levels = ranked.withColumn("full_at", most * F.col("source_size") / F.col("weight")).withColumns({
        "total": F.sum("source_size").over(everything),
        "filled": F.coalesce(F.sum(most * F.col("source_size")).over(by_full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weights": F.sum("weight").over(by_full.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).withColumn("level", (F.col("total") - F.col("filled")) / F.col("weights"))
    # of sources that fill up at the same level, the first has the running sums that leave out none of them
    level = F.min_by(F.when(F.col("full_at") > F.col("level"), F.col("level")), F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "place"))).over(everything)
    return levels.withColumn("last_level", level).select(
        "source", "source_size", "weight",
        F.least(most * F.col("source_size").cast("double"), F.coalesce(F.col("weight") * F.col("last_level"), most * F.col("source_size").cast("double"))).alias("target"),
    )


def _block_of(place: Column, pass_no: Column, seed: int) -> Column:
    """Slot place -> block index, a permutation of 0 .. n_blocks - 1 for each source and pass.

    A place is a point of a grid of a x b points, a and b about the square root of n_blocks. A round
    moves its column by a hash of its row, then its row by a hash of its column; both can be undone,
    so rounds permute the grid. Points beyond n_blocks go on until they are below it.
    """
    n = F.col("n_blocks")
    a = F.ceil(F.sqrt(n)).cast("long")
    b = F.ceil(n / a).cast("long")
    key = F.xxhash64("src", pass_no, F.lit(seed))

    def turned(at, i):
        column = F.pmod(at["c"] + F.pmod(F.xxhash64(at["r"], i, key), a), a)
        return F.struct(column.alias("c"), at["r"].alias("r"))

    def raised(at, i):
        return F.struct(at["c"].alias("c"), F.pmod(at["r"] + F.pmod(F.xxhash64(at["c"], -i, key), b), b).alias("r"))

    def permuted(x):
        first = F.struct(F.pmod(x, a).alias("c"), F.floor(x / a).cast("long").alias("r"))
        steps = F.sequence(F.lit(1), F.lit(ROUNDS))
        return F.aggregate(steps, first, lambda at, i: F.when(i % 2 == 1, turned(at, i)).otherwise(raised(at, i)), lambda at: at["r"] * a + at["c"])

    once = permuted(place)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), once, lambda x, _: F.when(x < n, x).otherwise(permuted(x)))
    return F.when(once < n, once).when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk did not end")))


def block_length(block_words: int) -> Column:
    """Words of a source's blocks."""
    return F.greatest(F.lit(1).cast("long"), F.least(F.lit(block_words).cast("long"), F.floor(F.col("source_size") / LEAST_BLOCKS)))


def laid_out(df: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's stream of words, and the source table."""
    sized = written(df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ), "mix-sizes")
    buckets = max(64, sized.count() // BUCKET_ROWS)
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).select(F.col("source").alias("source_name"), "source_size", "weight", "target", "src")
    docs = sized.join(sources, F.col("source").eqNullSafe(F.col("source_name"))).select("doc_id", "size", "source", "source_size", "target", "src", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).alias("bucket"))
    sums = docs.groupBy("src", "bucket").agg(F.sum("size").alias("n")).select("src", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = docs.withColumn("within", within).join(sums, ["src", "bucket"]).withColumn("start", F.col("base") + F.col("within")).drop("base", "within", "bucket")
    return placed, sources


def _numbered(ranges: DataFrame, first: Column, count: Column, name: str) -> DataFrame:
    """A row for each number of each range, made in chunks that are dealt out before."""
    chunks = ranges.withColumns({"_first": first, "_count": count}).where("_count > 0").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_count") - 1) / SLOTS_A_CHUNK))))
    # few and short rows that become many: with a number of its own, this exchange isn't coalesced to one task
    chunks = chunks.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "_first", "_chunk")
    at = F.col("_first") + F.col("_chunk") * SLOTS_A_CHUNK
    return chunks.withColumn(name, F.explode(F.sequence(at, F.least(at + SLOTS_A_CHUNK, F.col("_first") + F.col("_count")) - 1))).drop("_first", "_count", "_chunk")


def shard_counts(sources: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 9, output_shards: int = OUTPUT_SHARDS) -> DataFrame:
    """(src, shard, n_blocks, first, n): how many of a source's slots each output shard has, and the first of them. Each slot is a draw of one of the shards."""
    planned = sources.where("source_size > 0 and target > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block_length(block_words)).cast("long"))
    planned = planned.withColumn("n_slots", F.least(MOST_PASSES * F.col("n_blocks"), F.round(F.col("target") / F.col("source_size") * F.col("n_blocks")).cast("long"))).select("src", "n_blocks", "n_slots")
    drawn = _numbered(planned, F.lit(0).cast("long"), F.col("n_slots"), "draw")
    counts = drawn.groupBy("src", "n_blocks", F.pmod(F.xxhash64("src", "draw", F.lit(seed + 2)), F.lit(output_shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 9, output_shards: int = OUTPUT_SHARDS) -> DataFrame:
    """(shard, src, slot, pass_no, place, block): every slot of the mix, by output shard, with the block that it takes."""
    counts = written(shard_counts(sources, block_words, seed, output_shards), "mix-counts")
    each = _numbered(counts, F.col("first"), F.col("n"), "slot").withColumns({"pass_no": F.floor(F.col("slot") / F.col("n_blocks")), "place": F.pmod("slot", "n_blocks")})
    return each.select("shard", "src", "slot", "pass_no", "place", _block_of(F.col("place"), F.col("pass_no"), seed).alias("block"))


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """placed, cut at block ends: block (null for documents without words), begin (a place among the source's words) and words."""
    end, length = F.col("start") + F.col("size"), block_length(block_words)
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length)))))
    begin = F.greatest("start", F.col("block") * length)
    return pieces.withColumns({"begin": begin, "words": F.coalesce(F.least(end, (F.col("block") + 1) * length) - begin, F.lit(0))})


def assembled(df: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 9, output_shards: int = OUTPUT_SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: shard, source, slot, doc_id, first_word (in the document), words."""
    placed, sources = laid_out(df, id_col, text_col, source_col)
    pieces = _pieces(placed.where("size > 0"), block_words)
    return slots(sources, block_words, seed, output_shards).hint("merge").join(pieces, ["src", "block"]).select("shard", "source", "slot", "doc_id", (F.col("begin") - F.col("start")).alias("first_word"), "words")


def mix(df: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document in the mix, repeats counted), source."""
    placed, sources = laid_out(df, id_col, text_col, source_col)
    # a row for each block of the corpus: Spark would guess its size from the short source table and broadcast it
    draws = slots(sources, block_words, seed).groupBy("src", "block").agg(F.count("*").alias("draws")).hint("merge")
    # (src, block) has a block's pieces; draws has a row for each block, so one source's blocks are spread over all tasks
    joined = _pieces(placed, block_words).join(draws, ["src", "block"], "left")
    keys = ["doc_id", "size", "source_size", "target", "source", "src", "start"]
    # size-0 rows have no words of their own; n tells repeated ones apart
    summed = joined.groupBy(*keys).agg(F.sum(F.col("words") * F.coalesce("draws", F.lit(0))).alias("taken"), F.count(F.when(F.col("size") == 0, 1)).alias("n"))
    return summed.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n").cast("int")))).alias("copy")).drop("copy")


def op9_block_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
