"""A corpus pipeline: language ID, near-duplicates, repeated passages, mixing, byte-level BPE.

Every stage takes documents and, but for the last, returns documents with the same columns. Null
and empty texts have no language and go in the first stage. Rows that share an id are taken as one
document where ids decide (near-duplicates, mixing); rows without an id can't be told apart there and
stay. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm import bpe, langid, mixing, passages, shingles, simhash
from tidewheel.llm.common import SPACES, dropped, new_path, release, table, written, written_so_far

#: Documents with a lower score than this have no language that is clear enough.
LEAST_SCORE = 0.5
#: Near-duplicates share this part of their shingles of five words, or more (Jaccard).
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Of the draws that round a document's share of the mix to whole documents; documents of a bucket of theirs.
ROUNDING_SEED, BUCKET_DOCS = 12, 20_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is clear."""
    model = langid.train(docs.select("text", F.col("lang").cast("string").alias("lang"), F.col("doc_id").alias("seed")))
    judged = langid.predict(docs, model, docs.columns)
    return judged.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest id.

    Documents are linked by SimHash over shingles of five words (operator 2, its radius), and, as a
    similarity of 0.8 is up to 17 differing bits, by the exact similarity of their shingle sets too.
    """
    linked = simhash.near_duplicates(docs, SHINGLE_WORDS).select("doc_id", "component_id")
    found = shingles.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY, also=linked)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 100 bytes or more that start earlier elsewhere; documents with nothing left go."""
    cut = passages.without_repeats(docs, with_text=True)
    cut = cut.where((F.col("n_removed") == 0) | (F.length(F.translate("text", SPACES, "")) > 0))
    others = {c: F.col("rest")[c] for c in docs.columns if c not in ("doc_id", "text")}
    if "n_chars" in others:
        others["n_chars"] = F.when(F.col("n_removed") == 0, others["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[others[c].alias(c) if c in others else F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes its words, rounded to whole documents.

    The fractions of a source's documents are added up in the order of their sizes, in buckets of
    bounded size; a document gets one more copy where the sum passes a whole number, so copies come to
    the sum of the fractions, for short and for long documents. Rows without an id share a sum, so a
    hash of the text draws for each of them.
    """
    mixed = written(mixing.mix(docs).groupBy("doc_id", "source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).where("size > 0").withColumn("share", F.col("taken") / F.col("size")), "shares")
    buckets = F.lit(max(64, mixed.count() // BUCKET_DOCS))
    mixed = mixed.withColumns({"part": F.col("share") - F.floor("share"), "bucket": F.pmod(F.xxhash64("doc_id", F.lit(ROUNDING_SEED)), buckets)})
    unit = lambda h: F.pmod(h, F.lit(1 << 53)) / float(1 << 53)
    total = unit(F.xxhash64("source", "bucket", F.lit(ROUNDING_SEED))) + F.sum("part").over(Window.partitionBy("source", "bucket").orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    passed = (F.floor(total) - F.floor(total - F.col("part"))).cast("int")
    times = mixed.select(F.col("doc_id").alias("mixed_id"), F.col("source").alias("mixed_source"), "share", "part", F.when(F.col("doc_id").isNotNull(), passed).alias("one_more"))
    both = docs.join(times, F.col("doc_id").eqNullSafe(F.col("mixed_id")) & F.col("source").cast("string").eqNullSafe(F.col("mixed_source")))
    drawn = (unit(F.xxhash64("text", F.lit(ROUNDING_SEED))) < F.col("part")).cast("int")
    both = both.withColumn("times", F.floor("share").cast("int") + F.coalesce("one_more", drawn))
    return both.where("times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as byte-level BPE ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, is_table=bool(docs.inputFiles()))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL can't express language ID's model, SimHash or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is stored before the next begins; then what it was made from is deleted."""
    docs, stored, before = table(spark, sf_dir, "documents"), None, written_so_far()
    for k, (_, stage) in enumerate(STAGES[:-1]):
        found, path = stage(spark, docs, sf_dir), new_path(spark, f"stage-{k}")
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        release(spark, before)
        if stored:
            dropped(spark, stored)
        stored = path
    return STAGES[-1][1](spark, docs, sf_dir)
