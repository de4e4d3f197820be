"""Conversation prefix trie by partition refinement.

All conversations start in one class. For every depth the active classes are split by the digest of
their next turn; a class of one distinct sequence is retired, and the rest of it is emitted at once
as a chain of nodes with one child each. What subtrees hold is folded back from the deepest level.
Equal conversations are one sequence with a weight, so copies never keep a class active, and there
are as many rounds as turns are needed to tell all distinct sequences apart.

No conversation, class or list of ids is ever in one task as a whole. Turns are numbered by a global
sort whose partitions are numbered apart and shifted; a class's name is a hash of its parent's name and
the turn, so members needn't be sent the name; hot classes meet a table with one row for each class in
joins that Spark splits. A node's ids are joined to short texts in sorted order, and only these texts
pass one task in order, as SHA-256 reads them.

Turns are ordered by ``turn``, null first; then by role, by the first 64 characters of the text and by
digest. Null roles and texts become empty. Rows without conv_id belong to no conversation and are left
out. Repeated rows are turns of their own, other columns are left out, and an empty table has no
nodes. Sequences and turns are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

NONE_ENDS = hashlib.sha256(b"").hexdigest()
#: Ids in one row, where a node's ids are joined.
IDS_A_ROW = 500
#: A conversation's head comes from the conversation whose id is the next lower multiple of this; heads are shorter than MOST_HEAD.
GROUP, MOST_HEAD = 100, 6


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _earlier(*by: str, order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def ordered(df: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), k1, k2 (digests of role and text), chars, cum (of chars, through pos)."""
    rows = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("head"), F.xxhash64(F.lit(1), "role", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "role").alias("k2"), F.length("text").cast("long").alias("chars"))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("k1"), F.col("k2")]
    dealt = keyed.repartitionByRange(_partitions(df), *by).sortWithinPartitions(*by)
    dealt = written(dealt.select("conv_id", "k1", "k2", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "turns")
    within = Window.partitionBy("part", "conv_id").orderBy("place")
    numbered = dealt.withColumns({"pos": F.row_number().over(within).cast("long"), "cum": F.sum("chars").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    # conversations over several partitions: no more rows than two for each partition
    pieces = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("chars").alias("sum"))
    before = pieces.withColumns({"n_before": F.sum("n").over(_earlier("conv_id", order="part")), "sum_before": F.sum("sum").over(_earlier("conv_id", order="part"))}).where("n_before > 0")
    moved = numbered.join(F.broadcast(before.select("conv_id", "part", "n_before", "sum_before")), ["conv_id", "part"], "left")
    return moved.select("conv_id", (F.col("pos") + F.coalesce("n_before", F.lit(0))).alias("pos"), "k1", "k2", "chars", (F.col("cum") + F.coalesce("sum_before", F.lit(0))).alias("cum"))


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first h turns taken from its group's first conversation, h following from the id.

    Gives turns as ``ordered`` does, and conv_id and n for every conversation, turnless ones included.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(MOST_HEAD)).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    own = turns.withColumn("h", h)
    convs = own.groupBy("conv_id", "h").agg(F.count("*").alias("n_own"), F.sum(F.when(F.col("pos") <= F.col("h"), F.col("chars")).otherwise(0)).alias("left_out"))
    first = turns.where((F.col("conv_id") == base) & (F.col("pos") < MOST_HEAD)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "k1", "k2", "chars", "cum"))).alias("first"))  # fewer than MOST_HEAD turns
    convs = convs.withColumn("base", base).join(first, "base", "left")
    head = F.filter(F.coalesce("first", F.array().cast(first.schema["first"].dataType)), lambda x: x["pos"] <= F.col("h"))
    convs = convs.withColumn("head", head).withColumns({"n_head": F.size("head").cast("long"), "head_chars": F.coalesce(F.get("head", F.size("head") - 1)["cum"], F.lit(0))})
    convs = written(convs.select("conv_id", "h", "head", "left_out", "n_head", "head_chars", (F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    kept = own.where("pos > h").select("conv_id", "pos", "k1", "k2", "chars", "cum").join(convs.hint("merge").select("conv_id", "h", "left_out", "n_head", "head_chars"), "conv_id")
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "k1", "k2", "chars", (F.col("cum") - F.col("left_out") + F.col("head_chars")).alias("cum"))
    taken = convs.select("conv_id", F.inline("head")).select("conv_id", "pos", "k1", "k2", "chars", "cum")
    return kept.unionByName(taken), convs.select("conv_id", "n")


def counted(turns: DataFrame) -> DataFrame:
    """conv_id and n, the number of its turns."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"))


def _saved(w: Column, total: Column, cum: Column, chars: Column) -> Column:
    """Of a chain of w equal conversations, from the node of a turn to its end."""
    return (w - 1) * (total - cum + chars)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, see ``op11_prefix_trie``."""
    spark = turns.sparkSession
    turns = written(turns, "trie-turns")
    marks = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64(F.lit(1), "pos", "k1", "k2")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(2), "k2", "k1", "pos")).alias("x2"), F.sum("chars").alias("total"))
    none = {"x1": F.coalesce("x1", F.lit(0)), "x2": F.coalesce("x2", F.lit(0)), "total": F.coalesce("total", F.lit(0))}
    marked = written(convs.hint("merge").join(marks, "conv_id", "left").withColumns(none), "trie-marks")
    alike = ["n", "x1", "x2"]
    seqs = written(marked.groupBy(*alike).agg(F.min("conv_id").alias("seq"), F.count("*").alias("w"), F.max("total").alias("total")), "trie-sequences")
    root = seqs.agg(F.min("seq").alias("conv_id"), F.sum("w").alias("n_convs"), F.count("*").alias("n_seqs"))
    # a row for each turn of each distinct sequence; files hold ranges of pos, so that a round reads its own
    own = turns.join(seqs.hint("merge").select(F.col("seq").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "seq")
    own = written(own.repartitionByRange(_partitions(turns), "pos", "seq"), "trie-own")

    levels, ends, singles = [], [], []
    node = ["q1", "q2", "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_seqs", "chars"]
    one = written(root.where("n_seqs > 0").select(F.lit(0).cast("long").alias("q1"), F.lit(0).cast("long").alias("q2"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_seqs", F.lit(0).cast("long").alias("chars")), "trie-level")
    members = seqs.select("seq", "w", "n", "total", F.lit(0).cast("long").alias("q1"), F.lit(0).cast("long").alias("q2"), F.lit(0).cast("long").alias("cum"))
    depth = 0
    while one.limit(1).count():
        levels.append(one)
        # members learn whether their class goes on, and its smallest conversation
        if depth:
            told = members.join(one.hint("merge").select("q1", "q2", "conv_id", "n_seqs", "chars"), ["q1", "q2"])
        else:  # the root is one row
            told = members.withColumns({c: F.lit(v).cast("long") for c, v in one.select("conv_id", "n_seqs", "chars").first().asDict().items()})
        told = written(told, "trie-told")
        singles.append(told.where("n_seqs = 1").select("seq", "w", "n", "total", "cum", "chars", F.lit(depth).cast("long").alias("retired")))
        ends.append(told.where(F.col("n") == depth).select("seq", "w", "conv_id", F.lit(depth).cast("long").alias("depth")))
        ends.append(told.where((F.col("n_seqs") == 1) & (F.col("n") > depth)).select("seq", "w", F.col("seq").alias("conv_id"), F.col("n").alias("depth")))
        depth += 1
        active = told.where((F.col("n_seqs") > 1) & (F.col("n") >= depth)).select("seq", "w", "n", "total", F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
        split = active.join(own.hint("merge").where(F.col("pos") == depth).select("seq", "k1", "k2", "chars", "cum"), "seq")
        split = written(split.withColumns({"q1": F.xxhash64("p1", "k1", "k2"), "q2": F.xxhash64("k2", "p2", "k1")}), "trie-members")
        one = written(split.groupBy("q1", "q2").agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("seq").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), F.sum("w").alias("n_convs"), F.count("*").alias("n_seqs"), F.max("chars").alias("chars")).select(*node), "trie-level")
        members = split.select("seq", "w", "n", "total", "q1", "q2", "cum")
    if not levels:
        return spark.createDataFrame([], NODE_SCHEMA)

    retired = reduce(DataFrame.unionByName, singles)
    chains = own.join(retired.hint("merge").select("seq", "w", "n", "total", "retired"), "seq").where("pos > retired")
    chains = chains.select(F.col("seq").alias("conv_id"), F.col("pos").alias("depth"), F.col("seq").alias("parent_conv_id"), F.col("w").alias("n_convs"), F.when(F.col("pos") < F.col("n"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), _saved(F.col("w"), F.col("total"), F.col("cum"), F.col("chars")).alias("saved_tokens"))

    # folded back: a node of one sequence knows its chain, others sum up their children
    folded, below = [], None
    for at in reversed(range(len(levels))):
        tails = singles[at].select(F.col("seq").alias("conv_id"), F.when(F.col("n") > at, 1).otherwise(0).cast("long").alias("tail_children"), _saved(F.col("w"), F.col("total"), F.col("cum"), F.col("chars")).alias("tail_saved"))
        nodes = levels[at].join(tails.hint("merge"), "conv_id", "left")
        if below is None:
            nodes = nodes.withColumns({"children": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
        else:
            sums = below.groupBy(F.col("p1").alias("q1"), F.col("p2").alias("q2")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            nodes = nodes.join(sums.hint("merge"), ["q1", "q2"], "left")
        single = F.col("n_seqs") == 1
        below = written(nodes.select("q1", "q2", "p1", "p2", "conv_id", F.lit(at).cast("long").alias("depth"), "parent_conv_id", "n_convs",
            F.when(single, F.col("tail_children")).otherwise(F.col("children")).alias("n_children"), F.when(single, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
            F.when(single, F.col("tail_saved")).otherwise((F.col("n_convs") - 1) * F.col("chars") + F.col("saved")).alias("saved_tokens")), "trie-folded")
        folded.append(below.drop("q1", "q2", "p1", "p2"))

    hashes = _end_hashes(marked, seqs, reduce(DataFrame.unionByName, ends))
    every = reduce(DataFrame.unionByName, folded).unionByName(chains).join(hashes.hint("merge"), ["conv_id", "depth"], "left")
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE_ENDS)).alias("ends_sha256"))


NODE_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, conv_id) in order to (seq, first, ids): ids with commas, a bounded number a row."""
    for batch in batches:
        rows, at = {"seq": [], "first": [], "ids": []}, None
        for seq, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if seq != at or len(rows["ids"][-1]) == IDS_A_ROW:
                at = seq
                rows["seq"].append(seq)
                rows["first"].append(conv_id)
                rows["ids"].append([])
            rows["ids"][-1].append(str(conv_id))
        rows["ids"] = [",".join(x) for x in rows["ids"]]
        yield pa.RecordBatch.from_pydict({"seq": pa.array(rows["seq"], pa.int64()), "first": pa.array(rows["first"], pa.int64()), "ids": pa.array(rows["ids"], pa.string())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, first, ids) in order to (seq, ends_sha256)."""
    at = state = None
    for batch in batches:
        done = []
        for seq, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
            if seq == at:
                state.update(b",")
            else:
                if state:
                    done.append((at, state.hexdigest()))
                at, state = seq, hashlib.sha256()
            state.update(ids.as_py().encode())
        yield pa.RecordBatch.from_pydict({"seq": pa.array([d for d, _ in done], pa.int64()), "ends_sha256": pa.array([s for _, s in done], pa.string())})
    if state:
        yield pa.RecordBatch.from_pydict({"seq": pa.array([at], pa.int64()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def _end_hashes(marked: DataFrame, seqs: DataFrame, ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes where conversations end; ends has the node of each sequence."""
    alone = ends.where("w = 1").select("conv_id", "depth", F.sha2(F.col("seq").cast("string"), 256).alias("ends_sha256"))
    copies = seqs.where("w > 1").select("n", "x1", "x2", "seq")
    many = marked.select("n", "x1", "x2", "conv_id").join(copies.hint("merge"), ["n", "x1", "x2"]).select("seq", "conv_id")
    many = many.repartitionByRange(_partitions(marked), "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(_joined, "seq long, first long, ids string")
    many = many.repartition(_partitions(marked), "seq").sortWithinPartitions("seq", "first").mapInArrow(_hashed, "seq long, ends_sha256 string")
    return alone.unionByName(ends.where("w > 1").join(many.hint("merge"), "seq").select("conv_id", "depth", "ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each node of the trie of spliced conversations."""
    return trie(*spliced(ordered(table(spark, sf_dir, "conversations"))))


OP11_SQL = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         coalesce(role, '') AS r, coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(struct_pack(r := r, x := x) ORDER BY pos) AS s FROM t GROUP BY c
), bytes AS (
  SELECT c, s, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: list_prepend(CAST(ascii(d) AS BIGINT), list_transform(range(8), lambda k: CAST(-1 AS BIGINT))))) AS ops FROM own
), crc AS (
  SELECT c, s, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), ops), lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) ELSE xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)) END), CAST(4294967295 AS BIGINT)) % {MOST_HEAD} AS h FROM bytes
), rebuilt AS (
  SELECT a.c, list_concat(coalesce(list_slice(b.s, 1, a.h), []), list_slice(a.s, a.h + 1, len(a.s))) AS s FROM crc AS a LEFT JOIN crc AS b ON b.c = a.c - a.c % {GROUP}
), nodes AS (
  SELECT c, len(s) AS n, d, list_slice(s, 1, d) AS p FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)
), each AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE length(p[d].x) END) AS own_saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM nodes GROUP BY p, d
), kids AS (
  SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM each WHERE d > 0 GROUP BY 1
), whole AS (
  SELECT e.*, coalesce(n_children, 0) AS n_children FROM each AS e LEFT JOIN kids USING (p)
), up AS (
  SELECT list_slice(p, 1, k) AS p, own_saved, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf FROM (SELECT *, unnest(range(d + 1)) AS k FROM whole)
), sums AS (
  SELECT p, sum(own_saved) AS saved_tokens, sum(leaf) AS n_leaves FROM up GROUP BY p
)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole AS w JOIN sums USING (p) LEFT JOIN each AS a ON w.d > 0 AND a.p = list_slice(w.p, 1, w.d - 1)
"""
