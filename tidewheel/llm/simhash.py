"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints that differ in at most ``radius`` bits are linked. Their bits are cut into three blocks:
two linked ones differ in at most ``t`` bits of one block at least (one bit, for four in all), and
Hamming distance within a block is a metric as well, so each block has a vantage-point tree. At a
node, fingerprints no farther than the middle distance from the node's vantage point go inside, the
others outside. By the triangle bound those inside have partners outside only if they are within t of
the boundary; these visit the outer branch too, and all other branches are pruned. The leaves are the
shards; two linked fingerprints meet in one of them. Distances over all 64 bits would not prune: seven
in ten random fingerprints lie within four bits of any middle, so blocks are what makes a boundary
thin (one ring in six).

Trees are as deep as the number of fingerprints asks for (``depth``). Within a shard a vantage-point
tree over all 64 bits finds the exact pairs: at every node, branches are cut by the median distance
and only the bands within ``radius`` of it are compared across. A shard gives the edges of a spanning
forest, not all pairs. Small shards are dealt out many to a task, those above ``most`` rows are dealt
into tiles, each pair of tiles a task. Components are then found with star contractions, whose edges
stay in written tables.

Null and empty texts have fingerprint zero and are linked like any others. Equal fingerprints are
one node, whatever the number of copies. Rows with null ids get the component of their fingerprint
(null if no row of the component has an id); repeated rows are kept; texts of any length are
hashed whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, table, tidied, written

SEED = 42
RADIUS = 4
#: Blocks of bits, each with a tree.
BLOCKS = 3
#: Rows above which a shard is dealt into tiles, and those of a task that has many small shards.
MOST_ROWS, TASK_ROWS = 12_000, 40_000
#: Levels of a tree at most, so that a path fits a long.
MOST_LEVELS = 60
#: Work of a comparison within a shard, in rows that are sent to one.
COMPARISON = 1 / 1000
#: Rows of an in-shard leaf that are compared with one another outright; and of shards that are compared many at a time.
LEAF, SMALL = 256, 64


def fingerprint(text: str | None, width: int) -> int:
    """The SimHash of a text's word shingles, as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    if n <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends[: n - width]], ends[width - 1 :])]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        own = np.array(hashes[k : k + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, fp long")


# -- shards -----------------------------------------------------------------------------------------


def masks(blocks: int = BLOCKS) -> list[int]:
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])]


def depth(n: int, radius: int = RADIUS, blocks: int = BLOCKS) -> int:
    """The levels at which sending n random fingerprints to shards and comparing them there is least work.

    Of random ones a share p visits both branches, so a level makes 1 + p copies, and two rows that met
    go on together with a chance of about 1/4 + (1/2 + p)^2.
    """
    bits = 64 / blocks
    p = min(0.5, radius // blocks * (2 / (3.14159 * bits)) ** 0.5)
    best, least = 0, float("inf")
    for levels in range(MOST_LEVELS + 1):
        work = n * (1 + p) ** levels + COMPARISON * n * n / 2 * (0.25 + (0.5 + p) ** 2) ** levels
        if work < least:
            best, least = levels, work
    return best


def _vantage(tree: int, path: np.ndarray, level: int) -> np.ndarray:
    """A node's vantage point: 64 bits from a mixing of its place."""
    h = path.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(((tree * MOST_LEVELS + level + 1) * 0xD1B54A32D192ED03) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def descended(codes: np.ndarray, tree: int, mask: int, levels: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, path and whether it is a visitor, for each shard that a code is in."""
    rows, path, visits = np.arange(len(codes)), np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    middle = mask.bit_count() // 2
    for level in range(levels):
        d = np.bitwise_count((codes[rows] ^ _vantage(tree, path, level)) & np.uint64(mask)).astype(np.int64)
        both = np.flatnonzero((d <= middle) & (d > middle - t))
        path = np.concatenate([2 * path + (d > middle), 2 * path[both] + 1])
        visits = np.concatenate([visits, np.ones(len(both), bool)])
        rows = np.concatenate([rows, rows[both]])
    return rows, path, visits


def sharded(nodes: DataFrame, levels: int, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """nodes (fp) to (tree, path, fp, home): each fingerprint at home in one shard of every tree, and a visitor across near boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for tree, mask in enumerate(masks(blocks)):
                rows, path, visits = descended(fps.view(np.uint64), tree, mask, levels, radius // blocks)
                for k in range(0, len(rows), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[part]), tree, np.int32)), pa.array(path[part]), pa.array(fps[rows[part]]), pa.array(~visits[part])], names=["tree", "path", "fp", "home"])

    return nodes.select("fp").mapInArrow(tidied(run), "tree int, path long, fp long, home boolean")


def tiled(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Adds tile, tile2: 0, 0, or for each row of a shard above most rows all pairs of tiles that its own tile is in."""
    big = rows.groupBy("tree", "path").agg(F.count("*").alias("n")).where(F.col("n") > most).select("tree", "path", F.ceil(F.col("n") * 2 / most).cast("long").alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda k: F.struct(F.least(k, own).alias("tile"), F.greatest(k, own).alias("tile2")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("tile"), F.lit(0).cast("long").alias("tile2")))
    return rows.join(big, ["tree", "path"], "left").withColumn("at", F.explode(F.coalesce(pairs, alone))).select("tree", "path", "fp", "home", "at.tile", "at.tile2")


# -- within a shard ---------------------------------------------------------------------------------


class _Forest:
    """Union of pairs given as arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def _compare(codes: np.ndarray, a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray, radius: int, out: _Forest) -> None:
    """Links between rows a and rows b, whose distances to a vantage point are da and db: only rings within radius meet."""
    order = np.argsort(db, kind="stable")
    b, db = b[order], db[order]
    order = np.argsort(da, kind="stable")
    a, da = a[order], da[order]
    for k in range(0, len(a), LEAF):
        own, d = a[k : k + LEAF], da[k : k + LEAF]
        other = b[np.searchsorted(db, d[0] - radius) : np.searchsorted(db, d[-1] + radius, "right")]
        for m in range(0, len(other), 4096):
            near = np.bitwise_count(codes[own][:, None] ^ codes[other[m : m + 4096]][None, :]) <= radius
            i, j = np.nonzero(near)
            out.join(own[i], other[m : m + 4096][j])


def _within(codes: np.ndarray, rows: np.ndarray, radius: int, out: _Forest, depth: int = 0) -> None:
    """All links among rows, by a vantage-point tree."""
    if len(rows) < 2:
        return
    vantage = codes[rows[(depth * 7919) % len(rows)]]
    d = np.bitwise_count(codes[rows] ^ vantage).astype(np.int64)
    middle = int(np.median(d))
    inner = d <= middle
    if len(rows) <= LEAF or inner.all() or depth > 40:
        _compare(codes, rows, rows, d, d, radius, out)
        return
    _within(codes, rows[inner], radius, out, depth + 1)
    _within(codes, rows[~inner], radius, out, depth + 1)
    near_in, near_out = inner & (d > middle - radius), ~inner & (d <= middle + radius)
    _compare(codes, rows[near_in], rows[near_out], d[near_in], d[near_out], radius, out)


def joined_shards(codes: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of each shard's links. codes are sorted by shard, a number for each code."""
    out = _Forest(len(codes))
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(codes)]]))
    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for step in range(1, SMALL):
        # pairs of rows so far apart, of all small shards at once
        small = small[small + step < len(codes)]
        small = small[shard[small + step] == shard[small]]
        if not len(small):
            break
        near = small[np.bitwise_count(codes[small] ^ codes[small + step]) <= radius]
        if len(near):
            out.join(near, near + step)
    for k in np.flatnonzero(sizes > SMALL).tolist():
        _within(codes, np.arange(first[k], first[k] + sizes[k]), radius, out)
    member = np.flatnonzero(out.root != np.arange(len(codes)))
    return codes[member], codes[out.root[member]]


def links(nodes: DataFrame, n: int, radius: int = RADIUS, blocks: int = BLOCKS, levels: int | None = None, most: int = MOST_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect what is linked, and nothing else."""
    rows = tiled(sharded(nodes, depth(n, radius, blocks) if levels is None else levels, radius, blocks), most)

    def run(group: pa.Table) -> pa.Table:
        keys = [group[c].to_numpy() for c in ("fp", "tile2", "tile", "path", "tree")]
        by = np.lexsort(keys)
        fresh = np.concatenate([[True], np.any([k[by][1:] != k[by][:-1] for k in keys[1:]], axis=0)])
        a, b = joined_shards(keys[0].view(np.uint64)[by], np.cumsum(fresh), radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    tasks = max(1, ceil(n * blocks * 4 / TASK_ROWS))
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("tree", "path", "tile", "tile2"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(run, "a long, b long")


# -- components -------------------------------------------------------------------------------------


def _linked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges (u, v), stored, and what tells them from others: their number and a sum of hashes, observed while they are written."""
    seen = Observation()
    stored = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashed")), "links")
    return stored, (seen.get["n"], seen.get["hashed"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) to (node, root): the smallest node of each component, for nodes that have edges.

    Star contractions: every node's larger neighbours, then every node itself and its smaller
    neighbours, are tied to its smallest neighbour, until nothing changes.
    """
    now, before = _linked(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = lower.select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u <> v")
        last, (now, after) = now, _linked(small.distinct())
        for path in {x.rsplit("/", 1)[0] for x in last.inputFiles()}:
            dropped(now.sparkSession, path)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, width: int = 4, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id of the component), copies (rows with the same fingerprint)."""
    docs = written(fingerprints(df, width, id_col, text_col), "fingerprints")
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "nodes")
    roots = components(links(nodes.select("fp"), nodes.count(), radius))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id", "copies")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id", "copies")


def op2_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
