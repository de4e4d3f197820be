"""Approximate nearest neighbours by vantage-point trees, one for each shard.

A coarse tree of vantage points and distances, fitted on a bounded sample, deals all rows into
shards. A shard's own tree cuts its vectors at the median distance to a vantage point; a search
skips a branch if the triangle inequality says that it holds nothing nearer than the worst neighbour
so far. With ``factor`` above one the bound is taken that many times tighter, so more is skipped and
a neighbour may be missed; factor one is exact search. The same rule picks the shards that a query
visits: the sample's k nearest bound its k-th distance, the coarse tree bounds what each shard can
hold. Rows and visits are sorted by shard, rows first: a task builds a shard's tree once and streams
the visits past it, so it holds one shard and one batch of visits. Only a shard with more than
``GROUP_QUERIES`` visits is copied, for as many tasks as they need. Shards give each query its k
nearest, and the k nearest of all are kept.

``FACTOR`` is the one whose recall, measured on full shards of 16,384 rows of 64 dimensions, stays
above 0.99: 1.5 gives 1.000 on normal rows and 0.998 on rows of rank 8 (2: 0.970, 4: 0.732).

Of equal vectors only the k + 1 with the smallest ids can be among anyone's k nearest; Spark keeps
just those before vectors are dealt. Every row stays findable under that rule.

Vectors that are null, all zero, or hold null or non-finite components take no part, nor do rows
with a null id. Vectors meet those of their own length only. Repeated rows count once. Different
vectors under one id are all indexed and asked for: the id is as near as the nearest of them, fills
one place in a list, and has one list. A query's own id is never its neighbour. Ties go to the
smaller id. A distance beyond the range of doubles is infinite and comes last. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K = 10
FACTOR = 1.5
SHARD_ROWS = 16_384
#: Queries that are streamed past a shard's tree at once, and those that visit one copy of a shard, about.
QUERY_ROWS, GROUP_QUERIES = 4_096, 262_144
#: Rows of each length that the coarse tree is fitted on and that bound queries' distances, about; its leaves at most. Shards that come out larger are cut by a hash.
SAMPLE_ROWS, MOST_LEAVES = 4_096, 1_024
LEAF = 128


class Coarse:
    """Vantage points and distances that deal vectors into leaves 0, 1, ...; every leaf has the bounds that lead to it."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, leaves: int):
        order = np.argsort(ids, kind="stable")
        self.sample, self.ids = sample[order], ids[order]
        self.leaves = 0
        self.top = self._built(np.arange(len(ids)), leaves, 0)

    def _built(self, rows: np.ndarray, leaves: int, depth: int):
        if leaves > 1 and len(rows) > 1:
            vantage = self.sample[rows[(depth * 7919) % len(rows)]]
            d = distances(vantage[None, :], self.sample[rows])[0]
            cut = float(np.quantile(d, (leaves // 2) / leaves))
            inner = d <= cut
            if not inner.all() and np.isfinite(cut):
                return vantage, cut, self._built(rows[inner], leaves // 2, depth + 1), self._built(rows[~inner], leaves - leaves // 2, depth + 1)
        self.leaves += 1
        return self.leaves - 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)

        def go(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                inner = distances(node[0][None, :], x[rows])[0] <= node[1]
                go(node[2], rows[inner])
                go(node[3], rows[~inner])

        go(self.top, np.arange(len(x)))
        return out

    def limits(self, x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """The k-th smallest distance to different ids of the sample: no query's k-th neighbour is farther."""
        out = np.full(len(x), np.inf)
        _, at = np.unique(self.ids, return_inverse=True)
        for r in range(len(x)):
            d = distances(x[r][None, :], self.sample)[0]
            d[self.ids == own[r]] = np.inf
            if at[-1] + 1 < len(d):  # some id has several vectors
                least = np.full(at[-1] + 1, np.inf)
                np.minimum.at(least, at, d)
                d = least
            if len(d) > k:
                out[r] = np.partition(d, k - 1)[k - 1]
        return out

    def visits(self, x: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query row, leaf) of all leaves that may hold a neighbour; a relaxed bound skips more."""
        limit = self.limits(x, own, k)
        rows_out, leaves_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def go(node, rows: np.ndarray, bound: np.ndarray) -> None:
            keep = ~(bound * factor > limit[rows])
            rows, bound = rows[keep], bound[keep]
            if isinstance(node, int):
                rows_out.append(rows)
                leaves_out.append(np.full(len(rows), node, np.int64))
            elif len(rows):
                d = distances(node[0][None, :], x[rows])[0]
                go(node[2], rows, np.fmax(bound, d - node[1]))
                go(node[3], rows, np.fmax(bound, node[1] - d))

        go(self.top, np.arange(len(x)), np.zeros(len(x)))
        return np.concatenate(rows_out), np.concatenate(leaves_out)


class VantageTree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.vectors, self.ids = vectors, ids
        self.several = len(np.unique(ids)) < len(ids)
        self.top = self._built(np.arange(len(ids)), leaf, 0)

    def _built(self, rows: np.ndarray, leaf: int, depth: int):
        if len(rows) <= leaf:
            return rows
        vantage = self.vectors[rows[(depth * 7919) % len(rows)]]
        d = distances(vantage[None, :], self.vectors[rows])[0]
        inner = d <= np.median(d)
        if inner.all():
            return rows
        return vantage, (d[inner].min(), d[inner].max()), (d[~inner].min(), d[~inner].max()), self._built(rows[inner], leaf, depth + 1), self._built(rows[~inner], leaf, depth + 1)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest found of each query, nearest first; inf and the largest id where there are fewer."""
        self.queries, self.own, self.k, self.factor = queries, own, k, factor
        with np.errstate(over="ignore"):
            self.squares = np.square(queries).sum(axis=1)
        # first every query looks into its own leaf, which bounds its k-th distance; then the tree is walked once for all queries
        self.limit = np.full(len(queries), np.inf)
        for whole in (False, True):
            self.near = np.full((len(queries), k), np.inf)
            self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
            self._visit(self.top, np.arange(len(queries)), whole)
            self.limit = self.near[:, -1].copy()
        return self.near, self.found

    def _visit(self, node, q: np.ndarray, whole: bool) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            for a in range(0, len(node), 4 * LEAF):
                self._leaf(node[a : a + 4 * LEAF], q)
            return
        vantage, inner, outer, inside, outside = node
        d = distances(vantage[None, :], self.queries[q])[0]
        if not whole:
            first = d <= (inner[1] + outer[0]) / 2
            self._visit(inside, q[first], whole)
            self._visit(outside, q[~first], whole)
            return
        for branch, (low, high) in ((inside, inner), (outside, outer)):
            with np.errstate(invalid="ignore"):
                bound = np.fmax(0, np.fmax(low - d, d - high))
                self._visit(branch, q[~(bound * self.factor > np.minimum(self.limit[q], self.near[q, -1]))], whole)

    def _leaf(self, rows: np.ndarray, q: np.ndarray) -> None:
        ids, x = self.ids[rows], self.vectors[rows]
        for a in range(0, len(q), 256):
            own = q[a : a + 256]
            # a matrix product rules out what is clearly too far; what is left is measured from differences
            with np.errstate(over="ignore", invalid="ignore"):
                squares = self.squares[own][:, None] + np.square(x).sum(axis=1)[None, :]
                far = squares - 2 * (self.queries[own] @ x.T) > np.square(np.minimum(self.limit[own], self.near[own, -1]))[:, None] + 1e-9 * squares
            far |= self.own[own][:, None] == ids[None, :]
            some = np.flatnonzero(~far.all(axis=1))
            if not len(some):
                continue
            own, far = own[some], far[some]
            i, j = np.nonzero(~far)
            counts = np.bincount(i, minlength=len(own))
            place = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
            d = np.full((len(own), self.k + counts.max()), np.inf)
            found = np.full(d.shape, np.iinfo(np.int64).max)
            d[:, : self.k], found[:, : self.k] = self.near[own], self.found[own]
            d[i, self.k + place], found[i, self.k + place] = np.sqrt(np.square(self.queries[own[i]] - x[j]).sum(axis=1)), ids[j]
            if self.several:
                # an id counts with its nearest vector: sorted by id and distance, all but the first of an id go to the end
                by = np.lexsort((d, found), axis=-1)
                d, found = np.take_along_axis(d, by, 1), np.take_along_axis(found, by, 1)
                again = np.zeros(d.shape, bool)
                again[:, 1:] = found[:, 1:] == found[:, :-1]
                d[again], found[again] = np.inf, np.iinfo(np.int64).max
            best = np.lexsort((found, d), axis=-1)[:, : self.k]
            self.near[own], self.found[own] = np.take_along_axis(d, best, 1), np.take_along_axis(found, best, 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, from differences."""
    with np.errstate(over="ignore"):
        return np.sqrt(np.stack([np.square(b - x).sum(axis=1) for x in a])) if len(a) else np.empty((0, len(b)))


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (doubles), each row once."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    return rows.where(finite & F.exists(v, lambda x: x != 0)).distinct()


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy().reshape(len(whole), -1)


def coarse_trees(rows: DataFrame, shard_rows: int, sample_rows: int = SAMPLE_ROWS, most_leaves: int = MOST_LEAVES) -> dict[int, Coarse]:
    """A coarse tree for each length of vectors, fitted on a bounded sample of theirs: those whose hash falls under a threshold that follows from their count."""
    out = {}
    for length, n in rows.groupBy("length").count().collect():
        share = min(1.0, sample_rows / n)
        found = rows.where((F.col("length") == length) & (F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)) < int(share * (1 << 40)))).select("vec_id", "v").toArrow()
        out[length] = Coarse(matrix(found["v"]) if found.num_rows else np.empty((0, length)), found["vec_id"].to_numpy(), min(most_leaves, -(-n // shard_rows)))
    return out


#: The columns that say which copy of which shard a row or a visit belongs to.
SHARD = ["length", "leaf", "part", "copy"]


def streamed(batches: Iterator[pa.RecordBatch], k: int, factor: float, query_rows: int) -> Iterator[pa.RecordBatch]:
    """SHARD, asks, vec_id, v, sorted by shard with its rows before its visits, to query_id, vec_id, score."""
    now, rows, tree = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(len(SHARD) + 1)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            *shard, asks = keys[a].tolist()
            if shard != now:
                now, rows, tree = shard, [], None
            part = batch.slice(a, b - a)
            ids, vectors = part.column(len(SHARD) + 1).to_numpy(), matrix(part.column(len(SHARD) + 2))
            if not asks:
                rows.append((ids, vectors))
                continue
            if rows:
                known = np.concatenate([r[0] for r in rows])
                order = np.argsort(known, kind="stable")
                tree, rows = VantageTree(np.concatenate([r[1] for r in rows])[order], known[order]), []
            if tree is None:  # nothing is kept in this shard
                continue
            for m in range(0, len(ids), query_rows):
                own = ids[m : m + query_rows]
                d, found = tree.search(vectors[m : m + query_rows], own, k, factor)
                ok = found != np.iinfo(np.int64).max
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, ok.sum(axis=1))), pa.array(found[ok]), pa.array(d[ok])], names=["query_id", "vec_id", "score"])


def nearest(df: DataFrame, every: int = 100, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, group_queries: int = GROUP_QUERIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose id is divisible by every."""
    rows = written(usable(df, id_col, vector_col).withColumn("length", F.size("v")), "vectors")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    trees = rows.sparkSession.sparkContext.broadcast(coarse_trees(rows, shard_rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length in np.unique(batch.column(2)).tolist():
                part = batch.filter(pa.array(batch.column(2).to_numpy() == length))
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(trees.value[length].leaf_of(matrix(part.column(1)))), part.column(0), part.column(1)], names=["length", "leaf", "vec_id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length in np.unique(batch.column(2)).tolist():
                part = batch.filter(pa.array(batch.column(2).to_numpy() == length))
                for m in range(0, part.num_rows, 512):
                    own = part.slice(m, 512)
                    at, leaf = trees.value[length].visits(matrix(own.column(1)), own.column(0).to_numpy(), k, factor)
                    own = own.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([own.column(2), pa.array(leaf), own.column(0), own.column(1)], names=["length", "leaf", "vec_id", "v"])

    schema = "length int, leaf long, vec_id long, v array<double>"
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    own = rows.withColumn("copy", first).where(F.col("copy") <= k + 1).select("vec_id", "v", "length").mapInArrow(deal, schema)
    asked = written(queries.select("vec_id", "v", "length").mapInArrow(ask, schema), "visits")
    # leaves that hold more rows than a shard should are cut by a hash of the id, and those with many visits are copied; one row a leaf is collected
    held = own.groupBy("length", "leaf").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("parts")).where("parts > 2")
    visited = asked.groupBy("length", "leaf").agg(F.ceil(F.count("*") / group_queries).cast("long").alias("copies")).where("copies > 1")
    place = F.concat_ws(" ", "length", "leaf")

    def number(counts: DataFrame) -> Column:
        found = [F.lit(x) for r in counts.collect() for x in (f"{r[0]} {r[1]}", r[2])]
        one = F.lit(1).cast("long")
        return F.coalesce(F.create_map(*found)[place], one) if found else one

    parts, copies = number(held), number(visited)
    zero = F.lit(0).cast("long")
    own = own.withColumns({"part": F.pmod(F.xxhash64("vec_id"), parts), "copy": F.explode(F.sequence(zero, copies - 1)), "asks": F.lit(False)})
    asked = asked.withColumns({"part": F.explode(F.sequence(zero, parts - 1)), "copy": F.pmod(F.xxhash64("vec_id", F.lit(5)), copies), "asks": F.lit(True)})
    dealt = own.select(*SHARD, "asks", "vec_id", "v").unionByName(asked.select(*SHARD, "asks", "vec_id", "v"))
    sorted_rows = dealt.repartition(*SHARD).sortWithinPartitions(*SHARD, "asks")
    got = sorted_rows.mapInArrow(lambda batches: streamed(batches, k, factor, query_rows), "query_id long, vec_id long, score double")
    # an id with several vectors, as a query or as a neighbour, counts with the nearest of them
    got = got.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vantage_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
