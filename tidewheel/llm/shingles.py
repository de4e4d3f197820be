"""Near-duplicates by the Jaccard similarity of word shingles.

A document is the set of its shingles' hashes; equal sets are one node, whatever the number of
copies. ``BANDS`` bands of ``ROWS`` MinHash values each find candidates: two sets of similarity s
meet in a band with probability 1 - (1 - s^ROWS)^BANDS, which is 0.999 at 0.8, 0.99998 at 0.85 and
nearly 1 above. Within a bucket the exact similarity of the whole sets decides; buckets with the same
members are compared once, and those above ``simhash.MOST_ROWS`` rows are dealt into pairs of tiles.
A bucket gives the edges of a spanning forest, not all pairs; components are those of ``simhash``.
Groups that another search has found (``also``) count as linked.

Null and empty texts have the empty set and are one node. Rows with null ids get the component of
their set; texts of any length are hashed whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import packed, unpacked
from .common import tidied, written
from .simhash import MOST_ROWS, SEED, components, tiled

BANDS, ROWS = 24, 6
#: Shingles that are permuted at once.
AT_ONCE = 2048
#: Texts with a candidate are marked in a bitmap of this many slots, made in pages; where it fills up, more sets than needed are read.
SLOTS, PAGE = 1 << 24, 1 << 15
_RNG = np.random.default_rng(SEED)
_FLIPS, _FACTORS = (_RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
_FACTORS |= np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles; a text with fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends[:-width]], ends[width - 1 :]) if len(words) > width else [(0, ends[-1])]
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in spans], np.uint64))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash for each band of MinHash values; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), AT_ONCE):
        mixed = (shingles[None, k : k + AT_ONCE] ^ _FLIPS) * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, mixed.min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes()) for b in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def _hashed(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def sets(texts: DataFrame, width: int) -> DataFrame:
    """texts (doc_id, text, slot) to doc_id, slot, fp (a hash of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, each = [], []
            for t in batch.column(1).to_pylist():
                own = shingle_set(t, width)
                fps.append(_hashed(own))
                each.append(bands(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(each, pa.list_(pa.int64()))], names=["doc_id", "slot", "fp", "bands"])

    return texts.mapInArrow(tidied(run), "doc_id long, slot long, fp long, bands array<long>")


def met(texts: DataFrame, docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """fp, shingles of the sets in rows (and of the few others whose text has the same slot), from the texts again: sets are larger than texts."""

    def page(key: tuple, group: pa.Table) -> pa.Table:
        bits = np.zeros(PAGE, bool)
        bits[group["slot"].to_numpy() % PAGE] = True
        return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    slots = docs.join(rows.select("fp").distinct(), "fp", "left_semi").select("slot").distinct().withColumn("page", F.floor(F.col("slot") / PAGE))
    marks = np.zeros(SLOTS // 8, np.uint8)
    for k, bits in slots.groupBy("page").applyInArrow(page, "page long, bits binary").collect():  # SLOTS bits, whatever the input
        marks[k * PAGE // 8 : (k + 1) * PAGE // 8] = np.frombuffer(bits, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for t in batch.column(1).filter(pa.array(marked[batch.column(2).to_numpy()])).to_pylist():
                own = shingle_set(t, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_hashed(own)], np.uint64).view(np.int64)), pa.array([packed(own)], pa.binary())], names=["fp", "shingles"])

    return texts.mapInArrow(tidied(run), "fp long, shingles binary").groupBy("fp").agg(F.first("shingles").alias("shingles"))


def forest(found: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Edges (member, other member) that connect all sets that similarity links, by a search that leaves out what it has reached."""
    sizes = np.array([len(s) for s in found])
    names, codes = np.unique(np.concatenate(found), return_inverse=True)
    own = np.split(codes, np.cumsum(sizes)[:-1])
    flag = np.zeros(len(names), bool)
    left, a, b = np.arange(len(found)), [], []
    flat, starts = codes, np.cumsum(sizes) - sizes
    stack: list[int] = []
    while len(left):
        i = stack.pop() if stack else int(left[0])
        flag[own[i]] = True
        shared = np.add.reduceat(flag[flat], starts, dtype=np.int64)
        flag[own[i]] = False
        near = shared >= similarity * (sizes[i] + sizes[left] - shared) - 1e-9
        if near.any():  # a new start reaches itself as well
            new = left[near & (left != i)].tolist()
            stack += new
            a += new
            b += [i] * len(new)
            left = left[~near]
            if len(left):
                flat, starts = np.concatenate([own[k] for k in left.tolist()]), np.cumsum(sizes[left]) - sizes[left]
    return a, b


def links(texts: DataFrame, docs: DataFrame, width: int, similarity: float, most: int = MOST_ROWS) -> DataFrame:
    """texts and their sets() to edges (a, b) between distinct sets that connect what is linked, and nothing else."""
    banded = written(docs.select("fp", F.posexplode("bands").alias("tree", "path")).distinct(), "bands")
    members = banded.groupBy("tree", "path").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y")).where("n > 1")
    buckets = members.groupBy("n", "x", "y").agg(F.min(F.struct("tree", "path")).alias("of")).select("of.*")
    rows = written(banded.join(buckets.hint("merge"), ["tree", "path"]).withColumn("home", F.lit(True)), "candidates")

    def run(group: pa.Table) -> pa.Table:
        fps = group["fp"].to_numpy()
        a, b = forest([unpacked(s, np.uint64) for s in group["shingles"].to_pylist()], similarity)
        return pa.table({"a": pa.array(fps[a], pa.int64()), "b": pa.array(fps[b], pa.int64())})

    return tiled(rows, most).join(met(texts, docs, rows, width).hint("merge"), "fp").groupBy("tree", "path", "tile", "tile2").applyInArrow(run, "a long, b long")


def tied(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """groups (doc_id, component_id) and sets() to edges between the sets of each group and its smallest one. Rows without ids are in no group."""
    sets_of = written(groups.where("component_id is not null").join(docs.select("doc_id", "fp"), "doc_id").select("component_id", "fp").distinct(), "tied")  # read twice
    least = sets_of.groupBy("component_id").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    return sets_of.join(least, "component_id").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))


def near_duplicates(df: DataFrame, width: int, similarity: float, also: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest id of the component). also: (doc_id, component_id) of links that are known already."""
    text = F.col(text_col).cast("string")
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(text), F.lit(SLOTS)).alias("slot"))
    docs = written(sets(texts, width), "sets")
    edges = links(texts, docs, width, similarity)
    roots = components(edges if also is None else edges.unionByName(tied(also, docs)))
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return docs.select("doc_id", "fp").join(named, "fp").select("doc_id", "component_id")
