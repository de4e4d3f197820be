"""Removal of repeated passages by run-length indexes.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document
with a smaller id, or earlier in the same one. Matches never cross documents and are judged on the
input.

1. Every window of ``length`` bytes has an anchor (see ``anchors``); windows of one anchor that
   follow one another form a run, and only windows with equal anchors can be equal. Runs go to
   their anchor's partition as hashes and places, without text. Anchors that a bounded sample shows
   to be frequent are dealt further by document, and their first copies are settled in a second step.
2. Equal runs are one text of the index, that of the first of them; the others are marked whole, as
   an equal run starts earlier. Of the first copies, those whose anchor has other runs too are cut
   out of the texts.
3. A group of more than ``most_runs`` different runs of one anchor is dealt further: a window that has
   i bytes before its anchor shares with equal ones i bytes before it and the rest behind it, so runs
   are halved at the middle of i's range, and each half goes by the hash of the bytes that all its
   windows have. This is repeated until groups are small; in the end a half is a single window, so
   no group stays large. Equal halves are settled as equal runs are.
4. The cut-out runs are dealt by group into shards of bounded size. A shard halves its runs once in the
   same way and drops halves that share their bytes with no other; it streams the rest over
   run-length indexes of the earlier ones (``rindex``) and marks windows that match in full length.
5. Marks are gathered for each document and joined with the texts.

A null text is an empty one. Ids that are null come last. Rows that share an id, or have none, are
documents of their own if their texts differ, in the order of a hash of the text; if their texts are
equal they are one document, so they keep or lose the same bytes. Texts of any length are read in
overlapping pieces; an empty table gives no rows. The input is read several times, so it must be a
table or alike. A document's marks are gathered in one list, which is no longer than its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import anchors
from .anchors import portions, runs
from .common import table, tidied, tidy, written
from .rindex import seen_before

LENGTH = 100
#: Bytes of cut-out runs in a shard, about.
SHARD_BYTES = 1_200_000
#: Different runs of a group, above which it is dealt further.
MOST_RUNS = 16_384
#: The sample that shows which anchors are frequent, and how many of its documents have one.
SAMPLE_DOCS, OFTEN = 2_000, 0.01
SALTS = 64
#: A document's place in the order of documents: its id (the largest number for null), then tie.
KEY = ["doc", "tie"]
_LAST = (1 << 63) - 1


def keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """df's id and text as _id and _text, doc, tie, and rest (a struct of all of df); whether each row has an id of its own. If so, tie is 0 for all, else a hash of the text."""
    out = df.select(F.struct("*").alias("rest"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    alone = out.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1 or _id is null").isEmpty()
    return out.withColumns({"doc": F.coalesce("_id", F.lit(_LAST)), "tie": F.lit(0).cast("long") if alone else F.xxhash64(F.coalesce("_text", F.lit("")))}), alone


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batches_of(batch: pa.RecordBatch, column: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """Runs of a batch's texts: text number, start, windows, anchor; the pieces and each run's place in its piece as (piece, start)."""
    for k in range(0, batch.num_rows, 1000):
        texts = [(t or "").encode() for t in batch.column(column).slice(k, 1000).to_pylist()]
        for numbers, offsets, pieces in portions(texts, length):
            piece, start, count, anchor = runs(pieces, length)
            yield k + np.array(numbers, np.int64)[piece], start + np.array(offsets, np.int64)[piece], count, anchor, pieces, np.stack([piece, start])


def frequent_anchors(docs: DataFrame, length: int, sample_docs: int = SAMPLE_DOCS, often: float = OFTEN) -> np.ndarray:
    """Anchors in at least that share of a sample of documents. The sample is bounded, and only decides how rows are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, _, _, anchor, _, _ in _batches_of(batch, 0, length):
                each = np.unique(np.stack([number, anchor]), axis=1)[1]
                yield pa.RecordBatch.from_arrays([pa.array(each)], names=["anchor"])

    n = docs.count()
    share = min(1.0, sample_docs / max(1, n))
    sample = docs.where(F.pmod(F.xxhash64(*KEY, F.lit(8)), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    least = max(20, int(often * share * n))
    found = sample.mapInArrow(tidied(run), "anchor long").groupBy("anchor").count().where(F.col("count") >= least).orderBy(F.desc("count"), "anchor").limit(50_000)
    return np.sort(np.array([r[0] for r in found.collect()], np.int64))


def all_runs(docs: DataFrame, length: int, frequent: np.ndarray) -> DataFrame:
    """anchor, salt (0, or 1 to SALTS by document where the anchor is frequent), content (a hash of the run's bytes), doc, tie, start, windows."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for number, start, count, anchor, pieces, where in _batches_of(batch, 2, length):
                doc = ids[number]
                digest = xxhash.xxh3_64_intdigest
                content = np.fromiter((digest(pieces[p][a : a + c + length - 1]) for p, a, c in zip(where[0].tolist(), where[1].tolist(), count.tolist())), np.uint64, len(count)).view(np.int64)
                salt = np.zeros(len(doc), np.int32)
                if len(often):
                    at = np.minimum(np.searchsorted(often, anchor), len(often) - 1)
                    salt = np.where(often[at] == anchor, 1 + (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % SALTS, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(salt), pa.array(content), pa.array(doc), pa.array(ties[number]), pa.array(start), pa.array(count.astype(np.int32))], names=["anchor", "salt", "content", "doc", "tie", "start", "windows"])

    return docs.select("doc", "tie", "text").mapInArrow(tidied(run), "anchor long, salt int, content long, doc long, tie long, start long, windows int")


def sorted_out(found: DataFrame) -> DataFrame:
    """Runs that matter: copies (anchor null), and first copies whose anchor has other runs (with n, how many)."""
    place = F.struct("doc", "tie", "start")
    same = Window.partitionBy("anchor", "salt", "content")
    alike = Window.partitionBy("anchor", "salt")
    rows = found.withColumn("first", F.min(place).over(same)).withColumn("is_first", F.col("first") == place)
    rows = rows.withColumns({"n_rows": F.count("*").over(alike), "n": F.sum(F.col("is_first").cast("int")).over(alike)})
    keep = ["doc", "tie", "start", "windows", F.when(F.col("is_first"), F.col("anchor")).alias("anchor"), F.when(F.col("is_first"), F.col("content")).alias("content"), "salt", F.when(F.col("is_first"), F.col("n")).cast("long").alias("n")]
    return rows.where((F.col("salt") > 0) | ((F.col("n_rows") > 1) & (~F.col("is_first") | (F.col("n") > 1)))).select(*keep)


def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies (doc, tie, start, windows) and first copies (doc, tie, start, windows, anchor, n), with frequent anchors' local firsts compared."""
    copies = rows.where("anchor is null").select(*KEY, "start", "windows")
    firsts = rows.where("anchor is not null and salt = 0").select(*KEY, "start", "windows", "anchor", "n")
    local = rows.where("anchor is not null and salt > 0").drop("salt", "n")
    place = F.struct("doc", "tie", "start")
    first = local.groupBy("anchor", "content").agg(F.min(place).alias("first"))
    judged = local.join(first, ["anchor", "content"]).withColumn("is_first", F.col("first") == place)
    copies = copies.unionByName(judged.where(~F.col("is_first")).select(*KEY, "start", "windows"))
    several = first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    firsts = firsts.unionByName(judged.where("is_first").join(several, "anchor").select(*KEY, "start", "windows", "anchor", "n"))
    return copies, firsts


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc, tie, the text's bytes, compressed before they are shuffled, and the other columns of docs."""
    rest = [f for f in docs.schema.fields if f.name not in ("doc", "tie", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([press.compress((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, *batch.columns[3:]], names=["doc", "tie", "packed", *(f.name for f in rest)])

    return docs.select("doc", "tie", "text", *(f.name for f in rest)).mapInArrow(tidied(run), ", ".join(["doc long, tie long, packed binary"] + [f"{f.name} {f.dataType.simpleString()}" for f in rest]))


#: A cut-out run: its group, place, the place of the anchor in it (-1: not known yet), the fewest and most bytes that its windows may have before the anchor, its bytes.
RUN_FIELDS = ["anchor", "doc", "tie", "start", "at", "low", "high", "bytes"]
RUN_SCHEMA = "anchor long, doc long, tie long, start long, at int, low int, high int, bytes binary"


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(RUN_FIELDS)
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=RUN_FIELDS)


def cut_out(texts: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """The runs' bytes. texts: a row for each document."""
    lists = firsts.groupBy(*KEY).agg(F.collect_set(F.struct("start", "windows", "anchor")).alias("own"))
    both = lists.join(texts.select(*KEY, "packed"), KEY).select(*KEY, "packed", F.col("own.start").alias("start"), F.col("own.windows").alias("windows"), F.col("own.anchor").alias("anchor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                out = []
                for doc, tie, packed, start, windows, anchor in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns)):
                    text = press.decompress(packed)
                    out += [(a, doc, tie, s, -1, 0, length - anchors.GRAM, text[s : s + w + length - 1]) for s, w, a in zip(start, windows, anchor)]
                yield _run_batch(out)

    return both.mapInArrow(tidied(run), RUN_SCHEMA)


def halves(texts: list[bytes], groups: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> Iterator[tuple[int, ...]]:
    """Runs cut at the middle of the range of bytes before their anchor: run number, group, first window, last window, low, high, place of the anchor of each half. Its group is a hash of what all its windows have: so many bytes before the anchor, and so many from it on."""
    unknown = np.flatnonzero(at < 0)
    if len(unknown):
        at = at.copy()
        at[unknown] = anchors.places([texts[k] for k in unknown.tolist()], groups[unknown])
    digest = xxhash.xxh3_64_intdigest
    for k, (text, group, place, least, most) in enumerate(zip(texts, groups.tolist(), at.tolist(), low.tolist(), high.tolist())):
        windows, middle = len(text) - length + 1, (least + most) // 2
        for a, b in ((least, middle), (middle + 1, most)):
            first, last = max(0, place - b), min(windows - 1, place - a)
            if first <= last:
                yield k, _signed(digest(text[place - a : place + length - b] + group.to_bytes(8, "big", signed=True), seed=a * length + b)), first, last, a, b, place


def halved(rows: DataFrame, length: int) -> DataFrame:
    """Halves as rows like those of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, doc, tie, start, at, low, high = (c.to_numpy() for c in batch.columns[:7])
            texts = batch.column(7).to_pylist()
            if texts:
                yield _run_batch([(g, int(doc[k]), int(tie[k]), int(start[k]) + first, place - first, a, b, texts[k][first : last + length]) for k, g, first, last, a, b, place in halves(texts, anchor, at, low, high, length)])

    return rows.mapInArrow(tidied(run), RUN_SCHEMA)


def dealt_further(rows: DataFrame, length: int, most_runs: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of large groups to rows of groups with at most most_runs different runs, and marks of equal ones."""
    done, marks = rows.sparkSession.createDataFrame([], rows.schema), None
    place = F.struct("doc", "tie", "start")
    while True:
        halves = written(halved(rows, length).withColumn("content", F.xxhash64("bytes")), "halves")
        judged = halves.join(halves.groupBy("anchor", "content").agg(F.min(place).alias("first")).hint("merge"), ["anchor", "content"]).withColumn("is_first", F.col("first") == place)
        own = judged.where(~F.col("is_first")).select(*KEY, "start", (F.octet_length("bytes") - (length - 1)).cast("int").alias("windows"))
        marks = own if marks is None else marks.unionByName(own)
        firsts = judged.where("is_first").dropDuplicates(["anchor", "content"]).select(*RUN_FIELDS)
        sizes = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
        sized = written(firsts.join(sizes.hint("merge"), "anchor"), "halved-runs")
        done = done.unionByName(sized.where(F.col("n") <= most_runs).select(*RUN_FIELDS))
        rows = sized.where(F.col("n") > most_runs).select(*RUN_FIELDS)
        if rows.isEmpty():
            return done, marks


def indexed(rows: DataFrame, length: int, shards: int) -> DataFrame:
    """Marks (doc, tie, start, windows) of the windows that a shard's indexes show to start earlier elsewhere."""

    def run(group: pa.Table) -> pa.Table:
        doc, tie, start, anchor, at, low, high = (group[c].to_numpy() for c in RUN_FIELDS[1:4] + ["anchor"] + RUN_FIELDS[4:7])
        texts = group["bytes"].to_pylist()
        found = np.array([x[:4] for x in halves(texts, anchor, at, low, high, length)], np.int64).reshape(-1, 4)
        _, of, times = np.unique(found[:, 1], return_inverse=True, return_counts=True)
        number, key, first, last = found[times[of] > 1].T
        place = start[number] + first
        own = [texts[k][a : b + length] for k, a, b in zip(number.tolist(), first.tolist(), last.tolist())]
        half, begin, windows = seen_before(own, key, (doc[number], tie[number], place), length)
        number = number[half]
        tidy()
        return pa.table({"doc": doc[number], "tie": tie[number], "start": place[half] + begin, "windows": pa.array(windows, pa.int32())})

    dealt = rows.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), *RUN_FIELDS)
    return dealt.groupBy("shard").applyInArrow(run, "doc long, tie long, start long, windows int")


def repeated_windows(docs: DataFrame, texts: DataFrame, length: int, shard_bytes: int, most_runs: int, sample_docs: int, often: float) -> DataFrame:
    """All marks."""
    rows = written(sorted_out(all_runs(docs, length, frequent_anchors(docs, length, sample_docs, often))), "runs")
    marks, firsts = settled(rows)
    size, n_large = firsts.agg(F.sum(F.col("windows") + length), F.count(F.when(F.col("n") > most_runs, 1))).first()
    if not size:
        return marks
    usual = cut_out(texts, firsts, length)
    if n_large:
        large = firsts.where(F.col("n") > most_runs).select(F.col("anchor").alias("large")).distinct()
        cut = written(usual.join(large, F.col("anchor") == F.col("large"), "left"), "cut-out-runs")
        further, own = dealt_further(cut.where("large is not null").select(*RUN_FIELDS), length, most_runs)
        usual, marks = cut.where("large is null").select(*RUN_FIELDS).unionByName(further), marks.unionByName(own)
    return marks.unionByName(indexed(usual, length, max(1, size // shard_bytes)))


def covered(size: int, start: list[int], windows: list[int], length: int) -> np.ndarray:
    """For each byte, whether a marked window covers it."""
    edges = np.zeros(size + 1, np.int64)
    a = np.minimum(np.array(start, np.int64), size)
    np.add.at(edges, a, 1)
    np.add.at(edges, np.minimum(a + np.array(windows, np.int64) + length - 1, size), -1)
    return np.cumsum(edges[:-1]) > 0


def without_repeats(df: DataFrame, length: int = LENGTH, with_text: bool = False, shard_bytes: int = SHARD_BYTES, most_runs: int = MOST_RUNS, sample_docs: int = SAMPLE_DOCS, often: float = OFTEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. with_text: also text, what is left (bytes cut out of a character are dropped with it), and rest, a struct of df's other columns."""
    if length < anchors.GRAM:
        raise ValueError(f"passages of fewer than {anchors.GRAM} bytes have no anchor")
    whole, alone = keyed(df, id_col, text_col)
    docs = whole.select(*KEY, F.col("_text").alias("text"))
    one_each = packed_texts(docs)
    if not alone:
        one_each = one_each.dropDuplicates(KEY)
    marks = repeated_windows(docs, one_each, length, shard_bytes, most_runs, sample_docs, often)
    # a set: rows without an id and with equal texts all mark the same windows, so a list is bounded by a text
    lists = marks.groupBy(*KEY).agg(F.collect_set(F.struct("start", "windows")).alias("own")).select(*KEY, F.col("own.start").alias("start"), F.col("own.windows").alias("windows"))
    others = [F.col("rest")[c].alias(c) for c in df.columns if c not in (id_col, text_col)] or [F.lit(None).cast("int").alias("none")]
    texts = packed_texts(whole.select(*KEY, F.col("_text").alias("text"), "_id", *[F.struct(*others).alias("rest")] * with_text))
    both = texts.join(lists, KEY, "left").select("_id", "packed", "start", "windows", *["rest"] * with_text)
    more = f", text string, rest {texts.schema['rest'].dataType.simpleString()}" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sizes, removed, spans, digests, left = [], [], [], [], []
                for packed, start, windows in zip(*(part.column(c).to_pylist() for c in (1, 2, 3))):
                    text = press.decompress(packed)
                    kept, gone, n = text, 0, 0
                    if start:
                        mask = covered(len(text), start, windows, length)
                        gone = int(mask.sum())
                        n = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
                        kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
                    sizes.append(len(text))
                    removed.append(gone)
                    spans.append(n)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    left.append(kept.decode(errors="ignore") if with_text else None)
                cols = [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    cols, names = [*cols, pa.array(left, pa.string()), part.column(4)], [*names, "text", "rest"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return both.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)


def op8_run_length_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
