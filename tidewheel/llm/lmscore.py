"""Scoring texts with a small causal self-attention model over subword ids.

Words are lower-cased (A-Z) and counted over all training documents by the global shuffle of
distinct words of ``blocks``; each distinct word is also cut into byte-level BPE ids once. Joined
back by position, a document is its words' ids and one end. The ids' corpus counts give the model's
classes, its tail and its first biases.

``attention`` is trained on all windows of all training documents, however large the corpus is. The first
round trains on about one shard of bounded size, taken evenly from all documents, which gives the others
a common start. In the second every task goes through its own documents, deals their windows into
shards and trains each from the same weights (only a corpus of few blocks is shuffled for it);
the results are averaged, weighted by tokens. Scoring is one pass over the documents as ids: each token is scored once, in the one of its
overlapping windows that has it among the last ``STRIDE``.

A null text is an empty one: the end alone. Null ids count as the empty text when held out by id;
they and repeated rows are kept, one result a row; texts of any length are scored whole; an empty
table gives no rows. Where there is nothing to learn from, counts are zero and the model is the
untrained one. Reruns over the same files and partitions agree up to rounding.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .attention import STRIDE, WINDOW, Ranks, Weights
from .blocks import coded, list_count, packed, unpacked, unpacked_words
from .bpe import by_position, flat, merger
from .common import table, written
from .langid import held_out

#: The share of the training documents' windows that is learned from: all, at any size.
LEAST_SHARE = 1.0
#: Tokens of a training shard, about; shards that a task fills side by side, so that neighbouring windows go to different ones.
SHARD_TOKENS, BESIDE = 500_000, 8
#: Sums of weights that a task adds up, and that come to the driver.
SUMS = 16
#: Times that a shard goes over its windows in a round, and the learning rates at the round's start and end.
ROUNDS = [(4, 0.02, 0.01), (2, 0.01, 0.0002)]
#: Tokens that are scored at once.
AT_ONCE = 500_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower_words(text: str) -> list[bytes]:
    """bytes.split cuts at the space and 09 to 0D, and at nothing else."""
    return text.encode().translate(_LOWER).split()


def counted_words(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """Lists of words to their subwords (lengths, ids) and corpus counts. Each list also has a row without block: its training tokens, distinct training words, and counts of ids."""

    def count(group: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        own, each = [], []
        for words, counts in zip(group["words"].to_pylist(), group["counts"].to_pylist()):
            own.append(np.array([number.setdefault(w, len(number)) for w in unpacked_words(words)], np.int64))
            each.append(unpacked(counts, np.uint32))
        total = np.bincount(flat(own, np.int64), weights=flat(each, np.uint32), minlength=len(number)).astype(np.int64)
        parts = merger(path, pattern).encoded([b" " + w for w in number])
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.fromiter((x for p in parts for x in p), np.int64, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        sums = np.bincount(ids, weights=np.repeat(total, lengths), minlength=1).astype(np.int64)
        some = np.flatnonzero(sums)
        n = group.num_rows
        return pa.table({
            "block": pa.array([*group["block"].to_pylist(), None], pa.int64()), "check": pa.array([*group["check"].to_pylist(), None], pa.int64()), "list": pa.array([*group["list"].to_pylist(), None], pa.int32()),
            "lengths": pa.array([*(packed(lengths[x].astype(np.uint32)) for x in own), None], pa.binary()),
            "ids": pa.array([*(packed(by_position(x, lengths, starts, ids).astype(np.uint32)) for x in own), None], pa.binary()),
            "counts": pa.array([*(packed(total[x]) for x in own), None], pa.binary()),
            "tokens": pa.array([None] * n + [int(total.sum())], pa.int64()), "distinct": pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
            "of": pa.array([None] * n + [list(zip(some.tolist(), sums[some].tolist()))], pa.map_(pa.int32(), pa.int64())),
        })

    return words.groupBy("list").applyInArrow(count, "block long, check long, list int, lengths binary, ids binary, counts binary, tokens long, distinct long, of map<int,long>")


def as_slots(docs: DataFrame, lists: DataFrame, ranks: Ranks, train_docs: int, tokens: int, distinct: int, end: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, tail (the tail members' log probability), slots."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks.slot, ranks.tail_log))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, tail double, slots binary"

    def rebuild(coded: pa.Table, dictionary: pa.Table) -> pa.Table:
        slot_of, tail_log = shared.value
        if len({*coded["check"].to_pylist(), *dictionary["check"].to_pylist()}) > 1:
            raise ValueError("the input's partitions changed between two runs; write it to a table first")
        coded = coded.sort_by([("doc_id", "ascending"), ("codes", "ascending")])  # shards of training windows follow this order
        order = np.argsort(np.array(dictionary["list"].to_pylist(), np.int64), kind="stable").tolist()
        pieces = {c: dictionary[c].to_pylist() for c in ("lengths", "ids", "counts")}
        lengths = flat([unpacked(pieces["lengths"][k], np.uint32) for k in order], np.uint32).astype(np.int64)
        ids = flat([unpacked(pieces["ids"][k], np.uint32) for k in order], np.uint32)
        counts = flat([unpacked(pieces["counts"][k], np.int64) for k in order], np.int64)
        starts = np.cumsum(lengths) - lengths
        slots = slot_of[ids].astype(np.uint16)
        rare = np.where(slots == attention.TAIL, tail_log[ids], 0.0)
        tails = np.add.reduceat(rare, starts) if len(rare) else rare
        bases = np.log10((counts + 1) / (tokens + distinct + 1))
        known = counts > 0
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "tail": [], "slots": []}
        for blob in coded["codes"].to_pylist():
            code = unpacked(blob, np.uint32)
            out["n_tokens"].append(len(code) + 1)
            out["n_known"].append(int(known[code].sum()) + (train_docs > 0))
            out["base_score"].append(float(bases[code].sum() + np.log10((train_docs + 1) / (tokens + distinct + 1))))
            out["tail"].append(float(tails[code].sum() + (tail_log[end] if slot_of[end] == attention.TAIL else 0)))
            out["slots"].append(packed(np.append(by_position(code, lengths, starts, slots), slot_of[end]).astype(np.uint16)))
        train = np.array(coded["flag"].to_pylist(), bool)
        return pa.table({"doc_id": coded["doc_id"], "held_out": pa.array(~train), **{c: pa.array(out[c], t) for c, t in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("tail", pa.float64()), ("slots", pa.binary()))}})

    return docs.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(rebuild, schema)


Windows = Iterator[tuple[int, np.ndarray, np.ndarray]]


def _dealt(batches: Iterator[pa.RecordBatch], share: float, shards: int) -> Windows:
    """Shard, inputs and targets of some windows at a time. batches: seed, slots."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            texts = [unpacked(x, np.uint16).astype(np.int32) for x in part.column(1).to_pylist()]
            inputs, targets, starts, text = attention.laid_out(texts)
            first = np.searchsorted(text, np.arange(len(texts)))
            seed = part.column(0).to_numpy()[text].astype(np.int64)
            place = (np.arange(len(starts)) - first[text]) * share + seed / (1 << 31)
            chosen = np.floor(place + share) > np.floor(place)
            shard = (seed[chosen] + np.arange(int(chosen.sum()))) % shards
            starts = starts[chosen]
            if not len(starts):
                continue
            x = np.lib.stride_tricks.sliding_window_view(inputs, WINDOW)[starts].astype(np.int16)
            y = np.lib.stride_tricks.sliding_window_view(targets, WINDOW)[starts][:, -STRIDE:].astype(np.int16)
            for s in np.unique(shard).tolist():
                yield s, x[shard == s], y[shard == s]


def _stored(batches: Iterator[pa.RecordBatch]) -> Windows:
    """Those of training_windows' rows."""
    for batch in batches:
        for shard, inputs, targets in zip(*(c.to_pylist() for c in batch.columns)):
            yield shard, unpacked(inputs, np.int16).reshape(-1, WINDOW), unpacked(targets, np.int16).reshape(-1, STRIDE)


def _seeded(docs: DataFrame) -> DataFrame:
    return docs.where("not held_out").select(F.pmod(F.xxhash64("doc_id", "slots"), F.lit(1 << 31)).alias("seed"), "slots")


def spread(docs: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """The training documents for a round of ``weighed``, and its tasks. A task has a shard's worth of a small corpus, whose few blocks are dealt to all cores. Of a few
    blocks of a larger one some have many times the tokens of others, and all would wait for the largest: documents are dealt evenly, two tasks a core. Many blocks stay where they are."""
    found, cores = docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    even = found < 4 * cores and shards >= BESIDE * cores  # several shards a task, so that they are as large as before
    tasks = 2 * cores if even else min(shards, max(found, cores))
    rows = _seeded(docs)
    return (rows.repartition(tasks, "seed").sortWithinPartitions("seed", "slots") if even or found < tasks else rows.coalesce(tasks)), tasks


def training_windows(docs: DataFrame, share: float, shards: int) -> DataFrame:
    """A share of the windows of each training document, evenly apart, from a place that a hash gives, so short documents give theirs as often as long ones: shard, inputs, targets (so many windows in a row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, x, y in _dealt(batches, share, shards):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([packed(x)], pa.binary()), pa.array([packed(y)], pa.binary())], names=["shard", "inputs", "targets"])

    return _seeded(docs).mapInArrow(run, "shard long, inputs binary, targets binary")


def weighed(rows: DataFrame, windows: Callable[[Iterator[pa.RecordBatch]], Windows], weights: Weights, number: int, passes: int, rates: tuple[float, float], shard_tokens: int | None) -> DataFrame:
    """A round: tasks cut the windows of their rows into shards (None: one), each trains from weights. A row a task: tokens seen, the sum of what the shards' weights become, weighted by them."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(weights))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, held, tokens, seen = pickle.loads(shared.value), {}, {}, 0
        total = {k: np.zeros(v.shape) for k, v in weights.items()}

        def learn(pieces: list[tuple[np.ndarray, np.ndarray]]) -> None:
            nonlocal seen
            x, y = (np.concatenate(own) for own in zip(*pieces))
            order = np.lexsort((x[:, -1], y[:, 0], y[:, -1]))  # rows may come in any order
            parts = max(1, int((y >= 0).sum()) // shard_tokens) if shard_tokens else 1
            for k in range(parts):
                own, goals = x[order[k::parts]].astype(np.int32), y[order[k::parts]].astype(np.int32)
                became, n = attention.trained(weights, own, goals, int((goals >= 0).sum()) * passes, *rates, seed=number)
                seen += n
                for name, w in became.items():
                    total[name] += w.astype(np.float64) * n

        for shard, x, y in windows(batches):
            held.setdefault(shard, []).append((x, y))
            tokens[shard] = tokens.get(shard, 0) + int((y >= 0).sum())
            if shard_tokens and tokens[shard] >= shard_tokens:
                tokens[shard] = 0
                learn(held.pop(shard))
        if held:
            learn([x for shard in sorted(held) for x in held[shard]])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([pickle.dumps(total)], pa.binary())], names=["seen", "weights"])

    return rows.mapInArrow(train, "seen long, weights binary")


def averaged(sums: DataFrame, tasks: int, weights: Weights) -> Weights:
    """The average of the sums of ``weighed``; weights, if nothing was seen. Tasks add up a few each until few are left."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = 0, None
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = pickle.loads(blob.as_py())
                total = own if total is None else {k: v + own[k] for k, v in total.items()}
                seen += n
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([pickle.dumps(total)], pa.binary())], names=["seen", "weights"])

    while tasks > SUMS:
        tasks = -(-tasks // SUMS)
        sums = sums.repartition(tasks).mapInArrow(add, "seen long, weights binary")
    rows = sums.collect()
    seen = sum(r[0] for r in rows)
    if not seen:
        return weights
    own = [pickle.loads(r[1]) for r in rows]
    return {k: (sum(s[k] for s in own) / seen).astype(np.float32) for k in weights}


def scored(docs: DataFrame, weights: Weights) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            out, texts, n = [], [], 0
            for blob in batch.column(5).to_pylist():
                texts.append(unpacked(blob, np.uint16).astype(np.int32))
                n += len(texts[-1])
                if n >= AT_ONCE:
                    out.append(attention.score(weights, texts))
                    texts, n = [], 0
            out.append(attention.score(weights, texts))
            score = (np.concatenate(out) + batch.column(6).to_numpy()) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "slots", "tail").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def share_for(subwords: int) -> float:
    """The share of windows that is trained on, unless a caller asks for another: all of them."""
    return LEAST_SHARE


def score(df: DataFrame, path: str, pattern: str, share: float | None = None, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, left: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), mod, left, False).alias("flag"), F.col(text_col).cast("string").alias("text"))
    lists = list_count(docs)
    cut = written(coded(docs, lower_words, lists), "codes")
    counted = written(counted_words(cut.where("list is not null").select("block", "check", "list", "words", "counts"), path, pattern), "word-counts")
    stats = counted.where("block is null")
    tokens, distinct = stats.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    train_docs = docs.where("flag").count()
    end = max(_vocabulary(path), 1)
    counts = np.zeros(end + 1)
    for k, n in stats.select(F.explode("of").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[k] = n
    counts[end] = train_docs
    ranks = Ranks(counts)
    tokens, distinct = tokens + train_docs, distinct + (train_docs > 0)
    words = counted.where("block is not null").select("block", "check", "list", "lengths", "ids", "counts")
    ids = written(as_slots(cut.where("list is null").select("block", "check", "doc_id", "flag", "codes"), words, ranks, train_docs, tokens, distinct, end), "slots")
    weights = attention.first_weights(ranks)
    subwords = int(counts.sum())
    share = share or share_for(subwords)
    shards = max(1, int(subwords * share) // SHARD_TOKENS)
    rows, tasks = spread(ids, shards)
    for number, (passes, *rates) in enumerate(ROUNDS):
        if number:
            sums = weighed(rows, partial(_dealt, share=share, shards=BESIDE), weights, number, passes, tuple(rates), SHARD_TOKENS)
        else:
            sums = weighed(training_windows(ids, share / shards, 1).repartition(1), _stored, weights, number, passes, tuple(rates), None)
        weights = averaged(sums, tasks if number else 1, weights)
    return scored(ids, weights).withColumn("train_tokens", F.lit(tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _vocabulary(path: str) -> int:
    """Ids of a rank file; the number after them is the end's."""
    with open(path, "rb") as f:
        return 1 + max(int(line.split()[1]) for line in f)


def op4_attention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
