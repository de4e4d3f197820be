"""Documents as codes into a block's own list of distinct words.

A pass over the documents cuts each input partition into blocks of bounded size. A block's distinct
words go out as rows of their own, in lists dealt by a hash of the word; the documents stay behind
as arrays of codes, a code being a word's place in the block's lists. Whatever a word is worth (ids,
counts) is then worked out once for each distinct word of the corpus, sent back to the blocks, and
the documents are put together from it by position.

The two outputs come from one run that is written (``coded``), or from two runs of the same function
over the same partitions. Each carries a checksum of the block's words, and putting together fails if
they differ; so for two runs the input must be a table or anything else whose partitions come out
alike when they are computed again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import tidied

#: A block ends after so many bytes of text; the document that passes the bound still belongs to it.
BLOCK_BYTES = 24_000_000
#: Lists of words in a block, at least; a list is what travels as one row. With twice as many lists as input partitions, a list's words from all blocks stay about as many at any size.
LISTS = 128

DOC_SCHEMA = "block long, check long, doc_id long, flag boolean, codes binary"
WORD_SCHEMA = "block long, check long, list int, words binary, counts binary"


@functools.cache
def _coders() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Those of a Python worker, which has one thread: setting them up takes longer than a text does."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(a: np.ndarray) -> bytes:
    return _coders()[0].compress(a.tobytes())


def unpacked(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_coders()[1].decompress(b), dtype=kind)


def packed_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words))


def unpacked_words(b: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(b)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()] if n else []
    return [raw[a:b] for a, b in zip(starts, ends.tolist())]


class _Numbers(dict):
    """Words get numbers as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Block:
    """Lists and codes are settled when the block ends."""

    def __init__(self, number: int, lists: int):
        self.number, self.lists, self.known, self.docs, self.bytes = number, lists, _Numbers(), [], 0

    def add(self, doc_id: int | None, flag: bool | None, words: list) -> None:
        self.docs.append((doc_id, flag, np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words))))

    def settled(self) -> tuple[list[list[bytes]], np.ndarray, int]:
        """Lists of words; the code of each number (its place in all lists, one after the other); a checksum."""
        words = [w if isinstance(w, bytes) else w.encode() for w in self.known]
        self.known.clear()
        at = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)) % np.uint32(self.lists)
        order = np.argsort(at, kind="stable")
        code = np.empty(len(words), np.uint32)
        code[order] = np.arange(len(words), dtype=np.uint32)
        lists = [[] for _ in range(self.lists)]
        for k in order.tolist():
            lists[at[k]].append(words[k])
        check = xxhash.xxh64()
        for x in lists:
            check.update(b"\x00".join(x))
        return lists, code, check.intdigest() - (1 << 63)


def _blocks(batches: Iterator[pa.RecordBatch], split: Callable[[str], list], lists: int) -> Iterator[_Block]:
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 20
    block = _Block(number, lists)
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            for doc_id, flag, text in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns[:3])):
                text = text or ""
                block.add(doc_id, flag, split(text))
                block.bytes += len(text)
                if block.bytes >= BLOCK_BYTES:
                    yield block
                    number += 1
                    block = _Block(number, lists)
    if block.docs:
        yield block


def list_count(docs: DataFrame) -> int:
    return max(LISTS, 2 * docs.rdd.getNumPartitions())


def _doc_batches(block: _Block, code: np.ndarray, check: int) -> Iterator[dict[str, pa.Array]]:
    for k in range(0, len(block.docs), 512):
        part = block.docs[k : k + 512]
        yield {"block": pa.array([block.number] * len(part), pa.int64()), "check": pa.array([check] * len(part), pa.int64()), "doc_id": pa.array([d for d, _, _ in part], pa.int64()), "flag": pa.array([f for _, f, _ in part], pa.bool_()), "codes": pa.array([packed(code[n]) for _, _, n in part], pa.binary())}


def _word_batches(block: _Block, own: list[list[bytes]], code: np.ndarray, check: int, counted: bool) -> Iterator[dict[str, pa.Array]]:
    ends = np.cumsum([len(x) for x in own])
    counts = np.zeros(len(code), np.int64)
    flagged = [numbers for _, flag, numbers in block.docs if flag] if counted else []
    for k in range(0, len(flagged), 1000):
        counts += np.bincount(code[np.concatenate(flagged[k : k + 1000])], minlength=len(code))
    rows = [(k, packed_words(x), packed(counts[e - len(x) : e].astype(np.uint32)) if counted else None) for k, (x, e) in enumerate(zip(own, ends)) if x]
    for k in range(0, len(rows), 32):
        part = rows[k : k + 32]
        yield {"block": pa.array([block.number] * len(part), pa.int64()), "check": pa.array([check] * len(part), pa.int64()), "list": pa.array([r[0] for r in part], pa.int32()), "words": pa.array([r[1] for r in part], pa.binary()), "counts": pa.array([r[2] for r in part], pa.binary())}


def coded_docs(docs: DataFrame, split: Callable[[str], list], lists: int) -> DataFrame:
    """docs has the columns doc_id, flag, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, split, lists):
            _, code, check = block.settled()
            for cols in _doc_batches(block, code, check):
                yield pa.RecordBatch.from_pydict(cols)
            del block, code  # before the next one is filled

    return docs.mapInArrow(tidied(run), DOC_SCHEMA)


def block_words(docs: DataFrame, split: Callable[[str], list], lists: int, counted: bool = False) -> DataFrame:
    """A row for each list of each block. counted: with the words' counts in the documents whose flag is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, split, lists):
            own, code, check = block.settled()
            for cols in _word_batches(block, own, code, check, counted):
                yield pa.RecordBatch.from_pydict(cols)
            del block, own, code

    return docs.mapInArrow(tidied(run), WORD_SCHEMA)


def coded(docs: DataFrame, split: Callable[[str], list], lists: int) -> DataFrame:
    """The rows of coded_docs and of block_words (with counts) from one run; list is null in the former. To be written: it costs room instead of a second run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, split, lists):
            own, code, check = block.settled()
            for cols in _doc_batches(block, code, check):
                n = len(cols["block"])
                yield pa.RecordBatch.from_pydict(cols | {"list": pa.nulls(n, pa.int32()), "words": pa.nulls(n, pa.binary()), "counts": pa.nulls(n, pa.binary())})
            for cols in _word_batches(block, own, code, check, True):
                n = len(cols["block"])
                yield pa.RecordBatch.from_pydict({"block": cols["block"], "check": cols["check"], "doc_id": pa.nulls(n, pa.int64()), "flag": pa.nulls(n, pa.bool_()), "codes": pa.nulls(n, pa.binary()), "list": cols["list"], "words": cols["words"], "counts": cols["counts"]})
            del block, own, code

    return docs.mapInArrow(tidied(run), DOC_SCHEMA + ", list int, words binary, counts binary")
