"""Byte-level BPE by way of a global shuffle of distinct words.

Texts are cut before every word, where no match of the pre-token pattern can reach across: a word
with the one space before it, or a run of white space. Each block of documents keeps its words'
positions and sends out its distinct words; over all blocks each distinct word is encoded once (its
pattern matches one by one); the ids are joined back to the blocks and put together by position.
Words travel in packed lists: a row for each word would be several times the input (README).

Merging is done here (``Merger``), for many pre-tokens in step: in each step every pre-token merges the
leftmost of its pairs with the lowest rank. Decoding looks ids up in the token-byte table, which each
worker loads and which has as many rows as the vocabulary.

A null text is an empty one: no ids. Null ids and repeated rows are kept as they are, one result a
row; texts of any length are encoded whole; an empty table gives no rows. The strings of special
tokens are ordinary text. The input is read twice; unless it is said to be a table, it is written first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import block_words, coded_docs, list_count, packed, unpacked, unpacked_words
from .common import table, tidy, written

#: The characters of the Unicode property White_Space, as in a character class.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_RARE_WHITE = re.compile(f"[{WHITE.replace(' ', '').replace(chr(10), '')}]")


def units(text: str) -> list[str]:
    """The text in pieces whose pre-tokens, one piece after the other, are the text's pre-tokens."""
    if "  " in text or " \n" in text or "\n " in text or _RARE_WHITE.search(text):
        return _UNIT.findall(text)
    first, *rest = text.split(" ")
    out = [" " + x for x in rest]
    if first:
        out.insert(0, first)
    return out


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merger:
    """Merges by the ranks of a rank file; a token's id is its rank."""

    #: Pre-tokens of more bytes are merged one by one.
    LONG = 64
    #: Rank of a pair that is no token.
    NONE = np.int32(1 << 30)

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.by_id = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.by_id[k] = token
        # every way to put a token together from two others: pairs, sorted, and what they become
        made = np.fromiter((x for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks for x in (ranks[t[:k]] << 32 | ranks[t[k:]], r)), np.int64).reshape(-1, 2)
        self.pairs, self.become = made[np.argsort(made[:, 0])].T.copy()

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.become[at], self.NONE).astype(np.int32)

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each of distinct pre-tokens."""
        out: list = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = [whole]
            elif len(piece) > self.LONG:
                out[k] = self.merged_alone(piece)
            else:
                by_length.setdefault(len(piece), []).append(k)
        for length, own in by_length.items():
            for m in range(0, len(own), 20_000):
                part = own[m : m + 20_000]
                for k, ids in zip(part, self._in_step(np.frombuffer(b"".join(pieces[k] for k in part), np.uint8).reshape(-1, length))):
                    out[k] = ids
        return out

    def _in_step(self, raw: np.ndarray) -> list[list[int]]:
        """Pre-tokens of one length, a row each."""
        ids = self.of_byte[raw].astype(np.int32)
        n, width = ids.shape
        if width < 2:
            return ids.tolist()
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        sizes, done = np.full(n, width), [None] * n
        rows = np.arange(n)
        while len(rows):
            at = ranks.argmin(axis=1)
            found = ranks[np.arange(len(rows)), at]
            over = found == self.NONE
            if over.any():
                for r, size, own in zip(rows[over].tolist(), sizes[over].tolist(), ids[over].tolist()):
                    done[r] = own[:size]
                going = ~over
                rows, ids, ranks, sizes, at, found = rows[going], ids[going], ranks[going], sizes[going], at[going], found[going]
                if not len(rows):
                    break
            each, last = np.arange(len(rows)), ids.shape[1] - 1
            # all that follows the pair moves up by one
            ids[:, :-1] = np.where(np.arange(last) > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[each, at] = found
            if last > 1:
                ranks[:, :-1] = np.where(np.arange(last - 1) > at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = self.NONE
            sizes -= 1
            for k in (at - 1, at):
                pair = np.flatnonzero((k >= 0) & (k + 1 < sizes))
                ranks[pair, k[pair]] = self.pair_ranks(ids[pair, k[pair]], ids[pair, k[pair] + 1])
                if k is at:
                    end = np.flatnonzero(at + 1 >= sizes)
                    ranks[end, np.minimum(at[end], ranks.shape[1] - 1)] = self.NONE
            ids, ranks = (ids[:, :-1], ranks[:, : max(1, last - 1)]) if last > 1 else (ids, ranks)
        return done

    def merged_alone(self, piece: bytes) -> list[int]:
        """One long pre-token: pairs in a heap by rank and place, tokens in a linked list."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, live = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        table = dict(zip(self.pairs.tolist(), self.become.tolist())) if not hasattr(self, "_table") else self._table
        self._table = table
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := table.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            m = after[k] if live[k] else -1
            if m < 0 or ids[k] != left or ids[m] != right:
                continue
            ids[k], live[m], after[k] = rank, False, after[m]
            if after[m] >= 0:
                before[after[m]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := table.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x, own in zip(ids, live) if own]

    def encoded(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: of its pattern matches, one after the other."""
        number: dict[bytes, int] = {}
        parts = []
        for word in words:
            # most words are letters after a space or none: one match
            plain = word[1:] if word[:1] == b" " else word
            own = [word] if plain.isalpha() else [m.encode() for m in self.pattern.findall(word.decode())]
            parts.append([number.setdefault(x, len(number)) for x in own])
        ids = self.merged(list(number))
        return [ids[own[0]] if len(own) == 1 else [x for k in own for x in ids[k]] for own in parts]


_MERGERS: dict = {}


def merger(path: str, pattern: str) -> Merger:
    """That of a rank file, one in a Python worker."""
    if (path, pattern) not in _MERGERS:
        _MERGERS[path, pattern] = Merger(ranks_of(path), pattern)
    return _MERGERS[path, pattern]


def encoded_words(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """Lists of words to the same lists as ids: every distinct word of a list is encoded once, whatever the number of blocks that have it."""

    def encode(group: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        own = [np.array([number.setdefault(w, len(number)) for w in unpacked_words(blob)], np.int64) for blob in group["words"].to_pylist()]
        parts = merger(path, pattern).encoded(list(number))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.fromiter((x for p in parts for x in p), np.uint32, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        del number, parts
        tidy()
        return pa.table({"block": group["block"], "check": group["check"], "list": group["list"], "lengths": pa.array([packed(lengths[x].astype(np.uint32)) for x in own], pa.binary()), "ids": pa.array([packed(by_position(x, lengths, starts, ids)) for x in own], pa.binary())})

    return words.groupBy("list").applyInArrow(encode, "block long, check long, list int, lengths binary, ids binary")


def flat(pieces: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(pieces) if pieces else np.empty(0, kind)


def by_position(codes: np.ndarray, lengths: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of each code, one code after the other."""
    n = lengths[codes]
    ends = np.cumsum(n)
    if not len(ends):
        return values[:0]
    return values[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1])]


def put_together(docs: DataFrame, lists: DataFrame, path: str, pattern: str, with_ids: bool) -> DataFrame:
    def rebuild(coded: pa.Table, dictionary: pa.Table) -> pa.Table:
        by_id = merger(path, pattern).by_id
        if len({*coded["check"].to_pylist(), *dictionary["check"].to_pylist()}) > 1:
            raise ValueError("the input's partitions changed between two runs; write it to a table first")
        order = np.argsort(np.array(dictionary["list"].to_pylist(), np.int64), kind="stable").tolist()
        sizes, ids = dictionary["lengths"].to_pylist(), dictionary["ids"].to_pylist()
        lengths = flat([unpacked(sizes[k], np.uint32) for k in order], np.uint32).astype(np.int64)
        values = flat([unpacked(ids[k], np.uint32) for k in order], np.uint32)
        starts = np.cumsum(lengths) - lengths
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for blob in coded["codes"].to_pylist():
            own = by_position(unpacked(blob, np.uint32), lengths, starts, values)
            out["n_tokens"].append(len(own))
            out["ids_sha256"].append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join(map(by_id.__getitem__, own.tolist()))).hexdigest())
            if with_ids:
                out["ids"].append(own.astype(np.int32))
        del lengths, values, starts, sizes, ids
        tidy()
        cols = {"doc_id": coded["doc_id"], "n_tokens": pa.array(out["n_tokens"], pa.int64()), "ids_sha256": pa.array(out["ids_sha256"], pa.string()), "decoded_sha256": pa.array(out["decoded_sha256"], pa.string())}
        return pa.table(cols | ({"ids": pa.array(out["ids"], pa.list_(pa.int32()))} if with_ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(rebuild, schema)


def encode(df: DataFrame, path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", is_table: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids. is_table: df is read from files, so its partitions come out alike when they are read again."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("flag"), F.col(text_col).cast("string").alias("text"))
    docs = docs if is_table else written(docs, "texts")
    lists = list_count(docs)
    words = encoded_words(block_words(docs, units, lists), path, pattern)
    return put_together(coded_docs(docs, units, lists), words, path, pattern, with_ids)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, is_table=True)
