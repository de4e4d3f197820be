"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers encode a space and the text: A is a byte-level BPE, B a piece model with byte
fallback, which adds that space itself. Token ends are marked in packed bitsets over the bytes; their
AND has the shared cuts, popcounts give each cut's rank among A's and among B's tokens, and so the
token ranges between cuts (groups). Tokens that end together are links.

A text is cut before each single space that stands between two characters that are not white space.
Neither tokenizer has a token across such a place, so it is a shared cut, and a segment that occurs
again is encoded and aligned once for each slice of documents.

The counts of id pairs cover the whole corpus. Two ids can only be linked if the bytes of one end in
those of the other, so the table of pairs is bounded by the two vocabularies (324,000 pairs with those
of production), however large the corpus is; that is why it may be broadcast.

Null and empty texts have no tokens. Nor have texts that a tokenizer doesn't give back byte by byte
(such as those with U+2581 in them); they count in no pair. Repeated rows, null and repeated ids are rows
of their own, other columns are left out, an empty table gives no rows, and texts of any length are
aligned whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: A slice of documents ends after so many characters; the document that passes the bound still belongs to it.
SLICE_CHARS = 8_000_000
#: Records of segments kept from slice to slice.
MOST_RECORDS = 200_000
#: No tokenizer joins the two sides of such a space. U+180E was white space once.
CUT = re.compile(" (?<=[^\\s᠎] )(?=[^\\s᠎])")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the other bytes in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """The two tokenizers and the bytes of their tokens.

    A's file also gives its ids as ranks where ids follow the order of merges; then segments are
    encoded by ranks, which takes a third of the time and gives the same ids.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token)) if letters.keys() >= set(token) else token.encode()
        self.ranks = self._ranks(a_path)
        pieces = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))

    def _ranks(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path) as file:
            told = json.load(file)
        model, added = told["model"], {t["id"] for t in told["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = len(model["vocab"]) - len(added & set(model["vocab"].values())) - len(pairs)
        plain = told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": told["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
        if not plain or model.get("ignore_merges") or any(model["vocab"].get(a + b) != first + k for k, (a, b) in enumerate(pairs)):
            return None
        ranks = {self.a_bytes[i]: i for i in model["vocab"].values() if i not in added}
        return tiktoken.Encoding("A", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encoded(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        spaced = [" " + x for x in segments]
        a = list(map(self.ranks.encode_ordinary, spaced)) if self.ranks else [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        return a, self.b.encode(segments, num_threads=1)


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


class Bits:
    """A packed bitset with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, places: np.ndarray, n: int) -> Bits:
        marks = np.zeros(-(-max(n, 1) // 64) * 64, np.bool_)
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set up to each place, itself included."""
        word, bit = places // 64, (places % 64).astype(np.uint64)
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return self.before[word] + np.bitwise_count(self.words[word] & upto)

    def selected(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Aligned:
    """Segments, aligned. A segment that is not given back byte by byte has ok false and counts for nothing.

    Group k has the A tokens a_ids[a_cuts[k]:a_cuts[k + 1]] and the B tokens b_ids[b_cuts[k]:b_cuts[k + 1]];
    segment s has the groups firsts[s] to firsts[s + 1].
    """

    def __init__(self, both: Tokenizers, segments: list[str]):
        a, b = both.encoded(segments)
        raw = [(" " + x).encode() for x in segments]
        joined = b"".join(raw)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        sides = [self._flat(x, of) for x, of in ((a, both.a_sizes), (b, both.b_sizes))]
        # all at once, as a segment that is not given back is rare
        if all(b"".join(map(of.__getitem__, ids.tolist())) == joined and np.array_equal(each, sizes) for (ids, _, each), of in zip(sides, (both.a_bytes, both.b_bytes))):
            self.ok = np.ones(len(raw), np.bool_)
        else:
            self.ok = np.array([b"".join(map(both.a_bytes.__getitem__, x)) == z == b"".join(map(both.b_bytes.__getitem__, y)) for x, y, z in zip(a, b, raw)], np.bool_)
            a, b = ([x if ok else x[:0] for x, ok in zip(xs, self.ok)] for xs in (a, b))
            sizes = np.where(self.ok, sizes, 0)
            sides = [self._flat(x, of) for x, of in ((a, both.a_sizes), (b, both.b_sizes))]
        (self.a_ids, self.n_a, _), (self.b_ids, self.n_b, _) = sides
        n = int(sizes.sum())
        ends_a, ends_b = (Bits.at(np.cumsum(of[ids]) - 1, n) for of, ids in ((both.a_sizes, self.a_ids), (both.b_sizes, self.b_ids)))
        cuts = (shared := ends_a & ends_b).selected()
        self.a_cuts, self.b_cuts = (np.concatenate([[0], x.rank(cuts)]) for x in (ends_a, ends_b))
        ends = np.cumsum(sizes)
        self.firsts = np.concatenate([[0], np.where(ends > 0, shared.rank(np.maximum(ends - 1, 0)), 0)])

    @staticmethod
    def _flat(ids: list[list[int]], of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, their number in each segment and their bytes in each segment."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
        ends = np.concatenate([[0], np.cumsum(of[flat])])
        return flat, n, np.diff(ends[np.concatenate([[0], np.cumsum(n)])])

    def links(self) -> np.ndarray:
        """A key for each group's link: its last A token and its last B token end together, and no others of it do."""
        return self.a_ids[self.a_cuts[1:] - 1] << 20 | self.b_ids[self.b_cuts[1:] - 1]

    def n_groups(self) -> np.ndarray:
        return np.diff(self.firsts)

    def group_texts(self) -> list[str]:
        """Each segment's groups as a1,a2|b1;a3|b2."""
        a, b = list(map(str, self.a_ids.tolist())), list(map(str, self.b_ids.tolist()))
        x, y, f = self.a_cuts.tolist(), self.b_cuts.tolist(), self.firsts.tolist()
        groups = [f"{','.join(a[i:j])}|{','.join(b[k:m])}" for i, j, k, m in zip(x, x[1:], y, y[1:])]
        return [";".join(groups[i:j]) for i, j in zip(f, f[1:])]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[str]]]]:
    """Ids and cut texts, a bounded number of characters at a time."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            ids.append(doc_id)
            texts.append(CUT.split(text) if text else [])
            chars += len(text)
            if chars >= SLICE_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def _bare(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    if a_path and b_path:
        return a_path, b_path
    import public_tokenizers

    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")


def pair_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a_id, b_id, n_links: how many links of the corpus hold the two ids."""
    paths = _paths(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, keys, sums = tokenizers(*paths), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, texts in _slices(batches):
            counts = Counter(x for t in texts for x in t)
            if not counts:
                continue
            got = Aligned(both, list(counts))
            if not got.ok.all():  # texts with such a segment have no tokens
                bad = {x for x, ok in zip(counts, got.ok) if not ok}
                for t in texts:
                    if not bad.isdisjoint(t):
                        counts.subtract(t)
            times = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), got.n_groups())
            keys, at = np.unique(np.concatenate([keys, got.links()]), return_inverse=True)
            both_sums = np.concatenate([sums, times])
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, both_sums)
        kept = sums > 0
        yield pa.RecordBatch.from_pydict({"a_id": pa.array((keys[kept] >> 20).astype(np.int32)), "b_id": pa.array((keys[kept] & 0xFFFFF).astype(np.int32)), "n_links": pa.array(sums[kept])})

    each = _bare(df, id_col, text_col).mapInArrow(run, "a_id int, b_id int, n_links long")
    return each.groupBy("a_id", "b_id").agg(F.sum("n_links").alias("n_links"))


def aligned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, and the numbers of A and of B tokens in each group (a_group, b_group); all empty for texts without tokens."""
    paths = _paths(a_path, b_path)
    kinds = {"doc_id": pa.int64()} | {c: pa.list_(pa.int32()) for c in ("a_ids", "b_ids", "a_group", "b_group")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*paths)
        for ids, texts in _slices(batches):
            got = Aligned(both, [x for t in texts for x in t])
            ends = np.cumsum([len(t) for t in texts])
            cols = {c: [] for c in kinds}
            for doc_id, e, t in zip(ids, ends.tolist(), texts):
                s = e - len(t)
                first, last = (got.firsts[s], got.firsts[e]) if t and got.ok[s:e].all() else (0, 0)
                cols["doc_id"].append(doc_id)
                for side, all_ids, cuts in (("a", got.a_ids, got.a_cuts), ("b", got.b_ids, got.b_cuts)):
                    cols[f"{side}_ids"].append(all_ids[cuts[first] : cuts[last]])
                    cols[f"{side}_group"].append(np.diff(cuts[first : last + 1]))
            yield pa.RecordBatch.from_pydict({c: pa.array(x, kinds[c]) for c, x in cols.items()})

    return _bare(df, id_col, text_col).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>")


def judged_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with best: true where no other A id has more links with the B id."""
    highest = pairs.groupBy(F.col("b_id").alias("of")).agg(F.max("n_links").alias("most"))
    return pairs.join(highest, F.col("b_id") == F.col("of")).select("a_id", "b_id", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, the counts of COUNTS and groups (texts such as a1,a2|b1;a3|b2,b3) by their SHA-256."""
    paths, spark = _paths(a_path, b_path), df.sparkSession
    pairs = written(judged_pairs(pair_counts(df, id_col, text_col, *paths)), "token-pairs").toArrow()  # bounded by the vocabularies
    keys = pairs["a_id"].to_numpy().astype(np.int64) << 20 | pairs["b_id"].to_numpy()
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], pairs["n_links"].to_numpy()[order], pairs["best"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, (keys, n_links, best) = tokenizers(*paths), known.value
        number, groups, rows = {}, [], np.zeros((0, 6), np.int64)
        for ids, texts in _slices(batches):
            if len(number) > MOST_RECORDS:
                number, groups, rows = {}, [], rows[:0]
            new = list({x: None for t in texts for x in t if x not in number})
            if new:
                got = Aligned(both, new)
                links, firsts = got.links(), got.firsts
                at = np.minimum(np.searchsorted(keys, links), max(len(keys) - 1, 0))
                # links of texts without tokens may be unknown; nobody sums them up
                sums = [np.concatenate([[0], np.cumsum(x[at] if len(keys) else np.zeros(len(at)), dtype=np.int64)]) for x in (best, n_links)]
                each = [got.n_a, got.n_b, got.n_groups(), got.n_groups(), *(np.diff(x[firsts]) for x in sums)]
                number |= {x: len(number) + k for k, x in enumerate(new)}
                rows = np.concatenate([rows, np.stack(each, 1).astype(np.int64)])
                groups += [text if ok else None for text, ok in zip(got.group_texts(), got.ok)]
            out, digests = np.zeros((len(ids), 6), np.int64), [""] * len(ids)
            for k, t in enumerate(texts):
                places = [number[x] for x in t]
                parts = [groups[p] for p in places]
                if parts and None not in parts:
                    out[k] = rows[places].sum(0)
                    digests[k] = hashlib.sha256(";".join(parts).encode()).hexdigest()
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64())} | {c: pa.array(out[:, k]) for k, c in enumerate(COUNTS)} | {"groups_sha256": pa.array(digests, pa.string())})

    return _bare(df, id_col, text_col).mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents"))
