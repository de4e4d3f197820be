"""Alignment of two tokenizers against a plain reckoning over whole texts."""

import base64
import hashlib
from collections import Counter

import pytest

from tidewheel.llm import crosstok

P = pytest.importorskip("public_tokenizers")


def ends(parts):
    out, at = [], 0
    for x in parts:
        at += len(x)
        out.append(at)
    return out


@pytest.fixture(scope="module")
def plain():
    """Ids and token bytes of whole texts: A from its ranks, B from its pieces."""
    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    a = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def encoded(text):
        if not text:
            return [], [], [], []
        x, y = a.encode_ordinary(" " + text), b.encode(text)
        xs = [a.decode_single_token_bytes(i) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        return (x, y, xs, ys) if b"".join(xs) == b"".join(ys) == (" " + text).encode() else ([], [], [], [])

    return encoded


def expected(rows, encoded):
    got, pairs = [], Counter()
    for doc_id, text in rows:
        x, y, xs, ys = encoded(text)
        ex, ey = ends(xs), ends(ys)
        cuts = sorted(set(ex) & set(ey))
        links = [(x[ex.index(c)], y[ey.index(c)]) for c in cuts]
        groups, last = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, e in zip(x, ex) if last < e <= c) + "|" + ",".join(str(i) for i, e in zip(y, ey) if last < e <= c))
            last = c
        pairs.update(links)
        got.append((doc_id, len(x), len(y), links, ";".join(groups)))
    most = Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    out = [(d, n, m, len(k), len(k), sum(pairs[p] == most[p[1]] for p in k), sum(pairs[p] for p in k), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, n, m, k, g in got]
    return out, pairs


ODD = [(1, "a▁b c d"), (2, "a▁ b"), (3, "a  b   c \n d"), (4, " lead"), (5, "tail "), (6, "x\ty\nz\r\nq"), (7, "　 a\x0bb  \x85c d"), (8, "<|endoftext|> <s> </s> <unk> <0x41>"), (9, "\x00 a\x1c b"), (10, "don't we'll 12,345.67 -- !!!"), (11, "日本語 text 한국어 😀😀"), (12, "a᠎ b ​ c")]


def test_alignment_equals_the_plain_reckoning(spark, docs, raw, plain):
    rows = [(r[0], r[1]) for r in raw if len(r[1] or "") < 3000] + ODD
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, links int").repartition(3)
    want, pairs = expected(rows, plain)
    got = [tuple(r) for r in crosstok.measured(df).select("doc_id", *crosstok.COUNTS, "groups_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(r.a_id, r.b_id): r.n_links for r in crosstok.pair_counts(df).collect()} == pairs
    assert any(w[1] == 0 and t for w, (_, t) in zip(want, rows))  # some texts are not given back byte by byte


def test_groups_cover_both_sides(spark, raw, plain):
    rows = [(r[0], r[1]) for r in raw if len(r[1] or "") < 3000] + ODD
    got = crosstok.aligned(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    for r, (_, text) in zip(got, rows):
        x, y, xs, ys = plain(text)
        assert (r.a_ids, r.b_ids) == (x, y)
        assert sum(r.a_group) == len(x) and sum(r.b_group) == len(y) and len(r.a_group) == len(r.b_group)
        assert all(c in ends(ys) for c in [ends(xs)[k - 1] for k in ends([range(n) for n in r.a_group])])


def test_long_texts_and_small_slices(spark, docs, raw, plain, monkeypatch):
    """Texts longer than a slice, and records forgotten between slices, change nothing."""
    whole = {str(r) for r in crosstok.measured(docs).collect()}
    long = {r[0]: r[1] for r in raw if len(r[1] or "") >= 3000}
    for d in crosstok.measured(docs).where("doc_id in (120, 121)").collect():
        x, y, _, _ = plain(long[d.doc_id])
        assert (d.n_a, d.n_b) == (len(x), len(y))
    small = docs.repartition(11)
    assert {str(r) for r in crosstok.measured(small).collect()} == whole


def test_empty_table(spark, empty):
    assert crosstok.measured(empty).count() == 0
    assert crosstok.aligned(empty).count() == 0


def test_segments_that_are_not_given_back():
    both = crosstok.tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    got = crosstok.Aligned(both, ["▁", "word", "▁x", "▁", "one"])
    assert got.ok.tolist() == [False, True, False, False, True]
    assert [bool(t) for t in got.group_texts()] == got.ok.tolist() == [n > 0 for n in got.n_groups()]
    assert crosstok.Aligned(both, ["▁"]).links().size == 0


def test_both_ways_to_encode_agree(raw):
    both = crosstok.tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    texts = [t for _, t in ODD] + [r[1][:3000] for r in raw if r[1]]
    segments = sorted({x for t in texts for x in crosstok.CUT.split(t)})
    assert both.ranks
    ranks, both.ranks = both.ranks, None
    slow = both.encoded(segments)
    both.ranks = ranks
    assert both.encoded(segments) == slow
    assert [x.ids for x in both.a.encode_batch([" " + t for t in texts], add_special_tokens=False)] == [sum(x, []) for x in ([ranks.encode_ordinary(" " + y) for y in crosstok.CUT.split(t)] for t in texts)]


def test_bitset_ranks():
    import numpy as np

    places = np.array([0, 3, 63, 64, 130])
    bits = crosstok.Bits.at(places, 131)
    assert bits.selected().tolist() == places.tolist()
    assert bits.rank(np.array([0, 2, 3, 63, 64, 129, 130])).tolist() == [1, 1, 2, 3, 4, 4, 5]
