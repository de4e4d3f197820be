"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_structure_operators import WORD, key, passage_truth, simhash_truth, targets_of
from tidewheel.llm import bpe, shingles
from tidewheel.llm.common import written


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, outs = [n for n, _ in corpus_pipeline.STAGES], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        outs.append(written(stage(spark, docs if not k else outs[-1], sf), f"test-{k}"))
    assert len(names) == 5
    assert all(o.columns == docs.columns for o in outs[:-1])
    first, second, third, fourth = ([tuple(r) for r in o.collect()] for o in outs[:4])
    start = {tuple(r) for r in docs.collect()}
    assert set(first) <= start and len(first) >= 0.9 * sum(bool(re.search(r"[^\W\d_]{3}", r[1] or "")) for r in start)
    kept = near_truth(first)
    assert key(second) == key(r for r in first if r[0] in kept)
    cut = {r[0]: r for r in passage_truth(second, 100)}
    assert {r[0]: hashlib.sha256(r[1].encode()).hexdigest() for r in third}.items() <= {i: r[4] for i, r in cut.items()}.items()
    assert all(r[4] == len(r[1]) for r in third)
    gone = {r[0] for r in second} - {r[0] for r in third}
    assert all(cut[i][2] > 0 for i in gone)
    size = lambda rows: sum(len(WORD.findall(r[1] or "")) for r in rows)
    times = Counter(r[0] for r in fourth)
    assert set(fourth) <= set(third) and max(times.values()) <= 3
    assert 0.7 * size(third) <= size(fourth) <= 1.3 * size(third)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    expected = []
    for r in fourth:
        ids = coder.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert key(map(tuple, outs[4].collect())) == key(expected)


def test_stages_take_odd_tables(spark, docs, empty):
    for df in (docs.drop("copy", "_text"), empty.drop("copy", "_text")):
        for _, stage in corpus_pipeline.STAGES:
            df = written(stage(spark, df, ""), "odd")
        assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_each_source_gets_its_words_whatever_its_ratio(spark):
    rows = [(k, " ".join(["w"] * (100 + k * 7919 % 700)), "a" if k % 3 == 0 else "bcdef"[k % 5]) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sizes, got = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    out = [tuple(r) for r in corpus_pipeline.mixture(spark, docs, "").collect()]
    for _, t, s in out:
        got[s] += len(t.split())
    targets = targets_of(sizes)
    assert min(t / sizes[s] for s, t in targets.items()) < 0.4
    assert max(Counter(r[0] for r in out).values()) <= 3
    for s, t in targets.items():
        assert abs(got[s] - t) <= 0.1 * t


def near_truth(rows):
    """The smallest ids of groups linked by SimHash (five words, four bits) or by an exact similarity of 0.8."""
    held, groups = {}, defaultdict(set)
    for r in rows:
        words = [w.decode() for w in (r[1] or "").encode().lower().split()]
        held[r[0]] = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        for g in held[r[0]]:
            groups[g].add(r[0])
    root = {i: i for i in held}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(i, j):
        low, high = sorted((top(i), top(j)))
        root[high] = low

    for i, own in held.items():
        for j, n in Counter(j for g in own for j in groups[g] if j < i).items():
            if n >= 0.8 * (len(own) + len(held[j]) - n) - 1e-9:
                join(i, j)
    for i, _, c in simhash_truth(rows, width=5):
        join(i, c)
    return {i for i in held if top(i) == i}


def test_near_duplicates_are_those_of_similarity_point_eight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(10**6 + k, " ".join(f"x{k // 40}y{j}" if j % 97 != k % 40 else f"z{k}" for j in range(400)), "en", "s", 0) for k in range(80)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = near_truth([tuple(r) for r in docs.collect()])
    assert sum(i >= 10**6 for i in kept) < 80
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == kept


def test_a_forest_connects_what_is_similar():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    found = [np.unique(np.concatenate([base[k * 20 : k * 20 + 200], base[:1]])) for k in range(6)] + [rng.integers(0, 1 << 63, 50, dtype=np.uint64)]
    a, b = shingles.forest(found, 0.8)
    assert len(a) == 5 and {*a, *b} == set(range(6))


def test_run_deletes_what_is_used(spark, tmp_path):
    """One stage's documents stay for the last stage, which is read lazily; so do that stage's own tables and those of others."""
    from tidewheel.llm import common

    other = written(spark.range(3), "other")
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    folder = common.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    left = [x for x in os.listdir(folder) if re.match(r"tidewheel-stage-\d", x)]
    assert len(left) == 1 and left[0].startswith("tidewheel-stage-3")
    assert found.count() > 0 and other.count() == 3
