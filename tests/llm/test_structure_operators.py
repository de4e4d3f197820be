"""WARC, SimHash, neighbours, repeated passages, mixing, sharding and the pipeline against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tidewheel.llm import ann, mixing, passages, rindex, sharding, simhash, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# -- WARC --------------------------------------------------------------------------------------------

PAGES = [(1, "u", "a" * 200), (2, "u", "a" * 200), (3, None, "é" * 60), (4, "v\r\nx", "é" * 60), (5, "v", None), (6, "v", None), (7, "w", ""), (8, "w", "short"), (9, "w", "short"), (10, "x", "<p>" + "long " * 400_000), (11, "x", "a" * 99), (12, "x", "a" * 99), (2, "u", "a" * 200), (None, "n", "a" * 200), (None, "n", "b" * 150), (1, "again", "a" * 200)]


def warc_truth(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        revisit = len(b) >= 100 and html in first and i != first[html]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None))
    return out


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 5) for r in PAGES], "page_id long, url string, html string, payload int").repartition(3)
    got = warc.archived(pages, str(tmp_path / "w")).collect()
    assert key(map(tuple, got)) == key(warc_truth(PAGES))
    assert warc.archived(pages.where("page_id = 0")).count() == 0


def test_warc_files_hold_a_dictionary_and_single_frames(spark, tmp_path):
    warc.archived(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), str(tmp_path / "w")).count()
    files = sorted((tmp_path / "w").glob("*.warc.zst"))
    raw = files[0].read_bytes()
    assert raw[:4] == b"\x5d\x2a\x4d\x18"
    n = int.from_bytes(raw[4:8], "little")
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n]))
    one = coder.decompressobj().decompress(raw[8 + n :])
    assert one.startswith(b"WARC/1.1\r\n") and one.count(b"WARC/1.1\r\n") == 1


def test_warc_attempts_do_not_meet(spark, tmp_path):
    folder = str(tmp_path / "w")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    records = warc.marked(pages)
    warc.write_archives(records, b"", folder).count()  # an attempt whose list is lost
    warc.write_archives(records, b"", folder).write.parquet(f"{folder}-files")
    files = spark.read.parquet(f"{folder}-files")
    assert warc.read_archives(files, folder).count() == pages.count()
    assert warc.without_strays(files, folder) > 0
    assert len(list((tmp_path / "w").glob("*.zst"))) == files.count()
    assert warc.read_archives(files, folder).count() == pages.count()


def test_warc_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    expected = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.OP1_SQL})").fetchall()
    assert key(map(tuple, warc.op1_dictionary_warc(spark, sf_dir).collect())) == key(expected)


# -- SimHash -----------------------------------------------------------------------------------------


def simhash_of(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def components_of(codes, radius):
    root = {c: c for c in codes}

    def top(c):
        while root[c] != c:
            c = root[c]
        return c

    known = list(root)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= radius:
                root[top(a)] = top(b)
    return {c: top(c) for c in known}


def simhash_truth(rows, width=4, radius=4):
    codes = [simhash_of(r[1], width) for r in rows]
    root = components_of(codes, radius)
    least = {}
    for r, c in zip(rows, codes):
        if r[0] is not None:
            least[root[c]] = min(r[0], least.get(root[c], r[0]))
    return [(r[0], f"{c:016x}", least.get(root[c])) for r, c in zip(rows, codes)]


def shown(df):
    return [(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in df.collect()]


def test_simhash(docs, raw, empty):
    assert key(shown(simhash.near_duplicates(docs))) == key(simhash_truth(raw))
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = simhash.op2_vantage_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()
    assert key(map(tuple, got)) == key(simhash_truth(rows))


def clustered_codes(rng):
    codes = set()
    for c in rng.integers(0, 1 << 63, 60, dtype=np.uint64).tolist():
        codes.add(c)
        for _ in range(6):
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                c ^= 1 << b
            codes.add(c)
    return codes


@pytest.mark.parametrize(("blocks", "levels", "most"), [(3, None, 10_000), (3, 6, 10_000), (2, 4, 10_000), (1, 2, 10_000), (3, 1, 60)])
def test_simhash_shards_lose_no_link(spark, blocks, levels, most):
    codes = clustered_codes(np.random.default_rng(blocks))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(c),) for c in codes], "fp long")
    edges = simhash.links(nodes, len(codes), 4, blocks, levels, most)
    found = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in simhash.components(edges).collect()}
    want = components_of(codes, 4)
    assert all(want[a & (1 << 64) - 1] == want[b & (1 << 64) - 1] for a, b in edges.collect())
    groups = lambda of: {frozenset(c for c in codes if of(c) == r) for r in {of(c) for c in codes}}
    assert groups(lambda c: found.get(c, c)) == groups(want.get)


def test_simhash_queries_visit_shards_across_boundaries(spark):
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    levels = simhash.depth(250_000)
    assert levels >= 4 and simhash.depth(15_000_000) > levels
    at = simhash.sharded(spark.createDataFrame([(int(c),) for c in codes], "fp long"), levels).toPandas()
    assert (at.groupby("fp")["home"].sum() == simhash.BLOCKS).all()  # one home in every tree
    assert 0.5 < len(at) / (len(codes) * simhash.BLOCKS * 1.17**levels) < 1.5 and (~at["home"]).sum() > len(codes)
    near = [(int(c), int(c) ^ 1 << int(b)) for c, b in zip(codes[:300], rng.integers(0, 60, 300))]
    for tree, mask in enumerate(simhash.masks()):
        for x, y in near:
            rows, path, _ = simhash.descended(np.array([x, y], np.uint64), tree, mask, levels, 1)
            assert {*path[rows == 0].tolist()} & {*path[rows == 1].tolist()}  # they meet, also where a boundary lies between them


def test_a_round_of_components_shuffles_four_times(spark, monkeypatch):
    """Every task of a round costs the driver memory: it holds the task's metrics."""
    made, keep = [], simhash.written

    def counted(df, what):
        made.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return keep(df, what)

    monkeypatch.setattr(simhash, "written", counted)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    edges = [(5, 1), (1, 5), (5, 5), (7, 5), (7, 6), (6, 2), (-3, 90), (90, 91), (90, 92), (4, 4), *((1000, 1001 + k) for k in range(50)), *((3000, 2900 + k) for k in range(50))]
    try:
        got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert max(made[1:]) <= 4
    want = {5: 1, 7: 1, 6: 1, 2: 1, 90: -3, 91: -3, 92: -3} | {1001 + k: 1000 for k in range(50)} | {x: 2900 for x in (*range(2901, 2950), 3000)}
    assert {k: v for k, v in got.items() if k != v} == want
    assert simhash.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_components_that_have_not_settled_raise(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        simhash.components(edges, most_rounds=1)


# -- nearest neighbours ------------------------------------------------------------------------------


def near_truth(rows, every, k):
    live = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = defaultdict(dict)
    with np.errstate(over="ignore"):
        for q, v in live:
            for i, w in live:
                if q % every == 0 and i != q and len(w) == len(v):
                    near[q][i] = min(float(np.sqrt(np.square(np.array(v, float) - np.array(w, float)).sum())), near[q].get(i, np.inf))
    return [(q, r, i, d) for q, own in near.items() for r, (d, i) in enumerate(sorted((d, i) for i, d in own.items())[:k], 1)]


@pytest.mark.parametrize("sizes", [{"shard_rows": 100, "query_rows": 20}, {"shard_rows": 30, "group_queries": 9}, {}])
def test_neighbours_are_exact_with_factor_one(spark, sizes):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(30)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] + [1.0] * 7), (503, [None] + [1.0] * 7), (504, [float("inf")] + [1.0] * 7), (510, [1.0] * 3), (520, [2.0] * 3), (None, [1.0] * 8), rows[0]]
    rows += [(10, rng.normal(size=8).tolist()), (7, rng.normal(size=8).tolist()), (7, rows[20][1]), (600, [1e200] * 2), (610, [-1e200] * 2), (620, [3e199, 1.0]), (601, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, v int")
    got = ann.nearest(df, every=10, factor=1.0, **sizes).collect()
    assert [(*r[:3], round(r[3], 9)) for r in sorted(map(tuple, got))] == [(*r[:3], round(r[3], 9)) for r in sorted(near_truth(rows, 10, 10))]
    assert ann.nearest(df.where("vec_id < 0")).count() == 0


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    truth = {(q, i): d for q, _, i, d in near_truth(rows, 100, 10)}
    got = ann.op5_vantage_ann(spark, sf).collect()
    assert len(got) == len(truth)
    assert sum((r["query_id"], r["vec_id"]) in truth for r in got) >= 0.9 * len(truth)
    assert all(abs(truth[r["query_id"], r["vec_id"]] - r["score"]) < 1e-9 for r in got if (r["query_id"], r["vec_id"]) in truth)


@pytest.mark.parametrize("rank", [64, 8])
def test_neighbours_recall_on_fifty_thousand_rows(spark, tmp_path, rank):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(rank)
    x = rng.normal(size=(50_000, rank)) @ (np.eye(64) if rank == 64 else rng.normal(size=(rank, 64)))
    pq.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": pa.FixedSizeListArray.from_arrays(x.reshape(-1), 64).cast(pa.list_(pa.float64()))}), tmp_path / "v.parquet")
    got = ann.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), every=500).collect()
    squares = np.square(x).sum(axis=1)
    hits = defaultdict(set)
    for r in got:
        hits[r["query_id"]].add(r["vec_id"])
    recall = []
    for q in range(0, 50_000, 500):
        d = squares - 2 * x @ x[q]
        d[q] = np.inf
        recall.append(len(hits[q] & {*np.argpartition(d, 10)[:10].tolist()}) / 10)
    assert np.mean(recall) >= 0.95 and len(got) == 1000


def test_visits_are_streamed_past_one_tree_a_shard(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    built = []

    class Counted(ann.VantageTree):
        def __init__(self, vectors, ids):
            built.append(len(ids))
            super().__init__(vectors, ids)

    monkeypatch.setattr(ann, "VantageTree", Counted)
    # shard 0: rows 0-39, then visits; shard 1: visits alone; shard 2: rows alone; shard 3: rows 40-79, then visits
    plan = [(0, False, range(40)), (0, True, range(90)), (1, True, range(5)), (2, False, range(80, 90)), (3, False, range(40, 80)), (3, True, range(90))]
    rows = [(4, leaf, 0, 0, asks, i, x[i].tolist()) for leaf, asks, ids in plan for i in ids]
    schema = pa.schema([("length", pa.int32()), ("leaf", pa.int64()), ("part", pa.int64()), ("copy", pa.int64()), ("asks", pa.bool_()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])
    batches = [pa.RecordBatch.from_pydict({n: [r[j] for r in rows[a : a + 7]] for j, n in enumerate(schema.names)}, schema=schema) for a in range(0, len(rows), 7)]
    got = defaultdict(set)
    for b in ann.streamed(iter(batches), 3, 1.0, 4):
        for r in b.to_pylist():
            got[r["query_id"]].add((r["vec_id"], round(r["score"], 9)))
    assert built == [40, 40]
    for q in range(90):
        want = set()
        for shard in (range(40), range(40, 80)):
            want |= {(i, round(d, 9)) for d, i in sorted((float(np.sqrt(np.square(x[q] - x[i]).sum())), i) for i in shard if i != q)[:3]}
        assert got[q] == want


def test_coarse_bounds_skip_no_neighbour():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 3))
    coarse = ann.Coarse(x[::3], np.arange(0, 3000, 3), 16)
    leaf = coarse.leaf_of(x)
    at, to = coarse.visits(x[:100], np.arange(100), 10, 1.0)
    assert coarse.leaves == 16 and len(at) < 100 * 16
    for q in range(100):
        d = ann.distances(x[q][None, :], x)[0]
        d[q] = np.inf
        assert {*leaf[np.argsort(d)[:10]].tolist()} <= {*to[at == q].tolist()}


def test_a_larger_factor_searches_less():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    tree = ann.VantageTree(x, np.arange(3000))
    exact = tree.search(x[:50], np.arange(50), 10, 1.0)[1]
    rough = tree.search(x[:50], np.arange(50), 10, 8.0)[1]
    assert exact.tolist() == [[j for _, j in sorted((float(d), j) for j, d in enumerate(ann.distances(x[i][None, :], x)[0]) if j != i)[:10]] for i in range(50)]
    assert 0.3 < np.mean([len({*a} & {*b}) / 10 for a, b in zip(exact.tolist(), rough.tolist())]) <= 1


# -- repeated passages -------------------------------------------------------------------------------


def passage_truth(rows, length, with_text=False):
    """Rows with equal ids and texts are one document; those of one id, or of none, with different texts are in the order of the texts' hashes."""
    several = {i for i, n in Counter(r[0] for r in rows).items() if n > 1 or i is None}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    place = lambda r: (r[0] is None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)) if several else 0)
    first = {}
    for r in sorted(rows, key=place):
        b = (r[1] or "").encode()
        for a in range(len(b) - length + 1):
            first.setdefault(b[a : a + length], (*place(r), a))
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < (*place(r), a):
                gone[a : a + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        out.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), *[kept.decode(errors="ignore")] * with_text))
    return out


SETTINGS = [{}, {"shard_bytes": 3000}, {"most_runs": 1}, {"most_runs": 3, "often": 0.0}]


@pytest.mark.parametrize("settings", SETTINGS)
def test_passages_of_odd_tables(spark, docs, raw, empty, settings):
    assert passages.without_repeats(empty).count() == 0
    assert key(map(tuple, passages.without_repeats(docs, **settings).collect())) == key(passage_truth(raw, 100))
    rng = np.random.default_rng(12)
    fresh = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    shared, own = fresh(300), [fresh(400) for _ in range(8)]
    rows = [(1, shared), (None, shared + own[0]), (None, own[1]), (None, own[2][:250] + shared[:150]), (None, own[2][:250]), (7, own[3]), (7, own[4] + shared), (7, own[5]), (7, own[3]), (8, own[5] + own[6]), (8, own[5] + own[6]), ((1 << 63) - 1, own[7])]
    got = passages.without_repeats(spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, doc int"), **settings).collect()
    assert key(map(tuple, got)) == key(passage_truth(rows, 100))
    kept = [r["n_removed"] for r in got if r["doc_id"] == (1 << 63) - 1] + [r["n_removed"] for r in got if r["doc_id"] == 1] + [r["n_removed"] for r in got if r["doc_id"] is None and r["n_bytes"] == 400 and r["n_removed"] != 150]
    assert not any(kept)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_passages_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert key(map(tuple, passages.op8_run_length_passages(spark, f"/root/testdata/{sf}").collect())) == key(passage_truth(rows, 100))


def test_large_groups_are_dealt_until_they_are_small(spark, docs):
    texts = passages.keyed(docs.where("doc_id between 100 and 103 or doc_id = 141"), "doc_id", "text")[0].select("doc", "tie", F.col("_text").alias("text"))
    rows = passages.cut_out(passages.packed_texts(texts), passages.all_runs(texts, 100, np.empty(0, np.int64)), 100)
    further, _ = passages.dealt_further(rows, 100, 1)
    assert further.groupBy("anchor").count().where("count > 1").isEmpty()


def random_texts(rng, n, letters, longest):
    return [bytes(rng.integers(97, 97 + letters, rng.integers(0, longest)).astype(np.uint8)) for _ in range(n)]


def test_matching_lengths_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        letters, most = int(rng.integers(2, 5)), int(rng.integers(3, 45))
        texts, others = random_texts(rng, 4, letters, 40), random_texts(rng, 3, letters, 40)
        block, of = rng.integers(0, 2, 4), rng.integers(0, 2, 3)
        index = rindex.RunIndex(texts, block)
        got, where = index.matching_lengths(others, of, most)
        want = [max([m for m in range(len(t) - i + 1) if any(t[i : i + m] in x for x, b in zip(texts, block) if b == own)], default=0) for t, own in zip(others, of) for i in range(len(t))]
        assert got.tolist() == [min(m, most) for m in want]
        flat = b"".join(others)
        assert all(index.text[w : w + m].tobytes()[:1] == flat[k : k + 1] for k, (m, w) in enumerate(zip(got.tolist(), where.tolist())) if m)


def test_seen_before_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(60):
        texts = random_texts(rng, 11, 3, 30)
        group, order = rng.integers(0, 2, 11), rng.permutation(11)
        number, start, windows = rindex.seen_before(texts, group, (order,), 5)
        got = {(k, a + j) for k, a, w in zip(number.tolist(), start.tolist(), windows.tolist()) for j in range(w)}
        assert got == {(k, a) for k, t in enumerate(texts) for a in range(len(t) - 4) if any(t[a : a + 5] in texts[m] for m in range(11) if group[m] == group[k] and order[m] < order[k])}


def test_an_index_keeps_as_much_as_its_runs():
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 101, 2000).astype(np.uint8))
    kept = lambda index: sum(v.nbytes for k, v in vars(index).items() if isinstance(v, np.ndarray) and k != "text")
    one, many = (rindex.RunIndex([text] * n, np.zeros(n, np.int64)) for n in (1, 40))
    assert many.n > 39 * one.n and many.runs <= 1.1 * one.runs and kept(many) <= 1.1 * kept(one)


# -- mixing ------------------------------------------------------------------------------------------


def targets_of(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    full, rest, out = set(), float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in order if s not in full]
        out = {s: float(most * sizes[s]) for s in full} | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if out[s] > most * sizes[s]]
        if not over:
            return out
        full |= set(over)
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)


def check_mix(got, rows):
    size = lambda r: len(WORD.findall(r[1] or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r)
    targets = targets_of(sizes)
    assert key((r["doc_id"], r["size"], r["source_size"], r["source"]) for r in got) == key((r[0], size(r), sizes[r[3]], r[3]) for r in rows)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():  # half a slot, and the last block of each pass may be short
        assert abs(taken[s] - t) <= max(0.01 * t, 4 * min(mixing.BLOCK_WORDS, max(1, sizes[s] // mixing.LEAST_BLOCKS)))


def test_mixing(docs, raw, empty):
    got = mixing.mix(docs).collect()
    check_mix(got, raw)
    assert key(map(tuple, got)) == key(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty).count() == 0


def test_mixing_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"], None, r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_mix(mixing.op9_block_mixture(spark, sf).collect(), rows)


TIED = [{f"s{k:02}": 1000 for k in range(n)} for n in (2, 3, 6, 7, 12, 60)] + [{f"s{k}": n for k, n in enumerate([1000, 900, 1000, 900, 800, 1000])}, {None: 30, **{f"s{k:02}": 30 for k in range(59)}}]


@pytest.mark.parametrize("sizes", [*TIED, {"a": 10, "b": 1000, "c": 1}, {"a": 5, "b": 5, "c": 5, "d": 5, None: 900}, {"x": 7}, {"x": 0, "y": 4}])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = targets_of(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == want


@pytest.mark.parametrize("n_blocks", [1, 2, 3, 5, 7, 50, 1000])
def test_mix_permutation_visits_each_block_once_a_pass(spark, n_blocks):
    n_slots = n_blocks * 2 + n_blocks // 2
    words = 1 if n_blocks < 64 else 64
    sources = spark.createDataFrame([("a", words * n_blocks, 1, 1.0 * words * n_slots, 1)], "source string, source_size long, weight int, target double, src int")
    rows = mixing.slots(sources).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(n_slots)) and max(Counter((r["pass_no"], r["block"]) for r in rows).values()) == 1
    assert all(0 <= r["block"] < n_blocks for r in rows)
    if n_blocks == 1000:
        first = [r["block"] for r in rows if r["pass_no"] == 0]
        assert first != [r["block"] for r in rows if r["pass_no"] == 1]
        assert max(Counter((y - x) % 1000 for x, y in zip(first, first[1:])).values()) < 12  # no fixed stride


def test_mix_counts_by_output_shard(spark):
    sources = spark.createDataFrame([("a", 64 * 4000, 1, 64.0 * 4000, 1), ("b", 10, 2, 20.0, 2)], "source string, source_size long, weight int, target double, src int")
    counts = {(r["src"], r["shard"]): r["n"] for r in mixing.shard_counts(sources).collect()}
    assert sum(n for (s, _), n in counts.items() if s == 1) == 4000 and sum(n for (s, _), n in counts.items() if s == 2) == 20
    own = [counts.get((1, s), 0) for s in range(16)]
    assert 0.2 < np.var(own) / (4000 / 16 * 15 / 16) < 3  # of a multinomial law, not even shares
    assert counts == Counter((r["src"], r["shard"]) for r in mixing.slots(sources).collect())


def test_small_and_tied_sources(spark):
    """Six equal sources, and sources of few words that are taken less than half."""
    rows = [(100 * k + j, " ".join(["w"] * 100), None, f"s{k}") for k in range(6) for j in range(10)]
    check_mix(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect(), rows)
    rows = [(1, "a b c", None, "a"), (2, "d e f g", None, "a"), (3, " ".join("xyz" * 20), None, "b"), (4, " ".join("xyz" * 30), None, "c")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    check_mix(got, rows)
    assert sum(r["taken"] for r in got if r["source"] == "a") > 0


def test_the_mix_has_the_words_that_are_taken(docs):
    taken, size = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
        size[r["doc_id"]] += r["size"]
    words = Counter()
    for r in mixing.assembled(docs).collect():
        words[r["doc_id"]] += r["words"]
        assert r["first_word"] >= 0 and r["words"] <= mixing.BLOCK_WORDS and r["first_word"] + r["words"] <= size[r["doc_id"]]
    assert +taken == words


# -- sharding ----------------------------------------------------------------------------------------


def sharding_law(got, rows, shards=8, slack=200):
    expected = [(r[0], len((r[1] or "").encode()) + 1, None if r[1] is None else zlib.crc32(r[1].encode())) for r in rows]
    assert key((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == key(expected)
    slots, load = defaultdict(list), Counter({s: 0 for s in range(shards)})
    for r in got:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= max([slack, *(e[1] for e in expected)])


@pytest.mark.parametrize("bucket_rows", [sharding.BUCKET_ROWS, 50])
def test_sharding(spark, docs, raw, empty, bucket_rows):
    sharding_law(sharding.shard(docs, bucket_rows=bucket_rows).collect(), raw)
    rows = [(k, "x" * 10) for k in range(200)] + [(7, "y" * 15)] * 2800 + [(None, None)] * 9000
    sharding_law(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=bucket_rows).collect(), rows)
    assert sharding.shard(empty).count() == 0


def test_shards_are_even(spark):
    got = sharding.op10_fixed_virtual_slots(spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.01 * max(sizes)


def test_a_stored_map_is_loaded_and_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    sharding.add_version(spark, path, 1, sharding.first_map(64, 4))
    rows = [(k, "x" * (k * 37 % 200)) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = {r["doc_id"]: r["shard"] for r in sharding.shard(df, 4, 64, map_path=path).collect()}
    assert sharding.last_version(spark, path)[0] == 2
    again = {r["doc_id"]: r["shard"] for r in sharding.shard(df, 4, 64, map_path=path).collect()}
    assert again == before and sharding.last_version(spark, path)[0] == 2  # nothing to edit, no new version
    grown = spark.createDataFrame(rows + [(5000 + k, "y" * 90) for k in range(300)], "doc_id long, text string")
    after = {r["doc_id"]: r["shard"] for r in sharding.shard(grown, 4, 64, map_path=path).collect()}
    assert sharding.last_version(spark, path)[0] == 3
    assert 0 < sum(after[i] != s for i, s in before.items()) < 0.2 * len(before)


def test_slot_maps_are_edited_until_no_move_helps():
    # no move helps: 6 + 6 and 4 + 4 differ by less than any slot; a swap makes them equal
    assert sharding.rebalanced([0, 0, 1, 1], [6, 6, 4, 4], 2) in ([0, 1, 0, 1], [0, 1, 1, 0], [1, 0, 0, 1], [1, 0, 1, 0])
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(1, 4000, 60).tolist()
        even = sharding.rebalanced(sharding.first_map(60, 5), sizes, 5)
        load = np.bincount(even, weights=sizes, minlength=5)
        assert load.max() - load.min() <= 0.02 * load.mean() and sharding.rebalanced(even, sizes, 5) == even
    assert sharding.rebalanced([0, 1, 2, 3], [5, 5, 5, 5], 2) in ([0, 1, 0, 1], [0, 1, 1, 0])
    even = sharding.rebalanced(sharding.first_map(16, 4), [9] * 4 + [1] * 12, 4)
    load = Counter()
    for v, s in enumerate(even):
        load[s] += ([9] * 4 + [1] * 12)[v]
    assert {*load.values()} == {12}
