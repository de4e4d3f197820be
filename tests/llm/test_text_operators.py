"""Language ID, language-model scores, quality rules and byte-level BPE against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidewheel.llm import attention, bpe, langid, lmscore, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def left(doc_id, mod):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def test_language_id(docs, raw, empty):
    got = langid.identify(docs).collect()
    assert len(got) == len(raw)
    truth = {r[0]: r for r in raw}
    for r in got:
        text = truth[r["doc_id"]][1] if r["doc_id"] is not None else "some"
        assert r["held_out"] == (left(r["doc_id"], 5) == 0)
        assert 0 <= r["score"] <= 1
        if not any(map(str.isalpha, text or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    real = [r for r in got if r["doc_id"] is not None and (r["doc_id"] < 60 or 100 <= r["doc_id"] < 112)]
    assert sum(r["lang_pred"] == truth[r["doc_id"]][2] for r in real) >= 0.97 * len(real)
    assert langid.identify(empty).count() == 0


def language_truth(raw):
    """Every count and score anew, in plain Python."""
    letters = lambda text: "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    own = [r for r in raw if left(r[0], 5) != 0 and r[1] is not None and r[2] is not None]
    langs = sorted({r[2] for r in own}, key=str.encode)
    shares = Counter(r[2] for r in own)
    words = {g: Counter() for g in langs}
    for g, _, text in {(r[2], r[0], r[1]) for r in own}:
        words[g].update(letters(text))
    grams = {n: {g: Counter() for g in langs} for n in range(1, 5)}
    for g, counts in words.items():
        for w, c in counts.items():
            marked = f" {w} "
            for n in range(1, 5):
                for k in range(len(marked) - n + 1):
                    if marked[k : k + n].strip():
                        grams[n][g][marked[k : k + n]] += c

    def log_of(table, key):
        kinds = len(set().union(*table.values()))
        return [math.log((table[g][key] + 0.5) / (sum(table[g].values()) + 0.5 * kinds)) for g in langs]

    def of_word(w):
        if any(w in words[g] for g in langs):
            return log_of(words, w)
        marked = f" {w} "
        for n in range(min(4, len(marked)), 0, -1):
            found = [x for k in range(len(marked) - n + 1) if any((x := marked[k : k + n]) in grams[n][g] for g in langs)]
            if found:
                return [sum(col) / len(found) for col in zip(*(log_of(grams[n], x) for x in found))]
        return [0.0] * len(langs)

    prior = [math.log((shares[g] + 1) / (len(own) + len(langs))) for g in langs]
    known, out = {}, []
    for r in raw:
        found = letters(r[1])
        if not found:
            out.append((r[0], left(r[0], 5) == 0, "und", 0.0))
            continue
        total = list(prior)
        for w, c in Counter(found).items():
            known[w] = known.get(w) or of_word(w)
            total = [t + c * x for t, x in zip(total, known[w])]
        best = max(total)
        out.append((r[0], left(r[0], 5) == 0, langs[total.index(best)], 1 / sum(math.exp(max(t - best, -700)) for t in total)))
    return out


def test_language_id_equals_brute_force(docs, raw):
    shown = lambda rows: key((i, h, g, round(s, 6)) for i, h, g, s in rows)
    assert shown(map(tuple, langid.identify(docs).collect())) == shown(language_truth(raw))


def test_numbers_are_no_letters(spark, docs):
    assert langid.letters("a² ½Ⅷb x_y9") == ["a", "b", "x", "y"]
    odd = spark.createDataFrame([(5, "² ½", "aa"), (6, "Ⅷ ٣", "aa"), (7, "ª x", "aa")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs.select("doc_id", "text", "lang").where("doc_id > 7").unionByName(odd)).collect()}
    assert got[5] == got[6] == "und" and got[7] != "und"


def test_rare_languages_are_learned_from_whole(spark):
    rows = [(k, f"w{k}", "big") for k in range(6000)] + [(k, f"v{k}", "small") for k in range(3)]
    found, counts = langid.chosen(spark.createDataFrame(rows, "seed long, text string, lang string"), 100)
    n = Counter(r["lang"] for r in found.collect())
    assert counts == {"big": 6000, "small": 3} and n["small"] == 3 and 50 < n["big"] < 200


def test_language_id_never_looks_at_held_out_labels(spark, docs):
    from pyspark.sql import functions as F

    hidden = docs.withColumn("lang", F.when(~langid.held_out(F.col("doc_id"), 5, 0, True), F.col("lang")))
    same = lambda df: key([tuple(r) for r in langid.identify(df).collect()])
    assert same(docs) == same(hidden.withColumn("source", F.lit("other")))
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_backs_off():
    model = langid.Model(["a", "b"], np.zeros(2), {"known": 0}, np.array([[-1.0, -2.0]]), {"kno": 0, "k": 1, "z": 2}, np.array([[-3.0, -4.0], [-5.0, -6.0], [-8.0, -7.0]]))
    assert model.of_word("known").tolist() == [-1, -2]
    assert model.of_word("knot").tolist() == [-3, -4]
    assert model.of_word("zk").tolist() == [-6.5, -6.5]
    assert model.of_word("xy") is None


def test_scores_count_like_brute_force(docs, raw, empty):
    got = lmscore.score(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(raw)
    counts, n, trained = Counter(), 0, 0
    for r in raw:
        if left(r[0], 7) != 2:
            words = WORD.findall(low(r[1]))
            counts.update(words)
            n += len(words) + 1
            trained += 1
    v = len(counts) + 1
    expected = []
    for r in raw:
        words = WORD.findall(low(r[1]))
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((trained + 1) / (n + v + 1))
        expected.append((r[0], left(r[0], 7) == 2, len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n, round(base, 6)))
    assert key([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]) == key(expected)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert len({round(r["score"], 6) for r in got if r["doc_id"] in (110, 112)}) == 1
    assert lmscore.score(empty, PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_the_registered_model_is_better_than_words_alone(spark, monkeypatch, sf):
    """At the registered setting, over all held-out texts."""
    total = lambda df: df.where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    trained, base = total(lmscore.op4_attention_score(spark, f"/root/testdata/{sf}"))
    print(sf, trained, base)
    monkeypatch.setattr(lmscore, "ROUNDS", [])
    untrained, _ = total(lmscore.op4_attention_score(spark, f"/root/testdata/{sf}"))
    assert trained > base and trained > 0.8 * untrained


def test_training_grows_with_the_corpus():
    trained = [n * lmscore.share_for(n) for n in [0, *(int(1.3**k) for k in range(10, 120))]]
    assert all(b >= a * (1 - 1e-12) for a, b in zip(trained, trained[1:])) and trained[20] == int(1.3**29) and trained[-1] == int(1.3**119) * lmscore.LEAST_SHARE


def test_training_windows_are_the_share_asked_for(spark):
    rng = np.random.default_rng(3)
    docs = [(int(k), False, lmscore.packed(rng.integers(0, 4000, int(n)).astype(np.uint16))) for k, n in enumerate(rng.integers(1, 3000, 300))]
    df = spark.createDataFrame(docs, "doc_id long, held_out boolean, slots binary")
    sizes = [len(lmscore.unpacked(d[2], np.uint16)) for d in docs]
    windows = sum(-(-n // attention.STRIDE) for n in sizes)
    for share in (1.0, 0.37, 0.04):
        rows = lmscore.training_windows(df, share, 5).collect()
        count = {s: sum(len(lmscore.unpacked(r["inputs"], np.int16)) // attention.WINDOW for r in rows if r["shard"] == s) for s in range(5)}
        assert abs(sum(count.values()) - share * windows) <= 3 * (windows * share * (1 - share)) ** 0.5
        assert min(count.values()) > 0.7 * max(count.values())
    goals = sum(int((lmscore.unpacked(r["targets"], np.int16) >= 0).sum()) for r in lmscore.training_windows(df, 1.0, 5).collect())
    assert goals == sum(sizes)  # all windows have every token once


@pytest.mark.parametrize("tasks", [1, 40])
def test_every_training_token_is_learned_from(spark, tasks):
    assert all(lmscore.share_for(n) == 1 for n in (0, 1000, 10**8, 10**12))
    rng = np.random.default_rng(6)
    docs = [(k, k % 7 == 2, lmscore.packed(rng.integers(0, 4000, int(n)).astype(np.uint16))) for k, n in enumerate(rng.integers(1, 900, 120))]
    df = spark.createDataFrame(docs, "doc_id long, held_out boolean, slots binary").repartition(tasks)
    weights = attention.first_weights(attention.Ranks(np.ones(5000)))
    sums = lmscore.weighed(lmscore._seeded(df), lambda batches: lmscore._dealt(batches, 1.0, 3), weights, 1, 2, (0.01, 0.001), 2000)
    # a shard that trains alone sees each of its tokens as often as there are passes
    assert sum(r["seen"] for r in sums.collect()) == 2 * sum(len(lmscore.unpacked(x, np.uint16)) for _, out, x in docs if not out)
    became = lmscore.averaged(sums, tasks, weights)
    assert all(np.isfinite(w).all() and w.shape == weights[k].shape for k, w in became.items()) and not np.array_equal(became["E"], weights["E"])


def test_training_is_spread_evenly_over_tasks(spark):
    rng = np.random.default_rng(8)
    docs = [(k, k % 7 == 2, lmscore.packed(rng.integers(0, 4000, int(n)).astype(np.uint16))) for k, n in enumerate(rng.integers(50, 150, 3000))]
    cores = spark.sparkContext.defaultParallelism
    # as blocks are: one more than cores, the first with half of all documents
    parts = spark.sparkContext.parallelize(range(cores + 1), cores + 1).flatMap(lambda k: docs[:1500] if k == 0 else docs[1500 + k - 1 :: cores])
    df = spark.createDataFrame(parts, "doc_id long, held_out boolean, slots binary")
    rows, tasks = lmscore.spread(df, 10_000)
    sizes = [sum(len(lmscore.unpacked(r["slots"], np.uint16)) for r in part) for part in rows.rdd.glom().collect()]
    assert len(sizes) == tasks == 2 * cores and max(sizes) < 1.5 * sum(sizes) / len(sizes)
    assert sum(sizes) == sum(len(lmscore.unpacked(x, np.uint16)) for _, out, x in docs if not out)
    assert lmscore.spread(df, 1)[0].rdd.getNumPartitions() == 1
    assert lmscore.spread(df, cores)[1] == cores
    many = df.repartition(4 * cores)
    assert lmscore.spread(many, 10_000)[1] == 4 * cores and "Exchange" not in lmscore.spread(many.sparkSession.range(0, 9, 1, 4 * cores).selectExpr("id doc_id", "false held_out", "binary('') slots"), 10_000)[0]._jdf.queryExecution().toString()


def test_training_is_adam_by_the_gradients_and_only_of_weights_that_are_read():
    rng = np.random.default_rng(12)
    ranks = attention.Ranks(rng.integers(0, 50, 6000).astype(float))
    first = {k: (v + rng.normal(0, 0.05, v.shape)).astype(np.float32) for k, v in attention.first_weights(ranks).items()}
    inputs, targets, starts, _ = attention.laid_out([rng.integers(0, attention.KNOWN + 1, int(n)).astype(np.int32) for n in rng.integers(1, 300, 60)])
    x = np.lib.stride_tricks.sliding_window_view(inputs, attention.WINDOW)[starts]
    y = np.lib.stride_tricks.sliding_window_view(targets, attention.WINDOW)[starts][:, -attention.STRIDE :]
    tokens = 2 * int((y >= 0).sum())
    found, seen = attention.trained(first, x, y, tokens, 0.01, 0.001, seed=5, batch=40)
    w = {k: v.astype(np.float64) for k, v in first.items()}
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    order, done, step = np.random.default_rng(5), 0, 0
    for _ in range(2):
        for own in np.array_split(order.permutation(len(x)), -(-len(x) // 40)):
            g, _, n = attention.gradients(w, x[own], y[own])
            done, step = done + n, step + 1
            lr = 0.001 + 0.009 * max(0.0, 1 - done / tokens)
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    assert seen == done == tokens
    for k in w:
        assert np.quantile(np.abs(found[k] - w[k]), 0.999) < 2e-4 and not np.array_equal(found[k], first[k]), k
    read = np.arange(attention.MEMBERS) < attention.OF_CLASS[:, None]
    assert np.array_equal(found["bm"][~read], first["bm"][~read]) and len(attention._Flat.of(first).all) == sum(p.size for k, p in first.items() if k not in ("M", "bm")) + attention.KNOWN * (attention.DIM + 1)


def test_large_logits_train_like_small_ones(monkeypatch):
    """Sums of e to them neither overflow nor vanish; taking the largest away changes nothing else."""
    rng = np.random.default_rng(13)
    weights = {k: v.astype(np.float64) for k, v in attention.first_weights(attention.Ranks(rng.integers(1, 9, 5000).astype(float))).items()}
    x = rng.integers(0, attention.KNOWN, (5, attention.WINDOW)).astype(np.int32)
    y = rng.integers(0, attention.KNOWN + 1, (5, attention.STRIDE)).astype(np.int32)
    plain = attention.gradients(weights, x, y)
    monkeypatch.setattr(attention, "CALM", 0.0)
    again = attention.gradients(weights, x, y)
    assert again[1] == pytest.approx(plain[1], rel=1e-9) and all(np.allclose(again[0][k], plain[0][k], rtol=1e-6, atol=1e-12) for k in weights)
    large = {k: (v * (30 if k in ("Wq", "Wk", "C", "M") else 1)).astype(np.float32) for k, v in weights.items()}
    found, loss, n = attention.gradients(large, x, y)
    assert n == y.size and np.isfinite(loss) and all(np.isfinite(g).all() for g in found.values())


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(9)
    weights = {k: v + rng.normal(0, 0.1, v.shape).astype(np.float32) for k, v in attention.first_weights(attention.Ranks(rng.integers(0, 50, 6000).astype(float))).items()}
    text = rng.integers(0, attention.KNOWN, 500).astype(np.int32)
    scores = set()
    for k in range(12):
        others = [rng.integers(0, attention.KNOWN, int(n)).astype(np.int32) for n in rng.integers(1, 900, 40)]
        scores.add(attention.score(weights, [*others[:k], text, *others[k:]], at_once=int(rng.integers(1, 20)) * 64)[k])
    assert len(scores) == 1


def test_attention_scores_each_token_once_and_sums_to_one():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 6000).astype(float)
    ranks = attention.Ranks(counts)
    weights = {k: v + rng.normal(0, 0.05, v.shape).astype(np.float32) for k, v in attention.first_weights(ranks).items()}
    for history in (0, 3, 40, 61):
        before = rng.integers(0, attention.KNOWN + 1, history).astype(np.int32)
        base = attention.score(weights, [before])[0] if history else 0.0
        nexts = np.arange(attention.KNOWN + 1, dtype=np.int32)
        logs = attention.score(weights, [np.append(before, x).astype(np.int32) for x in nexts]) - base
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)
    assert np.exp(ranks.tail_log[ranks.slot == attention.TAIL]).sum() == pytest.approx(1)
    # a score depends on earlier tokens alone
    text = rng.integers(0, attention.KNOWN, 90).astype(np.int32)
    other = text.copy()
    other[-1] = (other[-1] + 1) % attention.KNOWN
    prefix = attention.score(weights, [text[:-1], other[:-1]])
    assert prefix[0] == prefix[1]


def test_attention_gradients_match_differences():
    rng = np.random.default_rng(2)
    weights = {k: v.astype(np.float64) + rng.normal(0, 0.05, v.shape) for k, v in attention.first_weights(attention.Ranks(rng.integers(1, 9, 5000).astype(float))).items()}
    inputs, targets, starts, _ = attention.laid_out([rng.integers(0, 4000, 50).astype(np.int32), rng.integers(0, 4097, 7).astype(np.int32)])
    x = np.lib.stride_tricks.sliding_window_view(inputs, attention.WINDOW)[starts]
    y = np.lib.stride_tricks.sliding_window_view(targets, attention.WINDOW)[starts][:, -attention.STRIDE :]
    found, _, n = attention.gradients(weights, x, y)
    assert n == 57
    for name in weights:
        at = np.unravel_index(np.argmax(np.abs(found[name])), found[name].shape)
        step = 1e-4
        losses = []
        for sign in (1, -1):
            moved = {k: v.copy() for k, v in weights.items()}
            moved[name][at] += sign * step
            losses.append(attention.gradients(moved, x, y)[1])
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(float(found[name][at]), rel=2e-2, abs=1e-5), name


def quality_truth(r):
    text = r[1] or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    chars = sum(map(len, words))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    stops = sum(w.lower() in quality.STOP_WORDS for w in words)
    kept = not failed and 2 <= chars / len(words) <= 14 and symbols / len(words) <= 0.25 and stops / len(words) >= 0.02 and (len(lines) - len(set(lines))) / len(lines) <= 0.5 and len(words) <= 100_000
    return r[0], len(words), chars, symbols, len(lines) - len(set(lines)), len(again), failed, kept


def test_quality_rules(docs, raw, empty):
    got = quality.judged(docs).select("doc_id", *quality.WHOLE, "base_failed", "kept").collect()
    assert key(map(tuple, got)) == key(map(quality_truth, raw))
    assert quality.judged(empty).count() == 0


def test_quality_rules_equal_their_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["doc_id", *quality.WHOLE, "base_failed", "kept", "n_lines", "n_stop_words"]
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({quality.OP6_SQL})").fetchall()
    found = quality.op6_threshold_rules(spark, sf).select(*names).collect()
    assert key(map(tuple, found)) == key(expected)
    assert 0.3 < sum(r["kept"] for r in found) / len(found)


def test_bpe_equals_tiktoken(docs, raw, empty):
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})
    expected = []
    for r in raw:
        ids = coder.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert key(map(tuple, bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect())) == key(expected)
    assert bpe.encode(empty, PATH, public_tokenizers.PATTERN).count() == 0
    with_ids = bpe.encode(docs.where("doc_id = 142"), PATH, public_tokenizers.PATTERN, with_ids=True).first()
    assert coder.decode(with_ids["ids"]) == next(r[1] for r in raw if r[0] == 142)


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    frequency = 1 / np.arange(1, 9001) ** 0.8
    frequency /= frequency.sum()
    ranks = attention.Ranks(frequency * 1e7)
    texts = [ranks.slot[rng.choice(9000, size=rng.integers(0, 900), p=frequency)] for _ in range(150)]
    weights = attention.first_weights(ranks)
    whole = attention.score(weights, texts)
    for _ in range(8):
        some = rng.permutation(150)[: rng.integers(1, 150)]
        assert (attention.score(weights, [texts[i] for i in some]) == whole[some]).all()


def test_a_block_is_gone_before_the_next_is_filled(monkeypatch):
    """A task that holds two blocks, or texts beside them, is what took an executor's memory."""
    import gc

    import pyarrow as pa

    from tidewheel.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 100)
    ran = {}
    frame = type("Frame", (), {"mapInArrow": lambda self, run, schema: ran.setdefault("run", run)})()
    blocks.block_words(frame, str.split, 4)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4, 5, 6], "flag": [None] * 6, "text": [f"w{k} " * 40 for k in range(6)]}, schema=pa.schema([("doc_id", pa.int64()), ("flag", pa.bool_()), ("text", pa.string())]))
    alive, add = [], blocks._Block.add

    def counted(self, *args):
        gc.collect()
        alive.append(sum(isinstance(x, blocks._Block) and bool(x.docs) for x in gc.get_objects()))
        add(self, *args)

    monkeypatch.setattr(blocks._Block, "add", counted)
    out = list(ran["run"](iter([batch])))
    assert len({x for b in out for x in b.column(0).to_pylist()}) == 6 and alive == [0] * 6
