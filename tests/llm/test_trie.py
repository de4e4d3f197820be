"""The prefix trie against a plain one made of dictionaries."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tidewheel.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, pos long, head string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows, splice=True):
    own = {}
    for c, turn, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if splice else 0
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        parts = [below(k) for k in kids.get(p, [])]
        return own_saved + sum(s for s, _ in parts), sum(n for _, n in parts) if parts else 1

    out = []
    for p, ids in members.items():
        saved, leaves = below(p)
        ends = ",".join(map(str, sorted(c for c in ids if len(built[c]) == len(p))))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(n=260, seed=3):
    rng = random.Random(seed)
    words = ["", "a", "bb", "ccc", "ünd 😀", None]
    out = []
    for c in range(n):
        if c in (100, 57):  # absent, one of them the first of its group
            continue
        kind = rng.random()
        turns = [("user", "hello"), ("assistant", "hi"), ("user", "x" * (c % 3))] if kind < 0.3 else [(rng.choice(["user", "assistant", None, "system"]), rng.choice(words)) for _ in range(rng.randint(1, 9))]
        out += [(c, k if k else None, r, t) for k, (r, t) in enumerate(turns)]
    out += [(500, k, "user", f"long {k}") for k in range(300)] + [(501, k, "user", f"long {k}") for k in range(300)] + [(502, k, "user", f"long {k}" if k != 290 else "other") for k in range(300)][:10]
    out += [(7, 1, "user", "again"), (7, 1, "user", "again"), (None, 0, "user", "nobody"), (3_000_000_007, 2, None, None), (900, 0, "user", "only")]
    return [(*r, 5, "clash") for r in out]


def found(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    return conversations()


def test_nodes_equal_the_plain_trie(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(trie.trie(*trie.spliced(trie.ordered(df)))) == expected(rows)


def test_conversations_as_they_are(spark):
    """Without splicing, and with deep copies that are retired at once."""
    rows = [r for r in conversations(40, 5) if r[0] is not None and r[0] < 500]
    rows += [(c, k, "user", f"same {k}", 1, "") for c in (600, 601, 602) for k in range(50)]
    turns = trie.ordered(spark.createDataFrame(rows, SCHEMA))
    assert found(trie.trie(turns, trie.counted(turns))) == expected(rows, splice=False)


def test_one_conversation_and_none(spark):
    one = [(4, 0, "user", "a", 0, ""), (4, 1, "user", "b", 0, "")]
    turns = trie.ordered(spark.createDataFrame(one, SCHEMA))
    assert found(trie.trie(turns, trie.counted(turns))) == expected(one, splice=False)
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.trie(*trie.spliced(trie.ordered(empty))).collect() == []


def test_turnless_conversations(spark):
    """A conversation whose own turns are all replaced by those of an absent one has no turns."""
    ids = [c for c in range(300, 400) if zlib.crc32(str(c).encode()) % 6 >= 1 and c % 100][:5]
    rows = [(c, 0, "user", f"t{c}", 0, "") for c in ids]
    got = found(trie.trie(*trie.spliced(trie.ordered(spark.createDataFrame(rows, SCHEMA)))))
    assert got == expected(rows) and got[0][3] == 5 and got[0][4] == 0


def test_positions_over_partitions(spark, rows):
    """A conversation that spans partitions is numbered without being gathered."""
    many = [(1, k, "user", "t" * (k % 7), 0, "") for k in range(5000)] + list(rows)
    got = {(r.conv_id, r.pos): (r.chars, r.cum) for r in trie.ordered(spark.createDataFrame(many, SCHEMA)).where("conv_id = 1").collect()}
    own = sorted((r for r in many if r[0] == 1), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    total = 0
    for k, r in enumerate(own):
        total += len(r[3] or "")
        assert got[(1, k + 1)] == (len(r[3] or ""), total)


def test_sql_gives_the_same_nodes(spark, rows, tmp_path):
    few = [r for r in rows if r[0] is None or r[0] < 500 or r[0] > 600]
    few = [r for r in few if r[0] != 7]
    df = spark.createDataFrame(few, SCHEMA)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW conversations AS FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
        want = sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(COLS)} FROM ({trie.OP11_SQL})").fetchall()), key=str)
    assert want == expected(few)
