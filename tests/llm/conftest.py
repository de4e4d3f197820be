"""Small documents with every odd case: nulls, empty and long texts, copies, ties, repeated rows, an extra column with a clashing name."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy int, _text string"


def rows() -> list[tuple]:
    rng = random.Random(7)
    lexicon = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(150)] for lang, letters in (("aa", "abcdeé"), ("bb", "klmnoü"))}
    prose = lambda lang, n: " ".join(rng.choice(lexicon[lang]) for _ in range(n))
    out = []
    for k in range(60):
        lang = ("aa", "bb")[k % 2]
        text = prose(lang, rng.randint(30, 90)) + rng.choice([".", "\n", " #x"]) + prose(lang, 9)
        out.append((k, text, lang, f"s{k % 5}" if k % 11 else None))
    shared = prose("aa", 60)
    out += [(100 + k, f"{prose('aa', 20)} {shared} {prose('aa', 20)}", "aa", "s1") for k in range(4)]
    near = prose("bb", 300)
    out += [(110, near, "bb", "s0"), (111, near + " und", "bb", "s0"), (112, near, None, "s0"), (113, near.upper(), "bb", "s2")]
    long = prose("bb", 8_000)
    out += [(120, long, "bb", "s3"), (121, long[2000:], "bb", "s3")]
    out += [(130, None, "aa", "s1"), (131, "", "aa", "s1"), (132, " \n\t ", "bb", None), (133, "12 34 !!", "bb", "s4"), (134, "x", "aa", "s4"), (135, "　 a\x0bb  \x85c", "aa", "s4")]
    out += [(140, "ab" * 700, "aa", "s2"), (141, "line\n" * 80, "aa", "s2"), (142, "Żółw 😀 naïve " * 30, "bb", "s2"), (143, " ".join(["w"] * 120), "aa", "s2")]
    out += [out[3], out[3], (None, prose("aa", 50), "aa", "s1"), (None, None, None, None)]
    return [(i, t, g, s, None if t is None else len(t), 1, "clash") for i, t, g, s in out]


@pytest.fixture(scope="session")
def raw():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(raw, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
