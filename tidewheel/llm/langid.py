"""Language ID by words first, backing off to shorter and shorter character n-grams.

A known word scores by its log frequency in each language. A word that training has not seen scores
by its character n-grams of the longest order of which any is known, from ``max_n`` down to single
letters. A text's score for a language is the sum over its words plus the language's log share.

Fitting reads the labelled rows alone, at most about ``docs_a_lang`` of each language: where there are
more, those whose hash falls under a threshold that follows from the language's own exact count, so
rare languages are learned as well as frequent ones. All words and n-grams of these rows are kept;
the bound on rows keeps the model small enough to send to every task, at any size of the corpus.
Prediction is one pass over whole texts without a shuffle. A letter is a character of the Unicode
categories L*, both in fitting and in prediction.

A text that is null or has no letter gets ``und`` and score 0, and so does every text if nothing
could be learned. Null ids, null languages (not learned from) and repeated rows are kept; ties go to
the language that comes first by code point; an empty table gives no rows. The language and other
columns are never looked at in prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidied, written

#: About so many labelled rows of each language are learned from, at most.
DOCS_A_LANG = 1_500
MAX_N = 4
UND = "und"


#: Runs of word characters but digits: letters, and now and then numbers of the categories Nl and No, which are no letters.
_RUNS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """The runs of letters (Unicode categories L*, as str.isalpha has it) of a text in lower case."""
    found = _RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


#: So many words of a worker's own are remembered.
_MEMO = 200_000


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    words: dict[str, int] = field(default_factory=dict)
    word_scores: np.ndarray = None
    grams: dict[str, int] = field(default_factory=dict)
    gram_scores: np.ndarray = None
    max_n: int = MAX_N

    def of_word(self, word: str) -> np.ndarray | None:
        """Log frequency in each language; None if not even a letter is known."""
        at = self.words.get(word)
        if at is not None:
            return self.word_scores[at]
        marked = f" {word} "
        for n in range(min(self.max_n, len(marked)), 0, -1):
            found = [self.grams[g] for k in range(len(marked) - n + 1) if (g := marked[k : k + n]) in self.grams]
            if found:
                return self.gram_scores[found].mean(axis=0)
        return None


def _columns(df: DataFrame) -> list[tuple[str, str, int]]:
    """A bounded table (key, lang, n) on the driver, by way of columns: rows as objects take several times the memory."""
    columns = df.toArrow()
    names = {x: x for x in columns.column(1).unique().to_pylist()}
    return list(zip(columns.column(0).to_pylist(), map(names.__getitem__, columns.column(1).to_pylist()), columns.column(2).to_pylist()))


def _log_table(rows: list, langs: list[str], totals: np.ndarray, kinds: int) -> tuple[dict[str, int], np.ndarray]:
    """rows (key, lang, n) to numbers of keys and their smoothed log frequencies."""
    at, where = {}, {lang: k for k, lang in enumerate(langs)}
    for key, _, _ in rows:
        at.setdefault(key, len(at))
    counts = np.zeros((len(at), len(langs)))
    for key, lang, n in rows:
        counts[at[key], where[lang]] += n
    return at, np.log((counts + 0.5) / (totals + 0.5 * max(1, kinds)))


def chosen(labelled: DataFrame, docs_a_lang: int) -> tuple[DataFrame, dict[str, int]]:
    """About docs_a_lang rows of each language at most, equal rows once; the languages' exact counts."""
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # as many rows as languages
    if not counts:
        return labelled, counts
    least = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, docs_a_lang / n) * (1 << 40))])
    place = F.xxhash64("lang", "seed", "text")
    return labelled.where(F.pmod(place, F.lit(1 << 40)) < least[F.col("lang")]).dropDuplicates(["lang", "seed", "text"]), counts


def _grams(n: int) -> Column:
    """All strings of n characters of the column marked."""
    return F.transform(F.sequence(F.lit(1), F.length("marked") - (n - 1)), lambda i: F.substr("marked", i, F.lit(n)))


def train(labelled: DataFrame, docs_a_lang: int = DOCS_A_LANG, max_n: int = MAX_N) -> Model | None:
    """labelled: text, lang, seed (a stable number for each row). None if there is nothing to learn."""
    labelled, shares = chosen(labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), docs_a_lang)
    if not shares:
        return None
    words = written(labelled.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "language-words")
    word_rows = _columns(words.select("word", "lang", "n"))
    totals: dict[str, int] = {}
    for _, lang, n in word_rows:
        totals[lang] = totals.get(lang, 0) + n
    if not totals:
        return None
    marked = words.withColumn("marked", F.concat(F.lit(" "), "word", F.lit(" ")))
    gram_rows, gram_totals = [], {}
    for n in range(1, max_n + 1):
        own = marked.where(F.length("marked") >= n).select("lang", F.explode(_grams(n)).alias("gram"), "n")
        gram_rows.append(_columns(own.where(F.trim("gram") != "").groupBy("gram", "lang").agg(F.sum("n").alias("n"))))
        gram_totals[n] = {}
        for _, lang, k in gram_rows[-1]:
            gram_totals[n][lang] = gram_totals[n].get(lang, 0) + k
    langs = sorted(totals, key=lambda x: x.encode())
    out = Model(langs, np.log(np.array([shares.get(x, 0) + 1.0 for x in langs]) / (sum(shares.values()) + len(langs))), max_n=max_n)
    out.words, out.word_scores = _log_table(word_rows, langs, np.array([totals[x] for x in langs], float), len({r[0] for r in word_rows}))
    scores = []
    for n, rows in enumerate(gram_rows, 1):
        at, own = _log_table(rows, langs, np.array([gram_totals[n].get(x, 0) for x in langs], float), len({r[0] for r in rows}))
        out.grams |= {g: k + sum(map(len, scores)) for g, k in at.items()}
        scores.append(own)
    out.gram_scores = np.concatenate(scores)
    return out


def predict(df: DataFrame, model: Model | None, kept: list[str], text_col: str = "text") -> DataFrame:
    """The columns kept (of df), lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in df.schema.fields if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        memo: dict[str, int] = {}
        rows: list[np.ndarray] = []
        unknown = -1
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(len(fields)).to_pylist():
                words = letters(text) if text else []
                if not words or model is None:
                    langs.append(UND)
                    scores.append(0.0)
                    continue
                if len(memo) > _MEMO:
                    memo, rows = {}, []
                for w in set(words).difference(memo):
                    got = model.of_word(w)
                    memo[w] = unknown if got is None else len(rows)
                    if got is not None:
                        rows.append(got)
                at = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                numbers, times = np.unique(at[at >= 0], return_counts=True)
                total = model.prior + (times @ np.array([rows[k] for k in numbers.tolist()]) if len(numbers) else 0)
                best = int(np.argmax(total))
                langs.append(model.langs[best])
                scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(fields))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in fields), "lang_pred", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"])
    return df.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text_col).cast("string").alias("_whole_text")).mapInArrow(tidied(run), schema)


def held_out(id_col: Column, mod: int, left: int, equal: bool) -> Column:
    """crc32 of the id as text, modulo mod, compared with left; a null id counts as the empty text."""
    rest = F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))
    return rest == left if equal else rest != left


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    docs = df.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col), 5, 0, True).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(docs.where(~F.col("held_out")).select("text", "lang", F.col("doc_id").alias("seed")))
    return predict(docs, model, ["doc_id", "held_out"])


def op3_word_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
