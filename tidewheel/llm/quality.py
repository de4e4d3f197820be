"""Quality rules: a table of thresholds compiled into one Spark projection.

Metrics are DataFrame expressions over the whole text; a rule names a metric and the interval in
which a text passes. All rules become one Boolean column, without user functions.

A null text counts as an empty one: no words, and it fails. Null ids and other columns pass
through, repeated rows are judged one by one, and an empty table gives no rows. Texts of any
length are judged whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "on", "with", "by", "at", "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "pour", "der", "die", "das", "und", "ist", "von", "den", "zu", "mit", "ein", "el", "los", "las", "y", "en", "es", "por", "una", "con", "se"]


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= metric <= high; an open side is None."""

    metric: str
    low: float | None = None
    high: float | None = None


RULES = [
    Rule("n_words", 50, 100_000),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_word_ratio", None, 0.5),
]

WHOLE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the counts of WHOLE, n_lines and n_stop_words, and the ratios that rules use."""
    kept = df.columns
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = df.withColumn("_text", text)
    out = out.withColumns({
        "_words": F.filter(F.split("_text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0),
    }).withColumn("n_words", F.size("_words").cast("long"))
    # 3-word windows as 64-bit hashes, sorted with their places: equal windows become neighbours
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i"))))
    out = out.withColumn("_windows", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))))
    same = lambda x, k, d: F.coalesce(F.get("_windows", k + d)["h"] == x["h"], F.lit(False))
    out = out.withColumn("_again", F.sort_array(F.filter(F.transform("_windows", lambda x, k: F.when(((k > 0) & same(x, k, -1)) | same(x, k, 1), x["i"])), lambda i: i.isNotNull())))
    covered = F.transform("_again", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_again", k + 1) - i, F.lit(3))))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    out = out.withColumns({
        "word_chars": F.length(F.translate("_text", SPACES, "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.array_contains(stop, F.lower(w)))).cast("long"),
    })
    out = out.withColumns({
        "mean_word_chars": F.try_divide("word_chars", "n_words"),
        "symbol_ratio": F.try_divide("n_symbols", "n_words"),
        "stop_word_ratio": F.try_divide("n_stop_words", "n_words"),
        "dup_line_ratio": F.try_divide("n_dup_lines", "n_lines"),
        "repeat_word_ratio": F.try_divide("n_repeat_words", "n_words"),
    })
    return out.select(*kept, *WHOLE, "n_lines", "n_stop_words", "mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "repeat_word_ratio")


def compiled(rules: list[Rule] = RULES) -> Column:
    """True where every rule holds; a metric that is null (no words) fails."""
    sides = [F.col(r.metric) >= F.lit(r.low) for r in rules if r.low is not None] + [F.col(r.metric) <= F.lit(r.high) for r in rules if r.high is not None]
    return F.coalesce(reduce(lambda a, b: a & b, sides, F.lit(True)), F.lit(False))


def judged(df: DataFrame, rules: list[Rule] = RULES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, the counts, base_failed and kept."""
    bare = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = measured(bare).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.select("doc_id", *WHOLE, "base_failed", (~F.col("base_failed") & compiled(rules)).alias("kept"), "n_lines", "n_stop_words", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "repeat_word_ratio", "mean_word_chars")


def op6_threshold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *WHOLE, "base_failed", "kept", "n_lines", "n_stop_words")


def _oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    metric = {"n_words": "n_words", "mean_word_chars": "word_chars / n_words", "symbol_ratio": "n_symbols / n_words", "stop_word_ratio": "n_stop_words / n_words", "dup_line_ratio": "n_dup_lines / n_lines", "repeat_word_ratio": "n_repeat_words / n_words"}
    sides = [f"{metric[r.metric]} >= {r.low}" for r in RULES if r.low is not None] + [f"{metric[r.metric]} <= {r.high}" for r in RULES if r.high is not None]
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t,
         list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) > 0) AS ls
  FROM d
), tri AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(ls) AS n_lines, len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words
  FROM w LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce({" AND ".join(sides)}, FALSE) AS kept,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(n_stop_words AS BIGINT) AS n_stop_words
FROM b"""


OP6_SQL = _oracle()
