"""Quality rules: a threshold table compiled into one projection, without user functions.

Null and empty texts have no words, fail the base rule and are not kept.
Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, let, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of the languages at hand.
STOP_WORDS = (
    "the be to of and that have with in is it for on as by this was are from or an a "
    "der die das und zu den von mit sich ist im ein eine nicht auf es be "
    "le la les des et un une en du de que qui est dans pour par sur au "
    "el los las del y en un una que se por con su al no"
).split()


@dataclass(frozen=True)
class Rule:
    """One line of the threshold table: a measure must lie within [low, high]."""

    name: str
    measure: Callable[[], Column]
    low: float | None = None
    high: float | None = None


def _ratio(a: str, b: str) -> Callable[[], Column]:
    return lambda: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


#: Loose on purpose: ordinary prose in any of the languages passes every line.
RULES = (
    Rule("mean_word_length", _ratio("qr_word_chars", "qr_n_words"), 2.0, 20.0),
    Rule("symbol_ratio", _ratio("qr_n_symbols", "qr_n_words"), None, 0.25),
    Rule("stop_word_ratio", _ratio("qr_n_stop", "qr_n_words"), 0.005, None),
    Rule("dup_line_ratio", _ratio("qr_n_dup_lines", "qr_n_lines"), None, 0.7),
)


def compile_rules(rules=RULES) -> Column:
    """All lines of the table as one boolean expression."""
    verdict = F.lit(True)
    for rule in rules:
        value = rule.measure()
        if rule.low is not None:
            verdict = verdict & (value >= F.lit(float(rule.low)))
        if rule.high is not None:
            verdict = verdict & (value <= F.lit(float(rule.high)))
    return verdict


def window_keys(words: Column, width: int) -> Column:
    """64-bit keys of all windows of ``width`` words, by doubling: two overlapping halves make a window."""

    def joined(keys: Column, step: int) -> Column:
        return let(keys, lambda k: F.zip_with(k, F.slice(k, step + 1, F.greatest(F.size(k) - step, F.lit(0))), lambda x, y: F.xxhash64(x, y)))

    keys, span = F.transform(words, lambda w: F.xxhash64(w)), 1
    while span < width:
        step = min(span, width - span)
        keys = joined(keys, step)
        span += step
    return keys


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more, the first finding included."""
    n = F.size(words) - width + 1

    def covered(keys: Column) -> Column:
        ranked = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        same = lambda r, j, x: F.coalesce(F.get(r, j)["k"] == x["k"], F.lit(False))
        starts = let(
            ranked,
            lambda r: F.array_sort(F.filter(F.transform(r, lambda x, j: F.when(same(r, j + 1, x) | same(r, j - 1, x), x["i"])), lambda i: i.isNotNull())),
        )
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(s, j + 1) - p, F.lit(width)))), F.lit(0), lambda a, x: a + x))

    def count(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), let(keys, covered)).otherwise(F.lit(0))

    whole = let(window_keys(words, width), lambda k: let(F.slice(k, 1, F.greatest(n, F.lit(0))), count))
    return F.when(n >= 2, whole).otherwise(F.lit(0)).cast("long")


def measure_quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with qr_* measures, qr_base_failed and qr_kept."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("qr_words", words_of(body, SPACE_RUN))
    out = out.withColumn("qr_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.select(
        *docs.columns,
        F.size("qr_words").cast("long").alias("qr_n_words"),
        F.length(F.regexp_replace(body, SPACE_RUN, "")).cast("long").alias("qr_word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("qr_n_symbols"),
        F.size("qr_lines").cast("long").alias("qr_n_lines"),
        (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).cast("long").alias("qr_n_dup_lines"),
        F.size(F.filter("qr_words", lambda w: F.lower(w).isin(sorted(set(STOP_WORDS))))).cast("long").alias("qr_n_stop"),
        repeated_words(F.col("qr_words")).alias("qr_n_repeat_words"),
    )
    out = out.withColumn("qr_base_failed", (F.col("qr_n_words") < 20) | (100 * F.col("qr_n_repeat_words") > 30 * F.col("qr_n_words")))
    return out.withColumn("qr_kept", ~F.col("qr_base_failed") & compile_rules(rules))


def quality_table(docs: DataFrame) -> DataFrame:
    out = measure_quality(docs.select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col(f"qr_{n}").alias(n) for n in names])
