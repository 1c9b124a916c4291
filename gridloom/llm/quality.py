"""Quality rules with thresholds learned per language and source.

Every document gets five measures.  A mergeable sketch per (language, source, measure) counts the
values in logarithmic bins: two sketches merge by adding counts, and a quantile read from one is
within ``ACCURACY`` of the value.  The sketch of a language is shrunk towards that of the whole table
and the sketch of a group towards its language's: ``PRIOR`` documents dealt like the wider sketch are
added to the counts, so a small group leans on its language and a large one on itself, without a
size at which this changes.  Fences come from the quartiles: an upper one for every measure and a
lower one for the word length.  Documents then meet their group's fences in a join.

Defined results: a null text has no words and fails the base rules; null languages and sources are
groups of their own; a table with no rows gives no rows; repeated rows count each and get equal
results; a text of any length is read whole, by one task.  A measure without a denominator (a text
without words or lines) is null and inside every fence.  Only doc_id, text, lang and source are read.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .text import map_batches, utf8

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
LINE_EDGES = b" \t\v\f\r"

#: Relative error of a quantile, and the ratio of neighbouring bin borders that gives it.
ACCURACY = 0.01
RATIO = (1 + ACCURACY) / (1 - ACCURACY)
ZERO_BIN = -100_000
SALTS = 64

MEASURES = {
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
}
#: The spread that a group of like documents has at least: a constant, and a part of the median.
LEAST_SPREAD = {
    "word_length": (0.0, 0.1),
    "symbol_share": (0.05, 0.0),
    "dup_line_share": (0.1, 0.0),
    "repeat_share": (0.1, 0.0),
}
#: Spreads (quartile distances) between a quartile and its fence.
REACH = 4.0
#: Documents of the wider sketch that are added to a narrower one.
PRIOR = 100.0
#: Measures that have a lower fence too.
LOWER = ("word_length",)

COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered = bytearray(len(words))
    for at, window in enumerate(windows):
        if often[window] > 1:
            covered[at : at + 3] = b"\x01\x01\x01"
    return covered.count(1)


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    text = pc.fill_null(batch.column("text"), "")
    count = lambda marks: sum(pc.count_substring(text, m).to_numpy() for m in marks)
    n_words, n_lines, n_dup, n_repeat = [], [], [], []
    for raw in utf8(text):
        words = raw.split()
        lines = [line for line in raw.split(b"\n") if line.strip(LINE_EDGES)]
        n_words.append(len(words))
        n_lines.append(len(lines))
        n_dup.append(len(lines) - len(set(lines)))
        n_repeat.append(repeated_words(words))
    long = lambda values: pa.array(values, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            batch.column("lang"),
            batch.column("source"),
            long(n_words),
            long(pc.utf8_length(text).to_numpy() - count(SPACES)),
            long(count(SYMBOLS)),
            long(n_lines),
            long(n_dup),
            long(n_repeat),
        ],
        names=["doc_id", "lang", "source"] + [c.split()[0] for c in COUNTS.split(", ")],
    )


def text_counts(docs: DataFrame) -> DataFrame:
    """Counts of every whole text beside doc_id, lang and source (both as strings)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs.select(
            "doc_id",
            F.col("lang").cast("string"),
            F.col("source").cast("string"),
            F.col("text").cast("string"),
        ),
        _measure,
        f"doc_id {kind}, lang string, source string, {COUNTS}",
    )


def bin_of(value: Column) -> Column:
    """The logarithmic bin of a value of 0 or more."""
    return F.when(value <= 0, F.lit(ZERO_BIN)).otherwise(
        F.ceil(F.log(value) / F.lit(math.log(RATIO)))
    )


def value_of(bin_: Column) -> Column:
    """The value that stands for a bin."""
    middle = F.pow(F.lit(RATIO), bin_) * F.lit(2 / (1 + RATIO))
    return F.when(bin_ == ZERO_BIN, F.lit(0.0)).otherwise(middle)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: one sketch per language, source and measure."""
    values = F.explode(
        F.array(
            *[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES]
        )
    )
    long = measured.select("lang", "source", values.alias("v")).where("v.value IS NOT NULL")
    return (
        long.groupBy(
            "lang", "source", F.col("v.measure").alias("measure"), bin_of(F.col("v.value")).alias("bin")
        ).agg(F.count("*").alias("n"))
    )


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, documents, q1, q2 and q3 of the sketches merged over all other keys."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "measure")  # a sketch has a few hundred bins
    upto = group.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    ranked = merged.select(
        *keys,
        "measure",
        "bin",
        F.sum("n").over(upto).alias("_upto"),
        F.sum("n").over(group).alias("_n"),
    )
    # counts may be sums of fractions: what reaches a rank but for rounding has reached it
    reached = lambda q: F.col("_upto") >= F.col("_n") * (q * (1 - 1e-9))
    at = lambda q: F.min(F.when(reached(q), F.col("bin")))
    return ranked.groupBy(*keys, "measure").agg(
        F.max("_n").alias("documents"),
        value_of(at(0.25)).alias("q1"),
        value_of(at(0.5)).alias("q2"),
        value_of(at(0.75)).alias("q3"),
    )


def shrunk(sketch: DataFrame, prior: float = PRIOR) -> DataFrame:
    """The sketches with ``prior`` documents of the wider sketch in each: whole, language, group."""
    whole = _shares(sketch.groupBy("measure", "bin").agg(F.sum("n").alias("n")), [])
    by_lang = sketch.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    langs = _lean(by_lang, ["lang"], whole, [], prior)
    return _lean(sketch, ["lang", "source"], _shares(langs, ["lang"]), ["lang"], prior)


def _shares(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, bin and the share of the sketch that lies in the bin."""
    total = F.sum("n").over(W.partitionBy(*keys, "measure"))
    return sketch.select(*keys, "measure", "bin", (F.col("n") / total).alias("share"))


def _lean(sketch: DataFrame, keys: list[str], wider: DataFrame, wide: list[str], prior: float) -> DataFrame:
    """``sketch`` by ``keys`` with ``prior`` documents dealt like ``wider``, which is by ``wide``."""
    groups = sketch.select(*keys, "measure").distinct()
    outer = wider.withColumnsRenamed({c: f"_{c}" for c in ("measure", *wide)})
    same = F.col("measure") == F.col("_measure")
    for key in wide:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    added = groups.join(outer, same).select(*keys, "measure", "bin", (prior * F.col("share")).alias("n"))
    own = sketch.select(*keys, "measure", "bin", F.col("n").cast("double").alias("n"))
    return own.unionByName(added).groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, reach: float = REACH, prior: float = PRIOR) -> DataFrame:
    """lang, source, an upper fence ``most_`` per measure and a lower one ``least_`` for ``LOWER``."""
    found = quartiles(shrunk(sketch, prior), ["lang", "source"])
    least_spread = F.lit(0.0)
    for name, (fixed, part) in LEAST_SPREAD.items():
        least_spread = F.when(F.col("measure") == name, fixed + part * F.col("q2")).otherwise(least_spread)
    distance = reach * F.greatest(F.col("q3") - F.col("q1"), least_spread)
    only = lambda m, fence: F.max(F.when(F.col("measure") == m, fence))
    return found.groupBy("lang", "source").agg(
        *[only(m, F.col("q3") + distance).alias(f"most_{m}") for m in MEASURES],
        *[only(m, F.col("q1") - distance).alias(f"least_{m}") for m in LOWER],
    )


def judged(docs: DataFrame) -> DataFrame:
    """Counts, measures, fences and the verdict of every document."""
    counts = text_counts(docs)
    for name, ratio in MEASURES.items():
        over, under = ratio.split(" / ")
        counts = counts.withColumn(name, F.when(F.col(under) > 0, F.col(over) / F.col(under)))
    measured = settle(
        counts.withColumn(
            "base_failed",
            (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        )
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    limits = settle(fences(sketches(measured))).withColumn("_salt", salts)
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    salted = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    same = (
        (F.col("salt_") == F.col("_salt"))
        & F.col("lang").eqNullSafe(F.col("_lang"))
        & F.col("source").eqNullSafe(F.col("_source"))
    )
    met = salted.withColumnRenamed("_salt", "salt_").join(limits, same, "left")
    inside = F.lit(True)
    for name in MEASURES:
        inside = inside & F.coalesce(F.col(name) <= F.col(f"most_{name}"), F.lit(True))
    for name in LOWER:
        inside = inside & F.coalesce(F.col(name) >= F.col(f"least_{name}"), F.lit(True))
    return met.withColumn("kept", ~F.col("base_failed") & inside).drop(
        "salt_", "_salt", "_lang", "_source"
    )
