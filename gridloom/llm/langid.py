"""Language identification by cross-parsing entropy.

For each language a suffix automaton accepts every substring of its labelled words.  A text is cut
into words of letters, and each word, with its edges marked, is parsed greedily into the longest
phrases that a language's automaton accepts.  Phrases per character, times the logarithm of the
language's training length, estimate the cross entropy; the language with the least wins.  A
phrase never crosses a word's edge, so a word's parse can be remembered.

The automata are fitted on a bounded sample: per language the ``SAMPLE_DOCS`` labelled documents
of smallest seeded hash, and of their words the first ``SAMPLE_LETTERS`` letters' worth.  Every
document is predicted over its whole text.

Defined results: a null text and one without letters give ``und`` and score 0; without any learned
language every text gives ``und``; documents with a null language are predicted but not learned
from; repeated rows are predicted alike.  Only doc_id, text and, for learning, lang are read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .text import map_batches, shuffle_key

UNKNOWN = "und"
FOLDS = 5
SAMPLE_DOCS = 200
SAMPLE_LETTERS = 30_000
SEED = 6
#: Parses remembered per task; longer words are parsed anew each time.
MEMORY_WORDS = 100_000
MEMORY_LETTERS = 40

LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """True where crc32 of the id's decimal text is divisible by ``folds``; false for null ids."""
    remainder = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(remainder == 0, F.lit(False))


def sampled(labelled: DataFrame, docs: int = SAMPLE_DOCS, seed: int = SEED) -> DataFrame:
    """lang and text of the ``docs`` rows of smallest hash per language.

    Two steps, so that a language that holds most rows is not sorted by one task.
    """
    rows = labelled.select(
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
        shuffle_key(F.col("doc_id"), seed).alias("_key"),
    ).withColumn("_part", F.pmod("_key", F.lit(64)))
    keys = rows.select("lang", "_part", "_key", F.xxhash64("text").alias("_text"))
    nth = F.row_number().over(W.partitionBy("lang", "_part").orderBy("_key", "_text"))
    some = keys.withColumn("_nth", nth).where(F.col("_nth") <= docs).drop("_nth")
    nth = F.row_number().over(W.partitionBy("lang").orderBy("_key", "_text"))
    picked = some.withColumn("_nth", nth).where(F.col("_nth") <= docs)
    border = settle(picked.groupBy("lang").agg(F.max("_key").alias("_border")))  # one row per language
    found = rows.join(border, "lang").where(F.col("_key") <= F.col("_border"))
    return found.orderBy("lang", "_key", F.xxhash64("text")).select("lang", "text")


def automaton(words: list[str]) -> list[dict[str, int]]:
    """Transitions of a suffix automaton that accepts all substrings of ``words``."""
    move: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    for word in words:
        last = 0
        for letter in word:
            known = move[last].get(letter)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:
                twin = len(move)
                move.append(move[known].copy())
                link.append(link[known])
                length.append(length[last] + 1)
                link[known] = twin
                at = last
                while at >= 0 and move[at].get(letter) == known:
                    move[at][letter] = twin
                    at = link[at]
                last = twin
                continue
            new = len(move)
            move.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and letter not in move[at]:
                move[at][letter] = new
                at = link[at]
            if at >= 0:
                old = move[at][letter]
                if length[old] == length[at] + 1:
                    link[new] = old
                else:
                    twin = len(move)
                    move.append(move[old].copy())
                    link.append(link[old])
                    length.append(length[at] + 1)
                    link[old] = link[new] = twin
                    while at >= 0 and move[at].get(letter) == old:
                        move[at][letter] = twin
                        at = link[at]
            last = new
    return move


def phrases(move: list[dict[str, int]], word: str) -> int:
    """Longest-match phrases of a greedy parse; an unknown character is a phrase of its own."""
    count = state = 0
    for letter in word:
        following = move[state].get(letter)
        if following is None:
            count += state != 0
            following = move[0].get(letter)
            if following is None:
                count += 1
                following = 0
        state = following
    return count + (state != 0)


def marked_words(text: str) -> list[str]:
    return [f" {w} " for w in LETTERS.findall(text.lower())]


class CrossParser:
    """Parses words against every language and remembers the counts."""

    def __init__(self, training: dict[str, list[str]]):
        self.languages = sorted(training)
        self.moves = [automaton(training[lang]) for lang in self.languages]
        self.weight = np.array(
            [math.log2(max(2, sum(map(len, training[lang])))) for lang in self.languages]
        )
        self.known: dict[str, int] = {}
        self.counts = np.zeros((1024, len(self.languages)), np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text else []
        if not self.languages or not any(any(map(str.isalpha, w)) for w in words):
            return UNKNOWN, 0.0
        known, rows, total = self.known, [], np.zeros(len(self.languages), np.int64)
        for word in words:
            row = known.get(word)
            if row is None:
                if len(word) > MEMORY_LETTERS:
                    total += [phrases(move, f" {word} ") for move in self.moves]
                    continue
                if len(known) >= MEMORY_WORDS:
                    total += self.counts[rows].sum(axis=0)
                    rows.clear()
                    known.clear()
                row = self.learn(word)
            rows.append(row)
        if rows:
            total += self.counts[rows].sum(axis=0)
        characters = sum(map(len, words)) + 2 * len(words)
        entropy = total * self.weight / characters
        best = int(entropy.argmin())
        others = np.delete(entropy, best)
        score = 1.0 - float(entropy[best] / others.min()) if len(others) and others.min() else 1.0
        return self.languages[best], min(1.0, max(0.0, score))

    def learn(self, word: str) -> int:
        at = len(self.known)
        if at == len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[at] = [phrases(move, f" {word} ") for move in self.moves]
        self.known[word] = at
        return at


def training_words(sample: DataFrame, letters: int = SAMPLE_LETTERS) -> dict[str, list[str]]:
    """Distinct marked words per language, at most ``letters`` characters of each."""
    found: dict[str, dict[str, None]] = {}
    sizes: dict[str, int] = {}
    for lang, text in sample.toLocalIterator():
        words = found.setdefault(lang, {})
        for word in marked_words(text or ""):
            if sizes.get(lang, 0) >= letters:
                break
            if word not in words:
                words[word] = None
                sizes[lang] = sizes.get(lang, 0) + len(word)
    return {lang: list(words) for lang, words in found.items() if words}


def identify(docs: DataFrame, training: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.sparkSession.sparkContext.broadcast(training)
    parser: list[CrossParser] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not parser:
            parser.append(CrossParser(given.value))
        pairs = [parser[0].predict(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([p[0] for p in pairs], pa.string()),
                pa.array([p[1] for p in pairs], pa.float64()),
            ],
            names=["doc_id", "lang_pred", "score"],
        )

    return map_batches(
        docs.select("doc_id", F.col("text").cast("string")),
        work,
        f"doc_id {kind}, lang_pred string, score double",
    )


def learned(docs: DataFrame, folds: int = FOLDS) -> dict[str, list[str]]:
    """Training words from the labelled documents outside the held-out fold."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return training_words(sampled(labelled.where(~held_out(F.col("doc_id"), folds))))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is found, learned from its own labelled rows."""
    given = docs.sparkSession.sparkContext.broadcast(learned(docs))
    parser: list[CrossParser] = []

    def found(texts: pd.Series) -> pd.Series:
        if not parser:
            parser.append(CrossParser(given.value))
        return pd.Series([parser[0].predict(t)[0] != UNKNOWN for t in texts], dtype=bool)

    return docs.where(F.pandas_udf(found, "boolean")(F.col("text").cast("string")))
