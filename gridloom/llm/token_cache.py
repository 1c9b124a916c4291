"""Token counts with a cache of digests.

A text is normalised as far as its tokenizer is blind to the difference, and named by the digest of
what is left.  The digests of a table are joined to the counts that the cache holds for this
version of the tokenizer; of those missing, one text each is encoded, and its count is appended.
All counts are then joined back from the cache.

The cache is a Parquet table of _digest and n_tokens, partitioned by the version: a digest of the
tokenizer's file, the library and its version, and the way of counting.  A row in it is right by
itself, so an append that was cut short, or two at once, do no harm: equal rows are merged when read.

The digests move without their texts.  Texts are merged by digest on the map side first, so copies of
one text reach a task once per partition; when few digests are missing the optimizer filters the texts
before it moves any.  A tokenizer that drops white space counts word by word, with a bounded memory of
counts, and a long text in stretches cut at white space; others take whole texts.

Defined results: a null text is empty; an empty text, or one of white space only where that is dropped,
has 0 tokens; repeated rows and equal texts have equal counts; an empty table gives no rows and leaves
the cache as it was.  ``docs`` is read twice and must not change in between.  Only the columns in
``keep`` and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .text import map_batches, utf8

LIMIT = 2048
#: Counts of words remembered per task, and the longest word that is remembered.
MEMORY_WORDS = 200_000
MEMORY_OCTETS = 64
#: Octets of a text whose words are held at once.
STRETCH = 1_000_000
#: White space that every tokenizer here takes for a separator.
SPACES = r"[ \t\n\x0B\f\r]+"
CACHE = "_digest binary, n_tokens long, tokenizer string"


class _Words(dict):
    """Counts of words, asked of the tokenizer once each while there is room."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: bytes) -> int:
        found = self.count(word.decode())
        if len(word) <= MEMORY_OCTETS and len(self) < MEMORY_WORDS:
            self[word] = found
        return found


def stretches(data: bytes, size: int = STRETCH):
    """``data`` in parts of about ``size`` octets, cut at white space."""
    space, at = re.compile(rb"[ \t\n\x0B\f\r]"), 0
    while len(data) - at > size:
        cut = space.search(data, at + size)
        if cut is None:
            break
        yield data[at : cut.start()]
        at = cut.start()
    yield data[at:]


class Tokenizer:
    """What is counted with: a file of the tokenizers library (.json) or of sentencepiece (.model)."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.data = file.read()
        if path.endswith(".json"):
            import tokenizers as library

            spec = json.loads(self.data)
            self.kind, self.by_word, self.lowers = "json", _drops_space(spec), _lowers(spec)
        elif path.endswith(".model"):
            import sentencepiece as library

            self.kind, self.by_word, self.lowers = "model", False, False
        else:
            raise ValueError(f"neither .json nor .model: {path}")
        named = f"{library.__name__} {library.__version__}, no special tokens added, whole texts\n"
        self.version = hashlib.sha256(named.encode() + self.data).hexdigest()

    def normalised(self, text: Column) -> Column:
        """``text`` without differences that cannot change its count.

        White space runs become one space where the tokenizer drops white space.  Where it lowers
        letters, texts of ASCII are lowered, unless they may hold a special string, which is matched
        before; other texts are not, as composition comes before lowering.
        """
        if not self.by_word:
            return text
        text = F.trim(F.regexp_replace(text, SPACES, " "))
        if not self.lowers:
            return text
        plain = (F.octet_length(text) == F.char_length(text)) & ~F.contains(text, F.lit("<|"))
        return F.when(plain, F.lower(text)).otherwise(text)

    def counting(self):
        """A function from a text's octets to its number of tokens; made once per task."""
        if self.kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda data: len(model.encode(data.decode()))
        import tokenizers

        model = tokenizers.Tokenizer.from_buffer(self.data)
        model.no_truncation()
        model.no_padding()
        count = lambda text: len(model.encode(text, add_special_tokens=False).ids)
        if not self.by_word:
            return lambda data: count(data.decode())
        words = _Words(count)
        return lambda data: sum(sum(map(words.__getitem__, s.split())) for s in stretches(data))


def _drops_space(spec: dict) -> bool:
    """Whether no token can reach across or hold ASCII white space, special strings included.

    So if the parts that a pattern matches are all that is kept, and the pattern has neither a space,
    a dot, nor a negated class that does not exclude white space.
    """
    steps = spec.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    pattern = (first.get("pattern") or {}).get("Regex", " ")
    classes = re.findall(r"\[\^(\\s)?", pattern)
    known = {"NFC", "Replace", "Lowercase"}
    normal = spec.get("normalizer") or {}
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and not re.search(r"[ .]|\\[SWDPs](?!\\p)", re.sub(r"\[\^\\s", "[^", pattern))
        and all(classes)
        and {n["type"] for n in normal.get("normalizers", [normal] if normal else [])} <= known
        and not any(re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    )


def _lowers(spec: dict) -> bool:
    normal = spec.get("normalizer") or {}
    return any(n["type"] == "Lowercase" for n in normal.get("normalizers", [normal]) if n)


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """_digest and n_tokens that the cache in folder ``cache`` holds for a tokenizer's version."""
    held = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return held.groupBy("_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _append(counts: DataFrame, cache: str) -> None:
    counts.write.mode("append").partitionBy("tokenizer").parquet(cache)


def count_tokens(
    docs: DataFrame,
    tokenizer: Tokenizer,
    cache: str,
    limit: int = LIMIT,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``keep``, n_bytes, n_tokens and over_limit of every row, with the cache in folder ``cache``."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = tokenizer.normalised(whole)
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    asked = settle(
        docs.select(
            *keep, F.octet_length(whole).cast("bigint").alias("n_bytes"), digest.alias("_digest")
        )
    )
    _append(spark.createDataFrame([], CACHE), cache)  # the folder is there from now on
    held = stored_counts(spark, cache, tokenizer.version)
    missing = settle(asked.select("_digest").distinct().join(held, "_digest", "left_anti"))
    texts = (
        docs.select(digest.alias("_digest"), content.alias("_content"))
        .groupBy("_digest")
        .agg(F.max("_content").alias("_content"))
        .join(missing, "_digest", "left_semi")
    )
    state: dict = {}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state["count"] = tokenizer.counting()
        counted = [state["count"](data) for data in utf8(batch.column("_content"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("_digest"), pa.array(counted, pa.int64())], names=["_digest", "n_tokens"]
        )

    fresh = map_batches(texts, count, "_digest binary, n_tokens long")
    _append(fresh.withColumn("tokenizer", F.lit(tokenizer.version)), cache)
    counts = stored_counts(spark, cache, tokenizer.version)
    return asked.join(counts, "_digest", "left").select(
        *keep, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
