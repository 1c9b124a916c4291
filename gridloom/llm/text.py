"""Shared pieces of the training-data operators.

Words are maximal runs of characters other than space and U+0009 to U+000D.  On UTF-8 bytes
``bytes.split()`` gives exactly these, so the Python operators split bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"

#: Shuffle order of rows: the leading 60 bits of an MD5, so that other engines can repeat it.
HASH_BITS = 60


def word_count(text: Column) -> Column:
    """Words in ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """A non-null key that sorts sources by code point and the null source last."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """A seeded 60-bit number for a document; null ids share one number."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def leading_bits(key: Column, bits: int) -> Column:
    """The leading bits of a shuffle key: buckets that keep the order of the key."""
    return F.shiftright(key, HASH_BITS - bits).cast("int")


#: Rows handed to a function at once: what it holds in memory follows from these, not from a batch.
SLICE_ROWS = 500


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable], schema: str
) -> DataFrame:
    """``mapInArrow`` with a function of a few rows that gives a batch or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = work(batch.slice(at, SLICE_ROWS))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null becomes empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
