"""Sharding by proportional stratified interleaving.

Within every source the rows are shuffled by a seeded hash and ranked; row ``r`` of ``n`` gets the
fractional rank ``(r + 1/2) / n``.  In the order of fractional ranks every stretch holds the
sources in proportion, so cutting that order into equal counts gives shards that match the mixture.

Law: ``rows``, the shards' counts differ by at most one.  Positions come from counts per bucket of
the fraction, so no task sorts more than a bucket.

Defined results: a null text has no bytes and CRC 0; the null source is a stratum of its own; rows
that are equal in all columns read are interchangeable; an empty table gives an empty result; shards
beyond the row count stay empty.  Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .ordering import bucket_totals, placed
from .text import leading_bits, shuffle_key, source_key

BUCKET_BITS = 12
FRACTIONS = 4096
SEED = 8


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """doc_id, source key, size, text_crc32, fraction, position, shard and slot of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = settle(
        docs.select(
            "doc_id",
            source_key(F.col("source")).alias("src"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            shuffle_key(F.col("doc_id"), seed).alias("_key"),
            F.lit(1).cast("bigint").alias("_one"),
        ).withColumn("_bucket", leading_bits(F.col("_key"), BUCKET_BITS))
    )
    tie = ["_key", "doc_id", "size", "text_crc32"]
    ranked = placed(rows, bucket_totals(rows, "src", "_one"), "src", "_one", tie).select(
        "doc_id",
        "src",
        "size",
        "text_crc32",
        "_key",
        ((F.col("_start") + 0.5) / F.col("_total")).alias("fraction"),
    )
    ranked = settle(ranked.withColumn("_cell", F.floor(F.col("fraction") * FRACTIONS).cast("int")))
    counts = ranked.groupBy("_cell").agg(F.count("*").alias("_in"))
    earlier = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)  # FRACTIONS rows at most
    starts = counts.select(
        "_cell",
        F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_in").over(W.partitionBy()).alias("_rows"),
    )
    inside = W.partitionBy("_cell").orderBy("fraction", "src", *tie)
    numbered = ranked.withColumn("_nth", F.row_number().over(inside)).join(starts, "_cell")
    cut = F.expr(f"(position * {shards}) div _rows")
    return (
        numbered.withColumn("position", F.col("_before") + F.col("_nth") - 1)
        .withColumn("shard", cut.cast("int"))
        .withColumn(
            "slot", F.col("position") - F.expr(f"(shard * _rows + {shards - 1}) div {shards}")
        )
        .select("doc_id", "src", "size", "text_crc32", "fraction", "position", "shard", "slot")
    )
