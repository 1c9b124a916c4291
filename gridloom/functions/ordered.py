"""Ordered computations that never put a whole group in one task.

A window over ``partitionBy(key).orderBy(position)`` sends all rows of a hot key to one
task.  The helpers here cut the integer position into fixed-width blocks.  Windows run
inside (key, block), which holds at most ``block`` positions, and over one summary row
per (key, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle

BLOCK = 65_536


def _with_block(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, Column],
    block: int = BLOCK,
) -> DataFrame:
    """Inclusive running sums by ``order`` (an integer, unique within ``keys``)."""
    keys = list(keys)
    blocked = _with_block(df, order, block)
    for name, value in sums.items():
        blocked = blocked.withColumn(f"_v_{name}", value)
    totals = blocked.groupBy(*keys, "_block").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    )
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
    )
    inside = (
        W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    )
    joined = blocked.join(carried, [*keys, "_block"])
    out = joined.select(
        *df.columns,
        *[(F.col(f"_c_{n}") + F.sum(f"_v_{n}").over(inside)).alias(n) for n in sums],
    )
    return out


def position(
    df: DataFrame, keys: Sequence[str], order: str, name: str, block: int = BLOCK
) -> DataFrame:
    """Dense 0-based position by ``order`` within ``keys``."""
    ranked = running_sum(df, keys, order, {name: F.lit(1).cast("bigint")}, block)
    return ranked.withColumn(name, F.col(name) - 1)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, str],
    block: int = BLOCK,
) -> DataFrame:
    """``values`` (new name -> column) of the preceding row by ``order``; null on the first."""
    keys = list(keys)
    blocked = _with_block(df, order, block)
    payload = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    last = blocked.groupBy(*keys, "_block").agg(F.max_by(payload, order).alias("_last"))
    over_blocks = W.partitionBy(*keys).orderBy("_block")
    carried = last.select(*keys, "_block", F.lag("_last").over(over_blocks).alias("_carry"))
    inside = W.partitionBy(*keys, "_block").orderBy(order)
    joined = (
        blocked.withColumn("_prev", F.lag(payload).over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn("_prev", F.coalesce("_prev", "_carry"))
    )
    return joined.select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in values])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics; nulls do not count.

    Equal values are counted first.  The distinct values are range-partitioned by key and value,
    so a hot key spans many tasks, and the counts of the partitions before give the ranks that a
    value holds.  Each wanted order statistic then meets the one value whose ranks hold it.
    NaN sorts above infinity.
    """
    keys = list(keys)
    source = df.select(*keys, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    counted = source.groupBy(*keys, "_x").agg(F.count("*").alias("_m"))
    order = [*[F.col(k) for k in keys], F.col("_x")]
    placed = settle(
        counted.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    sums = placed.groupBy(*keys, "_part").agg(F.sum("_m").alias("_in"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"),
        F.sum("_in").over(W.partitionBy(*keys)).alias("_n"),
    )
    inside = W.partitionBy(*keys, "_part").orderBy("_x")
    ranked = (
        placed.withColumn("_upto", F.sum("_m").over(inside))
        .join(starts, [*keys, "_part"])
        .withColumn("_to", F.col("_start") + F.col("_upto"))
        .withColumn("_from", F.col("_to") - F.col("_m"))
    )

    def at(q: float) -> Column:
        return (F.col("_n") - 1) * F.lit(q)

    def holding(rank: Column) -> Column:
        held = (rank >= F.col("_from")) & (rank < F.col("_to"))
        return F.max(F.when(held, F.col("_x")))

    found = ranked.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[holding(F.floor(at(q))).alias(f"_lo_{n}") for n, q in quantiles.items()],
        *[holding(F.ceil(at(q))).alias(f"_hi_{n}") for n, q in quantiles.items()],
    )

    def between(name: str, q: float) -> Column:
        low, high, weight = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), at(q) - F.floor(at(q))
        same = (low == high) | (weight == 0)  # keeps infinity as it is
        return F.when(same, low).otherwise(low * (1 - weight) + high * weight)

    return found.select(*keys, *[between(n, q).alias(n) for n, q in quantiles.items()])


def spread_sequence(
    df: DataFrame, count: Column, name: str, keys: Sequence[str], chunk: int = BLOCK
) -> DataFrame:
    """Rows 0 .. count-1 in column ``name`` for every input row.

    Long runs are cut into chunks and the (few) chunk rows are spread over the cluster
    before they are expanded, so one long run does not unfold inside one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = df.withColumn("_count", count.cast("bigint")).where(F.col("_count") > 0)
    last = F.floor((F.col("_count") - 1) / F.lit(chunk)).cast("bigint")
    chunks = sized.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    chunks = chunks.repartition(parts, *keys, "_chunk")
    low = F.col("_chunk") * F.lit(chunk)
    high = F.least(F.col("_count"), low + F.lit(chunk)) - 1
    return chunks.select(*df.columns, F.explode(F.sequence(low, high)).alias(name))


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, block: int = BLOCK
) -> DataFrame:
    """Last non-null ``value`` at or before each position (unique within ``keys``)."""
    keys = list(keys)
    blocked = _with_block(df, order, block)
    known = blocked.where(F.col(value).isNotNull())
    last = known.groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_last"))
    blocks = blocked.select(*keys, "_block").distinct().join(last, [*keys, "_block"], "left")
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(
        *keys, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carry")
    )
    inside = (
        W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    )
    joined = blocked.withColumn("_seen", F.last(value, ignorenulls=True).over(inside))
    return joined.join(carried, [*keys, "_block"]).select(
        *df.columns, F.coalesce("_seen", "_carry").alias(out)
    )


def sorted_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """1-based position by any sort order; the order must be total within ``keys``.

    Rows are range-partitioned by key and order, so a hot key spans many partitions, and
    written once to fix the partition of each row.  Positions are then the count of the
    partitions before plus the place inside the partition.
    """
    keys = list(keys)
    placed = settle(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    counts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        *keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = W.partitionBy(*keys, "_part").orderBy(*order)
    numbered = placed.withColumn("_row", F.row_number().over(inside))
    return numbered.join(starts, [*keys, "_part"]).select(
        *df.columns, (F.col("_start") + F.col("_row")).cast("bigint").alias(name)
    )
