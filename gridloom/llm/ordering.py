"""Positions in a seeded shuffle of each group, without a window over a whole group.

Rows fall into (group, leading bits of the shuffle key).  Windows run inside such a bucket; the
buckets' totals, at most ``2**bits`` per group, are summed up before them.  So a group that holds
a third of all rows is spread over thousands of partitions keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket_totals(rows: DataFrame, group: str, amount: str) -> DataFrame:
    """group, _bucket, _before (amount in earlier buckets), _total (amount in the group)."""
    sums = rows.groupBy(group, "_bucket").agg(F.sum(amount).alias("_in"))
    upto = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(group)
    return sums.select(
        group,
        "_bucket",
        F.coalesce(F.sum("_in").over(upto), F.lit(0)).alias("_before"),
        F.sum("_in").over(whole).alias("_total"),
    )


def placed(rows: DataFrame, totals: DataFrame, group: str, amount: str, order: list[str]) -> DataFrame:
    """``rows`` with the totals' columns, _start (amount before the row) and _place in its bucket.

    Rows that are equal in all of ``order`` are interchangeable.
    """
    inside = W.partitionBy(group, "_bucket").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("_upto", F.sum(amount).over(upto))
        .withColumn("_place", F.row_number().over(inside))
        .join(totals, [group, "_bucket"])
        .withColumn("_start", F.col("_before") + F.col("_upto") - F.col(amount))
        .drop("_upto", "_before")
    )
