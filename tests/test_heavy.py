"""Joins with frequent keys against ordinary joins."""

import pytest
from pyspark.sql import functions as F

import grids
from gridloom.functions.heavy import Heavy, find_heavy, join_heavy
from gridloom.operators import algebra as al

PLAIN = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def sorted_joins(spark):
    before = {k: spark.conf.get(k, None) for k in PLAIN}
    for k, v in PLAIN.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.select(sorted(df.columns)).collect())))


def test_frequent_keys_are_found(spark, table):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    found = find_heavy(df, "k")
    assert len(found.hashes) == 1 and df.where(found.holds()).select("k").distinct().first().k == 7
    assert find_heavy(df.where("k <> 7"), "k").hashes == ()
    assert find_heavy(df.limit(0), "k").hashes == ()
    nulls = df.withColumn("k", F.when(F.col("id") % 2 == 0, F.col("k")))
    assert nulls.where(find_heavy(nulls, "k").holds() & F.col("k").isNull()).count() == 15_000


def test_split_joins_keep_rows_and_spread_the_key(sorted_joins):
    spark = sorted_joins
    large = spark.range(6_000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), (F.col("id") % 500).alias("v")
    )  # a third of one key, a third null, repeated rows
    other = spark.range(0, 4_000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    other = other.unionByName(other.where("k = 7"))
    heavy = find_heavy(large, "k", ways=16)
    assert len(heavy.hashes) == 2
    for how in ("inner", "left", "left_semi"):
        assert rows_of(join_heavy(large, other, heavy, how)) == rows_of(large.join(other, "k", how))
    held = lambda df: df.where("k = 7").select(F.spark_partition_id()).distinct().count()
    assert held(large.join(other, "k")) == 1 and held(join_heavy(large, other, heavy)) >= 6


def test_split_joins_refuse_what_would_lose_rows(table):
    large, other = table("k long, v long", [(1, 1)]), table("k int, w long", [(1, 1)])
    heavy = Heavy(("k",), (5,), 4)
    with pytest.raises(ValueError, match="key k"):
        join_heavy(large, other, heavy)
    with pytest.raises(ValueError, match="full"):
        join_heavy(large, large, heavy, "full")


def test_products_with_a_heavy_column_and_row(table):
    cells = [(1, "A2", i, 0, 1.0 + i) for i in range(300)] + [(1, "A2", i, i + 1, 2.0) for i in range(300)]
    cells += [(1, "A2", 0, j, 3.0) for j in range(400, 700)]
    a = table(grids.A, cells)
    x = a.select("case_id", "col").distinct().withColumn("x", F.col("col") + 1.0)
    y = a.select("case_id", "block", "row").distinct().withColumn("y", F.col("row") + 1.0)
    by_col, by_row = find_heavy(a, *al.COL, ways=5), find_heavy(a, *al.ROW, ways=5)
    assert len(by_col.hashes) == 1 and len(by_row.hashes) == 1
    assert rows_of(al.spmv(a, x, heavy=by_col)) == rows_of(al.spmv(a, x))
    assert rows_of(al.spmv_t(a, y, heavy=by_row)) == rows_of(al.spmv_t(a, y))
    parted = a.withColumn("part", F.when(F.col("row") < 5, "balance").otherwise("storage"))
    assert rows_of(al.gram_blocks(parted, heavy=by_col)) == rows_of(al.gram_blocks(parted))
