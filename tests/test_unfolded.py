"""Tables with a row per device period or per branch and bus are never the broadcast side."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import network as n
from gridloom.operators import physical as p


@pytest.fixture
def adaptive_off(spark):
    """Plans as they are made from the estimates alone."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df):
    return str(df._jdf.queryExecution().executedPlan())


def periods(df):
    return df.withColumn("period", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))


def devices(spark):
    device = spark.range(20).select((F.col("id") % 2).alias("case_id"), F.col("id").alias("pos"))
    output = periods(device).withColumn("output", F.col("pos") + F.col("period") * 10.0)
    renewable = periods(device.where("pos < 18")).select("*", F.lit(5.0).alias("min_mw"), F.lit(20.0).alias("max_mw"))
    return output, renewable


def test_device_periods_are_not_broadcast(adaptive_off):
    output, renewable = devices(adaptive_off)
    found = p.violation_renewable(output, renewable)
    assert "Broadcast" not in plan(found)
    assert found.count() >= 2 * 18 * 4


def test_spilled_output_is_not_broadcast(adaptive_off, table):
    output, renewable = devices(adaptive_off)
    gen = table("case_id bigint, pos bigint, slope double, constant double", [(0, 0, 2.0, 1.0)])
    dispatch = table("case_id bigint, pos bigint, period bigint, p_g double", [(0, 0, 0, 3.0)])
    store = table("case_id bigint, pos bigint, charge_eff double, discharge_eff double", [(0, 0, 1.0, 1.0)])
    moved = table("case_id bigint, pos bigint, charge double, discharge double", [(0, 0, 1.0, 1.0)])
    found = p.direct_objective(dispatch, gen, output.where("pos < 18"), renewable, moved, store)
    spill = [c for c in plan(found).split("Join") if "period" in c and "BuildRight" in c]
    assert not spill
    want = sum(20.0 - (pos + t * 10.0) for pos in range(0, 18, 2) for t in range(4)) + 7.0
    assert {r.case_id: r.direct_objective for r in found.collect()}[0] == want


def test_factors_are_not_broadcast(adaptive_off, table):
    ptdf = adaptive_off.range(6).select(
        F.lit(0).cast("bigint").alias("case_id"), F.col("id").alias("branch_id"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("bus_id"),
    ).withColumn("value", F.col("bus_id") + 1.0)
    injection = table(
        "case_id bigint, bus_id bigint, period bigint, mw double", [(0, b, 0, 2.0) for b in range(3)]
    ).groupBy("case_id", "bus_id", "period").agg(F.sum("mw").alias("mw"))
    offset = table("case_id bigint, branch_id bigint, mw double", [(0, 1, 0.5)])
    adaptive_off.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    flows = n.flows_from_injections(ptdf, injection, offset)
    text = plan(flows)
    # the factors stream: what is broadcast are the settled injections and the offsets
    assert "BuildLeft" not in text and "gridloom-" in text
    assert {r.branch_id: r.mw for r in flows.collect()} == {b: 12.0 + (0.5 if b == 1 else 0) for b in range(6)}
