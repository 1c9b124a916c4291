"""Rows are dealt to all tasks before each makes many, and a bound has no row per branch and device."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import assemble as m
from gridloom.operators import network as n
from gridloom.plans.bindings import Tables

PLACED = "case_id bigint, device string, pos bigint, bus_id bigint"
BOX = "case_id bigint, device string, pos bigint, max_abs double"


def plan(df):
    return str(df._jdf.queryExecution().executedPlan())


def test_customers_are_dealt_before_their_factors_unfold(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    factors = Tables(spark, str(tmp_path)).ptdf()
    assert "REPARTITION_BY_NUM" in plan(factors)
    assert factors.count() == 1000


def test_devices_are_dealt_before_they_meet_the_lines(spark, table):
    dims = table(
        "case_id bigint, periods bigint, n_gen bigint, n_rg bigint, n_ess bigint, n_line bigint, c_p_g bigint,"
        " c_p_rg bigint, c_p_ess_dc bigint, c_p_ess_ch bigint, r_line_lower bigint, r_line_upper bigint",
        [(0, 1, 2, 0, 0, 1, 0, 2, 2, 2, 0, 1)],
    )
    ptdf = table("case_id bigint, line_pos bigint, bus_id bigint, value double", [(0, 0, 7, 0.5)])
    devices = table(PLACED, [(0, "gen", 0, 7), (0, "gen", 1, 7), (0, "gen", 2, 8)])
    lines = table("case_id bigint, line_pos bigint, limit_mw double", [(0, 0, 9.0)])
    flow = table("case_id bigint, line_pos bigint, period bigint, mw double", [(0, 0, 0, 1.0)])
    entries, _ = m.rows_line_flow(dims, ptdf, devices, lines, flow)
    assert "REPARTITION_BY_NUM" in plan(entries)
    assert sorted((r.row, r.col, r.value) for r in entries.collect()) == [
        (0, 0, 0.5), (0, 1, 0.5), (1, 0, -0.5), (1, 1, -0.5)
    ]


def test_bound_of_a_bus_is_that_of_its_devices(table):
    placed = table(PLACED, [(0, "gen", 0, 7), (0, "gen", 1, 7), (0, "gen", 1, 8), (0, "ess", 0, 8), (0, "gen", 9, 7)])
    box = table(BOX, [(0, "gen", 0, 2.0), (0, "gen", 1, 3.0), (0, "gen", 1, 4.0), (0, "ess", 0, None)])
    ptdf = table(
        "case_id bigint, branch_id bigint, bus_id bigint, value double", [(0, 5, 7, -0.5), (0, 5, 8, 0.25), (0, 6, 7, 1.0)]
    )
    branch = table("case_id bigint, branch_id bigint, rate_mw double", [(0, 5, 0.0), (0, 6, 2.5), (0, 4, 0.0)])
    flow = table("case_id bigint, branch_id bigint, mw double", [(0, 5, -1.5), (0, 6, 1.0)])
    one = n.derived_line_limit(branch, n.compress_ptdf(ptdf, placed), flow, box)
    place, reach = n.box_by_bus(placed, box)
    factors = n.compress_ptdf(ptdf, place)
    assert factors.count() == 3  # a row per branch and bus, not per device
    two = n.derived_line_limit(branch, factors, flow, reach)
    got, want = ({r.branch_id: (r.limit_mw, r.bound) for r in df.collect()} for df in (two, one))
    assert got.keys() == want.keys()
    for key in got:
        assert got[key][0] == pytest.approx(want[key][0], rel=1e-14)
        assert (got[key][1] or 0.0) == pytest.approx(want[key][1] or 0.0, rel=1e-14)
    assert got[5][1] >= 0.5 * (2 + 3 + 4) + 0.25 * (3 + 4) + 1.5
