"""Whole models from case text and configuration: dimensions, entries and dispatch."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import grids
from gridloom.operators import algebra as al
from gridloom.operators import assemble as asm
from gridloom.operators import derive as d
from gridloom.operators import iterate as it
from gridloom.operators import network as n
from gridloom.operators import physical as ph
from gridloom.schemas import OPERATING_CONFIG, with_corrupt
from gridloom.session import settle
from gridloom.sources import casefiles, configs


def config_tables(spark, table, config, case):
    raw = table("case_id string, text string", [(case, json.dumps(config))])
    parsed = raw.select("case_id", F.from_json("text", with_corrupt(OPERATING_CONFIG)).alias("c"))
    return configs.unfold_config(parsed.select("case_id", "c.*"))


BUILT = {}


def model(spark, table, text, config):
    """Each model is built once; its factors and tables are shared by the tests."""
    key = (text[:30], config["name"])
    if key not in BUILT:
        BUILT[key] = build(spark, table, text, config)
    return BUILT[key]


def build(spark, table, text, config, case="k"):
    """Limited active branches only, as in the strict model."""
    grid = casefiles.parse_case_text(table("path string, value string", [(case, text)]))
    setting = config_tables(spark, table, config, case)
    assert grid.rejects.count() == 0 and setting.rejects.count() == 0
    edge = n.branch_susceptance(grid.branch.withColumn("branch_id", F.col("branch_pos")), grid.case_meta)
    ref = grid.bus.where("bus_type = 3").select("case_id", F.col("bus_id").alias("ref_bus"))
    gen = d.linear_cost_terms(grid.gen).join(setting.gen_ramp, ["case_id", "gen_pos"])
    gen = gen.withColumn("lower_mw", F.col("min_mw")).withColumn("upper_mw", F.col("max_mw"))
    limited = grid.branch.where("status and rate_mw > 0 and rate_mw < 1e10")
    from gridloom.functions.ordered import position

    lines = position(limited, ["case_id"], "branch_pos", "line_pos").select(
        "case_id", "line_pos", F.col("branch_pos").alias("branch_id"), F.col("rate_mw").alias("limit_mw")
    )
    buses = grid.bus.where("bus_type <> 3").select("case_id", "bus_id")
    ptdf = n.shift_factor_columns(edge, ref, buses)
    offset = n.flow_offset(edge, ref)
    shift = n.shift_vector(
        edge, ref, d.bus_demand(grid.bus).select("case_id", "bus_id", F.col("withdrawal_mw").alias("mw"))
    )
    fixed = n.fixed_flow(offset, shift, setting.period_profile)
    place = lines.select("case_id", "branch_id", "line_pos")
    horizon = setting.config.select("case_id", "periods")
    load = d.expand_load(grid.bus, horizon, setting.period_profile)
    penalty = setting.config.first()
    ptdf, fixed, offset = settle(ptdf), settle(fixed), settle(offset)
    lp = asm.build_lp_tables(
        gen, setting.renewable_profile, setting.storage, lines, ptdf.join(place, ["case_id", "branch_id"]),
        fixed.join(place, ["case_id", "branch_id"]), load, setting.period_profile,
        penalty.interval_hours, penalty.renewable_penalty, penalty.storage_penalty,
    )
    return grid, setting, lp, gen, load, ptdf, offset, ref


@pytest.mark.parametrize(
    ("config", "sizes", "entries"),
    [(grids.BASE_CONFIG, (15, 1, 16), (5, 46)), (grids.TWO_PERIODS, (36, 3, 46), (20, 148))],
)
def test_ring_dimensions(spark, table, config, sizes, entries):
    _, _, lp, *_ = model(spark, table, grids.RING5, config)
    check = asm.check_lp_dimensions(lp).first()
    assert check.passed and (check.n, check.m1, check.m2) == sizes
    nnz = lp.a.groupBy("block").count().orderBy("block").collect()
    assert tuple(r["count"] for r in nnz) == entries
    assert lp.constraint_row.count() == sizes[1] + sizes[2]
    families = {r.family for r in lp.constraint_row.where("block = 'A1'").collect()}
    assert families <= {"power_balance", "storage_terminal_energy"}


TWO_BUS = """function mpc = twobus
mpc.baseMVA = 100;
mpc.bus = [205 1 95 0 5 0 1 1 0 1 1 1 1; 101 3 0 0 0 0 1 1 0 1 1 1 1];
mpc.gen = [205 40 0 0 0 1 100 1 200 0; 101 60 0 0 0 1 100 1 200 0];
mpc.branch = [101 205 0 0.1 0 60 0 0 0 0 1];
mpc.gencost = [2 0 0 2 30 7; 2 0 0 2 10 5];
"""


def test_congested_two_buses(spark, table):
    config = {**grids.BASE_CONFIG, "generator_ramp_up_mw_per_hour": [0.0] * 2, "generator_ramp_down_mw_per_hour": [0.0] * 2}
    grid, setting, lp, gen, load, ptdf, offset, ref = model(spark, table, TWO_BUS, config)
    cols = d.variable_index(lp.dims)
    value = F.when(F.col("kind") != "p_g", 0.0).when(F.col("pos") == 0, 40.0).otherwise(60.0)
    state = cols.select("case_id", "col", value.alias("x"), F.lit(0.0).alias("z"))
    worst = al.max_primal_violation(lp.a, lp.row_vec, lp.col_vec, state).first()
    assert worst.overall == pytest.approx(0, abs=1e-9)
    assert al.objective(state, lp.col_vec, lp.constant).first().objective == pytest.approx(1812.0)
    dispatch = d.unpack_state(state, lp.dims).where("device = 'gen'").fillna(0.0)
    placed = dispatch.join(gen.select("case_id", F.col("gen_pos").alias("pos"), "bus_id"), ["case_id", "pos"])
    injection = d.bus_injections(load, [(placed, "p_g", 1.0)])
    assert {r.bus_id: r.mw for r in injection.collect()} == {205: -60.0, 101: 60.0}
    flow = n.flows_from_injections(ptdf, injection, offset)
    assert flow.first().mw == pytest.approx(60.0)
    branch = grid.branch.withColumn("branch_id", F.col("branch_pos"))
    devices = gen.withColumn("pos", F.col("gen_pos"))
    parts = [
        ph.violation_power_balance([(dispatch, "p_g", 1.0)], load),
        ph.violation_line_flow(flow, branch),
        ph.violation_generator_bounds(dispatch, devices),
        ph.violation_reserve_bounds(dispatch, devices),
        ph.violation_headroom(dispatch, devices),
        ph.violation_reserve_requirement(dispatch, setting.period_profile),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    families = ph.family_summary(union).collect()
    assert len(families) == 6 and all(f.passed for f in families)
    tampered = dispatch.withColumn("p_g", F.col("p_g") + F.when(F.col("pos") == 0, 2.0).otherwise(0.0))
    off = ph.family_summary(ph.violation_power_balance([(tampered, "p_g", 1.0)], load)).first()
    assert not off.passed and off.max_violation == pytest.approx(2.0)


def tiny(table):
    gen = table(
        "case_id long, gen_pos long, bus_id long, status boolean, max_mw double, min_mw double, ramp_up double, ramp_down double",
        [(1, 0, 1, True, 200.0, 0.0, 0.0, 0.0), (1, 1, 2, False, 100.0, 0.0, 0.0, 0.0), (1, 2, 3, True, 150.0, 0.0, 0.0, 0.0)],
    )
    bus = table("case_id long, bus_id long, demand_mw double, shunt_mw double", [(1, 1, 50.0, 0.0), (1, 2, 60.0, 0.0), (1, 3, 40.0, 0.0)])
    spec = table("case_id long, renewables long, storage long", [(1, 2, 1)])
    return gen, bus, spec


def test_placed_resources_and_row_families(table):
    gen, bus, spec = tiny(table)
    placed = d.place_resources(gen, spec)
    got = {(r.kind, r.pos): (r.bus_id, r.resource_id) for r in placed.collect()}
    assert got == {
        ("renewable", 0): (1, "rg_0001_bus_1"),
        ("renewable", 1): (2, "rg_0002_bus_2"),
        ("storage", 0): (1, "ess_0001_bus_1"),
    }
    sized = d.size_resources(placed, d.base_load(bus), spec)
    tops = {r.kind: r.s for r in sized.groupBy("kind").agg(F.sum("max_mw").alias("s")).collect()}
    assert tops == {"renewable": pytest.approx(15.0), "storage": pytest.approx(1.5)}
    ramps = [r.ramp_up for r in d.size_ramps(gen).orderBy("gen_pos").collect()]
    assert ramps == pytest.approx([20.0, 0.0, 15.0])
    dims = d.with_offsets(
        table("case_id long, periods long, n_gen long, n_rg long, n_ess long, n_line long", [(1, 2, 3, 2, 1, 3)])
    )
    first = dims.first()
    assert (first.n, first.m1, first.m2, first.m) == (26, 3, 38, 41)
    families = d.row_families(dims)
    assert {r.block: r["count"] for r in families.groupBy("block").count().collect()} == {"A1": 2, "A2": 10}
    rows = {(r.block, r.row): r for r in d.expand_row_families(families).collect()}
    assert len(rows) == 41 and rows["A2", 0].family == "line_flow" and rows["A2", 37].family == "storage_energy"
    assert rows["A1", 2].period is None
    asked = table("case_id long, block string, row long", [(1, b, i) for b, i in rows] + [(1, "A2", 38)])
    for chunk in (1, 5, 1000):
        found = d.lookup_row_family(asked, families, chunk).collect()
        assert {(r.block, r.row): r.asDict() for r in found} == {k: r.asDict() for k, r in rows.items()}


# name -> buses, branches, generators, renewables, storage; horizon -> m, n
SIZES = {
    "a": ((1354, 1991, 260, 136, 68), {4: (20192, 4208), 16: (82124, 16832), 48: (247276, 50496), 96: (495004, 100992)}),
    "b": (
        (2868, 3808, 600, 286, 143),
        {
            4: (40163, 9488), 16: (163823, 37952), 48: (493583, 113856), 56: (576023, 132832), 64: (658463, 151808),
            72: (740903, 170784), 80: (823343, 189760), 88: (905783, 208736), 96: (988223, 227712),
        },
    ),
    "c": (
        (9241, 16049, 1445, 920, 460),
        {4: (152774, 24700), 6: (230376, 37050), 16: (618386, 98800), 24: (928794, 148200), 32: (1239202, 197600)},
    ),
}


def test_published_dimensions(table):
    rows = [(k, t, *counts) for k, (counts, horizons) in SIZES.items() for t in horizons]
    spec = table(
        "case_id string, periods long, buses long, branches long, generators long, renewables long, storage long", rows
    )
    got = d.expected_dimensions(spec).collect()
    assert len(got) == 18
    for r in got:
        assert (r.m, r.n) == SIZES[r.case_id][1][r.periods]


def fleet(spark, table):
    _, setting, lp, *_ = model(spark, table, grids.RING5, grids.TWO_PERIODS)
    if "fleet" not in BUILT:
        BUILT["fleet"] = it.Problem(settle(lp.a), settle(lp.row_vec), settle(lp.col_vec))
    return BUILT["fleet"], lp.dims, setting.storage


def dense(lp):
    """NumPy twins of one case."""
    cols = sorted(lp.col_vec.collect(), key=lambda r: r.col)
    rows = {b: sorted((r for r in lp.row_vec.collect() if r.block == b), key=lambda r: r.row) for b in ("A1", "A2")}
    a = {b: np.zeros((len(rows[b]), len(cols))) for b in rows}
    for e in lp.a.collect():
        a[e.block][e.row, e.col] = e.value
    vec = {k: np.array([getattr(r, k) for r in cols]) for k in ("c", "lower", "upper")}
    b = {k: np.array([r.b for r in v]) for k, v in rows.items()}
    return a["A1"], a["A2"], b["A1"], b["A2"], vec["c"], vec["lower"], vec["upper"]


def one_step(program, x, y1, y2, anchor, k, sigma, lam):
    a1, a2, b1, b2, c, low, high = program
    gram = a1 @ a1.T
    r = x + sigma * (a1.T @ y1 + a2.T @ y2 - c)
    xb = np.clip(r, low, high)
    zb = (xb - r) / sigma
    half = np.linalg.solve(gram, (b1 - a1 @ (xb + sigma * (a2.T @ y2 + zb - c))) / sigma)
    y2b = np.maximum(y2 + (b2 / sigma - a2 @ (xb / sigma + a1.T @ half + a2.T @ y2 + zb - c)) / lam, 0)
    y1b = np.linalg.solve(gram, (b1 - a1 @ (xb + sigma * (a2.T @ y2b + zb - c))) / sigma)
    after = [
        a / (k + 2) + (k + 1) / (k + 2) * (2 * new - old)
        for a, new, old in zip(anchor, (xb, y1b, y2b), (x, y1, y2), strict=True)
    ]
    return (xb, zb, y1b, y2b), after


def test_steps_against_numpy(spark, table):
    lp, dims, storage = fleet(spark, table)
    program = dense(lp)
    case = dims.first().case_id
    solve = it.structural_solver(dims, storage)
    lam = float(np.linalg.norm(program[1], 2) ** 2 * 1.01)
    control = table("case_id string, sigma double, lambda_used double", [(case, 0.7, lam)])
    state = it.zero_state(lp)
    anchor = state
    x, y1, y2 = (np.zeros(s) for s in (program[4].size, program[2].size, program[3].size))
    start = (x, y1, y2)
    for k in range(2):
        step = it.sgs_step(lp, state, anchor, k, control, solve)
        want, (x, y1, y2) = one_step(program, x, y1, y2, start, k, 0.7, lam)
        cols = sorted(step.proximal.col.collect(), key=lambda r: r.col)
        assert [r.x for r in cols] == pytest.approx(want[0], abs=1e-7)
        assert [r.z for r in cols] == pytest.approx(want[1], abs=1e-7)
        rows = {b: [r.y for r in sorted(step.proximal.row.collect(), key=lambda r: r.row) if r.block == b] for b in ("A1", "A2")}
        assert rows["A1"] == pytest.approx(want[2], abs=1e-7) and rows["A2"] == pytest.approx(want[3], abs=1e-7)
        after = sorted(step.next_state.col.collect(), key=lambda r: r.col)
        assert [r.x for r in after] == pytest.approx(x, abs=1e-7)
        note = step.evidence.first()
        assert note.first_relative < 1e-10 and note.zx_identity_error < 1e-9
        state = step.next_state


def test_equality_solve_and_metric_against_dense(spark, table):
    lp, dims, storage = fleet(spark, table)
    a1, a2, *_ = program = dense(lp)
    case = dims.first().case_id
    solve = it.structural_solver(dims, storage)
    rng = np.random.default_rng(7)
    rhs = rng.normal(size=a1.shape[0])
    got = solve(table("case_id string, row long, value double", [(case, i, float(v)) for i, v in enumerate(rhs)]))
    want = np.linalg.solve(a1 @ a1.T, rhs)
    assert [r.y for r in sorted(got.collect(), key=lambda r: r.row)] == pytest.approx(want, abs=1e-12)
    dy = [rng.normal(size=a.shape[0]) for a in (a1, a2)]
    dx = rng.normal(size=a1.shape[1])
    rows = [(case, b, i, float(v)) for b, vec in zip(("A1", "A2"), dy, strict=True) for i, v in enumerate(vec)]
    delta_row = table("case_id string, block string, row long, y double", rows)
    delta_col = table("case_id string, col long, x double", [(case, j, float(v)) for j, v in enumerate(dx)])
    lam, sigma = float(np.linalg.norm(a2, 2) ** 2), 1.7
    control = table("case_id string, sigma double, lambda_used double", [(case, sigma, lam)])
    first = a1 @ (a1.T @ dy[0] + a2.T @ dy[1])
    quadratic = first @ np.linalg.solve(a1 @ a1.T, first) + lam * dy[1] @ dy[1]
    assert it.metric_quadratic(lp, delta_row, control, solve).first().quadratic == pytest.approx(quadratic)
    cross = (a1 @ dx) @ dy[0] + (a2 @ dx) @ dy[1]
    merit = np.sqrt(dx @ dx / sigma + 2 * cross + sigma * quadratic)
    assert it.restart_merit(lp, delta_col, delta_row, control, solve).first().merit == pytest.approx(merit)
    assert len(program) == 7


def test_short_runs_approach_the_known_solutions(table):
    a, row_vec, col_vec, *_ = grids.program_tables(table)
    lp = it.Problem(a, row_vec, col_vec)
    control = table("case_id long, sigma double, lambda_used double", [(k, 1.0, 3.5) for k in grids.PROGRAMS])
    state, log = it.run_steps(lp, 8, control, it.orthogonal_solver(a), interval=3)
    assert sorted({r.iteration for r in log.collect()}) == [1, 3, 6, 8]
    norms = {(r.case_id, r.iteration): r.kkt_combined_norm for r in log.collect()}
    for case in grids.PROGRAMS:
        assert norms[case, 8] < 0.6 * norms[case, 1] + 1e-9
    assert state.col.count() == 10
