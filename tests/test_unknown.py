"""Unknown values (null, NaN, rows that are not there) never pass for 0."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import algebra as al
from gridloom.operators import benchstats as bs
from gridloom.operators import physical as p
from gridloom.operators import quality as q
from gridloom.operators import scaling as sc

A = "case_id long, block string, row long, col long, value double"
NAN = float("nan")


@pytest.fixture
def lp(table):
    a = table(A, [(1, "A1", 0, 0, 1.0), (1, "A1", 0, 1, 1.0), (1, "A2", 0, 1, 2.0)])
    rows = table("case_id long, block string, row long, b double", [(1, "A1", 0, 5.0), (1, "A2", 0, 1.0)])
    cols = table(
        "case_id long, col long, c double, lower double, upper double",
        [(1, 0, 1.0, 0.0, 9.0), (1, 1, 1.0, 0.0, 9.0)],
    )
    return a, rows, cols


def state(table, *xs):
    rows = [(1, i, x, 0.5) for i, x in enumerate(xs) if x != "absent"]
    return table("case_id long, col long, x double, z double", rows)


def duals(table, *ys):
    return table("case_id long, block string, row long, y double", [(1, b, 0, y) for b, y in zip(("A1", "A2"), ys)])


@pytest.mark.parametrize("x", [None, NAN, "absent"])
def test_primal_violation(table, lp, x):
    found = al.max_primal_violation(*lp, state(table, 2.0, x)).first()
    assert [found[n] for n in ("equality", "inequality", "lower", "upper", "overall")] == [None] * 5
    found = al.max_primal_violation(*lp, state(table, x, 2.0)).first()
    assert found.equality is None and found.inequality == 0.0 and found.overall is None
    none = state(table).limit(0)
    assert al.max_primal_violation(*lp, none).first().overall is None


def test_primal_violation_of_a_known_state(table, lp):
    found = al.max_primal_violation(*lp, state(table, 2.0, 10.0)).first()
    assert tuple(found)[1:] == (7.0, 0.0, 0.0, 1.0, 7.0)
    only_cols = al.max_primal_violation(lp[0].limit(0), lp[1].limit(0), lp[2], state(table, 2.0, 3.0)).first()
    assert tuple(only_cols)[1:] == (0.0, 0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("x, y", [(None, 1.0), (NAN, 1.0), ("absent", 1.0), (1.0, None), (1.0, NAN), (None, None)])
def test_residuals(table, lp, x, y):
    found = al.residual_summary(*lp, state(table, x, x), duals(table, y, y), tolerance=1e300).first()
    assert found.kkt_combined_norm is None and not found.stopping.all_satisfied
    flat = al.stopping_residual(*lp, state(table, x, x), duals(table, y, y), tolerance=1e300).first()
    assert not (flat.primal_ok and flat.box_ok and flat.stationarity_ok)


def test_residuals_of_a_known_state_and_of_an_absent_multiplier(table, lp):
    full = al.residual_summary(*lp, state(table, 2.0, 3.0), duals(table, 0.0, 0.0), tolerance=1e300).first()
    assert full.stopping.all_satisfied and full.raw.primal == 0.0
    assert full.raw.stationarity == pytest.approx(math.sqrt(0.5))
    part = al.residual_summary(*lp, state(table, 2.0, 3.0), duals(table, 0.0), tolerance=1e300).first()
    assert part.kkt_combined_norm is None and not part.stopping.all_satisfied


def test_normalization(table, lp):
    rows = lp[1].withColumn("b", F.when(F.col("block") == "A1", None).otherwise(F.col("b")))
    scale_r = table("case_id long, block string, row long, scale double", [])
    scale_c = table("case_id long, col long, scale double", [])
    got, cols, meta = sc.normalize_rhs_cost(rows, lp[2], scale_r, scale_c)
    assert meta.first().b_norm is None and all(r.b is None for r in got.collect())
    assert cols.first().lower is None and cols.first().c is not None


def test_storage_energy_after_an_unknown_charge(table):
    dispatch = table(
        "case_id long, pos long, period long, charge double, discharge double",
        [(1, 0, t, None if t == 1 else 1.0, 0.0) for t in range(4)],
    )
    storage = table(
        "case_id long, pos long, initial_mwh double, charge_eff double, discharge_eff double, min_mwh double, max_mwh double",
        [(1, 0, 5.0, 1.0, 1.0, 0.0, 100.0)],
    )
    path = p.storage_energy_path(dispatch, storage, block=2)
    assert [r.energy_mwh for r in path.orderBy("period").collect()] == [6.0, None, None, None]
    worst = p.violation_storage_energy(path, storage)
    assert worst.where("value IS NULL").count() == 6


def test_ramp_gaps(table):
    dispatch = table(
        "case_id long, pos long, period long, p_g double",
        [(1, 0, 0, 0.0), (1, 0, 2, 1000.0), (1, 1, 3, 1.0), (1, 1, 4, 2.0), (1, 2, 0, 1.0), (1, 2, 5, 1.0)],
    )
    got = p.ramp_gaps(dispatch).where("side = 'up'").select("element", "period", "value").collect()
    assert sorted(map(tuple, got)) == [(0, 1, None), (0, 2, None), (2, 1, None), (2, 5, None)]


@pytest.mark.parametrize("other, want", [(None, None), (NAN, None), (2.0, 2.0)])
def test_flow_crosscheck(table, other, want):
    schema = "case_id long, branch_id long, mw double"
    got = p.flow_crosscheck(table(schema, [(1, 0, other), (1, 1, 1.0)]), table(schema, [(1, 0, 0.0)]), ["case_id", "branch_id"])
    assert got.first().max_diff == want


def test_objective_difference(table):
    direct = table("case_id long, direct_objective double", [(1, 5.0), (2, None), (3, 7.0)])
    other = table("case_id long, objective double", [(1, 5.0), (2, 5.0), (4, 1.0)])
    got = {r.case_id: (r.difference, r.passed) for r in p.objective_difference(direct, other).collect()}
    assert got == {1: (0.0, True), 2: (None, False), 3: (None, False), 4: (None, False)}


def test_errors_of_unmatched_positions(table):
    schema = "case_id long, row long, value double"
    a, b = table(schema, [(1, 0, 3.0), (2, 0, 3.0)]), table(schema, [(1, 0, 3.0), (1, 1, 4.0), (2, 0, 3.0)])
    got = {r.case_id: r for r in bs.relative_error(a, b, ["case_id", "row"], "value").collect()}
    assert got[1].relative_error is None and got[1].scaled_error is None and got[1].unmatched == 1
    assert got[2].relative_error == 0.0 and got[2].unmatched == 0
    gram = table("case_id long, r1 long, r2 long, value double", [(c, i, i, 1.0) for c in (1, 2) for i in range(3 - c)])
    found = {r.case_id: r for r in bs.solution_error_metrics(gram, b, a, b).collect()}
    assert found[1].absolute_error_l2 is None and found[1].normalized_system_residual is None
    assert found[1].unmatched == 1
    assert found[2].absolute_error_l2 == 0.0 and found[2].normalized_system_residual == 0.0


def test_drift_of_large_numbers(table):
    schema = "id long, document string"
    pairs = [("9007199254740993", "9007199254740992", True), ("1.0", "1", False), ("1e300", "1.0e300", False),
             ("1e-20", "0", True), ("100.0", "1e2", False), ("-0.5", "-0.50", False)]
    a = table(schema, [(i, '{"k": %s}' % x) for i, (x, _, _) in enumerate(pairs)])
    b = table(schema, [(i, '{"k": %s}' % y) for i, (_, y, _) in enumerate(pairs)])
    got = {r.id for r in q.contract_drift(a, b, ["id"]).collect()}
    assert got == {i for i, (_, _, differs) in enumerate(pairs) if differs}
