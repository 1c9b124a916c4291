"""Norms, residuals, scaling and spectral bounds on small matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import grids
from gridloom.operators import algebra as al
from gridloom.operators import scaling as sc


def coo(table, matrix, block="A2", case=1):
    return table(grids.A, [(case, block, i, j, float(v)) for i, line in enumerate(matrix) for j, v in enumerate(line) if v])


def test_known_solutions_have_no_residual(table):
    lp = grids.program_tables(table)
    for r in al.residual_summary(*lp).collect():
        assert r.kkt_combined_norm == pytest.approx(0, abs=1e-12) and r.stopping.all_satisfied
    values = {r.case_id: r.objective for r in al.objective(lp[3], lp[2]).collect()}
    assert values == {k: pytest.approx(v[-1]) for k, v in grids.PROGRAMS.items()}
    worst = al.max_primal_violation(lp[0], lp[1], lp[2], lp[3]).collect()
    assert max(r.overall for r in worst) == pytest.approx(0, abs=1e-12)


def test_residual_signs_off_the_solution(table):
    lp = grids.program_tables(table, {1: (1.6, 0.8, 0)})
    found = al.kkt_residual(*lp).where("case_id = 1 and part = 'dual'")
    assert {(r.block, round(r.value, 12)) for r in found.collect()} == {("A1", 0.0), ("A2", -0.2), ("A2", 0.0)}
    violation = al.max_primal_violation(lp[0], lp[1], lp[2], lp[3]).where("case_id = 1").first()
    assert violation.inequality == pytest.approx(0.2)


def test_ruiz_and_pock_chambolle_steps(table):
    step = sc.scale_step(coo(table, [[4, 0, 1], [0, 9, 0]]), "ruiz")
    assert {r.row: r.scale for r in step.row_scale.collect()} == {0: 2, 1: 3}
    assert {r.col: r.scale for r in step.col_scale.collect()} == {0: 2, 1: 3, 2: 1}
    assert {(r.row, r.col): r.value for r in step.a.collect()} == {(0, 0): 1, (0, 2): 0.5, (1, 1): 1}
    step = sc.pock_chambolle(coo(table, [[4, 1], [0, 9]]))
    assert [r.scale for r in step.row_scale.orderBy("row").collect()] == pytest.approx([math.sqrt(5), 3])
    assert [r.scale for r in step.col_scale.orderBy("col").collect()] == pytest.approx([2, math.sqrt(10)])


def test_precondition_round_trip(table):
    a, row_vec, col_vec, x, y = grids.program_tables(table)
    full = sc.precondition(a, 3)
    rows, cols, meta = sc.normalize_rhs_cost(row_vec, col_vec, full.row_scale, full.col_scale)
    back_a, back_rows, back_cols = sc.recover_lp(full.a, rows, cols, full.row_scale, full.col_scale, meta)
    for got, want, keys in ((back_a, a, "value"), (back_rows, row_vec, "b"), (back_cols, col_vec, "upper")):
        left, right = sorted(map(tuple, got.collect())), sorted(map(tuple, want.select(got.columns).collect()))
        for one, two in zip(left, right, strict=True):
            assert [v for v in one if isinstance(v, float)] == pytest.approx([v for v in two if isinstance(v, float)])
        assert keys in got.columns
    there = sc.scale_state(x, y, full.row_scale, full.col_scale, meta)
    home = sc.recover_state(*there, full.row_scale, full.col_scale, meta)
    assert sorted(r.x for r in home[0].collect()) == pytest.approx(sorted(r.x for r in x.collect()))
    scaled = al.residual_summary(full.a, rows, cols, *there)
    assert max(r.kkt_combined_norm for r in scaled.collect()) == pytest.approx(0, abs=1e-12)
    check = sc.verify_diagonal_scaling(a, full.a, full.row_scale, full.col_scale)
    assert all(r.passed for r in check.collect())
    broken = full.a.withColumn("value", F.when(F.col("row") == 0, F.col("value") * 1.01).otherwise(F.col("value")))
    assert not any(r.passed for r in sc.verify_diagonal_scaling(a, broken, full.row_scale, full.col_scale).collect())


def test_norm_summary_of_zero_and_empty(table):
    norms = table("case_id long, row long, max_abs double", [(1, 0, 0.0), (1, 1, 4.0), (2, 0, 0.0)])
    got = {r.case_id: r for r in sc.norm_summary(norms, "max_abs", "row").collect()}
    assert (got[1].zero_count, got[1].minimum_positive) == (1, 4.0)
    assert got[2].minimum_positive is None


def test_spectral_bounds_enclose_the_norm(table):
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(6, 4)).round(3)
    a = coo(table, matrix)
    exact = np.linalg.norm(matrix, 2) ** 2
    bounds, rayleigh, collatz = al.spectral_bounds(a), al.power_iteration(a, 40), al.collatz_bound(a, 6)
    assert rayleigh.first().rayleigh == pytest.approx(exact, rel=1e-6)
    assert collatz.first().bound >= exact
    certificate = al.spectral_certificate(bounds, rayleigh, collatz).first()
    assert certificate.safe and certificate.lambda_used >= exact


def test_power_iteration_leaves_the_null_space(table):
    """A start vector that the matrix sends to zero is replaced."""
    probe = coo(table, [[1, 1]])
    start = {r.col: r.x for r in al.start_vector(probe, -1.0, 1.0).collect()}
    a = coo(table, [[start[1], -start[0]]])
    got = al.power_iteration(a, 5).first()
    assert got.rayleigh == pytest.approx(start[0] ** 2 + start[1] ** 2)


def test_coo_patterns(table):
    from gridloom.operators import assemble as asm

    unit = table(grids.A, [(1, "A2", 0, 0, 2.0)])
    dense = {
        "ones": [[2, 2, 2]],
        "difference": [[-2, 2, 0], [0, -2, 2]],
        "lower": [[2, 0, 0], [2, 2, 0], [2, 2, 2]],
    }
    for name, want in dense.items():
        got = {(r.row, r.col): r.value for r in asm.coo_kron(name, unit, 3, 1, 1).collect()}
        assert got == {(i, j): v for i, line in enumerate(want) for j, v in enumerate(line) if v}
