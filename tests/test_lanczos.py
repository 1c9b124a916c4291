"""Lanczos' recurrence against exact singular values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import grids
from gridloom.operators.lanczos import lanczos, ritz_residual, ritz_value


def entries(case, matrix):
    return [(case, "A2", i, j, float(v)) for i, line in enumerate(matrix) for j, v in enumerate(line) if v]


def test_ritz_values_of_tridiagonal_matrices(table):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for key in range(40):
        n = 1 + key % 9
        alphas, betas = rng.uniform(0, 5, n), rng.uniform(0.01, 3, n)
        if key % 4 == 0:
            alphas = alphas * 0 + 2  # ties on the diagonal
        full = np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1)
        values, vectors = np.linalg.eigh(full)
        want[key] = (values[-1], betas[-1] * abs(vectors[-1, -1]))
        rows.append((key, alphas.tolist(), betas.tolist()))
    df = table("k int, alphas array<double>, betas array<double>", rows)
    df = df.withColumn("value", ritz_value(F.col("alphas"), F.col("betas")))
    df = df.withColumn("residual", ritz_residual(F.col("alphas"), F.col("betas"), F.col("value")))
    for r in df.collect():
        assert r.value == pytest.approx(want[r.k][0], rel=1e-12)
        assert r.residual == pytest.approx(want[r.k][1], rel=1e-6, abs=1e-12)


def test_cases_converge_by_themselves(table):
    rng = np.random.default_rng(2)
    dense = rng.normal(size=(9, 6)).round(3)
    chain = np.eye(30) - np.eye(30, k=1)  # its largest values lie close together
    rows = entries(1, dense) + entries(2, [[3, 4]]) + entries(3, chain) + [(4, "A1", 0, 0, 0.0)]
    rows += [(5, "A1", 0, 0, 1.0), (5, "A1", 0, 1, None), (6, "A1", 0, 0, float("inf"))]
    got = {r.case_id: r for r in lanczos(table(grids.A, rows), 7, 1e-9).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    exact = np.linalg.norm(dense, 2) ** 2
    assert got[1].converged and got[1].steps <= 7 and got[1].rayleigh == pytest.approx(exact, rel=1e-10)
    assert got[2].converged and got[2].steps == 1 and got[2].rayleigh == pytest.approx(25)
    values = np.linalg.svd(chain, compute_uv=False) ** 2
    assert not got[3].converged and got[3].steps == 7 and got[3].residual > 1e-9 * got[3].rayleigh
    assert min(abs(values - got[3].rayleigh)) <= got[3].residual
    assert (got[4].rayleigh, got[4].residual, got[4].converged, got[4].steps) == (0, 0, True, 0)
    for case in (5, 6):
        assert got[case].rayleigh is None and not got[case].converged
