"""Elimination in blocks against NumPy: whole grids, cut grids, and those left to the iteration."""

import grids
import numpy as np
import pytest

from gridloom.operators import blocks
from gridloom.operators import network as n


def mesh(case, size, seed):
    """A path with a chord at every third bus."""
    rng = np.random.default_rng(seed)
    pairs = [(i, i + 1) for i in range(size - 1)] + [(i, min(size - 1, i + 7)) for i in range(0, size - 8, 3)]
    return [
        (case, k, i, j, float(rng.uniform(0.05, 0.5)), 0.0, float(rng.uniform(-3, 3)), 0.0, True)
        for k, (i, j) in enumerate(pairs)
    ]


def truth(rows, size, mw):
    """Branch flows with bus 0 as the reference."""
    inc = np.zeros((len(rows), size))
    for k, row in enumerate(rows):
        inc[k, row[2]], inc[k, row[3]] = 1, -1
    b = np.array([100 / row[4] for row in rows])
    own = -b * np.radians([row[6] for row in rows])
    angle = np.linalg.solve((inc.T * b @ inc)[1:, 1:], (mw - inc.T @ own)[1:])
    return b * (inc[:, 1:] @ angle) + own


def solved_flows(table, direct, size=60):
    rng = np.random.default_rng(5)
    rows = mesh(1, size, 1) + mesh(2, 6, 2)
    want, needed = {}, []
    for case, n_bus in ((1, size), (2, 6)):
        mine = [r for r in rows if r[0] == case]
        for rhs in (0, 1):
            mw = rng.normal(size=n_bus)
            needed += [(case, rhs, i, float(mw[i])) for i in range(n_bus)]
            for k, v in enumerate(truth(mine, n_bus, mw)):
                want[case, rhs, k] = v
    ref = table("case_id long, ref_bus long", [(1, 0), (2, 0)])
    injection = table("case_id long, rhs long, bus_id long, mw double", needed)
    edge = n.branch_susceptance(table(grids.BRANCH, rows))
    solved = n.solve_angles(edge, ref, injection, direct=direct)
    got = {(r.case_id, r.rhs, r.branch_id): r.mw for r in solved.flow.collect()}
    assert got == {k: pytest.approx(v, abs=1e-7) for k, v in want.items()}
    assert all(r.converged for r in solved.report.collect())
    return solved.rounds


def test_small_grids_need_no_iteration(table):
    assert solved_flows(table, n.DIRECT) == 0


def test_large_grid_is_cut_into_blocks(table):
    """Blocks of 16 buses for a grid of 59 and its borders."""
    assert solved_flows(table, 16) == 0


def test_iteration_alone(table):
    assert solved_flows(table, 0, 20) > 0


def test_what_cannot_be_cut_is_iterated(table):
    """Every bus of a full graph meets every other: blocks of four buses would all be border."""
    size = 12
    rng = np.random.default_rng(9)
    pairs = [(i, j) for i in range(size) for j in range(i)]
    rows = [(1, k, i, j, float(rng.uniform(0.1, 0.5)), 0.0, 0.0, 0.0, True) for k, (i, j) in enumerate(pairs)]
    mw = rng.normal(size=size)
    needed = [(1, 0, i, float(mw[i])) for i in range(size)]
    ref = table("case_id long, ref_bus long", [(1, 0)])
    injection = table("case_id long, rhs long, bus_id long, mw double", needed)
    edge = n.branch_susceptance(table(grids.BRANCH, rows))
    solved = n.solve_angles(edge, ref, injection, with_shift=False, direct=4)
    flow = {r.branch_id: r.mw for r in solved.flow.collect()}
    want = truth(rows, size, mw)
    assert solved.rounds > 0 and [flow[k] for k in range(len(rows))] == pytest.approx(list(want), abs=1e-7)


def test_island_without_rows_has_no_answer(table):
    """Two islands, injections in one: as in the iteration, the other has no flow."""
    rows = [(1, 0, 0, 1, 0.1, 0.0, 0.0, 0.0, True), (1, 1, 5, 6, 0.1, 0.0, 0.0, 0.0, True)]
    edge = n.branch_susceptance(table(grids.BRANCH, rows))
    ref = table("case_id long, ref_bus long", [(1, 0)])
    one = table("case_id long, rhs long, bus_id long, mw double", [(1, 0, 1, 3.0)])
    for direct in (0, n.DIRECT):
        flow = n.solve_angles(edge, ref, one, with_shift=False, direct=direct).flow
        assert [(r.branch_id, pytest.approx(r.mw)) for r in flow.collect()] == [(0, -3.0)]


def test_parts_stay_within_the_limit(table):
    cells = [(1, i, i, 2.0) for i in range(100)] + [(1, i, j, -1.0) for i in range(100) for j in (i - 1, i + 1) if 0 <= j < 100]
    parts = blocks.joined_parts(table("case_id long, i long, j long, value double", cells), 8)
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert sum(sizes) == 100 and 2 < max(sizes) <= 8


def test_cases_with_names(table):
    """Case files name their cases with text."""
    matrix = table("case_id string, i long, j long, value double", [("k", 1, 1, 2.0)])
    given = table("case_id string, rhs long, i long, mw double", [("k", 0, 1, 3.0)])
    assert [tuple(r) for r in blocks.settled_answers(matrix, given, 4).collect()] == [("k", 0, 1, 1.5)]
