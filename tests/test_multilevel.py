"""The hierarchy against NumPy, and rounds that hardly grow with the grid."""

import grids
import numpy as np
import pytest

from gridloom.operators import multilevel as m
from gridloom.operators import network as n


def rows_of(df, *names):
    return [tuple(r[c] for c in names) for r in df.collect()]


def path(case, size, seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0.05, 0.5, size - 1)
    return [(case, i, i, i + 1, float(x[i]), 0.0, 0.0, 0.0, True) for i in range(size - 1)]


def test_levels_are_those_of_the_matrix(table):
    """Every level's matrix is the finest one in that level's weights; the product is A times them."""
    edge = n.branch_susceptance(table(grids.BRANCH, path(1, 12, 1) + path(2, 3, 2)))
    ref = table("case_id long, ref_bus long", [(1, 0), (2, 0)])
    built = m.build_hierarchy(n.bus_susceptance(edge, ref))
    cells = rows_of(built.cells, "case_id", "level", "node", "i", "value", "own")
    down = rows_of(built.down, "case_id", "level", "bus_id", "node", "value")
    up = rows_of(built.up, "case_id", "level", "bus_id", "node", "value", "product")
    for case, size in ((1, 12), (2, 3)):
        fine = np.zeros((size, size))
        for c, level, j, i, v, own in cells:
            if c == case and level == 0 and not own:
                fine[i, j] = v
        assert np.abs(np.linalg.eigvalsh(fine[1:, 1:])).max() <= 2 + 1e-12
        levels = sorted({r[1] for r in cells if r[0] == case})
        counts = []
        for level in levels:
            weight, coarse = np.zeros((size, size)), np.zeros((size, size))
            value, product = np.zeros((size, size)), np.zeros((size, size))
            for c, at, bus, node, v in down:
                if (c, at) == (case, level):
                    weight[bus, node] = v
            for c, at, bus, node, v, p in up:
                if (c, at) == (case, level):
                    value[bus, node], product[bus, node] = v, p
            for c, at, j, i, v, own in cells:
                if (c, at) == (case, level) and not own:
                    coarse[i, j] = v
            assert np.allclose(weight.T @ fine @ weight, coarse, atol=1e-12)
            assert np.allclose(value, weight) and np.allclose(product, fine @ weight, atol=1e-12)
            counts.append(int((np.abs(coarse).sum(0) > 0).sum()))
        assert counts == sorted(counts, reverse=True) and len(set(counts)) == len(counts)
        assert counts[0] == size - 1 and counts[-1] == 1


def test_rounds_hardly_grow(table):
    """Paths of 40 and 640 buses, each against the running sum of its flows."""
    rounds = {}
    for size in (40, 640):
        edge = n.branch_susceptance(table(grids.BRANCH, path(1, size, size)))
        ref = table("case_id long, ref_bus long", [(1, 0)])
        rng = np.random.default_rng(7)
        mw = rng.normal(size=size)
        rows = [(1, 0, i, float(mw[i])) for i in range(size)]
        injection = table("case_id long, rhs long, bus_id long, mw double", rows)
        solved = n.solve_angles(edge, ref, injection, with_shift=False)
        flow = {r.branch_id: r.mw for r in solved.flow.collect()}
        beyond = np.cumsum(mw[::-1])[::-1]
        for i in range(size - 1):
            assert flow[i] == pytest.approx(-beyond[i + 1], abs=1e-6)
        rounds[size] = solved.rounds
    assert rounds[640] <= 2 * rounds[40] and rounds[640] <= 56


def test_no_rows(table):
    edge = n.branch_susceptance(table(grids.BRANCH, []))
    ref = table("case_id long, ref_bus long", [(1, 0)])
    built = m.build_hierarchy(n.bus_susceptance(edge, ref))
    assert [part.count() for part in built] == [0, 0, 0, 0]
    injection = table("case_id long, rhs long, bus_id long, mw double", [(1, 0, 0, 5.0)])
    assert n.solve_angles(edge, ref, injection, with_shift=False).flow.count() == 0
