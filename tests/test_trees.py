"""Spanning trees, tours and the probe of both laws."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import network as n
from gridloom.operators import trees

EDGE = "case_id long, branch_id long, from_bus long, to_bus long, b_mw double, shift_rad double, shift_mw double"
INJ = "case_id long, rhs long, bus_id long, mw double"


def grids(seed):
    """Connected grids: a path, a star and a mesh with parallel branches."""
    draw, edges = random.Random(seed), []
    for case, (buses, more) in enumerate([(40, 0), (30, 0), (25, 30)]):
        order = list(range(buses))
        draw.shuffle(order)
        for i in range(1, buses):
            other = order[i - 1] if case == 0 else order[0] if case == 1 else order[draw.randrange(i)]
            edges.append((case, order[i], other))
        edges += [(case, *draw.choices(order, k=2)) for _ in range(more)]
    draw.shuffle(edges)
    return [(c, i, a, b, draw.uniform(1, 50), 0.0, 0.0) for i, (c, a, b) in enumerate(edges)]


def kruskal(edges):
    root, kept = {}, set()

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for case, branch, a, b, *_ in sorted(edges, key=lambda e: e[1]):
        x, y = find((case, a)), find((case, b))
        if x != y:
            root[x] = y
            kept.add((case, branch))
    return kept


@pytest.fixture(scope="module")
def net(spark):
    edges = grids(4)
    edge = spark.createDataFrame(edges, EDGE)
    ref = spark.createDataFrame([(c, 3) for c in range(3)], "case_id long, ref_bus long")
    return edges, edge, ref


def test_least_spanning_tree(spark, net):
    edges, edge, _ = net
    got = {(r.case_id, r.branch_id) for r in trees.spanning_tree(edge).collect()}
    assert got == kruskal(edges)
    assert trees.spanning_tree(edge.limit(0)).count() == 0
    loop = spark.createDataFrame([(0, 0, 1, 1, 1.0, 0.0, 0.0)], EDGE)
    assert trees.spanning_tree(loop).count() == 0


def test_tour_and_tree_flows(spark, net):
    edges, edge, ref = net
    tree = trees.spanning_tree(edge)
    tour = trees.euler_tour(tree, ref).collect()
    for case in range(3):
        mine = sorted((r for r in tour if r.case_id == case), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine))) and mine[0].u == 3
        assert all(a.v == b.u for a, b in zip(mine, mine[1:])) and mine[-1].v == 3
    draw = random.Random(1)
    inject = [(c, k, b, draw.uniform(-9, 9)) for c in range(3) for k in range(2) for b in range(25) if b != 3]
    flows = trees.tree_flows(trees.euler_tour(tree, ref), spark.createDataFrame(inject, INJ)).collect()
    ends = {(c, i): (a, b) for c, i, a, b, *_ in edges}
    left = {}
    for c, k, b, mw in inject:
        left[c, k, b] = left.get((c, k, b), 0) + mw
    for r in flows:
        a, b = ends[r.case_id, r.branch_id]
        left[r.case_id, r.rhs, a] = left.get((r.case_id, r.rhs, a), 0) - r.mw
        left[r.case_id, r.rhs, b] = left.get((r.case_id, r.rhs, b), 0) + r.mw
    assert all(abs(v) < 1e-9 for (c, k, b), v in left.items() if b != 3)
    assert len(flows) == 2 * len(kruskal(edges))


def test_probe(spark, net):
    _, edge, ref = net
    inject = spark.createDataFrame([(c, b, b, 1.0) for c in range(3) for b in (0, 7, 11)], INJ)
    solved = n.solve_angles(edge, ref, inject, with_shift=False).flow
    good = trees.cycle_probe(solved, edge, ref, inject).collect()
    assert len(good) == 9 and all(r.unreached == 0 for r in good)
    assert all(r.current_gap < 1e-6 and r.cycle_gap < 1e-6 for r in good)
    # flows over the tree alone keep the first law and break the second where there are cycles
    tree = trees.tree_flows(trees.euler_tour(trees.spanning_tree(edge), ref), inject)
    found = {r.case_id: r for r in trees.cycle_probe(tree, edge, ref, inject).where("rhs = 7").collect()}
    assert all(r.current_gap < 1e-9 for r in found.values())
    assert found[0].cycle_gap == found[1].cycle_gap == 0 and found[2].cycle_gap > 1e-3
    wrong = solved.withColumn("mw", F.when(F.col("rhs") == 7, F.col("mw") * 1.01).otherwise(F.col("mw")))
    found = trees.cycle_probe(wrong, edge, ref, inject).collect()
    assert all((r.current_gap > 1e-3) == (r.rhs == 7) for r in found)
    lost = solved.withColumn("mw", F.when(F.col("rhs") == 7, None).otherwise(F.col("mw")))
    found = trees.cycle_probe(lost, edge, ref, inject).collect()
    assert all((r.current_gap is None) == (r.rhs == 7) for r in found)


def test_probe_names_unreached_injections(spark, net):
    _, edge, ref = net
    inject = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 999, 5.0)], INJ)
    flow = trees.tree_flows(trees.euler_tour(trees.spanning_tree(edge), ref), inject)
    assert [r.unreached for r in trees.cycle_probe(flow, edge, ref, inject).collect()] == [1]


def test_unsolvable_right_hand_sides_stop_by_name(spark):
    edge = spark.createDataFrame([(0, 0, 1, 2, 10.0, 0.0, 0.0), (0, 1, 4, 5, 10.0, 0.0, 0.0)], EDGE)
    ref = spark.createDataFrame([(0, 1)], "case_id long, ref_bus long")
    inject = spark.createDataFrame([(0, 4, 4, 1.0), (0, 2, 2, 1.0)], INJ)
    with pytest.raises(RuntimeError, match=r"\(0, 4\)"):
        n.solve_angles(edge, ref, inject, with_shift=False, patience=2, check_every=1)


def test_components_of_a_long_path(spark):
    draw = random.Random(2)
    order = draw.sample(range(300), 300)
    rows = [(0, i, a, b, True) for i, (a, b) in enumerate(zip(order, order[1:])) if i != 150]
    branch = spark.createDataFrame(rows, "case_id long, branch_id long, from_bus long, to_bus long, status boolean")
    bus = spark.createDataFrame([(0, b) for b in range(301)], "case_id long, bus_id long")
    got = {r.bus_id: r.label for r in n.connected_components(bus, branch).collect()}
    first, second = order[:151], order[151:]
    assert got == {b: min(first) for b in first} | {b: min(second) for b in second} | {300: 300}
