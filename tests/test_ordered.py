"""Ordered helpers against brute force, with blocks so small that every seam is used."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import ordered as o


@pytest.fixture(scope="module")
def data(spark):
    random.seed(5)
    rows = []
    for key in ("a", "b", "c"):
        places = random.sample(range(400), 10 if key == "c" else 150)
        rows += [(key, p, float(random.randint(-9, 9)), random.choice([None, p])) for p in places]
    return rows, spark.createDataFrame(rows, "k string, p long, v double, m long")


def by_key(rows):
    groups = {}
    for row in sorted(rows):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_running_sum_previous_position_carry(data, block):
    rows, df = data
    summed = {(r.k, r.p): r.s for r in o.running_sum(df, ["k"], "p", {"s": F.col("v")}, block).collect()}
    before = {(r.k, r.p): r.b for r in o.previous(df, ["k"], "p", {"b": "v"}, block).collect()}
    place = {(r.k, r.p): r.n for r in o.position(df, ["k"], "p", "n", block).collect()}
    carried = {(r.k, r.p): r.c for r in o.carry_forward(df, ["k"], "p", "m", "c", block).collect()}
    for key, group in by_key(rows).items():
        total, last, mark = 0.0, None, None
        for n, (_, p, v, m) in enumerate(group):
            total += v
            mark = m if m is not None else mark
            assert summed[key, p] == total
            assert before[key, p] == last
            assert place[key, p] == n
            assert carried[key, p] == mark
            last = v


def test_sorted_position(data):
    rows, df = data
    found = o.sorted_position(df, ["k"], [F.col("v").desc(), F.col("p")], "n").collect()
    for key, group in by_key(rows).items():
        want = sorted(group, key=lambda r: (-r[2], r[1]))
        got = sorted((r for r in found if r.k == key), key=lambda r: r.n)
        assert [r.p for r in got] == [r[1] for r in want]
        assert [r.n for r in got] == list(range(1, len(want) + 1))


def test_exact_quantiles(data):
    rows, df = data
    cuts = {"lo": 0.0, "q": 0.3, "md": 0.5, "hi": 1.0}
    got = {r.k: r for r in o.exact_quantiles(df, ["k"], "v", cuts).collect()}
    for key, group in by_key(rows).items():
        for name, q in cuts.items():
            assert got[key][name] == pytest.approx(np.percentile([r[2] for r in group], 100 * q))


def test_exact_quantiles_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    groups = {"inf": [1.0, 2.0, inf], "both": [-inf, 0.0, inf], "nan": [1.0, nan], "one": [5.0], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r for r in o.exact_quantiles(df, ["k"], "v", {"lo": 0.0, "md": 0.5, "hi": 1.0}).collect()}
    assert (got["inf"].lo, got["inf"].md, got["inf"].hi) == (1.0, 2.0, inf)
    assert (got["both"].lo, got["both"].md, got["both"].hi) == (-inf, 0.0, inf)
    assert got["nan"].lo == 1.0 and np.isnan(got["nan"].md) and np.isnan(got["nan"].hi)
    assert got["one"].md == 5.0 and "none" not in got
    whole = o.exact_quantiles(df.where("k = 'inf'"), [], "v", {"md": 0.5}).first()
    assert whole.md == 2.0


def test_spread_sequence(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", 3)], "k string, n long")
    got = sorted((r.k, r.i) for r in o.spread_sequence(df, F.col("n"), "i", ["k"], chunk=4).collect())
    assert got == [("a", i) for i in range(10)] + [("c", i) for i in range(3)]
