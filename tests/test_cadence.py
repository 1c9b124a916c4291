"""Sampling grids and cadences are counted, not listed: long runs, repeated runs, unknown keys."""

import pytest

from gridloom.operators import runlog as rl

GRID = "case string, iteration long"


def listed_grid(runs, events, logged, interval):
    want, seen = {}, {}
    for key, last in runs:
        mine = want.setdefault(key, set())
        mine |= {1, *([last] if (last or 0) > 0 else []), *range(interval, (last or 0) + 1, interval)}
    for key, at in events:
        want.setdefault(key, set()).add(at)
    for key, at in logged:
        seen.setdefault(key, []).append(at)
    found = {}
    for key in {*want, *seen}:
        mine, got = want.get(key, set()), seen.get(key, [])
        found[key] = (
            len(mine - set(got)), len(set(got) - mine), sum(got.count(at) > 1 for at in set(got))
        )
    return found


def test_grid_of_repeated_and_unknown_runs(table):
    runs = [("a", 25), ("a", 43), ("b", 9), ("c", None), (None, 31), ("d", -4)]
    events = [("a", 7), ("b", 40), ("z", 3), (None, 10)]
    logged = [("a", 10), ("a", 40), ("a", 50), ("b", 1), ("b", 1), ("c", 10), ("y", 10), (None, 30), ("a", None), ("d", 0)]
    found = rl.expected_sampling_grid(
        table("case string, iterations long", runs), table(GRID, events), table(GRID, logged), 10, ["case"]
    )
    got = {r.case: (r.missing, r.unexpected, r.repeated) for r in found.collect()}
    assert got == listed_grid(runs, events, logged, 10)


FLAGS = "case string, iterations long, converged boolean, adaptive_sigma boolean, restart boolean"


def test_cadence_of_repeated_and_unknown_runs(table):
    runs = [
        ("a", 40, False, True, False), ("a", 25, True, True, None), ("b", 30, True, None, True),
        ("c", 50, False, False, False), (None, 30, False, True, True), ("d", None, None, True, False),
    ]
    events = [("a", 10), ("a", 20), ("a", 20), ("a", 30), ("a", 35), ("b", 20), ("b", None), ("c", 10), ("z", 5)]
    found = rl.policy_cadence(table(FLAGS, runs), table(GRID, events), 10, ["case"])
    got = sorted((r.case or "", r.expected_events, r.differences, r.passed) for r in found.collect())
    # a is due at 10 and 20 twice, at 30 and 40 once; 10, 35 and 40 differ
    assert got == sorted([
        ("a", 6, 3, False), ("a", 6, 3, False), ("b", 2, 2, False), ("c", 0, 1, False),
        ("", 0, 0, True), ("d", 0, 0, True),
    ])


@pytest.mark.parametrize("name", ["expected_sampling_grid", "policy_cadence"])
def test_long_runs_are_not_unfolded(spark, table, name):
    """A run of 10**12 iterations has too many multiples to be listed."""
    events = table(GRID, [("a", 20)])
    if name == "policy_cadence":
        runs = table(FLAGS, [("a", 10**12, False, True, False)])
        row = rl.policy_cadence(runs, events, 10, ["case"]).first()
        assert (row.expected_events, row.differences) == (10**11, 10**11 - 1)
    else:
        runs = table("case string, iterations long", [("a", 10**12)])
        row = rl.expected_sampling_grid(runs, events, table(GRID, [("a", 30)]), 10, ["case"]).first()
        assert (row.missing, row.unexpected, row.repeated) == (10**11, 0, 0)
