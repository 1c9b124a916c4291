"""Logs, timings, ledgers, campaigns and annotations: fixture values and tampered copies."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import annotations as an
from gridloom.operators import benchstats as b
from gridloom.operators import campaign as c
from gridloom.operators import iterate as it
from gridloom.operators import ledger as g
from gridloom.operators import quality as q
from gridloom.operators import runlog as rl

EVENT = "case_id string, iteration long, inner_iteration long, merit double, reference_merit double, restart_count long"


def test_restart_reasons(table):
    rows = [("a", 50, 1, 0.19, 1.0, 1), ("a", 100, 20, 0.2, 1.0, 1), ("b", 100, 1, 5.0, 1.0, 0)]
    got = {(r.case_id, r.iteration): r.restart_reasons for r in it.restart_reasons(table(EVENT, rows)).collect()}
    assert got["a", 100] == ["sufficient_decay", "necessary_decay_no_local_progress", "long_inner_loop"]
    assert got["b", 100] == ["forced_first"]


def test_sigma_guards(table):
    names = "delta_x double, delta_y double, primal_infeasibility double, dual_infeasibility double, sigma_before double"
    rows = [(2.0, 4.0, 1.0, 1.0, 3.0), (0.0, 0.0, 1.0, 1.0, 3.0), (1.0, 1.0, 0.0, 1.0, 3.0)]
    got = it.sigma_update(table(names, rows)).collect()
    assert [r.sigma_after for r in got] == [0.5, 1.0, 1.0]
    assert "movement guard" in got[1].reason and got[2].reason == "reset to 1 after infeasibility-ratio guard"


def test_statistics_of_one_to_five(table):
    timing = table("run string, wall_seconds double", [("a", float(i)) for i in (3, 1, 5, 2, 4)] + [("one", 7.0)])
    runs = table("run string", [("a",), ("one",), ("none",)])
    got = {r.run: r for r in b.timing_statistics(timing, runs).collect()}
    assert (got["a"].median_seconds, got["a"].interquartile_range_seconds) == (3.0, 2.0)
    assert got["a"].standard_deviation_seconds == pytest.approx(math.sqrt(2.5))
    assert got["one"].standard_deviation_seconds == 0.0
    assert got["none"]["count"] == 0 and got["none"].median_seconds is None
    stats = b.timing_statistics(timing, runs)
    assert all(r.passed for r in b.audit_statistics(stats, stats).collect())
    wrong = stats.withColumn("median_seconds", F.col("median_seconds") + 1e-6)
    assert {r.run for r in b.audit_statistics(stats, wrong).collect() if not r.passed} == {"a", "one"}


def test_log_log_fit_rejects_points_without_logarithm(table):
    good = [("good", float(i), 2.0 * i) for i in range(1, 6)]
    bad = [("bad", float(i), 2.0 * i) for i in range(1, 6)] + [("bad", 0.0, 1.0), ("bad", None, 1.0)]
    got = {r.k: r for r in b.log_log_fit(table("k string, work double, seconds double", good + bad), ["k"]).collect()}
    assert got["good"].passed and got["good"].bad_points == 0
    assert not got["bad"].passed and got["bad"].bad_points == 2 and got["bad"].slope is None


def test_measured_runs(table):
    steady = [("steady", i, True, 1.0) for i in range(1, 8)]
    wild = [("wild", i, True, float(i)) for i in range(1, 11)]
    short = [("short", i, True, float(i)) for i in range(1, 7)]
    failed = [("failed", i, i != 3, 1.0) for i in range(1, 10)]
    late = [("late", i, i != 7, 1.0) for i in range(1, 10)]
    timing = table("run string, repetition long, passed boolean, wall_seconds double", steady + wild + short + failed + late)
    ok = table("run string, passed boolean", [(n, True) for n in ("steady", "wild", "short", "failed", "late")])
    chosen, status = b.select_measured_runs(timing, ok)
    assert {r.run: r.status for r in status.collect()} == {
        "steady": "COMPLETE", "wild": "COMPLETE", "short": "INCOMPLETE", "failed": "FAILED", "late": "COMPLETE"
    }
    counts = {r.run: r["count"] for r in chosen.groupBy("run").count().collect()}
    assert counts == {"steady": 5, "wild": 9, "late": 5}


def test_ledgers(table):
    names = "phase string, direction string, kind string, calls long, bytes long"
    before = table(names, [("initial_state", "host_to_device", "x", 1, 32)])
    after = table(names, [("initial_state", "host_to_device", "x", 4, 128), ("hidden_state_copy", "device_to_host", "x", 4, 320)])
    delta, rejects = g.ledger_delta(before, after)
    totals = {r.direction: (r.calls, r.bytes) for r in g.ledger_totals(delta).collect()}
    assert totals == {"host_to_device": (3, 96), "device_to_host": (4, 320), None: (7, 416)}
    assert rejects.count() == 0
    assert [r.phase for r in g.ledger_audit(delta).collect()] == ["hidden_state_copy"]
    assert g.ledger_delta(after, before)[1].count() == 2
    timers = "name string, seconds double"
    kept, bad = g.timer_delta(table(timers, [("a", 1.0), ("b", 2.0)]), table(timers, [("a", 1.25), ("b", 1.0)]), ["name"])
    assert kept.first().seconds == 0.25 and bad.first().name == "b"


KEYS = ["k1", "k2", "k3", "k4"]


def campaign(table, results):
    order = table("case_id long, seq long, key string", [(1, i, k) for i, k in enumerate(KEYS)])
    attempt = table("case_id long, key string, attempt long, status string", [(1, k, 1, s) for k, s in results])
    return order, attempt


@pytest.mark.parametrize(
    ("results", "prefix", "key", "retry", "status"),
    [
        ([], 0, "k1", "k1", "PLANNED"),
        ([("k1", "PASS")], 1, "k2", "k2", "PARTIAL_PASS"),
        ([("k1", "PASS"), ("k2", "FAIL")], 1, None, "k2", "STOPPED_ON_FAILURE"),
        ([("k1", "RUNNING")], 0, None, "k1", "RETRY_REQUIRED"),
        ([("k1", "PASS"), ("k2", "MEMORY_BLOCKED")], 1, None, "k2", "COMPLETE_WITH_RESOURCE_LIMIT"),
        ([(k, "PASS") for k in KEYS], 4, None, None, "PASS"),
    ],
)
def test_campaign_states(table, results, prefix, key, retry, status):
    order, attempt = campaign(table, results)
    assert c.passing_prefix(order, attempt).first().passing_prefix == prefix
    assert c.next_key(order, attempt).first().next_key == key
    assert c.next_key(order, attempt, retry_failed=True).first().next_key == retry
    assert c.campaign_status(order, attempt).first().status == status
    assert c.bypass_check(order, attempt).count() == 0


def test_bypass_and_order(table):
    order, attempt = campaign(table, [("k1", "FAIL"), ("k2", "PASS"), ("k9", "PASS"), ("k2", "PASS")])
    got = {(r.key, r.reason) for r in c.bypass_check(order, attempt).collect()}
    assert got == {("k2", "bypasses_predecessor"), ("k2", "duplicate"), ("k9", "unlisted")}
    names = "case_id long, ordinal long, key string, invocation_id string, gate_passed boolean"
    invocation = table(
        "case_id long, invocation_id string, mode string, approved boolean, allocated_keys array<string>",
        [(1, k, "run_next", True, [k]) for k in KEYS],
    )
    good = table(names, [(1, 5, "k1", "k1", True), (1, 7, "k1", "k1", True), (1, 9, "k2", "k2", True)])
    assert c.allocation_order_check(good, order, invocation).first().passed
    gap = table(names, [(1, 5, "k1", "k1", True), (1, 9, "k3", "k3", True)])
    assert c.allocation_order_check(gap, order, invocation).first().out_of_order == 1


def test_resource_gate_fails_closed(table):
    spec = table(
        "case_id string, periods long, branches long, generators long, renewables long, storage long", [("a", 4, 10, 3, 2, 1)]
    )
    sizes = "case_id string, periods long, published_m long, published_n long, published_nnz long"
    published = table(sizes, [("a", 4, 143, 52, 10)])
    seen = "case_id string, observed boolean, host_available long, device_free long"
    estimate = g.resource_estimate(spec, published)
    first = estimate.first()
    assert first.dimensions_match and first.unified_peak_bytes == first.host_peak_bytes + first.device_bytes
    assert g.resource_gate(estimate, table(seen, [("a", True, 10**9, 10**9)])).first().passed
    blind = g.resource_gate(estimate, table(seen, [("a", False, None, None)])).first()
    assert blind.block_reasons == ["observation_available", "within_host_safety_budget", "within_device_safety_budget"]
    text = g.resource_boundaries(g.resource_gate(estimate, table(seen, [("a", False, None, None)]))).first().block_reasons
    assert text.startswith("failed:within_host_safety_budget;failed:within_device_safety_budget")


def test_tampered_logs_are_named(table):
    grid = "case string, iteration long"
    runs = table("case string, iterations long", [("a", 25)])
    events = table(grid, [("a", 7)])
    logged = [("a", i) for i in (1, 7, 10, 20, 25)]
    check = lambda rows: rl.expected_sampling_grid(runs, events, table(grid, rows), 10, ["case"]).first()
    assert check(logged).passed
    assert check(logged[:-1]).missing == 1
    assert check([*logged, ("a", 11)]).unexpected == 1
    assert check([*logged, ("a", 25)]).repeated == 1
    counts = "case string, iteration long, restart_count long"
    summary = table("case string, restart_count long", [("a", 2)])
    good = table(counts, [("a", 10, 0), ("a", 20, 1), ("a", 30, 2)])
    assert rl.monotone_restart_count(good, summary, ["case"], block=10).first().passed
    bad = table(counts, [("a", 10, 2), ("a", 20, 1), ("a", 30, 2)])
    assert rl.monotone_restart_count(bad, summary, ["case"], block=10).first().decreases == 1


def test_unknown_values_are_rejected(table):
    df = table("k long, v double", [(1, 1.0), (2, float("nan")), (3, float("inf")), (4, None)])
    kept, rejects = q.reject_nonfinite(df, ["v"])
    assert [r.k for r in kept.collect()] == [1] and rejects.count() == 3


def test_annotation_changes(table):
    names = "owner_key string, document_id string, id string, comment string, status string, updated_at string"
    base = table(names, [("o", "d", "n1", "old", "open", "t0"), ("o", "d", "n2", "keep", "open", "t0")])
    log = table(
        "op string, seq long, owner_key string, document_id string, id string, comment string, status string, updated_at string, changed_at string",
        [
            ("update", 1, "o", "d", "n1", "new", "applied", None, "t1"),
            ("update", 2, "other", "d", "n2", "stolen", "applied", None, "t2"),
            ("delete", 3, "other", "d", "n2", None, None, None, "t3"),
            ("insert", 4, "o", "d", "n3", "first", "open", "t4", None),
            ("delete", 5, "o", "d", "n3", None, None, None, "t5"),
            ("insert", 6, "o", "d", "n3", "again", "open", "t6", None),
        ],
    )
    got = {r.id: (r.comment, r.status, r.updated_at) for r in an.apply_annotation_changes(base, log).collect()}
    assert got == {"n1": ("new", "applied", "t1"), "n2": ("keep", "open", "t0"), "n3": ("again", "open", "t6")}


def test_sections_at_the_seams(table):
    heading = table(
        "d string, offset long, place long, section_id string, section_title string",
        [("a", 10, 1, "s1", "One"), ("a", 10, 2, "s2", "Two"), ("a", 300, 3, "s3", "Three")],
    )
    notes = table("d string, id long, start_offset long", [("a", i, o) for i, o in enumerate((0, 10, 299, 300, 10_000))] + [("b", 9, 5)])
    found = {r.id: r.section_id for r in an.section_at_offset(notes, heading, ["d"], block=16).collect()}
    assert found == {0: "abstract", 1: "s2", 2: "s2", 3: "s3", 4: "s3", 9: "abstract"}
