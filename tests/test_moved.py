"""What the products, scalings and error metrics send and recompute on large tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import algebra as al
from gridloom.operators import benchstats as b
from gridloom.operators import iterate as it
from gridloom.operators import scaling as sc
from gridloom.session import settle, settle_bucketed, settled


@pytest.fixture
def adaptive_off(spark):
    """Plans as they are made from the estimates alone."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture
def no_broadcast(adaptive_off):
    """Tables that are too large for a broadcast."""
    before = adaptive_off.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive_off.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield adaptive_off
    adaptive_off.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return str(df._jdf.queryExecution().executedPlan())


def written(monkeypatch, module):
    """Plans of the tables that ``module`` settles from now on."""
    plans = []

    def noting(df, **options):
        plans.append(plan(df))
        return settle(df, **options)

    monkeypatch.setattr(module, "settle", noting)
    return plans


def program(table):
    """One case: A1 is a row over all of 12 columns, A2 has a row over all of them and two short ones."""
    entries = [(0, "A1", 0, j, 1.0) for j in range(12)] + [(0, "A2", 0, j, 1.0 + j) for j in range(12)]
    entries += [(0, "A2", 1, 3, 2.0), (0, "A2", 2, 4, -1.0)]
    a = table("case_id long, block string, row long, col long, value double", entries)
    rows = [(0, "A1", 0, 5.0), (0, "A2", 0, 1.0), (0, "A2", 1, 0.5), (0, "A2", 2, -3.0)]
    row_vec = table("case_id long, block string, row long, b double", rows)
    cols = [(0, j, j - 6.0, 0.0, 2.0) for j in range(12)]
    col_vec = table("case_id long, col long, c double, lower double, upper double", cols)
    control = table("case_id long, sigma double, lambda_used double", [(0, 1.0, 700.0)])
    return settle(a), settle(row_vec), settle(col_vec), control


def values(df, *keys):
    return {tuple(r[k] for k in keys): [r[c] for c in df.columns if c not in keys] for r in df.collect()}


def test_wide_rows_give_the_same_step(table):
    a, row_vec, col_vec, control = program(table)
    wide = al.find_wide(a, row_vec, entries=3, limit=0)
    assert {(r.block, r.row) for r in wide.rows.collect()} == {("A1", 0), ("A2", 0)}
    assert sorted(r.row for r in wide.rest.collect()) == [1, 2]
    solve = it.orthogonal_solver(a)
    logs, states = [], []
    for lp in (it.Problem(a, row_vec, col_vec), it.Problem(a, row_vec, col_vec, wide)):
        state, log = it.run_steps(lp, 2, control, solve)
        states.append((values(state.col, "col"), values(state.row, "block", "row")))
        logs.append({r.iteration: r.kkt_combined_norm for r in log.collect()})
    for one, two in zip(*states, strict=True):
        assert one.keys() == two.keys()
        for k in one:
            assert two[k] == pytest.approx(one[k])
    assert logs[1] == pytest.approx(logs[0])
    delta_row = row_vec.select(*al.ROW, (F.col("b") + 1).alias("y"))
    quadratics = [
        it.metric_quadratic(lp, delta_row, control, solve).first().quadratic
        for lp in (it.Problem(a, row_vec, col_vec), it.Problem(a, row_vec, col_vec, wide))
    ]
    assert quadratics[0] == pytest.approx(quadratics[1])


def test_wide_rows_keep_missing_repeated_and_null_multipliers(table):
    a, row_vec, *_ = program(table)
    a = a.unionByName(a.limit(1).select("case_id", F.lit(None).cast("string").alias("block"), "row", "col", "value"))
    wide = al.find_wide(a, row_vec, entries=3, limit=0)
    y = "case_id long, block string, row long, y double"
    for rows in ([(0, "A2", 0, 2.0), (0, "A2", 0, 3.0), (0, "A2", 1, 1.0)], [(0, "A1", 0, None), (0, "A2", 2, 4.0)], []):
        vec = table(y, rows)
        for how in ("inner", "left"):
            got = [sorted(map(str, al.join_rows(a, vec, w, how).select(*al.ROW, "col", "value", "y").collect())) for w in (None, wide)]
            assert got[0] == got[1]


def test_entries_of_wide_rows_are_not_sent_by_row(no_broadcast, table):
    a, row_vec, col_vec, _ = program(table)
    wide = al.find_wide(a, row_vec, entries=3, limit=0)
    y = settle(row_vec.withColumnRenamed("b", "y"))
    assert "BroadcastHashJoin" in plan(al.spmv_t(a, y, wide=wide))
    assert "BroadcastHashJoin" not in plan(al.spmv_t(a, y))
    assert al.find_wide(a, row_vec, entries=100, limit=0) is None
    assert al.find_wide(a, row_vec, entries=3, limit=10**6) is None


def test_vector_of_the_inequality_step_is_met_by_its_size(adaptive_off, table, monkeypatch):
    a, row_vec, col_vec, control = program(table)
    lp = it.Problem(a, row_vec, col_vec)
    solve = it.orthogonal_solver(a)
    plans = written(monkeypatch, it)
    it.sgs_step(lp, it.zero_state(lp), it.zero_state(lp), 0, control, solve)
    moved = [p for p in plans if "Union" in p and "lambda_used" in p and "x_bar" not in p]
    assert len(moved) == 1
    assert not re.search(r"SortMergeJoin \[case_id#\d+L, col#", moved[0])


def test_settled_tables_are_not_written_again(table, monkeypatch):
    a, row_vec, col_vec, control = program(table)
    assert settled(a) is a
    solve = it.orthogonal_solver(a)
    plans = written(monkeypatch, it)
    it.run_steps(it.Problem(a, row_vec, col_vec), 1, control, solve)
    assert not [p for p in plans if "Join" not in p and "Union" not in p and "value#" in p and "block#" in p]


def test_scaling_reads_its_norms_from_files(table):
    a, *_ = program(table)
    step = sc.scale_step(a, "ruiz")
    for scale in (step.row_scale, step.col_scale):
        assert "Exchange" not in plan(scale)
    assert plan(step.a).count("HashAggregate") == 0
    got = {(r.block, r.row): r.scale for r in step.row_scale.collect()}
    assert got["A2", 0] == pytest.approx(np.sqrt(12.0))


@pytest.mark.parametrize("method", [al.power_iteration, al.collatz_bound])
def test_bucketed_matrix_is_not_moved(adaptive_off, table, monkeypatch, method):
    a = settle_bucketed(program(table)[0], *al.ROW)
    plans = written(monkeypatch, al)
    method(a, 3).collect()
    products = [p for p in plans if "hashpartitioning(case_id" in p and "col#" in p and "value#" in p]
    assert products
    assert not [p for p in products if "row#" in "".join(x for x in p.split("\n") if "Exchange hashpartitioning" in x)]


def test_error_metrics_deal_their_rows(adaptive_off, table):
    vec = "case_id long, row long, value double"
    gram = table("case_id long, r1 long, r2 long, value double", [(0, 0, 0, 2.0), (0, 1, 1, 3.0)])
    x = table(vec, [(0, 0, 1.0), (0, 1, 2.0)])
    found = b.solution_error_metrics(gram, table(vec, [(0, 0, 2.0), (0, 1, 5.0)]), x, x)
    assert "REPARTITION_BY_NUM" in plan(found)
    assert found.first().normalized_system_residual == pytest.approx(1 / np.sqrt(29))
