"""Steps that carry the products of their multipliers, against steps that compute them anew."""

import pytest
from pyspark.sql import functions as F
from test_moved import program, values

from gridloom.operators import iterate as it
from gridloom.session import settle


def counted(monkeypatch):
    calls = []
    plain = it._products_by_block

    def noting(*args):
        calls.append(args)
        return plain(*args)

    monkeypatch.setattr(it, "_products_by_block", noting)
    return calls


def run(table, monkeypatch, change, refresh):
    monkeypatch.setattr(it, "REFRESH", refresh)
    a, row_vec, col_vec, control = program(table)
    lp = change(it.Problem(a, row_vec, col_vec))
    calls = counted(monkeypatch)
    state, log = it.run_steps(lp, 2, control, it.orthogonal_solver(a))
    monkeypatch.undo()
    drop = ("case_id", "iteration")
    logs = values(log.select(*drop, "kkt_combined_norm", "first_relative", "stopping.all_satisfied"), *drop)
    rows = sorted(((r.block, r.row, plain(r.y)) for r in state.row.collect()), key=str)
    cols = sorted(((r.col, plain(r.x), plain(r.z)) for r in state.col.collect()), key=str)
    return logs, rows, cols, len(calls)


def plain(v):
    return None if v is None else round(v, 9) + 0.0


def unchanged(lp):
    return lp


def no_bound(lp):
    """The limit of an inequality row is not known: its multiplier leaves the later products."""
    bound = F.when((F.col("block") == "A2") & (F.col("row") == 1), None).otherwise(F.col("b"))
    return lp._replace(row_vec=settle(lp.row_vec.withColumn("b", bound)))


def twice(lp):
    """A row of the right-hand side comes twice."""
    return lp._replace(row_vec=settle(lp.row_vec.unionByName(lp.row_vec.where("block = 'A2' AND row = 2"))))


def no_column(lp):
    """An entry's column is not in the model."""
    return lp._replace(col_vec=settle(lp.col_vec.where("col <> 4")))


@pytest.mark.parametrize("change, computed", [(unchanged, 1), (no_bound, 2), (twice, 2)])
def test_carried_products_give_the_same_steps(table, monkeypatch, change, computed):
    carried, anew = run(table, monkeypatch, change, 100), run(table, monkeypatch, change, 1)
    assert carried[3] == computed and anew[3] == 2
    assert carried[1:3] == anew[1:3]
    assert carried[0].keys() == anew[0].keys() == {(0, 1), (0, 2)}
    for key, found in carried[0].items():
        assert found == pytest.approx(anew[0][key], nan_ok=True)


def test_residual_of_a_step_is_that_of_the_whole_matrix(table):
    """What the step knows of A2 and the products with A1 are the residual of the proximal point."""
    a, row_vec, col_vec, control = program(table)
    for lp in (it.Problem(a, row_vec, col_vec), no_column(it.Problem(a, row_vec, col_vec))):
        zero = it.zero_state(lp)
        step = it.sgs_step(lp, zero, zero, 0, control, it.orthogonal_solver(a))
        states = step.proximal.col, step.proximal.row
        whole = it.residual_summary(a, lp.row_vec, lp.col_vec, *states).first()
        parts = it.residual_summary(a.where("block = 'A1'"), lp.row_vec, lp.col_vec, *states, known=step.activity).first()
        assert parts.kkt_combined_norm == pytest.approx(whole.kkt_combined_norm)
        assert parts.stopping == whole.stopping
