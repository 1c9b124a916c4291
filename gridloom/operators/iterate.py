"""First-order steps as batch jobs: one call advances every case.

``lp`` is ``Problem(a, row_vec, col_vec, wide)``; ``control(case_id, sigma, lambda_used)`` holds
the penalty and a bound of the squared norm of the inequality block.  A solver for the
equality block is a function ``rhs(case_id, row, value) -> (case_id, row, y)``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    EPS,
    absent_as_zero,
    clip,
    positive_part,
    reason_list,
    whole_sum,
)
from ..functions.ordered import BLOCK, previous
from ..session import beside, release, settle, settled
from .algebra import COL, ROW, Wide, join_rows, residual_summary, spmv, spmv_t

Solver = Callable[[DataFrame], DataFrame]


class Problem(NamedTuple):
    a: DataFrame
    row_vec: DataFrame
    col_vec: DataFrame
    wide: Wide | None = None  # find_wide(a, row_vec): a large model's products then move less


class State(NamedTuple):
    col: DataFrame
    row: DataFrame


class Step(NamedTuple):
    """``activity``: products of A2 with the proximal point, ``ax`` by row (with evidence only) and ``aty`` by
    column, null where a term is unknown.  ``products``: ``aty1`` and ``aty2`` of the current and, as
    ``_aty1`` and ``_aty2``, of the proximal multipliers by column."""

    proximal: State
    next_state: State
    evidence: DataFrame
    activity: tuple[DataFrame | None, DataFrame] | None = None
    products: DataFrame | None = None


#: After so many steps the carried products are computed anew, so rounding does not add up.
REFRESH = 100


def _merge(left: DataFrame, right: DataFrame, keys: list[str], change) -> DataFrame:
    values = [c for c in left.columns if c not in keys]
    other = right.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    joined = left.select(*keys, *values).join(other, keys)
    return joined.select(*keys, *[change(F.col(v), F.col(f"_{v}")).alias(v) for v in values])


def reflect_state(current: State, proximal: State) -> State:
    """Twice the proximal point minus the current one."""

    def change(now: Column, prox: Column) -> Column:
        return 2.0 * prox - now

    return State(
        _merge(current.col, proximal.col, COL, change),
        _merge(current.row, proximal.row, ROW, change),
    )


def halpern_update(anchor: State, reflected: State, k: int) -> State:
    """Weights 1/(k+2) on the anchor and (k+1)/(k+2) on the reflected point."""

    def change(old: Column, new: Column) -> Column:
        return F.lit(1.0 / (k + 2.0)) * old + F.lit((k + 1.0) / (k + 2.0)) * new

    return State(
        _merge(anchor.col, reflected.col, COL, change),
        _merge(anchor.row, reflected.row, ROW, change),
    )


def check_equality_pattern(
    a: DataFrame, dims: DataFrame, storage: DataFrame, expected: DataFrame
) -> DataFrame:
    """Equality block against the expected entries: missing, extra, error and counts."""
    keys = ["case_id", "row", "col"]
    got = a.where(F.col("block") == "A1").select(*keys, F.col("value").alias("got"))
    want = expected.where(F.col("block") == "A1").select(*keys, F.col("value").alias("want"))
    pair = got.join(want, keys, "full_outer")
    one = F.lit(1).cast("bigint")
    found = pair.groupBy("case_id").agg(
        F.sum(F.when(F.col("got").isNull(), one).otherwise(0)).alias("missing"),
        F.sum(F.when(F.col("want").isNull(), one).otherwise(0)).alias("extra"),
        F.coalesce(F.max(F.abs(F.col("got") - F.col("want"))), F.lit(0.0)).alias("max_error"),
        F.greatest(F.lit(1.0), F.max(F.abs("want"))).alias("magnitude"),
        F.count("got").alias("nnz"),
    )
    count = F.col("periods") * (F.col("n_gen") + F.col("n_rg") + 4 * F.col("n_ess"))
    joined = found.join(dims.select("case_id", count.alias("expected_nnz")), "case_id", "left")
    passed = (
        (F.col("missing") == 0)
        & (F.col("extra") == 0)
        & (F.col("max_error") <= 128 * EPS * F.col("magnitude"))
        & (F.col("nnz") == F.col("expected_nnz"))
    )
    return joined.withColumn("passed", passed).drop("magnitude")


def storage_coefficients(dims: DataFrame, storage: DataFrame, dt: float = 1.0) -> DataFrame:
    """Coupling and diagonal of each storage row of the equality Gram matrix."""
    charge, out = F.col("charge_eff"), 1 / F.col("discharge_eff")
    sized = storage.join(dims.select("case_id", "periods"), "case_id")
    return sized.select(
        "case_id",
        (F.col("periods") + F.col("pos")).alias("row"),
        (-F.lit(dt) * (charge + out)).alias("coupling"),
        (F.col("periods") * F.lit(dt * dt) * (charge**2 + out**2)).alias("diagonal"),
        ((charge - out) ** 2 / (charge**2 + out**2)).alias("schur_share"),
    )


def equality_coefficients(dims: DataFrame, storage: DataFrame, dt: float = 1.0) -> DataFrame:
    """Per case: balance diagonal, alpha and the Schur scalar without cancellation."""
    parts = storage_coefficients(dims, storage, dt).groupBy("case_id").agg(
        F.sum(F.col("coupling") ** 2 / F.col("diagonal")).alias("alpha"),
        F.sum("schur_share").alias("_share"),
    )
    joined = dims.select("case_id", "periods", "n_gen", "n_rg", "n_ess").join(parts, "case_id", "left")
    joined = joined.na.fill(0.0, ["alpha", "_share"])
    diagonal = (F.col("n_gen") + F.col("n_rg") + 2 * F.col("n_ess")).cast("double")
    schur = F.col("n_gen") + F.col("n_rg") + F.col("_share")
    safe = F.col("schur_scalar") > 128 * EPS * F.greatest(F.lit(1.0), F.col("balance_diagonal"))
    return (
        joined.withColumn("balance_diagonal", diagonal)
        .withColumn("schur_scalar", schur)
        .withColumn("safe", safe)
        .drop("_share")
    )


def equality_solve(rhs: DataFrame, coefficients: DataFrame, per_storage: DataFrame) -> DataFrame:
    """``(A1 A1')^-1 rhs`` in closed form: mean and zero-mean parts, then storage rows.

    ``rhs(case_id, row, value)``.  One aggregation per case gives all scalars.
    """
    base = rhs.join(
        coefficients.select("case_id", "periods", "balance_diagonal", "schur_scalar"), "case_id"
    ).join(per_storage.select("case_id", "row", "coupling", "diagonal"), ["case_id", "row"], "left")
    is_balance = F.col("row") < F.col("periods")
    sums = base.groupBy("case_id").agg(
        F.sum(F.when(is_balance, F.col("value")).otherwise(0.0)).alias("_total"),
        F.sum(
            F.when(~is_balance, F.col("coupling") / F.col("diagonal") * F.col("value")).otherwise(0.0)
        ).alias("_weighted"),
    )
    mean = F.col("_total") / F.col("periods") - F.col("_weighted")
    balance = (F.col("value") - F.col("_weighted") - mean) / F.col("balance_diagonal")
    balance = balance + mean / F.col("schur_scalar")
    balance_sum = F.col("periods") * mean / F.col("schur_scalar")
    store = (F.col("value") - F.col("coupling") * balance_sum) / F.col("diagonal")
    return base.join(sums, "case_id").select(
        "case_id", "row", F.when(is_balance, balance).otherwise(store).alias("y")
    )


def structural_solver(dims: DataFrame, storage: DataFrame, dt: float = 1.0) -> Solver:
    coefficients = settle(equality_coefficients(dims, storage, dt))
    per_storage = settle(storage_coefficients(dims, storage, dt))
    return lambda rhs: equality_solve(rhs, coefficients, per_storage)


def orthogonal_solver(a: DataFrame) -> Solver:
    """For equality rows without a common column: divide by the squared row norm."""
    norms = settle(
        a.where(F.col("block") == "A1").groupBy("case_id", "row").agg(F.sum(F.col("value") ** 2).alias("_sq"))
    )
    return lambda rhs: rhs.join(norms, ["case_id", "row"]).select(
        "case_id", "row", (F.col("value") / F.col("_sq")).alias("y")
    )


def _block(df: DataFrame, block: str) -> DataFrame:
    return df.where(F.col("block") == block)


def _products_by_block(
    a: DataFrame, row: DataFrame, cols: DataFrame, wide: Wide | None = None
) -> DataFrame:
    """``A1'y1`` and ``A2'y2`` by column in one aggregation."""
    zero = F.lit(0.0)
    v = F.col("value") * F.col("y")
    terms = join_rows(a, row.select(*ROW, "y"), wide).select(
        *COL,
        F.when(F.col("block") == "A1", v).otherwise(zero).alias("aty1"),
        F.when(F.col("block") == "A2", v).otherwise(zero).alias("aty2"),
    )
    terms = terms.unionByName(cols.select(*COL, zero.alias("aty1"), zero.alias("aty2")))
    return terms.groupBy(*COL).agg(F.sum("aty1").alias("aty1"), F.sum("aty2").alias("aty2"))


def _equality_rhs(lp: Problem, common: DataFrame, control: DataFrame) -> DataFrame:
    """``(b1 - A1 common) / sigma``."""
    product = _block(lp.a, "A1").join(common.select(*COL, "v"), COL).select(
        "case_id", "row", (-F.col("value") * F.col("v")).alias("value")
    )
    rhs = _block(lp.row_vec, "A1").select("case_id", "row", F.col("b").alias("value"))
    sums = rhs.unionByName(product).groupBy("case_id", "row").agg(F.sum("value").alias("value"))
    return sums.join(control.select("case_id", "sigma"), "case_id").select(
        "case_id", "row", (F.col("value") / F.col("sigma")).alias("value")
    )


def _equality_error(a: DataFrame, y1: DataFrame, rhs: DataFrame, name: str) -> DataFrame:
    """Relative and largest error of an equality solve, by products with A1."""
    block = _block(a, "A1")
    rows = y1.withColumn("block", F.lit("A1"))
    back = spmv(block, spmv_t(block, rows, "y", "x"), "x", "v").select(
        "case_id", "row", F.col("v"), F.lit(0.0).alias("w")
    )
    want = rhs.select("case_id", "row", F.lit(0.0).alias("v"), F.col("value").alias("w"))
    pair = back.unionByName(want).groupBy("case_id", "row").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    gap = F.col("v") - F.col("w")
    return pair.groupBy("case_id").agg(
        (F.sqrt(F.sum(gap**2)) / (1 + F.sqrt(F.sum(F.col("w") ** 2)))).alias(f"{name}_relative"),
        F.max(F.abs(gap)).alias(f"{name}_infinity"),
    )


def sgs_step(
    lp: Problem,
    current: State,
    anchor: State,
    k: int,
    control: DataFrame,
    solve: Solver,
    evidence: bool = True,
    products: DataFrame | None = None,
) -> Step:
    """One symmetric sweep: z and x, equality half step, inequality step, equality step.

    Then reflection and the anchored average.  The column table and the three multiplier
    tables are settled, as later parts of the step read each of them more than once; the vector
    that meets the inequality block is settled so that its size decides how they meet.
    ``products(case_id, col, aty1, aty2)`` are those of the current multipliers if they are known:
    the inequality block is then read twice, once in each direction.
    """
    sigma = F.col("sigma")
    if products is None:
        products = _products_by_block(lp.a, current.row, lp.col_vec, lp.wide)
    argument = F.col("x") + sigma * (F.col("aty1") + F.col("aty2") - F.col("c"))
    cols = (
        current.col.select(*COL, "x")
        .join(lp.col_vec, COL)
        .join(products, COL)
        .join(control.select("case_id", "sigma"), "case_id")
        .withColumn("_arg", argument)
        .withColumn("_proj", clip(F.col("_arg"), F.col("lower"), F.col("upper")))
        .withColumn("z_bar", (F.col("_proj") - F.col("_arg")) / sigma)
        .withColumn(
            "x_bar", F.col("x") + sigma * (F.col("aty1") + F.col("aty2") + F.col("z_bar") - F.col("c"))
        )
    )
    cols = settle(
        cols.select(
            *COL,
            "c",
            "aty1",
            "aty2",
            "z_bar",
            "x_bar",
            "sigma",
            F.abs(F.col("x_bar") - F.col("_proj")).alias("zx_gap"),
        )
    )
    first = cols.select(
        *COL, (F.col("x_bar") + sigma * (F.col("aty2") + F.col("z_bar") - F.col("c"))).alias("v")
    )
    rhs1 = settle(_equality_rhs(lp, first, control))
    half = settle(solve(rhs1))

    half_rows = half.withColumn("block", F.lit("A1"))
    at_half = spmv_t(_block(lp.a, "A1"), half_rows, "y", "h", lp.col_vec)
    ry = settle(
        cols.join(at_half, COL).select(
            *COL,
            (F.col("x_bar") / sigma + F.col("h") + F.col("aty2") + F.col("z_bar") - F.col("c")).alias("v"),
            F.col("x_bar").alias("x"),
        )
    )
    a2 = _block(lp.a, "A2")
    zero = F.lit(0.0)
    # the proximal x rides along: its product with the block is part of the residual
    terms = (
        a2.join(beside(ry), COL, "left")
        .select(
            "case_id",
            "row",
            (F.col("value") * F.col("v")).alias("p"),
            (F.col("value") * F.col("x")).alias("ax"),
            *_blank("b", "y"),
        )
        .unionByName(
            _block(lp.row_vec, "A2").select("case_id", "row", zero.alias("p"), zero.alias("ax"), "b", *_blank("y"))
        )
        .unionByName(
            _block(current.row, "A2").select("case_id", "row", zero.alias("p"), zero.alias("ax"), *_blank("b"), "y")
        )
    )
    gathered = terms.groupBy("case_id", "row").agg(
        F.sum("p").alias("p"),
        F.max("b").alias("b"),
        F.max("y").alias("y"),
        *([whole_sum("ax").alias("ax")] if evidence else []),
    )
    moved = F.col("y") + (F.col("b") / sigma - F.col("p")) / F.col("lambda_used")
    # a case without control has no multipliers, but its products count
    y2 = settle(
        gathered.join(control.withColumn("_run", F.lit(True)), "case_id", "left").select(
            "case_id", "row", positive_part(moved).alias("y"), "_run", *(["ax"] if evidence else [])
        )
    )
    by_row = y2.select("case_id", F.lit("A2").alias("block"), "row", "ax") if evidence else None
    y2 = y2.where("_run").select("case_id", "row", "y")

    wide2 = lp.wide and lp.wide.block("A2")
    at_y2 = join_rows(a2, y2.withColumn("block", F.lit("A2")), wide2, "left").select(
        *COL, (F.col("value") * F.col("y")).alias("h")
    )
    at_y2 = at_y2.unionByName(lp.col_vec.select(*COL, zero.alias("h")))
    at_y2 = settle(at_y2.groupBy(*COL).agg(F.sum("h").alias("h"), whole_sum("h").alias("aty")))
    second = cols.join(at_y2, COL).select(
        *COL, (F.col("x_bar") + sigma * (F.col("h") + F.col("z_bar") - F.col("c"))).alias("v")
    )
    rhs2 = settle(_equality_rhs(lp, second, control))
    y1 = settle(solve(rhs2))

    rows = (
        y1.select("case_id", F.lit("A1").alias("block"), "row", "y")
        .unionByName(y2.select("case_id", F.lit("A2").alias("block"), "row", "y"))
    )
    proximal = State(cols.select(*COL, F.col("x_bar").alias("x"), F.col("z_bar").alias("z")), rows)
    following = halpern_update(anchor, reflect_state(current, proximal), k)
    following = State(settle(following.col), settle(following.row))
    at_y1 = spmv_t(_block(lp.a, "A1"), y1.withColumn("block", F.lit("A1")), "y", "_aty1", lp.col_vec)
    products = (
        cols.select(*COL, "aty1", "aty2")
        .join(at_y1, COL)
        .join(at_y2.select(*COL, F.col("h").alias("_aty2")), COL)
    )
    noted = cols.groupBy("case_id").agg(F.max("zx_gap").alias("zx_identity_error"))
    if evidence:
        noted = (
            noted.join(_equality_error(lp.a, half, rhs1, "first"), "case_id", "left")
            .join(_equality_error(lp.a, y1, rhs2, "second"), "case_id", "left")
        )
    return Step(proximal, following, noted, (by_row, at_y2.select(*COL, "aty")), products)


def carried_products(step: Step, anchor: DataFrame, k: int) -> DataFrame:
    """``A1'y1`` and ``A2'y2`` of the state after step ``k``: what the step did to the multipliers, done
    to the products of the anchor, the current and the proximal ones."""
    old = anchor.select(*COL, F.col("aty1").alias("_old1"), F.col("aty2").alias("_old2"))

    def change(n: str) -> Column:
        reflected = 2.0 * F.col(f"_aty{n}") - F.col(f"aty{n}")
        return F.lit(1.0 / (k + 2.0)) * F.col(f"_old{n}") + F.lit((k + 1.0) / (k + 2.0)) * reflected

    joined = step.products.join(old, COL)
    return joined.select(*COL, change("1").alias("aty1"), change("2").alias("aty2"))


def _known_rows(row: DataFrame) -> tuple[int, bool]:
    """The number of multipliers, and whether each is known and of a row of its own."""
    count, rows, known = row.agg(F.count("*"), F.count_distinct(*ROW), F.count("y")).first()
    return count, count == rows == known


def _blank(*names: str) -> list[Column]:
    return [F.lit(None).cast("double").alias(n) for n in names]


def zero_state(lp: Problem) -> State:
    zero = F.lit(0.0)
    return State(
        lp.col_vec.select(*COL, zero.alias("x"), zero.alias("z")),
        lp.row_vec.select(*ROW, zero.alias("y")),
    )


def run_steps(
    lp: Problem,
    steps: int,
    control: DataFrame,
    solve: Solver,
    interval: int = 100,
    state: State | None = None,
    tolerance: float = 5e-5,
) -> tuple[State, DataFrame]:
    """``steps`` bounded steps of every case and the log of residuals.

    A residual row is taken at step 1, at every ``interval`` and at the last step.  The
    state is written at each step, so a later call can continue from it.
    """
    lp = Problem(settled(lp.a), settled(lp.row_vec), settled(lp.col_vec), lp.wide)
    anchor = current = state or zero_state(lp)
    log = None
    old: State | None = None
    proximal = current
    # products are carried while all states have the same rows, each once and known
    cols = lp.col_vec.agg(F.count("*"), F.count_distinct(*COL)).first()
    count, carried = _known_rows(anchor.row)
    carried = carried and cols[0] == cols[1] == anchor.col.select(*COL).distinct().count() == anchor.col.count()
    begun = products = None
    # residuals take the products with A2 from the step, so only what else there is meets the states
    other = lp.a.where(~F.col("block").eqNullSafe("A2"))
    for k in range(steps):
        done = k + 1
        record = done == 1 or done % interval == 0 or done == steps
        if carried and products is None:
            products = settle(_products_by_block(lp.a, current.row, lp.col_vec, lp.wide))
            begun = products if begun is None else begun
        step = sgs_step(lp, current, anchor, k, control, solve, evidence=record, products=products)
        current, proximal = step.next_state, step.proximal
        if old is not None:
            release(old.col, old.row)
        old = current
        if record:
            found = residual_summary(
                other, lp.row_vec, lp.col_vec, proximal.col, proximal.row, tolerance, known=step.activity
            )
            row = settle(
                found.join(step.evidence, "case_id")
                .join(control.select("case_id", "sigma"), "case_id")
                .withColumn("iteration", F.lit(done))
            )
            log = row if log is None else log.unionByName(row)
        if carried and done < steps:
            carried = proximal.row.count() == count and _known_rows(current.row) == (count, True)
            due = not carried or done % REFRESH == 0
            following = None if due else settle(carried_products(step, begun, k))
            if products is not begun:
                release(products)
            products = following
    release(products, begun)
    return current, log


def metric_quadratic(
    lp: Problem, delta_row: DataFrame, control: DataFrame, solve: Solver
) -> DataFrame:
    """``dy'(AA' + T)dy`` by products: equality part through the solver, lambda |dy2|^2."""
    back = spmv_t(lp.a, delta_row, "y", "x", lp.col_vec, wide=lp.wide)
    first = settle(
        spmv(_block(lp.a, "A1"), back, "x", "value", _block(lp.row_vec, "A1")).drop("block")
    )
    solved = solve(first)
    equality = (
        first.join(solved, ["case_id", "row"])
        .groupBy("case_id")
        .agg(
            whole_sum(F.col("value") * F.col("y")).alias("equality_term"),
            F.lit(True).alias("_equal"),
        )
    )
    square = _block(delta_row, "A2").groupBy("case_id").agg(
        whole_sum(F.col("y") ** 2).alias("_sq"), F.lit(True).alias("_other")
    )
    joined = control.join(equality, "case_id", "left").join(square, "case_id", "left")
    joined = joined.withColumns(
        {
            "equality_term": absent_as_zero("_equal", "equality_term"),
            "_sq": absent_as_zero("_other", "_sq"),
        }
    )
    inequality = F.col("lambda_used") * F.col("_sq")
    value = F.col("equality_term") + inequality
    scale = F.greatest(F.lit(1.0), F.abs("equality_term"), F.abs(inequality))
    return joined.select(
        "case_id",
        positive_part(value).alias("quadratic"),
        (value < -500 * EPS * scale).alias("materially_negative"),
    )


def restart_merit(
    lp: Problem, delta_col: DataFrame, delta_row: DataFrame, control: DataFrame, solve: Solver
) -> DataFrame:
    """Norm of a movement in the step's metric: primal, cross and dual terms; null if one is unknown."""
    quadratic = metric_quadratic(lp, delta_row, control, solve)
    primal = delta_col.groupBy("case_id").agg(
        whole_sum(F.col("x") ** 2).alias("_xx"), F.lit(True).alias("_cols")
    )
    cross = (
        spmv(lp.a, delta_col, "x", "v")
        .join(delta_row.select(*ROW, "y"), ROW)
        .groupBy("case_id")
        .agg(whole_sum(F.col("v") * F.col("y")).alias("_xy"), F.lit(True).alias("_both"))
    )
    joined = quadratic.join(control, "case_id").join(primal, "case_id", "left")
    joined = joined.join(cross, "case_id", "left").withColumns(
        {"_xx": absent_as_zero("_cols", "_xx"), "_xy": absent_as_zero("_both", "_xy")}
    )
    first = F.col("_xx") / F.col("sigma")
    second = 2.0 * F.col("_xy")
    third = F.col("sigma") * F.col("quadratic")
    squared = first + second + third
    scale = F.greatest(F.lit(1.0), F.abs(first), F.abs(second), F.abs(third))
    negative = F.col("materially_negative") | (squared < -1000 * EPS * scale)
    return joined.select(
        "case_id",
        F.sqrt(positive_part(squared)).alias("merit"),
        negative.alias("materially_negative"),
    )


# Thresholds of the restart and penalty rules.
CONTROL = {
    "alpha_sufficient": 0.2,
    "alpha_necessary": 0.6,
    "alpha_long": 0.2,
    "movement_minimum": 1e-16,
    "movement_maximum": 1e12,
    "ratio_minimum": 1e-8,
    "ratio_maximum": 1e8,
}


def restart_reasons(
    policy_event: DataFrame, control: dict[str, float] = CONTROL, block: int = BLOCK
) -> DataFrame:
    """Reasons to restart at each policy event; the first restart is forced.

    The merit of the event before comes from the ordered helper, so a case with very many
    events is not sorted in one task.
    """
    keys = ["case_id"]
    events = previous(policy_event, keys, "iteration", {"previous_merit": "merit"}, block)
    forced = F.col("restart_count") == 0
    merit, reference = F.col("merit"), F.col("reference_merit")
    reasons = F.when(forced, F.array(F.lit("forced_first"))).otherwise(
        reason_list(
            [
                ("sufficient_decay", merit <= control["alpha_sufficient"] * reference),
                (
                    "necessary_decay_no_local_progress",
                    (merit <= control["alpha_necessary"] * reference)
                    & (merit > F.col("previous_merit")),
                ),
                (
                    "long_inner_loop",
                    F.col("inner_iteration") >= control["alpha_long"] * F.col("iteration"),
                ),
            ]
        )
    )
    return events.withColumn("restart_reasons", reasons).withColumn(
        "restarted", F.size("restart_reasons") > 0
    )


def sigma_update(movement: DataFrame, control: dict[str, float] = CONTROL) -> DataFrame:
    """New penalty dx/dy when both guards hold, else 1 with the failed guards named."""
    dx, dy = F.col("delta_x"), F.col("delta_y")
    primal, dual = F.col("primal_infeasibility"), F.col("dual_infeasibility")
    ratio = F.when(primal > 0, dual / primal)
    low, high = control["movement_minimum"], control["movement_maximum"]
    quotient = F.when(dy != 0, dx / dy)
    moved = (dx > low) & (dx < high) & (dy > low) & (dy < high)
    moved = F.coalesce(moved & (quotient > 0), F.lit(False))
    balanced = F.coalesce(
        (ratio > control["ratio_minimum"]) & (ratio < control["ratio_maximum"]), F.lit(False)
    )
    accepted = moved & balanced
    failed = F.concat_ws(
        " and ", reason_list([("movement guard", ~moved), ("infeasibility-ratio guard", ~balanced)])
    )
    reason = F.when(accepted, "accepted HPR-LP Eq. (16)").otherwise(
        F.concat(F.lit("reset to 1 after "), failed)
    )
    return movement.select(
        "*",
        ratio.alias("infeasibility_ratio"),
        F.lit(True).alias("attempted"),
        accepted.alias("accepted"),
        reason.alias("reason"),
        F.when(accepted, quotient).otherwise(F.lit(1.0)).alias("sigma_after"),
    )
