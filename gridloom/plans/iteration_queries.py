"""Step operators over the supplier fleet and the event log."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import assemble as m
from ..operators import iterate as it
from ..operators.algebra import COL, ROW, find_wide, spectral_bounds
from ..session import settle
from .assembly_queries import COLS, FLEET, GEN, OFF, UNION_A, UNION_B, build
from .derived_queries import DIMS, dims
from .registry import query, r

LP = "b_entry b_coo b_row b_col b_state_col b_state_row"
LONG = {"x": ("b_state_col", "NULL", "col"), "z": ("b_state_col", "NULL", "col"), "y": ("b_state_row", "block", "row")}


def states(t):
    """The bound state and a second one shifted by the position."""
    col, row = t.state_col(), t.state_row()
    shift_c = (F.col("col") % 7).cast("double")
    shift_r = (F.col("row") % 5).cast("double")
    other = it.State(
        col.withColumn("x", F.col("x") + shift_c).withColumn("z", F.col("z") - shift_c),
        row.withColumn("y", F.col("y") * shift_r),
    )
    return it.State(col, row), other


OTHER = {"x": "(x + col % 7)", "z": "(z - col % 7)", "y": "(y * (row % 5))"}


def _long(state):
    pair = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("x", "z")])
    cols = state.col.select("case_id", F.explode(pair).alias("p"), F.col("col").alias("position")).select(
        "case_id", "p.name", F.lit(None).cast("string").alias("block"), "position", "p.value"
    )
    rows = state.row.select(
        "case_id", F.lit("y").alias("name"), "block", F.col("row").alias("position"), F.col("y").alias("value")
    )
    return cols.unionByName(rows).withColumn("value", rounded("value"))


def _state_sql(change):
    return " UNION ALL ".join(
        f"""SELECT case_id, '{n}' AS name, {block} AS block, {pos} AS position,
        {r(change.format(a=n, b=OTHER[n]))} AS value FROM {table}"""
        for n, (table, block, pos) in LONG.items()
    )


@query("reflect_state", _state_sql("2 * {b} - {a}"), LP)
def _(t):
    return _long(it.reflect_state(*states(t)))


@query("halpern_update", _state_sql("(1.0::DOUBLE / 5) * {a} + (4.0::DOUBLE / 5) * {b}"), LP)
def _(t):
    return _long(it.halpern_update(*states(t), k=3))


COEF = f"""{DIMS}, sc AS (SELECT case_id, t + pos AS row, -(charge_eff + 1 / discharge_eff) AS coupling,
      t * (charge_eff^2 + (1 / discharge_eff)^2) AS diagonal,
      (charge_eff - 1 / discharge_eff)^2 / (charge_eff^2 + (1 / discharge_eff)^2) AS share
      FROM b_storage JOIN dims USING (case_id)),
    co AS (SELECT case_id, t AS periods, g AS n_gen, rg AS n_rg, s AS n_ess, alpha,
      (g + rg + 2 * s)::DOUBLE AS balance_diagonal, g + rg + share AS schur_scalar FROM dims JOIN
      (SELECT case_id, sum(coupling^2 / diagonal) AS alpha, sum(share) AS share FROM sc GROUP BY 1)
      USING (case_id))"""
SIZES = "b_gen b_renewable b_storage"


@query(
    "equality_coefficients",
    f"""WITH {COEF} SELECT case_id, periods, n_gen, n_rg, n_ess, {r('alpha', 9)} AS alpha, balance_diagonal,
        {r('schur_scalar', 9)} AS schur_scalar, true AS safe FROM co""",
    SIZES,
)
def _(t):
    found = it.equality_coefficients(dims(t), t.storage())
    return found.withColumn("alpha", rounded("alpha", 9)).withColumn("schur_scalar", rounded("schur_scalar", 9))


def _rhs(t, spans):
    """Right-hand sides of all equality rows, from the fleet's own columns."""
    fam = spans.select("case_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m1") - 1)).alias("row"))
    return fam.select("case_id", "row", (F.col("row") * 37 % 101 - 50).cast("double").alias("value"))


@query(
    "equality_solve",
    f"""WITH {COEF}, rh AS (SELECT case_id, i AS row, (i * 37 % 101 - 50)::DOUBLE AS value
          FROM dims, unnest(range(t + s)) AS u(i)),
        sm AS (SELECT case_id, sum(value) FILTER (rh.row < periods) AS total,
          sum(coupling / diagonal * value) FILTER (rh.row >= periods) AS weighted
          FROM rh JOIN co USING (case_id) LEFT JOIN sc USING (case_id, row) GROUP BY 1),
        sv AS (SELECT case_id, rh.row AS row, value, coupling, diagonal, periods, balance_diagonal AS bd,
          schur_scalar AS sh, weighted AS w, total / periods - weighted AS mean
          FROM rh JOIN co USING (case_id) JOIN sm USING (case_id) LEFT JOIN sc USING (case_id, row))
      SELECT case_id, row, {r('''CASE WHEN row < periods THEN (value - w - mean) / bd + mean / sh
          ELSE (value - coupling * (periods * mean / sh)) / diagonal END''', 8)} AS y FROM sv""",
    SIZES,
)
def _(t):
    spans = dims(t)
    found = it.equality_solve(
        _rhs(t, spans), it.equality_coefficients(spans, t.storage()), it.storage_coefficients(spans, t.storage())
    )
    return found.withColumn("y", rounded("y", 8))


@query(
    "check_equality_pattern",
    f"""WITH {DIMS} SELECT case_id, 0::BIGINT AS missing, 0::BIGINT AS extra, 0::DOUBLE AS max_error,
        t * (g + rg + 4 * s) AS nnz, t * (g + rg + 4 * s) AS expected_nnz, true AS passed FROM dims""",
    SIZES,
)
def _(t):
    spans = dims(t)
    lp = build(t)
    expected = m.rows_power_balance(spans, t.bus().select("case_id", F.lit(0).alias("period"), F.lit(0.0).alias("mw")))[0]
    expected = expected.unionByName(m.rows_storage_terminal(spans, t.storage())[0])
    return it.check_equality_pattern(lp.a, spans, t.storage(), expected)


def problem(t):
    lp = build(t)
    a, row_vec = settle(lp.a), settle(lp.row_vec)
    small = it.Problem(a, row_vec, settle(lp.col_vec), find_wide(a, row_vec))
    bound = spectral_bounds(small.a.where(F.col("block") == "A2"))
    control = settle(
        bound.select(
            "case_id", F.lit(1.0).alias("sigma"),
            (F.least("frobenius", "induced") * (1 + 1e-10)).alias("lambda_used"),
        )
    )
    return small, control, it.structural_solver(lp.dims, t.storage())


# The first step from the zero state, written out: x_bar is the projection of -c and
# y1_half solves (A1 A1') y = b1 - A1 (x_bar + z_bar - c).
@query(
    "sgs_step",
    f"""WITH {DIMS}, {GEN}, {OFF}, {COLS}
    SELECT case_id, col::BIGINT AS col, {r('least(greatest(-c, lower), upper)')} AS x,
      {r('least(greatest(-c, lower), upper) + c')} AS z,
      {r('least(greatest(-c, lower), upper)')} AS next_x, true AS identity_holds, true AS equality_holds
    FROM colv""",
    FLEET,
)
def _(t):
    lp, control, solve = problem(t)
    zero = it.zero_state(lp)
    step = it.sgs_step(lp, zero, zero, 0, control, solve)
    joined = step.proximal.col.join(
        step.next_state.col.select(*COL, F.col("x").alias("next_x")), COL
    ).join(step.evidence, "case_id")
    return joined.select(
        *COL, rounded("x").alias("x"), rounded("z").alias("z"), rounded("next_x").alias("next_x"),
        (F.col("zx_identity_error") <= 1e-9).alias("identity_holds"),
        ((F.col("first_relative") <= 1e-9) & (F.col("second_relative") <= 1e-9)).alias("equality_holds"),
    )


@query(
    "run_steps",
    f"""WITH {DIMS} SELECT case_id, iteration, true AS identity_holds, true AS equality_holds
        FROM dims, (VALUES (1), (2), (3)) AS k(iteration)""",
    SIZES,
)
def _(t):
    lp, control, solve = problem(t)
    _, log = it.run_steps(lp, 3, control, solve, interval=2)
    return log.select(
        "case_id", "iteration", (F.col("zx_identity_error") <= 1e-6).alias("identity_holds"),
        ((F.col("first_relative") <= 1e-9) & (F.col("second_relative") <= 1e-9)).alias("equality_holds"),
    )


METRIC = f"""WITH {COEF}, {GEN}, {OFF}, a AS ({UNION_A}), b AS ({UNION_B}), {COLS},
  lam AS (SELECT case_id, least(f, mr * mc) * (1 + 1e-10) AS lam FROM
    (SELECT case_id, sum(f) AS f, max(s) AS mr FROM (SELECT case_id, row, sum(value^2) AS f, sum(abs(value)) AS s
      FROM a WHERE block = 'A2' GROUP BY ALL) GROUP BY 1)
    JOIN (SELECT case_id, max(s) AS mc FROM (SELECT case_id, col, sum(abs(value)) AS s FROM a
      WHERE block = 'A2' GROUP BY ALL) GROUP BY 1) USING (case_id)),
  dyv AS (SELECT case_id, block, row, (row % 11 - 5)::DOUBLE / 10 AS y FROM b),
  dxv AS (SELECT case_id, col, (col % 9 - 4)::DOUBLE AS x FROM colv),
  atv AS (SELECT case_id, col, sum(value * y) AS v FROM a JOIN dyv USING (case_id, block, row) GROUP BY ALL),
  fb AS (SELECT case_id, row, sum(value * v) AS value FROM a JOIN atv USING (case_id, col) WHERE block = 'A1' GROUP BY ALL),
  sm AS (SELECT case_id, sum(value) FILTER (fb.row < periods) AS total,
      sum(coupling / diagonal * value) FILTER (fb.row >= periods) AS weighted
      FROM fb JOIN co USING (case_id) LEFT JOIN sc USING (case_id, row) GROUP BY 1),
  sv AS (SELECT case_id, value, CASE WHEN fb.row < periods THEN (value - weighted - (total / periods - weighted))
        / balance_diagonal + (total / periods - weighted) / schur_scalar
      ELSE (value - coupling * (periods * (total / periods - weighted) / schur_scalar)) / diagonal END AS y
      FROM fb JOIN co USING (case_id) JOIN sm USING (case_id) LEFT JOIN sc USING (case_id, row)),
  qd AS (SELECT case_id, eq + lam * sq AS q FROM (SELECT case_id, sum(value * y) AS eq FROM sv GROUP BY 1)
      JOIN (SELECT case_id, sum(y^2) AS sq FROM dyv WHERE block = 'A2' GROUP BY 1) USING (case_id)
      JOIN lam USING (case_id))"""


def _movement(lp):
    dx = lp.col_vec.select(*COL, (F.col("col") % 9 - 4).cast("double").alias("x"))
    dy = lp.row_vec.select(*ROW, ((F.col("row") % 11 - 5).cast("double") / 10).alias("y"))
    return dx, dy


@query("metric_quadratic", f"{METRIC} SELECT case_id, {r('q', 1)} AS quadratic FROM qd", FLEET)
def _(t):
    lp, control, solve = problem(t)
    found = it.metric_quadratic(lp, _movement(lp)[1], control, solve)
    return found.select("case_id", rounded("quadratic", 1).alias("quadratic"))


@query(
    "restart_merit",
    f"""{METRIC}, xx AS (SELECT case_id, sum(x^2) AS xx FROM dxv GROUP BY 1),
      ax AS (SELECT case_id, block, row, sum(value * x) AS v FROM a JOIN dxv USING (case_id, col) GROUP BY ALL),
      xy AS (SELECT case_id, sum(v * y) AS xy FROM ax JOIN dyv USING (case_id, block, row) GROUP BY 1)
    SELECT case_id, {r('sqrt(xx + 2 * xy + q)', 3)} AS merit, false AS materially_negative
    FROM qd JOIN xx USING (case_id) JOIN xy USING (case_id)""",
    FLEET,
)
def _(t):
    lp, control, solve = problem(t)
    found = it.restart_merit(lp, *_movement(lp), control, solve)
    return found.withColumn("merit", rounded("merit", 3))


@query(
    "restart_reasons",
    """WITH e AS (SELECT *, lag(merit) OVER (PARTITION BY case_id ORDER BY iteration) AS previous_merit FROM b_policy)
    SELECT case_id, iteration, previous_merit, CASE WHEN restart_count = 0 THEN ['forced_first'] ELSE list_filter([
        CASE WHEN merit <= 0.2 * reference_merit THEN 'sufficient_decay' END,
        CASE WHEN merit <= 0.6 * reference_merit AND merit > previous_merit THEN 'necessary_decay_no_local_progress' END,
        CASE WHEN inner_iteration >= 0.2 * iteration THEN 'long_inner_loop' END], lambda r: r IS NOT NULL) END
        AS restart_reasons FROM e""",
    "b_policy",
)
def _(t):
    found = it.restart_reasons(t.policy(), block=512)
    return found.select("case_id", "iteration", "previous_merit", "restart_reasons")


@query(
    "sigma_update",
    f"""WITH e AS (SELECT *, delta_x > 1e-16 AND delta_y > 1e-16 AS mv,
          primal_infeasibility > 0 AND dual_infeasibility / primal_infeasibility > 1e-8 AS ok FROM b_policy)
    SELECT case_id, iteration, mv AND ok AS accepted, {r('CASE WHEN mv AND ok THEN delta_x / delta_y ELSE 1 END')} AS sigma_after,
      CASE WHEN mv AND ok THEN 'accepted HPR-LP Eq. (16)' WHEN NOT mv AND NOT ok THEN
        'reset to 1 after movement guard and infeasibility-ratio guard'
        WHEN NOT mv THEN 'reset to 1 after movement guard' ELSE 'reset to 1 after infeasibility-ratio guard' END AS reason
    FROM e""",
    "b_policy",
)
def _(t):
    found = it.sigma_update(t.policy())
    return found.select("case_id", "iteration", "accepted", rounded("sigma_after").alias("sigma_after"), "reason")
