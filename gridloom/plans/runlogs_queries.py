"""Run-log checks over the event table."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import runlog as rl
from .registry import query, r


def trajectory(t):
    """Nested trajectory rows built from the events; some of them break a rule."""
    value, event, user = F.col("value"), F.col("event_id"), F.col("user_id")
    parts = F.struct(
        value.alias("primal_feasibility"), (value * 2).alias("box"),
        F.when(event % 11 != 0, value).alias("stationarity"),
    )
    residuals = F.struct(
        value.alias("kkt_combined_norm"), value.alias("normalized_combined_norm"),
        parts.alias("paper_raw"), parts.alias("paper_normalized"),
        F.lit(True).alias("paper_stopping_satisfied"),
    )
    return t.read("events").select(
        F.lit("trajectory").alias("record_type"), F.concat(F.lit("u"), user).alias("case"),
        F.col("event_type").alias("run"), F.lit("main").alias("phase"),
        event.alias("iteration"), (event % 40).alias("inner_iteration"),
        value.alias("iteration_loop_elapsed_seconds"), value.alias("scaled_variable_objective"),
        value.alias("original_variable_objective"), residuals.alias("scaled_residuals"),
        residuals.alias("original_residuals"), F.lit(False).alias("kkt_target_satisfied"),
        value.alias("maximum_equality_solve_relative_residual"),
        value.alias("maximum_equality_solve_infinity_residual"),
        F.lit(None).cast("double").alias("minimum_original_inequality_multiplier"),
        (event % 3).cast("double").alias("sigma"), F.expr("event_id div 1000").alias("restart_count"),
    )


TRAJ_BAD = """(event_id <= 0 OR event_id % 40 = 0 OR value < 0 OR event_id % 11 = 0 OR event_id % 3 = 0)"""


@query(
    "validate_trajectory_rows",
    f"""SELECT 'u' || user_id AS "case", event_type AS run, 'main' AS phase, count(*) AS rows,
        count(*) FILTER {TRAJ_BAD} AS invalid, bool_and(NOT {TRAJ_BAD}) AS passed FROM events GROUP BY ALL""",
)
def _(t):
    return rl.validate_trajectory_rows(trajectory(t))[0]


@query(
    "trajectory_rejects",
    """SELECT event_id AS iteration, list_filter([CASE WHEN event_id <= 0 THEN 'iteration' END,
         CASE WHEN event_id % 40 = 0 THEN 'inner_iteration' END, CASE WHEN value < 0 THEN 'elapsed' END,
         CASE WHEN value < 0 OR event_id % 11 = 0 THEN 'scaled_residuals' END,
         CASE WHEN value < 0 OR event_id % 11 = 0 THEN 'original_residuals' END,
         CASE WHEN value < 0 THEN 'equality_residual' END, CASE WHEN event_id % 3 = 0 THEN 'sigma' END],
         lambda r: r IS NOT NULL) AS reasons FROM events
       WHERE event_id <= 0 OR event_id % 40 = 0 OR value < 0 OR event_id % 11 = 0 OR event_id % 3 = 0""",
)
def _(t):
    return rl.validate_trajectory_rows(trajectory(t))[1].select("iteration", "reasons")


def policy(t):
    """Nested policy events: the event type gives the reason, some rows break a rule."""
    event, user, value = F.col("event_id"), F.col("user_id"), F.col("value")
    kind = F.col("event_type")
    reasons = (
        F.when(kind == "click", F.array(F.lit("sufficient_decay")))
        .when(kind == "purchase", F.array(F.lit("long_inner_loop"), F.lit("sufficient_decay")))
        .when(kind == "error", F.array(F.lit("other")))
        .otherwise(F.array().cast("array<string>"))
    )
    update = F.struct(
        (user % 2 == 0).alias("attempted"), (event % 4 == 0).alias("accepted"), F.lit("text").alias("reason"),
        value.alias("delta_x"), value.alias("delta_y"), value.alias("primal_infeasibility"),
        value.alias("dual_infeasibility"), F.lit(None).cast("double").alias("infeasibility_ratio"),
        F.lit(1.0).alias("sigma_before"), (event % 5).cast("double").alias("sigma_after"),
    )
    return t.read("events").select(
        F.lit("policy_event").alias("record_type"), F.concat(F.lit("u"), user).alias("case"),
        F.lit("r").alias("run"), F.lit("main").alias("phase"), ((event + 1) * 10).alias("iteration"),
        (event + 1).alias("inner_iteration"), value.alias("merit"), value.alias("reference_merit"),
        F.lit(None).cast("double").alias("previous_checkpoint_merit"), reasons.alias("restart_reasons"),
        (kind.isin("click", "purchase", "error")).alias("restarted"),
        F.expr("event_id div 1000").alias("restart_count"), update.alias("sigma_update"),
    )


POL = """pe AS (SELECT 'u' || user_id AS "case", 'r' AS run, 'main' AS phase, (event_id + 1) * 10 AS iteration, event_id, user_id, value,
    event_type, event_id + 1 AS inner_iteration, event_type IN ('click', 'purchase', 'error') AS restarted,
    user_id % 2 = 0 AS attempted, event_id % 4 = 0 AS accepted, event_id // 1000 AS restart_count,
    user_id % 3 <> 0 AS adaptive, user_id % 5 <> 0 AS enabled,
    CASE event_type WHEN 'click' THEN ['sufficient_decay'] WHEN 'purchase' THEN ['long_inner_loop', 'sufficient_decay']
      WHEN 'error' THEN ['other'] ELSE []::VARCHAR[] END AS restart_reasons FROM events)"""
POL_BAD = """(value < 0 OR event_type = 'error' OR (NOT attempted AND accepted) OR event_id % 5 = 0
    OR (restarted AND NOT enabled) OR attempted <> (adaptive AND (restarted OR NOT enabled)))"""


def settings(t):
    user = F.col("user_id")
    return t.read("events").select(
        F.concat(F.lit("u"), user).alias("case"), F.lit("r").alias("run"), F.lit("main").alias("phase"),
        (user % 3 != 0).alias("adaptive_sigma"), (user % 5 != 0).alias("restart"),
    ).distinct()


@query(
    "validate_policy_rows",
    f"""WITH {POL} SELECT "case", run, phase, count(*) AS rows, count(*) FILTER {POL_BAD} AS invalid,
        bool_and(NOT {POL_BAD}) AS passed FROM pe GROUP BY ALL""",
)
def _(t):
    return rl.validate_policy_rows(policy(t), settings(t), 10)[0]


@query(
    "log_coverage",
    """WITH g AS (SELECT DISTINCT 'u' || user_id AS "case", event_type AS run FROM events WHERE value >= 10),
         w AS (SELECT DISTINCT 'u' || user_id AS "case", event_type AS run FROM events WHERE value < 10)
       SELECT *, 'unexpected' AS side FROM (SELECT * FROM g EXCEPT SELECT * FROM w)
       UNION ALL SELECT *, 'missing' FROM (SELECT * FROM w EXCEPT SELECT * FROM g)""",
)
def _(t):
    events = t.read("events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("case"), F.col("event_type").alias("run"), "value"
    )
    return rl.log_coverage(
        events.where(F.col("value") >= 10), events.where(F.col("value") < 10), ["case", "run"]
    )


@query(
    "unknown_event_runs",
    """SELECT DISTINCT 'u' || user_id AS "case", event_type AS run FROM events WHERE value >= 10
       AND ('u' || user_id, event_type) NOT IN (SELECT 'u' || user_id, event_type FROM events WHERE value < 10)""",
)
def _(t):
    events = t.read("events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("case"), F.col("event_type").alias("run"), "value"
    )
    wanted = events.where(F.col("value") < 10).select("case", "run")
    return rl.unknown_event_runs(events.where(F.col("value") >= 10), wanted, ["case", "run"])


GRID = """ru AS (SELECT user_id, max(event_id) AS iterations FROM events GROUP BY 1),
  lg AS (SELECT user_id, event_id AS i, count(*) AS g FROM events GROUP BY ALL),
  ex AS (SELECT user_id, unnest([1, iterations]) AS i FROM ru
    UNION SELECT user_id, k * 50 FROM ru, unnest(range(1, iterations // 50 + 1)) AS u(k)
    UNION SELECT user_id, event_id FROM events WHERE event_type = 'click')"""


@query(
    "expected_sampling_grid",
    f"""WITH {GRID}, j AS (SELECT coalesce(lg.user_id, ex.user_id) AS user_id, lg.g, ex.i AS w FROM lg
          FULL JOIN ex ON lg.user_id = ex.user_id AND lg.i = ex.i)
        SELECT user_id, count(*) FILTER (g IS NULL) AS missing, count(*) FILTER (w IS NULL) AS unexpected,
          count(*) FILTER (g > 1) AS repeated,
          bool_and(g IS NOT NULL AND w IS NOT NULL AND g = 1) AS passed FROM j GROUP BY 1""",
)
def _(t):
    events = t.read("events").withColumn("iteration", F.col("event_id"))
    runs = events.groupBy("user_id").agg(F.max("iteration").alias("iterations"))
    clicks = events.where(F.col("event_type") == "click")
    return rl.expected_sampling_grid(runs, clicks, events, 50, ["user_id"])


@query(
    "policy_cadence",
    """WITH ru AS (SELECT user_id, max(event_id) AS n, user_id % 4 = 0 AS conv, user_id % 3 <> 0 AS en FROM events GROUP BY 1),
       due AS (SELECT user_id, k * 100 AS i FROM ru, unnest(range(1, (n - conv::INT) // 100 + 1)) AS u(k) WHERE en),
       ev AS (SELECT user_id, event_id AS i FROM events WHERE event_type = 'click'),
       j AS (SELECT coalesce(due.user_id, ev.user_id) AS user_id, due.i AS d, ev.i AS e FROM due FULL JOIN ev
             ON due.user_id = ev.user_id AND due.i = ev.i)
       SELECT ru.user_id, count(d) AS expected_events, count(*) FILTER (j.user_id IS NOT NULL AND (d IS NULL OR e IS NULL)) AS differences,
         count(*) FILTER (j.user_id IS NOT NULL AND (d IS NULL OR e IS NULL)) = 0 AS passed
       FROM ru LEFT JOIN j USING (user_id) GROUP BY 1""",
)
def _(t):
    events = t.read("events").withColumn("iteration", F.col("event_id"))
    user = F.col("user_id")
    runs = events.groupBy("user_id").agg(F.max("iteration").alias("iterations")).select(
        "user_id", "iterations", (user % 4 == 0).alias("converged"), (user % 3 != 0).alias("adaptive_sigma"),
        F.lit(False).alias("restart"),
    )
    return rl.policy_cadence(runs, events.where(F.col("event_type") == "click"), 100, ["user_id"])


COUNTS = """count(*) AS events, count(*) FILTER (attempted) AS attempts, count(*) FILTER (accepted) AS accepted,
    count(*) FILTER (restarted) AS restarts, 0::BIGINT AS forced_first,
    count(*) FILTER (event_type IN ('click', 'purchase')) AS sufficient_decay,
    0::BIGINT AS necessary_decay_no_local_progress, count(*) FILTER (event_type = 'purchase') AS long_inner_loop"""


@query("event_counts", f"""WITH {POL} SELECT "case", run, phase, {COUNTS} FROM pe GROUP BY ALL""")
def _(t):
    return rl.event_counts(policy(t))


@query(
    "last_iteration",
    "SELECT case_id, max(iteration) AS iteration, arg_max(residual, iteration) AS residual, arg_max(sigma, iteration) AS sigma FROM b_run_log GROUP BY 1",
    "b_run_log",
)
def _(t):
    return rl.last_iteration(t.run_log(), ["case_id"], ["residual", "sigma"])


@query(
    "final_row_match",
    """WITH f AS (SELECT case_id, max(iteration) AS i, arg_max(residual, iteration) AS rs, arg_max(objective, iteration) AS ob,
         max(elapsed)::BIGINT AS u FROM b_run_log GROUP BY 1)
       SELECT case_id, list_filter([CASE WHEN u % 30 = 0 THEN 'iteration' END, CASE WHEN u % 50 = 0 THEN 'residual' END],
         lambda r: r IS NOT NULL) AS differences, u % 30 <> 0 AND u % 50 <> 0 AS passed FROM f""",
    "b_run_log",
)
def _(t):
    log = t.run_log()
    user = F.col("u").cast("bigint")
    summary = log.groupBy("case_id").agg(
        F.max("iteration").alias("i"), F.max_by("residual", "iteration").alias("rs"),
        F.max_by("objective", "iteration").alias("objective"), F.max("elapsed").alias("u"),
    ).select(
        "case_id", "objective",
        F.when(user % 30 == 0, F.col("i") - 1).otherwise(F.col("i")).alias("iterations"),
        F.when(user % 50 == 0, F.col("rs") + 1).otherwise(F.col("rs")).alias("residual"),
    )
    return rl.final_row_match(log, summary, ["residual", "objective"], ["case_id"])


@query(
    "monotone_restart_count",
    """WITH e AS (SELECT case_id, iteration, objective, lag(objective) OVER (PARTITION BY case_id ORDER BY iteration) AS b FROM b_run_log)
       SELECT case_id, count(*) FILTER (b > objective) AS decreases, arg_max(objective, iteration) AS last_count, 5::DOUBLE AS expected,
         count(*) FILTER (b > objective) = 0 AND arg_max(objective, iteration) = 5 AS passed FROM e GROUP BY 1""",
    "b_run_log",
)
def _(t):
    log = t.run_log().select("case_id", "iteration", F.col("objective").alias("restart_count"))
    summary = log.select("case_id", F.lit(5.0).alias("restart_count")).distinct()
    return rl.monotone_restart_count(log, summary, ["case_id"], block=256)


def second_log(t):
    """A second execution: some iterations absent, some residuals moved."""
    log = t.run_log().where(F.col("iteration") % 9 != 4)
    moved = F.when(F.col("iteration") % 10 == 3, F.col("residual") + 0.5).otherwise(F.col("residual"))
    return log.withColumn("residual", moved).withColumn("elapsed", F.col("elapsed") + 1)


SECOND = """b2 AS (SELECT * REPLACE (CASE WHEN iteration % 10 = 3 THEN residual + 0.5::DOUBLE ELSE residual END AS residual,
    elapsed + 1 AS elapsed) FROM b_run_log WHERE iteration % 9 <> 4)"""


@query(
    "trajectory_comparison",
    f"""WITH {SECOND} SELECT a.run, bool_and(b2.iteration IS NOT NULL) AS iteration_grid_matches, count(b2.iteration) AS samples,
        count(*) AS first_samples, count(b2.iteration) AS second_samples,
        {r('coalesce(max(abs(b2.objective - a.objective)), 0)')} AS max_objective_gap,
        {r('coalesce(max(abs(b2.residual - a.residual)), 0)')} AS max_residual_gap, 0::DOUBLE AS max_component_gap
      FROM b_run_log a LEFT JOIN b2 ON a.case_id = b2.case_id AND a.run = b2.run AND a.iteration = b2.iteration GROUP BY 1""",
    "b_run_log",
)
def _(t):
    found = rl.trajectory_comparison(t.run_log(), second_log(t), ["run"], "objective", "residual", ["sigma"])
    names = ("max_objective_gap", "max_residual_gap", "max_component_gap")
    return found.select(
        "run", "iteration_grid_matches", "samples", "first_samples", "second_samples",
        *[rounded(n).alias(n) for n in names],
    )


@query(
    "determinism_check",
    f"""WITH {SECOND}, x AS (SELECT * EXCLUDE (elapsed), 1 AS n FROM b_run_log UNION ALL SELECT * EXCLUDE (elapsed), -1 FROM b2),
        d AS (SELECT case_id, run, iteration, residual, objective, sigma, restart_count, sum(n) AS n FROM x GROUP BY ALL)
        SELECT case_id, sum(greatest(n, 0))::BIGINT AS only_first, sum(greatest(-n, 0))::BIGINT AS only_second,
          sum(abs(n)) = 0 AS identical FROM d GROUP BY 1""",
    "b_run_log",
)
def _(t):
    timed = {"elapsed": rl.ELAPSED}
    first, second = (df.withColumnsRenamed(timed) for df in (t.run_log(), second_log(t)))
    return rl.determinism_check(first, second, ["case_id"])


@query(
    "run_summary",
    f"""WITH {POL}, lg AS (SELECT 'u' || user_id AS "case", 'r' AS run, 'main' AS phase, event_id + 1 AS iteration,
          1 + (event_id % 3)::DOUBLE AS sigma, event_id // 1000 AS restart_count FROM events),
        s AS (SELECT "case", run, phase, max(iteration) AS iterations, count(*) AS rows, arg_min(sigma, iteration) AS sigma_initial,
          arg_max(sigma, iteration) AS sigma_final, min(sigma) AS sigma_minimum, max(sigma) AS sigma_maximum,
          arg_max(restart_count, iteration) AS restart_count FROM lg GROUP BY ALL),
        c AS (SELECT "case", run, phase, {COUNTS}, bool_and(iteration % 20 = 0) AS cadence_valid FROM pe GROUP BY ALL)
        SELECT * FROM s JOIN c USING ("case", run, phase)""",
)
def _(t):
    log = t.run_log().select(
        F.col("case_id").alias("case"), F.lit("r").alias("run"), F.lit("main").alias("phase"), "iteration", "sigma", "restart_count"
    )
    return rl.run_summary(log, policy(t), 20)


@query(
    "ablation_table",
    f"""WITH s AS (SELECT user_id AS run, count(*) AS rows FROM events GROUP BY 1)
        SELECT CASE WHEN run % 2 = 0 THEN 'none' ELSE 'full' END AS preprocessing, (run % 3)::DOUBLE AS initial_sigma,
          count(*) AS runs, {r("avg(rows) FILTER (run % 5 < 2)", 6)} AS fixed, {r("avg(rows) FILTER (run % 5 >= 2)", 6)} AS adaptive
        FROM s GROUP BY ALL""",
)
def _(t):
    runs = t.read("events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("rows"))
    key = F.col("run")
    settings_table = runs.select(
        "run", F.when(key % 2 == 0, "none").otherwise("full").alias("preprocessing"),
        (key % 3).cast("double").alias("initial_sigma"), F.when(key % 5 < 2, "fixed").otherwise("adaptive").alias("control"),
    )
    found = rl.ablation_table(runs, settings_table, "rows", ["fixed", "adaptive"])
    return found.withColumn("fixed", rounded("fixed")).withColumn("adaptive", rounded("adaptive"))


@query(
    "policy_schedule",
    f"""WITH {POL} SELECT "case", run, phase, iteration, inner_iteration, restarted, restart_reasons FROM pe""",
)
def _(t):
    return rl.policy_schedule(policy(t))


@query(
    "policy_differences",
    f"""WITH {POL}, x AS (SELECT "case", iteration, inner_iteration, restarted, restart_reasons, run, phase, 1 AS n FROM pe
          UNION ALL SELECT "case", iteration, inner_iteration, CASE WHEN iteration % 11 = 5 THEN NOT restarted ELSE restarted END,
            restart_reasons, run, phase, -1 FROM pe WHERE iteration % 9 <> 4),
        d AS (SELECT * EXCLUDE (n), sum(n) AS n FROM x GROUP BY ALL)
        SELECT "case", sum(greatest(n, 0))::BIGINT AS only_first, sum(greatest(-n, 0))::BIGINT AS only_second,
          sum(abs(n)) = 0 AS identical FROM d GROUP BY 1""",
)
def _(t):
    """A second execution lacks some events and restarts at others."""
    first = policy(t)
    flipped = F.when(F.col("iteration") % 11 == 5, ~F.col("restarted")).otherwise(F.col("restarted"))
    second = first.where(F.col("iteration") % 9 != 4).withColumn("restarted", flipped)
    return rl.policy_differences(first, second, ["case"])
