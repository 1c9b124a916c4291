"""Checks and summaries of solver run logs.

A run is ``(case, run, phase)`` unless other keys are given.  Group sizes are never
assumed small: order-dependent checks use the blocked helpers, sets are compared by
aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import close, count_if, every, finite, reason_list, scaled_gap
from ..functions.ordered import BLOCK, previous

RUN = ("case", "run", "phase")
# The reasons a restart may carry.
REASONS = (
    "forced_first",
    "sufficient_decay",
    "necessary_decay_no_local_progress",
    "long_inner_loop",
)
COMPONENTS = ("primal_feasibility", "box", "stationarity")


def _nonnegative(name: str) -> Column:
    return finite(name) & (F.col(name) >= 0)


def _positive(name: str) -> Column:
    return finite(name) & (F.col(name) > 0)


def _snapshot_ok(name: str) -> Column:
    ok = _nonnegative(f"{name}.kkt_combined_norm") & _nonnegative(f"{name}.normalized_combined_norm")
    for part in ("paper_raw", "paper_normalized"):
        for component in COMPONENTS:
            ok = ok & _nonnegative(f"{name}.{part}.{component}")
    return F.coalesce(ok & F.col(f"{name}.paper_stopping_satisfied").isNotNull(), F.lit(False))


def _not(cond: Column) -> Column:
    return ~F.coalesce(cond, F.lit(False))


def trajectory_conditions() -> list[tuple[str, Column]]:
    multiplier = F.col("minimum_original_inequality_multiplier")
    return [
        ("record_type", _not(F.col("record_type") == "trajectory")),
        ("labels", F.col("case").isNull() | F.col("run").isNull() | F.col("phase").isNull()),
        ("iteration", _not(F.col("iteration") > 0)),
        ("inner_iteration", _not(F.col("inner_iteration") > 0)),
        ("elapsed", _not(_nonnegative("iteration_loop_elapsed_seconds"))),
        (
            "objective",
            _not(finite("scaled_variable_objective") & finite("original_variable_objective")),
        ),
        ("scaled_residuals", ~_snapshot_ok("scaled_residuals")),
        ("original_residuals", ~_snapshot_ok("original_residuals")),
        ("kkt_target", F.col("kkt_target_satisfied").isNull()),
        (
            "equality_residual",
            _not(
                _nonnegative("maximum_equality_solve_relative_residual")
                & _nonnegative("maximum_equality_solve_infinity_residual")
            ),
        ),
        ("multiplier", multiplier.isNotNull() & ~finite(multiplier)),
        ("sigma", _not(_positive("sigma"))),
        ("restart_count", _not(F.col("restart_count") >= 0)),
    ]


def policy_conditions(interval: int) -> list[tuple[str, Column]]:
    """Row checks that need no run settings."""
    reasons = F.col("restart_reasons")
    previous_merit = F.col("previous_checkpoint_merit")
    u = "sigma_update"
    ratio = F.col(f"{u}.infeasibility_ratio")
    amounts = [f"{u}.{n}" for n in ("delta_x", "delta_y", "primal_infeasibility", "dual_infeasibility")]
    bad_amount = F.lit(False)
    for name in amounts:
        bad_amount = bad_amount | _not(_nonnegative(name))
    allowed = F.array(*[F.lit(r) for r in REASONS])
    return [
        ("record_type", _not(F.col("record_type") == "policy_event")),
        ("labels", F.col("case").isNull() | F.col("run").isNull() | F.col("phase").isNull()),
        ("iteration", _not((F.col("iteration") > 0) & (F.col("iteration") % interval == 0))),
        ("inner_iteration", _not(F.col("inner_iteration") > 0)),
        ("merit", _not(_nonnegative("merit") & _nonnegative("reference_merit"))),
        (
            "previous_merit",
            previous_merit.isNotNull() & _not(_nonnegative("previous_checkpoint_merit")),
        ),
        ("unknown_reason", F.size(F.array_except(reasons, allowed)) > 0),
        ("restarted", _not(F.col("restarted") == (F.size(reasons) > 0))),
        ("restart_count", _not(F.col("restart_count") >= 0)),
        ("accepted", _not(F.col(f"{u}.attempted") | ~F.col(f"{u}.accepted"))),
        ("movement", bad_amount),
        ("ratio", ratio.isNotNull() & _not(finite(ratio) & (ratio >= 0))),
        ("sigma", _not(_positive(f"{u}.sigma_before") & _positive(f"{u}.sigma_after"))),
        ("reason_text", _not(F.length(f"{u}.reason") > 0)),
    ]


def _check(df: DataFrame, conditions, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    tagged = df.withColumn("reasons", reason_list(conditions))
    checks = tagged.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        count_if(F.size("reasons") > 0).alias("invalid"),
        every(F.size("reasons") == 0).alias("passed"),
    )
    return checks, tagged.where(F.size("reasons") > 0)


def validate_trajectory_rows(
    run_log: DataFrame, keys: Sequence[str] = RUN
) -> tuple[DataFrame, DataFrame]:
    """Per run: rows, invalid rows and the flag; and the rejected rows with reasons."""
    return _check(run_log, trajectory_conditions(), keys)


def validate_policy_rows(
    policy_event: DataFrame, settings: DataFrame, interval: int, keys: Sequence[str] = RUN
) -> tuple[DataFrame, DataFrame]:
    """As above, with ``settings(keys, adaptive_sigma, restart)`` of each run."""
    joined = policy_event.join(
        settings.select(*keys, "adaptive_sigma", F.col("restart").alias("restart_enabled")),
        list(keys),
        "left",
    )
    adaptive = F.coalesce("adaptive_sigma", F.lit(False))
    enabled = F.coalesce("restart_enabled", F.lit(False))
    due = adaptive & (F.col("restarted") | ~enabled)
    extra = [
        ("restart_disabled", _not(enabled | ~F.col("restarted"))),
        ("attempted", _not(F.col("sigma_update.attempted") == due)),
    ]
    return _check(joined, policy_conditions(interval) + extra, keys)


def compare_sets(
    got: DataFrame, want: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Keys on one side only, by one aggregation of marked rows."""
    marked = got.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("w")).unionByName(
        want.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("w"))
    )
    sums = marked.groupBy(*keys).agg(F.max("g").alias("g"), F.max("w").alias("w"))
    side = F.when(F.col("w") == 0, "unexpected").otherwise("missing")
    return sums.where(F.col("g") != F.col("w")).select(*keys, side.alias("side"))


def log_coverage(run_log: DataFrame, expected: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Runs that are logged but not expected, or expected but not logged."""
    return compare_sets(run_log, expected, keys)


def unknown_event_runs(
    policy_event: DataFrame, expected: DataFrame, keys: Sequence[str] = RUN
) -> DataFrame:
    """Event runs outside the expected ones (events may be fewer, not other)."""
    return policy_event.select(*keys).distinct().join(expected, list(keys), "left_anti")


def _multiples(last: Column, interval: int) -> Column:
    """How many multiples of ``interval`` lie in 1 .. last; 0 if unknown."""
    return F.greatest(F.coalesce(F.floor(last / F.lit(interval)), F.lit(0)), F.lit(0)).cast("bigint")


def _multiple(interval: int) -> Column:
    """Which multiple of ``interval`` the iteration is, from 1; null if it is none."""
    step, at = F.lit(interval), F.col("iteration")
    return F.when((at > 0) & (F.pmod(at, step) == 0), F.floor(at / step).cast("bigint"))


def expected_sampling_grid(
    runs: DataFrame, events: DataFrame, logged: DataFrame, interval: int, keys: Sequence[str] = RUN
) -> DataFrame:
    """Logged iterations against {1, last, multiples of interval, event iterations}.

    ``runs(keys, iterations)``.  Per run: iterations missing, unexpected and repeated.  Multiples are
    counted and not listed, as their number grows with runs times iterations: arithmetic tells
    whether a logged or named iteration is one, and the others of their number are missing.
    """
    keys = list(keys)
    one = F.lit(1).cast("bigint")
    first = runs.select(*keys, one.alias("iteration"))
    last = runs.where(F.col("iterations") > 0).select(*keys, F.col("iterations").alias("iteration"))
    want = first.unionByName(last).unionByName(events.select(*keys, F.col("iteration")))
    marked = want.select(*keys, "iteration", (one * 0).alias("g"), one.alias("w")).unionByName(
        logged.select(*keys, "iteration", one.alias("g"), (one * 0).alias("w"))
    )
    per_iteration = marked.groupBy(*keys, "iteration").agg(
        F.sum("g").alias("g"), F.max("w").alias("w")
    )
    sized = runs.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.max(_multiples(F.col("iterations"), interval)).alias("_due")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on_grid = F.coalesce(_multiple(interval) <= F.col("_due"), F.lit(False))
    placed = per_iteration.join(sized, same, "left").withColumn("_on", on_grid)
    wanted = (F.col("w") == 1) | F.col("_on")
    absent = F.coalesce(F.max("_due"), F.lit(0)) - count_if(F.col("_on"))
    result = placed.groupBy(*keys).agg(
        (count_if((F.col("g") == 0) & wanted) + absent).alias("missing"),
        count_if((F.col("g") > 0) & ~wanted).alias("unexpected"),
        count_if(F.col("g") > 1).alias("repeated"),
    )
    passed = (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("repeated") == 0)
    return result.withColumn("passed", passed)


def policy_cadence(
    runs: DataFrame, events: DataFrame, interval: int, keys: Sequence[str] = RUN
) -> DataFrame:
    """Events at every interval up to the last eligible iteration; none when disabled.

    ``runs(keys, iterations, converged, adaptive_sigma, restart)``.  Iterations that are due are
    counted and not listed; a run with several rows has an iteration due once for each that reaches it.
    """
    keys = list(keys)
    enabled = F.coalesce(F.col("adaptive_sigma") | F.col("restart"), F.lit(False))
    last = F.col("iterations") - F.when(F.col("converged"), 1).otherwise(0)
    due = F.when(enabled, _multiples(last, interval)).otherwise(F.lit(0).cast("bigint"))
    sized = runs.select(*keys, due.alias("_due")).groupBy(*keys).agg(
        F.sum("_due").alias("expected_events"),
        F.max("_due").alias("_most"),
        F.collect_list(F.when(F.col("_due") > 0, F.col("_due"))).alias("_reach"),
    )
    at = _multiple(interval)
    times = F.when(
        at.isNotNull() & F.col("_reach").isNotNull(), F.size(F.filter("_reach", lambda d: d >= at))
    ).otherwise(0)
    seen = events.groupBy(*keys, "iteration").agg(F.count("*").alias("g"))
    placed = seen.join(sized.select(*keys, "_reach"), keys).withColumn("w", times)
    found = placed.groupBy(*keys).agg(
        count_if(F.col("g") != F.col("w")).alias("_off"), count_if(F.col("w") > 0).alias("_met")
    )
    zero = F.lit(0).cast("bigint")
    unmet = F.col("_most") - F.coalesce("_met", zero)
    diff = sized.join(found, keys, "left").select(
        *keys, "expected_events", (unmet + F.coalesce("_off", zero)).alias("differences")
    )
    joined = runs.select(*keys).join(diff, keys, "left").na.fill(0, ["expected_events", "differences"])
    return joined.withColumn("passed", F.col("differences") == 0)


def event_counts(policy_event: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Attempts, acceptances, restarts and events per reason."""
    return policy_event.groupBy(*keys).agg(
        F.count("*").alias("events"),
        count_if(F.col("sigma_update.attempted")).alias("attempts"),
        count_if(F.col("sigma_update.accepted")).alias("accepted"),
        count_if(F.col("restarted")).alias("restarts"),
        *[count_if(F.array_contains("restart_reasons", r)).alias(r) for r in REASONS],
    )


def last_iteration(run_log: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The row of the largest iteration per key; a partial maximum, no sort."""
    row = F.max_by(F.struct(*cols), "iteration").alias("_last")
    return run_log.groupBy(*keys).agg(F.max("iteration").alias("iteration"), row).select(
        *keys, "iteration", "_last.*"
    )


def final_row_match(
    run_log: DataFrame,
    summary: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = RUN,
    rtol: float = 1e-12,
    atol: float = 1e-12,
) -> DataFrame:
    """The last log row against the run summary: iteration and numbers within tolerance."""
    final = last_iteration(run_log, keys, cols)
    wanted = summary.select(
        *keys, F.col("iterations"), *[F.col(c).alias(f"_want_{c}") for c in cols]
    )
    joined = wanted.join(final, list(keys), "left")
    pairs = [("iteration", ~F.col("iteration").eqNullSafe(F.col("iterations")))]
    pairs += [(c, ~close(F.col(c), F.col(f"_want_{c}"), rtol, atol)) for c in cols]
    return joined.select(*keys, reason_list(pairs).alias("differences")).withColumn(
        "passed", F.size("differences") == 0
    )


def monotone_restart_count(
    policy_event: DataFrame,
    summary: DataFrame,
    keys: Sequence[str] = RUN,
    block: int = BLOCK,
) -> DataFrame:
    """Restart counts never fall and end at the summary's count."""
    keys = list(keys)
    stepped = previous(
        policy_event.select(*keys, "iteration", "restart_count"),
        keys,
        "iteration",
        {"_before": "restart_count"},
        block,
    )
    fall = F.col("_before") > F.col("restart_count")
    found = stepped.groupBy(*keys).agg(
        count_if(F.coalesce(fall, F.lit(False))).alias("decreases"),
        F.max_by("restart_count", "iteration").alias("last_count"),
    )
    joined = found.join(summary.select(*keys, F.col("restart_count").alias("expected")), keys, "left")
    passed = (F.col("decreases") == 0) & F.col("last_count").eqNullSafe(F.col("expected"))
    return joined.withColumn("passed", passed)


def trajectory_comparison(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    objective: str,
    residual: str,
    components: Sequence[str] = (),
) -> DataFrame:
    """Two logs of the same runs: same grid, and largest gaps on common iterations."""
    keys = list(keys)
    cols = [objective, residual, *components]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            *keys, "iteration", F.lit(True).alias(tag), *[F.col(c).alias(f"{tag}_{c}") for c in cols]
        )

    pair = side(a, "_a").join(side(b, "_b"), [*keys, "iteration"], "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def gap(c: str) -> Column:
        return F.abs(F.col(f"_b_{c}") - F.col(f"_a_{c}"))

    worst = F.greatest(*[gap(c) for c in components], F.lit(0.0)) if components else F.lit(0.0)
    zero = F.lit(0.0)
    return pair.groupBy(*keys).agg(
        every(both).alias("iteration_grid_matches"),
        count_if(both).alias("samples"),
        count_if(F.col("_a").isNotNull()).alias("first_samples"),
        count_if(F.col("_b").isNotNull()).alias("second_samples"),
        F.coalesce(
            F.max(F.when(both, scaled_gap(f"_b_{objective}", f"_a_{objective}"))), zero
        ).alias("max_objective_gap"),
        F.coalesce(F.max(F.when(both, gap(residual))), zero).alias("max_residual_gap"),
        F.coalesce(F.max(F.when(both, worst)), zero).alias("max_component_gap"),
    )


#: The only column of a log that two equal executions may differ in.
ELAPSED = "iteration_loop_elapsed_seconds"


def determinism_check(
    a: DataFrame, b: DataFrame, keys: Sequence[str], ignore: Sequence[str] = (ELAPSED,)
) -> DataFrame:
    """Rows that occur a different number of times in the two logs, elapsed time aside.

    Multisets are compared by one signed count per distinct row.
    """
    cols = [c for c in a.columns if c not in ignore]
    marked = a.select(*cols, F.lit(1).alias("_n")).unionByName(b.select(*cols, F.lit(-1).alias("_n")))
    odd = marked.groupBy(*cols).agg(F.sum("_n").alias("_n"))
    found = odd.groupBy(*keys).agg(
        F.sum(F.when(F.col("_n") > 0, F.col("_n")).otherwise(0)).alias("only_first"),
        F.sum(F.when(F.col("_n") < 0, -F.col("_n")).otherwise(0)).alias("only_second"),
    )
    return found.withColumn(
        "identical", (F.col("only_first") == 0) & (F.col("only_second") == 0)
    )


def run_summary(
    run_log: DataFrame, policy_event: DataFrame, interval: int, keys: Sequence[str] = RUN
) -> DataFrame:
    """Iterations, penalty range and event counts of each run, with the cadence flag.

    The two tables are reduced to one row per run before they meet.
    """
    keys = list(keys)
    logs = run_log.groupBy(*keys).agg(
        F.max("iteration").alias("iterations"),
        F.count("*").alias("rows"),
        F.min_by("sigma", "iteration").alias("sigma_initial"),
        F.max_by("sigma", "iteration").alias("sigma_final"),
        F.min("sigma").alias("sigma_minimum"),
        F.max("sigma").alias("sigma_maximum"),
        F.max_by("restart_count", "iteration").alias("restart_count"),
    )
    counts = event_counts(policy_event, keys)
    cadence = policy_event.groupBy(*keys).agg(
        every(F.col("iteration") % interval == 0).alias("cadence_valid")
    )
    joined = logs.join(counts, keys, "left").join(cadence, keys, "left")
    names = ["events", "attempts", "accepted", "restarts", *REASONS]
    return joined.na.fill(0, names).withColumn(
        "cadence_valid", F.coalesce("cadence_valid", F.lit(True))
    )


def ablation_table(
    run_summary: DataFrame, settings: DataFrame, metric: str, controls: Sequence[str]
) -> DataFrame:
    """Mean of ``metric`` by preprocessing and initial penalty, one column per control."""
    joined = run_summary.join(settings, "run")
    cells = [
        F.avg(F.when(F.col("control") == c, F.col(metric))).alias(c) for c in controls
    ]
    return joined.groupBy("preprocessing", "initial_sigma").agg(F.count("*").alias("runs"), *cells)


def policy_schedule(policy_event: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """What two executions must share: iteration counters, restarts and reasons."""
    return policy_event.select(
        *keys, "iteration", "inner_iteration", "restarted", "restart_reasons"
    )


def policy_differences(a: DataFrame, b: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Per ``keys``: schedule rows of one execution that the other lacks, and the verdict."""
    return determinism_check(policy_schedule(a), policy_schedule(b), keys, ignore=())
