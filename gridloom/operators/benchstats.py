"""Statistics of recorded timings and comparisons of recorded vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    TINY,
    close,
    every,
    finite,
    known_max,
    norm,
    scaled_gap,
    whole_sum,
)
from ..functions.ordered import exact_quantiles, position
from ..session import spread


def timing_statistics(
    timing: DataFrame, runs: DataFrame, keys: Sequence[str] = ("run",)
) -> DataFrame:
    """Count, median, range, sample deviation and quartile range per run.

    Runs without a sample keep a row of nulls with count 0.  Raw samples stay in
    ``timing``; they are not gathered into one value.
    """
    keys = list(keys)
    x = F.col("wall_seconds")
    basic = timing.groupBy(*keys).agg(
        F.count("wall_seconds").alias("count"),
        F.min(x).alias("minimum_seconds"),
        F.max(x).alias("maximum_seconds"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("standard_deviation_seconds"),
    )
    cuts = exact_quantiles(
        timing, keys, "wall_seconds", {"_q1": 0.25, "median_seconds": 0.5, "_q3": 0.75}
    )
    span = F.col("maximum_seconds") - F.col("minimum_seconds")
    joined = runs.select(*keys).join(basic, keys, "left").join(cuts, keys, "left")
    return joined.select(
        *keys,
        F.coalesce("count", F.lit(0)).alias("count"),
        "median_seconds",
        "minimum_seconds",
        "maximum_seconds",
        F.when(F.col("count") > 0, F.col("standard_deviation_seconds")).alias(
            "standard_deviation_seconds"
        ),
        (F.col("_q3") - F.col("_q1")).alias("interquartile_range_seconds"),
        (span / F.greatest(F.col("median_seconds"), F.lit(TINY))).alias("relative_range"),
    )


def percentile_linear(
    values: DataFrame, value: str, q: float, keys: Sequence[str]
) -> DataFrame:
    return exact_quantiles(values, keys, value, {"percentile": q})


def timing_distribution(
    timing: DataFrame, keys: Sequence[str] = ("run",)
) -> DataFrame:
    """Quartiles, range and the median absolute deviation (a second pass over the median)."""
    keys = list(keys)
    cuts = exact_quantiles(
        timing,
        keys,
        "wall_seconds",
        {"first_quartile": 0.25, "median": 0.5, "third_quartile": 0.75},
    )
    spans = timing.groupBy(*keys).agg(
        F.min("wall_seconds").alias("minimum"), F.max("wall_seconds").alias("maximum")
    )
    away = timing.join(cuts.select(*keys, "median"), keys).withColumn(
        "_away", F.abs(F.col("wall_seconds") - F.col("median"))
    )
    mad = exact_quantiles(away, keys, "_away", {"median_absolute_deviation": 0.5})
    return cuts.join(spans, keys).join(mad, keys)


def select_measured_runs(
    timing: DataFrame,
    correctness: DataFrame,
    first: int = 5,
    most: int = 9,
    threshold: float = 0.2,
) -> tuple[DataFrame, DataFrame]:
    """The repetitions that count, and per run why.

    The first ``first`` repetitions count, or ``most`` when their relative range exceeds
    the threshold.  A failed repetition on the way, too few of them, or a failed
    correctness run gives none.  Only the first ``most`` repetitions by order are kept
    before anything is grouped, so groups are small by construction.
    """
    ranked = position(timing, ["run"], "repetition", "_rank").where(F.col("_rank") < most)
    head = F.when(F.col("_rank") < first, F.col("wall_seconds"))
    facts = ranked.groupBy("run").agg(
        F.count("*").alias("available"),
        F.min(F.when(~F.col("passed"), F.col("_rank"))).alias("_failed_at"),
        F.percentile(head, 0.5).alias("_median"),
        (F.max(head) - F.min(head)).alias("_span"),
    )
    escalated = F.col("_span") / F.greatest(F.col("_median"), F.lit(TINY)) > threshold
    facts = facts.join(
        correctness.select("run", F.col("passed").alias("_correct")), "run", "left"
    ).withColumn("escalated", escalated & (F.col("available") >= first))
    target = F.when(F.col("escalated"), most).otherwise(first)
    status = (
        F.when(~F.coalesce("_correct", F.lit(False)), "NOT_RUN_CORRECTNESS_FAILED")
        .when(F.col("_failed_at") < target, "FAILED")
        .when(F.col("available") < target, "INCOMPLETE")
        .otherwise("COMPLETE")
    )
    decided = facts.select("run", "escalated", target.alias("_target"), status.alias("status"))
    chosen = ranked.join(decided.where(F.col("status") == "COMPLETE"), "run").where(
        F.col("_rank") < F.col("_target")
    )
    return chosen.select(*timing.columns), decided.drop("_target")


STATISTICS = (
    "median_seconds",
    "minimum_seconds",
    "maximum_seconds",
    "standard_deviation_seconds",
    "interquartile_range_seconds",
    "relative_range",
)


def audit_statistics(recomputed: DataFrame, stored: DataFrame, rtol: float = 1e-12) -> DataFrame:
    """Stored statistics against recomputed ones, with the names that differ."""
    names = ["count", *STATISTICS]
    pair = stored.select("run", *[F.col(n).alias(f"_s_{n}") for n in names]).join(
        recomputed, "run", "full_outer"
    )
    bad = F.array_compact(
        F.array(*[F.when(~close(F.col(n), F.col(f"_s_{n}"), rtol), F.lit(n)) for n in names])
    )
    return pair.select("run", bad.alias("differences")).withColumn(
        "passed", F.size("differences") == 0
    )


# Accepted slope range, least R squared and largest spread.
SLOPE_RANGE = (0.6, 1.4)
MINIMUM_R_SQUARED = 0.85
MAXIMUM_SPREAD = 4.0


def log_log_fit(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Line through log(seconds) over log(work), and the spread of seconds per work.

    A group with a point that has no logarithm (null, NaN, infinite, zero or negative) is
    rejected: its numbers are null, it does not pass, and ``bad_points`` counts such points.
    """
    good = finite("work") & finite("seconds") & (F.col("work") > 0) & (F.col("seconds") > 0)
    x, y = F.when(good, F.ln("work")), F.when(good, F.ln("seconds"))
    rate = F.when(good, F.col("seconds") / F.col("work"))
    bad = F.count_if(~F.coalesce(good, F.lit(False)))
    whole = lambda value: F.when(bad == 0, value)
    fit = points.groupBy(*keys).agg(
        whole(F.regr_slope(y, x)).alias("slope"),
        whole(F.regr_intercept(y, x)).alias("intercept"),
        whole(F.coalesce(F.regr_r2(y, x), F.lit(1.0))).alias("r_squared"),
        whole(F.max(rate) / F.min(rate)).alias("spread"),
        bad.alias("bad_points"),
    )
    passed = (
        F.col("slope").between(*SLOPE_RANGE)
        & (F.col("r_squared") >= MINIMUM_R_SQUARED)
        & (F.col("spread") <= MAXIMUM_SPREAD)
    )
    return fit.withColumn("passed", F.coalesce(passed, F.lit(False)))


def speedup(distribution: DataFrame, baseline: str, other: str) -> DataFrame:
    """Ratio of the baseline's median to the other's per phase; null without a baseline."""

    def pick(name: str) -> Column:
        return F.max(F.when(F.col("backend") == name, F.col("median")))

    return distribution.groupBy("phase").agg((pick(baseline) / pick(other)).alias("speedup"))


def scaled_gaps(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("gap", scaled_gap(a, b))


def relative_error(
    a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, group: Sequence[str] = ("case_id",)
) -> DataFrame:
    """L2 error over max(1, norm) and over the norm itself; both are null if a value is unknown or
    a position is on one side only.  ``unmatched`` counts such positions."""
    pair = _pairs(a, b, keys, value)
    error, size = norm(F.col("_a") - F.col("_b")), norm("_b")
    return pair.groupBy(*group).agg(
        (error / _at_least(1.0, size)).alias("scaled_error"),
        (error / _at_least(TINY, size)).alias("relative_error"),
        F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("unmatched"),
    )


def _pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Both sides' values of every position, with marks of the sides that list it."""
    yes = F.lit(True)
    return a.select(*keys, F.col(value).alias("_a"), yes.alias("_in_a")).join(
        b.select(*keys, F.col(value).alias("_b"), yes.alias("_in_b")), list(keys), "full_outer"
    )


def _at_least(low: float, value: Column) -> Column:
    """The larger of both; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), value))


def compare_vectors(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    value: str,
    group: Sequence[str],
    rtol: float | None = None,
    atol: float | None = None,
) -> DataFrame:
    """Same positions, finite values, relative and largest error, and the gates given."""
    pair = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(
        b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), list(keys), "full_outer"
    )
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    known = both & finite("_a") & finite("_b")
    gap = F.when(known, F.col("_a") - F.col("_b"))
    size = F.sqrt(F.coalesce(F.sum(F.when(known, F.col("_b") ** 2)), F.lit(0.0)))
    infinite = F.lit(float("inf"))
    facts = pair.groupBy(*group).agg(
        every(both).alias("shape_matches"),
        every(known).alias("_known"),
        every(
            (F.col("_in_a").isNull() | finite("_a")) & (F.col("_in_b").isNull() | finite("_b"))
        ).alias("finite"),
        (F.sqrt(F.sum(gap**2)) / F.greatest(F.lit(1.0), size)).alias("_relative"),
        F.max(F.abs(gap)).alias("_largest"),
    )
    usable = F.col("shape_matches") & F.col("finite")
    facts = facts.withColumn(
        "relative_error", F.when(usable, F.col("_relative")).otherwise(infinite)
    ).withColumn("maximum_absolute_error", F.when(usable, F.col("_largest")).otherwise(infinite))
    passed = usable
    if rtol is not None:
        passed = passed & (F.col("relative_error") <= rtol)
    if atol is not None:
        passed = passed & (F.col("maximum_absolute_error") <= atol)
    return facts.withColumn("passed", passed).drop("_known", "_relative", "_largest")


def compare_states(
    a: DataFrame, b: DataFrame, rtol: float | None = None, atol: float | None = None
) -> DataFrame:
    """Blocks x, y and z of ``(case_id, block, position, value)`` and their maxima."""
    keys = ["case_id", "block", "position"]
    blocks = compare_vectors(a, b, keys, "value", ["case_id", "block"], rtol, atol)
    return blocks.groupBy("case_id").agg(
        F.max("relative_error").alias("maximum_relative_error"),
        F.max("maximum_absolute_error").alias("maximum_absolute_error"),
        every(F.col("passed")).alias("passed"),
    )


def solution_error_metrics(
    gram: DataFrame, rhs: DataFrame, candidate: DataFrame, direct: DataFrame
) -> DataFrame:
    """Errors of a candidate against a direct solution, and its system residual.

    ``gram(case_id, r1, r2, value)``; vectors are ``(case_id, row, value)``.  Errors over an
    unknown value or a row of one side only are null, and ``unmatched`` counts such rows; a
    residual over an unknown value is null.  The products are dealt to all tasks by row before they
    are summed, so that no task sums more rows than its share.
    """
    keys = ["case_id", "row"]
    pair = _pairs(candidate, direct, keys, "value")
    gap = F.col("_a") - F.col("_b")
    l2, size = norm(gap), norm("_b")
    largest = known_max(F.abs(gap))
    errors = pair.groupBy("case_id").agg(
        l2.alias("absolute_error_l2"),
        largest.alias("maximum_component_error"),
        (l2 / _at_least(TINY, size)).alias("relative_solution_error"),
        (l2 / _at_least(1.0, size)).alias("scaled_solution_error"),
        (largest / _at_least(1.0, known_max(F.abs("_b")))).alias("scaled_component_error"),
        F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("unmatched"),
    )
    product = gram.join(
        candidate.select("case_id", F.col("row").alias("r2"), F.col("value").alias("_c")),
        ["case_id", "r2"],
        "left",
    ).select("case_id", F.col("r1").alias("row"), (F.col("value") * F.col("_c")).alias("p"), F.lit(0.0).alias("b"))
    wanted = rhs.select(*keys, F.lit(0.0).alias("p"), F.col("value").alias("b"))
    rows = spread(product.unionByName(wanted), *keys).groupBy(*keys).agg(
        whole_sum("p").alias("p"), whole_sum("b").alias("b")
    )
    residual = rows.groupBy("case_id").agg(
        (norm(F.col("p") - F.col("b")) / _at_least(1.0, norm("b"))).alias("normalized_system_residual")
    )
    return errors.join(residual, "case_id", "full_outer")


def track_summary(tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flatten one solver track per row; a missing track is NOT_RUN.

    ``tracks(keys, track)`` with ``track`` of schema ``schemas.TRACK``.
    """
    t = "track"
    status = F.coalesce(f"{t}.correctness.status", f"{t}.timing_status", F.lit("UNKNOWN"))
    timeout = F.when(
        F.col(f"{t}.correctness.status") == "TIME_LIMIT", F.col(f"{t}.correctness.wall_seconds")
    )
    s, c = f"{t}.statistics", f"{t}.correctness"
    return tracks.select(
        *keys,
        F.when(F.col(t).isNull(), "NOT_RUN").otherwise(status).alias("status"),
        F.col(f"{s}.median_seconds").alias("median_seconds"),
        F.col(f"{s}.minimum_seconds").alias("minimum_seconds"),
        F.col(f"{s}.maximum_seconds").alias("maximum_seconds"),
        F.col(f"{s}.interquartile_range_seconds").alias("interquartile_range_seconds"),
        F.col(f"{s}.standard_deviation_seconds").alias("standard_deviation_seconds"),
        F.col(f"{s}.count").alias("measured_repetitions"),
        timeout.alias("timeout_seconds"),
        F.col(f"{c}.iterations").alias("iterations"),
        F.col(f"{c}.restart_count").alias("restart_count"),
        F.col(f"{c}.candidate.objective").alias("objective"),
        F.col(f"{c}.candidate.residuals.kkt_combined_norm").alias("raw_kkt"),
        F.col(f"{c}.candidate.physical_validation.maximum_violation").alias("physical_violation"),
        F.col(f"{c}.candidate.scaled_objective_gap_to_highs").alias("objective_gap"),
    )


# Track names of the evidence and their column prefix.
TRACKS = {"highs": "highs", "cpu_fp64_sgs_hpr": "cpu", "gpu_fp64_sgs_hpr": "gpu"}
TIMES = {
    "median": "median_seconds",
    "minimum": "minimum_seconds",
    "maximum": "maximum_seconds",
    "iqr": "interquartile_range_seconds",
    "standard_deviation": "standard_deviation_seconds",
}
BY_TRACK = {
    "cpu": {"timeout_seconds": "timeout_seconds"},
    "gpu": {
        "iterations": "iterations",
        "restart_count": "restart_count",
        "objective": "objective",
        "raw_kkt": "raw_kkt",
        "physical_violation": "physical_violation",
        "objective_gap": "objective_gap",
    },
}


def _difference_pct(actual: Column, paper: Column) -> Column:
    return F.when(paper != 0, 100.0 * (actual - paper) / paper)


def benchmark_table(evidence: DataFrame, continuation: DataFrame | None = None) -> DataFrame:
    """One row per case with its three tracks side by side, then the continuation rows.

    Tracks are read from the map of the case itself, so no pivot or join is needed.
    """
    cases = evidence.select("stage", F.explode("cases").alias("c")).select("stage", "c.*")
    paper = F.col("structural_reconciliation.published_nnz")
    actual = F.col("construction.dimensions.nnz_A")
    wide = cases.select(
        F.lit("").alias("sequence"),
        "stage",
        F.col("key").alias("case_key"),
        F.col("construction.dimensions.m").alias("m"),
        F.col("construction.dimensions.n").alias("n"),
        paper.alias("paper_nnz"),
        actual.alias("reconstructed_nnz"),
        _difference_pct(actual, paper).alias("nnz_difference_pct"),
        F.coalesce("full_lp_allocation_attempted", F.lit(True)).alias("full_lp_allocated"),
        F.col("status").alias("row_status"),
        *[F.element_at("solver_tracks", n).alias(p) for n, p in TRACKS.items()],
    )
    base = [c for c in wide.columns if c not in TRACKS.values()]
    for prefix in TRACKS.values():
        flat = track_summary(wide.withColumnRenamed(prefix, "track"), [c for c in wide.columns if c != prefix])
        fields = {"status": "status"}
        fields.update({f"{short}_seconds": name for short, name in TIMES.items()})
        fields["measured_repetitions"] = "measured_repetitions"
        fields.update(BY_TRACK.get(prefix, {}))
        named = [F.col(source).alias(f"{prefix}_{target}") for target, source in fields.items()]
        wide = flat.select(*[c for c in wide.columns if c != prefix], *named)
        base += [f"{prefix}_{target}" for target in fields]
    wide = wide.select(*base)
    if continuation is None:
        return wide
    rest = continuation.select(F.explode("cases").alias("c")).select("c.*")
    paper, actual = F.col("resource_estimate.paper_nnz"), F.col("resource_estimate.exact_reconstructed_nnz")
    tail = rest.select(
        F.col("sequence").cast("string").alias("sequence"),
        F.lit(8).cast("bigint").alias("stage"),
        F.col("key").alias("case_key"),
        F.col("resource_estimate.row_count").alias("m"),
        F.col("resource_estimate.column_count").alias("n"),
        paper.alias("paper_nnz"),
        actual.alias("reconstructed_nnz"),
        F.when(actual != 0, _difference_pct(actual, paper)).alias("nnz_difference_pct"),
        F.col("full_lp_allocation_attempted").alias("full_lp_allocated"),
        F.col("status").alias("row_status"),
        F.lit("NOT_RUN").alias("highs_status"),
        F.lit("SKIPPED_BY_APPROVED_SCOPE").alias("cpu_status"),
        F.lit("NOT_RUN").alias("gpu_status"),
    )
    return wide.unionByName(tail, allowMissingColumns=True)


# Timing boundaries in report order.
BOUNDARY_ORDER = (
    "CUDA initialization",
    "CPU matrix construction and preprocessing",
    "first-run compilation and warm-up",
    "allocation",
    "host-to-device transfer",
    "GPU solver initialization",
    "iteration loop",
    "residual checks",
    "device-to-host transfer",
    "complete end-to-end wall time",
)


def timing_decomposition(
    evidence: DataFrame, order: Sequence[str] = BOUNDARY_ORDER, keys: Sequence[str] = ()
) -> DataFrame:
    """Seconds, status and method of each boundary, with its place in the list."""
    names = F.posexplode(F.array(*[F.lit(n) for n in order])).alias("position", "boundary")
    rows = evidence.select(*keys, "timing_boundaries.boundaries", names)
    cell = F.element_at("boundaries", F.col("boundary"))
    return rows.select(
        *keys, "position", "boundary", cell["seconds"].alias("seconds"), cell["status"].alias("status"),
        cell["method"].alias("method"),
    )
