"""Dispatch tables against every physical constraint family.

Violations share one shape: ``(case_id, family, side, period, element, value)`` with value
0 where the constraint holds, so that counts of checks and maxima come from one table.  A value
that cannot be computed is null, and dispatch of a device that is not listed has the side
``unknown_device`` and an infinite value: neither passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    INF,
    absent_as_zero,
    finite,
    known_max,
    positive_part,
    unknown,
    whole_sum,
)
from ..functions.ordered import BLOCK, running_sum
from ..session import unfolded
from .algebra import COL, row_activity

SHAPE = ["case_id", "family", "side", "period", "element", "value"]
DEVICE = ["case_id", "pos"]
#: Set by the joins below where the device of a row is listed.
LISTED = "_listed"


def _unfold(
    df: DataFrame, family: str, element: Column, sides: dict[str, Column], period: Column | None = None
) -> DataFrame:
    period = F.col("period") if period is None else period
    side = lambda name, value: F.struct(
        F.lit(name).alias("side"), value.cast("double").alias("value")
    )
    packed = F.array(*[side(s, v) for s, v in sides.items()])
    if LISTED in df.columns:
        unknown = F.array(side("unknown_device", F.lit(INF)))
        packed = F.when(F.col(LISTED).isNotNull(), packed).otherwise(unknown)
    out = df.select(
        "case_id",
        F.lit(family).alias("family"),
        period.cast("bigint").alias("period"),
        element.cast("bigint").alias("element"),
        F.explode(packed).alias("_s"),
    )
    return out.select("case_id", "family", "_s.side", "period", "element", "_s.value")


def violation_power_balance(supply: list[tuple[DataFrame, str, float]], load: DataFrame) -> DataFrame:
    """|supply - load| per period; ``supply`` lists (table, column, sign)."""
    terms = load.select("case_id", "period", (-F.col("mw")).alias("mw"))
    for df, value, sign in supply:
        terms = terms.unionByName(
            df.select("case_id", "period", (F.lit(sign) * F.col(value)).alias("mw"))
        )
    sums = terms.groupBy("case_id", "period").agg(whole_sum("mw").alias("mw"))
    return _unfold(sums, "power_balance", F.lit(0), {"equality": F.abs("mw")})


def violation_line_flow(flow: DataFrame, branch: DataFrame) -> DataFrame:
    """|flow| above the rate of limited active branches."""
    limited = F.col("status") & (F.col("rate_mw") > 0) & (F.col("rate_mw") < 1e10)
    rates = branch.withColumn("_limited", F.coalesce(limited, F.lit(False)))
    joined = _with(flow, rates, "rate_mw", "_limited", keys=["case_id", "branch_id"])
    joined = joined.where(F.col(LISTED).isNull() | F.col("_limited"))
    over = positive_part(F.abs("mw") - F.col("rate_mw"))
    return _unfold(joined, "line_flow", F.col("branch_id"), {"magnitude": over})


def _with(dispatch: DataFrame, device: DataFrame, *cols: str, keys: list[str] = DEVICE) -> DataFrame:
    """Dispatch rows beside their device; those of an unknown device stay, unlisted.

    A table with a row per device period counts as unfolded: it is never broadcast.
    """
    known = device.select(*keys, *cols, F.lit(True).alias(LISTED))
    return dispatch.join(unfolded(known) if "period" in keys else known, keys, "left")


def missing_dispatch(device: DataFrame, dispatch: DataFrame, family: str, keys: list[str] = DEVICE) -> DataFrame:
    """Listed devices (with ``period`` in ``keys``: device periods) without a dispatch row."""
    absent = device.select(*keys).distinct().join(dispatch.select(*keys).distinct(), keys, "left_anti")
    period = F.col("period") if "period" in keys else F.lit(None)
    element = F.col("pos") if "pos" in keys else F.lit(0)
    return _unfold(absent, family, element, {"missing_dispatch": F.lit(INF)}, period)


def violation_generator_bounds(dispatch: DataFrame, gen: DataFrame) -> DataFrame:
    both = _with(dispatch, gen, "lower_mw", "upper_mw")
    p = F.col("p_g")
    return _unfold(
        both,
        "generator_bounds",
        F.col("pos"),
        {"lower": positive_part(F.col("lower_mw") - p), "upper": positive_part(p - F.col("upper_mw"))},
    )


def violation_reserve_bounds(dispatch: DataFrame, gen: DataFrame, dt: float = 1.0) -> DataFrame:
    both = _with(dispatch, gen, "ramp_up", "ramp_down")
    up, down = F.col("r_up"), F.col("r_down")
    return _unfold(
        both,
        "reserve_bounds",
        F.col("pos"),
        {
            "up_lower": positive_part(-up),
            "up_upper": positive_part(up - F.col("ramp_up") * F.lit(dt)),
            "down_lower": positive_part(-down),
            "down_upper": positive_part(down - F.col("ramp_down") * F.lit(dt)),
        },
    )


def violation_headroom(dispatch: DataFrame, gen: DataFrame) -> DataFrame:
    both = _with(dispatch, gen, "lower_mw", "upper_mw")
    p = F.col("p_g")
    return _unfold(
        both,
        "reserve_headroom_footroom",
        F.col("pos"),
        {
            "headroom": positive_part(p + F.col("r_up") - F.col("upper_mw")),
            "footroom": positive_part(F.col("lower_mw") + F.col("r_down") - p),
        },
    )


def violation_reserve_requirement(dispatch: DataFrame, profile: DataFrame) -> DataFrame:
    """Requirement minus the reserve held; a period without any dispatch holds none, and one
    without a requirement cannot be checked (null)."""
    held = dispatch.select(
        "case_id", "period", F.col("r_up"), F.col("r_down"), F.lit(None).cast("double").alias("u"),
        F.lit(None).cast("double").alias("d"),
    ).unionByName(
        profile.select(
            "case_id", "period", F.lit(0.0).alias("r_up"), F.lit(0.0).alias("r_down"),
            F.col("reserve_up").alias("u"), F.col("reserve_down").alias("d"),
        )
    )
    sums = held.groupBy("case_id", "period").agg(
        whole_sum("r_up").alias("r_up"), whole_sum("r_down").alias("r_down"),
        F.max("u").alias("u"), F.max("d").alias("d"),
    )
    return _unfold(
        sums,
        "reserve_requirements",
        F.lit(0),
        {"up": positive_part(F.col("u") - F.col("r_up")), "down": positive_part(F.col("d") - F.col("r_down"))},
    )


def violation_ramp(dispatch: DataFrame, gen: DataFrame, dt: float = 1.0) -> DataFrame:
    """Change between consecutive periods against the limits.

    Each output is sent to its own period and to the next one; one aggregation by
    (case, device, period) pairs them, so no device's horizon is sorted in one task.  Changes across
    a missing period are not known: ``ramp_gaps`` lists them.
    """
    paired = _paired(dispatch).where(F.col("_now") & F.col("_before"))
    change = F.col("now") - F.col("before")
    return _unfold(
        _with(paired, gen, "ramp_up", "ramp_down"),
        "generator_ramping",
        F.col("pos"),
        {
            "up": positive_part(change - F.col("ramp_up") * F.lit(dt)),
            "down": positive_part(-F.col("ramp_down") * F.lit(dt) - change),
        },
    )


def ramp_gaps(dispatch: DataFrame) -> DataFrame:
    """Changes that cannot be checked, as violations with a null value, which do not pass.

    A change into or out of a period that is missing between a device's first and last period.
    """
    spans = dispatch.groupBy(*DEVICE).agg(
        F.min("period").alias("_first"), F.max("period").alias("_last")
    )
    one = F.col("_now").isNull() | F.col("_before").isNull()
    inside = (F.col("period") > F.col("_first")) & (F.col("period") <= F.col("_last"))
    open_ = F.lit(None).cast("double")
    return _unfold(
        _paired(dispatch).where(one).join(spans, DEVICE).where(inside),
        "generator_ramping",
        F.col("pos"),
        {"up": open_, "down": open_},
    )


def _paired(dispatch: DataFrame) -> DataFrame:
    """Output now and in the period before, with marks of the two being listed."""
    none = F.lit(None).cast("double")
    keys = [*DEVICE, "period"]
    yes, no = F.lit(True), F.lit(None).cast("boolean")
    sent = dispatch.select(
        *keys, F.col("p_g").alias("now"), none.alias("before"), yes.alias("_now"), no.alias("_before")
    ).unionByName(
        dispatch.select(
            *DEVICE, (F.col("period") + 1).alias("period"), none.alias("now"),
            F.col("p_g").alias("before"), no.alias("_now"), yes.alias("_before"),
        )
    )
    return sent.groupBy(*keys).agg(
        F.max("now").alias("now"), F.max("before").alias("before"),
        F.max("_now").alias("_now"), F.max("_before").alias("_before"),
    )


def violation_renewable(output: DataFrame, renewable: DataFrame) -> DataFrame:
    keys = [*DEVICE, "period"]
    both = _with(output, renewable, "min_mw", "max_mw", keys=keys)
    return _unfold(
        both,
        "renewable_bounds",
        F.col("pos"),
        {
            "lower": positive_part(F.col("min_mw") - F.col("output")),
            "upper": positive_part(F.col("output") - F.col("max_mw")),
        },
    )


def violation_storage_power(dispatch: DataFrame, storage: DataFrame) -> DataFrame:
    both = _with(dispatch, storage, "max_charge", "max_discharge")
    charge, out = F.col("charge"), F.col("discharge")
    return _unfold(
        both,
        "storage_power_bounds",
        F.col("pos"),
        {
            "discharge_lower": positive_part(-out),
            "discharge_upper": positive_part(out - F.col("max_discharge")),
            "charge_lower": positive_part(-charge),
            "charge_upper": positive_part(charge - F.col("max_charge")),
        },
    )


def _energy_change(dt: float) -> Column:
    return F.lit(dt) * (
        F.col("charge_eff") * F.col("charge") - F.col("discharge") / F.col("discharge_eff")
    )


def storage_energy_path(
    dispatch: DataFrame, storage: DataFrame, dt: float = 1.0, block: int = BLOCK
) -> DataFrame:
    """Energy after each period: the initial energy plus a two-level running sum.

    From the first unknown charge or discharge on, the energy is unknown.
    """
    both = _with(dispatch, storage, "initial_mwh", "charge_eff", "discharge_eff")
    change = _energy_change(dt)
    sums = {
        "_moved": F.coalesce(change, F.lit(0.0)),
        "_open": F.when(unknown(change), 1).otherwise(0).cast("bigint"),
    }
    summed = running_sum(both, DEVICE, "period", sums, block)
    energy = F.when(F.col("_open") == 0, F.col("initial_mwh") + F.col("_moved"))
    return summed.select(*DEVICE, "period", energy.alias("energy_mwh"))


def violation_storage_energy(path: DataFrame, storage: DataFrame) -> DataFrame:
    both = _with(path, storage, "min_mwh", "max_mwh")
    e = F.col("energy_mwh")
    return _unfold(
        both,
        "storage_energy_bounds",
        F.col("pos"),
        {"lower": positive_part(F.col("min_mwh") - e), "upper": positive_part(e - F.col("max_mwh"))},
    )


def violation_storage_terminal(dispatch: DataFrame, storage: DataFrame, dt: float = 1.0) -> DataFrame:
    both = _with(dispatch, storage, "charge_eff", "discharge_eff")
    sums = both.groupBy(*DEVICE).agg(
        whole_sum(_energy_change(dt)).alias("moved"), F.max(LISTED).alias(LISTED)
    )
    return _unfold(
        sums, "storage_terminal_energy", F.col("pos"), {"equality": F.abs("moved")}, F.lit(None)
    )


def violation_canonical(
    a: DataFrame, row_vec: DataFrame, col_vec: DataFrame, state_col: DataFrame
) -> DataFrame:
    """The same check on the matrix form: equality, inequality and box rows."""
    gap = F.col("ax") - F.col("b")
    rows = row_activity(a, row_vec, state_col)
    equal = F.col("block") == "A1"
    rows = rows.select(
        "case_id",
        F.when(equal, "canonical_equalities").otherwise("canonical_inequalities").alias("family"),
        F.lit("row").alias("side"),
        F.lit(None).cast("bigint").alias("period"),
        F.col("row").alias("element"),
        F.when(equal, F.abs(gap)).otherwise(positive_part(-gap)).alias("value"),
    )
    box = state_col.join(col_vec.select(*COL, "lower", "upper"), COL, "full_outer")
    outside = positive_part(F.col("lower") - F.col("x")) + positive_part(F.col("x") - F.col("upper"))
    return rows.unionByName(
        _unfold(box, "canonical_box", F.col("col"), {"box": outside}, F.lit(None))
    )


# Tolerance of a solution and of an approximate candidate.
STRICT_TOLERANCE = 1e-7
CANDIDATE_TOLERANCE = 0.01


def family_summary(
    violation: DataFrame, tolerance: float = STRICT_TOLERANCE, expected: DataFrame | None = None
) -> DataFrame:
    """Checks, largest violation and verdict per case and family.

    A family with a value that is null, NaN or infinite fails; its maximum is null if a value is
    unknown.  ``expected`` (case_id, family) lists families that must appear: one without any row
    has 0 checks and fails.
    """
    rows = violation.select("case_id", "family", "value", F.lit(1).alias("_row"))
    if expected is not None:
        rows = rows.unionByName(
            expected.select("case_id", "family", F.lit(None).cast("double").alias("value"), F.lit(0).alias("_row"))
        )
    unknown = F.count_if((F.col("_row") == 1) & (F.col("value").isNull() | F.isnan("value")))
    found = rows.groupBy("case_id", "family").agg(
        F.sum("_row").alias("checks"),
        F.when(unknown == 0, F.max("value")).alias("max_violation"),
    )
    return found.withColumn("tolerance", F.lit(tolerance)).withColumn(
        "passed",
        (F.col("checks") > 0)
        & finite("max_violation")
        & F.coalesce(F.col("max_violation") <= tolerance, F.lit(False)),
    )


def direct_objective(
    gen_dispatch: DataFrame,
    gen: DataFrame,
    output: DataFrame,
    renewable: DataFrame,
    storage_dispatch: DataFrame,
    storage: DataFrame,
    renewable_penalty: float = 1.0,
    storage_penalty: float = 1.0,
) -> DataFrame:
    """Cost per case from the devices: generation, spilled output and storage losses; null if a
    value is unknown or a row's device is not listed."""
    keys = [*DEVICE, "period"]
    parts = _with(gen_dispatch, gen, "slope", "constant").select(
        "case_id", (F.col("slope") * F.col("p_g") + F.col("constant")).alias("v")
    )
    spill = _with(output, renewable, "max_mw", keys=keys)
    parts = parts.unionByName(
        spill.select(
            "case_id", (F.lit(renewable_penalty) * (F.col("max_mw") - F.col("output"))).alias("v")
        )
    )
    loss = F.col("discharge") * (1 / F.col("discharge_eff") - 1) + F.col("charge") * (
        1 - F.col("charge_eff")
    )
    stored = _with(storage_dispatch, storage, "charge_eff", "discharge_eff")
    parts = parts.unionByName(stored.select("case_id", (F.lit(storage_penalty) * loss).alias("v")))
    return parts.groupBy("case_id").agg(whole_sum("v").alias("direct_objective"))


def objective_difference(direct: DataFrame, canonical: DataFrame, limit: float = 1e-8) -> DataFrame:
    """Direct cost against ``c'x`` plus constant (``canonical(case_id, objective)``).

    A case that one side lacks, or whose difference is unknown, has not passed.
    """
    gap = F.abs(F.col("objective") - F.col("direct_objective"))
    return direct.join(canonical, "case_id", "full_outer").withColumn("difference", gap).withColumn(
        "passed", F.coalesce(F.col("difference") <= limit, F.lit(False))
    )


def reference_slack(injection: DataFrame, ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Injections balanced at the reference bus, and the adjustment per period."""
    totals = injection.groupBy("case_id", "period").agg((-F.sum("mw")).alias("adjustment"))
    extra = totals.join(ref, "case_id").select(
        "case_id", F.col("ref_bus").alias("bus_id"), "period", F.col("adjustment").alias("mw")
    )
    balanced = (
        injection.select("case_id", "bus_id", "period", "mw")
        .unionByName(extra)
        .groupBy("case_id", "bus_id", "period")
        .agg(F.sum("mw").alias("mw"))
    )
    return balanced, totals


def flow_crosscheck(flow_a: DataFrame, flow_b: DataFrame, keys: list[str]) -> DataFrame:
    """Largest difference per case between two flow tables.

    A branch that one table does not list has flow 0 there; a listed flow that is unknown makes
    the case's difference null.
    """
    yes = F.lit(True)
    pair = flow_a.select(*keys, F.col("mw").alias("_a"), yes.alias("_in_a")).join(
        flow_b.select(*keys, F.col("mw").alias("_b"), yes.alias("_in_b")), keys, "full_outer"
    )
    gap = F.abs(absent_as_zero("_in_a", "_a") - absent_as_zero("_in_b", "_b"))
    return pair.groupBy("case_id").agg(known_max(gap).alias("max_diff"))


# Names of the acceptance gates, in report order.
GATES = (
    "finite",
    "paper_stopping_satisfied",
    "raw_kkt_within_tolerance",
    "canonical_primal_within_tolerance",
    "physical_validation_available",
    "physical_validation_passed",
    "objective_gap_within_tolerance",
)


def candidate_acceptance(
    summaries: DataFrame, kkt: float, violation: float, gap: float
) -> DataFrame:
    """Seven named gates per candidate and whether all hold; an unknown value fails.

    ``summaries`` has the columns finite, stopping_satisfied, kkt_combined_norm,
    max_canonical_violation, physical_available, physical_passed, objective and
    reference_objective (null: the candidate is its own reference).
    """
    reference = F.coalesce("reference_objective", "objective")
    scaled = F.abs(F.col("objective") - reference) / F.greatest(F.lit(1.0), F.abs(reference))
    conditions = [
        F.col("finite"),
        F.col("stopping_satisfied"),
        F.col("kkt_combined_norm") <= kkt,
        F.col("max_canonical_violation") <= violation,
        F.col("physical_available"),
        F.col("physical_passed"),
        scaled <= gap,
    ]
    known = [F.coalesce(c, F.lit(False)) for c in conditions]
    names = F.array(*[F.lit(g) for g in GATES])
    checks = F.map_from_arrays(names, F.array(*known))
    failed = F.filter(names, lambda g: ~checks[g])
    return (
        summaries.withColumn("scaled_gap", scaled)
        .withColumn("checks", checks)
        .withColumn("failed", failed)
        .withColumn("passed", F.size("failed") == 0)
    )
