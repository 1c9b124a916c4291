"""Transfer ledgers and resource planning tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import close, reason_list
from .assemble import nnz_upper_bound
from .derive import expected_dimensions

KEY = ["phase", "direction", "kind"]
INT32_MAX = 2**31 - 1
GIB = 1024.0**3

# Where a resident solver may move data.
ALLOWED = (
    ("initial_state", "host_to_device"),
    ("periodic_diagnostics", "device_to_host"),
    ("policy_diagnostics", "device_to_host"),
    ("final_state", "device_to_host"),
    ("final_scaled_state", "device_to_host"),
    ("final_diagnostics", "device_to_host"),
)


def ledger_aggregate(transfer: DataFrame) -> DataFrame:
    return transfer.groupBy(*KEY).agg(F.sum("calls").alias("calls"), F.sum("bytes").alias("bytes"))


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """Per direction, and overall with a null direction."""
    sums = [F.sum("calls").alias("calls"), F.sum("bytes").alias("bytes")]
    by_direction = [[F.col("direction")], []]
    return ledger.groupingSets(by_direction, "direction").agg(*sums)


def ledger_delta(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Difference of two cumulative ledgers without zero rows; decreases are rejects.

    Both ledgers are signed terms of one aggregation.
    """
    terms = after.select(*KEY, "calls", "bytes").unionByName(
        before.select(*KEY, (-F.col("calls")).alias("calls"), (-F.col("bytes")).alias("bytes"))
    )
    delta = ledger_aggregate(terms)
    falls = (F.col("calls") < 0) | (F.col("bytes") < 0)
    moved = (F.col("calls") != 0) | (F.col("bytes") != 0)
    return delta.where(moved & ~falls), delta.where(falls)


def ledger_audit(delta: DataFrame, allowed=ALLOWED) -> DataFrame:
    """Records whose (phase, direction) is not on the fixed list."""
    pair = F.struct(F.col("phase").alias("p"), F.col("direction").alias("d"))
    listed = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d")) for p, d in allowed])
    return delta.where(~F.array_contains(listed, pair))


def timer_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Difference of cumulative timers; a timer that runs backwards is a reject."""
    joined = after.select(*keys, F.col("seconds").alias("_a")).join(
        before.select(*keys, F.col("seconds").alias("_b")), keys, "left"
    )
    delta = joined.select(*keys, (F.col("_a") - F.coalesce("_b", F.lit(0.0))).alias("seconds"))
    return delta.where(F.col("seconds") >= 0), delta.where(F.col("seconds") < 0)


# Headroom, peak factor and safety shares of the planning rules.
RESOURCE_POLICY = {
    "headroom": 1.25,
    "host_peak": 2.5,
    "host_fraction": 0.80,
    "device_fraction": 0.80,
}


def resource_estimate(
    spec: DataFrame, published: DataFrame, policy: dict[str, float] = RESOURCE_POLICY
) -> DataFrame:
    """Bytes of matrix, transpose, vectors and peaks from sizes alone.

    ``published(case_id, periods, published_m, published_n, published_nnz)``.
    """
    sized = expected_dimensions(nnz_upper_bound(spec)).join(
        published, ["case_id", "periods"], "left"
    )
    planning = F.greatest(F.coalesce("published_nnz", F.lit(0)), F.col("nnz_bound"))
    csr = F.col("planning_nnz") * 12 + (F.col("m1") + F.col("m2") + 2) * 4
    vectors = 8 * (31 * F.col("n") + 19 * F.col("m1") + 16 * F.col("m2"))
    device = F.ceil(F.lit(policy["headroom"]) * (2 * F.col("csr_bytes") + F.col("vector_bytes")))
    host = F.ceil(F.lit(policy["host_peak"]) * F.col("csr_bytes"))
    return (
        sized.withColumn("planning_nnz", planning)
        .withColumn("csr_bytes", csr)
        .withColumn("vector_bytes", vectors)
        .withColumn("device_bytes", device.cast("bigint"))
        .withColumn("host_peak_bytes", host.cast("bigint"))
        .withColumn(
            "headroom_bytes",
            F.col("device_bytes") - 2 * F.col("csr_bytes") - F.col("vector_bytes"),
        )
        .withColumn("unified_peak_bytes", F.col("host_peak_bytes") + F.col("device_bytes"))
        .withColumn("int32_supported", F.col("planning_nnz") <= INT32_MAX)
        .withColumn(
            "dimensions_match",
            F.coalesce(
                (F.col("m") == F.col("published_m")) & (F.col("n") == F.col("published_n")),
                F.lit(False),
            ),
        )
    )


def resource_gate(
    estimate: DataFrame, observation: DataFrame, policy: dict[str, float] = RESOURCE_POLICY
) -> DataFrame:
    """Named checks of the projected peak; anything unknown fails.

    ``observation(case_id, observed, host_available, device_free)``.
    """
    joined = estimate.join(observation, "case_id", "left")

    def budget(name: str, fraction: str) -> Column:
        value = F.col(name)
        return F.when(value > 0, F.floor(F.lit(policy[fraction]) * value))

    gated = joined.withColumn("host_budget", budget("host_available", "host_fraction")).withColumn(
        "device_budget", budget("device_free", "device_fraction")
    )
    peak = F.col("unified_peak_bytes")
    conditions = {
        "observation_available": F.col("observed"),
        "dimensions_match_table": F.col("dimensions_match"),
        "signed_int32_csr_supported": F.col("int32_supported"),
        "within_host_safety_budget": peak <= F.col("host_budget"),
        "within_device_safety_budget": peak <= F.col("device_budget"),
    }
    failed = reason_list([(n, ~F.coalesce(c, F.lit(False))) for n, c in conditions.items()])
    return gated.withColumn("block_reasons", failed).withColumn(
        "passed", F.size("block_reasons") == 0
    )


def disposition(estimate: DataFrame, completed: DataFrame, campaign: DataFrame) -> DataFrame:
    """Where each row is handled, and whether its index width blocks it beforehand.

    ``completed(case_id, periods)``; ``campaign(case_id, periods, sequence)``.
    """
    keys = ["case_id", "periods"]
    joined = estimate.join(completed.select(*keys, F.lit(True).alias("_done")), keys, "left").join(
        campaign.select(*keys, "sequence"), keys, "left"
    )
    place = (
        F.when(F.col("_done"), "stage7_completed")
        .when(F.col("sequence").isNotNull(), "stage8_campaign")
        .otherwise("reconciliation_only")
    )
    blocked = ~F.col("int32_supported")
    return joined.select(
        *keys,
        "sequence",
        place.alias("disposition"),
        F.when(blocked, "BLOCKED").otherwise("ELIGIBLE").alias("static_status"),
        reason_list([("signed_int32_csr_nnz_limit", blocked)]).alias("static_reasons"),
    )


def symbolic_ledger(dims: DataFrame, published: DataFrame, ledger: DataFrame) -> DataFrame:
    """Computed sizes against published ones with differences and comparability.

    ``dims(case_id, periods, m, n)``; ``ledger(case_id, periods, nnz)`` may lack rows.
    """
    keys = ["case_id", "periods"]
    joined = dims.select(*keys, "m", "n").join(published, keys).join(
        ledger.select(*keys, "nnz"), keys, "left"
    )

    def gap(a: str, b: str) -> Column:
        return F.abs(F.col(a) - F.col(b))

    signed = F.col("nnz") - F.col("published_nnz")
    comparable = F.coalesce(signed == 0, F.lit(False))
    text = (
        F.when(signed.isNull(), "exact symbolic reconstruction nnz not counted")
        .when(signed == 0, "exact reconstructed nnz match")
        .otherwise("reconstructed nnz differs; Table II timing is context only")
    )
    return joined.select(
        *keys,
        "m",
        "published_m",
        gap("m", "published_m").alias("m_difference"),
        (100.0 * gap("m", "published_m") / F.col("published_m")).alias("m_difference_pct"),
        "n",
        "published_n",
        gap("n", "published_n").alias("n_difference"),
        (100.0 * gap("n", "published_n") / F.col("published_n")).alias("n_difference_pct"),
        "nnz",
        "published_nnz",
        signed.alias("nnz_difference"),
        (100.0 * F.abs(signed) / F.col("published_nnz")).alias("nnz_difference_pct"),
        comparable.alias("time_comparable"),
        text.alias("comparability"),
        ((F.col("m") == F.col("published_m")) & (F.col("n") == F.col("published_n"))).alias(
            "dimensions_match"
        ),
    )


def structural_reconciliation(symbolic: DataFrame) -> DataFrame:
    """The flat report table with match flags; here the percentage keeps its sign."""
    return symbolic.select(
        "case_id",
        "periods",
        F.col("published_m").alias("paper_m"),
        F.col("m").alias("reproduced_m"),
        F.col("published_n").alias("paper_n"),
        F.col("n").alias("reproduced_n"),
        F.col("published_nnz").alias("paper_nnz"),
        F.col("nnz").alias("reconstructed_nnz"),
        "nnz_difference",
        (100.0 * F.col("nnz_difference") / F.col("published_nnz")).alias("nnz_difference_pct"),
        F.col("dimensions_match").alias("dimension_match"),
        F.coalesce(F.col("nnz_difference") == 0, F.lit(False)).alias("nnz_match"),
        "time_comparable",
    )


# Order of the failures in a report row; other names follow by name.
FAILURE_ORDER = {
    "within_host_safety_budget": 0,
    "within_device_safety_budget": 1,
    "signed_int32_csr_nnz_limit": 2,
}


def resource_boundaries(gate: DataFrame) -> DataFrame:
    """Budgets in GiB and the failures as one ordered string."""

    def rank(name: Column) -> Column:
        place = F.lit(99)
        for known, number in FAILURE_ORDER.items():
            place = F.when(name == known, number).otherwise(place)
        return place

    ordered = F.array_sort(
        F.transform("block_reasons", lambda n: F.struct(rank(n).alias("place"), n.alias("name")))
    )
    text = F.array_join(F.transform(ordered, lambda s: F.concat(F.lit("failed:"), s["name"])), ";")
    return gate.select(
        "case_id",
        "periods",
        (F.col("unified_peak_bytes") / GIB).alias("projected_unified_gib"),
        (F.col("host_budget") / GIB).alias("host_budget_gib"),
        (F.col("device_budget") / GIB).alias("device_budget_gib"),
        "planning_nnz",
        F.lit(INT32_MAX).alias("int32_limit"),
        text.alias("block_reasons"),
    )


def audit_ledger_rows(
    stored: DataFrame, recomputed: DataFrame, keys: list[str], cols: list[str], rtol: float = 1e-12
) -> DataFrame:
    """Every stored row against its recomputation; missing and extra rows fail too."""
    exact = {n for n, kind in recomputed.dtypes if kind not in ("double", "float")}
    pair = stored.select(*keys, F.lit(True).alias("_s"), *[F.col(c).alias(f"_s_{c}") for c in cols]).join(
        recomputed.select(*keys, F.lit(True).alias("_r"), *cols), keys, "full_outer"
    )
    pairs = [("missing_row", F.col("_s").isNull()), ("unexpected_row", F.col("_r").isNull())]
    both = F.col("_s").isNotNull() & F.col("_r").isNotNull()
    for c in cols:
        same = (
            F.col(c).eqNullSafe(F.col(f"_s_{c}")) if c in exact else close(F.col(c), F.col(f"_s_{c}"), rtol)
        )
        pairs.append((c, both & ~same))
    return pair.select(*keys, reason_list(pairs).alias("differences")).withColumn(
        "passed", F.size("differences") == 0
    )
