"""Checks that return the offending rows with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if, every, finite, first_reason, near_zero, reason_list


def _split(df: DataFrame, conditions) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and rows with their reasons."""
    tagged = df.withColumn("reasons", reason_list(conditions))
    kept = tagged.where(F.size("reasons") == 0).drop("reasons")
    return kept, tagged.where(F.size("reasons") > 0)


def reject_nonfinite(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Null, NaN and infinite values go to the rejects, named by column."""
    return _split(df, [(c, ~finite(c)) for c in cols])


def reject_noninteger(df: DataFrame, cols: Sequence[str], atol: float = 1e-9) -> DataFrame:
    pairs = [(c, F.abs(F.col(c) - F.round(c)) > atol) for c in cols]
    return _split(df, pairs)[1]


def require_min_columns(parsed_rows: DataFrame, minimums: dict[str, int]) -> DataFrame:
    """Rows of ``(case_id, section, row_number, vals)`` with too few numbers."""
    needed = F.create_map(*[F.lit(x) for pair in minimums.items() for x in pair])[F.col("section")]
    short = parsed_rows.withColumn("required", needed).withColumn("received", F.size("vals"))
    return short.where(F.col("received") < F.col("required")).select(
        "case_id", "section", "row_number", "received", "required"
    )


def check_cost_arity(gencost: DataFrame) -> DataFrame:
    """Polynomial rows carry n numbers, piecewise rows 2n, other models are unsupported."""
    wanted = F.when(F.col("model") == 2, F.col("n")).when(F.col("model") == 1, 2 * F.col("n"))
    got = F.size("parameters")
    reason = first_reason(
        [("unsupported_model", wanted.isNull()), ("parameter_count", got != wanted)]
    )
    return gencost.withColumn("reason", reason).where(F.col("reason").isNotNull())


def check_unique_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def check_foreign_keys(
    child: DataFrame, parent: DataFrame, key: Sequence[tuple[str, str]]
) -> DataFrame:
    """Child rows whose key is not in the parent; ``key`` pairs child and parent columns."""
    known = parent.select(*[F.col(p).alias(f"_k{i}") for i, (_, p) in enumerate(key)]).distinct()
    matches = [child[c] == known[f"_k{i}"] for i, (c, _) in enumerate(key)]
    condition = matches[0]
    for extra in matches[1:]:
        condition = condition & extra
    return child.join(known, condition, "left_anti")


def check_bounds_order(
    df: DataFrame, low: str, high: str, keys: Sequence[str], position: str
) -> DataFrame:
    """Per key, the number of rows with low > high and the first such position."""
    bad = df.where(F.col(low) > F.col(high))
    return bad.groupBy(*keys).agg(
        F.count("*").alias("violations"), F.min(position).alias("first_position")
    )


def check_single_reference(bus: DataFrame) -> DataFrame:
    found = bus.groupBy("case_id").agg(count_if(F.col("bus_type") == 3).alias("references"))
    return found.where(F.col("references") != 1)


def check_storage(storage: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Storage rows with their reasons; with ``config``, unlabelled additions as well."""
    charge, discharge = F.col("charge_eff"), F.col("discharge_eff")
    pairs = [
        (
            "nonfinite",
            ~(
                finite("initial_mwh")
                & finite("min_mwh")
                & finite("max_mwh")
                & finite("max_charge")
                & finite("max_discharge")
                & finite(charge)
                & finite(discharge)
            ),
        ),
        (
            "initial_energy_outside_bounds",
            ~F.col("initial_mwh").between(F.col("min_mwh"), F.col("max_mwh")),
        ),
        ("negative_power", (F.col("max_charge") < 0) | (F.col("max_discharge") < 0)),
        ("charge_efficiency", ~((charge > 0) & (charge <= 1))),
        ("discharge_efficiency", ~((discharge > 0) & (discharge <= 1))),
    ]
    if config is not None:
        storage = storage.join(config.select("case_id", "synthetic_extension"), "case_id", "left")
        pairs.append(
            ("unlabelled_extension", ~F.coalesce("synthetic_extension", F.lit(False)))
        )
    return _split(storage, pairs)[1]


def check_branch_parameters(branch: DataFrame, min_x: float = 1e-9) -> DataFrame:
    """Active branches that the linear model does not take, with reasons."""
    tap = F.when(near_zero("tap"), F.lit(1.0)).otherwise(F.col("tap"))
    pairs = [
        ("reactance", F.abs("reactance") < min_x),
        ("tap", tap <= 0),
        ("negative_rate", F.col("rate_mw") < 0),
    ]
    if "angle_min" in branch.columns:
        limited = (F.col("angle_min") > -360) | (F.col("angle_max") < 360)
        pairs.append(("angle_limit", limited))
    return _split(branch.where(F.col("status")), pairs)[1]


def cases_without_limited_branch(branch: DataFrame) -> DataFrame:
    limited = F.col("status") & (F.col("rate_mw") > 0) & (F.col("rate_mw") < 1e10)
    found = branch.groupBy("case_id").agg(count_if(limited).alias("limited"))
    return found.where(F.col("limited") == 0)


def check_population(
    bus: DataFrame, branch: DataFrame, gen: DataFrame, spec: DataFrame
) -> DataFrame:
    """Cases whose table sizes differ from the published ones.

    Each table is counted before the tables meet, so no key is multiplied.
    """
    parts = {"buses": bus, "branches": branch, "generators": gen}
    union = None
    for name, df in parts.items():
        one = df.groupBy("case_id").agg(F.count("*").alias("n")).select(
            "case_id", *[F.col("n").alias(p) if p == name else F.lit(0).cast("bigint").alias(p) for p in parts]
        )
        union = one if union is None else union.unionByName(one)
    counts = union.groupBy("case_id").agg(*[F.sum(p).alias(p) for p in parts])
    wanted = spec.select("case_id", *[F.col(p).alias(f"expected_{p}") for p in parts])
    joined = wanted.join(counts, "case_id", "left").na.fill(0, list(parts))
    differs = [F.col(p) != F.col(f"expected_{p}") for p in parts]
    return joined.where(differs[0] | differs[1] | differs[2])


def contract_drift(
    actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str = "document"
) -> DataFrame:
    """Differing or missing keys of two JSON objects, compared key by key and by value.

    Values are written back in one form (objects with sorted keys, decimals without trailing
    zeros), and plain numbers are compared as numbers.  A key that holds null reads ``null``; an
    absent key is a null column.
    """
    spark = actual.sparkSession

    def entries(df: DataFrame, name: str) -> DataFrame:
        parsed = df.select(*keys, F.try_parse_json(value).alias("_v"))
        each = parsed.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        return each.select(*keys, F.col("key"), F.to_json("value").alias(name))

    pair = entries(actual, "actual").join(
        entries(expected, "expected"), [*keys, "key"], "full_outer"
    )

    def number(c: str, kind: str) -> Column:
        return F.when(~F.col(c).startswith('"'), F.expr(f"try_cast({c} AS {kind})"))

    # equal as doubles, and as decimals where both fit: 2**53 + 1 is not 2**53
    equal = number("actual", "double") == number("expected", "double")
    exact = number("actual", "decimal(38,18)") == number("expected", "decimal(38,18)")
    same = F.col("actual").eqNullSafe(F.col("expected")) | F.coalesce(
        equal & F.coalesce(exact, F.lit(True)), F.lit(False)
    )
    return pair.where(~same)


def reject_nonlinear_cost(gen: DataFrame) -> DataFrame:
    """Polynomial costs with a non-zero coefficient above the linear one."""
    n = F.size("parameters")
    higher = F.slice("parameters", 1, F.greatest(n - 2, F.lit(0)))
    return gen.where((F.col("model") == 2) & F.exists(higher, lambda c: F.abs(c) > 0))


def check_required_fields(
    df: DataFrame,
    keys: Sequence[str],
    required: Sequence[str],
    ranges: dict[str, tuple[float | None, float | None]],
) -> DataFrame:
    """Per key: rows, rows missing a field, rows outside a range, and the overall flag."""
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    outside = F.lit(False)
    for name, (low, high) in ranges.items():
        if low is not None:
            outside = outside | F.coalesce(F.col(name) < low, F.lit(False))
        if high is not None:
            outside = outside | F.coalesce(F.col(name) > high, F.lit(False))
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        count_if(missing).alias("missing"),
        count_if(outside).alias("out_of_range"),
        every(~missing & ~outside).alias("passed"),
    )
