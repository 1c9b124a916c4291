"""Diagonal scaling of LP tables, and the way back."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS, absent_as_zero, count_if, norm
from ..session import release, settle, settled
from .algebra import COL, ROW


class Scaled(NamedTuple):
    a: DataFrame
    row_scale: DataFrame
    col_scale: DataFrame
    diagnostics: DataFrame


def axis_norms(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Largest and summed absolute value by row and by column of the entries present."""
    v = F.abs("value")

    def by(keys: list[str]) -> DataFrame:
        return a.groupBy(*keys).agg(F.max(v).alias("max_abs"), F.sum(v).alias("sum_abs"))

    return by(ROW), by(COL)


def with_empty(norms: DataFrame, population: DataFrame, keys: list[str]) -> DataFrame:
    """Add the rows or columns that have no entry, with norm 0."""
    blank = population.select(*keys, F.lit(0.0).alias("max_abs"), F.lit(0.0).alias("sum_abs"))
    return (
        norms.unionByName(blank)
        .groupBy(*keys)
        .agg(F.max("max_abs").alias("max_abs"), F.max("sum_abs").alias("sum_abs"))
    )


def sqrt_denominator(norm: Column) -> Column:
    """Square root of a positive norm, 1 for zero."""
    return F.when(norm > 0, F.sqrt(norm)).otherwise(F.lit(1.0))


NORM_OF = {"ruiz": "max_abs", "pock_chambolle": "sum_abs"}


def scale_step(a: DataFrame, method: str) -> Scaled:
    """Divide rows and columns at once by the square roots of their norms.

    The matrix and both norms are settled: the scales, the diagnostics and the division read them.
    """
    a = settled(a)
    return _divided(a, method, *[settle(norms) for norms in axis_norms(a)])


def _divided(a: DataFrame, method: str, rows: DataFrame, cols: DataFrame) -> Scaled:
    """The step of ``scale_step`` with given norms."""
    norm = NORM_OF[method]
    row_scale = rows.select(*ROW, sqrt_denominator(F.col(norm)).alias("scale"))
    col_scale = cols.select(*COL, sqrt_denominator(F.col(norm)).alias("scale"))
    scaled = divide(a, row_scale, col_scale)
    before = norm_summary(rows, norm, "row_before").unionByName(
        norm_summary(cols, norm, "column_before")
    )
    return Scaled(scaled, row_scale, col_scale, before.withColumn("method", F.lit(method)))


def divide(a: DataFrame, row_scale: DataFrame, col_scale: DataFrame) -> DataFrame:
    """``a / r / d``; a row or column without a scale keeps 1."""
    return _combine(a, row_scale, col_scale, lambda v, r, d: v * (1 / r) * (1 / d))


def multiply(a: DataFrame, row_scale: DataFrame, col_scale: DataFrame) -> DataFrame:
    return _combine(a, row_scale, col_scale, lambda v, r, d: v * r * d)


def _combine(a, row_scale, col_scale, change) -> DataFrame:
    one = F.lit(1.0)
    joined = a.join(row_scale.select(*ROW, F.col("scale").alias("_r")), ROW, "left").join(
        col_scale.select(*COL, F.col("scale").alias("_d")), COL, "left"
    )
    value = change(F.col("value"), F.coalesce("_r", one), F.coalesce("_d", one))
    return joined.select(*ROW, "col", value.alias("value"))


def _accumulate(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    if old is None:
        return new
    joined = old.join(new.withColumnRenamed("scale", "_step"), keys, "left")
    return joined.select(*keys, (F.col("scale") * F.coalesce("_step", F.lit(1.0))).alias("scale"))


def ruiz(a: DataFrame, k: int) -> Scaled:
    """``k`` simultaneous infinity-norm steps with the accumulated denominators.

    Every step is settled: the plan of step k does not contain the k-1 steps before it.  The
    input is settled too, and so are the norms, which the scales, the accumulated scales, the
    diagnostics and the division read.
    """
    rows = cols = log = None
    a = settle(a)
    for step in range(1, k + 1):
        norms = [settle(found) for found in axis_norms(a)]
        one = _divided(a, "ruiz", *norms)
        noted = settle(one.diagnostics.withColumn("step", F.lit(step)))
        log = noted if log is None else log.unionByName(noted)
        new_rows = settle(_accumulate(rows, one.row_scale, ROW))
        new_cols = settle(_accumulate(cols, one.col_scale, COL))
        scaled = settle(one.a)
        release(rows, cols, a, *norms)
        rows, cols, a = new_rows, new_cols, scaled
    return Scaled(a, rows, cols, log)


def pock_chambolle(a: DataFrame) -> Scaled:
    """One step with absolute sums, exponent 1."""
    return scale_step(a, "pock_chambolle")


def precondition(a: DataFrame, ruiz_steps: int = 10) -> Scaled:
    """Infinity-norm steps, then one absolute-sum step, with the combined denominators."""
    first = ruiz(a, ruiz_steps)
    second = pock_chambolle(first.a)
    return Scaled(
        settle(second.a),
        settle(_accumulate(first.row_scale, second.row_scale, ROW)),
        settle(_accumulate(first.col_scale, second.col_scale, COL)),
        first.diagnostics.unionByName(second.diagnostics.withColumn("step", F.lit(ruiz_steps + 1))),
    )


def _with_scale(df: DataFrame, scale: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(scale.select(*keys, F.col("scale").alias("_s")), keys, "left").withColumn(
        "_s", F.coalesce("_s", F.lit(1.0))
    )


def normalize_rhs_cost(
    row_vec: DataFrame, col_vec: DataFrame, row_scale: DataFrame, col_scale: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Divide b by 1 + |b/r|, c by 1 + |c/d| and rescale the box; also the two factors.

    A factor over an unknown value is null, and with it all that it divides.
    """
    rows = _with_scale(row_vec, row_scale, ROW).withColumn("b", F.col("b") / F.col("_s"))
    cols = _with_scale(col_vec, col_scale, COL).withColumn("c", F.col("c") / F.col("_s"))
    b_norm = rows.groupBy("case_id").agg(norm("b").alias("b_norm"), F.lit(True).alias("_rows"))
    c_norm = cols.groupBy("case_id").agg(norm("c").alias("c_norm"), F.lit(True).alias("_cols"))
    meta = settle(
        b_norm.join(c_norm, "case_id", "full_outer")
        .select(
            "case_id",
            absent_as_zero("_rows", "b_norm").alias("b_norm"),
            absent_as_zero("_cols", "c_norm").alias("c_norm"),
        )
        .withColumn("b_scale", 1 + F.col("b_norm"))
        .withColumn("c_scale", 1 + F.col("c_norm"))
    )
    rows = rows.join(meta, "case_id").select(*ROW, (F.col("b") / F.col("b_scale")).alias("b"))
    cols = cols.join(meta, "case_id").select(
        *COL,
        (F.col("c") / F.col("c_scale")).alias("c"),
        (F.col("lower") * F.col("_s") / F.col("b_scale")).alias("lower"),
        (F.col("upper") * F.col("_s") / F.col("b_scale")).alias("upper"),
    )
    return rows, cols, meta


def scale_state(
    state_col: DataFrame,
    state_row: DataFrame,
    row_scale: DataFrame,
    col_scale: DataFrame,
    meta: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Original coordinates to scaled ones."""
    cols = _with_scale(state_col, col_scale, COL).join(meta, "case_id").select(
        *COL,
        (F.col("x") * F.col("_s") / F.col("b_scale")).alias("x"),
        (F.col("z") / (F.col("c_scale") * F.col("_s"))).alias("z"),
    )
    rows = _with_scale(state_row, row_scale, ROW).join(meta, "case_id").select(
        *ROW, (F.col("y") * F.col("_s") / F.col("c_scale")).alias("y")
    )
    return cols, rows


def recover_state(
    state_col: DataFrame,
    state_row: DataFrame,
    row_scale: DataFrame,
    col_scale: DataFrame,
    meta: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Scaled coordinates back to the original ones."""
    cols = _with_scale(state_col, col_scale, COL).join(meta, "case_id").select(
        *COL,
        (F.col("b_scale") * F.col("x") / F.col("_s")).alias("x"),
        (F.col("c_scale") * F.col("z") * F.col("_s")).alias("z"),
    )
    rows = _with_scale(state_row, row_scale, ROW).join(meta, "case_id").select(
        *ROW, (F.col("c_scale") * F.col("y") / F.col("_s")).alias("y")
    )
    return cols, rows


def recover_lp(
    a: DataFrame,
    row_vec: DataFrame,
    col_vec: DataFrame,
    row_scale: DataFrame,
    col_scale: DataFrame,
    meta: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The unscaled matrix and vectors."""
    rows = _with_scale(row_vec, row_scale, ROW).join(meta, "case_id").select(
        *ROW, (F.col("b") * F.col("_s") * F.col("b_scale")).alias("b")
    )
    cols = _with_scale(col_vec, col_scale, COL).join(meta, "case_id").select(
        *COL,
        (F.col("c") * F.col("_s") * F.col("c_scale")).alias("c"),
        (F.col("lower") * F.col("b_scale") / F.col("_s")).alias("lower"),
        (F.col("upper") * F.col("b_scale") / F.col("_s")).alias("upper"),
    )
    return multiply(a, row_scale, col_scale), rows, cols


def recover_objective(scaled: DataFrame, meta: DataFrame) -> DataFrame:
    factor = F.col("b_scale") * F.col("c_scale")
    return scaled.join(meta, "case_id").select(
        "case_id", (F.col("objective") * factor).alias("objective")
    )


def norm_summary(norms: DataFrame, value: str, axis: str) -> DataFrame:
    """Count, zeros and range of a norm vector; the least positive value is null if none."""
    v = F.col(value)
    return norms.groupBy("case_id").agg(
        F.lit(axis).alias("axis"),
        F.count("*").alias("count"),
        count_if(v == 0).alias("zero_count"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.min(F.when(v > 0, v)).alias("minimum_positive"),
    )


def verify_diagonal_scaling(
    a: DataFrame,
    scaled: DataFrame,
    row_scale: DataFrame,
    col_scale: DataFrame,
    multiplier: float = 512.0,
) -> DataFrame:
    """Same positions, and coefficients within rounding of the stated division."""
    keys = [*ROW, "col"]
    want = divide(a, row_scale, col_scale).where(F.col("value") != 0)
    pair = want.withColumnRenamed("value", "want").join(
        scaled.where(F.col("value") != 0).withColumnRenamed("value", "got"), keys, "full_outer"
    )
    result = pair.groupBy("case_id").agg(
        count_if(F.col("want").isNull() | F.col("got").isNull()).alias("pattern_differences"),
        F.coalesce(F.max(F.abs(F.col("want") - F.col("got"))), F.lit(0.0)).alias("max_error"),
        F.greatest(F.lit(1.0), F.max(F.abs("want"))).alias("magnitude"),
    )
    tolerance = F.lit(multiplier * EPS) * F.col("magnitude")
    passed = (F.col("pattern_differences") == 0) & (F.col("max_error") <= tolerance)
    return result.select(
        "case_id", "pattern_differences", "max_error", passed.alias("passed")
    )
