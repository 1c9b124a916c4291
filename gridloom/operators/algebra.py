"""Sparse products, norms, projections and residuals over long tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    EPS,
    absent_as_zero,
    clip,
    known_max,
    norm,
    positive_part,
    whole_sum,
)
from ..functions.heavy import Heavy, join_heavy, plain
from ..session import broadcast_limit, release, settle, settled

ROW = ["case_id", "block", "row"]
COL = ["case_id", "col"]

#: Entries that make a row wide, and the most rows that are.
WIDE_ENTRIES = 4_096
WIDE_ROWS = 100_000


class Wide(NamedTuple):
    """The rows of a matrix that hold many entries each, and the entries of all other rows."""

    rows: DataFrame
    rest: DataFrame

    def block(self, name: str) -> Wide:
        return Wide(*[df.where(F.col("block") == name) for df in self])


def find_wide(
    a: DataFrame, row_vec: DataFrame, entries: int = WIDE_ENTRIES, limit: int | None = None
) -> Wide | None:
    """The rows of ``a`` with at least ``entries`` entries, or more if over ``WIDE_ROWS`` rows had that many.

    None if a vector over ``row_vec`` is broadcast anyway (under ``limit`` bytes, the session's threshold
    when unset) or no row is wide.  Both tables are settled, once for all products with ``a``.
    """
    limit = broadcast_limit(a) if limit is None else limit
    if row_vec.count() * 32 <= limit:
        return None
    a = settled(a)
    counts = settle(a.groupBy(*ROW).agg(F.count("*").alias("_n")))
    least = max(entries, (counts.agg(F.sum("_n")).first()[0] or 0) // WIDE_ROWS)
    rows = settle(counts.where(F.col("_n") >= least).select(*ROW))
    if not rows.limit(1).count():
        return None
    return Wide(rows, settle(a.join(F.broadcast(rows), ROW, "left_anti")))


def join_rows(a: DataFrame, vec: DataFrame, wide: Wide | None = None, how: str = "inner") -> DataFrame:
    """``a.join(vec, ROW, how)``, inner or left, for a vector over the rows.

    The entries of ``wide`` rows stay where they are and meet a broadcast table of those rows only, so they
    are neither sent nor gathered by row.
    """
    if wide is None:
        return a.join(vec, ROW, how)
    few = F.broadcast(wide.rows).join(vec, ROW) if how == "inner" else vec.join(F.broadcast(wide.rows), ROW, "right")
    return a.join(F.broadcast(few), ROW).unionByName(wide.rest.join(vec, ROW, how))


def spmv(
    a: DataFrame,
    vec: DataFrame,
    value: str = "x",
    out: str = "ax",
    rows: DataFrame | None = None,
    heavy: Heavy | None = None,
) -> DataFrame:
    """``A x`` by row.  Rows listed in ``rows`` without entries get 0.

    The empty rows enter as zero terms of the same aggregation, which saves a join.  ``heavy``
    (``find_heavy(a, *COL)``, found once for all products with ``a``) deals the entries of
    columns that hold a large part of the matrix to many tasks.
    """
    terms = join_heavy(a, vec.select(*COL, F.col(value).alias("_x")), heavy or plain(*COL)).select(
        *ROW, (F.col("value") * F.col("_x")).alias(out)
    )
    if rows is not None:
        terms = terms.unionByName(rows.select(*ROW, F.lit(0.0).alias(out)))
    return terms.groupBy(*ROW).agg(F.sum(out).alias(out))


def spmv_t(
    a: DataFrame,
    vec: DataFrame,
    value: str = "y",
    out: str = "aty",
    cols: DataFrame | None = None,
    heavy: Heavy | None = None,
    wide: Wide | None = None,
) -> DataFrame:
    """``A' y`` by column; ``heavy`` is ``find_heavy(a, *ROW)``, for rows with very many entries.

    With ``wide`` (``find_wide(a, vec)``) the entries of such rows are not sent at all.
    """
    vec = vec.select(*ROW, F.col(value).alias("_y"))
    joined = join_heavy(a, vec, heavy or plain(*ROW)) if wide is None else join_rows(a, vec, wide)
    terms = joined.select(*COL, (F.col("value") * F.col("_y")).alias(out))
    if cols is not None:
        terms = terms.unionByName(cols.select(*COL, F.lit(0.0).alias(out)))
    return terms.groupBy(*COL).agg(F.sum(out).alias(out))


def gram_blocks(a: DataFrame, part: str = "part", heavy: Heavy | None = None) -> DataFrame:
    """``A A'`` for rows labelled 'balance' or 'storage'.

    Balance rows share no column with each other, nor do storage rows, so the diagonal
    blocks are sums of squares and only the coupling block needs a join.  ``max_shared``
    counts a column's entries within one part; above 1 the block form does not apply.
    ``heavy`` is ``find_heavy(a, *COL)``: the balance entries of such columns are dealt to many tasks.
    """
    shared = (
        a.groupBy(*COL, part).count().groupBy("case_id").agg(F.max("count").alias("max_shared"))
    )
    diagonal = a.groupBy("case_id", part, "row").agg(
        F.sum(F.col("value") * F.col("value")).alias("value")
    )
    diagonal = diagonal.select(
        "case_id",
        F.concat(F.col(part), F.lit("_diagonal")).alias("kind"),
        F.col("row").alias("r1"),
        F.col("row").alias("r2"),
        "value",
    )
    left = a.where(F.col(part) == "balance").select(
        *COL, F.col("row").alias("r1"), F.col("value").alias("_l")
    )
    right = a.where(F.col(part) == "storage").select(
        *COL, F.col("row").alias("r2"), F.col("value").alias("_r")
    )
    coupling = (
        join_heavy(left, right, heavy or plain(*COL))
        .groupBy("case_id", "r1", "r2")
        .agg(F.sum(F.col("_l") * F.col("_r")).alias("value"))
        .select("case_id", F.lit("coupling").alias("kind"), "r1", "r2", "value")
    )
    return diagonal.unionByName(coupling).join(shared, "case_id")


def vector_norms(vec: DataFrame, value: str, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    v = F.col(value)
    return vec.groupBy(*keys).agg(
        F.sum(F.abs(v)).alias("l1"),
        F.sqrt(F.sum(v * v)).alias("l2"),
        F.max(F.abs(v)).alias("linf"),
        F.count("*").alias("size"),
    )


def dot(
    left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, out: str = "dot"
) -> DataFrame:
    return (
        left.select(*keys, F.col(a).alias("_a"))
        .join(right.select(*keys, F.col(b).alias("_b")), list(keys))
        .groupBy("case_id")
        .agg(F.sum(F.col("_a") * F.col("_b")).alias(out))
    )


def dual_projection(value: Column, block: Column) -> Column:
    """Inequality multipliers are non-negative; equality multipliers are free."""
    return F.when(block == "A2", positive_part(value)).otherwise(value)


def project_box(vec: DataFrame, col_vec: DataFrame, value: str = "x") -> DataFrame:
    joined = vec.join(col_vec.select(*COL, "lower", "upper"), COL)
    return joined.select(
        *COL, clip(F.col(value), F.col("lower"), F.col("upper")).alias(value)
    )


def project_nonnegative(vec: DataFrame, value: str) -> DataFrame:
    return vec.withColumn(value, positive_part(value))


def project_dual(state_row: DataFrame, value: str = "y") -> DataFrame:
    return state_row.withColumn(value, dual_projection(F.col(value), F.col("block")))


def objective(
    state_col: DataFrame, col_vec: DataFrame, constant: DataFrame | None = None
) -> DataFrame:
    """``c'x`` per case, plus ``constant(case_id, constant)`` when given."""
    result = (
        state_col.select(*COL, "x")
        .join(col_vec.select(*COL, "c"), COL)
        .groupBy("case_id")
        .agg(F.sum(F.col("c") * F.col("x")).alias("objective"))
    )
    if constant is None:
        return result
    total = F.col("objective") + F.coalesce(F.col("constant"), F.lit(0.0))
    return result.join(constant, "case_id", "left").select("case_id", total.alias("objective"))


def row_activity(
    a: DataFrame,
    row_vec: DataFrame,
    state_col: DataFrame,
    state_row: DataFrame | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """``(ax, b, y)`` by row, gathered in one aggregation instead of three joins.

    An entry whose column has no state, or an unknown one, makes its row's ``ax`` unknown.
    ``known(case_id, block, row, ax)`` holds the products of entries that are not in ``a``.
    """
    empty = F.lit(None).cast("double")
    terms = (
        a.join(state_col.select(*COL, "x"), COL, "left")
        .select(*ROW, (F.col("value") * F.col("x")).alias("ax"), empty.alias("b"), empty.alias("y"))
        .unionByName(row_vec.select(*ROW, F.lit(0.0).alias("ax"), "b", empty.alias("y")))
    )
    if state_row is not None:
        terms = terms.unionByName(
            state_row.select(*ROW, F.lit(0.0).alias("ax"), empty.alias("b"), "y")
        )
    if known is not None:
        terms = terms.unionByName(known.select(*ROW, "ax", empty.alias("b"), empty.alias("y")))
    return terms.groupBy(*ROW).agg(
        whole_sum("ax").alias("ax"), F.max("b").alias("b"), F.max("y").alias("y")
    )


def col_activity(
    a: DataFrame,
    col_vec: DataFrame,
    state_col: DataFrame,
    state_row: DataFrame,
    wide: Wide | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """``(aty, c, lower, upper, x, z)`` by column; ``aty`` is null if a multiplier is missing.

    ``known(case_id, col, aty)`` holds the products of entries that are not in ``a``.
    """
    names = ["c", "lower", "upper", "x", "z"]

    def shape(df: DataFrame, present: Sequence[str]) -> DataFrame:
        blank = F.lit(None).cast("double")
        return df.select(
            *COL,
            *([F.lit(0.0).alias("aty")] if "aty" not in present else ["aty"]),
            *[F.col(n) if n in present else blank.alias(n) for n in names],
        )

    products = join_rows(a, state_row.select(*ROW, "y"), wide, "left").select(
        *COL, (F.col("value") * F.col("y")).alias("aty")
    )
    terms = (
        shape(products, ["aty"])
        .unionByName(shape(col_vec, ["c", "lower", "upper"]))
        .unionByName(shape(state_col, ["x", "z"]))
    )
    if known is not None:
        terms = terms.unionByName(shape(known, ["aty"]))
    return terms.groupBy(*COL).agg(
        whole_sum("aty").alias("aty"), *[F.max(n).alias(n) for n in names]
    )


def _dual_part() -> Column:
    argument = F.col("y") - F.col("ax") + F.col("b")
    return F.col("y") - dual_projection(argument, F.col("block"))


def _box_part() -> Column:
    return F.col("x") - clip(F.col("x") - F.col("z"), F.col("lower"), F.col("upper"))


def _stationarity_part() -> Column:
    return F.col("c") - F.col("aty") - F.col("z")


def kkt_residual(
    a: DataFrame,
    row_vec: DataFrame,
    col_vec: DataFrame,
    state_col: DataFrame,
    state_row: DataFrame,
) -> DataFrame:
    """``(case_id, part, block, position, value)`` for dual, box and stationarity."""
    rows = row_activity(a, row_vec, state_col, state_row).select(
        "case_id",
        F.lit("dual").alias("part"),
        "block",
        F.col("row").alias("position"),
        _dual_part().alias("value"),
    )
    cols = col_activity(a, col_vec, state_col, state_row).select(
        "case_id",
        F.explode(
            F.array(
                F.struct(F.lit("box").alias("part"), _box_part().alias("value")),
                F.struct(F.lit("stationarity").alias("part"), _stationarity_part().alias("value")),
            )
        ).alias("p"),
        F.col("col").alias("position"),
    )
    cols = cols.select(
        "case_id", "p.part", F.lit(None).cast("string").alias("block"), "position", "p.value"
    )
    return rows.unionByName(cols)


def residual_summary(
    a: DataFrame,
    row_vec: DataFrame,
    col_vec: DataFrame,
    state_col: DataFrame,
    state_row: DataFrame,
    tolerance: float = 5e-5,
    wide: Wide | None = None,
    known: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """One record per case: raw, normalised and combined norms and the stopping flags.

    A norm over an unknown value (null, NaN, or a state that is not there) is null, and its flag
    is false.  Only a case without rows, or without columns, has 0 for what it lacks.
    ``known`` holds the products of entries that are not in ``a``, by row and by column.
    """
    by_row, by_col = known or (None, None)
    primal = dual_projection(F.col("b") - F.col("ax"), F.col("block"))
    rows = (
        row_activity(a, row_vec, state_col, state_row, by_row)
        .groupBy("case_id")
        .agg(
            norm(_dual_part()).alias("dual"),
            norm(primal).alias("primal"),
            norm("b").alias("b_norm"),
            F.lit(True).alias("_rows"),
        )
    )
    cols = (
        col_activity(a, col_vec, state_col, state_row, wide, by_col)
        .groupBy("case_id")
        .agg(
            norm(_box_part()).alias("box"),
            norm(_stationarity_part()).alias("stationarity"),
            norm("x").alias("x_norm"),
            norm("z").alias("z_norm"),
            norm("c").alias("c_norm"),
            F.lit(True).alias("_cols"),
        )
    )
    joined = rows.join(cols, "case_id", "full_outer").select(
        "case_id",
        *[absent_as_zero("_rows", n).alias(n) for n in ("dual", "primal", "b_norm")],
        *[
            absent_as_zero("_cols", n).alias(n)
            for n in ("box", "stationarity", "x_norm", "z_norm", "c_norm")
        ],
    )
    scaled = joined.select(
        "case_id",
        F.sqrt(
            F.col("dual") ** 2 + F.col("box") ** 2 + F.col("stationarity") ** 2
        ).alias("kkt_combined_norm"),
        F.struct("primal", "box", "stationarity").alias("raw"),
        F.struct(
            (F.col("primal") / (1 + F.col("b_norm"))).alias("primal"),
            (F.col("box") / (1 + F.col("x_norm") + F.col("z_norm"))).alias("box"),
            (F.col("stationarity") / (1 + F.col("c_norm"))).alias("stationarity"),
        ).alias("normalized"),
    )
    n = "normalized"
    flags = {
        p: F.coalesce(F.col(f"{n}.{p}") <= tolerance, F.lit(False))
        for p in ("primal", "box", "stationarity")
    }
    return scaled.select(
        "*",
        F.sqrt(
            F.col(f"{n}.primal") ** 2 + F.col(f"{n}.box") ** 2 + F.col(f"{n}.stationarity") ** 2
        ).alias("normalized_combined_norm"),
        F.struct(
            *[flag.alias(p) for p, flag in flags.items()],
            (flags["primal"] & flags["box"] & flags["stationarity"]).alias("all_satisfied"),
        ).alias("stopping"),
        F.lit(tolerance).alias("tolerance"),
    )


def stopping_residual(
    a: DataFrame,
    row_vec: DataFrame,
    col_vec: DataFrame,
    state_col: DataFrame,
    state_row: DataFrame,
    tolerance: float = 5e-5,
) -> DataFrame:
    """The three normalised norms with their flags, flat."""
    summary = residual_summary(a, row_vec, col_vec, state_col, state_row, tolerance)
    return summary.select(
        "case_id",
        F.col("normalized.primal").alias("primal"),
        F.col("normalized.box").alias("box"),
        F.col("normalized.stationarity").alias("stationarity"),
        F.col("stopping.primal").alias("primal_ok"),
        F.col("stopping.box").alias("box_ok"),
        F.col("stopping.stationarity").alias("stationarity_ok"),
    )


def max_primal_violation(
    a: DataFrame, row_vec: DataFrame, col_vec: DataFrame, state_col: DataFrame
) -> DataFrame:
    """Largest equality, inequality and bound violation per case.

    A kind with an unknown term (a null or NaN state, a column without a state, a state
    without bounds) is null, and so is ``overall``.
    """
    gap = F.col("ax") - F.col("b")
    rows = (
        row_activity(a, row_vec, state_col)
        .groupBy("case_id")
        .agg(
            known_max(F.abs(gap), F.col("block") == "A1").alias("equality"),
            known_max(positive_part(-gap), F.col("block") == "A2").alias("inequality"),
            F.lit(True).alias("_rows"),
        )
    )
    cols = (
        state_col.select(*COL, "x")
        .join(col_vec.select(*COL, "lower", "upper"), COL, "full_outer")
        .groupBy("case_id")
        .agg(
            known_max(positive_part(F.col("lower") - F.col("x"))).alias("lower"),
            known_max(positive_part(F.col("x") - F.col("upper"))).alias("upper"),
            F.lit(True).alias("_cols"),
        )
    )
    kinds = {"equality": "_rows", "inequality": "_rows", "lower": "_cols", "upper": "_cols"}
    found = rows.join(cols, "case_id", "full_outer").select(
        "case_id", *[absent_as_zero(mark, n).alias(n) for n, mark in kinds.items()]
    )
    open_ = F.greatest(*[F.col(n).isNull() for n in kinds])
    return found.withColumn("overall", F.when(~open_, F.greatest(*kinds)))


def spectral_bounds(a: DataFrame) -> DataFrame:
    """Two upper bounds of the squared spectral norm: Frobenius, and row-sum x column-sum."""
    v = F.col("value")
    rows = (
        a.groupBy(*ROW)
        .agg(F.sum(v * v).alias("sq"), F.sum(F.abs(v)).alias("total"), F.count("*").alias("nnz"))
        .groupBy("case_id")
        .agg(
            F.sum("sq").alias("frobenius"),
            F.max("total").alias("max_row_sum"),
            F.sum("nnz").alias("nnz"),
        )
    )
    cols = (
        a.groupBy(*COL)
        .agg(F.sum(F.abs(v)).alias("total"))
        .groupBy("case_id")
        .agg(F.max("total").alias("max_col_sum"))
    )
    induced = F.col("max_row_sum") * F.col("max_col_sum")
    return rows.join(cols, "case_id").withColumn("induced", induced)


def start_vector(a: DataFrame, low: float, high: float) -> DataFrame:
    """A vector on the columns of ``a``, a fixed function of the column position."""
    unit = F.pmod(F.col("col") * 7_919 + 12_345, F.lit(10_007)) / F.lit(10_007.0)
    return a.select(*COL).distinct().select(*COL, (F.lit(low) + unit * (high - low)).alias("x"))


def normal_product(a: DataFrame, vec: DataFrame) -> DataFrame:
    return spmv_t(a, spmv(a, vec, "x", "y"), "y", "p")


def power_iteration(a: DataFrame, steps: int = 8) -> DataFrame:
    """Rayleigh estimate of the squared spectral norm per case, with its residual.

    A start vector in the null space of a case is replaced by the unit vector at the
    column of largest norm.  Each step writes two tables, the product and the next vector, whose
    size decides how it meets the matrix; the run length is fixed.  A matrix that is bucketed by
    row is not moved while the vectors are small.
    """
    vec = settle(start_vector(a, -1.0, 1.0))
    estimate = None
    for step in range(steps):
        product = settle(normal_product(a, vec))
        norms = product.groupBy("case_id").agg(F.sqrt(F.sum(F.col("p") ** 2)).alias("norm"))
        if step == 0:
            dead = norms.where(F.col("norm") == 0).select("case_id")
            if dead.limit(1).count():
                product = settle(_restart(a, product, dead))
                norms = product.groupBy("case_id").agg(F.sqrt(F.sum(F.col("p") ** 2)).alias("norm"))
        following = settle(
            product.join(norms, "case_id").select(*COL, (F.col("p") / F.col("norm")).alias("x"))
        )
        release(vec, product)
        vec = following
        if step == steps - 1:
            pair = normal_product(a, vec).join(vec, COL)
            moments = pair.groupBy("case_id").agg(
                F.sum(F.col("x") * F.col("p")).alias("xp"), F.sum(F.col("p") ** 2).alias("pp")
            )
            # |p - t x|^2 = pp - 2 t xp + t^2 for a unit vector x and t = xp
            residual = F.sqrt(positive_part(F.col("pp") - F.col("xp") ** 2))
            estimate = moments.select(
                "case_id",
                positive_part("xp").alias("rayleigh"),
                residual.alias("residual"),
                F.lit(steps).alias("steps"),
            )
    return estimate


def unit_at_longest(a: DataFrame) -> DataFrame:
    """The column of largest norm per case, ties to the first."""
    lengths = a.groupBy(*COL).agg(F.sum(F.col("value") ** 2).alias("sq"))
    return lengths.groupBy("case_id").agg(F.max_by("col", F.struct("sq", -F.col("col"))).alias("col"))


def _restart(a: DataFrame, product: DataFrame, dead: DataFrame) -> DataFrame:
    unit = unit_at_longest(a.join(dead, "case_id", "left_semi"))
    fresh = normal_product(a, unit.withColumn("x", F.lit(1.0)))
    return product.join(dead, "case_id", "left_anti").unionByName(fresh)


def collatz_bound(a: DataFrame, steps: int = 8) -> DataFrame:
    """Least ``max(|A|'|A| v / v)`` over the steps: an upper bound of the squared norm."""
    absolute = a.withColumn("value", F.abs("value"))
    vec = settle(start_vector(a, 0.5, 1.5))
    best = None
    floor = 64.0 * EPS
    for _ in range(steps):
        product = settle(normal_product(absolute, vec).join(vec, COL))
        ratio = product.groupBy("case_id").agg(
            F.max(F.col("p") / F.col("x")).alias("bound"), F.max("p").alias("top")
        )
        following = settle(
            product.join(ratio, "case_id").select(
                *COL, F.greatest(F.col("p") / F.col("top"), F.lit(floor)).alias("x")
            )
        )
        found = settle(ratio.select("case_id", "bound"))
        release(vec, product)
        vec = following
        best = found if best is None else best.unionByName(found)
    return best.groupBy("case_id").agg(F.min("bound").alias("bound"), F.count("*").alias("steps"))


def spectral_certificate(
    bounds: DataFrame, rayleigh: DataFrame, collatz: DataFrame, margin: float = 1e-10
) -> DataFrame:
    """A bound that is safe to use: the least upper bound plus rounding and asked margins.

    Spark has no next-float function, so the rounding margin is widened by a few units in
    the last place instead.
    """
    joined = bounds.join(rayleigh, "case_id").join(
        collatz.select("case_id", F.col("bound").alias("collatz")), "case_id"
    )
    upper = F.greatest(F.least("frobenius", "induced", "collatz"), F.col("rayleigh"))
    depth = F.greatest(F.lit(1.0), F.ceil(F.log2(F.col("nnz") + 1)))
    scale = F.greatest(F.lit(1.0), F.col("upper"))
    used = F.col("upper") * (1 + 4 * EPS) + 128.0 * EPS * depth * scale + F.lit(margin) * scale
    return (
        joined.withColumn("upper", upper)
        .withColumn("lambda_used", used)
        .withColumn("safe", F.col("lambda_used") > F.col("rayleigh"))
        .select(
            "case_id", "frobenius", "induced", "collatz", "rayleigh", "upper", "lambda_used", "safe"
        )
    )
