"""Largest squared singular value per case by Lanczos' recurrence, with a bound of its error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS, finite
from ..session import release, settle
from .algebra import COL, normal_product, start_vector, unit_at_longest

#: Halvings of the interval that holds the Ritz value: more than a double has bits.
HALVINGS = 64


def _pivots(alphas: Column, betas: Column) -> Column:
    """(a, b2): the diagonal with the square of the entry before it, 0 for the first."""
    before = F.concat(F.array(F.lit(0.0)), betas)
    pairs = F.zip_with(
        alphas, before, lambda a, b: F.struct(a.alias("a"), (b * b).alias("b2"))
    )
    return F.slice(pairs, 1, F.size(alphas))


def _is_above(pivots: Column, at: Column) -> Column:
    """True if ``at`` lies above every eigenvalue: all pivots of T - at I are negative."""
    last = F.aggregate(
        pivots, F.lit(-1.0), lambda d, e: F.when(d >= 0, F.lit(1.0)).otherwise(e["a"] - at - e["b2"] / d)
    )
    return last < 0


def ritz_value(alphas: Column, betas: Column) -> Column:
    """Largest eigenvalue of the tridiagonal matrix, by bisection from above.

    ``betas`` may hold the entry after the last row; it takes no part.
    """
    pivots = _pivots(alphas, betas)
    top = F.array_max(alphas)
    reach = 2 * F.array_max(F.transform(pivots, lambda e: F.sqrt(e["b2"])))
    start = F.struct(top.alias("low"), (top + reach + F.abs(top) * 4 * EPS + 1e-300).alias("high"))

    def halve(span: Column, _: Column) -> Column:
        middle = (span["low"] + span["high"]) / 2
        above = _is_above(pivots, middle)
        return F.struct(
            F.when(above, span["low"]).otherwise(middle).alias("low"),
            F.when(above, middle).otherwise(span["high"]).alias("high"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve)["high"]


def ritz_residual(alphas: Column, betas: Column, value: Column) -> Column:
    """``|A'A y - value y|`` of the unit Ritz vector y: the last beta times y's last entry.

    With d the pivots of T - value I, the last entry is 1 / sqrt(e) for e = 1 + b2 e' / d'^2 taken
    along the rows, a sum without cancellation.
    """
    start = F.struct(F.lit(-1.0).alias("d"), F.lit(0.0).alias("e"))

    def along(acc: Column, row: Column) -> Column:
        return F.struct(
            (row["a"] - value - row["b2"] / acc["d"]).alias("d"),
            (1 + row["b2"] * acc["e"] / (acc["d"] * acc["d"])).alias("e"),
        )

    last = F.aggregate(_pivots(alphas, betas), start, along)["e"]
    return F.element_at(betas, -1) / F.sqrt(last)


def _first_vector(a: DataFrame) -> DataFrame:
    """A unit vector per case that A'A has already been applied to once.

    A start that a case sends to zero is replaced by the unit vector at its longest column.
    """
    product = normal_product(a, start_vector(a, 0.5, 1.5))
    unit = normal_product(a, unit_at_longest(a).withColumn("x", F.lit(1.0)))
    both = product.select(*COL, "p", F.lit(0.0).alias("q")).unionByName(
        unit.select(*COL, F.lit(0.0).alias("p"), F.col("p").alias("q"))
    )
    both = settle(both.groupBy(*COL).agg(F.sum("p").alias("p"), F.sum("q").alias("q")))
    lengths = both.groupBy("case_id").agg(
        F.sqrt(F.sum(F.col("p") ** 2)).alias("_p"), F.sqrt(F.sum(F.col("q") ** 2)).alias("_q")
    )
    dead = F.col("_p") <= 64 * EPS * F.col("_q")
    unit_value = F.when(dead, F.col("q") / F.col("_q")).otherwise(F.col("p") / F.col("_p"))
    vec = settle(
        both.join(lengths.where("_q > 0"), "case_id").select(
            *COL, unit_value.alias("x"), F.lit(0.0).alias("before")
        )
    )
    release(both)
    return vec


def lanczos(a: DataFrame, steps: int = 24, tolerance: float = 1e-8) -> DataFrame:
    """case_id, rayleigh, residual, steps, converged: the largest eigenvalue of A'A.

    All cases step together; a case leaves the recurrence as soon as its residual is within
    ``tolerance`` of its Ritz value, and one that is not there after ``steps`` steps is reported
    with ``converged`` false.  An eigenvalue lies within ``residual`` of ``rayleigh``.  Only two
    vectors per case are kept; rounding that makes them lose orthogonality repeats found values and
    leaves the largest one and its residual right.

    A case whose entries are all 0, or too small for their fourth powers, gives 0, converged, after
    no step.  A null, NaN or infinite entry makes rayleigh and residual null and ``converged``
    false.  An empty table gives no rows.  Entries of one place count as their sum.
    """
    if steps < 1:
        raise ValueError("steps must be 1 or more")
    zero = a.groupBy("case_id").agg(
        F.count_if(~finite("value")).alias("_open"),
        F.max(F.abs("value")).alias("_top"),
    )
    left_out = settle(zero.where((F.col("_open") > 0) | (F.col("_top") ** 4 == 0)))
    body = a.join(left_out, "case_id", "left_anti")
    vec = _first_vector(body)
    known = settle(
        vec.select("case_id")
        .distinct()
        .select(
            "case_id",
            F.array().cast("array<double>").alias("alphas"),
            F.array().cast("array<double>").alias("betas"),
            F.lit(0.0).alias("rayleigh"),
            F.lit(0.0).alias("residual"),
            F.lit(False).alias("converged"),
        )
    )
    old: list[DataFrame] = []
    for _ in range(steps):
        w = normal_product(body, vec).join(vec, COL)
        w = settle(w.select(*COL, "x", (F.col("p") - F.col("before")).alias("w")))
        alpha = w.groupBy("case_id").agg(F.sum(F.col("w") * F.col("x")).alias("_alpha"))
        rest = w.join(alpha, "case_id").withColumn("w", F.col("w") - F.col("_alpha") * F.col("x"))
        beta = rest.groupBy("case_id").agg(
            F.max("_alpha").alias("_alpha"), F.sqrt(F.sum(F.col("w") ** 2)).alias("_beta")
        )
        grown = known.join(beta, "case_id", "left")
        went = F.col("_alpha").isNotNull()
        grown = grown.select(
            "case_id",
            *[
                F.when(went, F.concat(F.col(n), F.array(F.col(f"_{n[:-1]}")))).otherwise(F.col(n)).alias(n)
                for n in ("alphas", "betas")
            ],
        )
        # written before the Ritz values are read from the arrays, so that no plan repeats the sums
        arrays = settle(grown)
        judged = arrays.withColumn("rayleigh", ritz_value(F.col("alphas"), F.col("betas")))
        judged = judged.withColumn(
            "residual", ritz_residual(F.col("alphas"), F.col("betas"), F.col("rayleigh"))
        )
        small = F.col("residual") <= F.lit(tolerance) * F.col("rayleigh")
        settled = settle(judged.withColumn("converged", small))
        release(known, arrays, *old)
        known = settled
        going = known.where(~F.col("converged")).select(
            "case_id",
            F.element_at("alphas", -1).alias("_alpha"),
            F.element_at("betas", -1).alias("_beta"),
        )
        if not going.limit(1).count():
            old = [w, vec]
            break
        after = w.join(going, "case_id")
        step = (F.col("w") - F.col("_alpha") * F.col("x")) / F.col("_beta")
        # vectors stay expressions over the written w; w goes when the next one is written
        old = [w, vec]
        vec = after.select(*COL, step.alias("x"), (F.col("_beta") * F.col("x")).alias("before"))
    release(*old)
    report = known.select("case_id", "rayleigh", "residual", F.size("alphas").alias("steps"), "converged")
    rest = left_out.select(
        "case_id",
        F.when(F.col("_open") == 0, 0.0).alias("rayleigh"),
        F.when(F.col("_open") == 0, 0.0).alias("residual"),
        F.lit(0).alias("steps"),
        (F.col("_open") == 0).alias("converged"),
    )
    return report.unionByName(rest)
