"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
EPS = 2.0**-52
TINY = 2.0**-1022


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: str | Column) -> Column:
    """True for a non-null number that is neither NaN nor infinite."""
    value = col(value).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(INF))


def positive_part(value: str | Column) -> Column:
    """max(value, 0); null and NaN stay what they are."""
    value = col(value)
    return F.when(value > 0, value).when(value <= 0, F.lit(0.0))


def clip(value: Column, lower: Column, upper: Column) -> Column:
    """``value`` inside its bounds; null and NaN stay what they are."""
    return (
        F.when(F.isnan(value), value)
        .when(value < lower, lower)
        .when(value > upper, upper)
        .otherwise(value)
    )


def whole_sum(value: str | Column) -> Column:
    """Sum of a group that is null as soon as one of its values is."""
    value = col(value)
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))


def unknown(value: str | Column) -> Column:
    """True for null and NaN."""
    value = col(value).cast("double")
    return value.isNull() | F.isnan(value)


def known_max(value: Column, among: Column | None = None) -> Column:
    """Largest value of a group (of the rows ``among``): 0 without rows, null if one is unknown."""
    among = F.lit(True) if among is None else among
    open_ = F.count_if(among & unknown(value))
    return F.when(open_ == 0, F.coalesce(F.max(F.when(among, value)), F.lit(0.0)))


def norm(value: str | Column) -> Column:
    """Euclidean norm of a group: null if one of its values is unknown."""
    value = col(value)
    return F.when(F.count_if(unknown(value)) == 0, F.sqrt(F.sum(value * value)))


def absent_as_zero(present: str, value: str) -> Column:
    """0 where an outer join found no row (its mark ``present`` is null); unknown stays unknown."""
    return F.when(F.col(present).isNull(), F.lit(0.0)).otherwise(F.col(value))


def reason_list(pairs: Iterable[tuple[str, Column]]) -> Column:
    """Names of the conditions that hold, in the order given; null conditions do not hold."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in pairs])
    )


def first_reason(pairs: Iterable[tuple[str, Column]]) -> Column:
    return F.get(reason_list(pairs), F.lit(0))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def every(cond: Column) -> Column:
    """True when the condition holds (and is known) in all rows of the group."""
    return F.min(F.coalesce(cond, F.lit(False)))


def near_zero(value: str | Column, atol: float = 1e-8) -> Column:
    return F.abs(col(value)) <= F.lit(atol)


def scaled_gap(value: str | Column, reference: str | Column) -> Column:
    """|a - b| / max(1, |b|)."""
    return F.abs(col(value) - col(reference)) / F.greatest(F.lit(1.0), F.abs(col(reference)))


def close(a: str | Column, b: str | Column, rtol: float = 1e-12, atol: float = 1e-12) -> Column:
    a, b = col(a), col(b)
    bound = F.greatest(F.lit(atol), F.lit(rtol) * F.greatest(F.abs(a), F.abs(b)))
    return F.when(a.isNull() & b.isNull(), True).otherwise(
        F.coalesce(F.abs(a - b) <= bound, F.lit(False))
    )


def rounded(value: str | Column, places: int = 6) -> Column:
    """Round for reports; negative zero becomes zero."""
    return F.round(col(value), places) + F.lit(0.0)
