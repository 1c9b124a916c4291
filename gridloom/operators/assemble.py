"""Constraint tables of the dispatch LP as coordinate lists."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if
from ..functions.heavy import Heavy, join_heavy, plain
from ..session import beside, settle, spread, unfolded
from .derive import (
    COUNT_OF,
    case_dims,
    expand_row_families,
    expected_dimensions,
    row_families,
    variable_index,
)


def coo_consolidate(a: DataFrame) -> DataFrame:
    """Sum duplicate positions and drop zeros."""
    keys = ["case_id", "block", "row", "col"]
    return a.groupBy(*keys).agg(F.sum("value").alias("value")).where(F.col("value") != 0)


def coo_stack(blocks: list[tuple[DataFrame, int, int]]) -> DataFrame:
    """Place matrices at row and column offsets: vertical, horizontal or both."""
    result = None
    for a, row_offset, col_offset in blocks:
        moved = a.withColumn("row", F.col("row") + F.lit(row_offset)).withColumn(
            "col", F.col("col") + F.lit(col_offset)
        )
        result = moved if result is None else result.unionByName(moved)
    return result


def coo_time_expand(a: DataFrame, periods: int, rows: int, cols: int) -> DataFrame:
    """Block-diagonal repetition of an ``rows x cols`` matrix over the periods.

    Each entry is copied in place, without a join or a shuffle.
    """
    t = F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("_t")
    return a.select("*", t).select(
        "case_id",
        "block",
        (F.col("row") + F.col("_t") * F.lit(rows)).alias("row"),
        (F.col("col") + F.col("_t") * F.lit(cols)).alias("col"),
        "value",
    )


def coo_kron(pattern: str, device: DataFrame, periods: int, rows: int, cols: int) -> DataFrame:
    """Kronecker product of a time pattern with a device matrix.

    ``ones`` is one row over all periods, ``difference`` takes period t minus t-1 for
    t >= 1, ``lower`` sums the periods up to t.  An entry unfolds by period first, so one row
    never holds more than one period's cells.
    """
    t = F.col("_t")
    cell = lambda r, c, w: F.struct(r.alias("r"), c.alias("c"), F.lit(w).alias("w"))
    if pattern == "ones":
        first, cells = 0, F.array(cell(F.lit(0), t, 1.0))
    elif pattern == "difference":
        first, cells = 1, F.array(cell(t - 1, t, 1.0), cell(t - 1, t - 1, -1.0))
    elif pattern == "lower":
        first = 0
        cells = F.transform(F.sequence(F.lit(0), t), lambda s: cell(t, s, 1.0))
    else:
        raise ValueError(f"unknown time pattern {pattern!r}")
    times = F.array(*[]) if periods <= first else F.sequence(F.lit(first), F.lit(periods - 1))
    unfolded_rows = device.select("*", F.explode(times.cast("array<int>")).alias("_t"))
    return unfolded_rows.select("*", F.explode(cells).alias("_k")).select(
        "case_id",
        "block",
        (F.col("_k.r") * F.lit(rows) + F.col("row")).alias("row"),
        (F.col("_k.c") * F.lit(cols) + F.col("col")).alias("col"),
        (F.col("_k.w") * F.col("value")).alias("value"),
    )


# ---------------------------------------------------------------------------
# Constraint families.  ``dims`` is one row per case with counts and offsets (see
# ``derive.case_dims``).  Each function returns entries ``a`` and right-hand sides
# ``row_vec``; a row number is arithmetic on (period, position), never a sort.
# ---------------------------------------------------------------------------


def _over_periods(devices: DataFrame, dims: DataFrame, first: int = 0) -> DataFrame:
    """Devices with their case's dims, one row per period from ``first``."""
    joined = devices.join(beside(dims), "case_id").where(F.col("periods") > first)
    start = F.lit(first).cast("bigint")
    return joined.withColumn("t", F.explode(F.sequence(start, F.col("periods") - 1)))


def _column(kind: str, period: Column, pos: Column) -> Column:
    return F.col(f"c_{kind}") + period * F.col(COUNT_OF[kind]) + pos


def _entries(df: DataFrame, block: str, cells: list[tuple[Column, Column, Column]]) -> DataFrame:
    """Unfold (row, col, value) triples of each row; zero values are left out."""
    packed = F.array(
        *[
            F.struct(r.cast("bigint").alias("row"), c.cast("bigint").alias("col"), v.alias("value"))
            for r, c, v in cells
        ]
    )
    out = df.select("case_id", F.lit(block).alias("block"), F.explode(packed).alias("e"))
    return out.select("case_id", "block", "e.*").where(F.col("value") != 0)


def _rhs(df: DataFrame, block: str, pairs: list[tuple[Column, Column]]) -> DataFrame:
    packed = F.array(
        *[F.struct(r.cast("bigint").alias("row"), b.cast("double").alias("b")) for r, b in pairs]
    )
    out = df.select("case_id", F.lit(block).alias("block"), F.explode(packed).alias("e"))
    return out.select("case_id", "block", "e.*")


def rows_power_balance(dims: DataFrame, load: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supply of each period equals its load."""
    cols = variable_index(dims, ("p_g", "p_rg", "p_ess_dc", "p_ess_ch"))
    sign = F.when(F.col("kind") == "p_ess_ch", -1.0).otherwise(1.0)
    a = cols.select(
        "case_id", F.lit("A1").alias("block"), F.col("period").alias("row"), "col", sign.alias("value")
    )
    b = load.groupBy("case_id", "period").agg(F.sum("mw").alias("b"))
    return a, b.select("case_id", F.lit("A1").alias("block"), F.col("period").alias("row"), "b")


def rows_storage_terminal(
    dims: DataFrame, storage: DataFrame, dt: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """Net stored energy over the horizon is zero."""
    base = _over_periods(storage, dims)
    row = F.col("periods") + F.col("pos")
    a = _entries(
        base,
        "A1",
        [
            (row, _column("p_ess_dc", F.col("t"), F.col("pos")), F.lit(-dt) / F.col("discharge_eff")),
            (row, _column("p_ess_ch", F.col("t"), F.col("pos")), F.lit(dt) * F.col("charge_eff")),
        ],
    )
    return a, _rhs(storage.join(dims, "case_id"), "A1", [(row, F.lit(0.0))])


def rows_line_flow(
    dims: DataFrame,
    ptdf: DataFrame,
    devices: DataFrame,
    lines: DataFrame,
    fixed_flow: DataFrame,
    heavy: Heavy | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Lower and upper flow rows of every line and period.

    ``ptdf(case_id, line_pos, bus_id, value)`` meets ``devices(case_id, device, pos,
    bus_id)`` on the bus once; periods, sides and storage signs unfold afterwards.  A bus with a
    large part of all devices is in ``heavy``, ``find_heavy(devices, "case_id", "bus_id")``.  The
    devices are spread first: each meets every line of its case, and a repeated factor table would
    leave that to the few tasks that read them.
    """
    factors = ptdf.where(F.col("value") != 0)
    pairs = join_heavy(spread(devices, "case_id", "device", "pos"), factors, heavy or plain("case_id", "bus_id"))
    base = _over_periods(pairs, dims)
    t, pos, v, line = F.col("t"), F.col("pos"), F.col("value"), F.col("line_pos")
    low = F.col("r_line_lower") + t * F.col("n_line") + line
    high = F.col("r_line_upper") + t * F.col("n_line") + line

    def both(kind: str, sign: float) -> list:
        c = _column(kind, t, pos).cast("bigint")
        return [
            F.struct(low.cast("bigint").alias("row"), c.alias("col"), (v * sign).alias("value")),
            F.struct(high.cast("bigint").alias("row"), c.alias("col"), (v * -sign).alias("value")),
        ]

    cells = (
        F.when(F.col("device") == "gen", F.array(*both("p_g", 1.0)))
        .when(F.col("device") == "renewable", F.array(*both("p_rg", 1.0)))
        .otherwise(F.array(*both("p_ess_dc", 1.0), *both("p_ess_ch", -1.0)))
    )
    a = base.select("case_id", F.lit("A2").alias("block"), F.explode(cells).alias("e"))
    limits = unfolded(fixed_flow).join(
        lines.select("case_id", "line_pos", "limit_mw"), ["case_id", "line_pos"]
    )
    limits = limits.join(beside(dims), "case_id").withColumn("t", F.col("period"))
    rhs = _rhs(
        limits,
        "A2",
        [
            (low, -F.col("limit_mw") - F.col("mw")),
            (high, F.col("mw") - F.col("limit_mw")),
        ],
    )
    return a.select("case_id", "block", "e.*"), rhs


def rows_headroom_footroom(dims: DataFrame, gen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Output plus up-reserve within the upper limit, minus down-reserve above the lower."""
    base = _over_periods(gen.withColumnRenamed("gen_pos", "pos"), dims)
    t, pos = F.col("t"), F.col("pos")
    up = F.col("r_headroom") + t * F.col("n_gen") + pos
    down = F.col("r_footroom") + t * F.col("n_gen") + pos
    p = _column("p_g", t, pos)
    a = _entries(
        base,
        "A2",
        [
            (up, p, F.lit(-1.0)),
            (up, _column("r_up", t, pos), F.lit(-1.0)),
            (down, p, F.lit(1.0)),
            (down, _column("r_down", t, pos), F.lit(-1.0)),
        ],
    )
    return a, _rhs(base, "A2", [(up, -F.col("upper_mw")), (down, F.col("lower_mw"))])


def rows_reserve_requirement(dims: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reserves of each period reach the requirement, per direction."""
    cols = variable_index(dims, ("r_up", "r_down")).join(
        beside(dims.select("case_id", "r_reserve_up", "r_reserve_down")), "case_id"
    )
    first = F.when(F.col("kind") == "r_up", F.col("r_reserve_up")).otherwise(F.col("r_reserve_down"))
    a = cols.select(
        "case_id",
        F.lit("A2").alias("block"),
        (first + F.col("period")).alias("row"),
        "col",
        F.lit(1.0).alias("value"),
    )
    needs = profile.join(dims, "case_id")
    rhs = _rhs(
        needs,
        "A2",
        [
            (F.col("r_reserve_up") + F.col("period"), F.col("reserve_up")),
            (F.col("r_reserve_down") + F.col("period"), F.col("reserve_down")),
        ],
    )
    return a, rhs


def rows_ramp(dims: DataFrame, gen: DataFrame, dt: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Change from the period before within the down and up limits, from period 1 on."""
    base = _over_periods(gen.withColumnRenamed("gen_pos", "pos"), dims, 1)
    t, pos = F.col("t"), F.col("pos")
    local = (t - 1) * F.col("n_gen") + pos
    down, up = F.col("r_ramp_down") + local, F.col("r_ramp_up") + local
    now, before = _column("p_g", t, pos), _column("p_g", t - 1, pos)
    a = _entries(
        base,
        "A2",
        [
            (down, now, F.lit(1.0)),
            (down, before, F.lit(-1.0)),
            (up, now, F.lit(-1.0)),
            (up, before, F.lit(1.0)),
        ],
    )
    rhs = _rhs(
        base, "A2", [(down, -F.col("ramp_down") * F.lit(dt)), (up, -F.col("ramp_up") * F.lit(dt))]
    )
    return a, rhs


def rows_storage_energy(
    dims: DataFrame, storage: DataFrame, dt: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """Energy after each period within its limits.

    Row t sums the periods up to t; those are generated in place, not by a range join.
    """
    base = _over_periods(storage, dims)
    t, pos = F.col("t"), F.col("pos")
    local = t * F.col("n_ess") + pos
    low, high = F.col("r_energy_lower") + local, F.col("r_energy_upper") + local
    long = base.withColumn("s", F.explode(F.sequence(F.lit(0).cast("bigint"), t)))
    out = F.lit(-dt) / F.col("discharge_eff")
    into = F.lit(dt) * F.col("charge_eff")
    dc, ch = _column("p_ess_dc", F.col("s"), pos), _column("p_ess_ch", F.col("s"), pos)
    a = _entries(
        long, "A2", [(low, dc, out), (low, ch, into), (high, dc, -out), (high, ch, -into)]
    )
    rhs = _rhs(
        base,
        "A2",
        [
            (low, F.col("min_mwh") - F.col("initial_mwh")),
            (high, F.col("initial_mwh") - F.col("max_mwh")),
        ],
    )
    return a, rhs


def column_bounds_costs(
    dims: DataFrame,
    gen: DataFrame,
    renewable: DataFrame,
    storage: DataFrame,
    dt: float = 1.0,
    renewable_penalty: float = 1.0,
    storage_penalty: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """Bounds and cost of every variable, and the objective's constant per case."""
    zero = F.lit(0.0)

    def pack(df: DataFrame, cells: list[tuple[Column, Column, Column, Column]]) -> DataFrame:
        packed = F.array(
            *[
                F.struct(
                    col.cast("bigint").alias("col"),
                    c.alias("c"),
                    low.alias("lower"),
                    high.alias("upper"),
                )
                for col, c, low, high in cells
            ]
        )
        return df.select("case_id", F.explode(packed).alias("v")).select("case_id", "v.*")

    gens = _over_periods(gen.withColumnRenamed("gen_pos", "pos"), dims)
    t, pos = F.col("t"), F.col("pos")
    parts = pack(
        gens,
        [
            (_column("p_g", t, pos), F.col("slope"), F.col("lower_mw"), F.col("upper_mw")),
            (_column("r_up", t, pos), zero, zero, F.col("ramp_up") * F.lit(dt)),
            (_column("r_down", t, pos), zero, zero, F.col("ramp_down") * F.lit(dt)),
        ],
    )
    green = renewable.join(dims, "case_id")
    parts = parts.unionByName(
        pack(
            green,
            [
                (
                    _column("p_rg", F.col("period"), pos),
                    F.lit(-renewable_penalty),
                    F.col("min_mw"),
                    F.col("max_mw"),
                )
            ],
        )
    )
    store = _over_periods(storage, dims)
    loss_out = F.lit(storage_penalty) * (1 / F.col("discharge_eff") - 1)
    loss_in = F.lit(storage_penalty) * (1 - F.col("charge_eff"))
    parts = parts.unionByName(
        pack(
            store,
            [
                (_column("p_ess_dc", t, pos), loss_out, zero, F.col("max_discharge")),
                (_column("p_ess_ch", t, pos), loss_in, zero, F.col("max_charge")),
            ],
        )
    )
    fixed = gen.join(dims.select("case_id", "periods"), "case_id").select(
        "case_id", (F.col("periods") * F.col("constant")).alias("v")
    )
    spilled = renewable.select("case_id", (F.lit(renewable_penalty) * F.col("max_mw")).alias("v"))
    constant = fixed.unionByName(spilled).groupBy("case_id").agg(F.sum("v").alias("constant"))
    return parts, constant


class LpTables(NamedTuple):
    dims: DataFrame
    a: DataFrame
    row_vec: DataFrame
    col_vec: DataFrame
    constant: DataFrame
    constraint_row: DataFrame


def build_lp_tables(
    gen: DataFrame,
    renewable: DataFrame,
    storage: DataFrame,
    lines: DataFrame,
    ptdf: DataFrame,
    fixed_flow: DataFrame,
    load: DataFrame,
    profile: DataFrame,
    dt: float = 1.0,
    renewable_penalty: float = 1.0,
    storage_penalty: float = 1.0,
) -> LpTables:
    """All families in row order.

    ``gen`` is normalised (``derive.normalize_case``) with ``slope`` and ``constant``.
    """
    dims = settle(case_dims(gen, renewable, storage, lines, profile))
    place = ["case_id", "bus_id", "pos"]
    devices = (
        gen.select("case_id", "bus_id", F.col("gen_pos").alias("pos"), F.lit("gen").alias("device"))
        .unionByName(
            renewable.where(F.col("period") == 0).select(*place, F.lit("renewable").alias("device"))
        )
        .unionByName(storage.select(*place, F.lit("storage").alias("device")))
    )
    families = [
        rows_power_balance(dims, load),
        rows_storage_terminal(dims, storage, dt),
        rows_line_flow(dims, ptdf, devices, lines, fixed_flow),
        rows_headroom_footroom(dims, gen),
        rows_reserve_requirement(dims, profile),
        rows_ramp(dims, gen, dt),
        rows_storage_energy(dims, storage, dt),
    ]
    a, row_vec = families[0]
    for entries, rhs in families[1:]:
        a = a.unionByName(entries)
        row_vec = row_vec.unionByName(rhs)
    col_vec, constant = column_bounds_costs(
        dims, gen, renewable, storage, dt, renewable_penalty, storage_penalty
    )
    return LpTables(dims, a, row_vec, col_vec, constant, expand_row_families(row_families(dims)))


def check_lp_dimensions(lp: LpTables) -> DataFrame:
    """Built sizes against the closed form, per case."""
    rows = lp.row_vec.groupBy("case_id").agg(
        count_if(F.col("block") == "A1").alias("rows_a1"),
        count_if(F.col("block") == "A2").alias("rows_a2"),
    )
    cols = lp.col_vec.groupBy("case_id").agg(F.count("*").alias("columns"))
    joined = lp.dims.select("case_id", "n", "m1", "m2").join(rows, "case_id", "left")
    joined = joined.join(cols, "case_id", "left").na.fill(0)
    ok = (
        (F.col("n") == F.col("columns"))
        & (F.col("m1") == F.col("rows_a1"))
        & (F.col("m2") == F.col("rows_a2"))
    )
    return joined.withColumn("passed", ok)


def nnz_upper_bound(spec: DataFrame) -> DataFrame:
    """Entry count of the printed model before any zero factor is dropped."""
    t, g, r, s, b = (
        F.col(c).cast("bigint")
        for c in ("periods", "generators", "renewables", "storage", "branches")
    )
    devices = g + r + 2 * s
    line = 2 * t * b * devices
    other = t * devices + 2 * t * s + 6 * t * g + 4 * (t - 1) * g + 2 * s * t * (t + 1)
    return spec.select("*", line.alias("line_bound"), other.alias("nonline"), (line + other).alias("nnz_bound"))


def nnz_ledger(ptdf_devices: DataFrame, spec: DataFrame, published: DataFrame) -> DataFrame:
    """Exact entry counts of every horizon from the one-period line support.

    ``ptdf_devices(case_id, device, value)`` is counted once; horizons are arithmetic.
    """
    weight = F.when(F.col("device") == "storage", 2).otherwise(1)
    support = (
        ptdf_devices.where(F.col("value") != 0)
        .groupBy("case_id")
        .agg(F.sum(weight).cast("bigint").alias("line_base"))
    )
    sized = nnz_upper_bound(expected_dimensions(spec)).join(support, "case_id")
    nnz = 2 * F.col("periods") * F.col("line_base") + F.col("nonline")
    ledger = sized.withColumn("nnz", nnz).join(
        published.select("case_id", "periods", "published_nnz"), ["case_id", "periods"], "left"
    )
    return ledger.select(
        "case_id",
        "periods",
        "line_base",
        "nonline",
        "nnz",
        (F.col("nnz") * 12 + (F.col("m1") + F.col("m2") + 2) * 4).alias("csr_bytes"),
        "published_nnz",
        (F.col("nnz") - F.col("published_nnz")).alias("difference"),
    )
