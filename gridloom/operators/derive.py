"""Derived tables: normalised cases, resource placement, positions and dispatch blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if, near_zero
from ..functions.ordered import BLOCK, spread_sequence
from ..session import beside, settle, unfolded

# The order of the variable blocks.
KINDS = ("p_g", "p_rg", "p_ess_dc", "p_ess_ch", "r_up", "r_down")
COUNT_OF = {
    "p_g": "n_gen",
    "p_rg": "n_rg",
    "p_ess_dc": "n_ess",
    "p_ess_ch": "n_ess",
    "r_up": "n_gen",
    "r_down": "n_gen",
}
DEVICE_OF = {"n_gen": "gen", "n_rg": "renewable", "n_ess": "storage"}

# Shares of the base load, durations and efficiencies of the placed resources.
POLICY = {
    "renewable_share": 0.10,
    "renewable_availability": 1.0,
    "renewable_minimum": 0.0,
    "storage_share": 0.01,
    "storage_hours": 4.0,
    "storage_minimum": 0.0,
    "storage_initial": 0.5,
    "charge_eff": 0.95,
    "discharge_eff": 0.95,
    "ramp_share": 0.10,
    "reserve_up_share": 0.01,
    "reserve_down_share": 0.01,
}


def idiv(a: Column, b: Column | str) -> Column:
    """Whole-number division."""
    b = F.col(b) if isinstance(b, str) else b
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def active_elements(df: DataFrame) -> DataFrame:
    return df.where(F.col("status"))


def effective_tap(branch: DataFrame) -> DataFrame:
    """A tap ratio of zero means one."""
    tap = F.when(near_zero("tap"), F.lit(1.0)).otherwise(F.col("tap"))
    return branch.withColumn("effective_tap", tap)


def bus_demand(bus: DataFrame) -> DataFrame:
    return bus.withColumn("withdrawal_mw", F.col("demand_mw") + F.col("shunt_mw"))


def linear_cost_terms(gen: DataFrame) -> DataFrame:
    """Slope and constant: the tail of a polynomial, or the line of a one-segment cost.

    Costs that are neither get null terms.
    """
    p = F.col("parameters")
    n = F.size(p)
    polynomial = (F.col("model") == 2) & (n >= 2)
    segment = (F.col("model") == 1) & (n == 4)
    x1, y1, x2, y2 = (F.get(p, F.lit(i)) for i in range(4))
    distinct = F.abs(x2 - x1) > 1e-8 + 1e-5 * F.abs(x2)
    line = F.when(distinct, (y2 - y1) / (x2 - x1))
    slope = F.when(polynomial, F.get(p, n - 2)).when(segment, line)
    constant = F.when(polynomial, F.get(p, n - 1)).when(segment, y1 - line * x1)
    return gen.withColumn("slope", slope).withColumn("constant", constant)


def normalize_case(
    bus: DataFrame, gen: DataFrame, branch: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keep every row: offline generators get zero limits, special branches get flags."""
    zero = F.lit(0.0)
    online = F.col("status")
    gens = gen.withColumns(
        {
            "lower_mw": F.when(online, F.col("min_mw")).otherwise(zero),
            "upper_mw": F.when(online, F.col("max_mw")).otherwise(zero),
            "ramp_up": F.when(online, F.col("ramp_up")).otherwise(zero),
            "ramp_down": F.when(online, F.col("ramp_down")).otherwise(zero),
        }
    )
    limited = (F.col("angle_min") > -360) | (F.col("angle_max") < 360)
    branches = branch.withColumns(
        {
            "zero_rate": F.col("rate_mw") == 0,
            "ignored_angle": limited,
            "inactive": ~F.col("status"),
        }
    )
    return bus_demand(bus), gens, branches


def place_resources(gen: DataFrame, spec: DataFrame) -> DataFrame:
    """``(case_id, kind, pos, gen_pos, bus_id, resource_id)``.

    Renewable i sits at generator i mod G.  Storage j sits at every second renewable,
    starting over when these run out.  Both are arithmetic on positions, so the only join
    looks up the bus of a generator position.
    """
    sizes = gen.groupBy("case_id").agg(F.count("*").alias("_gens"))
    base = spec.select("case_id", "renewables", "storage").join(sizes, "case_id")
    i = F.col("pos")
    renewable = spread_sequence(base, F.col("renewables"), "pos", ["case_id"]).select(
        "case_id", F.lit("renewable").alias("kind"), "pos", (i % F.col("_gens")).alias("gen_pos")
    )
    halves = F.ceil(F.col("renewables") / 2)
    storage = spread_sequence(base, F.col("storage"), "pos", ["case_id"]).select(
        "case_id",
        F.lit("storage").alias("kind"),
        "pos",
        ((i % halves) * 2 % F.col("_gens")).alias("gen_pos"),
    )
    prefix = F.when(F.col("kind") == "renewable", "rg").otherwise("ess")
    placed = unfolded(renewable.unionByName(storage)).join(
        gen.select("case_id", "gen_pos", "bus_id"), ["case_id", "gen_pos"]
    )
    return placed.withColumn(
        "resource_id", F.format_string("%s_%04d_bus_%d", prefix, F.col("pos") + 1, F.col("bus_id"))
    )


def base_load(bus: DataFrame) -> DataFrame:
    return bus.groupBy("case_id").agg(
        F.sum(F.col("demand_mw") + F.col("shunt_mw")).alias("base_load")
    )


def size_resources(
    placement: DataFrame, load: DataFrame, spec: DataFrame, policy: dict[str, float] = POLICY
) -> DataFrame:
    """Nameplate, energy and limits of placed resources from ``load(case_id, base_load)``."""
    sized = placement.join(beside(load), "case_id").join(
        beside(spec.select("case_id", "renewables", "storage")), "case_id"
    )
    p = {k: F.lit(v) for k, v in policy.items()}
    name = p["renewable_share"] * F.col("base_load") / F.col("renewables")
    power = p["storage_share"] * F.col("base_load") / F.col("storage")
    is_rg = F.col("kind") == "renewable"
    top = F.when(is_rg, p["renewable_availability"] * name).otherwise(power)
    energy = F.when(~is_rg, p["storage_hours"] * power)
    return sized.select(
        *placement.columns,
        F.when(is_rg, p["renewable_minimum"] * top).otherwise(F.lit(0.0)).alias("min_mw"),
        top.alias("max_mw"),
        (p["storage_minimum"] * energy).alias("min_mwh"),
        (p["storage_initial"] * energy).alias("initial_mwh"),
        energy.alias("max_mwh"),
        F.when(~is_rg, p["charge_eff"]).alias("charge_eff"),
        F.when(~is_rg, p["discharge_eff"]).alias("discharge_eff"),
    )


def size_ramps(gen: DataFrame, policy: dict[str, float] = POLICY) -> DataFrame:
    """Ramp limits as a share of the upper limit; offline units cannot move."""
    ramp = F.when(
        F.col("status"), F.lit(policy["ramp_share"]) * F.greatest(F.col("max_mw"), F.lit(0.0))
    ).otherwise(F.lit(0.0))
    return gen.withColumn("ramp_up", ramp).withColumn("ramp_down", ramp)


def size_profile(load: DataFrame, periods: int, policy: dict[str, float] = POLICY) -> DataFrame:
    """Flat load and constant reserve requirements for every period."""
    return load.select(
        "case_id",
        F.explode(F.expr(f"sequence(0L, {periods - 1}L)")).alias("period"),
        F.lit(1.0).alias("multiplier"),
        (F.lit(policy["reserve_up_share"]) * F.col("base_load")).alias("reserve_up"),
        (F.lit(policy["reserve_down_share"]) * F.col("base_load")).alias("reserve_down"),
    )


def expand_load(bus: DataFrame, dims: DataFrame, profile: DataFrame) -> DataFrame:
    """Load per period and bus: the period is generated per bus, then looks up its factor."""
    long = bus.join(dims.select("case_id", "periods"), "case_id").withColumn(
        "period", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("periods") - 1))
    )
    return long.join(
        beside(settle(profile.select("case_id", "period", "multiplier"))), ["case_id", "period"]
    ).select(
        "case_id",
        "period",
        "bus_id",
        (F.col("multiplier") * (F.col("demand_mw") + F.col("shunt_mw"))).alias("mw"),
    )


def case_dims(
    gen: DataFrame,
    renewable: DataFrame,
    storage: DataFrame,
    lines: DataFrame,
    profile: DataFrame,
) -> DataFrame:
    """One row per case: periods and device counts, each counted before the tables meet."""
    names = ["periods", "n_gen", "n_rg", "n_ess", "n_line"]

    def part(df: DataFrame, name: str, value: Column) -> DataFrame:
        one = df.groupBy("case_id").agg(value.cast("bigint").alias(name))
        return one.select(
            "case_id", *[F.col(n) if n == name else F.lit(0).cast("bigint").alias(n) for n in names]
        )

    pieces = [
        part(profile, "periods", F.max("period") + 1),
        part(gen, "n_gen", F.count("*")),
        part(renewable, "n_rg", F.max("pos") + 1),
        part(storage, "n_ess", F.count("*")),
        part(lines, "n_line", F.count("*")),
    ]
    union = pieces[0]
    for piece in pieces[1:]:
        union = union.unionByName(piece)
    sums = union.groupBy("case_id").agg(*[F.sum(n).alias(n) for n in names])
    return with_offsets(sums.where(F.col("periods") > 0))


def with_offsets(dims: DataFrame) -> DataFrame:
    """Add the first column of each variable block and the first row of each family."""
    t, g, s, lines = (F.col(c) for c in ("periods", "n_gen", "n_ess", "n_line"))
    offset = F.lit(0).cast("bigint")
    columns: dict[str, Column] = {}
    for kind in KINDS:
        columns[f"c_{kind}"] = offset
        offset = offset + t * F.col(COUNT_OF[kind])
    columns["n"] = offset
    columns["m1"] = t + s
    row = F.lit(0).cast("bigint")
    for name, size in (
        ("r_line_lower", t * lines),
        ("r_line_upper", t * lines),
        ("r_headroom", t * g),
        ("r_footroom", t * g),
        ("r_reserve_up", t),
        ("r_reserve_down", t),
        ("r_ramp_down", (t - 1) * g),
        ("r_ramp_up", (t - 1) * g),
        ("r_energy_lower", t * s),
        ("r_energy_upper", t * s),
    ):
        columns[name] = row
        row = row + size
    columns["m2"] = row
    columns["m"] = columns["m1"] + row
    return dims.select("*", *[c.cast("bigint").alias(n) for n, c in columns.items()])


def variable_index(dims: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``(case_id, col, kind, period, pos)``, block by block and period by period."""
    blocks = dims.select(
        "case_id",
        "periods",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("kind"),
                        F.col(f"c_{k}").alias("start"),
                        F.col(COUNT_OF[k]).alias("width"),
                    )
                    for k in kinds
                ]
            )
        ).alias("b"),
    ).select("case_id", "periods", "b.*")
    rows = spread_sequence(
        blocks, F.col("periods") * F.col("width"), "_i", ["case_id", "kind"]
    )
    return rows.select(
        "case_id",
        (F.col("start") + F.col("_i")).alias("col"),
        "kind",
        idiv(F.col("_i"), "width").alias("period"),
        (F.col("_i") % F.col("width")).alias("pos"),
    )


def variable_key(cols: DataFrame, dims: DataFrame) -> DataFrame:
    """Inverse of ``variable_index`` for any table with ``case_id, col``."""
    spans = dims.select("case_id", "n", "n_gen", "n_rg", "n_ess", *[f"c_{k}" for k in KINDS])
    joined = cols.join(beside(spans), "case_id").where((F.col("col") >= 0) & (F.col("col") < F.col("n")))
    kind, start, width = F.lit(None), F.lit(None), F.lit(None)
    for k in KINDS:
        inside = F.col("col") >= F.col(f"c_{k}")
        inside = inside & (F.col(COUNT_OF[k]) > 0)
        kind = F.when(inside, F.lit(k)).otherwise(kind)
        start = F.when(inside, F.col(f"c_{k}")).otherwise(start)
        width = F.when(inside, F.col(COUNT_OF[k])).otherwise(width)
    local = F.col("col") - start
    return joined.select(
        *cols.columns,
        kind.alias("kind"),
        idiv(local, width).alias("period"),
        (local % width).alias("pos"),
    )


def row_families(dims: DataFrame) -> DataFrame:
    """One row per run of constraint rows: start, size and how to read a row number."""
    t, g, s, lines, one = (
        F.col("periods"), F.col("n_gen"), F.col("n_ess"), F.col("n_line"), F.lit(1).cast("bigint")
    )
    # Family, side and equation labels in row order.
    table = [
        ("A1", "power_balance", "equality", "1", F.lit(0), one, t, 0, False),
        ("A1", "storage_terminal_energy", "equality", "9", t, s, one, 0, True),
        ("A2", "line_flow", "lower", "2", F.col("r_line_lower"), lines, t, 0, False),
        ("A2", "line_flow", "upper", "2", F.col("r_line_upper"), lines, t, 0, False),
        ("A2", "reserve_headroom", "upper", "4", F.col("r_headroom"), g, t, 0, False),
        ("A2", "reserve_footroom", "lower", "4", F.col("r_footroom"), g, t, 0, False),
        ("A2", "reserve_requirement", "up", "5", F.col("r_reserve_up"), one, t, 0, False),
        ("A2", "reserve_requirement", "down", "5", F.col("r_reserve_down"), one, t, 0, False),
        ("A2", "generator_ramp", "down", "6", F.col("r_ramp_down"), g, t - 1, 1, False),
        ("A2", "generator_ramp", "up", "6", F.col("r_ramp_up"), g, t - 1, 1, False),
        ("A2", "storage_energy", "lower", "8", F.col("r_energy_lower"), s, t, 0, False),
        ("A2", "storage_energy", "upper", "8", F.col("r_energy_upper"), s, t, 0, False),
    ]
    runs = F.array(
        *[
            F.struct(
                F.lit(block).alias("block"),
                F.lit(family).alias("family"),
                F.lit(side).alias("side"),
                F.lit(equation).alias("equation"),
                start.cast("bigint").alias("start"),
                elements.cast("bigint").alias("elements"),
                periods.cast("bigint").alias("period_count"),
                F.lit(shift).cast("bigint").alias("period_offset"),
                F.lit(no_period).alias("no_period"),
            )
            for block, family, side, equation, start, elements, periods, shift, no_period in table
        ]
    )
    found = dims.select("case_id", F.explode(runs).alias("f")).select("case_id", "f.*")
    size = F.col("elements") * F.col("period_count")
    return found.where(size > 0).withColumn("stop", F.col("start") + size)


def _read_row(local: Column) -> list[Column]:
    period = F.when(
        ~F.col("no_period"), F.col("period_offset") + idiv(local, "elements")
    )
    return [period.alias("period"), (local % F.col("elements")).alias("element")]


def expand_row_families(families: DataFrame) -> DataFrame:
    """One record per constraint row."""
    rows = spread_sequence(
        families, F.col("stop") - F.col("start"), "_i", ["case_id", "block", "start"]
    )
    return rows.select(
        "case_id",
        "block",
        (F.col("start") + F.col("_i")).alias("row"),
        "family",
        "side",
        "equation",
        *_read_row(F.col("_i")),
    )


def lookup_row_family(rows: DataFrame, families: DataFrame, chunk: int = BLOCK) -> DataFrame:
    """Family, period and element of given row numbers.

    The range condition is made an equality on (case, block, row div chunk) first, so a
    row meets only the runs that touch its chunk.
    """
    spans = families.withColumn(
        "_chunk",
        F.explode(
            F.sequence(
                idiv(F.col("start"), F.lit(chunk)), idiv(F.col("stop") - 1, F.lit(chunk))
            )
        ),
    )
    keyed = rows.withColumn("_chunk", idiv(F.col("row"), F.lit(chunk)))
    joined = keyed.join(spans, ["case_id", "block", "_chunk"]).where(
        (F.col("row") >= F.col("start")) & (F.col("row") < F.col("stop"))
    )
    return joined.select(
        *rows.columns, "family", "side", "equation", *_read_row(F.col("row") - F.col("start"))
    )


def expected_dimensions(spec: DataFrame) -> DataFrame:
    """n, m1, m2 and m from the counts of ``spec`` and its horizon ``periods``."""
    t, g, r, s, b = (
        F.col(c).cast("bigint") for c in ("periods", "generators", "renewables", "storage", "branches")
    )
    n = t * (3 * g + r + 2 * s)
    m1 = t + s
    m2 = 2 * t * b + 2 * t * g + 2 * t + 2 * (t - 1) * g + 2 * t * s
    return spec.select(
        "*", n.alias("n"), m1.alias("m1"), m2.alias("m2"), (m1 + m2).alias("m")
    )


def dimension_summary(
    bus: DataFrame, gen: DataFrame, branch: DataFrame, a: DataFrame, dims: DataFrame
) -> DataFrame:
    """Counts of the model's tables and entries per case."""
    limited = F.col("status") & (F.col("rate_mw") > 0) & (F.col("rate_mw") < 1e10)
    parts = [
        bus.groupBy("case_id").agg(F.count("*").alias("buses")),
        gen.groupBy("case_id").agg(F.count("*").alias("generators")),
        branch.groupBy("case_id").agg(
            count_if(F.col("status")).alias("active_branches"),
            count_if(limited).alias("limited_branches"),
        ),
        a.groupBy("case_id").agg(
            count_if(F.col("block") == "A1").alias("nnz_a1"),
            count_if(F.col("block") == "A2").alias("nnz_a2"),
        ),
    ]
    result = dims.select("case_id", "periods", "n_rg", "n_ess", "n", "m1", "m2", "m")
    for part in parts:
        result = result.join(part, "case_id", "left")
    return result


def unpack_state(state_col: DataFrame, dims: DataFrame) -> DataFrame:
    """The vector as dispatch: one row per device and period, one column per kind."""
    keyed = variable_key(state_col.select("case_id", "col", "x"), dims)
    device = F.lit("gen")
    for kind in KINDS:
        device = F.when(F.col("kind") == kind, F.lit(DEVICE_OF[COUNT_OF[kind]])).otherwise(device)
    return keyed.groupBy("case_id", device.alias("device"), "pos", "period").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("x"))).alias(k) for k in KINDS]
    )


def bus_injections(load: DataFrame, supply: list[tuple[DataFrame, str, float]]) -> DataFrame:
    """Net injection per bus and period: signed terms in one aggregation.

    ``supply`` lists ``(table, value column, sign)`` with ``case_id, bus_id, period``.
    """
    keys = ["case_id", "bus_id", "period"]
    terms = load.select(*keys, (-F.col("mw")).alias("mw"))
    for df, value, sign in supply:
        terms = terms.unionByName(df.select(*keys, (F.lit(sign) * F.col(value)).alias("mw")))
    return terms.groupBy(*keys).agg(F.sum("mw").alias("mw"))


def period_results(values: DataFrame, chunk: int = 1024) -> DataFrame:
    """Arrays of values per period and kind in position order.

    ``values(case_id, period, kind, pos, value)``; an array holds one chunk of positions,
    so no array grows with the number of devices.
    """
    part = idiv(F.col("pos"), F.lit(chunk)).alias("chunk")
    packed = values.groupBy("case_id", "period", "kind", part).agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_v")
    )
    return packed.select(
        "case_id", "period", "kind", "chunk", F.transform("_v", lambda v: v["value"]).alias("values")
    )
