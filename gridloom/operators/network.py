"""Grid graph, angle solves and shift factors, many cases and right-hand sides at once."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS
from ..session import beside, release, settle, unfolded
from .blocks import settled_answers
from .derive import effective_tap
from .multilevel import Hierarchy, build_hierarchy, multiplied, prolonged, restricted

RHS = ["case_id", "rhs"]
SHIFT_RUN = -1
#: Buses of the largest block that a task solves: a dense matrix of 32 MB.
DIRECT = 2000
#: A residual within so many units of rounding of the terms it was summed from is rounding alone.
ROUNDING = 4 * EPS
# columns that repeat one value per right-hand side in all of its rows
RIDERS = ("gamma", "alpha", "start")


def branch_susceptance(branch: DataFrame, base_mva: float | DataFrame = 100.0) -> DataFrame:
    """Active branches with susceptance in MW, shift in radians and the shift's own flow.

    ``base_mva`` is a number or ``(case_id, base_mva)``.
    """
    tapped = effective_tap(branch.where(F.col("status")))
    if isinstance(base_mva, DataFrame):
        tapped = tapped.join(base_mva.select("case_id", "base_mva"), "case_id")
    else:
        tapped = tapped.withColumn("base_mva", F.lit(float(base_mva)))
    b = F.col("base_mva") / (F.col("reactance") * F.col("effective_tap"))
    shift = F.radians("shift_degrees")
    return tapped.select(
        "case_id",
        "branch_id",
        "from_bus",
        "to_bus",
        b.alias("b_mw"),
        shift.alias("shift_rad"),
        (-b * shift).alias("shift_mw"),
    )


def incidence(edge: DataFrame) -> DataFrame:
    """One row per branch end: +1 at the from bus, -1 at the to bus."""
    ends = F.array(
        F.struct(F.col("from_bus").alias("bus_id"), F.lit(1.0).alias("sign")),
        F.struct(F.col("to_bus").alias("bus_id"), F.lit(-1.0).alias("sign")),
    )
    return edge.select("*", F.explode(ends).alias("e")).select(*edge.columns, "e.*")


def bus_susceptance(edge: DataFrame, ref: DataFrame | None = None) -> DataFrame:
    """``(case_id, i, j, value)``; with ``ref(case_id, ref_bus)`` that row and column go."""
    f, t, b = F.col("from_bus"), F.col("to_bus"), F.col("b_mw")
    stamps = F.array(
        F.struct(f.alias("i"), f.alias("j"), b.alias("value")),
        F.struct(t.alias("i"), t.alias("j"), b.alias("value")),
        F.struct(f.alias("i"), t.alias("j"), (-b).alias("value")),
        F.struct(t.alias("i"), f.alias("j"), (-b).alias("value")),
    )
    cells = edge.select("case_id", F.explode(stamps).alias("s")).select("case_id", "s.*")
    matrix = cells.groupBy("case_id", "i", "j").agg(F.sum("value").alias("value"))
    if ref is None:
        return matrix
    keep = matrix.join(ref, "case_id").where(
        (F.col("i") != F.col("ref_bus")) & (F.col("j") != F.col("ref_bus"))
    )
    return keep.select("case_id", "i", "j", "value")


def phase_shift_terms(edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flow caused by a shift on its own branch, and the injections it stands for."""
    branch_shift = edge.select("case_id", "branch_id", F.col("shift_mw").alias("mw"))
    bus_shift = (
        incidence(edge)
        .groupBy("case_id", "bus_id")
        .agg(F.sum(F.col("sign") * F.col("shift_mw")).alias("mw"))
    )
    return branch_shift, bus_shift


def connected_components(bus: DataFrame, branch: DataFrame) -> DataFrame:
    """``(case_id, bus_id, label)``: the smallest bus of each island of active branches.

    Alternating star contraction: a step links the larger neighbours of a bus to its smallest
    one, the next one all its smaller neighbours.  Each leaves the islands as they are, and
    rounds, whose number grows with the logarithm of an island's size, end when nothing changes.
    """
    joined = branch.where(F.col("status")).select(
        "case_id",
        F.greatest("from_bus", "to_bus").alias("u"),
        F.least("from_bus", "to_bus").alias("v"),
    )
    found = settle(contracted(joined))
    listed = bus.select("case_id", "bus_id").join(
        found.select("case_id", F.col("u").alias("bus_id"), F.col("v").alias("_to")),
        ["case_id", "bus_id"],
        "left",
    )
    return listed.select("case_id", "bus_id", F.coalesce("_to", "bus_id").alias("label"))


def contracted(pairs: DataFrame) -> DataFrame:
    """``(case_id, u, v)``: every node u of a link with the smallest node v of its island, v < u."""
    node = ["case_id", "u"]
    edges = settle(pairs.where("u > v").distinct())
    while True:
        both = edges.unionByName(
            edges.select("case_id", F.col("v").alias("u"), F.col("u").alias("v"))
        )
        low = both.groupBy(*node).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, node).where("v > u")
        large = settle(large.select("case_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy(*node).agg(F.min("v").alias("m"))
        small = large.join(low, node).select("case_id", F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select(*node, F.col("m").alias("v"))).where("u > v")
        following = settle(small.distinct())
        # both are sets: they are equal if neither has a row that the other lacks
        state = [F.count("*"), F.bit_xor(F.xxhash64("case_id", "u", "v"))]
        same = following.agg(*state).first() == edges.agg(*state).first()
        release(edges, large)
        edges = following
        if same:
            return edges


def component_counts(labels: DataFrame) -> DataFrame:
    """Islands per case; the linear model needs exactly one."""
    return labels.groupBy("case_id").agg(
        F.sum(F.when(F.col("bus_id") == F.col("label"), 1).otherwise(0)).alias("components")
    ).withColumn("connected", F.col("components") == 1)


def balance_check(injection: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Sum of the injections per case and period against the tolerance."""
    sums = injection.groupBy("case_id", "period").agg(
        F.sum("mw").alias("total"), F.sum(F.abs("mw")).alias("l1")
    )
    limit = F.lit(tolerance) * (1 + F.col("l1"))
    return sums.withColumn("limit", limit).withColumn("balanced", F.abs("total") <= F.col("limit"))


class Solved(NamedTuple):
    angle: DataFrame
    flow: DataFrame
    report: DataFrame
    rounds: int


def solve_angles(
    edge: DataFrame,
    ref: DataFrame,
    injection: DataFrame,
    with_shift: bool = True,
    tol: float = 1e-11,
    patience: int = 50,
    check_every: int = 4,
    degree: int = 2,
    direct: int = DIRECT,
    prepared: list[Hierarchy] | None = None,
) -> Solved:
    """Bus angles and branch flows for every ``rhs`` of every case.

    ``injection(case_id, rhs, bus_id, mw)`` with ``rhs`` >= 0; with phase shifts it lists
    every bus, zeros included.  All cases are solved by elimination in blocks of at most ``direct``
    buses (``blocks``), and every answer is put into the whole matrix.  A case with an answer whose
    relative residual is above ``tol`` and above the rounding of its own terms, which no angles of
    64 bits undercut, or that cannot be cut into such blocks, is solved by
    iteration (``_iterated``), with all of its right-hand sides; ``direct`` = 0 leaves all cases
    to it.  ``prepared`` keeps its hierarchy for a caller that solves several times: the first
    call in need adds it.  ``report`` gives the last relative residual, ``rounds`` the iterations.
    """
    matrix = settle(bus_susceptance(edge, ref))
    needed = injection.select(*RHS, "bus_id", "mw")
    if with_shift:
        # the shifts of a case are one more right-hand side, added to the others at the end
        shifts = phase_shift_terms(edge)[1]
        own = F.lit(SHIFT_RUN).cast("bigint").alias("rhs")
        needed = needed.unionByName(
            shifts.select("case_id", own, "bus_id", (-F.col("mw")).alias("mw"))
        )
    needed = settle(needed.groupBy(*RHS, "bus_id").agg(F.sum("mw").alias("mw")))
    parts, iteration, made = [], 0, [matrix, needed]
    if direct:
        angle, report = _eliminated(matrix, needed, tol, direct)
        made += [angle, report]
        solved = settle(report.groupBy("case_id").agg(F.min("converged").alias("_all")).where("_all"))
        made.append(solved)
        mine = lambda df: df.join(solved.select("case_id"), "case_id", "left_semi")
        parts.append((mine(angle), mine(report)))
        needed = needed.join(solved, "case_id", "left_anti")
    left = matrix.join(needed.select("case_id").distinct(), "case_id", "left_semi")
    if not left.isEmpty() or not parts:
        kept = prepared if prepared is not None else []
        if not kept:
            kept.append(build_hierarchy(left if prepared is None else matrix))
        angle, report, iteration = _iterated(kept[0], needed, tol, patience, check_every, degree)
        made += [angle, report, *([] if prepared is not None else kept[0])]
        parts.append((angle, report))
    angle, report = parts[0] if len(parts) == 1 else [a.unionByName(b) for a, b in zip(*parts)]
    angle = settle(_add_shift_angles(angle) if with_shift else angle)
    report = settle(report)
    release(*made)
    return Solved(angle, branch_flows(edge, angle, with_shift), report, iteration)


def _eliminated(matrix: DataFrame, needed: DataFrame, tol: float, limit: int) -> tuple[DataFrame, DataFrame]:
    """Settled angles by elimination, and the report; cases that cannot be cut into blocks have
    unanswered right-hand sides in it."""
    # as in the hierarchy, rows are scaled by half their absolute sums and rows of zeros are none
    scale = matrix.groupBy("case_id", "i").agg((F.sum(F.abs("value")) / 2).alias("half"))
    scale = settle(scale.where("half > 0"))
    real = scale.select("case_id", "i")
    cells = matrix.join(real, ["case_id", "i"], "left_semi")
    cells = settle(cells.join(real.withColumnRenamed("i", "j"), ["case_id", "j"], "left_semi"))
    asked = needed.select(*RHS, F.col("bus_id").alias("i"), "mw").join(real, ["case_id", "i"], "left_semi")
    asked = settle(asked)
    answer = settled_answers(cells, asked, limit)
    product = cells.join(answer.withColumnRenamed("i", "j"), ["case_id", "j"]).select(
        *RHS, "i", F.lit(0.0).alias("mw"), (-F.col("value") * F.col("x")).alias("r")
    )
    terms = asked.select(*RHS, "i", "mw", F.col("mw").alias("r")).unionByName(product)
    # a sum leaves null terms out: they make the residual unknown
    left = terms.groupBy(*RHS, "i").agg(
        F.sum("mw").alias("mw"),
        F.sum("r").alias("r"),
        F.sum(F.abs("r")).alias("size"),
        F.max(F.col("r").isNull()).alias("_unknown"),
    )
    left = left.join(scale, ["case_id", "i"]).groupBy(*RHS).agg(
        F.sum(F.col("r") ** 2 / F.col("half")).alias("residual"),
        F.sum(F.col("mw") ** 2 / F.col("half")).alias("start"),
        F.sum(F.col("size") ** 2 / F.col("half")).alias("size"),
        F.max("_unknown").alias("_unknown"),
    )
    answered = answer.select(*RHS).distinct().withColumn("_answered", F.lit(True))
    left = left.join(answered, RHS, "left")
    small = F.col("residual") <= F.greatest(F.lit(tol**2) * F.col("start"), F.lit(ROUNDING**2) * F.col("size"))
    done = F.col("_answered") & ~F.col("_unknown") & small
    report = left.select(
        *RHS,
        F.when(F.col("start") > 0, F.sqrt(F.col("residual") / F.col("start")))
        .otherwise(0.0)
        .alias("relative_residual"),
        F.coalesce(done, F.lit(False)).alias("converged"),
    )
    report = settle(report)
    angle = settle(answer.select(*RHS, F.col("i").alias("bus_id"), F.col("x").alias("angle")))
    release(scale, cells, asked, answer)
    return angle, report


def _iterated(
    grid: Hierarchy, needed: DataFrame, tol: float, patience: int, check_every: int, degree: int
) -> tuple[DataFrame, DataFrame, int]:
    """Angles, report and iterations of conjugate gradients, preconditioned by ``grid``, a hierarchy of
    coarser grids (``multilevel``), so that the rounds hardly grow with a grid.

    All right-hand sides advance together.  The rearrangement that needs one set of dot products
    per iteration keeps an iteration at one written table, and convergence is looked up every
    ``check_every`` iterations.  A higher ``degree`` trades products inside a job for fewer jobs.
    There is no limit of rounds: a right-hand side whose residual has not fallen to a new low in
    ``patience`` looks stops the job with an error that names it, so no flow of an unsolved one is
    returned.
    """
    diagonal = grid.root
    zero, unset = F.lit(0.0), F.lit(None).cast("double")
    state = (
        needed.join(diagonal, ["case_id", "bus_id"])
        .select(
            *RHS,
            "bus_id",
            zero.alias("x"),
            (F.col("mw") / F.col("root")).alias("r"),
            zero.alias("p"),
            zero.alias("s"),
            *[unset.alias(n) for n in RIDERS],
        )
    )
    state = settle(state)
    last = state
    lowest, waited, iteration = float("inf"), 0, 0
    while True:
        iteration += 1
        table = settle(_preconditioned(state, grid, degree))
        release(last)
        last = table
        scalars = _step_lengths(table, tol)
        if iteration % check_every == 0:
            worst = F.max(F.sqrt(F.col("residual") / F.col("start")))
            open_ = scalars.where(~F.coalesce("done", F.lit(False)))
            left, size = open_.agg(F.count("*"), worst).first()
            if not left:
                break
            waited = 0 if size is not None and size < lowest else waited + 1
            lowest = min(lowest, size) if size is not None and size == size else lowest
            if waited >= patience or size is None or size != size:
                names = [tuple(r) for r in open_.select(*RHS).orderBy(*RHS).limit(10).collect()]
                raise RuntimeError(f"{left} right-hand sides do not converge, first (case, rhs): {names}")
        stepped = table.drop(*RIDERS).join(scalars, RHS)
        p = F.col("u") + F.col("beta") * F.col("p")
        s = F.col("w") + F.col("beta") * F.col("s")
        a = F.col("alpha")
        state = stepped.select(
            *RHS,
            "bus_id",
            (F.col("x") + a * p).alias("x"),
            (F.col("r") - a * s).alias("r"),
            p.alias("p"),
            s.alias("s"),
            *RIDERS,
        )
    angle = table.join(diagonal, ["case_id", "bus_id"]).select(
        *RHS, "bus_id", (F.col("x") / F.col("root")).alias("angle")
    )
    report = _step_lengths(table, tol).select(
        *RHS,
        F.when(F.col("start") > 0, F.sqrt(F.col("residual") / F.col("start")))
        .otherwise(0.0)
        .alias("relative_residual"),
        F.col("done").alias("converged"),
    )
    angle, report = settle(angle), settle(report)
    release(table)
    return angle, report, iteration


def _add_shift_angles(angle: DataFrame) -> DataFrame:
    """Superpose the answer of the shift run on the other runs."""
    shift = angle.where(F.col("rhs") == SHIFT_RUN).select(
        "case_id", "bus_id", F.col("angle").alias("_shift")
    )
    runs = angle.where(F.col("rhs") != SHIFT_RUN)
    return runs.join(shift, ["case_id", "bus_id"], "left").select(
        *RHS, "bus_id", (F.col("angle") + F.coalesce("_shift", F.lit(0.0))).alias("angle")
    )


def _preconditioned(state: DataFrame, grid: Hierarchy, degree: int) -> DataFrame:
    """Add ``u``, the sum of all levels' answers for ``r``, and ``w``, the matrix times ``u``.

    A level answers with a Chebyshev polynomial.  The scaled matrices have their spectrum in
    (0, 2], so the polynomial stays positive whatever the smallest eigenvalue is.  All products
    of an iteration are stages of one job; only its result is written.
    """
    low, high = 0.1, 2.0
    centre, half = (high + low) / 2, (high - low) / 2
    sigma = centre / half
    rho = 1 / sigma
    state = restricted(state, grid.down, RHS, RIDERS)
    state = state.withColumns({"d": F.col("r") / centre, "u": F.col("r") / centre})
    for _ in range(degree):
        following = 1 / (2 * sigma - rho)
        state = multiplied(state, grid.cells, "u", "w", RHS, RIDERS)
        step = F.lit(following * rho) * F.col("d") + F.lit(2 * following / half) * (
            F.col("r") - F.col("w")
        )
        state = state.withColumns({"d": step, "u": F.col("u") + step}).drop("w")
        rho = following
    # coarse residuals have done their work: only those of the buses go on
    mine = F.when(F.col("level") == 0, F.col("r")).otherwise(0.0)
    return prolonged(state.drop("d").withColumn("r", mine), grid.up, RHS, RIDERS)


def _step_lengths(table: DataFrame, tol: float) -> DataFrame:
    """Step lengths per right-hand side; a converged one keeps a zero step.

    The last step's ``gamma`` and ``alpha`` ride along in the state's rows, so an
    iteration needs no second table.
    """
    dots = table.groupBy(*RHS).agg(
        F.sum(F.col("r") * F.col("u")).alias("_g"),
        F.sum(F.col("w") * F.col("u")).alias("_d"),
        F.sum(F.col("r") ** 2).alias("_rr"),
        F.max("gamma").alias("gamma"),
        F.max("alpha").alias("alpha"),
        F.max("start").alias("start"),
    )
    start = F.coalesce("start", "_rr")
    beta = F.when(F.col("gamma") > 0, F.col("_g") / F.col("gamma")).otherwise(0.0)
    correction = F.when(F.col("alpha") != 0, beta * F.col("_g") / F.col("alpha")).otherwise(0.0)
    denominator = F.col("_d") - correction
    done = F.col("_rr") <= F.lit(tol * tol) * start
    safe = ~done & (denominator > 0)
    return dots.select(
        *RHS,
        F.col("_g").alias("gamma"),
        F.when(safe, F.col("_g") / denominator).otherwise(0.0).alias("alpha"),
        F.when(safe, beta).otherwise(0.0).alias("beta"),
        start.alias("start"),
        F.col("_rr").alias("residual"),
        done.alias("done"),
    )


def branch_flows(edge: DataFrame, angle: DataFrame, with_shift: bool = True) -> DataFrame:
    """Susceptance times the angle difference (plus the shift's flow) per branch.

    The reference bus has angle zero and needs no row.
    """
    ends = incidence(edge)
    terms = ends.join(angle, ["case_id", "bus_id"]).select(
        *RHS, "branch_id", (F.col("sign") * F.col("b_mw") * F.col("angle")).alias("mw")
    )
    flows = terms.groupBy(*RHS, "branch_id").agg(F.sum("mw").alias("mw"))
    if not with_shift:
        return flows
    shifts = edge.select("case_id", "branch_id", "shift_mw")
    return flows.join(shifts, ["case_id", "branch_id"]).select(
        *RHS, "branch_id", (F.col("mw") + F.col("shift_mw")).alias("mw")
    )


def shift_factor_columns(
    edge: DataFrame, ref: DataFrame, buses: DataFrame, batch: int = 128, tol: float = 1e-11
) -> DataFrame:
    """``ptdf(case_id, branch_id, bus_id, value)`` for the listed buses only.

    A column is the flow of one unit from its bus to the reference.  Columns are solved
    in batches of about ``batch`` per case, which bounds the state of one run.
    """
    wanted = settle(buses.select("case_id", "bus_id").distinct())
    largest = wanted.groupBy("case_id").count().agg(F.max("count")).first()[0] or 0
    batches = max(1, math.ceil(largest / batch))
    grid: list[Hierarchy] = []
    result = None
    for number in range(batches):
        mine = wanted.where(F.pmod(F.xxhash64("bus_id"), F.lit(batches)) == number)
        unit = mine.select("case_id", F.col("bus_id").alias("rhs"), "bus_id", F.lit(1.0).alias("mw"))
        flow = settle(solve_angles(edge, ref, unit, with_shift=False, tol=tol, prepared=grid).flow)
        part = flow.select(
            "case_id", "branch_id", F.col("rhs").alias("bus_id"), F.col("mw").alias("value")
        )
        result = part if result is None else result.unionByName(part)
    release(*(table for kept in grid for table in kept))
    return result


def shift_vector(edge: DataFrame, ref: DataFrame, vector: DataFrame) -> DataFrame:
    """Shift factors times one bus vector ``(case_id, bus_id, mw)``, without the factors."""
    one = vector.select("case_id", F.lit(0).cast("bigint").alias("rhs"), "bus_id", "mw")
    flow = solve_angles(edge, ref, one, with_shift=False).flow
    return flow.select("case_id", "branch_id", "mw")


def flow_offset(edge: DataFrame, ref: DataFrame) -> DataFrame:
    """Branch flows that the phase shifts cause with no injection at all."""
    _, bus_shift = phase_shift_terms(edge)
    answer = shift_vector(edge, ref, bus_shift.withColumn("mw", -F.col("mw")))
    own = edge.select("case_id", "branch_id", F.col("shift_mw").alias("mw"))
    return own.unionByName(answer).groupBy("case_id", "branch_id").agg(F.sum("mw").alias("mw"))


def compress_ptdf(ptdf: DataFrame, placement: DataFrame, atol: float = 1e-12) -> DataFrame:
    """Factors of the buses that carry a device, mapped to the devices, tiny ones dropped."""
    buses = placement.select("case_id", "bus_id").distinct()
    kept = ptdf.where(F.abs("value") > atol).join(buses, ["case_id", "bus_id"], "left_semi")
    return kept.join(placement, ["case_id", "bus_id"])


def flows_from_injections(ptdf: DataFrame, injection: DataFrame, offset: DataFrame) -> DataFrame:
    """``M injection + offset`` per branch and period.

    The offset enters once per (branch, period) as a term of the same aggregation.  The injections
    are settled, so that they are what a join repeats: the factors have a row per branch and bus.
    """
    keys = ["case_id", "branch_id", "period"]
    known = beside(settle(injection.select("case_id", "bus_id", "period", "mw")))
    terms = unfolded(ptdf).join(known, ["case_id", "bus_id"]).select(
        *keys, (F.col("value") * F.col("mw")).alias("mw")
    )
    flows = terms.groupBy(*keys).agg(F.sum("mw").alias("_mw"))
    moved = flows.join(
        offset.select("case_id", "branch_id", F.col("mw").alias("_o")), ["case_id", "branch_id"], "left"
    )
    return moved.select(*keys, (F.col("_mw") + F.coalesce("_o", F.lit(0.0))).alias("mw"))


def fixed_flow(offset: DataFrame, load_shift: DataFrame, profile: DataFrame) -> DataFrame:
    """``offset - multiplier[t] * load shift`` per branch and period."""
    keys = ["case_id", "branch_id"]
    base = (
        offset.select(*keys, F.col("mw").alias("o"), F.lit(0.0).alias("s"))
        .unionByName(load_shift.select(*keys, F.lit(0.0).alias("o"), F.col("mw").alias("s")))
        .groupBy(*keys)
        .agg(F.sum("o").alias("o"), F.sum("s").alias("s"))
    )
    horizon = profile.groupBy("case_id").agg((F.max("period") + 1).alias("periods"))
    long = base.join(horizon, "case_id").withColumn(
        "period", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("periods") - 1))
    )
    return long.join(
        beside(settle(profile.select("case_id", "period", "multiplier"))), ["case_id", "period"]
    ).select(*keys, "period", (F.col("o") - F.col("multiplier") * F.col("s")).alias("mw"))


def box_by_bus(placement: DataFrame, box: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Devices of a bus as one of kind ``bus``: its placement and its box, with the ``terms`` in it.

    All devices of a bus have its factor, so their part of a branch's bound is the factor times the
    sum of their boxes: a row per branch and bus instead of one per branch and device.
    """
    joined = placement.select("case_id", "device", "pos", "bus_id").join(box, ["case_id", "device", "pos"])
    sums = joined.groupBy("case_id", "bus_id").agg(
        F.sum("max_abs").alias("max_abs"), F.count("*").alias("terms")
    )
    one = sums.select(
        "case_id", "bus_id", F.lit("bus").alias("device"), F.col("bus_id").alias("pos"), "max_abs", "terms"
    )
    return one.select("case_id", "device", "pos", "bus_id"), one.drop("bus_id")


def derived_line_limit(
    branch: DataFrame, ptdf_devices: DataFrame, flow: DataFrame, box: DataFrame
) -> DataFrame:
    """A limit that cannot bind for branches without one; positive rates stay.

    The bound is the sum of all absolute terms over the box: fixed flows of every period
    and factor times the largest device output.  ``box(case_id, device, pos, max_abs)``
    holds twice the power for storage, and ``terms`` if an entry stands for several devices
    (``box_by_bus``).  k rounded non-negative terms err by less than
    (k + 1) 2^-53 in relative size, so the factor below rounds outward.
    """
    keys = ["case_id", "branch_id"]
    zero = branch.where(F.col("rate_mw") == 0).select(*keys)
    one = F.lit(1).cast("bigint")
    held = F.col("terms") if "terms" in box.columns else one
    device = ptdf_devices.join(zero, keys, "left_semi").join(box, ["case_id", "device", "pos"])
    terms = device.select(*keys, (F.abs("value") * F.col("max_abs")).alias("v"), held.alias("k")).unionByName(
        unfolded(flow.select(*keys, "mw")).join(zero, keys, "left_semi").select(*keys, F.abs("mw").alias("v"), one.alias("k"))
    )
    bound = terms.groupBy(*keys).agg(F.sum("v").alias("_sum"), F.sum("k").alias("_k"))
    outward = F.col("_sum") * (1 + (F.col("_k") + 2) * F.lit(2.0**-52))
    joined = branch.select(*keys, "rate_mw").join(
        bound.select(*keys, outward.alias("bound")), keys, "left"
    )
    limit = F.when(
        F.col("rate_mw") == 0, F.coalesce("bound", F.lit(0.0)) * (1 + 2.0**-51) + F.lit(2.0**-1022)
    ).otherwise(F.col("rate_mw"))
    return joined.select(*keys, limit.alias("limit_mw"), "bound")


def ptdf_probe(ptdf: DataFrame, edge: DataFrame, ref: DataFrame, buses: DataFrame) -> DataFrame:
    """Largest difference between a factor column and the flow of the unit transfer."""
    unit = buses.select("case_id", F.col("bus_id").alias("rhs"), "bus_id", F.lit(1.0).alias("mw"))
    solved = solve_angles(edge, ref, unit, with_shift=False).flow
    keys = ["case_id", "branch_id", "rhs"]
    pair = ptdf.select("case_id", "branch_id", F.col("bus_id").alias("rhs"), "value").join(
        solved, keys, "full_outer"
    )
    gap = F.abs(F.coalesce("value", F.lit(0.0)) - F.coalesce("mw", F.lit(0.0)))
    return pair.groupBy("case_id", F.col("rhs").alias("bus_id")).agg(F.max(gap).alias("max_diff"))
