"""Grid graph and shift-factor queries over the customer network (25 cases)."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import network as n
from ..operators import trees
from ..session import settle
from .bindings import BINDING_SQL
from .registry import ORACLES, QUERIES, query, r

EDGE = """edge AS (SELECT *, 100 / (reactance * CASE WHEN tap = 0 THEN 1 ELSE tap END) AS b,
    radians(shift_degrees) AS sh FROM b_net_branch WHERE status)"""
NET = "b_net_branch b_net_bus"


def edges(t):
    return n.branch_susceptance(t.net_branch())


def ref(t):
    return t.net_bus().where(F.col("bus_type") == 3).select("case_id", F.col("bus_id").alias("ref_bus"))


@query(
    "branch_susceptance",
    f"""WITH {EDGE} SELECT case_id, branch_id, from_bus, to_bus, {r('b')} AS b_mw, {r('sh', 9)} AS shift_rad,
        {r('-b * sh')} AS shift_mw FROM edge""",
    NET,
)
def _(t):
    return edges(t).select(
        "case_id", "branch_id", "from_bus", "to_bus", rounded("b_mw").alias("b_mw"),
        rounded("shift_rad", 9).alias("shift_rad"), rounded("shift_mw").alias("shift_mw"),
    )


@query(
    "bus_susceptance",
    f"""WITH {EDGE}, st AS (SELECT case_id, unnest([from_bus, to_bus, from_bus, to_bus]) AS i,
          unnest([from_bus, to_bus, to_bus, from_bus]) AS j, unnest([b, b, -b, -b]) AS value FROM edge)
        SELECT case_id, i, j, {r('sum(value)')} AS value FROM st WHERE i >= 25 AND j >= 25 GROUP BY ALL""",
    NET,
)
def _(t):
    return n.bus_susceptance(edges(t), ref(t)).withColumn("value", rounded("value"))


@query(
    "phase_shift_terms",
    f"""WITH {EDGE}, e2 AS (SELECT case_id, unnest([from_bus, to_bus]) AS bus_id,
          unnest([-b * sh, b * sh]) AS mw FROM edge)
        SELECT case_id, 'bus' AS element, bus_id AS id, {r('sum(mw)')} AS mw FROM e2 GROUP BY ALL
        UNION ALL SELECT case_id, 'branch', branch_id, {r('-b * sh')} FROM edge""",
    NET,
)
def _(t):
    branch, bus = n.phase_shift_terms(edges(t))
    return bus.select(
        "case_id", F.lit("bus").alias("element"), F.col("bus_id").alias("id"), rounded("mw").alias("mw")
    ).unionByName(
        branch.select(
            "case_id", F.lit("branch").alias("element"), F.col("branch_id").alias("id"), rounded("mw").alias("mw")
        )
    )


@query("connected_components")
def _(t):
    cut = t.net_branch().withColumn(
        "status", F.col("status") & (F.col("branch_id") * 7919 % 10 < 4)
    )
    return n.connected_components(t.net_bus(), cut)


ORACLES["connected_components"] = f"""WITH RECURSIVE b_net_branch AS ({BINDING_SQL['b_net_branch']}),
  e AS (SELECT case_id, unnest([from_bus, to_bus]) AS u, unnest([to_bus, from_bus]) AS v
        FROM b_net_branch WHERE status AND branch_id * 7919 % 10 < 4),
  reach(case_id, bus_id, other) AS (SELECT c_custkey % 25, c_custkey, c_custkey FROM customer
    UNION SELECT reach.case_id, reach.bus_id, e.v FROM reach
      JOIN e ON e.case_id = reach.case_id AND e.u = reach.other)
  SELECT case_id, bus_id, min(other) AS label FROM reach GROUP BY ALL"""
assert "connected_components" in QUERIES


@query(
    "component_counts",
    "SELECT c_custkey % 25 AS case_id, 1::BIGINT AS components, true AS connected FROM customer GROUP BY 1",
)
def _(t):
    return n.component_counts(n.connected_components(t.net_bus(), t.net_branch()))


@query(
    "balance_check",
    f"""WITH m AS (SELECT l_suppkey % 5 AS case_id, (l_orderkey % 12)::BIGINT AS period,
          CASE WHEN l_orderkey % 12 = 5 THEN 1 WHEN l_returnflag = 'A' THEN -1 ELSE 1 END * l_quantity AS mw FROM lineitem),
        s AS (SELECT case_id, period, sum(mw) AS total, sum(abs(mw)) AS l1 FROM m GROUP BY ALL)
        SELECT case_id, period, total, l1, {r('1e-10 * (1 + l1)', 14)} AS "limit",
          abs(total) <= 1e-10 * (1 + l1) AS balanced FROM s""",
)
def _(t):
    period = F.col("l_orderkey") % 12
    sign = F.when(period == 5, 1).when(F.col("l_returnflag") == "A", -1).otherwise(1)
    inj = t.read("lineitem").select(
        (F.col("l_suppkey") % 5).alias("case_id"), period.alias("period"),
        (sign * F.col("l_quantity")).alias("mw"),
    )
    return n.balance_check(inj).withColumn("limit", rounded("limit", 14))


def injection(t):
    """Two scenarios per case: the demand, and the demand shifted by the bus number."""
    bus = t.net_bus().where(F.col("bus_type") != 3)
    two = bus.withColumn("rhs", F.explode(F.expr("array(0L, 1L)")))
    return two.select(
        "case_id", "rhs", "bus_id",
        (F.col("demand_mw") + F.col("rhs") * (F.col("bus_id") % 50)).alias("mw"),
    )


@query(
    "solve_angles",
    """SELECT case_id, rhs, bus_id, demand_mw + rhs * (bus_id % 50) AS net_mw
       FROM b_net_bus, range(2) AS k(rhs) WHERE bus_type <> 3""",
    NET,
)
def _(t):
    """The solved flows leaving a bus must give back its injection."""
    edge = settle(edges(t))
    flow = n.solve_angles(edge, ref(t), injection(t)).flow
    leaving = n.incidence(edge).join(flow, ["case_id", "branch_id"])
    net = leaving.groupBy("case_id", "rhs", "bus_id").agg(
        F.sum(F.col("sign") * F.col("mw")).alias("net_mw")
    )
    return net.join(ref(t), "case_id").where(F.col("bus_id") != F.col("ref_bus")).select(
        "case_id", "rhs", "bus_id", rounded("net_mw", 4).alias("net_mw")
    )


def device_buses(t):
    """Buses that carry a generator: those named by a supplier."""
    bus = t.net_bus().where(F.col("bus_type") != 3).select("case_id", "bus_id")
    named = t.read("supplier").select((F.col("s_suppkey") * 7 + 25).alias("bus_id"))
    return bus.join(named, "bus_id", "left_semi")


@query(
    "shift_factor_columns",
    """SELECT c_custkey % 25 AS case_id, c_custkey AS bus_id, 1::DOUBLE AS at_bus, -1::DOUBLE AS at_ref,
         0::DOUBLE AS elsewhere FROM customer
       WHERE c_custkey >= 25 AND c_custkey IN (SELECT s_suppkey * 7 + 25 FROM supplier)""",
)
def _(t):
    """Flows of a column leave its bus, reach the reference, and balance elsewhere."""
    edge = settle(edges(t))
    ptdf = n.shift_factor_columns(edge, ref(t), device_buses(t), batch=128)
    ends = n.incidence(edge).select("case_id", "branch_id", F.col("bus_id").alias("at"), "sign")
    net = (
        ptdf.join(ends, ["case_id", "branch_id"])
        .groupBy("case_id", "bus_id", "at")
        .agg(F.sum(F.col("sign") * F.col("value")).alias("v"))
        .join(ref(t), "case_id")
    )
    own, root = F.col("at") == F.col("bus_id"), F.col("at") == F.col("ref_bus")
    return net.groupBy("case_id", "bus_id").agg(
        rounded(F.max(F.when(own, F.col("v"))), 5).alias("at_bus"),
        rounded(F.max(F.when(root, F.col("v"))), 5).alias("at_ref"),
        rounded(F.max(F.when(~own & ~root, F.abs("v"))), 5).alias("elsewhere"),
    )


@query(
    "shift_vector",
    "SELECT case_id, bus_id, demand_mw AS net_mw FROM b_net_bus WHERE bus_type <> 3",
    NET,
)
def _(t):
    edge = settle(edges(t))
    flow = n.shift_vector(edge, ref(t), t.net_bus().select("case_id", "bus_id", F.col("demand_mw").alias("mw")))
    net = n.incidence(edge).join(flow, ["case_id", "branch_id"]).groupBy("case_id", "bus_id").agg(
        rounded(F.sum(F.col("sign") * F.col("mw")), 4).alias("net_mw")
    )
    return net.join(ref(t), "case_id").where(F.col("bus_id") != F.col("ref_bus")).drop("ref_bus")


@query(
    "flow_offset",
    "SELECT case_id, bus_id, 0::DOUBLE AS net_mw FROM b_net_bus WHERE bus_type <> 3",
    NET,
)
def _(t):
    """Offset flows circulate: they leave no net injection at any bus."""
    edge = settle(edges(t))
    flow = n.flow_offset(edge, ref(t))
    net = n.incidence(edge).join(flow, ["case_id", "branch_id"]).groupBy("case_id", "bus_id").agg(
        rounded(F.sum(F.col("sign") * F.col("mw")), 5).alias("net_mw")
    )
    return net.join(ref(t), "case_id").where(F.col("bus_id") != F.col("ref_bus")).drop("ref_bus")


@query(
    "ptdf_probe",
    """SELECT c_custkey % 25 AS case_id, c_custkey AS bus_id, 0::DOUBLE AS max_diff FROM customer
       WHERE c_custkey >= 25 AND c_custkey IN (SELECT s_suppkey * 7 + 25 FROM supplier)""",
)
def _(t):
    edge = settle(edges(t))
    buses = settle(device_buses(t))
    ptdf = n.shift_factor_columns(edge, ref(t), buses, batch=128)
    probe = n.ptdf_probe(ptdf, edge, ref(t), buses)
    return probe.withColumn("max_diff", rounded("max_diff", 6))


@query(
    "cycle_probe",
    """SELECT c_custkey % 25 AS case_id, c_custkey AS rhs, 0::DOUBLE AS current_gap,
         0::DOUBLE AS cycle_gap, 0::BIGINT AS unreached FROM customer
       WHERE c_custkey >= 25 AND c_custkey IN (SELECT s_suppkey * 7 + 25 FROM supplier)""",
)
def _(t):
    """The shift factors keep both laws: measured along trees and cycles, without the solver."""
    edge = settle(edges(t))
    buses = settle(device_buses(t))
    ptdf = n.shift_factor_columns(edge, ref(t), buses, batch=128)
    flow = ptdf.select("case_id", F.col("bus_id").alias("rhs"), "branch_id", F.col("value").alias("mw"))
    unit = buses.select("case_id", F.col("bus_id").alias("rhs"), "bus_id", F.lit(1.0).alias("mw"))
    probe = trees.cycle_probe(flow, edge, ref(t), unit)
    gaps = [rounded(c, 6).alias(c) for c in ("current_gap", "cycle_gap")]
    return probe.select("case_id", "rhs", *gaps, "unreached")


def heap(t):
    """Customers as a radial grid: customer k hangs below customer k / 2."""
    key = F.col("c_custkey").cast("bigint")
    return t.read("customer").where("c_custkey >= 1").select(
        F.lit(0).cast("bigint").alias("case_id"), key.alias("bus_id"),
        F.expr("c_custkey div 2").cast("bigint").alias("above"), F.round("c_acctbal").alias("mw"),
    )


def heap_branches(t):
    return heap(t).where("bus_id >= 2").select(
        "case_id", F.col("bus_id").alias("branch_id"), F.col("above").alias("from_bus"),
        F.col("bus_id").alias("to_bus"),
    )


@query(
    "spanning_tree",
    "SELECT 0::BIGINT AS case_id, c_custkey::BIGINT AS branch_id FROM customer WHERE c_custkey >= 2",
)
def _(t):
    """The radial grid with a cross branch of a higher number at every bus: these are left out."""
    last = F.lit(t.read("customer").agg(F.max("c_custkey")).first()[0] or 1)
    cross = heap(t).select(
        "case_id", (F.col("bus_id") + 2 * last).alias("branch_id"), F.col("bus_id").alias("from_bus"),
        (F.col("bus_id") * 7 % last + 1).alias("to_bus"),
    )
    return trees.spanning_tree(heap_branches(t).unionByName(cross)).select("case_id", "branch_id")


@query(
    "tree_flows",
    f"""WITH RECURSIVE up(branch_id, mw) AS (
          SELECT c_custkey::BIGINT, round(c_acctbal) FROM customer WHERE c_custkey >= 2
          UNION ALL SELECT branch_id // 2, mw FROM up WHERE branch_id // 2 >= 2)
        SELECT 0::BIGINT AS case_id, 0::BIGINT AS rhs, branch_id, {r('-sum(mw)', 3)} AS mw
        FROM up GROUP BY branch_id""",
)
def _(t):
    ref_bus = heap(t).where("bus_id = 1").select("case_id", F.col("bus_id").alias("ref_bus"))
    injection = heap(t).select("case_id", F.lit(0).cast("bigint").alias("rhs"), "bus_id", "mw")
    tour = trees.euler_tour(heap_branches(t), ref_bus)
    return trees.tree_flows(tour, injection).withColumn("mw", rounded("mw", 3))


DEV = """dv AS (SELECT s_suppkey % 25 AS case_id, 'gen' AS device, s_suppkey AS pos,
    s_nationkey::BIGINT AS bus_id, abs(s_acctbal) AS max_abs FROM supplier)"""


def placed(t):
    return t.read("supplier").select(
        (F.col("s_suppkey") % 25).alias("case_id"), F.lit("gen").alias("device"),
        F.col("s_suppkey").alias("pos"), F.col("s_nationkey").cast("bigint").alias("bus_id"),
    )


@query(
    "compress_ptdf",
    f"""WITH {DEV} SELECT case_id, bus_id, branch_id, value, device, pos FROM b_ptdf
        JOIN dv USING (case_id, bus_id) WHERE abs(value) > 1e-12""",
    "b_ptdf",
)
def _(t):
    return n.compress_ptdf(t.ptdf(), placed(t))


def bus_periods(t):
    """Net output by case, nation bus and year from the order lines."""
    joined = t.read("lineitem").join(t.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(
        (F.col("l_suppkey") % 25).alias("case_id"),
        F.col("s_nationkey").cast("bigint").alias("bus_id"),
        (F.year("l_shipdate") - 1995).cast("bigint").alias("period"),
    ).agg(F.sum("l_quantity").alias("mw"))


BUS_PERIODS = """bp AS (SELECT l_suppkey % 25 AS case_id, s_nationkey::BIGINT AS bus_id,
    (year(l_shipdate) - 1995)::BIGINT AS period, sum(l_quantity) AS mw
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


@query(
    "flows_from_injections",
    f"""WITH {BUS_PERIODS} SELECT case_id, branch_id, period,
        {r('sum(value * mw) + any_value(branch_id % 10)', 4)} AS mw FROM b_ptdf JOIN bp USING (case_id, bus_id) GROUP BY ALL""",
    "b_ptdf",
)
def _(t):
    offset = t.read("customer").select(
        (F.col("c_custkey") % 25).alias("case_id"), F.col("c_custkey").alias("branch_id"),
        (F.col("c_custkey") % 10).cast("double").alias("mw"),
    )
    flows = n.flows_from_injections(t.ptdf(), bus_periods(t), offset)
    return flows.withColumn("mw", rounded("mw", 4))


FIXED = """fx AS (SELECT c_custkey % 25 AS case_id, c_custkey AS branch_id, period::BIGINT AS period,
    c_custkey % 10 - (1 + period / 10) * c_acctbal AS mw FROM customer, range(4) AS p(period))"""


def fixed(t):
    base = t.read("customer").select(
        (F.col("c_custkey") % 25).alias("case_id"), F.col("c_custkey").alias("branch_id"), "c_acctbal",
        (F.col("c_custkey") % 10).cast("double").alias("mw"),
    )
    profile = t._periods(base.select("case_id").distinct()).withColumn("multiplier", 1 + F.col("period") / 10)
    shift = base.select("case_id", "branch_id", F.col("c_acctbal").alias("mw"))
    return n.fixed_flow(base, shift, profile)


@query("fixed_flow", f"WITH {FIXED} SELECT case_id, branch_id, period, {r('mw')} AS mw FROM fx")
def _(t):
    return fixed(t).withColumn("mw", rounded("mw"))


@query(
    "derived_line_limit",
    f"""WITH {DEV}, {FIXED}, z AS (SELECT c_custkey % 25 AS case_id, c_custkey AS branch_id,
          CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE abs(c_acctbal) + 1 END AS rate FROM customer),
        tm AS (SELECT case_id, branch_id, abs(value) * max_abs AS v FROM b_ptdf JOIN dv USING (case_id, bus_id)
               WHERE abs(value) > 1e-12
               UNION ALL SELECT case_id, branch_id, abs(mw) FROM fx),
        bd AS (SELECT case_id, branch_id, sum(v) AS s FROM tm GROUP BY ALL)
        SELECT case_id, branch_id, {r('CASE WHEN rate = 0 THEN s ELSE rate END', 5)} AS limit_mw,
          {r('CASE WHEN rate = 0 THEN s END', 5)} AS bound, true AS outward
        FROM z JOIN bd USING (case_id, branch_id)""",
    "b_ptdf",
)
def _(t):
    branch = t.read("customer").select(
        (F.col("c_custkey") % 25).alias("case_id"), F.col("c_custkey").alias("branch_id"),
        F.when(F.col("c_custkey") % 6 == 0, 0.0).otherwise(F.abs("c_acctbal") + 1).alias("rate_mw"),
    )
    box = t.read("supplier").select(
        (F.col("s_suppkey") % 25).alias("case_id"), F.lit("gen").alias("device"),
        F.col("s_suppkey").alias("pos"), F.abs("s_acctbal").alias("max_abs"),
    )
    place, reach = (settle(part) for part in n.box_by_bus(placed(t), box))
    limits = n.derived_line_limit(branch, n.compress_ptdf(t.ptdf(), place), fixed(t), reach)
    return limits.select(
        "case_id", "branch_id", rounded("limit_mw", 5).alias("limit_mw"), rounded("bound", 5).alias("bound"),
        (F.col("bound").isNull() | (F.col("limit_mw") > F.col("bound"))).alias("outward"),
    )
