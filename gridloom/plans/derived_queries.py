"""Derived tables over the supplier, part, order and customer bindings."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import derive as d
from .bindings import CASES, HORIZON, Tables
from .registry import query, r

DIMS = """dims AS (SELECT case_id, 4::BIGINT AS t, g, rg, g AS s, 50::BIGINT AS l FROM
    (SELECT case_id, count(*) AS g FROM b_gen GROUP BY 1) JOIN
    (SELECT case_id, max(pos) + 1 AS rg FROM b_renewable GROUP BY 1) USING (case_id))"""
VARIABLE = f"""{DIMS}, vars AS (
    SELECT case_id, 'p_g' AS kind, period, gen_pos AS pos, period * g + gen_pos AS col
      FROM b_gen JOIN dims USING (case_id), range(4) AS p(period)
    UNION ALL SELECT case_id, 'p_rg', period, pos, t * g + period * rg + pos
      FROM b_renewable JOIN dims USING (case_id)
    UNION ALL SELECT case_id, 'p_ess_dc', period, pos, t * (g + rg) + period * s + pos
      FROM b_storage JOIN dims USING (case_id), range(4) AS p(period)
    UNION ALL SELECT case_id, 'p_ess_ch', period, pos, t * (g + rg + s) + period * s + pos
      FROM b_storage JOIN dims USING (case_id), range(4) AS p(period)
    UNION ALL SELECT case_id, 'r_up', period, gen_pos, t * (g + rg + 2 * s) + period * g + gen_pos
      FROM b_gen JOIN dims USING (case_id), range(4) AS p(period)
    UNION ALL SELECT case_id, 'r_down', period, gen_pos, t * (2 * g + rg + 2 * s) + period * g + gen_pos
      FROM b_gen JOIN dims USING (case_id), range(4) AS p(period))"""


def lines(t: Tables):
    """Every branch keeps a row; its position is its id."""
    return t.branch().select(
        "case_id", F.col("branch_id").alias("line_pos"), (F.col("rate_mw") + 100).alias("limit_mw")
    )


def dims(t: Tables):
    from ..session import settle

    return settle(d.case_dims(t.gen(), t.renewable(), t.storage(), lines(t), t.profile()))


@query("active_elements", "SELECT case_id, branch_id FROM b_net_branch WHERE status", "b_net_branch")
def _(t):
    return d.active_elements(t.net_branch()).select("case_id", "branch_id")


@query(
    "effective_tap",
    """SELECT case_id, branch_id, CASE WHEN abs(tap) <= 1e-8 THEN 1 ELSE tap END::DOUBLE AS effective_tap
       FROM b_net_branch""",
    "b_net_branch",
)
def _(t):
    return d.effective_tap(t.net_branch()).select("case_id", "branch_id", "effective_tap")


@query(
    "bus_demand",
    f"SELECT case_id, bus_id, {r('demand_mw + shunt_mw', 2)} AS withdrawal_mw FROM b_bus",
    "b_bus",
)
def _(t):
    found = d.bus_demand(t.bus())
    return found.select("case_id", "bus_id", rounded("withdrawal_mw", 2).alias("withdrawal_mw"))


@query(
    "linear_cost_terms",
    f"""SELECT l_orderkey, l_linenumber, {r('''CASE WHEN l_linenumber % 2 = 0 THEN l_quantity
          ELSE (l_extendedprice - l_discount) / l_quantity END''', 8)} AS slope,
        {r('''CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice
          ELSE l_discount - (l_extendedprice - l_discount) / l_quantity * 0.04 END''', 8)} AS constant
        FROM lineitem""",
)
def _(t):
    odd = F.col("l_linenumber") % 2 == 1
    x1 = F.lit(0.04)
    costs = t.read("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(odd, 1).otherwise(2).alias("model"),
        F.when(
            odd, F.array(x1, F.col("l_discount"), x1 + F.col("l_quantity"), F.col("l_extendedprice"))
        )
        .otherwise(F.array(F.lit(0.0), F.col("l_quantity"), F.col("l_extendedprice")))
        .alias("parameters"),
    )
    found = d.linear_cost_terms(costs)
    return found.select(
        "l_orderkey", "l_linenumber", rounded("slope", 8).alias("slope"), rounded("constant", 8).alias("constant")
    )


@query(
    "normalize_case",
    """SELECT case_id, 'gen' AS element, gen_pos AS id, CASE WHEN status THEN min_mw ELSE 0 END AS a,
         CASE WHEN status THEN max_mw ELSE 0 END AS b, NOT status AS flag FROM b_gen
       UNION ALL SELECT case_id, 'branch', branch_id, (rate_mw = 0)::INT::DOUBLE,
         (branch_id % 9 = 0)::INT::DOUBLE, NOT status FROM b_net_branch""",
    "b_gen b_net_branch",
)
def _(t):
    angle = F.when(F.col("branch_id") % 9 == 0, 45.0).otherwise(360.0)
    branch = t.net_branch().withColumn("angle_min", F.lit(-360.0)).withColumn("angle_max", angle)
    _, gens, branches = d.normalize_case(t.bus(), t.gen(), branch)
    left = gens.select(
        "case_id", F.lit("gen").alias("element"), F.col("gen_pos").alias("id"),
        F.col("lower_mw").alias("a"), F.col("upper_mw").alias("b"), (~F.col("status")).alias("flag"),
    )
    right = branches.select(
        "case_id", F.lit("branch").alias("element"), F.col("branch_id").alias("id"),
        F.col("zero_rate").cast("double").alias("a"), F.col("ignored_angle").cast("double").alias("b"),
        F.col("inactive").alias("flag"),
    )
    return left.unionByName(right)


PLACED = """sp AS (SELECT case_id, rg AS renewables, rg // 2 AS storage, g FROM
      (SELECT p_partkey % 5 AS case_id, count(*) AS rg FROM part GROUP BY 1)
      JOIN (SELECT case_id, count(*) AS g FROM b_gen GROUP BY 1) USING (case_id)),
    i AS (SELECT p_partkey % 5 AS case_id, p_partkey // 5 AS pos FROM part),
    pl AS (SELECT case_id, 'renewable' AS kind, pos, pos % g AS gen_pos FROM i JOIN sp USING (case_id)
      UNION ALL SELECT case_id, 'storage', pos, (pos % ((renewables + 1) // 2)) * 2 % g
        FROM i JOIN sp USING (case_id) WHERE pos < storage)"""


def placement(t):
    spec = t.read("part").groupBy((F.col("p_partkey") % CASES).alias("case_id")).agg(
        F.count("*").alias("renewables")
    )
    spec = spec.withColumn("storage", d.idiv(F.col("renewables"), F.lit(2)))
    return d.place_resources(t.gen(), spec), spec


@query(
    "place_resources",
    f"""WITH {PLACED} SELECT case_id, kind, pos, gen_pos, bus_id,
        (CASE kind WHEN 'renewable' THEN 'rg' ELSE 'ess' END) || '_' ||
        (CASE WHEN pos < 9999 THEN lpad((pos + 1)::VARCHAR, 4, '0') ELSE (pos + 1)::VARCHAR END)
        || '_bus_' || bus_id AS resource_id FROM pl JOIN b_gen USING (case_id, gen_pos)""",
    "b_gen",
)
def _(t):
    return placement(t)[0]


@query(
    "size_resources",
    f"""WITH {PLACED}, ld AS (SELECT case_id, sum((demand_mw + shunt_mw)) AS base FROM b_bus GROUP BY 1)
        SELECT case_id, kind, pos, {r("CASE kind WHEN 'renewable' THEN 0.1::DOUBLE * base / renewables ELSE 0.01::DOUBLE * base / storage END", 3)} AS max_mw,
        CASE kind WHEN 'storage' THEN {r('4 * (0.01::DOUBLE * base / storage)', 3)} END AS max_mwh,
        CASE kind WHEN 'storage' THEN {r('0.5 * 4 * (0.01::DOUBLE * base / storage)', 3)} END AS initial_mwh
        FROM pl JOIN sp USING (case_id) JOIN ld USING (case_id)""",
    "b_gen b_bus",
)
def _(t):
    placed, spec = placement(t)
    sized = d.size_resources(placed, d.base_load(t.bus()), spec)
    names = ("max_mw", "max_mwh", "initial_mwh")
    return sized.select("case_id", "kind", "pos", *[rounded(n, 3).alias(n) for n in names])


@query(
    "size_ramps",
    f"""SELECT case_id, gen_pos, {r('CASE WHEN status THEN 0.1 * max_mw ELSE 0 END')} AS ramp_up,
        {r('CASE WHEN status THEN 0.1 * max_mw ELSE 0 END')} AS ramp_down FROM b_gen""",
    "b_gen",
)
def _(t):
    g = d.size_ramps(t.gen())
    return g.select("case_id", "gen_pos", rounded("ramp_up").alias("ramp_up"), rounded("ramp_down").alias("ramp_down"))


@query(
    "size_profile",
    f"""WITH ld AS (SELECT case_id, sum(demand_mw + shunt_mw) AS base FROM b_bus GROUP BY 1)
        SELECT case_id, period, 1::DOUBLE AS multiplier, {r('0.01 * base', 4)} AS reserve_up,
        {r('0.01 * base', 4)} AS reserve_down FROM ld, range(6) AS p(period)""",
    "b_bus",
)
def _(t):
    p = d.size_profile(d.base_load(t.bus()), 6)
    names = ("reserve_up", "reserve_down")
    return p.select("case_id", "period", "multiplier", *[rounded(n, 4).alias(n) for n in names])


@query(
    "expand_load",
    f"""SELECT case_id, period, bus_id, {r('multiplier * (demand_mw + shunt_mw)', 3)} AS mw
        FROM b_bus JOIN b_profile USING (case_id)""",
    "b_bus b_profile",
)
def _(t):
    horizon = t.profile().groupBy("case_id").agg((F.max("period") + 1).alias("periods"))
    load = d.expand_load(t.bus(), horizon, t.profile())
    return load.withColumn("mw", rounded("mw", 3))


@query("variable_index", f"WITH {VARIABLE} SELECT * FROM vars", "b_gen b_renewable b_storage")
def _(t):
    return d.variable_index(dims(t))


@query(
    "variable_key",
    f"WITH {VARIABLE} SELECT * FROM vars",
    "b_gen b_renewable b_storage",
)
def _(t):
    spans = dims(t)
    cols = d.variable_index(spans).select("case_id", "col")
    return d.variable_key(cols, spans)


FAMILY = f"""{DIMS}, fam(k, block, family, side, equation) AS (VALUES
    (0, 'A1', 'power_balance', 'equality', '1'), (1, 'A1', 'storage_terminal_energy', 'equality', '9'),
    (2, 'A2', 'line_flow', 'lower', '2'), (3, 'A2', 'line_flow', 'upper', '2'),
    (4, 'A2', 'reserve_headroom', 'upper', '4'), (5, 'A2', 'reserve_footroom', 'lower', '4'),
    (6, 'A2', 'reserve_requirement', 'up', '5'), (7, 'A2', 'reserve_requirement', 'down', '5'),
    (8, 'A2', 'generator_ramp', 'down', '6'), (9, 'A2', 'generator_ramp', 'up', '6'),
    (10, 'A2', 'storage_energy', 'lower', '8'), (11, 'A2', 'storage_energy', 'upper', '8')),
  sized AS (SELECT *, CASE WHEN k IN (0, 6, 7) THEN 1 WHEN k IN (1, 10, 11) THEN s WHEN k IN (2, 3) THEN l
      ELSE g END AS elements, CASE WHEN k = 1 THEN 1 WHEN k IN (8, 9) THEN t - 1 ELSE t END AS cnt
    FROM dims, fam),
  placed AS (SELECT *, coalesce(sum(elements * cnt) OVER (PARTITION BY case_id, block ORDER BY k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized),
  crow AS (SELECT case_id, block, start + i AS row, family, side, equation,
      CASE WHEN k <> 1 THEN i // elements + CASE WHEN k IN (8, 9) THEN 1 ELSE 0 END END AS period,
      i % elements AS element
    FROM placed, unnest(range(elements * cnt)) AS u(i))"""


@query("expand_row_families", f"WITH {FAMILY} SELECT * FROM crow", "b_gen b_renewable")
def _(t):
    return d.expand_row_families(d.row_families(dims(t)))


@query(
    "lookup_row_family",
    f"""WITH {FAMILY}, wanted AS (SELECT DISTINCT l_suppkey % 5 AS case_id, 'A2' AS block,
          l_partkey AS row FROM lineitem)
        SELECT crow.* FROM wanted JOIN crow USING (case_id, block, row)""",
    "b_gen b_renewable",
)
def _(t):
    rows = t.read("lineitem").select(
        (F.col("l_suppkey") % CASES).alias("case_id"), F.lit("A2").alias("block"), F.col("l_partkey").alias("row")
    ).distinct()
    return d.lookup_row_family(rows, d.row_families(dims(t)), chunk=256)


SPEC_DIMS = """n AS (SELECT *, periods * (3 * generators + renewables + 2 * storage) AS n,
    periods + storage AS m1, 2 * periods * branches + 2 * periods * generators + 2 * periods
    + 2 * (periods - 1) * generators + 2 * periods * storage AS m2 FROM b_spec)"""


@query("expected_dimensions", f"WITH {SPEC_DIMS} SELECT *, m1 + m2 AS m FROM n", "b_spec")
def _(t):
    return d.expected_dimensions(t.spec())


@query(
    "dimension_summary",
    f"""WITH {DIMS}, e AS (SELECT l_suppkey % 5 AS case_id, count(*) FILTER (l_linestatus = 'F') AS a1,
          count(*) FILTER (l_linestatus <> 'F') AS a2 FROM lineitem GROUP BY 1),
        br AS (SELECT case_id, count(*) FILTER (status) AS ab,
          count(*) FILTER (status AND rate_mw > 0) AS lb FROM b_branch GROUP BY 1),
        bu AS (SELECT case_id, count(*) AS buses FROM b_bus GROUP BY 1)
      SELECT case_id, t AS periods, rg AS n_rg, s AS n_ess, t * (3 * g + rg + 2 * s) AS n, t + s AS m1,
        2*t*l + 2*t*g + 2*t + 2*(t-1)*g + 2*t*s AS m2, t + s + 2*t*l + 2*t*g + 2*t + 2*(t-1)*g + 2*t*s AS m,
        buses, g AS generators, ab AS active_branches, lb AS limited_branches, a1 AS nnz_a1, a2 AS nnz_a2
      FROM dims JOIN e USING (case_id) JOIN br USING (case_id) JOIN bu USING (case_id)""",
    "b_gen b_renewable b_branch b_bus",
)
def _(t):
    a = t.read("lineitem").select(
        (F.col("l_suppkey") % CASES).alias("case_id"),
        F.when(F.col("l_linestatus") == "F", "A1").otherwise("A2").alias("block"),
    )
    return d.dimension_summary(t.bus(), t.gen(), t.branch(), a, dims(t))


@query(
    "unpack_state",
    f"""WITH {VARIABLE} SELECT case_id, CASE WHEN kind IN ('p_g', 'r_up', 'r_down') THEN 'gen'
          WHEN kind = 'p_rg' THEN 'renewable' ELSE 'storage' END AS device, pos, period,
        {', '.join(f"max(col::DOUBLE / 4) FILTER (kind = '{k}') AS {k}" for k in d.KINDS)}
        FROM vars GROUP BY ALL""",
    "b_gen b_renewable b_storage",
)
def _(t):
    spans = dims(t)
    state = d.variable_index(spans).withColumn("x", F.col("col").cast("double") / 4)
    return d.unpack_state(state, spans)


@query(
    "bus_injections",
    f"""WITH m AS (SELECT case_id, s_nationkey::BIGINT AS bus_id, period, p_g, charge, discharge
          FROM b_months JOIN supplier ON s_suppkey = pos * 5 + case_id),
        terms AS (SELECT case_id, bus_id, period, p_g + discharge - charge AS mw FROM m
          UNION ALL SELECT case_id, bus_id, period, -(demand_mw + shunt_mw) FROM b_bus, range(84) AS p(period))
        SELECT case_id, bus_id, period, {r('sum(mw)', 2)} AS mw FROM terms GROUP BY ALL""",
    "b_months b_bus",
)
def _(t):
    place = t.gen().select("case_id", F.col("gen_pos").alias("pos"), "bus_id")
    months = t.months().join(place, ["case_id", "pos"])
    horizon = t.gen().groupBy("case_id").agg(F.lit(84).cast("bigint").alias("periods"))
    flat = t.gen().select("case_id").distinct().withColumn(
        "period", F.explode(F.expr("sequence(0L, 83L)"))
    )
    load = d.expand_load(t.bus(), horizon, flat.withColumn("multiplier", F.lit(1.0)))
    net = d.bus_injections(
        load, [(months, "p_g", 1.0), (months, "discharge", 1.0), (months, "charge", -1.0)]
    )
    return net.withColumn("mw", rounded("mw", 2))


@query(
    "period_results",
    """WITH v AS (SELECT case_id, period, pos, unnest(['p_g', 'r_up', 'r_down']) AS kind,
         unnest([p_g, r_up, r_down]) AS value FROM b_months)
       SELECT case_id, period, kind, pos // 16 AS chunk, list(value ORDER BY pos) AS "values"
       FROM v GROUP BY ALL""",
    "b_months",
)
def _(t):
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("p_g", "r_up", "r_down")])
    long = t.months().select("case_id", "period", "pos", F.explode(kinds).alias("k"))
    return d.period_results(long.select("case_id", "period", "pos", "k.*"), chunk=16)
