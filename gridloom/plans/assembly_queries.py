"""Constraint families and the whole model over the supplier fleet."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.heavy import find_heavy
from ..operators import assemble as m
from ..operators import derive as d
from .bindings import CASES
from .derived_queries import DIMS, SPEC_DIMS, dims, lines
from .registry import query, r

FLEET = "b_gen b_renewable b_storage b_profile b_bus b_branch b_model_ptdf"
GEN = """g2 AS (SELECT *, CASE WHEN status THEN min_mw ELSE 0 END AS lower_mw,
    CASE WHEN status THEN max_mw ELSE 0 END AS upper_mw, CASE WHEN status THEN ramp_up ELSE 0 END AS up,
    CASE WHEN status THEN ramp_down ELSE 0 END AS down FROM b_gen JOIN dims USING (case_id)),
  st AS (SELECT * FROM b_storage JOIN dims USING (case_id)),
  rg2 AS (SELECT * FROM b_renewable JOIN dims USING (case_id)),
  ld AS (SELECT case_id, period, sum(multiplier * (demand_mw + shunt_mw)) AS mw
         FROM b_bus JOIN b_profile USING (case_id) GROUP BY ALL),
  dev AS (SELECT case_id, bus_id, gen_pos AS pos, 'gen' AS device FROM b_gen
    UNION ALL SELECT case_id, bus_id, pos, 'renewable' FROM b_renewable WHERE period = 0
    UNION ALL SELECT case_id, bus_id, pos, 'storage' FROM b_storage),
  ff AS (SELECT case_id, branch_id AS line_pos, period, (branch_id + period)::DOUBLE AS mw,
    rate_mw + 100 AS limit_mw FROM b_branch, range(4) AS p(period)),
  q AS (SELECT *, t*l AS tl, t*g AS tg, t*s AS ts FROM dims)"""
# column of a kind: c_* ; first row of an inequality family: r_*
OFF = """o AS (SELECT *, 0 AS c_pg, t*g AS c_rg, t*(g+rg) AS c_dc, t*(g+rg+s) AS c_ch, t*(g+rg+2*s) AS c_up,
    t*(2*g+rg+2*s) AS c_dn, 0 AS r_ll, t*l AS r_lu, 2*t*l AS r_h, 2*t*l+t*g AS r_f, 2*t*l+2*t*g AS r_ru,
    2*t*l+2*t*g+t AS r_rd, 2*t*l+2*t*g+2*t AS r_pd, 2*t*l+2*t*g+2*t+(t-1)*g AS r_pu,
    2*t*l+2*t*g+2*t+2*(t-1)*g AS r_el, 2*t*l+2*t*g+2*t+2*(t-1)*g+t*s AS r_eu FROM dims)"""
P = "range(4) AS p(period)"
A_SQL = {
    "balance": f"""SELECT case_id, 'A1' AS block, period AS row, c_pg + period * o.g + gen_pos AS col, 1::DOUBLE AS value
        FROM g2 JOIN o USING (case_id), {P}
      UNION ALL SELECT case_id, 'A1', period, c_rg + period * o.rg + pos, 1 FROM rg2 JOIN o USING (case_id)
      UNION ALL SELECT case_id, 'A1', period, c_dc + period * o.s + pos, 1 FROM st JOIN o USING (case_id), {P}
      UNION ALL SELECT case_id, 'A1', period, c_ch + period * o.s + pos, -1 FROM st JOIN o USING (case_id), {P}""",
    "terminal": f"""SELECT case_id, 'A1' AS block, o.t + pos AS row, c_dc + period * o.s + pos AS col, -1 / discharge_eff AS value
        FROM st JOIN o USING (case_id), {P}
      UNION ALL SELECT case_id, 'A1', o.t + pos, c_ch + period * o.s + pos, charge_eff FROM st JOIN o USING (case_id), {P}""",
    "line": f"""SELECT case_id, 'A2' AS block,
        CASE WHEN side = 1 THEN r_ll ELSE r_lu END + period * l + branch_id AS row,
        CASE WHEN device = 'gen' THEN c_pg + period * g WHEN device = 'renewable' THEN c_rg + period * rg
          WHEN k = 1 THEN c_dc + period * s ELSE c_ch + period * s END + pos AS col,
        (value * side * k)::DOUBLE AS value
      FROM b_model_ptdf JOIN dev USING (case_id, bus_id) JOIN o USING (case_id), {P},
        (VALUES (1), (-1)) AS sd(side), (VALUES (1), (-1)) AS sg(k)
      WHERE value <> 0 AND (k = 1 OR device = 'storage')""",
    "headroom": f"""SELECT case_id, 'A2' AS block, unnest([r_h, r_h, r_f, r_f]) + period * o.g + gen_pos AS row,
        unnest([c_pg, c_up, c_pg, c_dn]) + period * o.g + gen_pos AS col,
        unnest([-1, -1, 1, -1])::DOUBLE AS value FROM g2 JOIN o USING (case_id), {P}""",
    "requirement": f"""SELECT case_id, 'A2' AS block, unnest([r_ru, r_rd]) + period AS row,
        unnest([c_up, c_dn]) + period * o.g + gen_pos AS col, 1::DOUBLE AS value
        FROM g2 JOIN o USING (case_id), {P}""",
    "ramp": f"""SELECT case_id, 'A2' AS block, unnest([r_pd, r_pd, r_pu, r_pu]) + (period - 1) * o.g + gen_pos AS row,
        c_pg + unnest([period, period - 1, period, period - 1]) * o.g + gen_pos AS col,
        unnest([1, -1, -1, 1])::DOUBLE AS value FROM g2 JOIN o USING (case_id), {P} WHERE period >= 1""",
    "energy": f"""SELECT case_id, 'A2' AS block, unnest([r_el, r_el, r_eu, r_eu]) + period * o.s + pos AS row,
        unnest([c_dc, c_ch, c_dc, c_ch]) + e * o.s + pos AS col,
        unnest([-1 / discharge_eff, charge_eff, 1 / discharge_eff, -charge_eff]) AS value
        FROM st JOIN o USING (case_id), {P}, range(4) AS x(e) WHERE e <= period""",
}
B_SQL = {
    "balance": "SELECT case_id, 'A1' AS block, period AS row, mw AS b FROM ld",
    "terminal": "SELECT case_id, 'A1' AS block, t + pos AS row, 0::DOUBLE AS b FROM st",
    "line": """SELECT case_id, 'A2' AS block, unnest([r_ll, r_lu]) + period * l + line_pos AS row,
        unnest([-limit_mw - mw, mw - limit_mw]) AS b FROM ff JOIN o USING (case_id)""",
    "headroom": f"""SELECT case_id, 'A2' AS block, unnest([r_h, r_f]) + period * o.g + gen_pos AS row,
        unnest([-upper_mw, lower_mw]) AS b FROM g2 JOIN o USING (case_id), {P}""",
    "requirement": """SELECT case_id, 'A2' AS block, unnest([r_ru, r_rd]) + period AS row,
        unnest([reserve_up, reserve_down]) AS b FROM b_profile JOIN o USING (case_id)""",
    "ramp": f"""SELECT case_id, 'A2' AS block, unnest([r_pd, r_pu]) + (period - 1) * o.g + gen_pos AS row,
        unnest([-down, -up]) AS b FROM g2 JOIN o USING (case_id), {P} WHERE period >= 1""",
    "energy": f"""SELECT case_id, 'A2' AS block, unnest([r_el, r_eu]) + period * o.s + pos AS row,
        unnest([min_mwh - initial_mwh, initial_mwh - max_mwh]) AS b FROM st JOIN o USING (case_id), {P}""",
}


def _sql(family):
    return f"""WITH {DIMS}, {GEN}, {OFF}, a AS ({A_SQL[family]}), b AS ({B_SQL[family]})
      SELECT 'a' AS part, case_id, block, row::BIGINT AS row, col::BIGINT AS col, {r('value', 9)} AS value FROM a
      UNION ALL SELECT 'b', case_id, block, row::BIGINT, NULL, {r('b', 6)} FROM b"""


def _long(a, b):
    left = a.select(F.lit("a").alias("part"), "case_id", "block", "row", "col", rounded("value", 9).alias("value"))
    right = b.select(
        F.lit("b").alias("part"), "case_id", "block", "row", F.lit(None).cast("bigint").alias("col"),
        rounded("b", 6).alias("value"),
    )
    return left.unionByName(right)


def gens(t):
    wide = t.branch().withColumn("angle_min", F.lit(-360.0)).withColumn("angle_max", F.lit(360.0))
    return d.normalize_case(t.bus(), t.gen(), wide)[1]


def devices(t):
    place = ["case_id", "bus_id", "pos"]
    return (
        t.gen()
        .select("case_id", "bus_id", F.col("gen_pos").alias("pos"), F.lit("gen").alias("device"))
        .unionByName(t.renewable().where(F.col("period") == 0).select(*place, F.lit("renewable").alias("device")))
        .unionByName(t.storage().select(*place, F.lit("storage").alias("device")))
    )


def line_ptdf(t):
    return t.model_ptdf().withColumnRenamed("branch_id", "line_pos")


def flows(t):
    return t._periods(t.branch()).select(
        "case_id", F.col("branch_id").alias("line_pos"), "period",
        (F.col("branch_id") + F.col("period")).cast("double").alias("mw"),
    )


def load(t, spans):
    return d.expand_load(t.bus(), spans, t.profile())


@query("rows_power_balance", _sql("balance"), FLEET)
def _(t):
    spans = dims(t)
    return _long(*m.rows_power_balance(spans, load(t, spans)))


@query("rows_storage_terminal", _sql("terminal"), FLEET)
def _(t):
    return _long(*m.rows_storage_terminal(dims(t), t.storage()))


@query("rows_line_flow", _sql("line"), FLEET)
def _(t):
    return _long(*m.rows_line_flow(dims(t), line_ptdf(t), devices(t), lines(t), flows(t)))


@query("rows_line_flow_heavy", _sql("line"), FLEET)
def _(t):
    placed = devices(t)
    often = find_heavy(placed, "case_id", "bus_id", share=1 / 256, ways=8)
    return _long(*m.rows_line_flow(dims(t), line_ptdf(t), placed, lines(t), flows(t), often))


@query("rows_headroom_footroom", _sql("headroom"), FLEET)
def _(t):
    return _long(*m.rows_headroom_footroom(dims(t), gens(t)))


@query("rows_reserve_requirement", _sql("requirement"), FLEET)
def _(t):
    return _long(*m.rows_reserve_requirement(dims(t), t.profile()))


@query("rows_ramp", _sql("ramp"), FLEET)
def _(t):
    return _long(*m.rows_ramp(dims(t), gens(t)))


@query("rows_storage_energy", _sql("energy"), FLEET)
def _(t):
    return _long(*m.rows_storage_energy(dims(t), t.storage()))


COLS = f"""colv AS (SELECT case_id, unnest([c_pg, c_up, c_dn]) + period * o.g + gen_pos AS col,
      unnest([slope, 0, 0]) AS c, unnest([lower_mw, 0, 0]) AS lower, unnest([upper_mw, up, down]) AS upper
      FROM g2 JOIN o USING (case_id), {P}
    UNION ALL SELECT case_id, c_rg + period * o.rg + pos, -1, min_mw, max_mw FROM rg2 JOIN o USING (case_id)
    UNION ALL SELECT case_id, unnest([c_dc, c_ch]) + period * o.s + pos,
      unnest([1 / discharge_eff - 1, 1 - charge_eff]), 0, unnest([max_discharge, max_charge])
      FROM st JOIN o USING (case_id), {P}),
  k AS (SELECT case_id, sum(v) AS constant FROM (SELECT case_id, t * constant AS v FROM g2
    UNION ALL SELECT case_id, max_mw FROM rg2) GROUP BY 1)"""


@query(
    "column_bounds_costs",
    f"""WITH {DIMS}, {GEN}, {OFF}, {COLS}
    SELECT case_id, col::BIGINT AS col, {r('c', 9)} AS c, {r('lower', 6)} AS lower, {r('upper', 6)} AS upper,
      {r('constant', 2)} AS constant FROM colv JOIN k USING (case_id)""",
    FLEET,
)
def _(t):
    cols, constant = m.column_bounds_costs(dims(t), gens(t), t.renewable(), t.storage())
    return cols.join(constant, "case_id").select(
        "case_id", "col", rounded("c", 9).alias("c"), rounded("lower", 6).alias("lower"),
        rounded("upper", 6).alias("upper"), rounded("constant", 2).alias("constant"),
    )


def build(t):
    spans = dims(t)
    return m.build_lp_tables(
        gens(t), t.renewable(), t.storage(), lines(t), line_ptdf(t), flows(t), load(t, spans), t.profile()
    )


UNION_A = " UNION ALL ".join(f"SELECT '{n}' AS fam, * FROM ({s})" for n, s in A_SQL.items())
UNION_B = " UNION ALL ".join(f"SELECT * FROM ({s})" for s in B_SQL.values())


@query(
    "build_lp_tables",
    f"""WITH {DIMS}, {GEN}, {OFF}, a AS ({UNION_A}), b AS ({UNION_B}),
      aa AS (SELECT case_id, block, row::BIGINT AS row, count(*) AS entries, sum(value) AS total,
        sum(col * value) AS moment FROM a GROUP BY ALL)
    SELECT case_id, block, row, entries, {r('total', 6)} AS total, {r('moment', 3)} AS moment,
      {r('b', 6)} AS b FROM aa JOIN (SELECT case_id, block, row::BIGINT AS row, b FROM b) USING (case_id, block, row)""",
    FLEET,
)
def _(t):
    lp = build(t)
    by_row = lp.a.groupBy("case_id", "block", "row").agg(
        F.count("*").alias("entries"), F.sum("value").alias("total"),
        F.sum(F.col("col") * F.col("value")).alias("moment"),
    )
    return by_row.join(lp.row_vec, ["case_id", "block", "row"]).select(
        "case_id", "block", "row", "entries", rounded("total", 6).alias("total"),
        rounded("moment", 3).alias("moment"), rounded("b", 6).alias("b"),
    )


@query(
    "check_lp_dimensions",
    f"""WITH {DIMS} SELECT case_id, t*(3*g+rg+2*s) AS n, t+s AS m1,
        2*t*l+2*t*g+2*t+2*(t-1)*g+2*t*s AS m2, t+s AS rows_a1, 2*t*l+2*t*g+2*t+2*(t-1)*g+2*t*s AS rows_a2,
        t*(3*g+rg+2*s) AS columns, true AS passed FROM dims""",
    FLEET,
)
def _(t):
    return m.check_lp_dimensions(build(t))


BOUND = f"""{SPEC_DIMS}, nb AS (SELECT *, 2*periods*branches*(generators+renewables+2*storage) AS line_bound,
    periods*(generators+renewables+2*storage) + 2*periods*storage + 6*periods*generators
    + 4*(periods-1)*generators + 2*storage*periods*(periods+1) AS nonline FROM n)"""


@query(
    "nnz_upper_bound",
    f"WITH {BOUND} SELECT * EXCLUDE (n, m1, m2), line_bound + nonline AS nnz_bound FROM nb",
    "b_spec",
)
def _(t):
    return m.nnz_upper_bound(t.spec())


@query(
    "nnz_ledger",
    f"""WITH {BOUND}, sup AS (SELECT s_nationkey AS case_id,
        sum(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END) FILTER (l_discount <> 0)::BIGINT AS line_base
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
      led AS (SELECT *, 2 * periods * line_base + nonline AS nnz FROM nb JOIN sup USING (case_id))
      SELECT case_id, periods, line_base, nonline, nnz, nnz * 12 + (m1 + m2 + 2) * 4 AS csr_bytes,
        CASE WHEN periods < 96 THEN generators * 100000 + periods END AS published_nnz,
        nnz - CASE WHEN periods < 96 THEN generators * 100000 + periods END AS difference FROM led""",
    "b_spec",
)
def _(t):
    support = t.read("lineitem").join(
        t.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    ).select(
        F.col("s_nationkey").alias("case_id"),
        F.when(F.col("l_returnflag") == "R", "storage").otherwise("gen").alias("device"),
        F.col("l_discount").alias("value"),
    )
    spec = t.spec()
    published = spec.where(F.col("periods") < 96).select(
        "case_id", "periods", (F.col("generators") * 100_000 + F.col("periods")).alias("published_nnz")
    )
    return m.nnz_ledger(support, spec, published)
