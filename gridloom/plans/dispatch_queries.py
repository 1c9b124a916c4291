"""Physical validation of the monthly shipment dispatch."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import physical as p
from ..session import unfolded
from .networks_queries import BUS_PERIODS, bus_periods, fixed
from .registry import query, r

DISPATCH = "b_gen b_months b_storage"
G = """g AS (SELECT case_id, gen_pos AS pos, CASE WHEN status THEN min_mw ELSE 0 END AS lower_mw,
    CASE WHEN status THEN max_mw ELSE 0 END AS upper_mw, ramp_up, ramp_down, slope, constant FROM b_gen),
  gd AS (SELECT * FROM b_months JOIN g USING (case_id, pos)),
  sd AS (SELECT * FROM b_months JOIN b_storage USING (case_id, pos))"""


def gens(t):
    zero = F.lit(0.0)
    return t.gen().select(
        "case_id", F.col("gen_pos").alias("pos"), "bus_id", "slope", "constant", "ramp_up", "ramp_down",
        F.when(F.col("status"), F.col("min_mw")).otherwise(zero).alias("lower_mw"),
        F.when(F.col("status"), F.col("max_mw")).otherwise(zero).alias("upper_mw"),
    )


def _sql(family, source, sides, period="period", element="pos", places=4):
    parts = [
        f"""SELECT case_id, '{family}' AS family, '{side}' AS side, {period} AS period,
        {element} AS element, {r(value, places)} AS value FROM {source}"""
        for side, value in sides.items()
    ]
    return f"WITH {G} " + " UNION ALL ".join(parts)


def out(df, places=4):
    return df.withColumn("value", rounded("value", places))


def profile(t):
    """Reserve needs of every month with dispatch."""
    months = t.months().select("case_id", "period").distinct()
    return months.select(
        "case_id", "period", (F.col("period") * 10.0).alias("reserve_up"), (F.col("period") * 5.0).alias("reserve_down")
    )


def month_load(t):
    months = t.months()
    return months.select("case_id", "period", (F.col("r_up") * 2 + F.col("pos") % 3).alias("mw"))


def stored(t):
    """Dispatch of the storage devices."""
    return t.months().join(t.storage().select("case_id", "pos"), ["case_id", "pos"], "left_semi")


def generated(t):
    """Dispatch of the generators."""
    return t.months().join(gens(t).select("case_id", "pos"), ["case_id", "pos"], "left_semi")


def produced(t):
    """Output of the device periods that have a profile."""
    keys = ["case_id", "pos", "period"]
    return t.output().join(unfolded(t.renewable().select(*keys)), keys, "left_semi")


@query(
    "violation_power_balance",
    f"""SELECT case_id, 'power_balance' AS family, 'equality' AS side, period, 0::BIGINT AS element,
        {r('abs(sum(p_g + discharge - charge - (r_up * 2 + pos % 3)))', 4)} AS value FROM b_months GROUP BY ALL""",
    "b_months",
)
def _(t):
    m = t.months()
    return out(p.violation_power_balance([(m, "p_g", 1.0), (m, "discharge", 1.0), (m, "charge", -1.0)], month_load(t)))


@query(
    "violation_line_flow",
    f"""WITH fx AS (SELECT c_custkey % 25 AS case_id, c_custkey AS branch_id, period::BIGINT AS period,
          c_custkey % 10 - (1 + period / 10) * c_acctbal AS mw, c_custkey % 4000 AS rate, c_mktsegment AS seg
          FROM customer, range(4) AS p(period))
        SELECT case_id, 'line_flow' AS family, 'magnitude' AS side, period, branch_id AS element,
          {r('greatest(abs(mw) - rate, 0)', 4)} AS value FROM fx WHERE seg <> 'BUILDING' AND rate > 0""",
)
def _(t):
    key = F.col("c_custkey")
    branch = t.read("customer").select(
        (key % 25).alias("case_id"), key.alias("branch_id"), (key % 4000).cast("double").alias("rate_mw"),
        (F.col("c_mktsegment") != "BUILDING").alias("status"),
    )
    return out(p.violation_line_flow(fixed(t), branch))


@query("violation_generator_bounds", _sql("generator_bounds", "gd", {
    "lower": "greatest(lower_mw - p_g, 0)", "upper": "greatest(p_g - upper_mw, 0)"}), DISPATCH)
def _(t):
    return out(p.violation_generator_bounds(generated(t), gens(t)))


@query("violation_reserve_bounds", _sql("reserve_bounds", "gd", {
    "up_lower": "greatest(-r_up, 0)", "up_upper": "greatest(r_up - ramp_up, 0)",
    "down_lower": "greatest(-r_down, 0)", "down_upper": "greatest(r_down - ramp_down, 0)"}), DISPATCH)
def _(t):
    return out(p.violation_reserve_bounds(generated(t), gens(t)))


@query("violation_headroom", _sql("reserve_headroom_footroom", "gd", {
    "headroom": "greatest(p_g + r_up - upper_mw, 0)", "footroom": "greatest(lower_mw + r_down - p_g, 0)"}), DISPATCH)
def _(t):
    return out(p.violation_headroom(generated(t), gens(t)))


@query(
    "violation_reserve_requirement",
    f"""WITH s AS (SELECT case_id, period, sum(r_up) AS u, sum(r_down) AS d FROM b_months GROUP BY ALL)
        SELECT case_id, 'reserve_requirements' AS family, 'up' AS side, period, 0::BIGINT AS element,
          {r('greatest(period * 10 - u, 0)')} AS value FROM s
        UNION ALL SELECT case_id, 'reserve_requirements', 'down', period, 0, {r('greatest(period * 5 - d, 0)')} FROM s""",
    "b_months",
)
def _(t):
    return out(p.violation_reserve_requirement(t.months(), profile(t)))


RAMP = "(SELECT now.*, now.p_g - before.p_g AS ch FROM gd now JOIN b_months before ON before.case_id = now.case_id AND before.pos = now.pos AND before.period = now.period - 1)"


@query("violation_ramp", _sql("generator_ramping", RAMP, {
    "up": "greatest(ch - ramp_up, 0)", "down": "greatest(-ramp_down - ch, 0)"}), DISPATCH)
def _(t):
    return out(p.violation_ramp(generated(t), gens(t)))


@query(
    "violation_renewable",
    f"""WITH x AS (SELECT * FROM b_output JOIN b_renewable USING (case_id, pos, period))
        SELECT case_id, 'renewable_bounds' AS family, 'lower' AS side, period, pos AS element,
          {r('greatest(min_mw - output, 0)')} AS value FROM x
        UNION ALL SELECT case_id, 'renewable_bounds', 'upper', period, pos, {r('greatest(output - max_mw, 0)')} FROM x""",
    "b_output b_renewable",
)
def _(t):
    return out(p.violation_renewable(produced(t), t.renewable()), 6)


@query("violation_storage_power", _sql("storage_power_bounds", "sd", {
    "discharge_lower": "greatest(-discharge, 0)", "discharge_upper": "greatest(discharge - max_discharge, 0)",
    "charge_lower": "greatest(-charge, 0)", "charge_upper": "greatest(charge - max_charge, 0)"}), DISPATCH)
def _(t):
    return out(p.violation_storage_power(stored(t), t.storage()))


PATH = """pt AS (SELECT *, initial_mwh + sum(charge_eff * charge - discharge / discharge_eff) OVER
    (PARTITION BY case_id, pos ORDER BY period) AS energy_mwh FROM sd)"""


@query("storage_energy_path", f"WITH {G}, {PATH} SELECT case_id, pos, period, {r('energy_mwh', 4)} AS energy_mwh FROM pt", DISPATCH)
def _(t):
    path = p.storage_energy_path(stored(t), t.storage(), block=16)
    return path.withColumn("energy_mwh", rounded("energy_mwh", 4))


NULLED = "CASE WHEN (pos + period) % 11 = 0 THEN NULL ELSE charge END"


@query(
    "storage_energy_nulls",
    f"""WITH {G}, moved AS (SELECT *, charge_eff * ({NULLED}) - discharge / discharge_eff AS m FROM sd)
        SELECT case_id, pos, period, CASE WHEN count(*) FILTER (m IS NULL) OVER w = 0
          THEN {r('initial_mwh + sum(m) OVER w', 4)} END AS energy_mwh
        FROM moved WINDOW w AS (PARTITION BY case_id, pos ORDER BY period)""",
    DISPATCH,
)
def _(t):
    """Energy with unknown charges: known before the first of them, unknown from it on."""
    lost = stored(t).withColumn("charge", F.expr(NULLED))
    path = p.storage_energy_path(lost, t.storage(), block=16)
    return path.withColumn("energy_mwh", rounded("energy_mwh", 4))


HALF_PAIRS = """(SELECT now.case_id, now.pos, now.period FROM gd now ANTI JOIN gd b
      ON b.case_id = now.case_id AND b.pos = now.pos AND b.period = now.period - 1
    UNION ALL SELECT b.case_id, b.pos, b.period + 1 FROM gd b ANTI JOIN gd now
      ON b.case_id = now.case_id AND b.pos = now.pos AND b.period = now.period - 1)"""


@query(
    "ramp_gaps",
    f"""WITH {G}, s AS (SELECT case_id, pos, min(period) AS a, max(period) AS z FROM gd GROUP BY ALL)
        SELECT case_id, 'generator_ramping' AS family, side, period, pos AS element, NULL::DOUBLE AS value
        FROM {HALF_PAIRS} JOIN s USING (case_id, pos), (VALUES ('up'), ('down')) AS v(side)
        WHERE period > a AND period <= z""",
    DISPATCH,
)
def _(t):
    return p.ramp_gaps(generated(t))


@query("violation_storage_energy", _sql("storage_energy_bounds", "(SELECT *, initial_mwh + sum(charge_eff * charge - discharge / discharge_eff) OVER (PARTITION BY case_id, pos ORDER BY period) AS e FROM sd)", {
    "lower": "greatest(min_mwh - e, 0)", "upper": "greatest(e - max_mwh, 0)"}), DISPATCH)
def _(t):
    return out(p.violation_storage_energy(p.storage_energy_path(stored(t), t.storage()), t.storage()))


@query(
    "violation_storage_terminal",
    f"""WITH {G} SELECT case_id, 'storage_terminal_energy' AS family, 'equality' AS side, NULL::BIGINT AS period,
        pos AS element, {r('abs(sum(charge_eff * charge - discharge / discharge_eff))', 4)} AS value FROM sd GROUP BY case_id, pos""",
    DISPATCH,
)
def _(t):
    return out(p.violation_storage_terminal(stored(t), t.storage()))


CANON = """ax AS (SELECT case_id, block, row, sum(value * x) AS ax FROM b_coo JOIN b_state_col USING (case_id, col) GROUP BY ALL),
  rw AS (SELECT case_id, block, row, coalesce(ax, 0) - b AS gap FROM b_row LEFT JOIN ax USING (case_id, block, row)),
  bx AS (SELECT case_id, col, greatest(lower - x, 0) + greatest(x - upper, 0) AS v FROM b_col JOIN b_state_col USING (case_id, col)),
  vi AS (SELECT case_id, CASE block WHEN 'A1' THEN 'canonical_equalities' ELSE 'canonical_inequalities' END AS family,
      'row' AS side, NULL::BIGINT AS period, row AS element,
      CASE block WHEN 'A1' THEN abs(gap) ELSE greatest(-gap, 0) END AS value FROM rw
    UNION ALL SELECT case_id, 'canonical_box', 'box', NULL, col, v FROM bx)"""
LP = "b_entry b_coo b_row b_col b_state_col"


@query("violation_canonical", f"WITH {CANON} SELECT case_id, family, side, period, element, {r('value', 4)} AS value FROM vi", LP)
def _(t):
    return out(p.violation_canonical(t.coo(), t.row_vec(), t.col_vec(), t.state_col()))


@query(
    "family_summary",
    f"""WITH {CANON} SELECT case_id, family, count(*) AS checks, {r('max(value)', 4)} AS max_violation,
        5000::DOUBLE AS tolerance, max(value) <= 5000 AS passed FROM vi GROUP BY ALL""",
    LP,
)
def _(t):
    found = p.family_summary(p.violation_canonical(t.coo(), t.row_vec(), t.col_vec(), t.state_col()), 5000.0)
    return found.withColumn("max_violation", rounded("max_violation", 4))


@query(
    "validate_nulls",
    f"""WITH {G}, x AS (SELECT *, CASE WHEN pos % 7 = 3 AND period % 5 = 2 THEN NULL ELSE p_g END AS q FROM gd),
      v AS (SELECT case_id, CASE WHEN q IS NULL THEN NULL ELSE greatest(lower_mw - q, 0) END AS v FROM x
        UNION ALL SELECT case_id, CASE WHEN q IS NULL THEN NULL ELSE greatest(q - upper_mw, 0) END FROM x)
      SELECT case_id, 'generator_bounds' AS family, count(*) AS checks,
        CASE WHEN count(v) = count(*) THEN {r('max(v)', 4)} END AS max_violation, 1e6::DOUBLE AS tolerance,
        count(v) = count(*) AND max(v) <= 1e6 AS passed FROM v GROUP BY 1""",
    DISPATCH,
)
def _(t):
    lost = (F.col("pos") % 7 == 3) & (F.col("period") % 5 == 2)
    dispatch = generated(t).withColumn("p_g", F.when(~lost, F.col("p_g")))
    found = p.family_summary(p.violation_generator_bounds(dispatch, gens(t)), 1e6)
    return found.withColumn("max_violation", rounded("max_violation", 4))


@query(
    "validate_unknown_devices",
    f"""WITH {G}, few AS (SELECT * FROM g WHERE pos % 3 <> 1), m AS (SELECT * FROM gd WHERE pos % 4 <> 2),
      v AS (SELECT case_id, greatest(lower_mw - p_g, 0) AS v FROM m WHERE pos % 3 <> 1
        UNION ALL SELECT case_id, greatest(p_g - upper_mw, 0) FROM m WHERE pos % 3 <> 1
        UNION ALL SELECT case_id, 'infinity'::DOUBLE FROM m WHERE pos % 3 = 1
        UNION ALL SELECT case_id, 'infinity'::DOUBLE FROM few WHERE (case_id, pos) NOT IN (SELECT (case_id, pos) FROM m)),
      e AS (SELECT case_id, 'generator_bounds' AS family, count(*) AS checks, max(v) AS mv FROM v GROUP BY 1
        UNION ALL SELECT DISTINCT case_id, 'no_such_family', 0, NULL FROM g)
      SELECT case_id, family, checks, CASE WHEN isinf(mv) THEN mv ELSE {r('mv', 4)} END AS max_violation,
        1e6::DOUBLE AS tolerance, coalesce(checks > 0 AND mv <= 1e6, false) AS passed FROM e""",
    DISPATCH,
)
def _(t):
    listed = gens(t).where(F.col("pos") % 3 != 1)
    dispatch = generated(t).where(F.col("pos") % 4 != 2)
    found = p.violation_generator_bounds(dispatch, listed).unionByName(
        p.missing_dispatch(listed, dispatch, "generator_bounds")
    )
    cases = gens(t).select("case_id").distinct()
    expected = cases.select("case_id", F.lit("generator_bounds").alias("family")).unionByName(
        cases.select("case_id", F.lit("no_such_family").alias("family"))
    )
    summary = p.family_summary(found, 1e6, expected)
    value = F.when(F.abs("max_violation") < float("inf"), rounded("max_violation", 4))
    return summary.withColumn("max_violation", F.coalesce(value, "max_violation"))


DIRECT = f"""{G}, v AS (SELECT case_id, slope * p_g + constant AS v FROM gd
    UNION ALL SELECT case_id, max_mw - output FROM b_output JOIN b_renewable USING (case_id, pos, period)
    UNION ALL SELECT case_id, discharge * (1 / discharge_eff - 1) + charge * (1 - charge_eff) FROM sd)"""


@query(
    "direct_objective",
    f"WITH {DIRECT} SELECT case_id, {r('sum(v)', 3)} AS direct_objective FROM v GROUP BY 1",
    f"{DISPATCH} b_output b_renewable",
)
def _(t):
    found = p.direct_objective(generated(t), gens(t), produced(t), t.renewable(), stored(t), t.storage())
    return found.withColumn("direct_objective", rounded("direct_objective", 3))


@query(
    "objective_difference",
    f"""WITH {DIRECT}, d AS (SELECT case_id, sum(v) AS a FROM v GROUP BY 1),
        l AS (SELECT l_suppkey % 5 AS case_id, sum(l_quantity) AS b FROM lineitem GROUP BY 1)
        SELECT case_id, {r('abs(a - b)', 3)} AS difference, abs(a - b) <= 1e6 AS passed FROM d JOIN l USING (case_id)""",
    f"{DISPATCH} b_output b_renewable",
)
def _(t):
    direct = p.direct_objective(generated(t), gens(t), produced(t), t.renewable(), stored(t), t.storage())
    other = t.read("lineitem").groupBy((F.col("l_suppkey") % 5).alias("case_id")).agg(F.sum("l_quantity").alias("objective"))
    found = p.objective_difference(direct, other, 1e6)
    return found.select("case_id", rounded("difference", 3).alias("difference"), "passed")


@query(
    "reference_slack",
    f"""WITH {BUS_PERIODS}, tt AS (SELECT case_id, period, -sum(mw) AS adj FROM bp GROUP BY ALL)
        SELECT case_id, bus_id, period, sum(mw) AS mw FROM (SELECT * FROM bp UNION ALL
          SELECT case_id, case_id % 25, period, adj FROM tt) GROUP BY ALL""",
)
def _(t):
    inj = bus_periods(t)
    ref = inj.select("case_id", (F.col("case_id") % 25).alias("ref_bus")).distinct()
    return p.reference_slack(inj, ref)[0]


@query(
    "flow_crosscheck",
    f"""WITH fx AS (SELECT c_custkey % 25 AS case_id, c_custkey % 10 - (1 + period / 10) * c_acctbal AS a,
          c_custkey % 10 - (1 + period / 10) * round(c_acctbal) AS b FROM customer, range(4) AS p(period))
        SELECT case_id, {r('max(abs(a - b))')} AS max_diff FROM fx GROUP BY 1""",
)
def _(t):
    first = fixed(t)
    key = F.col("c_custkey")
    rounded_flow = t._periods(t.read("customer")).select(
        (key % 25).alias("case_id"), key.alias("branch_id"), "period",
        ((key % 10) - (1 + F.col("period") / 10) * F.round("c_acctbal")).alias("mw"),
    )
    found = p.flow_crosscheck(first, rounded_flow, ["case_id", "branch_id", "period"])
    return found.withColumn("max_diff", rounded("max_diff"))


@query(
    "candidate_acceptance",
    """WITH s AS (SELECT o_orderkey, o_custkey % 5 <> 0 AS f, o_orderstatus <> 'P' AS st, o_totalprice <= 250000 AS k,
         o_custkey % 100 <= 90 AS v, o_orderkey % 7 <> 3 AS av, o_orderkey % 4 <> 1 AS ph,
         CASE WHEN o_custkey % 2 = 0 THEN true ELSE abs(o_totalprice - 100000) / 100000 <= 0.5 END AS g FROM orders)
       SELECT o_orderkey, list_filter([CASE WHEN NOT f THEN 'finite' END, CASE WHEN NOT st THEN 'paper_stopping_satisfied' END,
         CASE WHEN NOT k THEN 'raw_kkt_within_tolerance' END, CASE WHEN NOT v THEN 'canonical_primal_within_tolerance' END,
         CASE WHEN NOT av THEN 'physical_validation_available' END, CASE WHEN NOT ph THEN 'physical_validation_passed' END,
         CASE WHEN NOT g THEN 'objective_gap_within_tolerance' END], lambda r: r IS NOT NULL) AS failed,
         f AND st AND k AND v AND av AND ph AND g AS passed FROM s""",
)
def _(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    summaries = t.read("orders").select(
        "o_orderkey", (cust % 5 != 0).alias("finite"), (F.col("o_orderstatus") != "P").alias("stopping_satisfied"),
        F.col("o_totalprice").alias("kkt_combined_norm"), (cust % 100).alias("max_canonical_violation"),
        (key % 7 != 3).alias("physical_available"), (key % 4 != 1).alias("physical_passed"),
        F.col("o_totalprice").alias("objective"),
        F.when(cust % 2 != 0, 100000.0).alias("reference_objective"),
    )
    found = p.candidate_acceptance(summaries, 250000.0, 90.0, 0.5)
    return found.select("o_orderkey", "failed", "passed")
