"""Timing statistics over events and comparisons of the bound vectors."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import benchstats as b
from ..session import spread
from .registry import query, r

STATS = f"""SELECT run, count(*) AS count, {r('quantile_cont(wall_seconds, 0.5)')} AS median_seconds,
    {r('min(wall_seconds)')} AS minimum_seconds, {r('max(wall_seconds)')} AS maximum_seconds,
    {r('coalesce(stddev_samp(wall_seconds), 0)')} AS standard_deviation_seconds,
    {r('quantile_cont(wall_seconds, 0.75) - quantile_cont(wall_seconds, 0.25)')} AS interquartile_range_seconds,
    {r('(max(wall_seconds) - min(wall_seconds)) / greatest(quantile_cont(wall_seconds, 0.5), 1e-300)')} AS relative_range"""


def short(df):
    return df.select("run", "count", *[rounded(n).alias(n) for n in b.STATISTICS])


def runs(t):
    return t.timing().select("run").distinct()


def _stats_sql(where):
    return f"""WITH s AS ({STATS} FROM b_timing WHERE {where} GROUP BY 1)
    SELECT run, coalesce(count, 0) AS count, median_seconds, minimum_seconds, maximum_seconds,
      standard_deviation_seconds, interquartile_range_seconds, relative_range
    FROM (SELECT DISTINCT run FROM b_timing) LEFT JOIN s USING (run)"""


@query("timing_statistics", _stats_sql("passed"), "b_timing")
def _(t):
    timing = t.timing()
    return short(b.timing_statistics(timing.where(F.col("passed")), runs(t)))


@query("timing_statistics_spread", _stats_sql("true"), "b_timing")
def _(t):
    """The same statistics by the path for runs too large for one buffer."""
    return short(b.timing_statistics(t.timing(), runs(t)))


@query(
    "percentile_linear",
    f"SELECT event_type, {r('quantile_cont(value, 0.9)')} AS percentile FROM events GROUP BY 1",
)
def _(t):
    found = b.percentile_linear(t.read("events"), "value", 0.9, ["event_type"])
    return found.withColumn("percentile", rounded("percentile"))


@query(
    "timing_distribution",
    f"""WITH m AS (SELECT run, quantile_cont(wall_seconds, 0.5) AS md FROM b_timing GROUP BY 1)
    SELECT run, {r('quantile_cont(wall_seconds, 0.25)')} AS first_quartile, {r('any_value(md)')} AS median,
      {r('quantile_cont(wall_seconds, 0.75)')} AS third_quartile, {r('min(wall_seconds)')} AS minimum,
      {r('max(wall_seconds)')} AS maximum, {r('quantile_cont(abs(wall_seconds - md), 0.5)')} AS median_absolute_deviation
    FROM b_timing JOIN m USING (run) GROUP BY 1""",
    "b_timing",
)
def _(t):
    names = ("first_quartile", "median", "third_quartile", "minimum", "maximum", "median_absolute_deviation")
    found = b.timing_distribution(t.timing())
    return found.select("run", *[rounded(n).alias(n) for n in names])


SELECTED = """rk AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY repetition) - 1 AS k FROM b_timing),
  f AS (SELECT run, count(*) AS n, min(k) FILTER (NOT passed) AS bad,
     (max(wall_seconds) FILTER (k < 5) - min(wall_seconds) FILTER (k < 5))
       / greatest(quantile_cont(wall_seconds, 0.5) FILTER (k < 5), 1e-300) AS rr FROM rk WHERE k < 9 GROUP BY 1),
  s AS (SELECT run, n >= 5 AND rr > 0.9 AS escalated, CASE WHEN n >= 5 AND rr > 0.9 THEN 9 ELSE 5 END AS target, n, bad FROM f),
  d AS (SELECT run, escalated, target, CASE WHEN right(run, 1) = '7' THEN 'NOT_RUN_CORRECTNESS_FAILED'
     WHEN bad < target THEN 'FAILED' WHEN n < target THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status FROM s)"""


def correctness(t):
    return runs(t).withColumn("passed", ~F.col("run").endswith("7"))


@query(
    "select_measured_runs",
    f"""WITH {SELECTED} SELECT rk.run, repetition, passed, wall_seconds FROM rk JOIN d USING (run)
        WHERE status = 'COMPLETE' AND k < target""",
    "b_timing",
)
def _(t):
    return b.select_measured_runs(t.timing(), correctness(t), threshold=0.9)[0]


@query("measured_run_status", f"WITH {SELECTED} SELECT run, escalated, status FROM d", "b_timing")
def _(t):
    return b.select_measured_runs(t.timing(), correctness(t), threshold=0.9)[1]


@query(
    "audit_statistics",
    """WITH n AS (SELECT DISTINCT run FROM b_timing) SELECT run, CASE WHEN right(run, 1) = '3' THEN ['median_seconds']
         WHEN right(run, 1) = '4' THEN ['count', 'relative_range'] ELSE []::VARCHAR[] END AS differences,
         right(run, 1) NOT IN ('3', '4') AS passed FROM n""",
    "b_timing",
)
def _(t):
    """Some stored statistics are tampered with; the audit must name them."""
    stats = b.timing_statistics(t.timing(), runs(t))
    three, four = F.col("run").endswith("3"), F.col("run").endswith("4")
    stored = (
        stats.withColumn("median_seconds", F.when(three, F.col("median_seconds") + 1).otherwise(F.col("median_seconds")))
        .withColumn("count", F.when(four, F.col("count") + 1).otherwise(F.col("count")))
        .withColumn("relative_range", F.when(four, F.col("relative_range") + 1).otherwise(F.col("relative_range")))
    )
    return b.audit_statistics(stats, stored)


@query(
    "log_log_fit",
    f"""WITH p AS (SELECT l_returnflag AS phase, ln(l_quantity) AS x, ln(l_extendedprice) AS y, l_extendedprice / l_quantity AS rt
          FROM lineitem), f AS (SELECT phase, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_r2(y, x) AS r2,
          max(rt) / min(rt) AS sp FROM p GROUP BY 1)
        SELECT phase, {r('s')} AS slope, {r('i')} AS intercept, {r('r2')} AS r_squared, {r('sp', 4)} AS spread,
          s BETWEEN 0.6 AND 1.4 AND r2 >= 0.85 AND sp <= 4 AS passed FROM f""",
)
def _(t):
    points = t.read("lineitem").select(
        F.col("l_returnflag").alias("phase"), F.col("l_quantity").alias("work"), F.col("l_extendedprice").alias("seconds")
    )
    fit = b.log_log_fit(points, ["phase"])
    return fit.select(
        "phase", rounded("slope").alias("slope"), rounded("intercept").alias("intercept"),
        rounded("r_squared").alias("r_squared"), rounded("spread", 4).alias("spread"), "passed",
    )


@query(
    "log_log_fit_rejected",
    """SELECT l_linenumber AS phase, count(*) FILTER (l_quantity <= l_linenumber) AS bad_points,
         count(*) FILTER (l_quantity <= l_linenumber) = 0 AS whole
       FROM lineitem GROUP BY 1""",
)
def _(t):
    """Some points have no logarithm: their groups are rejected and count them."""
    points = t.read("lineitem").select(
        F.col("l_linenumber").alias("phase"),
        (F.col("l_quantity") - F.col("l_linenumber")).alias("work"),
        F.col("l_extendedprice").alias("seconds"),
    )
    fit = b.log_log_fit(points, ["phase"])
    return fit.select("phase", "bad_points", F.col("slope").isNotNull().alias("whole"))


@query(
    "speedup",
    f"""WITH m AS (SELECT user_id AS phase, event_type AS backend, quantile_cont(value, 0.5) AS md FROM events GROUP BY ALL)
        SELECT phase, {r("max(md) FILTER (backend = 'error') / max(md) FILTER (backend = 'click')")} AS speedup FROM m GROUP BY 1""",
)
def _(t):
    from ..functions.ordered import exact_quantiles

    timing = t.read("events").select(F.col("user_id").alias("phase"), F.col("event_type").alias("backend"), "value")
    medians = exact_quantiles(timing, ["phase", "backend"], "value", {"median": 0.5})
    found = b.speedup(medians, "error", "click")
    return found.withColumn("speedup", rounded("speedup"))


@query(
    "scaled_gap",
    "SELECT o_orderkey, abs(o_totalprice - o_custkey) / greatest(1, abs(o_custkey)) AS gap FROM orders",
)
def _(t):
    found = b.scaled_gaps(t.read("orders"), "o_totalprice", "o_custkey")
    return found.select("o_orderkey", "gap")


PAIR = """pr AS (SELECT case_id, col, x AS a, x + col % 3 - 1 AS b FROM b_state_col)"""


def vectors(t):
    a = t.state_col().select("case_id", "col", F.col("x").alias("value"))
    return a, a.withColumn("value", F.col("value") + F.col("col") % 3 - 1)


@query(
    "relative_error",
    f"""WITH {PAIR} SELECT case_id, {r('sqrt(sum((a-b)^2)) / greatest(1, sqrt(sum(b^2)))', 9)} AS scaled_error,
        {r('sqrt(sum((a-b)^2)) / sqrt(sum(b^2))', 9)} AS relative_error FROM pr GROUP BY 1""",
    "b_state_col",
)
def _(t):
    found = b.relative_error(*vectors(t), ["case_id", "col"], "value")
    return found.select("case_id", *[rounded(n, 9).alias(n) for n in ("scaled_error", "relative_error")])


@query(
    "compare_vectors",
    f"""WITH {PAIR} SELECT case_id, true AS shape_matches, true AS finite,
        {r('sqrt(sum((a-b)^2)) / greatest(1, sqrt(sum(b^2)))', 9)} AS relative_error,
        {r('max(abs(a-b))', 9)} AS maximum_absolute_error, false AS passed FROM pr GROUP BY 1""",
    "b_state_col",
)
def _(t):
    found = b.compare_vectors(*vectors(t), ["case_id", "col"], "value", ["case_id"], 1e-3, 0.5)
    names = ("relative_error", "maximum_absolute_error")
    return found.select("case_id", "shape_matches", "finite", *[rounded(n, 9).alias(n) for n in names], "passed")


@query(
    "compare_states",
    f"""WITH p AS (SELECT case_id, 'x' AS block, x AS a, x + col % 3 AS b FROM b_state_col
          UNION ALL SELECT case_id, 'z', z, z FROM b_state_col UNION ALL SELECT case_id, 'y', y, y * 2 FROM b_state_row),
        e AS (SELECT case_id, block, sqrt(sum((a-b)^2)) / greatest(1, sqrt(sum(b^2))) AS rel, max(abs(a-b)) AS mx FROM p GROUP BY ALL)
        SELECT case_id, {r('max(rel)', 9)} AS maximum_relative_error, {r('max(mx)', 9)} AS maximum_absolute_error,
          bool_and(rel <= 0.6) AS passed FROM e GROUP BY 1""",
    "b_state_col b_state_row",
)
def _(t):
    def long(col, row):
        pairs = F.array(*[F.struct(F.lit(n).alias("block"), F.col(n).alias("value")) for n in ("x", "z")])
        left = col.select("case_id", F.explode(pairs).alias("p"), F.col("col").alias("position"))
        left = left.select("case_id", "p.block", "position", "p.value")
        right = row.select("case_id", F.lit("y").alias("block"), F.col("row").alias("position"), F.col("y").alias("value"))
        return left.unionByName(right)

    col, row = t.state_col(), t.state_row()
    second = long(col.withColumn("x", F.col("x") + F.col("col") % 3), row.withColumn("y", F.col("y") * 2))
    found = b.compare_states(long(col, row), second, 0.6)
    names = ("maximum_relative_error", "maximum_absolute_error")
    return found.select("case_id", *[rounded(n, 9).alias(n) for n in names], "passed")


@query(
    "solution_error_metrics",
    f"""WITH gm AS (SELECT l_suppkey % 5 AS case_id, l_orderkey AS r1, l_suppkey AS r2, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
        cd AS (SELECT s_suppkey % 5 AS case_id, s_suppkey AS row, s_acctbal / 1000 AS c, s_nationkey::DOUBLE AS d FROM supplier),
        er AS (SELECT case_id, sqrt(sum((c-d)^2)) AS l2, max(abs(c-d)) AS mx, sqrt(sum(d^2)) AS nd, max(abs(d)) AS md FROM cd GROUP BY 1),
        pr AS (SELECT gm.case_id, r1 AS row, sum(v * c) AS p FROM gm JOIN cd ON gm.case_id = cd.case_id AND r2 = cd.row GROUP BY ALL),
        rh AS (SELECT case_id, l_orderkey AS row, count(*)::DOUBLE AS b FROM (SELECT l_suppkey % 5 AS case_id, l_orderkey FROM lineitem) GROUP BY ALL),
        rs AS (SELECT case_id, sqrt(sum((p - b)^2)) / greatest(1, sqrt(sum(b^2))) AS res FROM pr JOIN rh USING (case_id, row) GROUP BY 1)
      SELECT case_id, {r('l2')} AS absolute_error_l2, {r('mx')} AS maximum_component_error, {r('l2 / nd')} AS relative_solution_error,
        {r('l2 / greatest(1, nd)')} AS scaled_solution_error, {r('mx / greatest(1, md)')} AS scaled_component_error,
        {r('res', 4)} AS normalized_system_residual FROM er JOIN rs USING (case_id)""",
)
def _(t):
    case = (F.col("l_suppkey") % 5).alias("case_id")
    line = t.read("lineitem").select(case, F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("r2"), "l_quantity")
    line = spread(line, "case_id", "row")
    gram = line.groupBy("case_id", F.col("row").alias("r1"), "r2").agg(F.sum("l_quantity").alias("value"))
    rhs = line.groupBy("case_id", "row").agg(F.count("*").cast("double").alias("value"))
    vec = t.read("supplier").select(
        (F.col("s_suppkey") % 5).alias("case_id"), F.col("s_suppkey").alias("row"),
        (F.col("s_acctbal") / 1000).alias("c"), F.col("s_nationkey").cast("double").alias("d"),
    )
    found = b.solution_error_metrics(
        gram, rhs, vec.withColumnRenamed("c", "value"), vec.withColumnRenamed("d", "value")
    )
    return found.select(
        "case_id", *[rounded(n).alias(n) for n in ("absolute_error_l2", "maximum_component_error", "relative_solution_error", "scaled_solution_error", "scaled_component_error")],
        rounded("normalized_system_residual", 4).alias("normalized_system_residual"),
    )


def evidence(t):
    """Nested evidence: an order is a case, its status says which tracks were recorded."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    none_d, none_l = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    track = F.struct(
        F.lit("COMPLETE").alias("timing_status"),
        F.struct(
            F.when(key % 5 == 0, "TIME_LIMIT").when(key % 5 != 4, "SUCCESS").alias("status"), price.alias("wall_seconds"),
            (key % 300).alias("iterations"), (key % 4).alias("restart_count"),
            F.struct(
                price.alias("objective"), none_d.alias("scaled_objective_gap_to_highs"),
                F.struct((price / 10).alias("kkt_combined_norm")).alias("residuals"),
                F.struct(none_d.alias("maximum_violation")).alias("physical_validation"),
            ).alias("candidate"),
        ).alias("correctness"),
        F.struct(
            (key % 9).alias("count"), price.alias("median_seconds"), none_d.alias("minimum_seconds"),
            none_d.alias("maximum_seconds"), none_d.alias("standard_deviation_seconds"),
            none_d.alias("interquartile_range_seconds"), none_d.alias("relative_range"),
        ).alias("statistics"),
    )
    tracks = F.map_from_arrays(
        F.when(F.col("o_orderstatus") == "P", F.array(F.lit("highs"))).otherwise(
            F.array(F.lit("highs"), F.lit("cpu_fp64_sgs_hpr"))
        ),
        F.when(F.col("o_orderstatus") == "P", F.array(track)).otherwise(F.array(track, track)),
    )
    case = F.struct(
        F.concat(F.lit("case"), key).alias("key"), none_l.alias("sequence"), F.col("o_orderstatus").alias("status"),
        F.lit(None).cast("boolean").alias("full_lp_allocation_attempted"),
        F.struct(F.struct(key.alias("m"), (key * 2).alias("n"), (key * 3).alias("nnz_A")).alias("dimensions")).alias("construction"),
        F.struct((key * 4).alias("published_nnz")).alias("structural_reconciliation"),
        tracks.alias("solver_tracks"),
    )
    return t.read("orders").select(F.lit(7).cast("bigint").alias("stage"), F.array(case).alias("cases"))


STATUS = "CASE WHEN o_orderkey % 5 = 0 THEN 'TIME_LIMIT' WHEN o_orderkey % 5 <> 4 THEN 'SUCCESS' ELSE 'COMPLETE' END"


@query(
    "track_summary",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'NOT_RUN' ELSE {STATUS} END AS status,
        CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS median_seconds,
        CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 = 0 THEN o_totalprice END AS timeout_seconds,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 9 END AS measured_repetitions FROM orders""",
)
def _(t):
    cases = evidence(t).select(F.col("cases")[0].alias("c")).select(
        F.col("c.construction.dimensions.m").alias("o_orderkey"),
        F.element_at("c.solver_tracks", "cpu_fp64_sgs_hpr").alias("track"),
    )
    flat = b.track_summary(cases, ["o_orderkey"])
    return flat.select("o_orderkey", "status", "median_seconds", "timeout_seconds", "measured_repetitions")


@query(
    "benchmark_table",
    f"""SELECT 'case' || o_orderkey AS case_key, o_orderkey AS m, {r('CASE WHEN o_orderkey <> 0 THEN -25 END', 4)} AS nnz_difference_pct,
        true AS full_lp_allocated, {STATUS} AS highs_status, CASE WHEN o_orderstatus = 'P' THEN 'NOT_RUN' ELSE {STATUS} END AS cpu_status,
        'NOT_RUN' AS gpu_status, o_totalprice AS highs_median_seconds,
        CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 = 0 THEN o_totalprice END AS cpu_timeout_seconds FROM orders""",
)
def _(t):
    wide = b.benchmark_table(evidence(t))
    return wide.select(
        "case_key", "m", rounded("nnz_difference_pct", 4).alias("nnz_difference_pct"), "full_lp_allocated", "highs_status",
        "cpu_status", "gpu_status", "highs_median_seconds", "cpu_timeout_seconds",
    )


@query(
    "timing_decomposition",
    """SELECT o_orderkey, i AS position, b AS boundary, CASE WHEN i < 2 THEN o_totalprice + i END AS seconds,
         CASE WHEN i < 2 THEN 'MEASURED' END AS status FROM orders,
         (VALUES (0, 'CPU matrix construction and preprocessing'), (1, 'iteration loop'), (2, 'residual checks')) AS o(i, b)""",
)
def _(t):
    def cell(plus):
        return F.struct(
            (F.col("o_totalprice") + plus).alias("seconds"), F.lit("MEASURED").alias("status"), F.col("o_orderkey").cast("string").alias("method")
        )

    order = ["CPU matrix construction and preprocessing", "iteration loop", "residual checks"]
    boundaries = F.create_map(F.lit(order[0]), cell(0), F.lit(order[1]), cell(1), F.lit("other"), cell(2))
    docs = t.read("orders").select("o_orderkey", F.struct(boundaries.alias("boundaries")).alias("timing_boundaries"))
    return b.timing_decomposition(docs, order, ["o_orderkey"]).drop("method")
