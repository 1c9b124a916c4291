"""Rejected rows and failed checks."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import quality as q
from .registry import query


@query(
    "reject_nonfinite",
    """SELECT event_id, ['ratio'] AS reasons FROM events WHERE NOT (user_id % 7 <> 0 AND value IS NOT NULL)""",
)
def _(t):
    ratio = F.when(F.col("user_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    _, rejects = q.reject_nonfinite(t.read("events").withColumn("ratio", ratio), ["ratio"])
    return rejects.select("event_id", "reasons")


@query(
    "reject_noninteger",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       WHERE abs(l_extendedprice - round(l_extendedprice)) > 1e-9""",
)
def _(t):
    bad = q.reject_noninteger(t.read("lineitem"), ["l_quantity", "l_extendedprice"])
    return bad.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "require_min_columns",
    """SELECT source AS case_id, 'text' AS section, doc_id AS row_number,
       len(string_split(text, ' '))::INTEGER AS received, 40 AS required FROM documents
       WHERE len(string_split(text, ' ')) < 40""",
)
def _(t):
    words = t.read("documents").select(
        F.col("source").alias("case_id"),
        F.lit("text").alias("section"),
        F.col("doc_id").alias("row_number"),
        F.split("text", " ").alias("vals"),
    )
    return q.require_min_columns(words, {"text": 40})


@query(
    "check_cost_arity",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 NOT IN (1, 2) THEN 'unsupported_model'
         ELSE 'parameter_count' END AS reason FROM supplier
       WHERE s_suppkey % 4 NOT IN (1, 2) OR 2 <> CASE WHEN s_suppkey % 4 = 2 THEN 1 + s_nationkey % 2
         ELSE 2 * (1 + s_nationkey % 2) END""",
)
def _(t):
    costs = t.read("supplier").select(
        "s_suppkey",
        (F.col("s_suppkey") % 4).alias("model"),
        (1 + F.col("s_nationkey") % 2).alias("n"),
        F.array("s_acctbal", "s_acctbal").alias("parameters"),
    )
    return q.check_cost_arity(costs).select("s_suppkey", "reason")


@query(
    "check_unique_keys",
    """SELECT l_orderkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def _(t):
    return q.check_unique_keys(t.read("lineitem"), ["l_orderkey", "l_suppkey"])


@query(
    "check_foreign_keys",
    """SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(t):
    bad = q.check_foreign_keys(t.read("documents"), t.read("labels"), [("doc_id", "doc_id")])
    return bad.select("doc_id", "lang")


@query(
    "check_bounds_order",
    """SELECT l_suppkey, count(*) AS violations, min(l_orderkey) AS first_position FROM lineitem
       WHERE l_discount > l_tax GROUP BY 1""",
)
def _(t):
    return q.check_bounds_order(
        t.read("lineitem"), "l_discount", "l_tax", ["l_suppkey"], "l_orderkey"
    )


@query(
    "check_single_reference",
    """SELECT c_custkey % 40 AS case_id, count(*) FILTER (c_nationkey = 0) AS "references" FROM customer
       GROUP BY 1 HAVING count(*) FILTER (c_nationkey = 0) <> 1""",
)
def _(t):
    bus = t.read("customer").select(
        (F.col("c_custkey") % 40).alias("case_id"),
        F.when(F.col("c_nationkey") == 0, 3).otherwise(1).alias("bus_type"),
    )
    return q.check_single_reference(bus)


@query(
    "check_storage",
    """SELECT s_suppkey, list_filter([
         CASE WHEN s_acctbal < 0 OR s_acctbal > 5000 THEN 'initial_energy_outside_bounds' END,
         CASE WHEN s_nationkey < 5 THEN 'negative_power' END,
         CASE WHEN s_nationkey > 10 THEN 'charge_efficiency' END,
         CASE WHEN s_suppkey % 3 = 0 THEN 'unlabelled_extension' END], lambda r: r IS NOT NULL) AS reasons
       FROM supplier WHERE s_acctbal < 0 OR s_acctbal > 5000 OR s_nationkey < 5 OR s_nationkey > 10
         OR s_suppkey % 3 = 0""",
)
def _(t):
    store = t.read("supplier").select(
        "s_suppkey",
        (F.col("s_suppkey") % 3).alias("case_id"),
        F.col("s_acctbal").alias("initial_mwh"),
        F.lit(0.0).alias("min_mwh"),
        F.lit(5000.0).alias("max_mwh"),
        (F.col("s_nationkey") - 5).alias("max_charge"),
        F.lit(1.0).alias("max_discharge"),
        ((F.col("s_nationkey") + 1) / 11).alias("charge_eff"),
        F.lit(0.9).alias("discharge_eff"),
    )
    config = store.select("case_id", (F.col("case_id") > 0).alias("synthetic_extension")).distinct()
    return q.check_storage(store, config).select("s_suppkey", "reasons")


@query(
    "check_branch_parameters",
    """SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_discount < 0.02 THEN 'reactance' END,
         CASE WHEN l_tax - 0.04 <= 0 AND abs(l_tax - 0.04) > 1e-8 THEN 'tap' END,
         CASE WHEN l_quantity < 10 THEN 'negative_rate' END,
         CASE WHEN l_linenumber = 3 THEN 'angle_limit' END], lambda r: r IS NOT NULL) AS reasons
       FROM lineitem WHERE l_returnflag <> 'R' AND (l_discount < 0.02
         OR (l_tax - 0.04 <= 0 AND abs(l_tax - 0.04) > 1e-8) OR l_quantity < 10 OR l_linenumber = 3)""",
)
def _(t):
    line = t.read("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_returnflag") != "R").alias("status"),
        F.col("l_discount").alias("reactance"),
        (F.col("l_tax") - 0.04).alias("tap"),
        (F.col("l_quantity") - 10).alias("rate_mw"),
        F.lit(-360.0).alias("angle_min"),
        F.when(F.col("l_linenumber") == 3, 30.0).otherwise(360.0).alias("angle_max"),
    )
    return q.check_branch_parameters(line, 0.02).select("l_orderkey", "l_linenumber", "reasons")


@query(
    "cases_without_limited_branch",
    """SELECT l_orderkey AS case_id, 0::BIGINT AS limited FROM lineitem GROUP BY 1
       HAVING count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 30) = 0""",
)
def _(t):
    line = t.read("lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        (F.col("l_returnflag") != "R").alias("status"),
        (F.col("l_quantity") - 30).alias("rate_mw"),
    )
    return q.cases_without_limited_branch(line)


@query(
    "check_population",
    """WITH c AS (SELECT c_nationkey AS case_id, count(*) AS n FROM customer GROUP BY 1),
       s AS (SELECT s_nationkey AS case_id, count(*) AS n FROM supplier GROUP BY 1),
       o AS (SELECT c_nationkey AS case_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
             GROUP BY 1)
       SELECT n_nationkey AS case_id, 60::BIGINT AS expected_buses, 600::BIGINT AS expected_branches,
         4::BIGINT AS expected_generators, coalesce(c.n, 0) AS buses, coalesce(o.n, 0) AS branches,
         coalesce(s.n, 0) AS generators
       FROM nation LEFT JOIN c ON c.case_id = n_nationkey LEFT JOIN s ON s.case_id = n_nationkey
       LEFT JOIN o ON o.case_id = n_nationkey
       WHERE coalesce(c.n, 0) <> 60 OR coalesce(o.n, 0) <> 600 OR coalesce(s.n, 0) <> 4""",
)
def _(t):
    customer = t.read("customer").withColumn("case_id", F.col("c_nationkey"))
    orders = t.read("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    supplier = t.read("supplier").withColumn("case_id", F.col("s_nationkey"))
    spec = t.read("nation").select(
        F.col("n_nationkey").alias("case_id"),
        F.lit(60).cast("bigint").alias("buses"),
        F.lit(600).cast("bigint").alias("branches"),
        F.lit(4).cast("bigint").alias("generators"),
    )
    return q.check_population(customer, orders, supplier, spec)


@query(
    "contract_drift",
    """WITH e AS (SELECT event_id, (props->'$.k')::VARCHAR AS a, (event_id % 100)::VARCHAR AS x FROM events)
       SELECT event_id, 'k' AS key, a AS actual, x AS expected FROM e WHERE a IS DISTINCT FROM x
       UNION ALL SELECT event_id, 'mode', NULL, '{"a":[1,2.5],"b":"1"}' FROM e
       UNION ALL SELECT event_id, 'gone', NULL, 'null' FROM e WHERE event_id % 7 = 0""",
)
def _(t):
    """Expected numbers are written as 12.0, nested keys out of order, some keys hold null."""
    events = t.read("events")
    actual = events.select("event_id", F.col("props").alias("document"))
    gone = F.when(F.col("event_id") % 7 == 0, ',"gone":null').otherwise("")
    expected = events.select(
        "event_id",
        F.concat(
            F.lit('{"mode":{"b":"1","a":[1.0,2.50]},"k":'),
            (F.col("event_id") % 100).cast("string"),
            F.lit(".0"),
            gone,
            F.lit("}"),
        ).alias("document"),
    )
    return q.contract_drift(actual, expected, ["event_id"])


@query(
    "reject_nonlinear_cost",
    """SELECT p_partkey FROM part WHERE p_partkey % 3 = 2 AND p_size % 5 <> 0""",
)
def _(t):
    costs = t.read("part").select(
        "p_partkey",
        (F.col("p_partkey") % 3).alias("model"),
        F.array((F.col("p_size") % 5).cast("double"), "p_retailprice", F.lit(3.0)).alias("parameters"),
    )
    return q.reject_nonlinear_cost(costs).select("p_partkey")


@query(
    "check_required_fields",
    """SELECT event_type, count(*) AS rows, count(*) FILTER (user_id % 10 = 0) AS missing,
         count(*) FILTER (user_id % 10 <> 0 AND (value < 0 OR value > 20)) AS out_of_range,
         bool_and(user_id % 10 <> 0 AND value BETWEEN 0 AND 20) AS passed FROM events GROUP BY 1""",
)
def _(t):
    events = t.read("events").withColumn(
        "residual", F.when(F.col("user_id") % 10 != 0, F.col("value"))
    )
    return q.check_required_fields(
        events, ["event_type"], ["residual", "ts"], {"residual": (0.0, 20.0)}
    )
