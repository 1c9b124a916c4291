"""Sources and sinks: data derived from the tables is written, read back and compared."""

import uuid

from pyspark.sql import functions as F

from ..operators import derive as d
from ..schemas import EVIDENCE, OPERATING_CONFIG, with_corrupt
from ..session import shared_folder, spread
from ..sources import casefiles, configs, tables
from ..streaming.runlog_stream import stream_run_log
from .derived_queries import FAMILY, dims
from .registry import query, r
from .runlogs_queries import POL, policy, trajectory
from .statistics_queries import evidence


def fresh(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def case_text(t):
    """A small case text per order; some have a comment, a continuation or a word in a row."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    row = F.format_string("%d 3 %.2f 0 1.5 0 1 1 0 1 1 1 1", key, price)
    body = (
        F.when(key % 7 == 3, F.concat(row, F.lit(" ...")))
        .when(key % 7 == 5, F.concat(F.lit("x"), row))
        .otherwise(F.concat(row, F.lit("; % note ; ] ;\n\t2, 1, 5, 0, 0.5, 0, 1, 1, 0, 1, 1, 1, 1")))
    )
    text = F.concat(
        F.lit("function mpc = grid"), key, F.lit("\nmpc.baseMVA = 100;\nmpc.bus = [\n\t"), body,
        F.lit(";\n];\nmpc.gen = [ 2 0 0 0 0 1 100 1 50 10 ];\nmpc.branch = [1 2 0 0.1 0 40 0 0 0 0 1];\n"),
        F.lit("mpc.gencost = [2 0 0 2 14 7];\n"),
    )
    orders = spread(t.read("orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return orders.select(F.concat(F.lit("/in/order"), key, F.lit(".m")).alias("path"), text.alias("value"))


@query(
    "read_case_text",
    f"""SELECT '/in/order' || o_orderkey || '.m' AS case_id, o_orderkey AS bus_id, 0::BIGINT AS bus_pos, 3 AS bus_type,
          {r('o_totalprice', 2)} AS demand_mw, 1.5::DOUBLE AS shunt_mw FROM orders WHERE o_orderkey % 7 NOT IN (3, 5)
        UNION ALL SELECT '/in/order' || o_orderkey || '.m', 2, 1, 1, 5, 0.5 FROM orders WHERE o_orderkey % 7 NOT IN (3, 5)""",
)
def _(t):
    return casefiles.parse_case_text(case_text(t)).bus


@query(
    "case_text_rejects",
    """SELECT '/in/order' || o_orderkey || '.m' AS case_id, 'bus' AS section, 1 AS row_number,
         CASE o_orderkey % 7 WHEN 3 THEN 'continuation' ELSE 'nonnumeric' END AS reason FROM orders WHERE o_orderkey % 7 IN (3, 5)""",
)
def _(t):
    return casefiles.parse_case_text(case_text(t)).rejects


@query(
    "case_scalar",
    "SELECT '/in/order' || o_orderkey || '.m' AS path, 100::DOUBLE AS base_mva FROM orders",
)
def _(t):
    return casefiles.case_scalar(case_text(t)).select("path", "base_mva")


@query("case_name", "SELECT '/in/order' || o_orderkey || '.m' AS path, 'grid' || o_orderkey AS name FROM orders")
def _(t):
    return casefiles.case_name(case_text(t)).select("path", "name")


@query(
    "read_operating_config",
    """SELECT 's' || s_suppkey AS case_id, p::BIGINT AS period, (s_suppkey % 3 + p)::DOUBLE AS multiplier, abs(s_acctbal) AS reserve_up,
         0::DOUBLE AS reserve_down FROM supplier, range(2) AS t(p) WHERE s_nationkey <> 3""",
)
def _(t):
    """One configuration document per supplier; one nation's declare a wrong horizon."""
    size = F.abs("s_acctbal")
    raw = t.read("supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("case_id"),
        F.to_json(
            F.struct(
                F.lit("n").alias("name"), F.lit("c").alias("classification"), F.lit(False).alias("synthetic_extension"),
                F.when(F.col("s_nationkey") == 3, 5).otherwise(2).alias("periods"), F.lit(1.0).alias("interval_hours"),
                F.array(F.col("s_suppkey") % 3, F.col("s_suppkey") % 3 + 1).alias("load_multipliers"),
                F.array(size, size).alias("reserve_up_mw"), F.array(F.lit(0.0), F.lit(0.0)).alias("reserve_down_mw"),
                F.array(size).alias("generator_ramp_up_mw_per_hour"), F.array(size).alias("generator_ramp_down_mw_per_hour"),
            )
        ).alias("text"),
    )
    parsed = raw.select("case_id", F.from_json("text", with_corrupt(OPERATING_CONFIG)).alias("c")).select("case_id", "c.*")
    return configs.unfold_config(parsed).period_profile


@query("table_csv", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(t):
    df = t.read("orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = fresh(t, "csv")
    tables.write_table_csv(df, path)
    return tables.read_table_csv(t.spark, path, df.schema)


@query("write_row_metadata", f"WITH {FAMILY} SELECT count(*) AS written, count(*) AS read FROM crow", "b_gen b_renewable")
def _(t):
    path = fresh(t, "rows")
    rows = d.expand_row_families(d.row_families(dims(t)))
    written = tables.write_row_metadata(rows, path)
    back = t.spark.read.schema(rows.schema).json(path)
    return back.agg(F.count("*").alias("read")).withColumn("written", F.lit(written).cast("bigint"))


@query(
    "run_log_round_trip",
    """SELECT record_type, run, count(*) AS rows FROM (SELECT 'trajectory' AS record_type, event_type AS run FROM events
       UNION ALL SELECT 'policy_event', 'r' FROM events) GROUP BY ALL""",
)
def _(t):
    path = fresh(t, "log")
    tables.write_run_log(trajectory(t), policy(t), path)
    rows, _ = tables.read_run_log(t.spark, path)
    return rows.groupBy("record_type", "run").agg(F.count("*").alias("rows"))


@query(
    "read_evidence_json",
    "SELECT 'case' || o_orderkey AS key, o_orderkey * 3 AS nnz, o_orderstatus AS status FROM orders",
)
def _(t):
    docs = evidence(t).select("stage", F.lit("PASS").alias("status"), "cases")
    text = docs.select(F.from_json(F.to_json(F.struct("stage", "status", "cases")), EVIDENCE).alias("e")).select("e.*")
    case = F.explode("cases").alias("c")
    return text.select(case).select("c.key", F.col("c.construction.dimensions.nnz_A").alias("nnz"), "c.status")


@query(
    "file_manifest",
    "SELECT url AS path, strlen(html)::BIGINT AS bytes, sha256(html) AS sha256 FROM pages",
)
def _(t):
    """Digests of the pages' contents; reading files themselves is tested with pytest."""
    return tables.content_manifest(t.read("pages").withColumnRenamed("url", "path"), "html")


STREAM_BAD = """(value < 0 OR event_type = 'error' OR (NOT attempted AND accepted) OR event_id % 5 = 0)"""


@query(
    "stream_run_log",
    f"""WITH {POL} SELECT 'policy_event' AS record_type, CASE WHEN {STREAM_BAD} THEN 'rejected' ELSE 'valid' END AS outcome, count(*) AS rows
          FROM pe GROUP BY ALL
        UNION ALL SELECT 'trajectory', CASE WHEN event_id <= 0 OR event_id % 40 = 0 OR value < 0 OR event_id % 11 = 0 OR event_id % 3 = 0
          THEN 'rejected' ELSE 'valid' END, count(*) FROM events GROUP BY ALL""",
)
def _(t):
    log, out, state = fresh(t, "log"), fresh(t, "stream"), fresh(t, "state")
    tables.write_run_log(trajectory(t), policy(t), log)
    stream_run_log(t.spark, log, out, state, interval=10).awaitTermination()
    return t.spark.read.parquet(out).groupBy("record_type", "outcome").agg(F.count("*").alias("rows"))
