"""How the driver's tables stand in for grid, solver and campaign tables.

Each binding exists twice: as a method of ``Tables`` and as SQL in ``BINDING_SQL``.
Every binding covers its whole source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

HORIZON = 4
CASES = 5

BINDING_SQL: dict[str, str] = {
    "b_entry": """SELECT l_orderkey % 3 AS case_id,
        CASE WHEN l_orderkey % 2 = 0 THEN 'A1' ELSE 'A2' END AS block,
        l_orderkey AS row, l_suppkey AS col, l_quantity AS value FROM lineitem""",
    "b_coo": """SELECT case_id, block, row, col, sum(value) AS value FROM b_entry
        GROUP BY ALL HAVING sum(value) <> 0""",
    "b_row": """SELECT o_orderkey % 3 AS case_id,
        CASE WHEN o_orderkey % 2 = 0 THEN 'A1' ELSE 'A2' END AS block,
        o_orderkey AS row, o_totalprice AS b FROM orders""",
    "b_col": """SELECT case_id, s_suppkey AS col, s_nationkey::DOUBLE AS c, 0::DOUBLE AS lower,
        abs(s_acctbal) AS upper FROM supplier, range(3) AS k(case_id)""",
    "b_state_col": """SELECT case_id, s_suppkey AS col, s_acctbal / 100 AS x,
        (s_nationkey - 12)::DOUBLE AS z FROM supplier, range(3) AS k(case_id)""",
    "b_state_row": """SELECT o_orderkey % 3 AS case_id,
        CASE WHEN o_orderkey % 2 = 0 THEN 'A1' ELSE 'A2' END AS block,
        o_orderkey AS row, (o_custkey % 7 - 3)::DOUBLE AS y FROM orders""",
    "b_bus": """SELECT c_custkey % 5 AS case_id, c_nationkey::BIGINT AS bus_id,
        CASE WHEN c_nationkey = 0 THEN 3 ELSE 1 END AS bus_type,
        sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS demand_mw,
        (c_nationkey % 4)::DOUBLE AS shunt_mw
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "b_branch": """SELECT case_id, n_nationkey * 2 + k AS branch_id, n_nationkey::BIGINT AS from_bus,
        CASE WHEN k = 0 THEN (n_nationkey + 1) % 25 ELSE (n_nationkey + 5) % 25 END::BIGINT
            AS to_bus,
        (1 + n_nationkey % 4) / 10 AS reactance,
        CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 0 END::DOUBLE AS tap,
        (n_nationkey % 5)::DOUBLE AS shift_degrees,
        CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE (n_nationkey + 1) * 1000 END::DOUBLE AS rate_mw,
        n_nationkey % 7 <> 6 AS status
        FROM nation, range(2) AS e(k), range(5) AS c(case_id)""",
    "b_net_bus": """SELECT c_custkey % 25 AS case_id, c_custkey AS bus_id,
        CASE WHEN c_custkey < 25 THEN 3 ELSE 1 END AS bus_type,
        round(c_acctbal) AS demand_mw FROM customer""",
    "b_net_branch": """SELECT c_custkey % 25 AS case_id, c_custkey * 2 + k AS branch_id,
        c_custkey AS from_bus,
        CASE WHEN k = 0 THEN ((c_custkey // 25 - 1) // 2) * 25 + c_custkey % 25
             ELSE c_custkey - 25 END AS to_bus,
        (1 + c_custkey % 4) / 10 AS reactance,
        CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END::DOUBLE AS tap,
        (c_custkey % 5)::DOUBLE AS shift_degrees,
        CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE abs(c_acctbal) + 1 END AS rate_mw,
        c_custkey % 11 <> 10 OR k = 0 AS status
        FROM customer, range(2) AS e(k) WHERE c_custkey >= 25""",
    "b_ptdf": """SELECT c_custkey % 25 AS case_id, c_custkey AS branch_id, n_nationkey::BIGINT AS bus_id,
        CASE WHEN n_nationkey = 0 THEN 0 ELSE ((7 * c_custkey + 3 * n_nationkey) % 11 - 5) / 10 END
            ::DOUBLE AS value FROM customer, nation""",
    "b_model_ptdf": """SELECT case_id, branch_id, bus AS bus_id,
        CASE WHEN bus = 0 THEN 0 ELSE ((7 * branch_id + 3 * bus) % 11 - 5) / 10 END::DOUBLE AS value
        FROM b_branch, range(25) AS b(bus)""",
    "b_gen": """SELECT s_suppkey % 5 AS case_id, s_suppkey // 5 AS gen_pos,
        s_nationkey::BIGINT AS bus_id, s_acctbal >= 0 AS status, abs(s_acctbal) AS max_mw,
        abs(s_acctbal) / 10 AS min_mw, (s_suppkey % 50)::DOUBLE AS slope, 7::DOUBLE AS constant,
        abs(s_acctbal) / 5 AS ramp_up, abs(s_acctbal) / 4 AS ramp_down FROM supplier""",
    "b_renewable": """SELECT p_partkey % 5 AS case_id, p_partkey // 5 AS pos,
        p_partkey % 25 AS bus_id, period, p_size::DOUBLE AS min_mw, p_retailprice AS max_mw
        FROM part, range(4) AS t(period)""",
    "b_storage": """SELECT s_suppkey % 5 AS case_id, s_suppkey // 5 AS pos, s_nationkey::BIGINT AS bus_id,
        abs(s_acctbal) / 2 AS initial_mwh, 0::DOUBLE AS min_mwh, abs(s_acctbal) AS max_mwh,
        s_suppkey % 60 + 20::DOUBLE AS max_charge, s_suppkey % 50 + 25::DOUBLE AS max_discharge,
        0.95::DOUBLE AS charge_eff, 0.9::DOUBLE AS discharge_eff FROM supplier""",
    "b_profile": """SELECT case_id, period, (1 + period / 10)::DOUBLE AS multiplier,
        100 * (period + 1)::DOUBLE AS reserve_up, 50 * (period + 1)::DOUBLE AS reserve_down
        FROM range(5) AS c(case_id), range(4) AS t(period)""",
    "b_months": """SELECT l_suppkey % 5 AS case_id, l_suppkey // 5 AS pos,
        (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS period,
        sum(l_quantity) AS p_g,
        sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::DOUBLE AS r_up,
        sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END)::DOUBLE AS r_down,
        sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END)::DOUBLE AS charge,
        sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END)::DOUBLE AS discharge
        FROM lineitem GROUP BY ALL""",
    "b_output": """SELECT p_partkey % 5 AS case_id, p_partkey // 5 AS pos,
        p_partkey % 25 AS bus_id, period, p_size * 20 * (period + 1)::DOUBLE AS output
        FROM part, range(4) AS t(period)""",
    "b_run_log": """SELECT 'u' || user_id AS case_id, event_type AS run, event_id + 1 AS iteration,
        value AS residual, (event_id % 100)::DOUBLE / 10 AS objective,
        1 + (event_id % 3)::DOUBLE AS sigma, event_id // 1000 AS restart_count,
        (user_id * 10)::DOUBLE AS elapsed FROM events""",
    "b_policy": """SELECT 'u' || user_id AS case_id, event_id + 1 AS iteration,
        1 + event_id % 40 AS inner_iteration, value AS merit,
        (user_id % 10 * 20)::DOUBLE AS reference_merit,
        event_id // 1000 AS restart_count, event_type,
        (event_id % 13)::DOUBLE AS delta_x, (user_id % 7)::DOUBLE AS delta_y,
        (event_id % 5)::DOUBLE AS primal_infeasibility, (event_id % 9)::DOUBLE AS dual_infeasibility,
        1::DOUBLE AS sigma_before FROM events""",
    "b_timing": """SELECT event_type || '-' || user_id AS run, event_id AS repetition,
        event_type <> 'error' AS passed, abs(value) AS wall_seconds FROM events""",
    "b_ledger": """SELECT CASE WHEN day(ts) <= 15 THEN 'before' ELSE 'after' END AS side,
        event_type AS phase,
        CASE WHEN event_id % 2 = 0 THEN 'host_to_device' ELSE 'device_to_host' END AS direction,
        'kind' || user_id % 6 AS kind, 1::BIGINT AS calls,
        round(abs(value) * 100)::BIGINT AS bytes FROM events""",
    "b_spec": """SELECT n_nationkey AS case_id, periods, buses, branches, generators, renewables, storage
        FROM (SELECT c_nationkey AS n_nationkey, count(*) AS buses, 2 * count(*) AS branches
              FROM customer GROUP BY 1)
        JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS generators, 1 + count(*) // 2 AS storage
              FROM supplier GROUP BY 1) USING (n_nationkey)
        JOIN (SELECT p_partkey % 25 AS n_nationkey, count(*) AS renewables FROM part GROUP BY 1)
            USING (n_nationkey), (VALUES (4), (16), (48), (96)) AS t(periods)""",
    "b_campaign": """SELECT o_custkey AS case_id, o_orderkey AS seq, o_orderkey % 3 AS attempt,
        CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'FAIL' ELSE 'PENDING' END AS status,
        o_orderpriority AS fingerprint, o_totalprice AS cost FROM orders""",
    "b_checks": """SELECT source AS scope, 'doc_' || documents.doc_id AS name, quality = 1 AS passed
        FROM documents JOIN labels ON labels.doc_id = documents.doc_id""",
    "b_annotation": """SELECT 'c' || conv_id || '-t' || turn AS id, 'owner' || conv_id % 50 AS owner_key,
        role AS document_id, turn AS created_at, text AS comment,
        CASE WHEN turn % 3 = 0 THEN 'applied' ELSE 'open' END AS status,
        (conv_id * 37 + turn * 11) % 5000 AS start_offset FROM conversations""",
    "b_manifest": """SELECT 'doc_' || doc_id AS path, sha256(text) AS sha256, n_chars AS bytes
        FROM documents""",
}


class Tables:
    """The driver's Parquet tables and the bindings over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def entries(self) -> DataFrame:
        order = F.col("l_orderkey")
        return self.read("lineitem").select(
            (order % 3).alias("case_id"),
            F.when(order % 2 == 0, "A1").otherwise("A2").alias("block"),
            order.alias("row"),
            F.col("l_suppkey").alias("col"),
            F.col("l_quantity").alias("value"),
        )

    def coo(self) -> DataFrame:
        from ..operators.assemble import coo_consolidate

        return coo_consolidate(self.entries())

    def _row(self, *cols) -> DataFrame:
        order = F.col("o_orderkey")
        return self.read("orders").select(
            (order % 3).alias("case_id"),
            F.when(order % 2 == 0, "A1").otherwise("A2").alias("block"),
            order.alias("row"),
            *cols,
        )

    def row_vec(self) -> DataFrame:
        return self._row(F.col("o_totalprice").alias("b"))

    def state_row(self) -> DataFrame:
        return self._row((F.col("o_custkey") % 7 - 3).cast("double").alias("y"))

    def _per_case(self, df: DataFrame, cases: int) -> DataFrame:
        return df.withColumn("case_id", F.explode(F.sequence(F.lit(0), F.lit(cases - 1)))).withColumn(
            "case_id", F.col("case_id").cast("bigint")
        )

    def col_vec(self) -> DataFrame:
        return self._per_case(self.read("supplier"), 3).select(
            "case_id",
            F.col("s_suppkey").alias("col"),
            F.col("s_nationkey").cast("double").alias("c"),
            F.lit(0.0).alias("lower"),
            F.abs("s_acctbal").alias("upper"),
        )

    def state_col(self) -> DataFrame:
        return self._per_case(self.read("supplier"), 3).select(
            "case_id",
            F.col("s_suppkey").alias("col"),
            (F.col("s_acctbal") / 100).alias("x"),
            (F.col("s_nationkey") - 12).cast("double").alias("z"),
        )

    def bus(self) -> DataFrame:
        customer = self.read("customer")
        nation = F.col("c_nationkey")
        joined = self.read("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        sums = joined.groupBy((F.col("c_custkey") % CASES).alias("case_id"), "c_nationkey").agg(
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("demand_mw")
        )
        return sums.select(
            "case_id",
            nation.cast("bigint").alias("bus_id"),
            F.when(nation == 0, 3).otherwise(1).alias("bus_type"),
            "demand_mw",
            (nation % 4).cast("double").alias("shunt_mw"),
        )

    def branch(self) -> DataFrame:
        nation = F.col("n_nationkey")
        edges = self._per_case(self.read("nation"), CASES).withColumn(
            "k", F.explode(F.array(F.lit(0), F.lit(1)))
        )
        return edges.select(
            "case_id",
            (nation * 2 + F.col("k")).cast("bigint").alias("branch_id"),
            nation.cast("bigint").alias("from_bus"),
            F.when(F.col("k") == 0, (nation + 1) % 25)
            .otherwise((nation + 5) % 25)
            .cast("bigint")
            .alias("to_bus"),
            ((1 + nation % 4) / 10).alias("reactance"),
            F.when(nation % 3 == 0, 2.0).otherwise(0.0).alias("tap"),
            (nation % 5).cast("double").alias("shift_degrees"),
            F.when(nation % 6 == 0, 0.0).otherwise((nation + 1) * 1000.0).alias("rate_mw"),
            (nation % 7 != 6).alias("status"),
        )

    def net_bus(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(
            (key % 25).alias("case_id"),
            key.alias("bus_id"),
            F.when(key < 25, 3).otherwise(1).alias("bus_type"),
            F.round("c_acctbal").alias("demand_mw"),
        )

    def net_branch(self) -> DataFrame:
        key = F.col("c_custkey")
        edges = (
            self.read("customer")
            .where(key >= 25)
            .withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        )
        parent = F.expr("(c_custkey div 25 - 1) div 2") * 25 + key % 25
        return edges.select(
            (key % 25).alias("case_id"),
            (key * 2 + F.col("k")).alias("branch_id"),
            key.alias("from_bus"),
            F.when(F.col("k") == 0, parent).otherwise(key - 25).alias("to_bus"),
            ((1 + key % 4) / 10).alias("reactance"),
            F.when(key % 3 == 0, 2.0).otherwise(0.0).alias("tap"),
            (key % 5).cast("double").alias("shift_degrees"),
            F.when(key % 6 == 0, 0.0).otherwise(F.abs("c_acctbal") + 1).alias("rate_mw"),
            ((key % 11 != 10) | (F.col("k") == 0)).alias("status"),
        )

    @staticmethod
    def _factor(branch, bus):
        return F.when(bus == 0, 0.0).otherwise(((7 * branch + 3 * bus) % 11 - 5) / 10)

    def ptdf(self) -> DataFrame:
        """A factor for every branch (customer) and every one of the 25 buses."""
        key = F.col("c_custkey")
        wide = spread(self.read("customer").select("c_custkey"), "c_custkey").withColumn(
            "bus_id", F.explode(F.expr("sequence(0L, 24L)"))
        )
        return wide.select(
            (key % 25).alias("case_id"),
            key.alias("branch_id"),
            "bus_id",
            self._factor(key, F.col("bus_id")).alias("value"),
        )

    def model_ptdf(self) -> DataFrame:
        wide = self.branch().withColumn(
            "bus_id", F.explode(F.expr("sequence(0L, 24L)"))
        )
        return wide.select(
            "case_id",
            "branch_id",
            "bus_id",
            self._factor(F.col("branch_id"), F.col("bus_id")).alias("value"),
        )

    def gen(self) -> DataFrame:
        key, balance = F.col("s_suppkey"), F.col("s_acctbal")
        return self.read("supplier").select(
            (key % CASES).alias("case_id"),
            F.expr(f"s_suppkey div {CASES}").alias("gen_pos"),
            F.col("s_nationkey").cast("bigint").alias("bus_id"),
            (balance >= 0).alias("status"),
            F.abs(balance).alias("max_mw"),
            (F.abs(balance) / 10).alias("min_mw"),
            (key % 50).cast("double").alias("slope"),
            F.lit(7.0).alias("constant"),
            (F.abs(balance) / 5).alias("ramp_up"),
            (F.abs(balance) / 4).alias("ramp_down"),
            F.lit(2).alias("model"),
            F.array((key % 50).cast("double"), F.lit(7.0)).alias("parameters"),
        )

    def _periods(self, df: DataFrame) -> DataFrame:
        return df.withColumn(
            "period", F.explode(F.expr(f"sequence(0L, {HORIZON - 1}L)"))
        )

    def renewable(self) -> DataFrame:
        return self._periods(self.read("part")).select(
            (F.col("p_partkey") % CASES).alias("case_id"),
            F.expr(f"p_partkey div {CASES}").alias("pos"),
            (F.col("p_partkey") % 25).alias("bus_id"),
            "period",
            F.col("p_size").cast("double").alias("min_mw"),
            F.col("p_retailprice").alias("max_mw"),
        )

    def output(self) -> DataFrame:
        return self._periods(self.read("part")).select(
            (F.col("p_partkey") % CASES).alias("case_id"),
            F.expr(f"p_partkey div {CASES}").alias("pos"),
            (F.col("p_partkey") % 25).alias("bus_id"),
            "period",
            (F.col("p_size") * 20 * (F.col("period") + 1)).cast("double").alias("output"),
        )

    def storage(self) -> DataFrame:
        key, size = F.col("s_suppkey"), F.abs("s_acctbal")
        return self.read("supplier").select(
            (key % CASES).alias("case_id"),
            F.expr(f"s_suppkey div {CASES}").alias("pos"),
            F.col("s_nationkey").cast("bigint").alias("bus_id"),
            (size / 2).alias("initial_mwh"),
            F.lit(0.0).alias("min_mwh"),
            size.alias("max_mwh"),
            (key % 60 + 20).cast("double").alias("max_charge"),
            (key % 50 + 25).cast("double").alias("max_discharge"),
            F.lit(0.95).alias("charge_eff"),
            F.lit(0.9).alias("discharge_eff"),
        )

    def profile(self) -> DataFrame:
        """Per-period settings of the cases present in the generator table."""
        period = F.col("period")
        return self._periods(self.gen().select("case_id").distinct()).select(
            "case_id",
            "period",
            (1 + period / 10).alias("multiplier"),
            (100.0 * (period + 1)).alias("reserve_up"),
            (50.0 * (period + 1)).alias("reserve_down"),
        )

    def months(self) -> DataFrame:
        qty = F.col("l_quantity")

        def part(column: str, flag: str):
            return F.sum(F.when(F.col(column) == flag, qty).otherwise(0.0))

        return (
            self.read("lineitem")
            .groupBy(
                (F.col("l_suppkey") % CASES).alias("case_id"),
                F.expr(f"l_suppkey div {CASES}").alias("pos"),
                ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1)
                .cast("bigint")
                .alias("period"),
            )
            .agg(
                F.sum(qty).alias("p_g"),
                part("l_returnflag", "R").alias("r_up"),
                part("l_returnflag", "A").alias("r_down"),
                part("l_linestatus", "O").alias("charge"),
                part("l_linestatus", "F").alias("discharge"),
            )
        )

    def run_log(self) -> DataFrame:
        event = F.col("event_id")
        return self.read("events").select(
            F.concat(F.lit("u"), F.col("user_id")).alias("case_id"),
            F.col("event_type").alias("run"),
            (event + 1).alias("iteration"),
            F.col("value").alias("residual"),
            ((event % 100).cast("double") / 10).alias("objective"),
            (1 + (event % 3)).cast("double").alias("sigma"),
            F.expr("event_id div 1000").alias("restart_count"),
            (F.col("user_id") * 10).cast("double").alias("elapsed"),
        )

    def policy(self) -> DataFrame:
        event, user = F.col("event_id"), F.col("user_id")
        return self.read("events").select(
            F.concat(F.lit("u"), user).alias("case_id"),
            (event + 1).alias("iteration"),
            (1 + event % 40).alias("inner_iteration"),
            F.col("value").alias("merit"),
            (user % 10 * 20).cast("double").alias("reference_merit"),
            F.expr("event_id div 1000").alias("restart_count"),
            "event_type",
            (event % 13).cast("double").alias("delta_x"),
            (user % 7).cast("double").alias("delta_y"),
            (event % 5).cast("double").alias("primal_infeasibility"),
            (event % 9).cast("double").alias("dual_infeasibility"),
            F.lit(1.0).alias("sigma_before"),
        )

    def timing(self) -> DataFrame:
        return self.read("events").select(
            F.concat_ws("-", "event_type", "user_id").alias("run"),
            F.col("event_id").alias("repetition"),
            (F.col("event_type") != "error").alias("passed"),
            F.abs("value").alias("wall_seconds"),
        )

    def ledger(self) -> DataFrame:
        return self.read("events").select(
            F.when(F.dayofmonth("ts") <= 15, "before").otherwise("after").alias("side"),
            F.col("event_type").alias("phase"),
            F.when(F.col("event_id") % 2 == 0, "host_to_device")
            .otherwise("device_to_host")
            .alias("direction"),
            F.concat(F.lit("kind"), F.col("user_id") % 6).alias("kind"),
            F.lit(1).cast("bigint").alias("calls"),
            F.round(F.abs("value") * 100).cast("bigint").alias("bytes"),
        )

    def spec(self) -> DataFrame:
        """Case sizes from the customer, supplier and part counts of each nation."""
        buses = self.read("customer").groupBy(F.col("c_nationkey").alias("case_id")).agg(
            F.count("*").alias("buses"), (2 * F.count("*")).alias("branches")
        )
        devices = self.read("supplier").groupBy(F.col("s_nationkey").alias("case_id")).agg(
            F.count("*").alias("generators"),
            (F.floor(F.count("*") / 2) + 1).cast("bigint").alias("storage"),
        )
        renewables = self.read("part").groupBy(
            (F.col("p_partkey") % 25).cast("int").alias("case_id")
        ).agg(F.count("*").alias("renewables"))
        joined = buses.join(devices, "case_id").join(renewables, "case_id")
        return joined.select(
            "case_id",
            F.explode(F.array(*[F.lit(t) for t in (4, 16, 48, 96)])).alias("periods"),
            "buses",
            "branches",
            "generators",
            "renewables",
            "storage",
        )

    def campaign(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_custkey").alias("case_id"),
            F.col("o_orderkey").alias("seq"),
            (F.col("o_orderkey") % 3).alias("attempt"),
            F.when(F.col("o_orderstatus") == "F", "PASS")
            .when(F.col("o_orderstatus") == "O", "FAIL")
            .otherwise("PENDING")
            .alias("status"),
            F.col("o_orderpriority").alias("fingerprint"),
            F.col("o_totalprice").alias("cost"),
        )

    def checks(self) -> DataFrame:
        return self.read("documents").select("doc_id", "source").join(
            self.read("labels"), "doc_id"
        ).select(
            F.col("source").alias("scope"),
            F.concat(F.lit("doc_"), F.col("doc_id")).alias("name"),
            (F.col("quality") == 1).alias("passed"),
        )

    def annotation(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        return self.read("conversations").select(
            F.concat(F.lit("c"), conv, F.lit("-t"), turn).alias("id"),
            F.concat(F.lit("owner"), conv % 50).alias("owner_key"),
            F.col("role").alias("document_id"),
            turn.alias("created_at"),
            F.col("text").alias("comment"),
            F.when(turn % 3 == 0, "applied").otherwise("open").alias("status"),
            ((conv * 37 + turn * 11) % 5000).alias("start_offset"),
        )

    def manifest(self) -> DataFrame:
        return self.read("documents").select(
            F.concat(F.lit("doc_"), F.col("doc_id")).alias("path"),
            F.sha2("text", 256).alias("sha256"),
            F.col("n_chars").alias("bytes"),
        )
