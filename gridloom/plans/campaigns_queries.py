"""Campaign, report, manifest and text-coverage queries."""

from pyspark.sql import functions as F

from ..operators import campaign as c
from .registry import query


def order(t):
    return t.campaign().select("case_id", "seq", F.concat(F.lit("k"), F.col("seq")).alias("key"))


def attempts(t):
    """Two attempts for some orders; none for those of the lowest priority."""
    base = t.campaign().where(F.col("fingerprint") != "5-LOW")
    again = base.where(F.col("attempt") == 2)
    key = F.concat(F.lit("k"), F.col("seq")).alias("key")
    first = base.select("case_id", key, F.lit(1).cast("bigint").alias("attempt"), "status", "fingerprint")
    retry = F.when(F.col("seq") % 2 == 0, "PASS").otherwise("MEMORY_BLOCKED").alias("status")
    second = again.select("case_id", key, F.lit(2).cast("bigint").alias("attempt"), retry, "fingerprint")
    return first.unionByName(second)


CAMP = """od AS (SELECT case_id, seq, 'k' || seq AS key FROM b_campaign),
  at AS (SELECT case_id, 'k' || seq AS key, 1::BIGINT AS attempt, status, fingerprint FROM b_campaign WHERE fingerprint <> '5-LOW'
    UNION ALL SELECT case_id, 'k' || seq, 2, CASE WHEN seq % 2 = 0 THEN 'PASS' ELSE 'MEMORY_BLOCKED' END, fingerprint
      FROM b_campaign WHERE fingerprint <> '5-LOW' AND attempt = 2),
  la AS (SELECT case_id, key, max(attempt) AS attempt, arg_max(status, attempt) AS status, any_value(fingerprint) AS fingerprint,
      count(*) AS attempts FROM at GROUP BY ALL),
  rw AS (SELECT od.case_id, seq, od.key, status FROM od LEFT JOIN la USING (case_id, key)),
  stp AS (SELECT case_id, min(seq) FILTER (status IS DISTINCT FROM 'PASS') AS stop FROM rw GROUP BY 1)""".replace(
    "  at AS", "  att AS"
).replace("FROM at GROUP", "FROM att GROUP")


@query("latest_attempt", f"WITH {CAMP} SELECT * FROM la", "b_campaign")
def _(t):
    return c.latest_attempt(attempts(t))


@query(
    "compatible_runs",
    f"WITH {CAMP} SELECT * FROM att WHERE fingerprint IN ('1-URGENT', '2-HIGH')",
    "b_campaign",
)
def _(t):
    current = t.campaign().where(F.col("fingerprint").isin("1-URGENT", "2-HIGH"))
    return c.compatible_runs(attempts(t), current)


@query(
    "passing_prefix",
    f"""WITH {CAMP} SELECT case_id, count(*) FILTER (stop IS NULL OR seq < stop) AS passing_prefix, count(*) AS rows
        FROM rw JOIN stp USING (case_id) GROUP BY 1""",
    "b_campaign",
)
def _(t):
    return c.passing_prefix(order(t), attempts(t))


@query(
    "next_key",
    f"""WITH {CAMP} SELECT case_id, CASE WHEN status IS NULL THEN key END AS next_key FROM stp
        LEFT JOIN rw ON rw.case_id = stp.case_id AND rw.seq = stop""".replace("SELECT case_id, CASE", "SELECT stp.case_id, CASE"),
    "b_campaign",
)
def _(t):
    return c.next_key(order(t), attempts(t))


@query(
    "next_key_retry",
    f"WITH {CAMP} SELECT stp.case_id, key AS next_key FROM stp LEFT JOIN rw ON rw.case_id = stp.case_id AND rw.seq = stop",
    "b_campaign",
)
def _(t):
    return c.next_key(order(t), attempts(t), retry_failed=True)


@query(
    "campaign_status",
    f"""WITH {CAMP}, fa AS (SELECT case_id, arg_min(key, seq) FILTER (status IN ('PENDING', 'RUNNING')) AS ik,
          arg_min(status, seq) FILTER (status IN ('FAIL', 'TIME_LIMIT', 'MEMORY_BLOCKED')) AS ss,
          arg_min(key, seq) FILTER (status IS DISTINCT FROM 'PASS') AS nk, arg_min(coalesce(status, ''), seq) AS fs FROM rw GROUP BY 1)
        SELECT case_id, CASE WHEN ss = 'MEMORY_BLOCKED' THEN 'COMPLETE_WITH_RESOURCE_LIMIT' WHEN ss IS NOT NULL THEN 'STOPPED_ON_FAILURE'
          WHEN ik IS NOT NULL THEN 'RETRY_REQUIRED' WHEN nk IS NULL THEN 'PASS' WHEN fs = 'PASS' THEN 'PARTIAL_PASS' ELSE 'PLANNED' END AS status,
          nk IS NULL OR ss IS NOT NULL AS complete, CASE WHEN ss IS NULL AND ik IS NULL THEN nk END AS next_authorized_key, ik AS retry_required_key
        FROM fa""",
    "b_campaign",
)
def _(t):
    return c.campaign_status(order(t), attempts(t))


@query(
    "bypass_check",
    f"""WITH {CAMP}, ky AS (SELECT case_id, key, count(*) AS n, max(status) AS status FROM att GROUP BY ALL),
        od2 AS (SELECT * FROM od WHERE seq % 10 <> 3), r2 AS (SELECT od2.*, status FROM od2 LEFT JOIN ky USING (case_id, key)),
        s2 AS (SELECT case_id, min(seq) FILTER (status IS DISTINCT FROM 'PASS') AS stop FROM r2 GROUP BY 1)
        SELECT case_id, key, 'unlisted' AS reason FROM ky WHERE (case_id, key) NOT IN (SELECT case_id, key FROM od2)
        UNION ALL SELECT case_id, key, 'duplicate' FROM ky WHERE n > 1
        UNION ALL SELECT case_id, key, 'bypasses_predecessor' FROM r2 JOIN s2 USING (case_id) WHERE status IS NOT NULL AND seq > stop""",
    "b_campaign",
)
def _(t):
    return c.bypass_check(order(t).where(F.col("seq") % 10 != 3), attempts(t))


@query(
    "allocation_order_check",
    """WITH h AS (SELECT l_suppkey AS case_id, (l_orderkey * 8 + l_linenumber) * 8 + year(l_shipdate) - 1995 AS ordinal, 'm' || ((year(l_shipdate) - 1995)) AS key,
         l_quantity > 3 AS gate, l_returnflag FROM lineitem),
       pl AS (SELECT case_id, key, min(ordinal) AS f FROM h GROUP BY ALL),
       rk AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY f) - 1 AS nth, substr(key, 2)::BIGINT AS place FROM pl)
       SELECT case_id, attempts, invalid_rows, unique_keys, out_of_order, invalid_rows = 0 AND out_of_order = 0 AS passed FROM
         (SELECT case_id, count(*) AS attempts, count(*) FILTER (NOT (gate AND l_returnflag <> 'A')) AS invalid_rows FROM h GROUP BY 1)
         JOIN (SELECT case_id, count(*) AS unique_keys, count(*) FILTER (nth <> place) AS out_of_order FROM rk GROUP BY 1) USING (case_id)""",
)
def _(t):
    line = t.read("lineitem")
    year = F.year("l_shipdate") - 1995
    history = line.select(
        F.col("l_suppkey").alias("case_id"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 8 + year).alias("ordinal"),
        F.concat(F.lit("m"), year).alias("key"),
        F.concat_ws("-", "l_returnflag", year.cast("string")).alias("invocation_id"), (F.col("l_quantity") > 3).alias("gate_passed"),
    )
    suppliers = line.select(F.col("l_suppkey").alias("case_id")).distinct()
    years = suppliers.withColumn("seq", F.explode(F.expr("sequence(0L, 6L)")))
    listed = years.withColumn("key", F.concat(F.lit("m"), F.col("seq")))
    flags = listed.withColumn("flag", F.explode(F.array(*[F.lit(x) for x in "ANR"])))
    invocation = flags.select(
        "case_id", F.concat_ws("-", "flag", F.col("seq").cast("string")).alias("invocation_id"), F.lit("run_next").alias("mode"),
        (F.col("flag") != "A").alias("approved"), F.array("key").alias("allocated_keys"),
    )
    return c.allocation_order_check(history, listed, invocation, block=1000)


@query(
    "stage_check_summary",
    """SELECT scope, count(*) FILTER (passed) AS passed_checks, count(*) AS total_checks,
         CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS checker_result FROM b_checks GROUP BY 1""",
    "b_checks",
)
def _(t):
    return c.stage_check_summary(t.checks())


@query(
    "coverage_counts",
    """SELECT (SELECT count(*) FROM part) AS symbolic_rows, (SELECT count(*) FROM part WHERE p_size > 10) AS dimension_matches,
         (SELECT count(*) FROM part WHERE p_size > 40) AS nnz_matches, count(*) FILTER (o_orderkey % 3 <> 0) AS allocated_rows,
         count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderstatus = 'F') AS validated_gpu_rows,
         count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderstatus <> 'P') AS validated_cpu_rows,
         count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS resolved_without_allocation FROM orders""",
)
def _(t):
    structural = t.read("part").select((F.col("p_size") > 10).alias("dimension_match"), (F.col("p_size") > 40).alias("nnz_match"))
    priority = F.col("o_orderpriority")
    bench = t.read("orders").select(
        (F.col("o_orderkey") % 3 != 0).alias("full_lp_allocated"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("FAIL").alias("gpu_status"),
        F.when(F.col("o_orderstatus") != "P", "SUCCESS").otherwise("TIME_LIMIT").alias("cpu_status"),
        F.when(priority == "1-URGENT", "MEMORY_BLOCKED").when(priority == "2-HIGH", "INDEX_BLOCKED").otherwise("PASS").alias("row_status"),
    )
    return c.coverage_counts(structural, bench)


@query(
    "assert_table_invariants",
    """SELECT 'orders' AS scope, unnest(['positive_price', 'all_final', 'many_rows']) AS name,
         unnest([bool_and(o_totalprice > 0), bool_and(o_orderstatus = 'F'), count(*) > 100]) AS passed FROM orders""",
)
def _(t):
    return c.assert_table_invariants(
        t.read("orders"),
        "orders",
        {
            "positive_price": F.min(F.col("o_totalprice") > 0),
            "all_final": F.min(F.col("o_orderstatus") == "F"),
            "many_rows": F.count("*") > 100,
        },
    )


@query(
    "manifest_drift",
    """SELECT path, CASE d WHEN 1 THEN 'missing' WHEN 2 THEN 'unexpected' WHEN 3 THEN 'changed' ELSE 'size_changed' END AS drift FROM
         (SELECT path, substr(path, 5)::BIGINT % 10 AS d FROM b_manifest) WHERE d BETWEEN 1 AND 4""",
    "b_manifest",
)
def _(t):
    d = F.substring("path", 5, 20).cast("bigint") % 10
    now = t.manifest()
    stored = now.where(d != 2).withColumn(
        "sha256", F.when(d == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    ).withColumn("bytes", F.when(d == 4, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return c.manifest_drift(stored, now.where(d != 1))


@query(
    "text_coverage",
    """WITH k AS (SELECT count(*) AS n FROM benchmark),
       ph AS (SELECT doc_id, 'item' AS subject, b.text AS wording FROM documents, k JOIN benchmark b ON b.item_id = doc_id % n
         UNION ALL SELECT doc_id, 'own', substr(text, 1 + doc_id % 50, 12) FROM documents
         UNION ALL SELECT doc_id, 'own', 'no such wording' FROM documents)
       SELECT doc_id, subject FROM ph JOIN documents USING (doc_id) GROUP BY ALL
       HAVING NOT bool_or(contains(lower(text), lower(wording)))""".replace("FROM documents, k JOIN benchmark b ON b.item_id = doc_id % n", "FROM documents JOIN benchmark b ON b.item_id = doc_id % (SELECT n FROM k)"),
)
def _(t):
    docs, bench = t.read("documents"), t.read("benchmark")
    size = bench.count()
    item = docs.select("doc_id", (F.col("doc_id") % size).alias("item_id")).join(bench, "item_id").select(
        "doc_id", F.lit("item").alias("subject"), F.col("text").alias("wording")
    )
    own = docs.select(
        "doc_id", F.lit("own").alias("subject"),
        F.explode(F.array(F.substr("text", 1 + F.col("doc_id") % 50, F.lit(12)), F.lit("no such wording"))).alias("wording"),
    )
    return c.text_coverage(docs, item.unionByName(own))


@query(
    "status_counts",
    """WITH s AS (SELECT o_custkey % 20 AS g, CASE o_orderpriority WHEN '1-URGENT' THEN 'passed' WHEN '2-HIGH' THEN 'failed'
         WHEN '3-MEDIUM' THEN 'index-blocked' WHEN '4-NOT SPECIFIED' THEN 'locked' ELSE 'running' END AS st FROM orders)
       SELECT g, count(*) FILTER (st = 'passed') AS passed, count(*) FILTER (st = 'failed') AS failed,
         count(*) FILTER (st IN ('passed', 'failed')) AS attempted, count(*) FILTER (st = 'index-blocked') AS blocked,
         count(*) FILTER (st NOT IN ('running', 'locked')) AS recorded, count(*) AS total,
         floor(100.0 * count(*) FILTER (st = 'passed') / count(*) + 0.5)::BIGINT AS percent FROM s GROUP BY 1""",
)
def _(t):
    p = F.col("o_orderpriority")
    status = (
        F.when(p == "1-URGENT", "passed").when(p == "2-HIGH", "failed").when(p == "3-MEDIUM", "index-blocked")
        .when(p == "4-NOT SPECIFIED", "locked").otherwise("running")
    )
    rows = t.read("orders").select((F.col("o_custkey") % 20).alias("g"), status.alias("status"))
    return c.status_counts(rows, ["g"])


def stages(t):
    """A stage per document: title is its source, purpose its text, one task per language."""
    return t.read("documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("purpose"),
        F.when(F.col("doc_id") % 3 == 0, "complete").otherwise("locked").alias("status"),
        F.array(F.struct(F.concat(F.lit("t"), F.col("doc_id")).alias("id"), F.upper("lang").alias("title"))).alias("tasks"),
    )


@query(
    "stage_search",
    """SELECT doc_id AS id, source AS title FROM documents WHERE doc_id % 3 = 0 AND (contains(lower(source), 'en')
       OR contains(lower(text), 'en') OR contains('t' || doc_id, 'en') OR contains(lower(lang), 'en'))""",
)
def _(t):
    return c.stage_search(stages(t), "complete", " EN ").select("id", "title")


@query(
    "current_stage",
    """WITH s AS (SELECT o_custkey AS case_id, o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'active' WHEN '2-HIGH' THEN 'stopped'
         WHEN '3-MEDIUM' THEN 'complete' ELSE 'locked' END AS st FROM orders),
       f AS (SELECT case_id, min(id) FILTER (st = 'active') AS a, min(id) FILTER (st = 'stopped') AS s, max(id) FILTER (st = 'complete') AS c,
         min(id) AS l FROM s GROUP BY 1),
       k AS (SELECT case_id, coalesce(a, CASE WHEN s IS NULL OR c > s THEN c END, s, l) AS current FROM f)
       SELECT case_id, current, min(id) FILTER (st = 'locked' AND id > current) AS next_locked FROM s JOIN k USING (case_id) GROUP BY ALL""",
)
def _(t):
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "active").when(p == "2-HIGH", "stopped").when(p == "3-MEDIUM", "complete").otherwise("locked")
    rows = t.read("orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("id"), status.alias("status"))
    return c.current_stage(rows, ["case_id"], last_core=2**62)
