"""Digests of records, matrices, states and runs."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import fingerprint as fp
from .registry import query, r


def _sum_sql(digest):
    words = ", ".join(
        f"sum(('0x' || substr({digest}, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(fp.WORDS)
    )
    return f"sha256(concat_ws('|', count(*)::VARCHAR, {words}))"


def _written(*values):
    """SQL twin of a row's text before it is digested."""
    parts = [f"coalesce(length({v}::VARCHAR) || ':' || {v}::VARCHAR, 'n')" for v in values]
    return f"sha256({' || '.join(parts)})"


@query(
    "record_fingerprint",
    """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":'
         || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS digest FROM orders""",
)
def _(t):
    status = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    orders = t.read("orders").withColumn("o_orderstatus", status)
    found = fp.record_fingerprint(orders, ["o_orderstatus", "o_orderkey", "o_custkey"])
    return found.select("o_orderkey", "digest")


@query(
    "table_fingerprint",
    f"""WITH d AS (SELECT case_id, block, {_written('row', 'col', 'value')} AS h FROM b_coo)
        SELECT case_id, block, count(*) AS rows, {_sum_sql('h')} AS digest FROM d GROUP BY ALL""",
    "b_entry b_coo",
)
def _(t):
    return fp.table_fingerprint(t.coo(), ["case_id", "block"], ["row", "col", "value"])


@query(
    "lp_fingerprint",
    f"""WITH p AS (SELECT case_id, block AS part, row AS p, col AS q, value AS v FROM b_coo
          UNION ALL SELECT case_id, CASE block WHEN 'A1' THEN 'b1' ELSE 'b2' END, row, NULL, b FROM b_row
          UNION ALL SELECT case_id, 'c', col, NULL, c FROM b_col UNION ALL SELECT case_id, 'lower', col, NULL, lower FROM b_col
          UNION ALL SELECT case_id, 'upper', col, NULL, upper FROM b_col),
        d AS (SELECT case_id, part, {_written('p', 'q', 'v')} AS h FROM p),
        g AS (SELECT case_id, part, {_sum_sql('h')} AS digest FROM d GROUP BY ALL)
        SELECT case_id, sha256('{{' || string_agg('"' || part || '":"' || digest || '"', ',' ORDER BY part) || '}}') AS digest FROM g GROUP BY 1""",
    "b_entry b_coo b_row b_col",
)
def _(t):
    found = fp.lp_fingerprint(t.coo(), t.row_vec(), t.col_vec())
    return found.select("case_id", "digest")


@query(
    "state_fingerprint",
    f"""WITH s AS (SELECT case_id, 'x' AS name, '' AS block, col AS place, x AS v FROM b_state_col
          UNION ALL SELECT case_id, 'z', '', col, z FROM b_state_col
          UNION ALL SELECT case_id, 'y', block, row, y FROM b_state_row),
        d AS (SELECT *, {_written('block', 'place', 'v')} AS h FROM s)
        SELECT case_id, name, count(*) AS size, true AS finite, least(min(v), 0) AS minimum, greatest(max(v), 0) AS maximum,
          {r('sqrt(sum(v * v))')} AS l2_norm, {_sum_sql('h')} AS digest FROM d GROUP BY case_id, name""",
    "b_state_col b_state_row",
)
def _(t):
    found = fp.state_fingerprint(t.state_col(), t.state_row())
    return found.select("case_id", "name", "size", "finite", "minimum", "maximum", rounded("l2_norm").alias("l2_norm"), "digest")


@query(
    "run_fingerprint",
    f"""WITH d AS (SELECT source AS run, {_written("('doc_' || doc_id)", 'sha256(text)')} AS h FROM documents),
        g AS (SELECT run, {_sum_sql('h')} AS sources FROM d GROUP BY 1)
        SELECT run, sha256('{{"config_sha256":"' || sha256(run) || '","sources":"' || sources || '","versions":"v1"}}') AS run_fingerprint FROM g""",
)
def _(t):
    docs = t.read("documents")
    manifest = docs.select(
        F.col("source").alias("run"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("path"), F.sha2("text", 256).alias("sha256")
    )
    provenance = docs.select(F.col("source").alias("run")).distinct().select(
        "run", F.sha2("run", 256).alias("config_sha256"), F.lit("v1").alias("versions")
    )
    return fp.run_fingerprint(manifest, provenance)
