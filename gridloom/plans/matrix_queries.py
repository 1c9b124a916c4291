"""Products, norms, residuals and scaling over the order-line matrix."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.heavy import find_heavy
from ..operators import algebra as al
from ..operators import assemble as asm
from ..operators import scaling as sc
from ..operators.lanczos import lanczos
from ..session import settle, settle_bucketed
from .registry import query, r

LP = "b_entry b_coo b_row b_col b_state_col b_state_row"
AX = """ax AS (SELECT case_id, block, row, sum(value * x) AS ax FROM b_coo
    JOIN b_state_col USING (case_id, col) GROUP BY ALL),
  rows AS (SELECT case_id, block, row, coalesce(ax, 0) AS ax, b, y FROM b_row
    LEFT JOIN ax USING (case_id, block, row) JOIN b_state_row USING (case_id, block, row))"""
ATY = """aty AS (SELECT case_id, col, sum(value * y) AS aty FROM b_coo
    JOIN b_state_row USING (case_id, block, row) GROUP BY ALL),
  cols AS (SELECT case_id, col, coalesce(aty, 0) AS aty, c, lower, upper, x, z FROM b_col
    JOIN b_state_col USING (case_id, col) LEFT JOIN aty USING (case_id, col))"""
PD = "CASE WHEN block = 'A2' THEN greatest({0}, 0) ELSE {0} END"
BOX = "x - least(greatest(x - z, lower), upper)"


def lp(t):
    return t.coo(), t.row_vec(), t.col_vec(), t.state_col(), t.state_row()


@query("coo_consolidate", "SELECT * FROM b_coo", "b_entry b_coo")
def _(t):
    return asm.coo_consolidate(t.entries())


@query(
    "coo_stack",
    """SELECT case_id, block, row + k * 1000000 AS row, col + k * 1000 AS col,
       CASE WHEN k = 0 THEN value ELSE -value END AS value FROM b_coo, range(2) AS s(k)""",
    "b_entry b_coo",
)
def _(t):
    a = t.coo()
    return asm.coo_stack([(a, 0, 0), (a.withColumn("value", -F.col("value")), 1_000_000, 1_000)])


@query(
    "coo_time_expand",
    """SELECT case_id, block, row + k * 1000000 AS row, col + k * 10000 AS col, value
       FROM b_coo, range(3) AS s(k)""",
    "b_entry b_coo",
)
def _(t):
    return asm.coo_time_expand(t.coo(), 3, 1_000_000, 10_000)


@query(
    "coo_kron",
    """SELECT p, case_id, block, r * 1000000 + row AS row, c * 10000 + col AS col, w * value AS value
       FROM b_coo, (VALUES ('difference', 0, 1, 1.0), ('difference', 0, 0, -1.0),
         ('difference', 1, 2, 1.0), ('difference', 1, 1, -1.0),
         ('lower', 0, 0, 1.0), ('lower', 1, 0, 1.0), ('lower', 1, 1, 1.0),
         ('lower', 2, 0, 1.0), ('lower', 2, 1, 1.0), ('lower', 2, 2, 1.0),
         ('ones', 0, 0, 1.0), ('ones', 0, 1, 1.0), ('ones', 0, 2, 1.0)) AS k(p, r, c, w)""",
    "b_entry b_coo",
)
def _(t):
    a = t.coo()
    result = None
    for name in ("ones", "difference", "lower"):
        one = asm.coo_kron(name, a, 3, 1_000_000, 10_000).withColumn("p", F.lit(name))
        result = one if result is None else result.unionByName(one)
    return result


@query(
    "spmv",
    f"WITH {AX} SELECT case_id, block, row, {r('ax')} AS ax FROM rows",
    LP,
)
def _(t):
    a, row_vec, _, x, _ = lp(t)
    return al.spmv(a, x, rows=row_vec).withColumn("ax", rounded("ax"))


@query(
    "spmv_t",
    f"WITH {ATY} SELECT case_id, col, {r('aty')} AS aty FROM cols",
    LP,
)
def _(t):
    a, _, col_vec, _, y = lp(t)
    return al.spmv_t(a, y, cols=col_vec).withColumn("aty", rounded("aty"))


HOT_COLUMN = "CASE WHEN l_linenumber <= 3 THEN 0 ELSE l_suppkey END"


@query(
    "spmv_heavy",
    f"""SELECT l_orderkey % 3 AS case_id, CASE WHEN l_orderkey % 2 = 0 THEN 'A1' ELSE 'A2' END AS block,
      l_orderkey AS row, {r(f'sum(l_quantity * (({HOT_COLUMN}) % 11 + 1))')} AS ax FROM lineitem GROUP BY ALL""",
)
def _(t):
    order = F.col("l_orderkey")
    a = t.read("lineitem").select(
        (order % 3).alias("case_id"),
        F.when(order % 2 == 0, "A1").otherwise("A2").alias("block"),
        order.alias("row"),
        F.expr(HOT_COLUMN).cast("bigint").alias("col"),
        F.col("l_quantity").alias("value"),
    )
    a = settle(asm.coo_consolidate(a))
    x = a.select(*al.COL).distinct().withColumn("x", F.col("col") % 11 + 1)
    often = find_heavy(a, *al.COL, ways=8)
    return al.spmv(a, x, heavy=often).withColumn("ax", rounded("ax"))


@query(
    "vector_norms",
    f"""SELECT case_id, {r('sum(abs(x))')} AS l1, {r('sqrt(sum(x*x))')} AS l2,
        {r('max(abs(x))')} AS linf, count(*) AS size FROM b_state_col GROUP BY 1""",
    LP,
)
def _(t):
    norms = al.vector_norms(t.state_col(), "x")
    return norms.select("case_id", *[rounded(n).alias(n) for n in ("l1", "l2", "linf")], "size")


@query(
    "dot_product",
    f"SELECT case_id, {r('sum(x*z)', 4)} AS dot FROM b_state_col GROUP BY 1",
    LP,
)
def _(t):
    s = t.state_col()
    return al.dot(s, s, al.COL, "x", "z").withColumn("dot", rounded("dot", 4))


@query(
    "project_box",
    """SELECT case_id, col, least(greatest(x, lower), upper) AS x
       FROM b_state_col JOIN b_col USING (case_id, col)""",
    LP,
)
def _(t):
    return al.project_box(t.state_col(), t.col_vec())


@query(
    "project_nonnegative",
    "SELECT case_id, block, row, greatest(y, 0) AS y FROM b_state_row",
    LP,
)
def _(t):
    return al.project_nonnegative(t.state_row(), "y")


@query("project_dual", f"SELECT case_id, block, row, {PD.format('y')} AS y FROM b_state_row", LP)
def _(t):
    return al.project_dual(t.state_row())


@query(
    "objective",
    f"""SELECT case_id, {r('sum(c*x) + 7', 4)} AS objective FROM b_col
        JOIN b_state_col USING (case_id, col) GROUP BY 1""",
    LP,
)
def _(t):
    cols = t.col_vec()
    constant = cols.groupBy("case_id").agg(F.lit(7.0).alias("constant"))
    return al.objective(t.state_col(), cols, constant).withColumn(
        "objective", rounded("objective", 4)
    )


@query(
    "kkt_residual",
    f"""WITH {AX}, {ATY}
    SELECT case_id, 'dual' AS part, block, row AS position, {r('y - (' + PD.format('(y - ax + b)') + ')')} AS value
      FROM rows
    UNION ALL SELECT case_id, 'box', NULL, col, {r(BOX)} FROM cols
    UNION ALL SELECT case_id, 'stationarity', NULL, col, {r('c - aty - z')} FROM cols""",
    LP,
)
def _(t):
    return al.kkt_residual(*lp(t)).withColumn("value", rounded("value"))


NORMS = f"""WITH {AX}, {ATY},
  rn AS (SELECT case_id, sum(({PD.format('(b - ax)')})^2) AS p, sum(b^2) AS b,
         sum((y - ({PD.format('(y - ax + b)')}))^2) AS d FROM rows GROUP BY 1),
  cn AS (SELECT case_id, sum(({BOX})^2) AS box, sum((c - aty - z)^2) AS st, sum(x^2) AS x,
         sum(z^2) AS z, sum(c^2) AS c FROM cols GROUP BY 1),
  s AS (SELECT case_id, sqrt(d + box + st) AS kkt, sqrt(p) AS p, sqrt(box) AS box, sqrt(st) AS st,
        sqrt(p) / (1 + sqrt(b)) AS pn, sqrt(box) / (1 + sqrt(x) + sqrt(z)) AS boxn,
        sqrt(st) / (1 + sqrt(c)) AS stn FROM rn JOIN cn USING (case_id))"""


@query(
    "stopping_residual",
    f"""{NORMS} SELECT case_id, {r('pn')} AS "primal", {r('boxn')} AS box, {r('stn')} AS stationarity,
        pn <= 0.9 AS primal_ok, boxn <= 0.9 AS box_ok, stn <= 0.9 AS stationarity_ok FROM s""",
    LP,
)
def _(t):
    found = al.stopping_residual(*lp(t), tolerance=0.9)
    return found.select(
        "case_id",
        *[rounded(n).alias(n) for n in ("primal", "box", "stationarity")],
        "primal_ok",
        "box_ok",
        "stationarity_ok",
    )


@query(
    "residual_summary",
    f"""{NORMS} SELECT case_id, {r('kkt', 3)} AS kkt_combined_norm, {r('p', 3)} AS primal_raw,
        {r('box', 3)} AS box_raw, {r('st', 3)} AS stationarity_raw,
        {r('sqrt(pn^2 + boxn^2 + stn^2)')} AS normalized_combined_norm,
        pn <= 0.9 AND boxn <= 0.9 AND stn <= 0.9 AS all_satisfied FROM s""",
    LP,
)
def _(t):
    s = al.residual_summary(*lp(t), tolerance=0.9)
    return s.select(
        "case_id",
        rounded("kkt_combined_norm", 3).alias("kkt_combined_norm"),
        rounded("raw.primal", 3).alias("primal_raw"),
        rounded("raw.box", 3).alias("box_raw"),
        rounded("raw.stationarity", 3).alias("stationarity_raw"),
        rounded("normalized_combined_norm").alias("normalized_combined_norm"),
        "stopping.all_satisfied",
    )


@query(
    "max_primal_violation",
    f"""WITH {AX},
    rv AS (SELECT case_id, max(CASE WHEN block = 'A1' THEN abs(ax - b) END) AS e,
           max(CASE WHEN block = 'A2' THEN greatest(b - ax, 0) END) AS i FROM rows GROUP BY 1),
    cv AS (SELECT case_id, max(greatest(lower - x, 0)) AS l, max(greatest(x - upper, 0)) AS u
           FROM b_col JOIN b_state_col USING (case_id, col) GROUP BY 1)
    SELECT case_id, {r('e')} AS equality, {r('i')} AS inequality, {r('l')} AS lower,
      {r('u')} AS upper, {r('greatest(e, i, l, u)')} AS overall FROM rv JOIN cv USING (case_id)""",
    LP,
)
def _(t):
    a, row_vec, col_vec, x, _ = lp(t)
    names = ("equality", "inequality", "lower", "upper", "overall")
    found = al.max_primal_violation(a, row_vec, col_vec, x)
    return found.select("case_id", *[rounded(n).alias(n) for n in names])


# the state with some values null, NaN (case 0) or absent (case 1)
LOST = """lost AS (SELECT case_id, col, z, CASE WHEN case_id = 0 AND col % 97 = 3 THEN NULL
      WHEN case_id = 0 AND col % 97 = 4 THEN 'NaN'::DOUBLE ELSE x END AS x
    FROM b_state_col WHERE NOT (case_id = 1 AND col % 97 = 3)),
  ax AS (SELECT a.case_id, block, row, sum(value * x) AS ax, bool_or(x IS NULL OR isnan(x)) AS bad
    FROM b_coo a LEFT JOIN lost USING (case_id, col) GROUP BY ALL),
  rows AS (SELECT case_id, block, row, coalesce(ax, 0) AS ax, coalesce(bad, false) AS bad, b
    FROM b_row LEFT JOIN ax USING (case_id, block, row)),
  cols AS (SELECT case_id, lower, upper, x, x IS NULL OR isnan(x) AS bad, z IS NULL AS no_z
    FROM b_col LEFT JOIN lost USING (case_id, col))"""


def lost(t):
    case, part = F.col("case_id"), F.col("col") % 97
    x = F.when((case == 0) & (part == 3), None)
    x = x.when((case == 0) & (part == 4), float("nan")).otherwise(F.col("x"))
    return t.state_col().where(~((case == 1) & (part == 3))).withColumn("x", x)


@query(
    "primal_violation_nulls",
    f"""WITH {LOST},
    rv AS (SELECT case_id,
             CASE WHEN NOT bool_or(bad AND block = 'A1') THEN max(CASE WHEN block = 'A1' THEN abs(ax - b) END) END AS e,
             CASE WHEN NOT bool_or(bad AND block = 'A2') THEN max(CASE WHEN block = 'A2' THEN greatest(b - ax, 0) END) END AS i
           FROM rows GROUP BY 1),
    cv AS (SELECT case_id, CASE WHEN NOT bool_or(bad) THEN max(greatest(lower - x, 0)) END AS l,
             CASE WHEN NOT bool_or(bad) THEN max(greatest(x - upper, 0)) END AS u
           FROM cols GROUP BY 1)
    SELECT case_id, {r('e')} AS equality, {r('i')} AS inequality, {r('l')} AS lower, {r('u')} AS upper,
      CASE WHEN e IS NOT NULL AND i IS NOT NULL AND l IS NOT NULL AND u IS NOT NULL
        THEN {r('greatest(e, i, l, u)')} END AS overall
    FROM rv JOIN cv USING (case_id)""",
    LP,
)
def _(t):
    """A case whose state has a null, a NaN or a gap has no violation that could pass."""
    a, row_vec, col_vec, _, _ = lp(t)
    names = ("equality", "inequality", "lower", "upper", "overall")
    found = al.max_primal_violation(a, row_vec, col_vec, lost(t))
    return found.select("case_id", *[rounded(n).alias(n) for n in names])


@query(
    "residual_nulls",
    f"""WITH {LOST},
    rv AS (SELECT case_id, NOT bool_or(bad) AS ok FROM rows GROUP BY 1),
    cv AS (SELECT case_id, NOT bool_or(bad) AS ok, NOT bool_or(no_z) AS z_ok FROM cols GROUP BY 1)
    SELECT case_id, rv.ok AS primal_known, cv.ok AND z_ok AS box_known, z_ok AS stationarity_known,
      rv.ok AND cv.ok AND z_ok AS all_satisfied
    FROM rv JOIN cv USING (case_id)""",
    LP,
)
def _(t):
    """With a tolerance that any number meets, exactly the cases without a gap stop."""
    a, row_vec, col_vec, _, y = lp(t)
    s = al.residual_summary(a, row_vec, col_vec, lost(t), y, tolerance=1e300)
    known = [F.col(f"raw.{n}").isNotNull().alias(f"{n}_known") for n in ("primal", "box", "stationarity")]
    return s.select("case_id", *known, "stopping.all_satisfied")


@query(
    "spectral_bounds",
    f"""WITH rs AS (SELECT case_id, sum(f) AS frobenius, max(s) AS mr, sum(n) AS nnz FROM
        (SELECT case_id, block, row, sum(value*value) AS f, sum(abs(value)) AS s, count(*) AS n
         FROM b_coo GROUP BY ALL) GROUP BY 1),
      cs AS (SELECT case_id, max(s) AS mc FROM
        (SELECT case_id, col, sum(abs(value)) AS s FROM b_coo GROUP BY ALL) GROUP BY 1)
      SELECT case_id, frobenius, mr AS max_row_sum, nnz::BIGINT AS nnz, mc AS max_col_sum,
        mr * mc AS induced FROM rs JOIN cs USING (case_id)""",
    "b_entry b_coo",
)
def _(t):
    return al.spectral_bounds(t.coo())


@query(
    "gram_blocks",
    f"""WITH m AS (SELECT l_suppkey % 5 AS case_id, l_orderkey * 8 + l_linenumber AS col,
            year(l_shipdate) AS period, l_suppkey AS store, l_quantity AS q, l_discount + 1 AS d
            FROM lineitem),
        e AS (SELECT case_id, 'balance' AS part, period AS row, col, sum(q) AS v FROM m GROUP BY ALL
              UNION ALL SELECT case_id, 'storage', store, col, sum(-q) FROM m GROUP BY ALL),
        mx AS (SELECT case_id, max(n) AS max_shared FROM
               (SELECT case_id, col, part, count(*) AS n FROM e GROUP BY ALL) GROUP BY 1),
        g AS (SELECT case_id, part || '_diagonal' AS kind, row AS r1, row AS r2, sum(v*v) AS value
                FROM e GROUP BY ALL
              UNION ALL SELECT l.case_id, 'coupling', l.row, s.row, sum(l.v * s.v) FROM e l JOIN e s
                ON l.case_id = s.case_id AND l.col = s.col AND l.part = 'balance'
                AND s.part = 'storage' GROUP BY ALL)
      SELECT * FROM g JOIN mx USING (case_id)""",
)
def _(t):
    line = t.read("lineitem")
    keys = [(F.col("l_suppkey") % 5).alias("case_id"), F.expr("l_orderkey * 8 + l_linenumber").alias("col")]
    q = F.col("l_quantity")
    balance = line.select(
        *keys, F.lit("balance").alias("part"), F.year("l_shipdate").cast("bigint").alias("row"), q.alias("v")
    )
    storage = line.select(
        *keys, F.lit("storage").alias("part"), F.col("l_suppkey").alias("row"), (-q).alias("v")
    )
    a = balance.unionByName(storage).groupBy("case_id", "part", "row", "col").agg(
        F.sum("v").alias("value")
    )
    return al.gram_blocks(a)


STEP = """
  rn AS (SELECT case_id, block, row, max(abs(value)) AS mx, sum(abs(value)) AS sm FROM b_coo GROUP BY ALL),
  cn AS (SELECT case_id, col, max(abs(value)) AS mx, sum(abs(value)) AS sm FROM b_coo GROUP BY ALL)"""


@query(
    "axis_norms",
    f"""WITH {STEP} SELECT case_id, 'row' AS axis, block, row AS position, mx AS max_abs, sm AS sum_abs FROM rn
        UNION ALL SELECT case_id, 'column', NULL, col, mx, sm FROM cn""",
    "b_entry b_coo",
)
def _(t):
    rows, cols = sc.axis_norms(t.coo())
    return rows.select(
        "case_id", F.lit("row").alias("axis"), "block", F.col("row").alias("position"), "max_abs", "sum_abs"
    ).unionByName(
        cols.select(
            "case_id",
            F.lit("column").alias("axis"),
            F.lit(None).cast("string").alias("block"),
            F.col("col").alias("position"),
            "max_abs",
            "sum_abs",
        )
    )


@query(
    "sqrt_denominator",
    f"""SELECT case_id, block, row, {r('CASE WHEN n > 0 THEN sqrt(n) ELSE 1 END', 9)} AS scale FROM
        (SELECT case_id, block, row, coalesce(max(abs(value)), 0) AS n FROM b_row
         LEFT JOIN b_coo USING (case_id, block, row) GROUP BY ALL)""",
    LP,
)
def _(t):
    rows, _ = sc.axis_norms(t.coo())
    full = sc.with_empty(rows, t.row_vec(), al.ROW)
    return full.select(*al.ROW, rounded(sc.sqrt_denominator(F.col("max_abs")), 9).alias("scale"))


def _step_sql(norm):
    return f"""WITH {STEP} SELECT case_id, block, row, col,
        {r(f'value * (1 / sqrt(rn.{norm})) * (1 / sqrt(cn.{norm}))', 9)} AS value
        FROM b_coo JOIN rn USING (case_id, block, row) JOIN cn USING (case_id, col)"""


@query("scale_step", _step_sql("mx"), "b_entry b_coo")
def _(t):
    return sc.scale_step(t.coo(), "ruiz").a.withColumn("value", rounded("value", 9))


@query("pock_chambolle", _step_sql("sm"), "b_entry b_coo")
def _(t):
    return sc.pock_chambolle(t.coo()).a.withColumn("value", rounded("value", 9))


def _ruiz_sql(k):
    parts = ["a0 AS (SELECT * FROM b_coo)"]
    for i in range(k):
        parts.append(
            f"r{i} AS (SELECT case_id, block, row, sqrt(max(abs(value))) AS s FROM a{i} GROUP BY ALL)"
        )
        parts.append(f"c{i} AS (SELECT case_id, col, sqrt(max(abs(value))) AS s FROM a{i} GROUP BY ALL)")
        parts.append(
            f"""a{i + 1} AS (SELECT case_id, block, row, col, value * (1 / r.s) * (1 / c.s) AS value
            FROM a{i} JOIN r{i} r USING (case_id, block, row) JOIN c{i} c USING (case_id, col))"""
        )
    return ", ".join(parts)


@query(
    "ruiz",
    f"WITH {_ruiz_sql(3)} SELECT case_id, block, row, col, {r('value', 8)} AS value FROM a3",
    "b_entry b_coo",
)
def _(t):
    return sc.ruiz(t.coo(), 3).a.withColumn("value", rounded("value", 8))


SCALES = f"""{STEP},
  rs AS (SELECT case_id, block, row, sqrt(mx) AS s FROM rn),
  cs AS (SELECT case_id, col, sqrt(mx) AS s FROM cn),
  b1 AS (SELECT case_id, block, row, b, y, coalesce(s, 1) AS s FROM b_row
         JOIN b_state_row USING (case_id, block, row) LEFT JOIN rs USING (case_id, block, row)),
  c1 AS (SELECT case_id, col, c, lower, upper, x, z, coalesce(s, 1) AS s FROM b_col
         JOIN b_state_col USING (case_id, col) LEFT JOIN cs USING (case_id, col)),
  meta AS (SELECT case_id, 1 + bn AS bs, 1 + cn AS cs FROM
     (SELECT case_id, sqrt(sum((b / s)^2)) AS bn FROM b1 GROUP BY 1)
     JOIN (SELECT case_id, sqrt(sum((c / s)^2)) AS cn FROM c1 GROUP BY 1) USING (case_id))"""


def _scaled(t):
    a, row_vec, col_vec, x, y = lp(t)
    step = sc.scale_step(a, "ruiz")
    return step, sc.normalize_rhs_cost(row_vec, col_vec, step.row_scale, step.col_scale), x, y


def _long(rows, row_value, cols, col_values):
    """Row and column vectors as one long table."""
    left = rows.select(
        "case_id", F.lit(row_value).alias("name"), "block", F.col("row").alias("position"),
        F.col(row_value).alias("value"),
    )
    pairs = [F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in col_values]
    right = cols.select("case_id", F.explode(F.array(*pairs)).alias("p"), F.col("col").alias("position"))
    right = right.select(
        "case_id", "p.name", F.lit(None).cast("string").alias("block"), "position", "p.value"
    )
    return left.unionByName(right)


def _long_sql(row_name, row_value, values, places):
    parts = [
        f"""SELECT case_id, '{row_name}' AS name, block, row AS position, {r(row_value, places)} AS value
        FROM b1 JOIN meta USING (case_id)"""
    ]
    for name, value in values.items():
        parts.append(
            f"SELECT case_id, '{name}', NULL, col, {r(value, places)} FROM c1 JOIN meta USING (case_id)"
        )
    return f"WITH {SCALES} " + " UNION ALL ".join(parts)


@query(
    "normalize_rhs_cost",
    _long_sql("b", "b / s / bs", {"c": "c / s / cs", "lower": "lower * s / bs", "upper": "upper * s / bs"}, 9),
    LP,
)
def _(t):
    _, (rows, cols, _meta), _, _ = _scaled(t)
    return _long(rows, "b", cols, ["c", "lower", "upper"]).withColumn("value", rounded("value", 9))


@query("scale_state", _long_sql("y", "y * s / cs", {"x": "x * s / bs", "z": "z / (cs * s)"}, 9), LP)
def _(t):
    step, (_, _, meta), x, y = _scaled(t)
    cols, rows = sc.scale_state(x, y, step.row_scale, step.col_scale, meta)
    return _long(rows, "y", cols, ["x", "z"]).withColumn("value", rounded("value", 9))


@query("recover_state", _long_sql("y", "y * cs / s", {"x": "bs * x / s", "z": "cs * z * s"}, 3), LP)
def _(t):
    step, (_, _, meta), x, y = _scaled(t)
    cols, rows = sc.recover_state(x, y, step.row_scale, step.col_scale, meta)
    return _long(rows, "y", cols, ["x", "z"]).withColumn("value", rounded("value", 3))


@query(
    "recover_lp",
    """SELECT case_id, 'a' AS name, block, row AS position, col, round(value, 6) AS value FROM b_coo
       UNION ALL SELECT case_id, 'b', block, row, NULL, round(b, 4) FROM b_row
       UNION ALL SELECT case_id, 'c', NULL, col, NULL, round(c, 4) FROM b_col
       UNION ALL SELECT case_id, 'lower', NULL, col, NULL, round(lower, 4) FROM b_col
       UNION ALL SELECT case_id, 'upper', NULL, col, NULL, round(upper, 4) FROM b_col""",
    LP,
)
def _(t):
    step, (rows, cols, meta), _, _ = _scaled(t)
    a, b, c = sc.recover_lp(step.a, rows, cols, step.row_scale, step.col_scale, meta)
    vectors = _long(b, "b", c, ["c", "lower", "upper"]).withColumn("col", F.lit(None).cast("bigint"))
    vectors = vectors.withColumn("value", rounded("value", 4))
    matrix = a.select(
        "case_id", F.lit("a").alias("name"), "block", F.col("row").alias("position"), "col",
        rounded("value", 6).alias("value"),
    )
    return matrix.unionByName(vectors)


@query(
    "recover_objective",
    f"SELECT case_id, {r('sum(c*x)', 4)} AS objective FROM b_col JOIN b_state_col USING (case_id, col) GROUP BY 1",
    LP,
)
def _(t):
    step, (_, cols, meta), x, y = _scaled(t)
    scaled_x, _ = sc.scale_state(x, y, step.row_scale, step.col_scale, meta)
    found = sc.recover_objective(al.objective(scaled_x, cols), meta)
    return found.withColumn("objective", rounded("objective", 4))


@query(
    "scaling_diagnostics",
    f"""WITH {STEP}, n AS (SELECT case_id, 'row' AS axis, mx FROM rn
          UNION ALL SELECT case_id, 'row', 0 FROM b_row ANTI JOIN rn USING (case_id, block, row)
          UNION ALL SELECT case_id, 'column', mx FROM cn
          UNION ALL SELECT case_id, 'column', 0 FROM b_col ANTI JOIN cn USING (case_id, col))
        SELECT case_id, axis, count(*) AS count, count(*) FILTER (mx = 0) AS zero_count,
          min(mx) AS minimum, max(mx) AS maximum, min(mx) FILTER (mx > 0) AS minimum_positive
        FROM n GROUP BY ALL""",
    LP,
)
def _(t):
    rows, cols = sc.axis_norms(t.coo())
    return sc.norm_summary(sc.with_empty(rows, t.row_vec(), al.ROW), "max_abs", "row").unionByName(
        sc.norm_summary(sc.with_empty(cols, t.col_vec(), al.COL), "max_abs", "column")
    )


@query(
    "verify_diagonal_scaling",
    """SELECT case_id, 0::BIGINT AS pattern_differences, 0::DOUBLE AS max_error, true AS passed
       FROM b_coo GROUP BY 1""",
    "b_entry b_coo",
)
def _(t):
    a = t.coo()
    step = sc.scale_step(a, "ruiz")
    found = sc.verify_diagonal_scaling(a, step.a, step.row_scale, step.col_scale)
    return found.withColumn("max_error", rounded("max_error", 9))


def _normal_steps(steps, absolute):
    """Unrolled products with A'A, from the start vector of the operator."""
    value, low, span = ("abs(value)", "0.5", "1.0") if absolute else ("value", "-1.0", "2.0")
    parts = [
        f"""x0 AS (SELECT case_id, col, {low}::DOUBLE + ((col * 7919 + 12345) % 10007) / 10007 * {span}::DOUBLE
        AS x FROM (SELECT DISTINCT case_id, col FROM b_coo))"""
    ]
    for i in range(steps + (not absolute)):
        parts.append(
            f"""y{i} AS (SELECT case_id, block, row, sum({value} * x) AS y FROM b_coo
            JOIN x{i} USING (case_id, col) GROUP BY ALL),
            p{i} AS (SELECT case_id, col, sum({value} * y) AS p FROM b_coo
            JOIN y{i} USING (case_id, block, row) GROUP BY ALL)"""
        )
        if absolute:
            parts.append(
                f"""q{i} AS (SELECT case_id, max(p / x) AS bound, max(p) AS top
                FROM p{i} JOIN x{i} USING (case_id, col) GROUP BY 1),
                x{i + 1} AS (SELECT case_id, col, greatest(p / top, 64 * pow(2.0, -52)) AS x
                FROM p{i} JOIN q{i} USING (case_id))"""
            )
        else:
            parts.append(
                f"""n{i} AS (SELECT case_id, sqrt(sum(p * p)) AS n FROM p{i} GROUP BY 1),
                x{i + 1} AS (SELECT case_id, col, p / n AS x FROM p{i} JOIN n{i} USING (case_id))"""
            )
    return ", ".join(parts)


RAYLEIGH = """SELECT case_id, xp AS rayleigh, sqrt(greatest(pp - xp * xp, 0)) AS residual FROM
    (SELECT case_id, sum(x * p) AS xp, sum(p * p) AS pp FROM p{0} JOIN x{0} USING (case_id, col) GROUP BY 1)"""


@query(
    "power_iteration",
    f"""WITH {_normal_steps(3, False)}, e AS ({RAYLEIGH.format(3)})
    SELECT case_id, {r('rayleigh', 2)} AS rayleigh, {r('residual / rayleigh', 5)} AS relative_residual,
      3 AS steps FROM e""",
    "b_entry b_coo",
)
def _(t):
    found = al.power_iteration(settle_bucketed(t.coo(), *al.ROW), 3)
    return found.select(
        "case_id",
        rounded("rayleigh", 2).alias("rayleigh"),
        rounded(F.col("residual") / F.col("rayleigh"), 5).alias("relative_residual"),
        "steps",
    )


COLLATZ = " UNION ALL ".join(f"SELECT * FROM q{i}" for i in range(3))


@query(
    "collatz_bound",
    f"""WITH {_normal_steps(3, True)} SELECT case_id, {r('min(bound)', 2)} AS bound, 3::BIGINT AS steps
    FROM ({COLLATZ}) GROUP BY 1""",
    "b_entry b_coo",
)
def _(t):
    return al.collatz_bound(settle_bucketed(t.coo(), *al.ROW), 3).withColumn("bound", rounded("bound", 2))


@query(
    "spectral_certificate",
    f"""WITH {_normal_steps(3, True)},
    cb AS (SELECT case_id, min(bound) AS c FROM ({COLLATZ}) GROUP BY 1),
    rs AS (SELECT case_id, sum(f) AS f, max(s) AS mr FROM (SELECT case_id, block, row,
      sum(value*value) AS f, sum(abs(value)) AS s FROM b_coo GROUP BY ALL) GROUP BY 1),
    cs AS (SELECT case_id, max(s) AS mc FROM
      (SELECT case_id, col, sum(abs(value)) AS s FROM b_coo GROUP BY ALL) GROUP BY 1)
    SELECT case_id, {r('least(f, mr * mc, c)', 2)} AS upper, true AS safe, true AS tight
    FROM cb JOIN rs USING (case_id) JOIN cs USING (case_id)""",
    "b_entry b_coo",
)
def _(t):
    a = settle_bucketed(t.coo(), *al.ROW)
    found = al.spectral_certificate(
        al.spectral_bounds(a), al.power_iteration(a, 3), al.collatz_bound(a, 3)
    )
    tight = (F.col("lambda_used") >= F.col("upper")) & (F.col("lambda_used") <= 1.000001 * F.col("upper"))
    return found.select("case_id", rounded("upper", 2).alias("upper"), "safe", tight.alias("tight"))


@query(
    "lanczos_three_columns",
    f"""WITH e AS (SELECT case_id, block, row, col % 3 AS col, sum(value) AS v FROM b_coo GROUP BY ALL),
    g AS (SELECT l.case_id, l.col AS i, s.col AS j, sum(l.v * s.v) AS v FROM e l
      JOIN e s USING (case_id, block, row) GROUP BY ALL),
    m AS (SELECT case_id, max(CASE WHEN i = 0 AND j = 0 THEN v END) AS a,
      max(CASE WHEN i = 1 AND j = 1 THEN v END) AS b, max(CASE WHEN i = 2 AND j = 2 THEN v END) AS c,
      max(CASE WHEN i = 0 AND j = 1 THEN v END) AS d, max(CASE WHEN i = 0 AND j = 2 THEN v END) AS e,
      max(CASE WHEN i = 1 AND j = 2 THEN v END) AS f FROM g GROUP BY 1),
    q AS (SELECT *, (a + b + c) / 3 AS q FROM m),
    p AS (SELECT *, sqrt(((a-q)*(a-q) + (b-q)*(b-q) + (c-q)*(c-q) + 2*(d*d + e*e + f*f)) / 6) AS p FROM q),
    s AS (SELECT *, ((a-q) * ((b-q)*(c-q) - f*f) - d * (d*(c-q) - f*e) + e * (d*f - (b-q)*e))
      / (2*p*p*p) AS s FROM p)
    SELECT case_id, {r('q + 2 * p * cos(acos(greatest(-1, least(1, s))) / 3)', 2)} AS largest,
      true AS converged, true AS few_steps FROM s""",
    "b_entry b_coo",
)
def _(t):
    three = t.entries().withColumn("col", F.col("col") % 3)
    found = lanczos(settle(asm.coo_consolidate(three)), 6, 1e-9)
    return found.select(
        "case_id",
        rounded("rayleigh", 2).alias("largest"),
        "converged",
        (F.col("steps") <= 3).alias("few_steps"),
    )
