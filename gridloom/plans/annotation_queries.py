"""Annotation queries over the conversation turns."""

from pyspark.sql import functions as F

from ..operators import annotations as an
from .registry import query


@query(
    "list_annotations",
    """SELECT id, created_at, comment FROM b_annotation WHERE owner_key = 'owner7' AND document_id = 'user'
       ORDER BY created_at DESC, id DESC""",
    "b_annotation",
)
def _(t):
    return an.list_annotations(t.annotation(), "owner7", "user").select("id", "created_at", "comment")


@query(
    "owner_key",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'user:' || role || conv_id || '@x.org'
         WHEN conv_id % 3 <> 0 THEN 'session:session-' || conv_id END AS owner_key FROM conversations""",
)
def _(t):
    conv, turn = F.col("conv_id"), F.col("turn")
    request = t.read("conversations").select(
        "conv_id", "turn",
        F.when(turn % 2 == 0, F.concat(F.lit("  "), F.upper("role"), conv, F.lit("@X.org\t"))).otherwise(" ").alias("email"),
        F.when(conv % 3 != 0, F.concat(F.lit(" session-"), conv)).otherwise("bad id!").alias("session"),
    )
    return an.owner_key(request).select("conv_id", "turn", "owner_key")


def requests(t):
    conv, turn = F.col("conv_id"), F.col("turn")
    return t.read("conversations").select(
        "conv_id", "turn",
        F.when(conv % 11 != 0, F.concat(F.lit("owner"), conv)).alias("owner_key"),
        F.concat(F.lit("note-"), conv, F.when(turn % 5 == 4, F.lit("_")).otherwise("-"), turn, F.lit("-abcdef")).alias("id"),
        F.col("role").alias("document_id"), F.lit(" s1 ").alias("section_id"), F.lit("Title").alias("section_title"),
        F.col("text").alias("selected_text"), F.concat(F.lit("\n"), F.col("text"), F.lit(" ")).alias("comment"),
        (conv % 17 - 1).cast("double").alias("start_offset"),
        (conv % 17 + F.when(turn % 7 == 6, 0.5).otherwise(3.0)).cast("double").alias("end_offset"),
        F.col("text").alias("prefix"), F.lit(None).cast("string").alias("suffix"),
    )


TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
FLAGS = f"""rq AS (SELECT *, list_filter([CASE WHEN conv_id % 11 = 0 THEN 'owner' END, CASE WHEN turn % 5 = 4 THEN 'id' END,
    CASE WHEN length({TRIM}) NOT BETWEEN 1 AND 1200 THEN 'selected_text' END,
    CASE WHEN length({TRIM}) NOT BETWEEN 1 AND 4000 THEN 'comment' END,
    CASE WHEN conv_id % 17 = 0 THEN 'start_offset' END, CASE WHEN turn % 7 = 6 THEN 'end_offset' END], lambda r: r IS NOT NULL) AS reasons
    FROM conversations)"""


@query("validate_annotations", f"""WITH {FLAGS} SELECT conv_id, turn, {TRIM} AS comment, substr(text, 1, 240) AS prefix, '' AS suffix,
    (conv_id % 17 - 1)::BIGINT AS start_offset, (conv_id % 17 + 3)::BIGINT AS end_offset FROM rq WHERE len(reasons) = 0""")
def _(t):
    good = an.validate_annotations(requests(t))[0]
    return good.select("conv_id", "turn", "comment", "prefix", "suffix", "start_offset", "end_offset")


@query("annotation_rejects", f"WITH {FLAGS} SELECT conv_id, turn, reasons FROM rq WHERE len(reasons) > 0")
def _(t):
    return an.validate_annotations(requests(t))[1].select("conv_id", "turn", "reasons")


@query(
    "apply_annotation_changes",
    """SELECT id, document_id, CASE WHEN created_at % 4 = 1 THEN 'edited ' || (created_at + 100) ELSE comment END AS comment,
         CASE WHEN created_at % 4 = 1 THEN 'applied' ELSE status END AS status,
         CASE WHEN created_at % 4 = 1 THEN 'now' ELSE 'then' END AS updated_at
       FROM b_annotation WHERE created_at % 4 <> 3
       UNION ALL SELECT id || '-new', document_id, 'fresh', 'open', 'then' FROM b_annotation WHERE created_at % 4 = 2""",
    "b_annotation",
)
def _(t):
    base = t.annotation().select("owner_key", "document_id", "id", "comment", "status", F.lit("then").alias("updated_at"))
    odd = t.annotation().withColumn("turn", F.col("created_at"))
    scope = ["owner_key", "document_id"]

    def change(rows, op, seq, comment, status, id_column=F.col("id")):
        return rows.select(
            *scope, id_column.alias("id"), F.lit(op).alias("op"), seq.cast("bigint").alias("seq"), comment.alias("comment"),
            F.lit(status).alias("status"), F.lit("then").alias("updated_at"), F.lit("now").alias("changed_at"),
        )

    t1, t2, t3 = (odd.where(F.col("turn") % 4 == k) for k in (1, 2, 3))
    edits = change(t1, "update", F.lit(5), F.lit("first"), "open").unionByName(
        change(t1, "update", F.lit(9), F.concat(F.lit("edited "), F.col("turn") + 100), "applied")
    )
    gone = change(t3, "update", F.lit(6), F.lit("lost"), "open").unionByName(change(t3, "delete", F.lit(7), F.lit(None).cast("string"), None))
    name = F.concat(F.col("id"), F.lit("-new"))
    fresh = change(t2, "insert", F.lit(3), F.lit("fresh"), "open", name).unionByName(
        change(t2, "insert", F.lit(8), F.lit("second insert"), "open", name)
    )
    log = edits.unionByName(gone).unionByName(fresh)
    return an.apply_annotation_changes(base, log).select("id", "document_id", "comment", "status", "updated_at")


@query(
    "section_at_offset",
    """WITH h AS (SELECT role AS document_id, (conv_id * 53 + turn) % 5000 AS "offset", conv_id * 1000 + turn AS place, 's' || conv_id AS sid
         FROM conversations),
       m AS (SELECT document_id, "offset", arg_max(sid, place) AS sid FROM h GROUP BY ALL)
       SELECT a.id, coalesce(m.sid, 'abstract') AS section_id FROM b_annotation a ASOF LEFT JOIN m
         ON a.document_id = m.document_id AND a.start_offset >= m."offset" """,
    "b_annotation",
)
def _(t):
    conv, turn = F.col("conv_id"), F.col("turn")
    heading = t.read("conversations").select(
        F.col("role").alias("document_id"), ((conv * 53 + turn) % 5000).alias("offset"), (conv * 1000 + turn).alias("place"),
        F.concat(F.lit("s"), conv).alias("section_id"), F.lit("Heading").alias("section_title"),
    )
    found = an.section_at_offset(t.annotation(), heading, ["document_id"], block=128)
    return found.select("id", "section_id")


@query(
    "feedback_markdown",
    r"""SELECT id, row_number() OVER (PARTITION BY owner_key, document_id ORDER BY created_at DESC, id DESC) AS number,
         '## ' || row_number() OVER (PARTITION BY owner_key, document_id ORDER BY created_at DESC, id DESC) || '. Title' || chr(10) || chr(10) ||
         '**Status:** ' || status || chr(10) || chr(10) || '> ' || replace(comment, chr(10), chr(10) || '> ') || chr(10) || chr(10) ||
         '**Requested change:** ' || comment || chr(10) AS entry FROM b_annotation""",
    "b_annotation",
)
def _(t):
    rows = t.annotation().withColumn("section_title", F.lit("Title")).withColumn("selected_text", F.col("comment"))
    return an.feedback_markdown(rows).select("id", "number", "entry")


@query(
    "annotation_counts",
    """SELECT document_id, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'applied') AS applied
       FROM b_annotation GROUP BY 1""",
    "b_annotation",
)
def _(t):
    return an.annotation_counts(t.annotation(), ["document_id"])
