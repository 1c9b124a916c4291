"""The annotation table: listing, validation, changes and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if, reason_list
from ..functions.ordered import BLOCK, carry_forward, sorted_position

# Patterns of identifiers and limits of texts.
DOCUMENT_PATTERN = r"^[a-z0-9-]{1,80}$"
CLIENT_PATTERN = r"^[a-zA-Z0-9-]{8,100}$"
LIMITS = {"section_id": 120, "section_title": 180, "selected_text": 1200, "comment": 4000}
CONTEXT = 240
BLANK = r"^\s+|\s+$"
SCOPE = ["owner_key", "document_id", "id"]


def list_annotations(annotation: DataFrame, owner: str, document: str) -> DataFrame:
    """Newest first; equal times by id."""
    mine = annotation.where((F.col("owner_key") == owner) & (F.col("document_id") == document))
    return mine.orderBy(F.col("created_at").desc(), F.col("id").desc())


def _trim(value: str | Column) -> Column:
    return F.regexp_replace(value, BLANK, "")


def owner_key(request: DataFrame) -> DataFrame:
    """``user:`` and the lower-case email, else ``session:`` and a well-formed id, else null."""
    email = F.lower(_trim("email"))
    session = _trim("session")
    key = F.when(F.length(email) > 0, F.concat(F.lit("user:"), email)).when(
        session.rlike(CLIENT_PATTERN), F.concat(F.lit("session:"), session)
    )
    return request.withColumn("owner_key", key)


def validate_annotations(request: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with trimmed texts and cut context, and rejects with reasons.

    Offsets arrive as doubles so that fractions can be refused.
    """
    trimmed = request.withColumns({name: _trim(name) for name in LIMITS})
    start, end = F.col("start_offset"), F.col("end_offset")

    def bad(ok: Column) -> Column:
        return ~F.coalesce(ok, F.lit(False))

    pairs = [
        ("owner", F.col("owner_key").isNull()),
        ("id", bad(F.col("id").rlike(CLIENT_PATTERN))),
        ("document_id", bad(F.col("document_id").rlike(DOCUMENT_PATTERN))),
    ]
    pairs += [(n, bad(F.length(n).between(1, top))) for n, top in LIMITS.items()]
    pairs += [
        ("start_offset", bad((start == F.floor(start)) & (start >= 0))),
        ("end_offset", bad((end == F.floor(end)) & (end > start))),
    ]
    tagged = trimmed.withColumn("reasons", reason_list(pairs))
    context = {
        n: F.coalesce(F.substring(n, 1, CONTEXT), F.lit("")) for n in ("prefix", "suffix")
    }
    good = tagged.where(F.size("reasons") == 0).drop("reasons").withColumns(context)
    good = good.withColumn("start_offset", start.cast("bigint")).withColumn(
        "end_offset", end.cast("bigint")
    )
    return good, tagged.where(F.size("reasons") > 0)


def apply_annotation_changes(annotation: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after an ordered log of inserts, updates and deletes.

    ``changes(op, seq, owner_key, document_id, id, comment, status, changed_at, ...)``.
    A change acts only inside its owner and document.  The effective insert is the first
    after the last delete (a second insert of a live id is refused); the last update after
    it sets comment, status and time.  Both are aggregates, so a much-edited id is not
    collected.
    """
    fields = [c for c in annotation.columns if c not in SCOPE]
    payload = [F.col(f) for f in fields]
    base = annotation.select(
        *SCOPE, F.lit("insert").alias("op"), F.lit(-1).cast("bigint").alias("seq"), *payload,
        F.lit(None).cast("string").alias("changed_at"),
    )
    log = base.unionByName(
        changes.select(*base.columns) if set(fields) <= set(changes.columns) else changes,
        allowMissingColumns=True,
    )
    deleted = log.groupBy(*SCOPE).agg(
        F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("_gone")
    )
    live = log.join(deleted, SCOPE).where(
        F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))
    )
    inserted = F.when(F.col("op") == "insert", F.col("seq"))
    updated = F.when(F.col("op") == "update", F.col("seq"))
    facts = live.groupBy(*SCOPE).agg(
        F.min(inserted).alias("_at"),
        F.min_by(F.struct(*fields), inserted).alias("_row"),
        F.max(updated).alias("_edit"),
        F.max_by(F.struct("comment", "status", "changed_at"), updated).alias("_new"),
    ).where(F.col("_at").isNotNull())
    edited = F.col("_edit") > F.col("_at")
    columns = []
    for name in annotation.columns:
        if name in SCOPE:
            columns.append(F.col(name))
            continue
        value = F.col(f"_row.{name}")
        if name in ("comment", "status"):
            value = F.when(edited, F.col(f"_new.{name}")).otherwise(value)
        if name == "updated_at":
            value = F.when(edited, F.col("_new.changed_at")).otherwise(value)
        columns.append(value.alias(name))
    return facts.select(*columns)


def section_at_offset(
    annotation: DataFrame, heading: DataFrame, keys: list[str], block: int = BLOCK
) -> DataFrame:
    """The last heading at or before the start offset, 'abstract' before the first.

    ``heading(keys, offset, place, section_id, section_title)``.  The lookup runs over the
    distinct offsets, which are unique per document, and the answers are joined back: a
    document with very many annotations is not sorted in one task.
    """
    marks = heading.groupBy(*keys, "offset").agg(
        F.max_by(F.struct("section_id", "section_title"), "place").alias("_mark")
    )
    asked = annotation.select(*keys, F.col("start_offset").alias("offset"))
    empty = F.lit(None).cast(marks.schema["_mark"].dataType)
    points = (
        marks.unionByName(asked.distinct().withColumn("_mark", empty))
        .groupBy(*keys, "offset")
        .agg(F.max("_mark").alias("_mark"))
    )
    found = carry_forward(points, keys, "offset", "_mark", "_section", block)
    answers = found.select(*keys, F.col("offset").alias("start_offset"), "_section")
    joined = annotation.join(answers, [*keys, "start_offset"], "left")
    return joined.select(
        *annotation.columns,
        F.coalesce("_section.section_id", F.lit("abstract")).alias("section_id"),
        F.coalesce("_section.section_title", F.lit("Abstract")).alias("section_title"),
    )


def feedback_markdown(annotation: DataFrame) -> DataFrame:
    """A numbered Markdown entry per annotation, newest first within owner and document."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    numbered = sorted_position(annotation, ["owner_key", "document_id"], order, "number")
    quoted = F.regexp_replace("selected_text", "\n", "\n> ")
    entry = F.format_string(
        "## %d. %s\n\n**Status:** %s\n\n> %s\n\n**Requested change:** %s\n",
        F.col("number"), F.col("section_title"), F.col("status"), quoted, F.col("comment"),
    )
    return numbered.select("owner_key", "document_id", "id", "number", entry.alias("entry"))


def annotation_counts(annotation: DataFrame, keys: list[str]) -> DataFrame:
    return annotation.groupBy(*keys).agg(
        count_if(F.col("status") == "open").alias("open"),
        count_if(F.col("status") == "applied").alias("applied"),
    )
