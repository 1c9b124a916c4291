"""Campaign state, check reports, manifests and text coverage.

``order(case_id, seq, key)`` is the campaign order and ``attempt(case_id, key, attempt,
status)`` the recorded results.  "First" positions are minima of one aggregation; no
campaign is sorted or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if, every
from ..functions.ordered import BLOCK, position

# Statuses that end an attempt, and those that need another try.
STOPPED = ("FAIL", "TIME_LIMIT", "MEMORY_BLOCKED")
INTERRUPTED = ("PENDING", "RUNNING")


def latest_attempt(attempt: DataFrame, keys: Sequence[str] = ("case_id", "key")) -> DataFrame:
    """The newest attempt of each key; earlier ones stay in ``attempt``."""
    rest = [c for c in attempt.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), "attempt").alias("_a")
    return attempt.groupBy(*keys).agg(newest, F.count("*").alias("attempts")).select(
        *keys, "_a.*", "attempts"
    )


def compatible_runs(attempt: DataFrame, current: DataFrame) -> DataFrame:
    """Attempts whose fingerprint is among the current ones."""
    return attempt.join(current.select("fingerprint").distinct(), "fingerprint", "left_semi")


def _with_status(order: DataFrame, attempt: DataFrame) -> DataFrame:
    latest = latest_attempt(attempt).select("case_id", "key", "status")
    return order.join(latest, ["case_id", "key"], "left")


def _open() -> Column:
    return ~F.coalesce(F.col("status") == "PASS", F.lit(False))


def passing_prefix(order: DataFrame, attempt: DataFrame) -> DataFrame:
    """Length of the leading run of PASS: the rows before the first that is not."""
    rows = _with_status(order, attempt)
    stop = rows.groupBy("case_id").agg(F.min(F.when(_open(), F.col("seq"))).alias("_stop"))
    joined = rows.join(stop, "case_id")
    before = F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))
    return joined.groupBy("case_id").agg(
        count_if(before).alias("passing_prefix"), F.count("*").alias("rows")
    )


def next_key(order: DataFrame, attempt: DataFrame, retry_failed: bool = False) -> DataFrame:
    """The first key that is not PASS, if it may run: it is new, or a retry was asked for."""
    rows = _with_status(order, attempt)
    first = F.min_by(F.struct("key", "status"), F.when(_open(), F.col("seq"))).alias("_f")
    found = rows.groupBy("case_id").agg(first)
    retry = F.lit(retry_failed) & F.col("_f.status").isin(*STOPPED, *INTERRUPTED)
    may_run = F.col("_f.status").isNull() | retry
    return found.select("case_id", F.when(may_run, F.col("_f.key")).alias("next_key"))


def campaign_status(order: DataFrame, attempt: DataFrame) -> DataFrame:
    """Overall status, the key that needs a retry and the next authorised key."""
    rows = _with_status(order, attempt)

    def first(statuses: Sequence[str]) -> Column:
        inside = F.col("status").isin(*statuses)
        return F.min_by(F.struct("key", "status"), F.when(inside, F.col("seq")))

    facts = rows.groupBy("case_id").agg(
        first(STOPPED).alias("_stopped"),
        first(INTERRUPTED).alias("_interrupted"),
        F.min_by("key", F.when(_open(), F.col("seq"))).alias("_next"),
        F.min_by(F.coalesce(F.col("status"), F.lit("")), "seq").alias("_first_status"),
    )
    stopped, waiting = F.col("_stopped").isNotNull(), F.col("_interrupted").isNotNull()
    finished = F.col("_next").isNull()
    status = (
        F.when(F.col("_stopped.status") == "MEMORY_BLOCKED", "COMPLETE_WITH_RESOURCE_LIMIT")
        .when(stopped, "STOPPED_ON_FAILURE")
        .when(waiting, "RETRY_REQUIRED")
        .when(finished, "PASS")
        .when(F.col("_first_status") == "PASS", "PARTIAL_PASS")
        .otherwise("PLANNED")
    )
    return facts.select(
        "case_id",
        status.alias("status"),
        (finished | stopped).alias("complete"),
        F.when(~stopped & ~waiting, F.col("_next")).alias("next_authorized_key"),
        F.col("_interrupted.key").alias("retry_required_key"),
    )


def bypass_check(order: DataFrame, attempt: DataFrame) -> DataFrame:
    """Recorded keys that are unlisted, repeated, or follow a predecessor without PASS.

    ``attempt`` holds one row per key here; a second row is a duplicate.
    """
    keyed = attempt.groupBy("case_id", "key").agg(
        F.count("*").alias("copies"), F.max("status").alias("status")
    )
    unlisted = keyed.join(order, ["case_id", "key"], "left_anti").select(
        "case_id", "key", F.lit("unlisted").alias("reason")
    )
    double = keyed.where(F.col("copies") > 1).select(
        "case_id", "key", F.lit("duplicate").alias("reason")
    )
    rows = order.join(keyed, ["case_id", "key"], "left")
    stop = rows.groupBy("case_id").agg(F.min(F.when(_open(), F.col("seq"))).alias("_stop"))
    later = rows.where(F.col("status").isNotNull()).join(stop, "case_id")
    passed_over = later.where(F.col("seq") > F.col("_stop")).select(
        "case_id", "key", F.lit("bypasses_predecessor").alias("reason")
    )
    return unlisted.unionByName(double).unionByName(passed_over)


def allocation_order_check(
    history: DataFrame, order: DataFrame, invocation: DataFrame, block: int = BLOCK
) -> DataFrame:
    """History rows against the campaign order and their invocation, summed per case.

    ``history(case_id, ordinal, key, invocation_id, gate_passed)``;
    ``invocation(case_id, invocation_id, mode, approved, allocated_keys)``.  First
    occurrences must follow the campaign order without a gap: the n-th new key is the
    n-th key of the order.
    """
    listed = position(order.select("case_id", "seq", "key"), ["case_id"], "seq", "_place", block)
    joined = history.join(listed.select("case_id", "key", "_place"), ["case_id", "key"], "left")
    joined = joined.join(invocation, ["case_id", "invocation_id"], "left")
    ok = (
        F.col("_place").isNotNull()
        & (F.col("mode") == "run_next")
        & F.col("approved")
        & (F.col("allocated_keys") == F.array("key"))
        & F.col("gate_passed")
    )
    rows = joined.groupBy("case_id").agg(
        F.count("*").alias("attempts"), count_if(~F.coalesce(ok, F.lit(False))).alias("invalid_rows")
    )
    first = joined.where(F.col("_place").isNotNull()).groupBy("case_id", "key", "_place").agg(
        F.min("ordinal").alias("_first")
    )
    ranked = position(first, ["case_id"], "_first", "_nth", block)
    order_ok = ranked.groupBy("case_id").agg(
        F.count("*").alias("unique_keys"),
        count_if(F.col("_nth") != F.col("_place")).alias("out_of_order"),
    )
    found = rows.join(order_ok, "case_id", "left").na.fill(0)
    passed = (F.col("invalid_rows") == 0) & (F.col("out_of_order") == 0)
    return found.withColumn("passed", passed)


def stage_check_summary(checks: DataFrame, interpretation: DataFrame | None = None) -> DataFrame:
    """Passed and total checks and the overall flag of each scope."""
    found = checks.groupBy("scope").agg(
        count_if(F.col("passed")).alias("passed_checks"),
        F.count("*").alias("total_checks"),
        F.when(every(F.col("passed")), "PASS").otherwise("FAIL").alias("checker_result"),
    )
    return found if interpretation is None else found.join(interpretation, "scope", "left")


def coverage_counts(structural: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The report's headline counts, one row, from one aggregation of each table."""
    allocated = F.col("full_lp_allocated")
    left = structural.agg(
        F.count("*").alias("symbolic_rows"),
        count_if(F.col("dimension_match")).alias("dimension_matches"),
        count_if(F.col("nnz_match")).alias("nnz_matches"),
    )
    right = benchmark.agg(
        count_if(allocated).alias("allocated_rows"),
        count_if(allocated & (F.col("gpu_status") == "SUCCESS")).alias("validated_gpu_rows"),
        count_if(allocated & (F.col("cpu_status") == "SUCCESS")).alias("validated_cpu_rows"),
        count_if(F.col("row_status").isin("MEMORY_BLOCKED", "INDEX_BLOCKED")).alias(
            "resolved_without_allocation"
        ),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])


def assert_table_invariants(df: DataFrame, scope: str, facts: dict[str, Column]) -> DataFrame:
    """Aggregate conditions of one table as rows of a checks table."""
    row = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in facts.items()])
    names = [F.struct(F.lit(n).alias("name"), F.col(n).alias("passed")) for n in facts]
    return row.select(F.explode(F.array(*names)).alias("f")).select(
        F.lit(scope).alias("scope"), "f.name", "f.passed"
    )


def manifest_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Paths whose digest or size changed, vanished or appeared."""
    pair = stored.select("path", F.col("sha256").alias("stored_sha256"), F.col("bytes").alias("stored_bytes")).join(
        current, "path", "full_outer"
    )
    drift = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("stored_sha256").isNull(), "unexpected")
        .when(F.col("sha256") != F.col("stored_sha256"), "changed")
        .when(F.col("bytes") != F.col("stored_bytes"), "size_changed")
    )
    return pair.withColumn("drift", drift).where(F.col("drift").isNotNull()).select("path", "drift")


def text_coverage(document: DataFrame, phrase: DataFrame) -> DataFrame:
    """Required subjects of a document of which no wording occurs in its whole text.

    ``document(doc_id, text)`` and ``phrase(doc_id, subject, wording)``: a subject names
    its document, so a text meets only its own wordings, all beside one copy of it.
    """
    asked = phrase.groupBy("doc_id").agg(
        F.collect_set(F.struct("subject", F.lower("wording").alias("wording"))).alias("_asked")
    )
    beside_text = asked.join(document.select("doc_id", F.lower("text").alias("_low")), "doc_id", "left")
    checks = F.transform(
        "_asked",
        lambda a: F.struct(
            a["subject"].alias("subject"),
            F.coalesce(F.contains(F.col("_low"), a["wording"]), F.lit(False)).alias("found"),
        ),
    )
    found = beside_text.select("doc_id", checks.alias("_c")).select("doc_id", F.explode("_c").alias("_c"))
    present = found.groupBy("doc_id", F.col("_c.subject").alias("subject")).agg(
        F.max("_c.found").alias("present")
    )
    return present.where(~F.col("present")).select("doc_id", "subject")


def status_counts(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of each kind of status and the passed share in whole percent."""
    s = F.col("status")
    total = F.count("*")
    passed = count_if(s == "passed")
    return rows.groupBy(*keys).agg(
        passed.alias("passed"),
        count_if(s == "failed").alias("failed"),
        count_if(s.isin("passed", "failed")).alias("attempted"),
        count_if(s.isin("memory-blocked", "index-blocked")).alias("blocked"),
        count_if(~s.isin("queued", "running", "locked")).alias("recorded"),
        total.alias("total"),
        F.floor(100.0 * passed / total + 0.5).cast("bigint").alias("percent"),
    )


def stage_search(stages: DataFrame, status: str, text: str) -> DataFrame:
    """Stages by status ('all' for any) with the text in title, purpose or any task.

    ``stages(id, title, purpose, status, tasks ARRAY<STRUCT<id, title>>)``; task ids are
    compared as they are, everything else without case.
    """
    wanted = text.strip().lower()
    hit = F.lit(True)
    if wanted:
        w = F.lit(wanted)
        hit = (
            F.contains(F.lower("title"), w)
            | F.contains(F.lower("purpose"), w)
            | F.exists("tasks", lambda k: F.contains(k["id"], w) | F.contains(F.lower(k["title"]), w))
        )
    kept = stages.where(hit)
    return kept if status == "all" else kept.where(F.col("status") == status)


def current_stage(stages: DataFrame, keys: Sequence[str] = (), last_core: int = 9) -> DataFrame:
    """The active stage, else the newer of the last complete and the first stopped one,
    else the first; and the first locked stage after it.

    The locked stage needs the current one, so the second pass joins one row per key.
    """
    core = F.col("id") <= last_core
    one = F.lit(1).alias("_one")
    keys = [*keys, "_one"]
    rows = stages.select("*", one)

    def first(status: str) -> Column:
        return F.min(F.when(core & (F.col("status") == status), F.col("id")))

    facts = rows.groupBy(*keys).agg(
        first("active").alias("_active"),
        first("stopped").alias("_stopped"),
        F.max(F.when(core & (F.col("status") == "complete"), F.col("id"))).alias("_complete"),
        F.min("id").alias("_least"),
    )
    newer = F.when(
        F.col("_stopped").isNull() | (F.col("_complete") > F.col("_stopped")), F.col("_complete")
    )
    current = F.coalesce(F.col("_active"), newer, F.col("_stopped"), F.col("_least"))
    facts = facts.select(*keys, current.alias("current"))
    locked = rows.join(facts, keys)
    after = core & (F.col("id") > F.col("current")) & (F.col("status") == "locked")
    return locked.groupBy(*keys, "current").agg(
        F.min(F.when(after, F.col("id"))).alias("next_locked")
    ).drop("_one")
