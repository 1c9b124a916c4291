"""Check run-log rows as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import reason_list
from ..operators.runlog import policy_conditions, trajectory_conditions
from ..schemas import RUN_LOG, with_corrupt


def tag_rows(log: DataFrame, interval: int) -> DataFrame:
    """Every row with its reasons and outcome; no state, so any batch split gives the same."""
    event = F.col("record_type") == "policy_event"
    known = event | (F.col("record_type") == "trajectory")
    of_event = reason_list(policy_conditions(interval))
    of_row = reason_list(trajectory_conditions())
    reasons = (
        F.when(F.col("_corrupt_record").isNotNull(), F.array(F.lit("unreadable")))
        .when(~F.coalesce(known, F.lit(False)), F.array(F.lit("record_type")))
        .when(event, of_event)
        .otherwise(of_row)
    )
    return log.withColumn("reasons", reasons).withColumn(
        "outcome", F.when(F.size("reasons") == 0, "valid").otherwise("rejected")
    )


def stream_run_log(
    spark: SparkSession, log_dir: str, out_dir: str, checkpoint: str, interval: int = 100
) -> StreamingQuery:
    """Tag the log's rows and append them to Parquet by outcome, then stop when caught up.

    The file sink and the checkpoint together write each row once; a later call goes on
    with the files that arrived since.
    """
    raw = spark.readStream.schema(with_corrupt(RUN_LOG)).json(log_dir)
    return (
        tag_rows(raw, interval)
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .partitionBy("outcome")
        .trigger(availableNow=True)
        .start()
    )
