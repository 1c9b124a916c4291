"""Run logs, evidence documents, row metadata, CSV tables and file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import RUN_LOG, with_corrupt

Paths = str | list[str]


def _parse(text: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Readable records of ``text(path, value)``, and ``(path, record)`` of the others."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = text.select("path", "value", F.from_json("value", with_corrupt(schema), options).alias("_r"))
    broken = F.col("_r").isNull() | F.col("_r._corrupt_record").isNotNull()
    rejects = parsed.where(broken).select("path", F.col("value").alias("record"))
    return parsed.where(~broken).select("_r.*").drop("_corrupt_record"), rejects


def read_run_log(
    spark: SparkSession, paths: Paths, schema: StructType = RUN_LOG
) -> tuple[DataFrame, DataFrame]:
    """JSON lines, plain or gzip, with a declared schema; blank lines are no rows.

    A gzip file is read by one task, so large logs should be many files.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    return _parse(lines.where(F.trim("value") != ""), schema)


def read_evidence_json(
    spark: SparkSession, paths: Paths, schema: StructType
) -> tuple[DataFrame, DataFrame]:
    """One JSON object per file; a file that is not an object is a reject."""
    files = spark.read.text(paths, wholetext=True)
    return _parse(files.select(F.col("_metadata.file_path").alias("path"), "value"), schema)


def read_table_csv(spark: SparkSession, path: Paths, schema: StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", escape='"')


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, escape='"')


def write_row_metadata(constraint_row: DataFrame, path: str) -> int:
    """One gzip JSON line per constraint row; the count is taken while writing."""
    seen = Observation()
    constraint_row.observe(seen, F.count(F.lit(1)).alias("rows")).write.json(path, compression="gzip")
    return seen.get["rows"]


def write_run_log(trajectory: DataFrame, policy_event: DataFrame, path: str) -> None:
    """Both record types in one log, each with its own fields."""
    both = trajectory.unionByName(policy_event, allowMissingColumns=True)
    both.write.json(path, compression="gzip")


def content_manifest(files: DataFrame, content: str = "content") -> DataFrame:
    """``path``, size and SHA-256 of each row's content."""
    octets = F.col(content).cast("binary")
    return files.select(
        "path",
        F.octet_length(octets).cast("bigint").alias("bytes"),
        F.sha2(octets, 256).alias("sha256"),
    )


def file_manifest(spark: SparkSession, paths: Paths) -> DataFrame:
    """Path, size and SHA-256 of each file, one file (of less than 2 GiB) per row."""
    return content_manifest(spark.read.format("binaryFile").load(paths))
