"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "gridloom", **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``master`` is left to spark-submit when unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only for a local master: on a cluster a machine-local
    folder would be lost with its machine, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="gridloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The plan then starts at Parquet files: an executor loss recomputes nothing above
    them, an iteration's plan stays short, and the optimizer knows the real size, so a
    join broadcasts this side only when the file size is under its threshold.  ``options``
    go to the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridloom-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled_at = path
    return back


def settled(df: DataFrame) -> DataFrame:
    """``df`` itself if ``settle`` made it, else ``settle(df)``."""
    return df if getattr(df, "_settled_at", None) else settle(df)


def settle_bucketed(df: DataFrame, *keys: str, **options: str) -> DataFrame:
    """``settle`` as a table bucketed by ``keys``.

    Joins and aggregations by exactly these keys then move only the other side.  There are as many
    buckets as shuffle partitions, so the other side is dealt alike; the rows are dealt first, so a
    task writes one file per bucket that it holds.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"gridloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.options(**options).option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
    back = spark.table(name)
    back._settled_at, back._table = path, name
    return back


def release(*tables: DataFrame | None) -> None:
    """Delete settled tables that a loop has replaced.

    Call it only after the table that replaces them has been written.  Anything that was
    not made by ``settle`` is left alone.
    """
    for df in tables:
        path = getattr(df, "_settled_at", None)
        if path is None:
            continue
        spark = df.sparkSession
        if getattr(df, "_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {df._table}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def beside(small: DataFrame) -> DataFrame:
    """The lookup side of a join whose other side was unfolded.

    The optimizer takes an unfolded table for as small as its source and might broadcast
    it.  So the lookup side is broadcast when its own size, which for a settled table is
    its file size, is under the session's threshold; otherwise the join is sorted, where
    adaptive execution splits hot keys.
    """
    size = int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(small) if size <= broadcast_limit(small) else small.hint("merge")


def broadcast_limit(df: DataFrame) -> int:
    """Bytes up to which the session broadcasts a table."""
    return df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def unfolded(df: DataFrame) -> DataFrame:
    """Mark an unfolded table so that a join with another large table does not broadcast it."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows to all shuffle partitions, before a step that makes much work or many rows of each.

    A small file is one task however many rows follow from it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
