"""Digests of records and of tables.

A table digest must not depend on row order or on how rows are spread.  Each row's
SHA-256 is cut into eight 32-bit words and the words are summed over all rows together
with the row count; the digest is the SHA-256 of these nine numbers.  Sums combine
partially, so no rows are collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import every, finite

WORDS = 8


def record_digest(cols: Sequence[str]) -> Column:
    """SHA-256 of the record as JSON with sorted keys; a null field is written as null."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def record_fingerprint(df: DataFrame, cols: Sequence[str], out: str = "digest") -> DataFrame:
    return df.withColumn(out, record_digest(cols))


def _row_digest(cols: Sequence[str]) -> Column:
    """SHA-256 of the row's values as text, in the order given.

    Every value is preceded by its length and null is the letter n, so that different rows have
    different texts.
    """

    def written(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("n"))

    return F.sha2(F.concat(*[written(c) for c in cols]), 256)


def _sum_digest(digest: Column) -> Column:
    words = [
        F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)"))
        for i in range(WORDS)
    ]
    numbers = [F.count("*").cast("string")] + [w.cast("string") for w in words]
    return F.sha2(F.concat_ws("|", *numbers), 256)


def table_fingerprint(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], out: str = "digest"
) -> DataFrame:
    """One digest per ``keys`` over the multiset of rows, with the row count bound in."""
    rows = df.select(*keys, _row_digest(cols).alias("_d"))
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), _sum_digest(F.col("_d")).alias(out))


# Names of the seven parts of a linear program.
PARTS = ("A1", "A2", "b1", "b2", "c", "lower", "upper")


def lp_parts(a: DataFrame, row_vec: DataFrame, col_vec: DataFrame) -> DataFrame:
    """``(case_id, part, p, q, value)``: the seven parts as one long table."""
    none = F.lit(None).cast("bigint")
    matrix = a.select(
        "case_id", F.col("block").alias("part"), F.col("row").alias("p"), F.col("col").alias("q"), "value"
    )
    rhs = row_vec.select(
        "case_id",
        F.when(F.col("block") == "A1", "b1").otherwise("b2").alias("part"),
        F.col("row").alias("p"),
        none.alias("q"),
        F.col("b").alias("value"),
    )
    vectors = F.array(
        *[F.struct(F.lit(n).alias("part"), F.col(n).alias("value")) for n in ("c", "lower", "upper")]
    )
    cols = col_vec.select("case_id", F.explode(vectors).alias("v"), F.col("col").alias("p"))
    cols = cols.select("case_id", "v.part", "p", none.alias("q"), "v.value")
    return matrix.unionByName(rhs).unionByName(cols)


def lp_fingerprint(a: DataFrame, row_vec: DataFrame, col_vec: DataFrame) -> DataFrame:
    """Digest of the seven part digests per case; at most seven rows meet per case."""
    parts = table_fingerprint(
        lp_parts(a, row_vec, col_vec), ["case_id", "part"], ["p", "q", "value"]
    )
    wide = parts.groupBy("case_id").agg(
        *[F.max(F.when(F.col("part") == p, F.col("digest"))).alias(p) for p in PARTS]
    )
    return record_fingerprint(wide, PARTS)


def state_fingerprint(state_col: DataFrame, state_row: DataFrame) -> DataFrame:
    """Size, finiteness, range (zero included), norm and digest of x, y and z."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("x", "z")]
    )
    cols = state_col.select(
        "case_id", F.explode(pairs).alias("v"), F.lit("").alias("block"), F.col("col").alias("position")
    ).select("case_id", "v.name", "block", "position", "v.value")
    rows = state_row.select(
        "case_id", F.lit("y").alias("name"), "block", F.col("row").alias("position"), F.col("y").alias("value")
    )
    long = cols.unionByName(rows).withColumn("_d", _row_digest(["block", "position", "value"]))
    v, zero = F.col("value"), F.lit(0.0)
    return long.groupBy("case_id", "name").agg(
        F.count("*").alias("size"),
        every(finite("value")).alias("finite"),
        F.least(F.min(v), zero).alias("minimum"),
        F.greatest(F.max(v), zero).alias("maximum"),
        F.sqrt(F.sum(v * v)).alias("l2_norm"),
        _sum_digest(F.col("_d")).alias("digest"),
    )


def run_fingerprint(manifest: DataFrame, provenance: DataFrame) -> DataFrame:
    """One digest per run over its source manifest and its provenance record.

    ``manifest(run, path, sha256)``; ``provenance(run, config_sha256, versions)``.
    """
    sources = table_fingerprint(manifest, ["run"], ["path", "sha256"], "sources")
    joined = provenance.join(sources, "run", "left")
    return joined.select(
        "run", record_digest(["config_sha256", "versions", "sources"]).alias("run_fingerprint")
    )
