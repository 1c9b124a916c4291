"""Joins that deal the rows of frequent keys to many tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

#: Keys that one mergeable counter follows, and how many of them are looked at.
TRACKED = 8_192
LISTED = 512


@dataclass(frozen=True)
class Heavy:
    """Hashes of the frequent keys of one table, and the number of parts for each."""

    keys: tuple[str, ...]
    hashes: tuple[int, ...]
    ways: int

    def holds(self) -> Column:
        """True for a row whose key is frequent; two keys of one hash are both split, which is harmless."""
        return F.xxhash64(*self.keys).isin(list(self.hashes))


def find_heavy(df: DataFrame, *keys: str, share: float = 1 / 128, ways: int | None = None) -> Heavy:
    """The keys that hold at least ``share`` of the rows of ``df``.

    One pass: every partition counts in a sketch of fixed size, and sketches are merged, so the
    driver gets one row of at most ``LISTED`` counts, of which at most ``1 / share`` are frequent.
    The counter may be off by a small part of all rows; that only changes which keys are split,
    never the rows of a join.  ``ways`` is the number of shuffle partitions when unset.  A null key
    counts like any other.
    """
    if not 2 / LISTED <= share <= 1:
        raise ValueError(f"share must lie between {2 / LISTED} and 1")
    ways = ways or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.select(F.xxhash64(*keys).alias("key")).agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(key, {LISTED}, {TRACKED})").alias("top")
    )
    found = counted.first()
    top = [r["item"] for r in found["top"] or [] if r["count"] >= share * found["n"]]
    return Heavy(tuple(keys), tuple(sorted(top)), max(1, ways))


def plain(*keys: str) -> Heavy:
    """No frequent keys: ``join_heavy`` is then an ordinary join."""
    return Heavy(keys, (), 1)


def join_heavy(large: DataFrame, other: DataFrame, heavy: Heavy, how: str = "inner") -> DataFrame:
    """``large.join(other, keys, how)`` with the frequent keys of ``large`` dealt to many tasks.

    A row of ``large`` with a frequent key takes a part by the hash of all its values, and the rows
    of ``other`` with that key are repeated once per part: at most ``ways`` times, for at most
    ``1 / share`` keys.  All other rows meet as before.  ``how`` is inner, left or left_semi: each
    row of ``large`` is in one part, so no result row is lost or doubled.  Equal rows of ``large``
    share a part.  Both sides need keys of the same types, and none of a floating type, because
    equal keys must have equal hashes.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"a split join cannot be {how!r}")
    if not heavy.hashes or heavy.ways == 1:
        return large.join(other, list(heavy.keys), how)
    for key in heavy.keys:
        one, two = large.schema[key].dataType, other.schema[key].dataType
        if one != two or isinstance(one, FractionalType):
            raise ValueError(f"key {key} is {one.simpleString()} and {two.simpleString()}")
    part = F.pmod(F.xxhash64(F.lit("part"), *large.columns), F.lit(heavy.ways)).cast("int")
    parts = F.sequence(F.lit(0), F.lit(heavy.ways - 1))
    dealt = large.withColumn("_part", F.when(heavy.holds(), part).otherwise(F.lit(0)))
    repeated = other.withColumn(
        "_part", F.explode(F.when(heavy.holds(), parts).otherwise(F.array(F.lit(0))))
    )
    return dealt.join(repeated, [*heavy.keys, "_part"], how).drop("_part")
