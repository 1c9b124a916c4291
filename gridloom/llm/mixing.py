"""Mixing sources to target weights with a low-discrepancy source schedule.

Slot ``i`` of the schedule has the golden-ratio point ``frac((i + 1) * phi)``.  The point falls
into one source's interval of the cumulative weights, so every stretch of the schedule is close
to the weights.  A source's slots are ranked; its documents, shuffled by a seeded hash and read
repeatedly, are cut into as many blocks of equal token counts; slot and block of equal rank meet.

Defined results: a null text has no words; a document without words takes part in nothing and is
returned with 0; the null source is a source of its own, last in order; a source without words has
target 0; an empty table gives an empty mix; repeated rows are separate documents.  Only the columns
doc_id, text and source are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import position
from ..session import settle
from .ordering import bucket_totals, placed
from .text import WORD, leading_bits, shuffle_key, source_key, word_count

#: The golden ratio's fraction in units of 2**-64.
GOLDEN = 11400714819323198485
CELLS = 65_536
BUCKET_BITS = 12
SEED = 20


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2
) -> DataFrame:
    """source_size and target of every source (columns src, _size).

    The sources, in order, take ``weights`` in turn and share ``share`` times all sizes.  No
    target exceeds ``most`` times its source's size; the excess goes to the others by weight.
    In order of cap over weight, the level is that of the first source that it does not fill.
    """
    every = W.partitionBy()
    in_turn = F.array(*[F.lit(float(w)) for w in weights])
    by_fill = W.orderBy("_ratio", "_ix")
    sources = (
        sizes.groupBy("src")
        .agg(F.sum("_size").alias("source_size"))
        .withColumn("_ix", F.row_number().over(W.orderBy("src")) - 1)
        .withColumn("_w", F.get(in_turn, F.col("_ix") % len(weights)))
        .withColumn("_cap", (F.col("source_size") * most).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(every) * F.lit(share))
        .withColumn(
            "_filled",
            F.coalesce(
                F.sum("_cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)
            ),
        )
        .withColumn("_open", F.sum("_w").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_filled")) / F.col("_open"))
        .withColumn(
            "_first",
            F.min(
                F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_ix", "_level"))
            ).over(every),
        )
    )
    target = F.least(F.col("_cap"), F.col("_w") * F.col("_first._level"))
    return sources.select("src", "_ix", "source_size", target.alias("target"))


def golden_point(slot: Column) -> Column:
    """frac((slot + 1) * phi), exact to 2**-64 for slots below 10**18."""
    whole = (slot + 1).cast("decimal(18,0)") * F.lit(str(GOLDEN)).cast("decimal(20,0)")
    rest = F.pmod(whole, F.lit(str(2**64)).cast("decimal(20,0)"))
    return rest.cast("double") / F.lit(float(2**64))


def schedule(sources: DataFrame, block: int = 1024) -> DataFrame:
    """slot, src, rank: the sources in schedule order, about ``block`` tokens a slot.

    A source whose interval catches no point gets one slot at the end, so none is lost.
    """
    spark = sources.sparkSession
    by_ix = W.orderBy("_ix")
    edges = sources.where("target > 0").select(
        "src",
        "_ix",
        (F.sum("target").over(by_ix) / F.sum("target").over(W.partitionBy())).alias("_hi"),
        (
            F.coalesce(
                F.sum("target").over(by_ix.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)
            )
            / F.sum("target").over(W.partitionBy())
        ).alias("_lo"),
    )
    wanted = sources.agg(F.sum("target")).first()[0] or 0.0
    slots = int(-(-wanted // block))
    cell = lambda edge: F.least(F.floor(F.col(edge) * CELLS), F.lit(CELLS - 1))
    intervals = edges.withColumn("_cell", F.explode(F.sequence(cell("_lo"), cell("_hi"))))
    points = spark.range(slots).select(
        F.col("id").alias("slot"), golden_point(F.col("id")).alias("_point")
    )
    points = points.withColumn("_cell", F.floor(F.col("_point") * CELLS))
    caught = (
        points.join(intervals, "_cell")
        .where((F.col("_point") >= F.col("_lo")) & (F.col("_point") < F.col("_hi")))
        .select("slot", "src")
    )
    missed = edges.join(caught.select("src").distinct(), "src", "left_anti").select(
        (F.lit(slots) + F.col("_ix")).cast("bigint").alias("slot"), "src"
    )
    return position(caught.unionByName(missed), ["src"], "slot", "rank", block=4096)


def shuffled(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Settled: doc_id, src, _size, _key, _bucket of every document."""
    return settle(
        docs.select(
            F.col("doc_id"),
            source_key(F.col("source")).alias("src"),
            word_count(F.col("text")).alias("_size"),
            shuffle_key(F.col("doc_id"), seed).alias("_key"),
        ).withColumn("_bucket", leading_bits(F.col("_key"), BUCKET_BITS))
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    block: int = 1024,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs``: (documents, spans).

    documents: doc_id, src, bucket, place (the row's identity), size, source_size, target.
    spans: slot, src, rank, bucket, place, doc_id, copy, first (word of the document), tokens.
    Reading the spans by slot, copy and first gives the mixed stream.
    """
    rows = shuffled(docs, seed)
    sources = settle(targets(rows, weights, share, most))
    slots = settle(schedule(sources, block))
    totals = bucket_totals(rows, "src", "_size")
    found = slots.groupBy("src").agg(F.count("*").alias("_slots"))
    plan = sources.join(found, "src", "left").select(
        "src",
        "source_size",
        "target",
        F.round("target").cast("bigint").alias("_goal"),
        F.coalesce("_slots", F.lit(0)).alias("_slots"),
    )
    documents = settle(
        placed(rows, totals.join(plan, "src"), "src", "_size", ["_key", "doc_id", "_size"])
    )
    copies = F.sequence(F.lit(0), F.lit(most - 1))
    taken = (
        documents.where("_size > 0 AND _goal > 0")
        .withColumn("copy", F.explode(copies))
        .withColumn("_from", F.col("copy") * F.col("source_size") + F.col("_start"))
        .withColumn("_to", F.least(F.col("_from") + F.col("_size"), F.col("_goal")))
        .where("_from < _to")
        .withColumn("_wide", F.expr("_goal % _slots"))
        .withColumn("_q", F.expr("_goal div _slots"))
    )

    def rank_at(at: Column) -> Column:
        """The block that holds a position: the first _wide blocks have one token more."""
        wide, q = F.col("_wide"), F.col("_q")
        edge = wide * (q + 1)
        rest = F.greatest(q, F.lit(1))
        in_wide, in_rest = F.floor(at / (q + 1)), wide + F.floor((at - edge) / rest)
        return F.when(at < edge, in_wide).otherwise(in_rest).cast("bigint")

    cut = taken.withColumn(
        "rank", F.explode(F.sequence(rank_at(F.col("_from")), rank_at(F.col("_to") - 1)))
    )
    low = F.col("rank") * F.col("_q") + F.least("rank", "_wide")
    high = (F.col("rank") + 1) * F.col("_q") + F.least(F.col("rank") + 1, F.col("_wide"))
    blocks = cut.select(
        "src",
        "rank",
        F.col("_bucket").alias("bucket"),
        F.col("_place").alias("place"),
        "doc_id",
        "copy",
        (F.greatest(low, F.col("_from")) - F.col("_from")).alias("first"),
        (F.least(high, F.col("_to")) - F.greatest(low, F.col("_from"))).alias("tokens"),
    )
    spans = slots.join(blocks, ["src", "rank"])
    listed = documents.select(
        "doc_id",
        "src",
        F.col("_bucket").alias("bucket"),
        F.col("_place").alias("place"),
        F.col("_size").alias("size"),
        "source_size",
        "target",
    )
    return listed, spans


def words_taken(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``documents`` with ``taken``: the words that all spans of a row hold."""
    names = documents.columns
    amounts = documents.select("src", "bucket", "place", F.struct(*names).alias("_row")).withColumn(
        "tokens", F.lit(0).cast("bigint")
    )
    parts = spans.select(
        "src", "bucket", "place", F.lit(None).cast(amounts.schema["_row"].dataType).alias("_row"), "tokens"
    )
    whole = amounts.unionByName(parts).groupBy("src", "bucket", "place")
    return whole.agg(F.max("_row").alias("_row"), F.sum("tokens").alias("taken")).select(
        *[F.col(f"_row.{n}").alias(n) for n in names], "taken"
    )


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with every row's copies as the schedule's spans hold them.

    The spans of a copy begin at the text's first word and follow each other.  Where they end
    before the text does, at a source's target, the copy's text ends with their last word, and
    n_chars, if there, counts what is left.  A document without words is in no span and goes.
    """
    _, spans = mix(docs, weights, share, most, seed=seed)
    taken = spans.groupBy("src", "bucket", "place", "copy").agg(F.sum("tokens").alias("_taken"))
    packed = docs.select(
        F.struct("*").alias("_row"),
        F.col("doc_id").alias("_id"),
        source_key(F.col("source")).alias("src"),
        word_count(F.col("text")).alias("_size"),
        shuffle_key(F.col("doc_id"), seed).alias("_key"),
    ).withColumn("_bucket", leading_bits(F.col("_key"), BUCKET_BITS))
    # rows with equal key, id and size are interchangeable: any order of them fits the spans
    totals = bucket_totals(packed, "src", "_size")
    rows = placed(packed, totals, "src", "_size", ["_key", "_id", "_size"]).select(
        "src", F.col("_bucket").alias("bucket"), F.col("_place").alias("place"), "_size", "_row"
    )
    row, cut = F.col("_row"), F.col("_taken") < F.col("_size")
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    left = F.array_join(F.slice(words, 1, F.col("_taken").cast("int")), "")
    row = row.withField("text", F.when(cut, left).otherwise(F.col("_row.text")))
    if "n_chars" in docs.columns:
        count = F.char_length(left).cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(cut, count).otherwise(F.col("_row.n_chars")))
    return rows.join(taken, ["src", "bucket", "place"]).select(row.alias("_row")).select("_row.*")
