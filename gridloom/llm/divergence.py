"""Divergence between sources of a language, by a frequent-pattern tree of term rows.

A term is a run of letters and of characters outside ASCII; only A-Z are lowered.  A language keeps the
terms that enough of its documents hold.  Shares are whole numbers per thousand million, smoothed:
``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))``, and two shares differ by
``f = floor((p - q)**2 / (p + q))``.

For all pairs of sources the sum of f over all kept terms is wanted.  Almost all terms are absent
from some source, so the sum starts from ``V * f(zero share, zero share)`` and is corrected:

* every share that is not a zero share, against the zero share of each other source;
* both shares of a pair that hold the term, by what the two corrections above got wrong.

A term's row is the list of its nonzero shares in the order of the sources.  Rows are inserted into a
prefix tree: a node is a prefix, with the number of terms that pass it.  Equal beginnings share nodes,
and the pair correction is computed once for each node and ancestor, times the node's terms.  All of
it is sums by key with partial sums first, so neither a large language nor a frequent prefix lands in
one task.  A row is never longer than the number of sources.

All arithmetic is in whole numbers; products above 64 bits are decimals.

Defined results: null texts, languages and sources are empty texts; a language without kept terms
has value 0 for each pair and no term rows; repeated rows count again; a long text is read in
stretches; an empty table gives no rows.  Only text, lang and source are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import release, settle

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: A place in a term's row: the source's number above this many bits, and the share in them.
PLACE_BITS = 31
#: Entries that a task gathers before it hands them on.
GATHERED = 100_000
#: Octets of a text whose terms are held at once.
STRETCH = 1_000_000

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_OTHERS = bytes(set(range(256)) - set(_LETTERS))
#: Other octets become spaces, A-Z become a-z.
_TO_TERMS = bytes.maketrans(
    _OTHERS + bytes(range(65, 91)), b" " * len(_OTHERS) + bytes(range(97, 123))
)


def terms(text: bytes) -> Counter:
    """How often each term occurs in a text."""
    text, at, found = text.translate(_TO_TERMS), 0, Counter()
    while len(text) - at > STRETCH:
        cut = text.find(b" ", at + STRETCH)
        if cut < 0:
            break
        found.update(text[at:cut].split())
        at = cut
    found.update(text[at:].split())
    return found


COUNTED = "lang string, source string, term string, count long, docs long"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of the terms of each language and source, summed over many rows.

    A row without a term stands for its language and source.
    """
    held: dict[tuple, list] = {}

    def listed() -> pa.RecordBatch:
        keys, sums = list(held), list(held.values())
        columns = [[k[i] for k in keys] for i in range(3)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.binary()).cast(pa.string()) for c in columns]
            + [pa.array([s[i] for s in sums], pa.int64()) for i in range(2)],
            names=["lang", "source", "term", "count", "docs"],
        )

    for batch in batches:
        sides = [batch.column(name).cast(pa.binary()) for name in ("lang", "source", "text")]
        for lang, source, text in zip(*[(v.as_py() or b"" for v in side) for side in sides]):
            found = terms(text)
            found[None] = 0
            for term, times in found.items():
                sums = held.get((lang, source, term))
                if sums is None:
                    held[lang, source, term] = [times, 1]
                else:
                    sums[0] += times
                    sums[1] += 1
            if len(held) >= GATHERED:
                yield listed()
                held.clear()
    if held:
        yield listed()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (null once for each source), count (occurrences) and docs."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    found = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_gather, COUNTED)
    return found.groupBy("lang", "source", "term").agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs")
    )


def share(count: Column, total: Column, kept: Column) -> Column:
    """The smoothed share of a count, as a whole number."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + 2 * kept).cast("decimal(20,0)")) + 1


def differ(p: Column, q: Column) -> Column:
    """f of two shares: at most 10**18 above the line, which 64 bits hold."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS
) -> tuple[DataFrame, DataFrame]:
    """Two tables: of every pair of sources, and of each source's overused terms.

    Pairs: lang, source, item (the other source), value, rank.  Terms: the same columns, item a
    term that the source uses more than its language does, ranks up to ``top_terms``.
    """
    counts = settle(term_counts(docs))
    rows = settle(
        counts.where(F.col("term").isNotNull())
        .groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum("count").alias("count"),
            F.collect_list(F.struct("source", "count")).alias("items"),
        )
        .where(F.col("docs") >= least_documents)
        .drop("docs")
    )
    sources, langs = _totals(counts, rows)
    placed = settle(_places(rows, langs))
    release(rows)
    pairs = _pair_values(placed, sources, langs)
    words = _term_values(placed)
    return _ranked(pairs, None), _ranked(words, top_terms)


def _totals(counts: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per source: lang, source, ix, n, kept, zero.  Per language: lang, n, kept, names (its sources'
    names in order) and sums (their n)."""
    items = rows.select("lang", F.explode("items").alias("i"))
    sums = items.groupBy("lang", F.col("i.source").alias("source")).agg(
        F.sum("i.count").alias("n")
    )
    kept = rows.groupBy("lang").agg(F.count("*").alias("kept"))
    known = counts.where(F.col("term").isNull()).select("lang", "source")
    sources = (
        known.join(sums, ["lang", "source"], "left")
        .join(kept, "lang", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("kept", F.coalesce("kept", F.lit(0)))
        .withColumn("ix", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    )
    sources = settle(
        sources.withColumn(
            "zero", F.when(F.col("kept") > 0, share(F.lit(0).cast("bigint"), F.col("n"), F.col("kept")))
        )
    )
    one = F.sort_array(F.collect_list(F.struct("ix", "source", "n", "zero")))
    langs = settle(
        sources.groupBy("lang").agg(
            F.sum("n").alias("total"), F.max("kept").alias("kept"), one.alias("sources")
        )
    )
    return sources, langs


def _places(rows: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, term, p (the language's share) and items: source, ix, share p, in the sources' order."""
    joined = rows.join(langs.where("kept > 0"), "lang").withColumn(
        "_at", F.map_from_entries(F.transform("sources", lambda s: F.struct(s["source"], s)))
    )

    def place(item: Column) -> Column:
        side = F.col("_at")[item["source"]]
        return F.struct(
            side["ix"].alias("ix"),
            share(item["count"], side["n"], F.col("kept")).alias("p"),
            item["source"].alias("source"),
        )

    return joined.select(
        "lang",
        "term",
        share(F.col("count"), F.col("total"), F.col("kept")).alias("p"),
        F.sort_array(F.transform("items", place)).alias("items"),
    )


def tree_nodes(placed: DataFrame) -> DataFrame:
    """lang, path (the places of a prefix, the node's own last) and terms that pass the node."""
    code = lambda i: F.shiftleft(i["ix"].cast("bigint"), PLACE_BITS) + i["p"]
    whole = placed.select("lang", F.transform("items", code).alias("path"))
    whole = whole.groupBy("lang", "path").agg(F.count("*").alias("terms"))
    depth = F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth")
    prefixes = whole.select("lang", "path", "terms", depth)
    return prefixes.groupBy("lang", F.slice("path", F.lit(1), F.col("depth")).alias("path")).agg(
        F.sum("terms").alias("terms")
    )


def _pair_values(placed: DataFrame, sources: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of a language's sources."""
    nodes = settle(tree_nodes(placed))
    zeros = langs.select("lang", F.col("sources.zero").alias("zeros"))
    ix = lambda code: F.shiftright(code, PLACE_BITS).cast("int")
    p = lambda code: code.bitwiseAND((1 << PLACE_BITS) - 1)
    zero = lambda code: F.element_at("zeros", ix(code) + 1)

    # a node against each ancestor: what the two corrections against zero shares got wrong
    own = F.element_at("path", -1)
    above = nodes.where(F.size("path") > 1).join(zeros, "lang")
    above = above.withColumn("own", own).withColumn(
        "anc", F.explode(F.slice("path", F.lit(1), F.size("path") - 1))
    )
    a, b = F.col("anc"), F.col("own")
    wrong = differ(p(a), p(b)) - differ(p(a), zero(b)) - differ(zero(a), p(b)) + differ(zero(a), zero(b))
    both = above.groupBy("lang", ix(a).alias("a"), ix(b).alias("b")).agg(
        F.sum(F.col("terms") * wrong).alias("value")
    )
    # a share against the zero share of each other source, once for each share
    single = nodes.groupBy("lang", own.alias("own")).agg(F.sum("terms").alias("terms"))
    single = single.join(zeros, "lang").select(
        "lang", "own", "terms", "zeros", F.posexplode("zeros").alias("u", "other")
    )
    single = single.where(ix(F.col("own")) != F.col("u"))
    gain = differ(p(F.col("own")), F.col("other")) - differ(zero(F.col("own")), F.col("other"))
    single = single.select(
        "lang",
        F.least(ix(F.col("own")), F.col("u")).alias("a"),
        F.greatest(ix(F.col("own")), F.col("u")).alias("b"),
        (F.col("terms") * gain).alias("value"),
    )
    corrections = (
        both.unionByName(single).groupBy("lang", "a", "b").agg(F.sum("value").alias("correction"))
    )
    # every pair of a language, from the list of its sources
    listed = sources.join(langs.select("lang", "sources"), "lang").select(
        "lang", "source", "ix", "kept", "zero", F.explode("sources").alias("o")
    )
    listed = listed.where(F.col("ix") != F.col("o.ix")).select(
        "lang",
        "source",
        F.col("o.source").alias("item"),
        F.least("ix", F.col("o.ix")).alias("a"),
        F.greatest("ix", F.col("o.ix")).alias("b"),
        F.coalesce(F.col("kept") * differ(F.col("zero"), F.col("o.zero")), F.lit(0)).alias("base"),
    )
    return listed.join(corrections, ["lang", "a", "b"], "left").select(
        "lang",
        "source",
        "item",
        (F.col("base") + F.coalesce("correction", F.lit(0))).cast("bigint").alias("value"),
    )


def _term_values(placed: DataFrame) -> DataFrame:
    used = placed.select("lang", "term", F.col("p").alias("q"), F.explode("items").alias("i"))
    return used.where(F.col("i.p") > F.col("q")).select(
        "lang",
        F.col("i.source").alias("source"),
        F.col("term").alias("item"),
        differ(F.col("i.p"), F.col("q")).alias("value"),
    )


def _ranked(values: DataFrame, most: int | None) -> DataFrame:
    by = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = values.withColumn("rank", F.row_number().over(by))
    return ranked if most is None else ranked.where(F.col("rank") <= most)
