"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are 64-bit majority votes over the XXH64 values of word shingles.  Two fingerprints
that differ in at most three bits agree in one of four 16-bit blocks, so for each block the
distinct fingerprints are grouped by it and spread by its value.  Inside a task they are sorted by
block and by the Gray rank of the rest: neighbours then share bits.  A node of the index covers
sixteen neighbours (or sixteen nodes) and holds the bits that all of them share and that its
parent does not hold already.  A search carries the differences counted so far down the tree: more
than three drop the whole group, and a group whose open bits cannot lead beyond three is linked as
a whole.  A task gives at most one link per fingerprint and block, and components of the links
follow from alternating star contraction on settled tables.

Defined results: a null or wordless text has fingerprint 0 and is linked like any other; repeated
rows share a fingerprint; the null doc_id never names a component unless it is alone; an empty
table gives no rows; a long text's shingles are voted in slices.  Only doc_id and text are read.

The removal of near copies (``one_of_each``) has fingerprints and settings of its own and confirms
its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, settle
from .text import SLICE_ROWS, map_batches, utf8

BITS = 64
MOST_BITS = 3
BLOCKS = 4
WIDTH = BITS // BLOCKS
FAN = 16
#: Fingerprints per task that the number of spread keys aims at, and candidate pairs held at once.
TASK_ROWS = 20_000
FRONTIER = 2_000_000


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The majority bits of the shingles' XXH64 values."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, seed) for p in parts), np.uint64, len(parts))
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 100_000):
        octets = hashes[at : at + 100_000].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprint(t, shingle, seed) for t in utf8(batch.column("text"))]
        signed = np.array(values, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(signed)], names=["doc_id", "fp"]
        )

    return map_batches(
        docs.select("doc_id", F.col("text").cast("string")), work, f"doc_id {kind}, fp long"
    )


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The index bottom up: shared bits beyond the parent's, their pattern, bits still open."""
    levels, both, either = [], codes, codes
    while True:
        shared = ~(both ^ either)
        levels.append([shared, both & shared, shared])
        if len(both) <= FAN:
            break
        starts = np.arange(0, len(both), FAN)
        both = np.bitwise_and.reduceat(both, starts)
        either = np.bitwise_or.reduceat(either, starts)
    for low, high in zip(levels, levels[1:]):
        up = np.repeat(high[2], FAN)[: len(low[2])]
        low[0] = low[2] & ~up
    return [(own, pattern, np.uint64(BITS) - np.bitwise_count(shared)) for own, pattern, shared in levels]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; afterwards every parent is a smallest index."""
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def linked_classes(codes: np.ndarray, most: int = MOST_BITS, top: int = WIDTH) -> np.ndarray:
    """For sorted distinct codes: the first index of each code's class under links of at most
    ``most`` differing bits between codes whose ``top`` leading bits are equal."""
    n = len(codes)
    parent = np.arange(n)
    head = np.uint64(((1 << top) - 1) << (BITS - top))
    levels = _levels(codes)
    roots = np.arange(len(levels[-1][0]))
    per_query = max(1, FRONTIER // (FAN * FAN * 8))
    for begin in range(0, n, per_query):
        mine = np.arange(begin, min(n, begin + per_query))
        query = np.repeat(mine, len(roots))
        node = np.tile(roots, len(mine))
        spent = np.zeros(len(query), np.uint8)
        for depth in range(len(levels) - 1, -1, -1):
            own, pattern, open_bits = levels[depth]
            width = FAN**depth
            apart = (codes[query] ^ pattern[node]) & own[node]
            spent = spent + np.bitwise_count(apart)
            # a pair is met once: groups that end at or before the query are not searched
            keep = (spent <= most) & ((apart & head) == 0) & ((node + 1) * width > query)
            query, node, spent = query[keep], node[keep], spent[keep]
            if depth == 0:
                _union(parent, query, node)
                break
            sure = (spent + open_bits[node] <= most)
            if sure.any():
                group = np.unique(node[sure])
                first = np.repeat(group * width, width)
                member = first + np.tile(np.arange(width), len(group))
                inside = member < n
                _union(parent, first[inside], member[inside])
                _union(parent, query[sure], node[sure] * width)
                query, node, spent = query[~sure], node[~sure], spent[~sure]
            parts = np.arange(FAN)
            node = (node[:, None] * FAN + parts).ravel()
            query, spent = np.repeat(query, FAN), np.repeat(spent, FAN)
            inside = node < len(levels[depth - 1][0])
            query, node, spent = query[inside], node[inside], spent[inside]
    return parent


def _task_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links (fp, other) of one spread key: every member with the first of its class."""
    shift = np.uint64(WIDTH * int(group["block"].iloc[0]))
    fp = group["fp"].to_numpy(np.int64).view(np.uint64)
    turned = (fp << shift) | (fp >> (np.uint64(BITS) - shift)) if shift else fp.copy()
    rest = np.uint64((1 << (BITS - WIDTH)) - 1)
    order = np.lexsort((gray_rank(turned & rest), turned >> np.uint64(BITS - WIDTH)))
    parent = linked_classes(turned[order])
    fp = fp[order].view(np.int64)
    linked = parent != np.arange(len(parent))
    return pd.DataFrame({"fp": fp[linked], "other": fp[parent[linked]]})


def links(distinct: DataFrame, rows: int) -> DataFrame:
    """A spanning set of links between ``rows`` distinct fingerprints (column fp)."""
    spread = max(1, min(1 << WIDTH, -(-rows // TASK_ROWS)))
    block = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    value = F.expr(f"shiftrightunsigned(fp, {BITS - WIDTH} - {WIDTH} * block) & {(1 << WIDTH) - 1}")
    keyed = distinct.withColumn("block", block).withColumn("part", value % F.lit(spread))
    return keyed.groupBy("block", "part").applyInPandas(_task_links, "fp long, other long")


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """node and root, the smallest node of its component, by alternating star contraction.

    Both steps are one aggregation and one join per round; a hub's rows meet its minimum in a
    sort-merge join, whose large partitions adaptive execution splits.
    """
    edges = settle(
        pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u > v").unionByName(low.select("u", F.col("m").alias("v")))
        following = settle(small.where("u > v").distinct())
        state = F.struct(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)))
        same = following.agg(state).first()[0] == edges.agg(state).first()[0]
        release(edges, large)
        edges = following
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def roots_of(marked: DataFrame) -> DataFrame:
    """fp, root and first_id (the smallest doc_id with fp) of every fingerprint in ``marked``."""
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = links(distinct.select("fp"), distinct.count())
    roots = settle(components(found, "fp", "other"))
    return distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_id"
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable, of every row."""
    marked = settle(fingerprints(docs))
    rooted = roots_of(marked)
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(of_print, "fp").select("doc_id", "fp", "component_id")


#: Near copies for removal: words in a shingle, and the similarity that confirms a link, as a ratio.
COPY_SHINGLE = 5
SIMILAR = (4, 5)
#: Bits of a removal fingerprint, tables of the index, and bits of a table's key.
WIDE = 128
TABLES = 40
KEY_BITS = 14
#: Most differing bits of a candidate: in the half that the index holds, and in all.
MOST_HALF = 20
MOST_WIDE = 32


def shingle_digests(text: bytes, shingle: int = COPY_SHINGLE) -> tuple[bytes, np.ndarray]:
    """128 bits that name the text's words, and its distinct shingles as rows of 16 octets."""
    words = text.lower().split()
    line = b" ".join(words)
    if len(words) <= shingle:
        parts = {line} if words else set()
    else:
        parts = set(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.uint8)
    return xxhash.xxh3_128_digest(line), digests.reshape(-1, WIDE // 8)


def wide_print(digests: np.ndarray) -> np.ndarray:
    """The majority bits of the shingles' digests, 16 octets; zeros without shingles."""
    votes = np.zeros(WIDE, np.int64)
    for at in range(0, len(digests), 100_000):
        part = np.unpackbits(digests[at : at + 100_000], axis=1)
        votes += part.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * votes > len(digests))


def _tables() -> np.ndarray:
    """For each table an order of the bits; its key's bits come first."""
    draw = np.random.default_rng(WIDE)
    return np.array([draw.permutation(WIDE) for _ in range(TABLES)])


def near_pairs(codes: np.ndarray, more: np.ndarray, top: int):
    """Pairs (i, j, differing bits), i < j, of sorted codes that agree in the ``top`` leading bits.

    The index holds ``codes``; the differences counted down the tree drop groups above
    ``MOST_HALF``, and ``more``, the other half of each fingerprint, decides at the leaves.
    """
    n = len(codes)
    head = np.uint64(((1 << top) - 1) << (BITS - top))
    levels = _levels(codes)
    roots = np.arange(len(levels[-1][0]))
    per_query = max(1, FRONTIER // (FAN * FAN * 8))
    for begin in range(0, n, per_query):
        mine = np.arange(begin, min(n, begin + per_query))
        query, node = np.repeat(mine, len(roots)), np.tile(roots, len(mine))
        spent = np.zeros(len(query), np.uint8)
        for depth in range(len(levels) - 1, -1, -1):
            own, pattern, _ = levels[depth]
            apart = (codes[query] ^ pattern[node]) & own[node]
            spent = spent + np.bitwise_count(apart)
            keep = (spent <= MOST_HALF) & ((apart & head) == 0) & ((node + 1) * FAN**depth > query)
            query, node, spent = query[keep], node[keep], spent[keep]
            if depth:
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                query, spent = np.repeat(query, FAN), np.repeat(spent, FAN)
                inside = node < len(levels[depth - 1][0])
                query, node, spent = query[inside], node[inside], spent[inside]
        later = node > query
        query, node, spent = query[later], node[later], spent[later]
        spent = spent + np.bitwise_count(more[query] ^ more[node])
        near = spent <= MOST_WIDE
        yield query[near], node[near], spent[near].astype(np.int64)


def _nearest(orders: np.ndarray):
    """The work of one spread key of one table: each print's nearest before and after it."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(group["prints"]), np.uint8).reshape(-1, WIDE // 8)
        bits = np.unpackbits(raw, axis=1)[:, orders[int(group["block"].iloc[0])]]
        halves = np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").astype(np.uint64)
        codes, more = halves[:, 0], halves[:, 1]
        rest = np.uint64((1 << (BITS - KEY_BITS)) - 1)
        order = np.lexsort((gray_rank(codes & rest), codes >> np.uint64(BITS - KEY_BITS)))
        codes, more, raw = codes[order], more[order], raw[order]
        none = np.iinfo(np.int64).max
        before, after = np.full(len(codes), none), np.full(len(codes), none)
        for i, j, apart in near_pairs(codes, more, KEY_BITS):
            np.minimum.at(after, i, (apart << 32) + j)
            np.minimum.at(before, j, (apart << 32) + i)
        low = (1 << 32) - 1
        a = np.concatenate([np.flatnonzero(best != none) for best in (before, after)])
        b = np.concatenate([best[best != none] & low for best in (before, after)])
        packed = [bytes(row) for row in raw]
        return pd.DataFrame({"a": [packed[i] for i in a], "b": [packed[i] for i in b]})

    return work


def candidate_prints(distinct: DataFrame, rows: int) -> DataFrame:
    """Pairs (a, b) of prints that some table holds as nearest: one before and one after each."""
    orders = _tables()
    spread = max(1, min(1 << KEY_BITS, -(-rows // TASK_ROWS)))

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8)
        raw = raw.reshape(-1, WIDE // 8)
        bits, weight = np.unpackbits(raw, axis=1).astype(np.int64), 1 << np.arange(KEY_BITS)
        rows = []
        for block, order in enumerate(orders):
            part = bits[:, order[:KEY_BITS]] @ weight % spread
            by = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[by])) + 1
            rows += [(block, part[some[0]], raw[some].tobytes()) for some in np.split(by, cuts) if len(some)]
        blocks, parts, prints = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array(parts, pa.int32()), pa.array(prints, pa.binary())],
            names=["block", "part", "prints"],
        )

    keyed = map_batches(distinct, keys, "block int, part int, prints binary")
    return keyed.groupBy("block", "part").applyInPandas(_nearest(orders), "a binary, b binary")


#: Hashed counters of shingles, which give them an order from rare to frequent, and a row's share.
COUNTERS = 1 << 20
COUNTER_ROWS = 1 << 14


def shingle_words(text: bytes) -> np.ndarray:
    """64 bits of each distinct shingle's digest, ascending."""
    return np.unique(np.ascontiguousarray(shingle_digests(text)[1][:, :8]).view(np.int64).ravel())


def shingle_levels(texts: DataFrame) -> np.ndarray:
    """A level per counter: eight times the logarithm of the texts' shingles that it counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting = np.zeros(COUNTERS, np.int32), [], 0
        # a few rows at once: a whole batch would stand in memory several times
        slices = (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS))
        for some in slices:
            for text in utf8(some.column("text")):
                held.append((shingle_words(text) & (COUNTERS - 1)).astype(np.int32))
                waiting += len(held[-1])
                if waiting > COUNTERS // 4:
                    np.add.at(total, np.concatenate(held), 1)
                    held, waiting = [], 0
        if held:
            np.add.at(total, np.concatenate(held), 1)
        parts = total.reshape(-1, COUNTER_ROWS)
        numbers = pa.array(range(len(parts)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [numbers, pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "counts"]
        )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTER_ROWS, np.int64)
        for counts in group["counts"]:
            total += np.frombuffer(counts, np.int32)
        level = np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8)
        return pd.DataFrame({"part": group["part"].iloc[:1], "level": [level.tobytes()]})

    counted = texts.select("text").mapInArrow(count, "part int, counts binary")
    levels = np.zeros((COUNTERS // COUNTER_ROWS, COUNTER_ROWS), np.uint8)
    for part, level in counted.groupBy("part").applyInPandas(add, "part int, level binary").collect():
        levels[part] = np.frombuffer(level, np.uint8)
    return levels.ravel()


def rare_shingles(texts: DataFrame) -> DataFrame:
    """(shingle, short, size, place) of each text's first shingles in the order from rare to frequent.

    Of two texts with a similarity of 0.8 or more, one lacks at most a fifth of the other's
    shingles; so the first fifth and one of either, in any order common to all texts, have one in
    common.  The counters only choose the order.
    """
    levels = shingle_levels(texts)

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, short, size, place = [], [], [], []
        for text in utf8(batch.column("text")):
            words = shingle_words(text)
            n = len(words)
            if n:
                take = n + n * SIMILAR[0] // -SIMILAR[1] + 1
                found.append(words[np.lexsort((words, levels[words & (COUNTERS - 1)]))[:take]])
                short.append(np.full(take, short_name(shingle_digests(text)[0])))
                size.append(np.full(take, n))
                place.append(np.arange(take))
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (found, short, size, place)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["shingle", "short", "size", "place"]
        )

    return map_batches(texts.select("text"), first, "shingle long, short long, size int, place int")


def short_name(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def pairs_between(texts: DataFrame, rooted: DataFrame) -> DataFrame:
    """Pairs (a, b) of names in ``rooted`` (name, short, root) with different roots, among them all
    whose ``texts`` have a similarity of 0.8 or more."""
    of_shingle = Window.partitionBy("shingle")
    shared = rare_shingles(texts).withColumns(
        {"_least": F.min("short").over(of_shingle), "_most": F.max("short").over(of_shingle)}
    )
    shared = settle(shared.where("_least <> _most").drop("_least", "_most").distinct())
    held = settle(shared.join(rooted.select("short", "name", "root"), "short").drop("short"))
    side = lambda c: held.select(
        "shingle", *[F.col(n).alias(f"{n}_{c}") for n in ("name", "root", "size", "place")]
    )
    # before the first common shingle there is none in common: what is left must suffice
    most = F.least(F.expr("size_a - place_a"), F.expr("size_b - place_b"))
    enough = most * (SIMILAR[0] + SIMILAR[1]) >= F.expr("size_a + size_b") * SIMILAR[0]
    pairs = side("a").join(side("b"), "shingle").where((F.col("root_a") < F.col("root_b")) & enough)
    pairs = settle(pairs.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")).distinct())
    release(shared, held)
    return pairs


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``texts`` (name, text) whose shingles are similar: exact Jaccard."""

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        # 64 bits of each shingle's digest stand for it
        sets = [shingle_words(t) for t in utf8(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("name"), pa.array(sets, pa.list_(pa.int64()))], names=["name", "shingles"]
        )

    sets = settle(map_batches(texts, shingles, "name binary, shingles array<long>"))
    side = lambda n: sets.select(F.col("name").alias(n), F.col("shingles").alias(f"of_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - common
    found = settle(both.where(common * SIMILAR[1] >= either * SIMILAR[0]).select("a", "b"))
    release(sets)
    return found


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every group of near copies: of those with the smallest doc_id, that of the least
    row hash.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more
    (A-Z lowered; a text of five words or fewer is one shingle), and groups are the components of
    such links.  Texts of the same words are merged first.  Candidates come from fingerprints of
    128 bits: each of ``TABLES`` tables deals them by 14 of the bits, chosen at random once for
    all, and searches the Gray-order index of a bucket.  First a table proposes each print's nearest
    neighbour before and after it in its bucket, so that a large group gives a few links per text
    and not all pairs.  These links give groups.  Then texts of different groups are joined by their
    rare shingles, which proposes every pair that is similar, so no link between groups is left out.
    Every proposed link is confirmed on the texts themselves.
    """
    packed = docs.select(F.struct("*").alias("_row")).withColumns(
        {"_k1": F.xxhash64("_row"), "_k2": F.xxhash64(F.lit(1), F.col("_row"))}
    )
    key = F.struct(
        F.col("_row.doc_id").isNull().alias("last"), F.col("_row.doc_id").alias("id"), "_k1", "_k2"
    )
    texts = packed.select(key.alias("_key"), F.col("_row.text").cast("string").alias("text"))

    def marks(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_digests(t) for t in utf8(batch.column("text"))]
        prints = [wide_print(d).tobytes() for _, d in found]
        short = pa.array([short_name(n) for n, _ in found], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("_key"), pa.array([n for n, _ in found]), pa.array(prints, pa.binary()), short],
            names=["_key", "name", "print", "short"],
        )

    kind = texts.schema["_key"].dataType.simpleString()
    marked = settle(map_batches(texts, marks, f"_key {kind}, name binary, print binary, short long"))
    units = settle(
        marked.groupBy("name").agg(
            F.min("_key").alias("_key"), F.first("print").alias("print"), F.first("short").alias("short")
        )
    )
    prints = settle(units.groupBy("print").agg(F.min("name").alias("name"), F.count("*").alias("n")))
    near = settle(candidate_prints(prints.select("print"), prints.count()).distinct())
    named = lambda c: prints.select(F.col("print").alias(f"of_{c}"), F.col("name").alias(c))
    pairs = (
        near.select(F.col("a").alias("of_a"), F.col("b").alias("of_b"))
        .join(named("a"), "of_a")
        .join(named("b"), "of_b")
        .select("a", "b")
    )
    alike = units.select("print", F.col("name").alias("b")).join(
        prints.where("n > 1").select("print", F.col("name").alias("a")), "print"
    )
    pairs = pairs.unionByName(alike.where("a <> b").select("a", "b"))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    def linked(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name")))
        asked = settle(units.join(asked.distinct(), "name").select("name", "_key"))
        wanted = asked.select("name", F.col("_key._k1").alias("_k1"), F.col("_key._k2").alias("_k2"))
        mine = packed.select("_k1", "_k2", F.col("_row.text").cast("string").alias("text"))
        found = mine.join(wanted, ["_k1", "_k2"]).select("name", "text").dropDuplicates(["name"])
        links = confirmed(pairs, found)
        release(asked)
        return links

    def grouped(links: DataFrame) -> DataFrame:
        roots = settle(components(links, "a", "b"))
        rooted = settle(
            units.join(roots, units.name == roots.node, "left").select(
                "name", "_key", "short", F.coalesce("root", "name").alias("root")
            )
        )
        release(roots)
        return rooted

    pairs = settle(pairs.select(*ordered).distinct())
    links = linked(pairs)
    rooted = grouped(links)
    # links inside a group change nothing; of those between groups none is left out
    between = pairs_between(texts, rooted)
    further = settle(between.join(pairs, ["a", "b"], "left_anti"))
    late = linked(further)
    release(near, prints, pairs, between, further)
    first_rooted = rooted
    rooted = grouped(links.unionByName(late))
    release(first_rooted, links, late)
    first = rooted.groupBy("root").agg(F.min("_key").alias("_first"))
    chosen = rooted.join(first, "root").select("name", "_first")
    rows = marked.groupBy("name", "_key").agg(F.count("*").alias("n")).join(chosen, "name")
    rows = settle(
        rows.select("_key._k1", "_key._k2", "n", (F.col("_key") == F.col("_first")).alias("stays"))
    )
    release(marked, units, rooted)
    # most rows stay: only those that go, and equal rows, are named
    others = rows.where("NOT stays OR n > 1").select("_k1", "_k2")
    equal = packed.join(rows.where("stays AND n > 1").select("_k1", "_k2"), ["_k1", "_k2"])
    alone = packed.join(others, ["_k1", "_k2"], "left_anti").select("_row")
    return alone.unionByName(equal.dropDuplicates(["_k1", "_k2"]).select("_row")).select("_row.*")
