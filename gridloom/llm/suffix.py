"""Exact removal of repeated byte strings with suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts at another place of the
input, in the same or another document.  Documents are UTF-8; strings never cross documents.

1. Equal texts are merged: one of each is searched, with the number of its rows.  The texts are
   bucketed by name, so that they move once.
2. Anchors: every start of a string is given to the gram of 32 bytes of least mixed hash inside the
   string (the last of equal ones).  The choice depends only on the string, so equal strings have
   equal anchors.  Neighbouring starts with one anchor form a run.
3. A string has on one side of its anchor at least half of what is not the anchor.  A run without a
   side (the anchor and that half) that occurs elsewhere holds no repeated string.  Of the others
   the bytes are taken, and equal runs are merged before and after the shuffle; a run met twice is
   repeated in whole.
4. Anchors with several different runs are dealt to shards of bounded bytes.  A shard sorts its
   suffixes by Larsson-Sadakane refinement (groups of equal prefixes double their sorted depth;
   singletons rest), and Kasai's walk gives the common prefixes of neighbours.
5. An anchor with more bytes than a shard is split over several.  Those send the digests of their
   strings, each once, and the digests of one range are searched by bisection in each other's sorted
   lists.
6. Repeated starts return to their texts, and the spans they cover are cut.

The same search over words, as 64 bits of hash each, finds passages of equal words.  Tables
are deleted as soon as their last reader is written, and one search ends before the other starts.

Defined results: null texts are empty; texts shorter than ``length`` stay whole; repeated rows are
copies of each other and lose all bytes if long enough; an empty table gives no rows.  Only doc_id
and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, settle, settle_bucketed
from .text import map_batches, word_count

LENGTH = 400
#: Passages of over 50 words.
PASSAGE_WORDS = 51
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
GRAM = 32
#: Units (bytes or words) of runs that one shard sorts; it takes about 120 bytes of memory for each.
SHARD_BYTES = 500_000
#: Bytes whose anchors are computed at once; places inside a stretch need less than 20 bits.
STRETCH = 500_000
BASE = 0x9E3779B97F4A7C15


class View(NamedTuple):
    """What strings are made of: a text's ``body`` as units of ``width`` octets each, and the number of
    units in a gram that may become an anchor (a power of two)."""

    units: Callable[[bytes], bytes]
    width: int
    gram: int

    def array(self, parts: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(parts), np.uint8 if self.width == 1 else np.uint64)


def word_units(body: bytes) -> bytes:
    """64 bits of hash for each word."""
    return b"".join(map(xxhash.xxh3_64_digest, body.split()))


OCTETS = View(bytes, 1, GRAM)
WORDS = View(word_units, 8, 4)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Polynomial hashes of all grams (``gram`` a power of two), by doubling, then mixed."""
    value, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < gram:
        factor = np.uint64(pow(BASE, width, 1 << 64))
        value = value[:-width] * factor + value[width:]
        width *= 2
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value


def window_least(value: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` neighbours."""
    least, have = value, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        rest = width - have
        least = np.minimum(least[:-rest], least[rest:])
    return least


def grams_beside(length: int, gram: int = GRAM) -> tuple[int, int]:
    """What lies beside a string's anchor: on one side at least this many units, and the width of
    the two grams that cover them together with the anchor."""
    half = -(-(length - gram) // 2)
    return half, 1 << ((half + gram).bit_length() - 1)


def anchor_runs(data: np.ndarray, length: int = LENGTH, size: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of every run of ``data``'s strings: anchor, first start, last start, the anchor's place, and the
    hashes of the anchor with what lies to its left and to its right.

    An anchor has ``size`` units.  A hash reaches ``grams_beside`` units and holds for strings with so
    many on that side; it means nothing where the run has no such string.
    """
    grams = length - size + 1
    half, width = grams_beside(length, size)
    found = []
    for at in range(0, len(data) - length + 1, STRETCH):
        part = data[at : at + STRETCH + length - 1]
        mixed = gram_hashes(part, size)
        place = np.arange(len(mixed), dtype=np.uint64)
        low = np.uint64((1 << 20) - 1)
        chosen = window_least((mixed & ~low) | (low - place), grams)
        gram = (low - (chosen & low)).astype(np.int64)
        edge = np.flatnonzero(np.diff(gram)) + 1
        first = np.concatenate([[0], edge])
        mine, wide = gram[first], gram_hashes(part, width)
        last = len(wide) - 1

        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            near, far = wide[np.clip(a, 0, last)], wide[np.clip(b, 0, last)]
            return (near * np.uint64(BASE) + far).view(np.int64)

        found.append(
            (
                mixed[mine].view(np.int64),
                first + at,
                np.concatenate([edge - 1, [len(gram) - 1]]) + at,
                mine + at,
                pair(mine - half, mine + size - width),
                pair(mine + half + size - width, mine),
            )
        )
    if not found:
        return (np.zeros(0, np.int64),) * 6
    return tuple(np.concatenate(column) for column in zip(*found))


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The suffix array of ``data``, sorted in full as Kasai's walk needs it.

    Bytes begin with keys of eight, other units with keys of one.
    """
    n = len(data)
    if data.dtype != np.uint8:
        order = np.argsort(data, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = data[order[1:]] != data[order[:-1]]
        return _refined(order, fresh, 1)
    key, width = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64), 1
    while width < 8:
        key = (key[:-width] << np.uint64(8 * width)) | key[width:]
        width *= 2
    order = np.argsort(key[:n])
    # a suffix shorter than its key comes before those that hold zero bytes where it has ended
    ordered = key[order]
    for short in np.unique(key[max(0, n - 7) : n]):
        low, high = np.searchsorted(ordered, short, "left"), np.searchsorted(ordered, short, "right")
        equal = order[low:high]
        ended = equal > n - 8
        order[low:high] = np.concatenate([-np.sort(-equal[ended]), equal[~ended]])
    fresh = np.ones(n, bool)
    fresh[1:] = np.diff(key[order]) != 0
    # and differs from all others
    tail = np.flatnonzero(order > n - 8)
    fresh[tail] = True
    fresh[tail[tail + 1 < n] + 1] = True
    return _refined(order, fresh, 8)


def _refined(order: np.ndarray, fresh: np.ndarray, have: int) -> np.ndarray:
    """``order``, sorted to depth ``have`` with ``fresh`` where a group begins, sorted in full."""
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while True:
        single = fresh.copy()
        single[:-1] &= fresh[1:]
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        suffix = order[open_]
        group = rank[suffix]
        follow = suffix + have
        inside = follow < n
        second = np.where(inside, rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.argsort(group * (n + 1) + second, kind="stable")
        suffix, group, second = suffix[by], group[by], second[by]
        order[open_] = suffix
        new = np.ones(len(open_), bool)
        new[1:] = (np.diff(group) != 0) | (np.diff(second) != 0)
        fresh[open_] = new
        rank[suffix] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        have *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lanes: int = 24) -> np.ndarray:
    """Common prefix (at most ``most``) of each suffix in ``order`` with the one before it.

    Kasai's walk in text order: a prefix is at most one byte shorter than that of the suffix one
    byte earlier.  The text is cut into stretches of ``lanes`` places that walk side by side.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    small = data.dtype == np.uint8
    word, width = np.concatenate([data, np.zeros(most + 16, data.dtype)]).astype(np.uint64), 1
    while small and width < 8:
        word = (word[:-width] << np.uint64(8 * width)) | word[width:]
        width *= 2
    out = np.zeros(n, np.int64)
    head = np.arange(0, n, lanes)
    have = np.zeros(len(head), np.int64)
    for step in range(lanes):
        at = head + step
        live = np.flatnonzero((at < n))
        at, other = at[live], before[at[live]]
        size = np.maximum(have[live] - 1, 0)
        size[other < 0] = 0
        limit = np.minimum(most, n - np.maximum(at, other))
        limit[other < 0] = 0
        size = np.minimum(size, limit)
        grow = np.flatnonzero(size < limit)
        while len(grow):
            differ = word[at[grow] + size[grow]] ^ word[other[grow] + size[grow]]
            whole = differ == 0
            step_by = np.where(whole, 8, _leading_zero_bytes(differ)) if small else whole
            size[grow] = np.minimum(size[grow] + step_by, limit[grow])
            grow = grow[whole & (size[grow] < limit[grow])]
        have[live] = size
        out[at] = size
    return out[order]


def _leading_zero_bytes(value: np.ndarray) -> np.ndarray:
    count = np.zeros(len(value), np.int64)
    for bits, octets in ((32, 4), (48, 2), (56, 1)):
        small = value >> np.uint64(bits) == 0
        shift = np.uint64(8 * octets)
        count[small] += octets
        value = np.where(small, value << shift, value)
    return count


def repeated_starts(
    runs: list[bytes], length: int = LENGTH, view: View = OCTETS
) -> tuple[np.ndarray, np.ndarray]:
    """For different runs laid end to end: places of strings that occur twice or more, and the
    place of the first of each distinct string (each run has len - length + 1 starts)."""
    sizes = np.array([len(r) // view.width for r in runs], np.int64)
    data = view.array(runs)
    ends = np.cumsum(sizes)
    valid = np.ones(len(data), bool)
    for back in range(1, length):
        valid[ends - back] = False
    order = suffix_order(data)
    same = common_prefixes(data, order, length) >= length
    group = np.cumsum(~same)
    starts = valid[order]
    group, order = group[starts], order[starts]
    edge = np.ones(len(group), bool)
    edge[1:] = np.diff(group) != 0
    twice = ~edge
    twice[:-1] |= ~edge[1:]
    return np.sort(order[twice]), order[edge]


def spans_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of every stretch of consecutive sorted places."""
    if not len(places):
        return places, places
    edge = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate([[0], edge + 1])], places[np.concatenate([edge, [len(places) - 1]])]


SHARD_COLUMNS = "anchor long, d1 long, d2 long, firsts array<long>, lasts array<long>, starts array<long>, codes binary, part int"


def _shard(length: int, view: View):
    """The work of one shard: repeated stretches per run and, of a split anchor, string digests."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        runs, rows = list(group["bytes"]), []
        keys = list(zip(group["anchor"], group["d1"], group["d2"]))
        begin = np.concatenate([[0], np.cumsum([len(r) // view.width for r in runs])])
        places, distinct = repeated_starts(runs, length, view)
        wide = view.width * length

        def by_run(found: np.ndarray):
            owner = np.searchsorted(begin, found, side="right") - 1
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for at, mine in zip(owner[np.concatenate([[0], cuts])], np.split(found, cuts)):
                yield int(at), mine - begin[at]

        part = int(group["part"].iloc[0])
        if len(places):
            for at, mine in by_run(places):
                rows.append((*keys[at], *spans_of(mine), None, None, part))
        if bool(group["split"].iloc[0]):
            for at, mine in by_run(np.sort(distinct)):
                run = runs[at]
                codes = b"".join(
                    xxhash.xxh3_128_digest(run[i : i + wide]) for i in (mine * view.width).tolist()
                )
                rows.append((*keys[at], None, None, mine, codes, part))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SHARD_COLUMNS.split(", ")])

    return work


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Strings of one digest range that different shards of an anchor hold."""
    sides = []
    for _, mine in group.groupby("part"):
        codes = np.frombuffer(b"".join(mine["codes"]), [("a", ">u8"), ("b", ">u8")])
        which = np.repeat(np.arange(len(mine)), [len(s) for s in mine["starts"]])
        at = np.concatenate(list(mine["starts"]))
        order = np.lexsort((codes["b"], codes["a"]))
        sides.append((mine, codes[order], which[order], at[order]))
    rows = []
    for i, (mine, codes, which, at) in enumerate(sides):
        met = np.zeros(len(codes), bool)
        for j, (_, other, _, _) in enumerate(sides):
            if i != j:
                place = np.minimum(_search(other, codes), len(other) - 1)
                met |= other[place] == codes
        for row in np.unique(which[met]):
            found = np.sort(at[met & (which == row)])
            key = mine.iloc[int(row)]
            rows.append((key["anchor"], key["d1"], key["d2"], *spans_of(found)))
    return pd.DataFrame(rows, columns=["anchor", "d1", "d2", "firsts", "lasts"])


def _search(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Bisection for 128-bit codes: by the high half, then inside its equal range."""
    low = np.searchsorted(codes["a"], wanted["a"], side="left")
    high = np.searchsorted(codes["a"], wanted["a"], side="right")
    while True:
        open_ = low < high
        middle = (low + high) // 2
        open_ &= codes["b"][np.minimum(middle, len(codes) - 1)] < wanted["b"]
        wide = low < high
        if not wide.any():
            return low
        low = np.where(wide & open_, middle + 1, low)
        high = np.where(wide & ~open_, middle, high)


def _ranges(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A run's digests by their first octet."""
    for row in batch.to_pylist():
        codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, 16)
        starts = np.array(row["starts"], np.int64)
        order = np.argsort(codes[:, 0], kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order, 0])) + 1
        parts = np.split(order, cuts)
        same = lambda name: [row[name]] * len(parts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(same("anchor"), pa.int64()),
                pa.array(same("d1"), pa.int64()),
                pa.array(same("d2"), pa.int64()),
                pa.array(same("part"), pa.int32()),
                pa.array([int(codes[p[0], 0]) for p in parts], pa.int32()),
                pa.array([starts[p] for p in parts], pa.list_(pa.int64())),
                pa.array([codes[p].tobytes() for p in parts], pa.binary()),
            ],
            names=["anchor", "d1", "d2", "part", "range", "starts", "codes"],
        )


def _anchors(length: int, view: View):
    half, _ = grams_beside(length, view.gram)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [view.units(t) for t in batch.column("body").to_pylist()]
        sizes = np.array([len(t) // view.width for t in texts], np.int64)
        end = np.cumsum(sizes)
        begin = end - sizes
        runs = anchor_runs(view.array(texts), length, view.gram)
        first, last = runs[1:3]
        # a run touches the starts of one text only: shorten it to those
        owner = np.searchsorted(end, first, side="right")
        late = first > end[owner] - length
        owner = np.minimum(owner + late, len(end) - 1)
        first = np.maximum(first, begin[owner])
        last = np.minimum(last, end[owner] - length)
        keep = first <= last
        anchor, _, _, gram, left, right = (column[keep] for column in runs)
        owner, first, last = owner[keep], first[keep], last[keep]
        take = pa.array(owner)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("t1").take(take),
                batch.column("t2").take(take),
                pa.array(anchor),
                pa.array((first - begin[owner]).astype(np.int64)),
                pa.array((last - begin[owner]).astype(np.int64)),
                pa.array(left, mask=first > gram - half),
                pa.array(right, mask=last + length < gram + view.gram + half),
            ],
            names=["t1", "t2", "anchor", "first", "last", "left", "right"],
        )

    return work


def _runs(length: int, view: View):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            body, picked, wide = view.units(row["body"]), row["picked"], view.width
            parts = [body[p["first"] * wide : (p["last"] + length) * wide] for p in picked]
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["t1"]] * len(parts), pa.int64()),
                    pa.array([row["t2"]] * len(parts), pa.int64()),
                    pa.array([p["first"] for p in picked], pa.int64()),
                    pa.array([p["anchor"] for p in picked], pa.int64()),
                    pa.array(digests[0::2]),
                    pa.array(digests[1::2]),
                    pa.array([len(p) // wide for p in parts], pa.int64()),
                    pa.array(parts, pa.binary()),
                ],
                names=["t1", "t2", "first", "anchor", "d1", "d2", "size", "bytes"],
            )

    return work


def _merge_spans(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Touching and overlapping spans of each text as one."""
    begins, ends = [], []
    for spans in batch.column("spans").to_pylist():
        b = np.array([s["b"] for s in spans], np.int64)
        e = np.array([s["e"] for s in spans], np.int64)
        order = np.argsort(b, kind="stable")
        b, e = b[order], np.maximum.accumulate(e[order])
        new = np.concatenate([[True], b[1:] > e[:-1]])
        begins.append(b[new])
        ends.append(e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(e) - 1]])])
    long = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column("t1"), batch.column("t2"), pa.array(begins, long), pa.array(ends, long)],
        names=["t1", "t2", "begins", "ends"],
    )


def _body(text):
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` packed in _row, the text's bytes as body, and 128 bits that name the text."""
    body = _body(F.col("text")).alias("body")
    return docs.select(F.struct("*").alias("_row"), body).withColumns(
        {"t1": F.xxhash64("body"), "t2": F.xxhash64(F.lit(1), F.col("body"))}
    )


def merged(rows: DataFrame) -> DataFrame:
    """t1, t2, body and n (rows) of every text, bucketed by its name.

    What is gathered for a text later does not grow with its copies, and the texts move only here.
    """
    texts = rows.groupBy("t1", "t2").agg(F.first("body").alias("body"), F.count("*").alias("n"))
    return settle_bucketed(texts, "t1", "t2", compression="zstd")


def repeated_spans(
    rows: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """t1, t2, begins and ends: the removed bytes of every text (t1, t2, body) that has some."""
    texts = merged(rows)
    spans = text_spans(texts, OCTETS, length, shard_bytes)
    release(texts)
    return spans


def text_spans(texts: DataFrame, view: View, length: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """t1, t2, begins and ends of what is repeated in a view of ``merged`` texts."""
    sided = settle(
        map_batches(
            # a unit has an octet at least
            texts.where(F.octet_length("body") >= length).select("t1", "t2", "body"),
            _anchors(length, view),
            "t1 long, t2 long, anchor long, first long, last long, left long, right long",
        )
    )
    sides = F.explode(F.array_compact(F.array("left", "right"))).alias("side")
    sides = sided.select("t1", "t2", "anchor", "first", "last", sides)
    again = settle(sides.groupBy("side").agg(F.count("*").alias("n")).where("n > 1").select("side"))
    anchors = settle(sides.join(again, "side").drop("side").distinct())
    release(sided, again)
    place = F.struct("anchor", "first", "last")
    picked = anchors.groupBy("t1", "t2").agg(F.collect_list(place).alias("picked"))
    runs = settle(
        map_batches(
            texts.select("t1", "t2", "body").join(picked, ["t1", "t2"]),
            _runs(length, view),
            "t1 long, t2 long, first long, anchor long, d1 long, d2 long, size long, bytes binary",
        ),
        compression="zstd",
    )
    release(anchors)
    key = ["anchor", "d1", "d2"]
    counted = settle(runs.groupBy(*key).agg(F.count("*").alias("n"), F.first("size").alias("size")))
    several = settle(
        counted.groupBy("anchor")
        .agg(F.count("*").alias("kinds"), F.sum("size").alias("total"))
        .where("kinds > 1")
    )
    total = several.agg(F.sum("total")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    pieces = F.ceil(F.col("total") / shard_bytes)
    dealt = (
        runs.groupBy(*key)
        .agg(F.first("bytes").alias("bytes"))
        .join(several, "anchor")
        .withColumn("split", F.col("total") > shard_bytes)
        .withColumn("part", F.when(F.col("split"), F.pmod(F.col("d1"), pieces)).otherwise(0).cast("int"))
        .withColumn(
            "shard",
            F.when(F.col("split"), F.col("anchor")).otherwise(
                F.pmod(F.xxhash64("anchor"), F.lit(shards))
            ),
        )
        .select(*key, "bytes", "split", "part", "shard")
    )
    found = settle(
        dealt.groupBy("shard", "split", "part").applyInPandas(_shard(length, view), SHARD_COLUMNS)
    )
    release(several)
    places = settle(runs.select("t1", "t2", "first", *key))
    release(runs)
    across = map_batches(
        found.where("codes IS NOT NULL").select(*key, "part", "starts", "codes"),
        _ranges,
        "anchor long, d1 long, d2 long, part int, range int, starts array<long>, codes binary",
    )
    met = across.groupBy("anchor", "range").applyInPandas(
        _merge, "anchor long, d1 long, d2 long, firsts array<long>, lasts array<long>"
    )
    stretch = F.explode(F.arrays_zip("firsts", "lasts")).alias("s")
    partly = (
        found.where("firsts IS NOT NULL")
        .select(*key, "firsts", "lasts")
        .unionByName(met)
        .select(*key, stretch)
        .select(*key, F.col("s.firsts").alias("b"), (F.col("s.lasts") + length).alias("e"))
    )
    wholly = counted.where("n > 1").select(
        *key, F.lit(0).cast("bigint").alias("b"), F.col("size").alias("e")
    )
    marks = partly.unionByName(wholly)
    spans = places.join(marks, key)
    one = lambda b, e: F.struct(b.cast("bigint").alias("b"), e.cast("bigint").alias("e"))
    listed = spans.select(
        "t1", "t2", one(F.col("first") + F.col("b"), F.col("first") + F.col("e")).alias("s")
    ).unionByName(_copied(texts, view, length, one))
    out = settle(
        map_batches(
            listed.groupBy("t1", "t2").agg(F.collect_list("s").alias("spans")),
            _merge_spans,
            "t1 long, t2 long, begins array<long>, ends array<long>",
        )
    )
    release(found, counted, places)
    return out


def _copied(texts: DataFrame, view: View, length: int, one) -> DataFrame:
    """Texts of several rows: all of the view is repeated, if it is long enough."""
    size = F.octet_length("body") if view.width == 1 else word_count(F.decode("body", "UTF-8"))
    copied = texts.where("n > 1").select("t1", "t2", size.alias("size"))
    return copied.where(F.col("size") >= length).select("t1", "t2", one(F.lit(0), F.col("size")).alias("s"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """_row (the columns of ``docs``), body, and begins and ends of the removed spans."""
    rows = keyed(docs)
    return _beside_rows(rows, repeated_spans(rows, length, shard_bytes), "begins", "ends")


def _beside_rows(rows: DataFrame, spans: DataFrame, *names: str) -> DataFrame:
    """_row, body, and the lists ``names`` of the row's text, empty where ``spans`` lacks it."""
    none = F.array().cast("array<bigint>")
    return (
        rows.select("_row", "t1", "t2")
        .join(spans, ["t1", "t2"], "left")
        .select("_row", _body(F.col("_row.text")).alias("body"), *[F.coalesce(n, none).alias(n) for n in names])
    )


def kept_bytes(whole_characters: bool = False):
    """The bytes of ``body`` outside the spans; optionally without cut-off parts of characters."""
    size = F.octet_length("body").cast("bigint")
    left = F.concat(F.array(F.lit(0).cast("bigint")), F.col("ends"))
    right = F.concat(F.col("begins"), F.array(size))
    octet = lambda at: F.conv(F.hex(F.substring("body", at + 1, 1)), 16, 10).cast("int")
    inner = lambda at: (at < size) & (octet(at).bitwiseAND(0xC0) == 0x80)

    def aligned(at, step: int):
        if not whole_characters:
            return at
        places = [at + step * k for k in range(4)]
        found = F.when(~inner(places[0]), places[0])
        for place in places[1:3]:
            found = found.when(~inner(place), place)
        return found.otherwise(places[3])

    parts = F.zip_with(
        left,
        right,
        lambda a, b: F.substring(
            "body", aligned(a, 1).cast("int") + 1, F.greatest(aligned(b, -1) - aligned(a, 1), F.lit(0)).cast("int")
        ),
    )
    return F.aggregate(parts, F.lit(b"").cast("binary"), lambda done, part: F.concat(done, part))


def _word_spans(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Spans of words as spans of the text's bytes, from a first word to the end of a last."""
    for row in batch.to_pylist():
        edges = [m.span() for m in WORD.finditer(row["body"])]
        begins = [edges[b][0] for b in row["begins"]]
        ends = [edges[e - 1][1] for e in row["ends"]]
        long = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["t1"]]), pa.array([row["t2"]]), pa.array([begins], long), pa.array([ends], long)],
            names=["t1", "t2", "passage_begins", "passage_ends"],
        )


def repeats_and_passages(
    docs: DataFrame, length: int = LENGTH, words: int = PASSAGE_WORDS
) -> DataFrame:
    """As ``cut_repeats``, and passage_begins and passage_ends: what ``words`` equal words that stand at
    two places cover, from a first word to the end of a last.

    Words are compared by 64 bits of hash, in passages of ``words``; the space between may differ.
    """
    rows = keyed(docs)
    texts = merged(rows)
    coded = text_spans(texts, WORDS, words)
    passages = settle(
        map_batches(
            coded.join(texts.select("t1", "t2", "body"), ["t1", "t2"]),
            _word_spans,
            "t1 long, t2 long, passage_begins array<long>, passage_ends array<long>",
        )
    )
    release(coded)
    strings = text_spans(texts, OCTETS, length)
    release(texts)
    both = strings.join(passages, ["t1", "t2"], "full")
    return _beside_rows(rows, both, "begins", "ends", "passage_begins", "passage_ends")


def cut_passages(docs: DataFrame, length: int = LENGTH, words: int = PASSAGE_WORDS) -> DataFrame:
    """As ``cut_repeats``, and what passages of ``words`` equal words cover is removed as well."""
    found = repeats_and_passages(docs, length, words)
    # all spans by their begins, then the furthest end so far tells where a new one starts
    one = lambda b, e: F.zip_with(b, e, lambda x, y: F.struct(x.alias("b"), y.alias("e")))
    listed = F.array_sort(F.concat(one("begins", "ends"), one("passage_begins", "passage_ends")))
    span = "array<struct<b: bigint, e: bigint>>"

    def join(done, s):
        last = F.element_at(done, -1)
        wider = F.struct(last["b"].alias("b"), F.greatest(last["e"], s["e"]).alias("e"))
        touched = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))
        return F.when((F.size(done) > 0) & (s["b"] <= F.try_element_at(done, F.lit(-1))["e"]), touched).otherwise(
            F.concat(done, F.array(s))
        )

    spans = F.aggregate(listed, F.array().cast(span), join)
    return found.select("_row", "body", spans.alias("_spans")).select(
        "_row", "body", F.col("_spans.b").alias("begins"), F.col("_spans.e").alias("ends")
    )


def without_passages(docs: DataFrame) -> DataFrame:
    """``without_repeats``, also of passages of over 50 words, however short their words are."""
    return _without(docs, cut_passages(docs))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of text; n_chars, if there, counts what is left.

    A character of which only a part is cut goes as a whole, so that texts stay valid.
    """
    return _without(docs, cut_repeats(docs, length))


def _without(docs: DataFrame, cut: DataFrame) -> DataFrame:
    cut = cut.withColumn("_cut", F.size("begins") > 0)
    row, left = F.col("_row"), F.decode(kept_bytes(whole_characters=True), "UTF-8")
    row = row.withField("text", F.when(F.col("_cut"), left).otherwise(row["text"]))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        count = F.when(F.col("_cut"), F.char_length(left).cast(kind)).otherwise(row["n_chars"])
        row = row.withField("n_chars", count)
    return cut.select(row.alias("_row")).select("_row.*")
