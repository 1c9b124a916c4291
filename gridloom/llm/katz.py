"""Word scoring with a Katz backoff model of pairs.

A training token is a word of a training document, or its one end.  Pairs seen ``least_pair`` times
or more (the query: once, so all of them) keep a Good-Turing discounted share of their context's
count; what is left of a context goes to all other tokens by their discounted single counts, with a weight that makes every context sum to one; what
is left of the single counts goes to the unknown word.  Every token is looked up as a pair, then as
a single, then as unknown.

Counts are too many to send to every task, and so are the tokens.  So documents are packed into
blocks of some million tokens, written once.  A block asks each partition of the word table, and
then of the pair table, for its distinct entries; a partition sums what all blocks sent, keeps the
table's rows, and answers each block in the order of its request.  What moves is one entry per
distinct word or pair of a block, as sorted and compressed arrays.  A context that is very frequent
is spread over many partitions by its second word.

Defined results: a null text is empty and has only its end; documents with a null id train; repeated
rows are separate documents; without any training token all words are unknown and the end is too.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .text import utf8

BLOCK_TOKENS = 500_000
PART_ENTRIES = 500_000
#: Counts above this are not discounted; pairs below LEAST_PAIR count as unseen unless a caller
#: gives another limit.
MOST_DISCOUNTED = 5
LEAST_PAIR = 2
#: Contexts with more tokens than this are spread over SALTS partitions.
HOT_CONTEXT = 100_000
SALTS = 64
BEGIN, END = b"", b"\n"
MESSAGE = "block long, part int, kind string, data binary, hist array<long>"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers as compressed planes of octets."""
    head = np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()
    planes = [
        np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes() if len(a) else b""
        for a in arrays
    ]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, count, 8).tolist()
    at, out = 8 * (count + 1), []
    for size, kind in zip(sizes, kinds or ("i8",) * count):
        planes = np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 8 * size
    return out


class _Numbers(dict):
    """The number of each word, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _block(ids: list, texts: list[np.ndarray], trains: list[bool], words: _Numbers) -> tuple:
    sizes = np.array([len(t) for t in texts], np.int64)
    tokens = np.concatenate(texts)
    train = np.array(trains, np.int64)
    counts = np.bincount(tokens, np.repeat(train, sizes), len(words)).astype(np.int64)
    counts[words[BEGIN]] = train.sum()
    spelled = zstandard.ZstdCompressor(level=1).compress(b" ".join(words))
    return ids, pack(sizes, train, tokens), spelled, pack(counts), len(words), len(tokens)


def blocks_of(docs: DataFrame, folds: int, block_tokens: int) -> DataFrame:
    """Settled: block, docs (ids), data (sizes, training flags, tokens), words, counts, sizes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0
    names = ["docs", "data", "words", "counts", "n_words", "n_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, trains, words, size = [], [], [], _Numbers(), 0
        id_type = None

        def row() -> pa.RecordBatch:
            made = _block(ids, texts, trains, words)
            types = (pa.list_(id_type), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(made, types)], names=names
            )

        for batch in batches:
            id_type = batch.column("doc_id").type
            flags = batch.column("train").to_pylist()
            for id_, text, train in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), flags):
                if not texts:
                    words[BEGIN], words[END]  # numbers 0 and 1
                found = text.lower().split()
                found.append(END)
                texts.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                ids.append(id_)
                trains.append(train)
                size += len(found)
                if size >= block_tokens:
                    yield row()
                    ids, texts, trains, words, size = [], [], [], _Numbers(), 0
        if texts:
            yield row()

    rows = docs.select(
        "doc_id", F.col("text").cast("string"), (~F.coalesce(held, F.lit(False))).alias("train")
    ).mapInArrow(
        work,
        f"docs array<{kind}>, data binary, words binary, counts binary, n_words long, n_tokens long",
    )
    return settle(rows.withColumn("block", F.monotonically_increasing_id()), compression="zstd")


def _by_part(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places in order) of every part."""
    order = np.argsort(parts, kind="stable")
    cuts = np.flatnonzero(np.diff(parts[order])) + 1
    for mine in np.split(order, cuts):
        if len(mine):
            yield int(parts[mine[0]]), mine


def _ask_words(parts: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")
                (counts,) = unpack(row["counts"])
                digest = xxhash.xxh64_intdigest
                of = np.fromiter((digest(w) % parts for w in words), np.int64, len(words))
                for part, mine in _by_part(of):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([row["block"]], pa.int64()),
                            "part": pa.array([part], pa.int32()),
                            "words": pa.array([b" ".join([words[i] for i in mine.tolist()])], pa.binary()),
                            "data": pa.array([pack(mine, counts[mine])], pa.binary()),
                        }
                    )

    return work


def _message(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "part", "kind", "data", "hist"])


def _histogram(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, ... up to one beyond the discounted ones."""
    return np.bincount(counts[counts <= MOST_DISCOUNTED + 1], minlength=MOST_DISCOUNTED + 2)[1:].tolist()


def _answer_words(parts: int):
    """A word partition: total counts, ids in order of count, and the answers to the blocks."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        part, totals, asked = int(group["part"].iloc[0]), {}, []
        for block, words, data in zip(group["block"], group["words"], group["data"]):
            words, (places, counts) = words.split(b" "), unpack(data)
            for word, count in zip(words, counts.tolist()):
                totals[word] = totals.get(word, 0) + count
            asked.append((block, words, places))
        order = sorted(totals, key=lambda w: (-totals[w], w))
        number = {w: part + parts * i for i, w in enumerate(order)}
        rows = []
        for block, words, places in asked:
            ids = np.array([number[w] for w in words], np.int64)
            counts = np.array([totals[w] for w in words], np.int64)
            rows.append((block, part, "words", pack(places, ids, counts), None))
        seen = np.array([c for w, c in totals.items() if c and w != BEGIN], np.int64)
        rows.append((-1, part, "singles", None, [int(seen.sum()), len(seen), *_histogram(seen)]))
        return _message(rows)

    return work


def discounts(histogram: list[int]) -> np.ndarray:
    """Good-Turing discount ratio by count from 0 to MOST_DISCOUNTED.

    ``histogram[r - 1]`` is the number of entries of count r.  The limit is lowered until every
    ratio lies between 0 and 1; counts beyond it keep all of their mass.
    """
    out = np.ones(MOST_DISCOUNTED + 1)
    n = [0, *histogram]
    for limit in range(MOST_DISCOUNTED, 0, -1):
        if not all(n[r] for r in range(1, limit + 2)):
            continue
        common = (limit + 1) * n[limit + 1] / n[1]
        ratio = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common != 1 else -1.0
                 for r in range(1, limit + 1)]
        if all(0 < d < 1 for d in ratio):
            out[1 : limit + 1] = ratio
            break
    return out


class Singles:
    """Probabilities of single tokens; the unknown word has what discounting leaves."""

    def __init__(self, tokens: int, types: int, histogram: list[int]):
        self.tokens, self.types = tokens, types
        self.ratio = discounts(histogram)
        kept = sum((1 - self.ratio[r]) * r * histogram[r - 1] for r in range(1, MOST_DISCOUNTED + 1))
        self.unknown = max(kept, tokens / (tokens + 1)) / tokens if tokens else 1.0
        #: What the known words had before they were scaled to leave ``unknown``.
        self.mass = tokens - kept

    def probability(self, counts: np.ndarray) -> np.ndarray:
        ratio = self.ratio[np.minimum(counts, MOST_DISCOUNTED)]
        ratio = np.where(counts > MOST_DISCOUNTED, 1.0, ratio)
        known = ratio * counts / max(self.mass, 1e-300) * (1 - self.unknown)
        return np.where(counts > 0, known, self.unknown)


class Pairs:
    """The distinct pairs of one block, by partition, each in the order of its ids."""

    def __init__(self, data: bytes, answers: list[tuple[int, bytes]], parts: int):
        self.sizes, self.train, self.tokens = unpack(data)
        total = sum(len(unpack(a)[0]) for _, a in answers)
        self.ids, self.counts = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for _, answer in answers:
            places, ids, counts = unpack(answer)
            self.ids[places], self.counts[places] = ids, counts
        last = np.cumsum(self.sizes)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[last - self.sizes] = 0  # the begin mark
        key, self.place = np.unique(before * total + self.tokens, return_inverse=True)
        self.first, self.second = key // total, key % total
        train = np.repeat(self.train, self.sizes)
        self.n = np.bincount(self.place, train, len(key)).astype(np.int64)
        first, second = self.ids[self.first], self.ids[self.second]
        if len(first) and max(first.max(), second.max()) >= 1 << 31:
            raise ValueError("more than 2**31 distinct words")
        salt = np.where(self.counts[self.first] > HOT_CONTEXT, second % SALTS + 1, 0)
        mixed = (first * SALTS * 2 + salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((second, first))
        self.parts = [(p, order[mine]) for p, mine in _by_part(part[order])]


def _ask_pairs(parts: int):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["block"].iloc[0])
        data = group.loc[group["kind"] == "block", "data"].iloc[0]
        answers = group[group["kind"] == "words"]
        pairs = Pairs(data, list(zip(answers["part"], answers["data"])), parts)
        rows = []
        for part, mine in pairs.parts:
            first = pairs.ids[pairs.first[mine]]
            n = pairs.n[mine]
            after = np.where(n > 0, pairs.counts[pairs.second[mine]], 0)
            steps = np.diff(first, prepend=0)
            rows.append((block, part, "pairs", pack(steps, pairs.ids[pairs.second[mine]], n, after), None))
        return _message(rows)

    return work


CONTEXTS = "context array<long>, seen array<double>, singles array<double>, counted array<array<long>>"


def _answer_pairs(singles: Singles, least_pair: int):
    """A pair partition: total counts, sums per context, and the answers to the blocks."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        sent = [unpack(d) for d in group["data"]]
        first = np.concatenate([np.cumsum(s[0]) for s in sent])
        second = np.concatenate([s[1] for s in sent])
        key, place = np.unique((first << 32) | second, return_inverse=True)
        total = np.bincount(place, np.concatenate([s[2] for s in sent]), len(key)).astype(np.int64)
        after = np.zeros(len(key), np.int64)
        np.maximum.at(after, place, np.concatenate([s[3] for s in sent]))
        rows, at = [], 0
        for block, s in zip(group["block"], sent):
            mine = total[place[at : at + len(s[1])]]
            rows.append((block, part, "counts", pack(mine), None, None, None, None, None))
            at += len(s[1])
        kept = total >= least_pair
        context, count = key[kept] >> 32, total[kept]
        start = np.flatnonzero(np.diff(context, prepend=-1))
        sums = lambda v: np.add.reduceat(v, start) if len(start) else np.zeros(0)
        counted = np.stack(
            [sums((count == r).astype(np.int64)) for r in range(1, MOST_DISCOUNTED + 1)]
            + [sums(np.where(count > MOST_DISCOUNTED, count, 0))],
            axis=1,
        ) if len(start) else np.zeros((0, MOST_DISCOUNTED + 1), np.int64)
        rows.append(
            (-1, part, "table", pack(key[kept] >> 32, key[kept] & 0xFFFFFFFF, count),
             _histogram(total), context[start], sums(singles.probability(after[kept])),
             None, list(counted.astype(np.int64)))
        )
        names = ["block", "part", "kind", "data", "hist", "context", "singles", "seen", "counted"]
        frame = pd.DataFrame(rows, columns=names)
        return frame[names[:5] + ["context", "seen", "singles", "counted"]]

    return work


def _answer_contexts(contexts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """Sums of each asked word as a context, in the order of the words' answer."""
    contexts = contexts.sort_values("context")
    known = contexts["context"].to_numpy(np.int64)
    rows = []
    for block, part, data in zip(words["block"], words["part"], words["data"]):
        ids = unpack(data)[1]
        seen, singles = np.zeros(len(ids)), np.zeros(len(ids))
        if len(known):
            at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            hit = known[at] == ids
            seen[hit] = contexts["seen"].to_numpy(np.float64)[at[hit]]
            singles[hit] = contexts["singles"].to_numpy(np.float64)[at[hit]]
        rows.append((block, part, "contexts", pack(seen, singles), None))
    return _message(rows)


def _score(parts: int, singles: Singles, pair_ratio: np.ndarray, least_pair: int):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        of = {k: g for k, g in group.groupby("kind")}
        base = of["block"].iloc[0]
        words = of["words"].sort_values("part")
        pairs = Pairs(base["data"], list(zip(words["part"], words["data"])), parts)
        seen, lower = np.zeros(len(pairs.ids)), np.zeros(len(pairs.ids))
        sums = dict(zip(of["contexts"]["part"], of["contexts"]["data"]))
        for part, data in zip(words["part"], words["data"]):
            places = unpack(data)[0]
            seen[places], lower[places] = unpack(sums[part], "f8", "f8")
        total = np.zeros(len(pairs.n), np.int64)
        counts = dict(zip(of["counts"]["part"], of["counts"]["data"]))
        for part, mine in pairs.parts:
            total[mine] = unpack(counts[part])[0]
        tokens = pairs.counts.astype(np.float64)  # of each word, as a context
        # a context whose pairs keep all of its count gets one more, for the rest
        whole = np.where((seen > 0) & (tokens - seen < 1e-9), tokens + 1, np.maximum(tokens, 1))
        weight = np.where(seen > 0, (1 - seen / whole) / np.maximum(1 - lower, 1e-300), 1.0)
        single = np.log10(singles.probability(pairs.counts))
        ratio = np.where(total > MOST_DISCOUNTED, 1.0, pair_ratio[np.minimum(total, MOST_DISCOUNTED)])
        kept = total >= least_pair
        direct = np.log10(np.where(kept, ratio * total / whole[pairs.first], 1.0))
        backed = np.log10(weight[pairs.first]) + single[pairs.second]
        by_pair = np.where(kept, direct, backed)
        row = np.repeat(np.arange(len(pairs.sizes)), pairs.sizes)
        add = lambda v: np.bincount(row, v, len(pairs.sizes))
        count = pairs.counts[pairs.tokens]
        smooth = np.log10((count + 0.1) / (singles.tokens + 0.1 * (singles.types + 1)))
        return pd.DataFrame(
            {
                "doc_id": pd.Series(list(base["docs"]), dtype=object),
                "held_out": pairs.train == 0,
                "n_tokens": pairs.sizes,
                "n_known": add(count > 0).astype(np.int64),
                "base_score": add(smooth),
                "score": add(by_pair[pairs.place]),
            }
        )

    return work


def score_documents(
    docs: DataFrame,
    folds: int = 10,
    block_tokens: int = BLOCK_TOKENS,
    part_entries: int = PART_ENTRIES,
    least_pair: int = LEAST_PAIR,
) -> tuple[DataFrame, DataFrame]:
    """(scores, pair table).  scores: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.  The pair table's rows hold sorted arrays of first word, second word, count.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = blocks_of(docs, folds, block_tokens)
    sizes = blocks.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    word_parts = max(1, -(-(sizes[0] or 0) // part_entries))
    pair_parts = max(1, -(-(sizes[1] or 0) // part_entries))
    asked = blocks.select("block", "words", "counts").mapInArrow(
        _ask_words(word_parts), "block long, part int, words binary, data binary"
    )
    words = settle(asked.groupBy("part").applyInPandas(_answer_words(word_parts), MESSAGE))
    places = [F.sum(F.get("hist", F.lit(i))) for i in range(MOST_DISCOUNTED + 3)]
    totals = [v or 0 for v in words.where("kind = 'singles'").agg(*places).first()]
    singles = Singles(totals[0], totals[1], totals[2:])
    message = ["block", "part", "kind", "data"]
    body = blocks.select(
        "block", F.lit(-1).alias("part"), F.lit("block").alias("kind"), "data"
    )
    answers = words.where("kind = 'words'").select(*message)
    pairs = body.unionByName(answers).groupBy("block").applyInPandas(_ask_pairs(pair_parts), MESSAGE)
    table = settle(
        pairs.groupBy("part").applyInPandas(_answer_pairs(singles, least_pair), f"{MESSAGE}, {CONTEXTS}"),
        compression="zstd",
    )
    places = [F.sum(F.get("hist", F.lit(i))) for i in range(MOST_DISCOUNTED + 1)]
    found = [v or 0 for v in table.where("kind = 'table'").agg(*places).first()]
    pair_ratio = discounts(found)
    mass = F.lit(0.0)
    for r in range(least_pair, MOST_DISCOUNTED + 1):
        mass = mass + F.get("c.counted", F.lit(r - 1)) * float(pair_ratio[r] * r)
    mass = mass + F.get("c.counted", F.lit(MOST_DISCOUNTED))
    zipped = F.explode(F.arrays_zip("context", "singles", "counted")).alias("c")
    contexts = (
        table.where("kind = 'table'")
        .select(zipped)
        .select(F.col("c.context").alias("context"), mass.alias("seen"), F.col("c.singles").alias("singles"))
        .groupBy("context")
        .agg(F.sum("seen").alias("seen"), F.sum("singles").alias("singles"))
        .withColumn("in_part", F.pmod("context", F.lit(word_parts)).cast("int"))
    )
    sums = contexts.groupBy("in_part").cogroup(answers.groupBy("part")).applyInPandas(
        _answer_contexts, MESSAGE
    )
    counts = table.where("kind = 'counts'").select(*message)
    everything = (
        answers.unionByName(sums.select(*message))
        .unionByName(counts)
        .withColumn("docs", F.lit(None).cast(f"array<{kind}>"))
        .unionByName(
            blocks.select(
                "block", F.lit(-1).alias("part"), F.lit("block").alias("kind"), "data", "docs"
            )
        )
    )
    columns = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scores = everything.groupBy("block").applyInPandas(
        _score(pair_parts, singles, pair_ratio, least_pair), columns
    )
    return (
        scores.withColumn("train_tokens", F.lit(int(singles.tokens)).cast("bigint")),
        table.where("kind = 'table'").select("part", "data"),
    )
