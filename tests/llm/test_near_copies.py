"""Removal of near copies against exact similarities of all pairs, and repeats with NUL bytes."""

import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.llm import simhash, suffix

from .conftest import prose
from .test_copies import brute_cut

SF = "/root/testdata/sf0.1"


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) <= 5:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(5))))


def similar(a, b):
    common = len(a & b)
    return 5 * common >= 4 * (len(a) + len(b) - common)


def edited(text, edits, draw):
    words = text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = "edit%d" % draw.randrange(1000)
    return " ".join(words)


def groups(sets):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and similar(sets[i], sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_groups_of_near_copies(make_docs, messy):
    draw = random.Random(3)
    rows = [r for r in messy if r[0] != 7]
    for g in range(12):
        base = prose(500 + g, 60 + 40 * g)
        rows += [
            (1000 + 100 * g + k, edited(base, k * (6 + 4 * g) // 24, draw), "en", "a") for k in range(8)
        ]
    docs = make_docs(rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    label = groups([shingles(r[1]) for r in rows])
    least = {}
    for root, row in zip(label, rows):
        key = (row[0] is None, row[0] or 0)
        least[root] = min(least.get(root, key), key)
    want = Counter(None if none else i for none, i in least.values())
    # candidates are found with a probability: a tenth may stay that should go, but nothing else goes
    assert not want - got
    assert sum((got - want).values()) <= 0.1 * (len(rows) - sum(want.values()))


def test_removal_on_an_empty_table(make_docs):
    assert simhash.one_of_each(make_docs([])).count() == 0


def test_near_pairs_of_the_index():
    draw = np.random.default_rng(5)
    codes = np.sort(draw.integers(0, 2**63, 300, dtype=np.uint64) >> np.uint64(2))
    codes[50:90] = codes[50] ^ (np.uint64(1) << draw.integers(0, 40, 40).astype(np.uint64))
    codes = np.sort(codes)
    more = np.zeros(300, np.uint64)
    got = set()
    for i, j, apart in simhash.near_pairs(codes, more, 8):
        got |= set(zip(i.tolist(), j.tolist(), apart.tolist()))
    want = set()
    for i in range(300):
        for j in range(i + 1, 300):
            d = int(codes[i] ^ codes[j]).bit_count()
            if int(codes[i]) >> 56 == int(codes[j]) >> 56 and d <= simhash.MOST_HALF:
                want.add((i, j, d))
    assert got == want and len(want) > 100


@pytest.mark.skipif(not pq, reason="test tables are absent")
def test_recall_on_documents(spark):
    """Of pairs of different texts with a similarity of 0.8 or more, found by exact counting of
    shared shingles, at least 0.9 lose one document or both; nothing goes without such a partner."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    first, holders = {}, {}
    for r in rows:
        first.setdefault((r.text or "").lower().encode().split().__repr__(), []).append(r)
    texts = [(v[0].doc_id, shingles(v[0].text), {x.doc_id for x in v}) for v in first.values()]
    for at, (_, found, _) in enumerate(texts):
        for s in found:
            holders.setdefault(s, []).append(at)
    shared = Counter()
    for held in holders.values():
        if 1 < len(held) <= 200:
            shared.update((a, b) for k, b in enumerate(held) for a in held[:k])
    near = [
        (a, b) for (a, b), n in shared.items()
        if 2 * n > min(len(texts[a][1]), len(texts[b][1])) and similar(texts[a][1], texts[b][1])
    ]
    kept = {r.doc_id for r in simhash.one_of_each(docs).select("doc_id").collect()}
    missed = sum(bool(texts[a][2] & kept) and bool(texts[b][2] & kept) for a, b in near)
    assert len(near) > 40 and missed <= 0.1 * len(near), (missed, len(near))
    partner = {a for pair in near for a in pair}
    gone = [at for at, t in enumerate(texts) if not t[2] & kept]
    assert set(gone) <= partner
    print("pairs", len(near), "missed", missed, "texts gone", len(gone))


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array_with_zero_bytes(seed):
    draw = random.Random(seed)
    for _ in range(300):
        data = bytes(draw.choice((0, 0, 1, draw.randrange(256))) for _ in range(draw.randint(1, 60)))
        order = suffix.suffix_order(np.frombuffer(data, np.uint8))
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_repeats_with_zero_bytes(make_docs):
    nul = "\0" * 6
    texts = [("ab" + nul) * 60 + "cd" * 250, "x" + ("ab" + nul) * 60, "\0" * 900, "\0" * 401, "q" + "\0" * 450]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    removed = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("bigint"), lambda a, x: a + x)
    got = suffix.cut_repeats(make_docs(rows)).select(
        "_row.doc_id", F.octet_length("body"), removed, F.size("begins"), F.sha2(suffix.kept_bytes(), 256)
    )
    want = Counter((i, *w) for i, w in enumerate(brute_cut([t.encode() for t in texts])))
    assert Counter(map(tuple, got.collect())) == want


def test_passages_of_words(make_docs, messy):
    draw = random.Random(9)
    shared = [prose(900 + i, draw.randint(48, 56)) for i in range(8)]
    rows = [r for r in messy if r[0] != 7]
    for i in range(24):
        text = f"{prose(1000 + i, 30)} {shared[i % 8]}  {prose(1100 + i, draw.randint(0, 30))}"
        rows.append((400 + i, text.replace(" ", "\n ") if i % 3 == 0 else text, "en", "a"))
    found = suffix.repeats_and_passages(make_docs(rows)).select(
        "_row.doc_id", F.size("passage_begins").alias("n"), "passage_begins", "passage_ends"
    )
    texts = [(r[1] or "").encode() for r in rows]
    places = {}
    for at, text in enumerate(texts):
        words = text.split()
        for k in range(len(words) - 50):
            places.setdefault(tuple(words[k : k + 51]), []).append((at, k))
    covered = [set() for _ in texts]
    for held in places.values():
        if len(held) > 1:
            for at, k in held:
                covered[at].update(range(k, k + 51))
    want = Counter()
    for row, text, words in zip(rows, texts, covered):
        edges = [m.span() for m in suffix.WORD.finditer(text)]
        begins = [edges[k][0] for k in sorted(words) if k - 1 not in words]
        ends = [edges[k][1] for k in sorted(words) if k + 1 not in words]
        want[row[0], tuple(begins), tuple(ends)] += 1
    got = Counter((r.doc_id, tuple(r.passage_begins), tuple(r.passage_ends)) for r in found.collect())
    assert got == want and sum(bool(b) for _, b, _ in want) > 5


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array_of_words(seed):
    draw = np.random.default_rng(seed)
    for _ in range(100):
        data = draw.integers(0, 4, draw.integers(1, 60)).astype(np.uint64) * np.uint64(2**61)
        order, listed = suffix.suffix_order(data), data.tolist()
        assert order.tolist() == sorted(range(len(listed)), key=lambda i: listed[i:])
        common = suffix.common_prefixes(data, order, 9, lanes=4)
        for k in range(1, len(listed)):
            a, b = listed[order[k - 1] :], listed[order[k] :]
            size = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == min(9, size)


def test_links_that_no_table_proposes(make_docs, messy, monkeypatch):
    """Nearest neighbours only make groups early: without any of them the groups are the same."""
    draw = random.Random(5)
    rows = [r for r in messy if r[0] != 7]
    for g in range(8):
        base = prose(800 + g, 40 + 30 * g)
        rows += [(1000 + 100 * g + k, edited(base, k * (4 + 3 * g) // 16, draw), "en", "a") for k in range(8)]
    monkeypatch.setattr(
        simhash, "candidate_prints",
        lambda distinct, rows: distinct.select(F.col("print").alias("a"), F.col("print").alias("b")).limit(0),
    )
    got = Counter(r.doc_id for r in simhash.one_of_each(make_docs(rows)).collect())
    least = {}
    for root, row in zip(groups([shingles(r[1]) for r in rows]), rows):
        key = (row[0] is None, row[0] or 0)
        least[root] = min(least.get(root, key), key)
    assert got == Counter(None if none else i for none, i in least.values())
    assert len(rows) - sum(got.values()) > 20


def test_shingles_are_counted_in_slices(make_docs, monkeypatch):
    """A task holds a few texts at once; the levels are those of all texts."""
    taken = simhash.utf8

    def few(column):
        assert len(column) <= simhash.SLICE_ROWS
        return taken(column)

    texts = [prose(n, 12) for n in range(1300)]
    docs = make_docs([(n, t, None, None) for n, t in enumerate(texts)]).coalesce(1)
    monkeypatch.setattr(simhash, "utf8", few)
    levels = simhash.shingle_levels(docs)
    total = np.zeros(simhash.COUNTERS, np.int64)
    for text in texts:
        np.add.at(total, simhash.shingle_words(text.encode()) & (simhash.COUNTERS - 1), 1)
    assert (levels == np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8)).all()
