"""Near copies, repeated strings, pair scores, neighbours, and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import hnsw, katz, queries, simhash, suffix

from .conftest import prose


def brute_print(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    parts = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    votes = Counter()
    for part in parts:
        value = xxhash.xxh64_intdigest(part, 42)
        votes.update(b for b in range(64) if value >> b & 1)
    return sum(1 << b for b, n in votes.items() if 2 * n > len(parts))


def brute_components(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_duplicates(make_docs, messy):
    got = simhash.near_duplicates(make_docs(messy)).collect()
    prints = [brute_print(r[1]) for r in messy]
    label = brute_components(prints)
    least = {}
    for root, row in zip(label, messy):
        if row[0] is not None:
            least[root] = min(least.get(root, row[0]), row[0])
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    want = Counter((r[0], signed(p), least.get(x)) for r, p, x in zip(messy, prints, label))
    assert Counter(map(tuple, got)) == want
    docs = make_docs(messy)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(label))
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_gray_index_against_all_pairs():
    draw = np.random.default_rng(1)
    for n in (1, 17, 400):
        base = draw.integers(0, 2**63, max(1, n // 8), dtype=np.uint64)
        codes = base[draw.integers(0, len(base), n)]
        for _ in range(3):
            flip = np.uint64(1) << draw.integers(0, 64, n).astype(np.uint64)
            codes = codes ^ (flip * draw.integers(0, 2, n).astype(np.uint64))
        codes = np.unique(codes)
        rest = np.uint64((1 << 48) - 1)
        codes = codes[np.lexsort((simhash.gray_rank(codes & rest), codes >> np.uint64(48)))]
        near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3) & (
            codes[:, None] >> np.uint64(48) == codes[None, :] >> np.uint64(48)
        )
        want = np.arange(len(codes))
        simhash._union(want, *np.nonzero(near))
        assert (simhash.linked_classes(codes) == want).all()


def test_gray_rank_orders_neighbours_by_one_bit():
    codes = np.array(sorted(range(256), key=lambda c: int(simhash.gray_rank(np.array([c], np.uint64))[0])), np.uint64)
    assert (np.bitwise_count(codes[1:] ^ codes[:-1]) == 1).all()


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(pairs, "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200: 100}


def brute_cut(texts, length=400):
    places = defaultdict(list)
    for i, t in enumerate(texts):
        for j in range(len(t) - length + 1):
            places[t[j : j + length]].append((i, j))
    covered = [bytearray(len(t)) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for i, j in found:
                covered[i][j : j + length] = b"\1" * length
    out = []
    for t, c in zip(texts, covered):
        kept = bytes(x for x, y in zip(t, c) if not y)
        spans = sum(c[k] and (k == 0 or not c[k - 1]) for k in range(len(c)))
        out.append((len(t), sum(c), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [3000, 1_000_000])
def test_repeated_strings(make_docs, messy, shard_bytes):
    draw = random.Random(0)
    base = "".join(draw.choice("abcdefgh é日") for _ in range(1500))
    texts = []
    for _ in range(20):
        letters = list(base)
        for _ in range(draw.randint(0, 4)):
            letters[draw.randrange(len(letters))] = "Z"
        at = draw.randrange(300)
        texts.append("".join(letters)[at : at + draw.randint(200, 1400)])
    texts += ["ab " * 500, "ab " * 300 + base[:450], "x" * 399, "y" * 400, "y" * 401, base[:700] + base[200:900]]
    rows = [r for r in messy if r[0] != 7] + [(100 + i, t, "en", "a") for i, t in enumerate(texts)]
    removed = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("bigint"), lambda a, x: a + x)
    got = suffix.cut_repeats(make_docs(rows), shard_bytes=shard_bytes).select(
        "_row.doc_id", F.octet_length("body"), removed, F.size("begins"), F.sha2(suffix.kept_bytes(), 256)
    )
    want = Counter((r[0], *w) for r, w in zip(rows, brute_cut([(r[1] or "").encode() for r in rows])))
    assert Counter(map(tuple, got.collect())) == want


def test_text_without_repeats(make_docs, messy):
    rows = [(1, "é" * 250 + "-" + prose(3, 50), "en", "a"), (2, "é" * 250 + "!" + prose(4, 50), "en", "b"), *messy]
    docs = make_docs(rows)
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got[4, None] == 1 and got[5, ""] == 1
    assert got[1, "-" + prose(3, 50)] == 1 and got[1, ""] == 1
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert suffix.cut_repeats(make_docs([])).count() == 0


@pytest.mark.parametrize("data", [b"a", b"abababab", b"mississippi", b"a" * 300])
def test_suffix_array(data):
    text = np.frombuffer(data, np.uint8)
    order = suffix.suffix_order(text)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    common = suffix.common_prefixes(text, order, 50)
    for k in range(1, len(data)):
        a, b = data[order[k - 1] :], data[order[k] :]
        size = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == min(50, size)


def brute_scores(rows):
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    one, two, before = Counter(), Counter(), Counter()
    for text in train:
        found = [b"", *tokens(text)]
        one.update(found[1:]), two.update(zip(found, found[1:])), before.update(found[:-1])
    total, types = sum(one.values()), len(one)
    histogram = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
    singles, ratio = katz.Singles(total, types, histogram(one)), katz.discounts(histogram(two))
    by_count = {c: float(singles.probability(np.array([c]))[0]) for c in {0, *one.values()}}
    single = lambda w: by_count[one[w]]
    kept = lambda c: (ratio[c] if c <= 5 else 1) * c
    follow = defaultdict(list)
    for (a, b), c in two.items():
        if c >= 2:
            follow[a].append((b, c))
    context = {}
    for a, found in follow.items():
        mass = sum(kept(c) for _, c in found)
        whole = before[a] + 1 if before[a] - mass < 1e-9 else before[a]
        context[a] = whole, (1 - mass / whole) / (1 - sum(single(b) for b, _ in found))
        if len(context) > 20:
            continue
        seen = dict(found)
        rest = singles.unknown + sum(single(w) for w in one if w not in seen)
        assert mass / whole + context[a][1] * rest == pytest.approx(1)
    assert sum(map(single, one)) + singles.unknown == pytest.approx(1)
    out = []
    for i, text in rows:
        found = tokens(text)
        score = base = 0.0
        for a, b in zip([b"", *found], found):
            base += math.log10((one[b] + 0.1) / (total + 0.1 * (types + 1)))
            if two[a, b] >= 2:
                score += math.log10(kept(two[a, b]) / context[a][0])
            else:
                score += math.log10(context.get(a, (0, 1))[1]) + math.log10(single(b))
        out.append((i, len(found), sum(one[w] > 0 for w in found), total, base, score))
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_tokens": 2000, "part_entries": 1000}])
def test_katz(make_docs, messy, sizes, monkeypatch):
    monkeypatch.setattr(katz, "HOT_CONTEXT", 50)
    rows = messy + [(300 + i, prose(i % 7, 200), "en", "a") for i in range(30)]
    got = katz.score_documents(make_docs(rows), **sizes)[0].collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    have = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    want = sorted(brute_scores([r[:2] for r in rows]), key=key)
    assert [r[:4] for r in have] == [r[:4] for r in want]
    for a, b in zip(have, want):
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)
    assert katz.score_documents(make_docs([]))[0].count() == 0


def test_discounts_fall_back():
    assert (katz.discounts([0, 0, 0, 0, 0, 0]) == 1).all()
    assert (katz.discounts([10, 0, 0, 0, 0, 0]) == 1).all()
    found = katz.discounts([1000, 400, 220, 140, 100, 75])
    assert ((found[1:] > 0) & (found[1:] < 1)).all()


def brute_nearest(rows, query, count=5):
    sound = [
        (i, np.array(v, float)) for i, v in rows
        if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
    ]
    asked = dict(sound)[query]
    cosine = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    found = sorted((-round(cosine(asked, v), 12), i) for i, v in sound if i != query and len(v) == len(asked))
    return [i for _, i in found[:count]]


def test_neighbours(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [None] + [1.0] * 7),
             (2004, [1.0, 2.0]), (None, [1.0] * 8), (2005, []), (2006, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<float>, key string, rank string")
    got = hnsw.nearest(df, F.col("vec_id") % 50 == 0).collect()
    by_query = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by_query[r.query_id].append(r.vec_id)
    asked = [i for i, v in rows if i is not None and i % 50 == 0 and i != 2000]
    assert set(by_query) == set(asked)
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    hits = sum(len(set(by_query[q]) & set(brute_nearest(floats, q))) for q in asked)
    assert hits / (5 * len(asked)) >= 0.95
    assert by_query[0] == [1000, 1001, 1002, 1003, 1004]
    assert hnsw.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in hnsw.nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.0)]


def test_pipeline(spark, make_docs, messy):
    import corpus_pipeline

    from gridloom.session import settle

    docs = make_docs(messy)
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, ""))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    assert out.count() == docs.count() > 0
    assert set(queries.QUERIES) >= {"op1_mix_sources"} and len(corpus_pipeline.STAGES) == 5
