"""Mixing and sharding."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing, sharding

ASCII_SPACE = " \t\n\v\f\r"


def words(text):
    return len((text or "").encode().split())


def expected_targets(rows):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += words(text)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = total / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if weight[s] * level > 2 * sizes[s] + 1e-9}
        if not full:
            return sizes, out | {s: weight[s] * level for s in free}
        out |= {s: 2.0 * sizes[s] for s in full}
        total -= sum(2 * sizes[s] for s in full)
        free -= full


@pytest.mark.parametrize("block", [7, 1024])
def test_mix(make_docs, messy, block):
    listed, spans = mixing.mix(make_docs(messy), block=block)
    got = mixing.words_taken(listed, spans).collect()
    assert len(got) == len(messy)
    sizes, targets = expected_targets(messy)
    taken = Counter()
    for row in got:
        source = None if row.src == "z" else row.src[1:]
        assert row.source_size == sizes[source]
        assert row.target == pytest.approx(targets[source])
        assert 0 <= row.taken <= 2 * row.size
        taken[source] += row.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1
    again = mixing.words_taken(*mixing.mix(make_docs(messy[::-1]), block=block)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_schedule_is_close_to_its_weights(spark):
    sources = spark.createDataFrame(
        [("a", 0, 0, 600_000.0), ("b", 1, 0, 300_000.0), ("c", 2, 0, 100_000.0), ("d", 3, 0, 1.0)],
        "src string, _ix int, source_size long, target double",
    )
    rows = mixing.schedule(sources, block=100).orderBy("slot").collect()
    for end in (100, 1000, 10_000):
        found = Counter(r.src for r in rows[:end])
        for name, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
            assert abs(found[name] - share * end) < 6
    assert sum(r.src == "d" for r in rows) == 1
    for name in "abcd":
        assert [r["rank"] for r in rows if r.src == name] == list(range(sum(r.src == name for r in rows)))


def test_mixed_documents(make_docs, messy):
    docs = make_docs(messy)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    sizes, targets = expected_targets(messy)
    taken = Counter()
    for row in out.collect():
        taken[row.source] += words(row.text)
    largest = max(words(r[1]) for r in messy)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest / 2 + 1


def test_empty_tables(make_docs):
    empty = make_docs([])
    assert mixing.words_taken(*mixing.mix(empty)).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert sharding.shard_rows(empty).count() == 0


def test_shards(make_docs, messy):
    rows = messy * 5
    got = sharding.shard_rows(make_docs(rows), shards=4).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in sizes:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    want = Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows
    )
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    # the mixture: a shard's share of a source is its even share, to one row
    for src, n in Counter(r.src for r in got).items():
        for shard in sizes:
            assert abs(sum(r.src == src and r.shard == shard for r in got) - n / 4) <= 2


def test_native_plans(make_docs, messy):
    listed, spans = mixing.mix(make_docs(messy))
    for df in (spans, sharding.shard_rows(make_docs(messy)), mixing.mixed_documents(make_docs(messy))):
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
        assert "CartesianProduct" not in plan
    assert F is not None
