"""The divergence audit against sums over every term and pair."""

import re
from collections import Counter, defaultdict

import pytest

from gridloom.llm import divergence

from .conftest import prose

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def expected(rows, least, top):
    use, seen, langs = defaultdict(Counter), Counter(), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        langs[lang].add(source)
        use[lang, source].update(found)
        seen.update((lang, t) for t in set(found))
    out = []
    for lang, sources in langs.items():
        kept = {t for (x, t), n in seen.items() if x == lang and n >= least}
        whole = Counter()
        for s in sources:
            whole.update({t: use[lang, s][t] for t in kept})

        def shares(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        p, q = {s: shares(use[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            words = [(t, f(p[s][t], q[t])) for t in kept if use[lang, s][t] and p[s][t] > q[t]]
            for part, listed, most in (("pair", pairs, None), ("term", words, top)):
                listed.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(part, lang, s, t, v, i + 1) for i, (t, v) in enumerate(listed[:most])]
    return Counter(out)


def found(docs, least, top):
    pairs, words = divergence.audit(docs, least, top)
    return Counter(
        (part, r.lang, r.source, r.item, r.value, r["rank"])
        for part, df in (("pair", pairs), ("term", words))
        for r in df.collect()
    )


@pytest.mark.parametrize("least, top", [(1, 10), (2, 3), (10, 10), (1000, 10)])
def test_audit(make_docs, messy, least, top):
    rows = messy + [
        (200 + i, f"{prose(i % 6, 30 + i)} Straße É-{'z' * (i % 4)} x_y", ("en", "de")[i % 2], f"s{i % 5}")
        for i in range(60)
    ]
    assert found(make_docs(rows), least, top) == expected(rows, least, top)


def test_many_sources_and_equal_rows(make_docs):
    rows = [(i, f"common word{i % 7} word{i % 3}", "en", f"s{i % 23}") for i in range(300)]
    rows += [(None, None, None, None), (None, "", "en", "only")] * 2
    assert found(make_docs(rows), 1, 10) == expected(rows, 1, 10)


def test_shares_of_large_counts(spark):
    row = spark.createDataFrame([(5 * 10**17, 10**18, 10**6)], "c long, n long, v long")
    got = row.select(divergence.share(row.c, row.n, row.v).alias("p")).first().p
    assert got == 1 + 10**9 * (5 * 10**17 + 2) // (10**18 + 2 * 10**6)


def test_stretches_keep_terms_whole():
    text = ("Ab1cd " * 400_000).encode()
    assert divergence.terms(text) == {b"ab": 400_000, b"cd": 400_000}
    assert divergence.terms(b"x" * 2_500_000) == {b"x" * 2_500_000: 1}


def test_nodes_are_shared(spark):
    items = "array<struct<ix: int, p: long, source: string>>"
    rows = [("en", [(0, 5, "a"), (1, 7, "b")])] * 3 + [("en", [(0, 5, "a"), (2, 9, "c")])]
    nodes = divergence.tree_nodes(spark.createDataFrame(rows, f"lang string, items {items}")).collect()
    assert sorted((len(r.path), r.terms) for r in nodes) == [(1, 4), (2, 1), (2, 3)]


def test_empty(make_docs):
    assert not found(make_docs([]), 10, 10)
