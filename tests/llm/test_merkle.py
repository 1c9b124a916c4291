"""The Merkle manifest against a tree built row by row."""

import hashlib
import zlib
from collections import Counter

import pytest

from gridloom.llm import merkle

from .conftest import prose


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(level, fanout):
    """The root, and for every leaf its siblings by level as (left, right)."""
    paths, below = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        runs = [range(i, min(i + fanout, len(level))) for i in range(0, len(level), fanout)]
        for run in runs:
            for at in run:
                step = "".join(level[run[0] : at]), "".join(level[at + 1 : run[-1] + 1])
                for leaf in below[at]:
                    paths[leaf].append(step)
        below = [[leaf for at in run for leaf in below[at]] for run in runs]
        level = [digest(*[level[at] for at in run]) for run in runs]
    return level[0], paths


def expected(rows, fanout=2):
    leaf = lambda r, more: digest(
        *map(field, (r[0], r[3], r[2], None if r[1] is None else len(r[1]) + more, r[1]))
    )
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {}
    for lang in langs:
        mine = [r for r in rows if r[2] == lang]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, 0)))
        groups[lang] = mine, *climb([leaf(r, 0) for r in mine], fanout)
    root, over = climb([groups[x][1] for x in langs], fanout)
    out = []
    for lang, top in zip(langs, over):
        mine, subroot, paths = groups[lang]
        for row, path in zip(mine, paths):
            path = path + top
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            done = leaf(row, int(bad))
            for left, right in path:
                done = digest(left, done, right)
            proof = digest(*[side for step in path for side in step])
            out.append((row[0], leaf(row, 0), subroot, root, proof, done, done == root))
    return Counter(out)


def found(docs, **settings):
    listed = merkle.verified(merkle.manifest(docs, **settings)).collect()
    return Counter(map(tuple, listed))


@pytest.mark.parametrize("fanout, levels", [(2, 6), (2, 2), (3, 1)])
def test_manifest(make_docs, messy, fanout, levels):
    rows = messy + [(100 + i, prose(i % 5, i % 9), ("en", "de", None)[i % 3], "a") for i in range(90)]
    rows += [(None, prose(i, 4), "en", None) for i in range(4)]
    got = found(make_docs(rows), fanout=fanout, levels=levels)
    assert got == expected(rows, fanout)
    assert any(row[-1] for row in got) and not all(row[-1] for row in got)


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 9])
def test_small_trees(make_docs, count):
    rows = [(i, prose(i, 5), "en", None) for i in range(count)]
    assert found(make_docs(rows), levels=2) == expected(rows)


def test_a_changed_field_changes_the_root(make_docs):
    rows = [(i, prose(i, 5), "en", "a") for i in range(20)]
    roots = set()
    for other in (rows[0], (0, "", "en", "a"), (0, None, "en", "a"), (0, prose(0, 5), "en", None)):
        roots |= {r.root for r in merkle.manifest(make_docs([other, *rows[1:]])).collect()}
    assert len(roots) == 4


def test_empty(make_docs):
    assert merkle.verified(merkle.manifest(make_docs([]))).count() == 0
