"""Operators at full extent: nothing below a cut-off is left out."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import katz, licenses

from .conftest import prose


def katz_scores(rows):
    """Scores with every training pair in the model, those seen once included."""
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    one, two, before = Counter(), Counter(), Counter()
    for i, text in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            found = [b"", *tokens(text)]
            one.update(found[1:]), two.update(zip(found, found[1:])), before.update(found[:-1])
    histogram = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
    singles = katz.Singles(sum(one.values()), len(one), histogram(one))
    ratio = katz.discounts(histogram(two))
    single = lambda w: float(singles.probability(np.array([one[w]]))[0])
    kept = lambda c: (ratio[c] if c <= 5 else 1) * c
    mass, lower = Counter(), Counter()
    for (a, b), c in two.items():
        mass[a] += kept(c)
        lower[a] += single(b)
    whole = {a: before[a] + (before[a] - mass[a] < 1e-9) for a in mass}

    def pair(a, b):
        if two[a, b]:
            return kept(two[a, b]) / whole[a]
        return ((1 - mass[a] / whole[a]) / (1 - lower[a]) if a in mass else 1) * single(b)

    return Counter(
        (i, round(sum(math.log10(pair(a, b)) for a, b in zip([b"", *tokens(t)], tokens(t))), 6))
        for i, t in rows
    )


def test_katz_keeps_pairs_seen_once(make_docs, messy):
    rows = [r for r in messy if r[0] != 7] + [(300 + i, prose(i % 7, 60 + i), "en", "a") for i in range(30)]
    got = katz.score_documents(make_docs(rows), least_pair=1)[0].collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == katz_scores([r[:2] for r in rows])
    table = katz.score_documents(make_docs(rows), least_pair=1)[1].collect()
    counts = np.concatenate([katz.unpack(r.data)[2] for r in table])
    assert (counts == 1).any()


def spelled(pattern):
    """All texts of a name's pattern."""
    group = re.search(r"\(\?:([^()]*)\)(\?)?|\[([a-z]+)\]|(.)\?", pattern)
    if not group:
        return {} if "[" in pattern else {pattern}
    inner, optional, letters, single = group.groups()
    if inner is not None:
        options = inner.split("|") + [""] * bool(optional)
    else:
        options = list(letters) if letters else [single, ""]
    before, after = pattern[: group.start()], pattern[group.end() :]
    return {text for option in options for text in spelled(before + option + after)}


def test_every_license_name_is_found_alone():
    scanner, checked = licenses.Scanner(), 0
    for names, versions, label in licenses.FAMILIES:
        for name in re.split(r"\|(?![^()]*\))", names):
            for text in spelled(name.replace("[0-9]", "3")):
                for around in ("{}", "released under the {}"):
                    found = scanner.scan(around.format(text).encode())
                    assert any(x.split("-")[0] == label.split("-")[0] for x in found[5].split(",")), text
                    assert found[6] >= 0.6
                for version in versions:
                    for form in (" {}", " v{}", " version {}", "v{}", "{}"):
                        found = scanner.scan((text + form.format(version)).encode())
                        assert label.split("-")[0] in found[5], (text, form, version)
                        checked += 1
    assert checked > 500


@pytest.mark.parametrize(
    "text, label",
    [
        ("Released under the MPL 2.0", "mpl-2.0"),
        ("licensed under the Expat License", "mit"),
        ("GPLv3", "gpl-3"),
        ("LGPLv2.1 or later", "lgpl-2.1"),
        ("BSD 3-Clause License", "bsd-3-clause"),
        ("the 2-clause BSD license", "bsd-2-clause"),
        ("Apache 2.0 License", "apache-2.0"),
        ("an example, simply closely apart", ""),
    ],
)
def test_license_forms(text, label):
    assert licenses.Scanner().scan(text.encode())[5] == label
