"""License detection by ordered signature rules.

Rules are regular expressions over a text's normalised words.  They are written by families: each
family's names and versions meet the phrasings of a notice, a grant, a link and an identifier, and
signatures are sentences of licence texts and notices.  A rule runs only where its keyword occurs.
A name of three letters means other things too, so it counts only with a version, beside the word
"license" or after "under"; a name before a word as "plate" or "fee" is no licence.  Detections
are ordered by priority, then length, then place; one whose words all lie inside an accepted
detection is suppressed, so "gnu lesser general public license" does not also report a shorter name.

Base phrases are reported at all their places and never suppressed.

Defined results: a null or empty text has no words and no labels; score is the confidence of the
strongest detection, 0 without any; repeated rows get equal results; an empty table gives no rows; a
text of any length is read whole, by one task.  Only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import map_batches, utf8

#: Octets of words: letters and digits of ASCII, upper case folded, and everything beyond ASCII.
WORD_OCTETS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)

#: Phrases whose places are counted, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: family: (names, versions, label).  Words are separated by one space, as in a text; each name is
#: gated by a word of its own.
FAMILIES = (
    ("gnu general public license|gnu gpl|gpl", ("1", "2", "3"), "gpl"),
    ("gnu (?:lesser|library) general public license|gnu lgpl|lgpl", ("2", "2 1", "3"), "lgpl"),
    ("gnu affero general public license|affero general public license|gnu agpl|agpl", ("1", "3"), "agpl"),
    ("gnu free documentation license|gnu fdl|gfdl", ("1 1", "1 2", "1 3"), "gfdl"),
    ("apache (?:software )?license", ("1 0", "1 1", "2 0", "2"), "apache"),
    ("mit license|mit x11 license|expat license", (), "mit"),
    ("(?:new |modified |simplified |original )?bsd (?:style )?license", ("2 clause", "3 clause", "4 clause"), "bsd"),
    ("mozilla public license|mpl", ("1 0", "1 1", "2 0"), "mpl"),
    ("eclipse public license|epl", ("1 0", "2 0"), "epl"),
    ("cddl", ("1 0", "1 1"), "cddl"),
    ("common development and distribution license", ("1 0", "1 1"), "cddl"),
    ("common public license", ("0 5", "1 0"), "cpl"),
    ("(?:perl )?artistic license", ("1 0", "2 0"), "artistic"),
    ("zlib(?: libpng)? license", (), "zlib"),
    ("boost software license", ("1 0",), "boost"),
    ("isc license|internet systems consortium license", (), "isc"),
    ("unlicense", (), "unlicense"),
    ("wtfpl", ("1", "2"), "wtfpl"),
    ("python software foundation license|python license", ("2",), "python"),
    ("php license", ("3 0", "3 01"), "php"),
    ("microsoft (?:public|reciprocal) license", (), "microsoft"),
    ("european union public licen[cs]e|eupl", ("1 0", "1 1", "1 2"), "eupl"),
    ("open software license|osl", ("1 0", "2 0", "2 1", "3 0"), "osl"),
    ("academic free license|afl", ("1 1", "2 1", "3 0"), "afl"),
    ("open database license|odbl", ("1 0",), "odbl"),
    ("sil open font license", ("1 0", "1 1"), "ofl"),
    ("cecill(?: [abc])?(?: license)?", ("1 0", "2 0", "2 1"), "cecill"),
    ("creative commons attribution(?: [0-9] [0-9])?(?: international| unported| generic)?", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by"),
    ("creative commons attribution share ?alike", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-sa"),
    ("creative commons attribution non ?commercial", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-nc"),
    ("creative commons attribution non ?commercial share ?alike", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-nc-sa"),
    ("creative commons attribution no ?deriv(?:ative)?s?", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-nd"),
    ("creative commons zero|creative commons public domain dedication", ("1 0",), "cc0"),
    ("cc by", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by"),
    ("cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-sa"),
    ("cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-nc"),
    ("cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-nc-sa"),
    ("cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-nc-nd"),
    ("cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-nd"),
    ("cc0", ("1 0",), "cc0"),
)
#: A version after a name, with the words that may stand between.
#: or fused to it ("gplv3").
VERSION = "(?:(?: license)?(?: version| ver)? (?:v ?)?|v?){}(?: (?:only|or (?:any |at your option any )?later(?: version)?|plus))?"
#: A version inside a name ("bsd 3 clause license"), or numbers of clauses before it.
INNER = "{}(?: version| ver)?(?: (?:v ?)?|v?){} license"
#: Words too common to gate a name, if it has another.
COMMON_WORDS = {"license", "public", "general", "software", "free", "open"}
#: phrasing: (pattern around the family's name, priority, confidence)
PHRASINGS = {
    "grant": ("(?:licen[cs]ed|released|distributed|available|published|covered|provided) (?:under|by) (?:the )?(?:terms of )?(?:the |an? )?{}", 3, 0.9),
    "terms": ("(?:subject to|under) the terms (?:and conditions )?of (?:the |an? )?{}", 3, 0.9),
    "name": ("(?:the )?{}", 1, 0.6),
}
#: The phrasings of a name of three letters.
SHORT_PHRASINGS = {
    "grant": ("(?:licen[cs]ed|released|distributed|available|published|covered|provided) under (?:the )?(?:terms of )?(?:the |an? )?{}", 3, 0.9),
    "terms": PHRASINGS["terms"],
    "beside": ("(?:{0} licen[cs](?:ed?|es|ing)|licen[cs]e[ds]?(?: is| type| name| under| the){{0,2}} {0})", 1, 0.6),
}
#: Words after a name that make it something else.
OTHERWISE = "(?! (?:plates?|fees?|keys?|servers?|holders?|numbers?|exams?|tests?|office|revoked|suspended|expired|renewal) )"
#: Signatures of whole texts and notices: (keyword, pattern, label, priority, confidence).
SIGNATURES = (
    ("redistribution", "redistribution and use in source and binary forms with or without modification are permitted", "bsd", 4, 1.0),
    ("endorse", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse", "bsd", 4, 0.95),
    ("permission", "permission is hereby granted free of charge to any person obtaining a copy", "mit", 4, 1.0),
    ("permission", "permission to use copy modify and or distribute this software for any purpose", "isc", 4, 1.0),
    ("altered", "altered source versions must be plainly marked as such", "zlib", 4, 0.95),
    ("redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 4, 1.0),
    ("redistribute", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "lgpl", 4, 1.0),
    ("redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl", 4, 1.0),
    ("apache", "www apache org licenses license 2 0", "apache", 4, 1.0),
    ("opensource", "opensource org licenses mit", "mit", 4, 0.95),
    ("opensource", "opensource org licenses bsd", "bsd", 4, 0.95),
    ("gnu", "www gnu org licenses", "gnu", 2, 0.5),
    ("creativecommons", "creativecommons org licenses by(?: [0-9] [0-9])?", "cc-by", 4, 0.95),
    ("creativecommons", "creativecommons org publicdomain zero", "cc0", 4, 0.95),
    ("unencumbered", "this is free and unencumbered software released into the public domain", "unlicense", 4, 1.0),
    ("public domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", "public-domain", 3, 0.8),
    ("all rights reserved", "all rights reserved", "proprietary", 1, 0.3),
    ("proprietary", "proprietary and confidential", "proprietary", 2, 0.6),
    ("substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", 4, 1.0),
    ("except as contained", "except as contained in this notice the name of .{1,80}? shall not be used in advertising", "x11", 4, 0.95),
    ("advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "bsd-4-clause", 4, 1.0),
    ("berkeley", "this product includes software developed by the university of california berkeley", "bsd", 4, 0.9),
    ("contributor license agreements", "licensed to the apache software foundation asf under one or more contributor license agreements", "apache", 4, 1.0),
    ("apache", "this product includes software developed (?:by|at) the apache software foundation", "apache", 4, 0.9),
    ("applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0", 4, 0.95),
    ("source code form", "this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", 5, 1.0),
    ("the contents of this file", "the contents of this file are subject to the mozilla public license", "mpl", 4, 1.0),
    ("the contents of this file", "the contents of this file are subject to the terms of the common development and distribution license", "cddl", 4, 1.0),
    ("accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license", "epl", 4, 1.0),
    ("verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "gnu", 3, 0.8),
    ("remotely through a computer network", "prominently offer all users interacting with it remotely through a computer network", "agpl", 4, 1.0),
    ("modify this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl", 4, 1.0),
    ("misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "zlib", 4, 1.0),
    ("accompanying documentation", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost", 4, 1.0),
    ("font software", "this font software is licensed under the sil open font license", "ofl", 4, 1.0),
    ("fonts and derivatives", "the fonts and derivatives however can be embedded bundled redistributed and or sold", "ofl", 4, 1.0),
    ("package may be copied", "the intent of this document is to state the conditions under which a package may be copied", "artistic", 4, 1.0),
    ("psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world ?wide license", "python", 4, 1.0),
    ("called php", "products derived from this software may not be called php", "php", 4, 1.0),
    ("neighboring rights", "(?:dedicated|waived) all copyright and related (?:and|or) neighboring rights", "cc0", 4, 0.95),
    ("sell or distribute", "anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 4, 1.0),
    ("whatever you want with this stuff", "as long as you retain this notice you can do whatever you want with this stuff", "beerware", 4, 1.0),
    ("good not evil", "the software shall be used for good not evil", "json", 4, 1.0),
    ("openssl", "this product includes software developed by the openssl project", "openssl", 4, 1.0),
    ("freetype", "portions of this software are copyright .{0,40}?the freetype project", "freetype", 4, 1.0),
    ("independent jpeg group", "this software is based in part on the work of the independent jpeg group", "ijg", 4, 1.0),
    ("hereby granted without fee", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", "hpnd", 4, 1.0),
    ("without a written agreement", "distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "postgresql", 4, 1.0),
    ("public domain", "has been placed in the public domain", "public-domain", 3, 0.8),
    ("grants to you a perpetual", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide", "apache-2.0", 4, 0.95),
    ("each contributor", "each contributor hereby grants recipient a non exclusive worldwide royalty free copyright license", "epl", 4, 0.9),
    ("do what the fuck", "do what the fuck you want to public license", "wtfpl", 4, 1.0),
)


class Rule(NamedTuple):
    keyword: bytes
    pattern: re.Pattern
    label: str
    priority: int
    confidence: float


class Detection(NamedTuple):
    priority: int
    length: int
    start: int
    end: int
    label: str
    confidence: float


def keyword_of(name: str) -> str:
    """The begin of a word that every form of a name's pattern holds, the longest of uncommon ones."""
    fixed = re.sub(r"\S*[?\[]\S*", " ", re.sub(r"\(\?:[^()]*\)\??", " ", name)).split()
    word = max([w for w in fixed if w not in COMMON_WORDS] or fixed, key=len)
    return f" {word}"


def by_keyword(names: str) -> dict[str, list[str]]:
    """The alternatives of ``names`` (split outside of groups) by keyword."""
    out: dict[str, list[str]] = {}
    for name in re.split(r"\|(?![^()]*\))", names):
        out.setdefault(keyword_of(name), []).append(name)
    return out


def versioned(name: str, version: str) -> str:
    """A name with a version after it, inside it, or, for clauses, before it."""
    forms = [name + VERSION.format(version)]
    head = re.sub(r"(?: |\(\?:\w+ \)\?)*license$", "", name)
    if head != name:
        forms.append(INNER.format(head, version))
        if "clause" in version:
            forms += [f"{head} {version}", f"{version} {name}"]
    return "|".join(forms)


def rules() -> list[Rule]:
    """All rules, highest priority first."""
    out = []

    def add(keyword, pattern, label, priority, confidence):
        compiled = re.compile(f"(?<= )(?:{pattern})(?= )".encode())
        out.append(Rule(keyword.encode(), compiled, label, priority, confidence))

    for keyword, pattern, label, priority, confidence in SIGNATURES:
        add(keyword, pattern, label, priority, confidence)
    for names, versions, label in FAMILIES:
        for keyword, alike in by_keyword(names).items():
            short = all(re.fullmatch("[a-z]{3}", name) for name in alike)
            for kind, (around, priority, confidence) in (SHORT_PHRASINGS if short else PHRASINGS).items():
                # a version is context enough for a short name
                for version in versions:
                    with_version = "|".join(versioned(name, version) for name in alike)
                    name = f"{label}-{version.replace(' ', '-' if 'clause' in version else '.')}"
                    dated = PHRASINGS["name"][0] if kind == "beside" else around
                    add(keyword, dated.format(f"(?:{with_version})"), name, priority + 1, min(1.0, confidence + 0.1))
                bare = around.format(f"(?:{'|'.join(alike)})")
                add(keyword, f"(?:{bare}){OTHERWISE}", label, priority, confidence)
        for version in ("", *versions):
            exact = label.replace("-", " ") + (f" {version}" if version else "")
            dotted = version.replace(" ", "-" if "clause" in version else ".")
            name = f"{label}-{dotted}" if version else label
            add("spdx", f"spdx license identifier {exact}(?: only| or later)?", name, 5, 1.0)
    return sorted(out, key=lambda r: -r.priority)


class Scanner:
    def __init__(self) -> None:
        self.by_keyword: dict[bytes, list[Rule]] = {}
        for rule in rules():
            self.by_keyword.setdefault(rule.keyword, []).append(rule)
        # one pass finds whether any keyword occurs at all
        words = sorted(self.by_keyword, key=len, reverse=True)
        self.any_keyword = re.compile(b"|".join(map(re.escape, words)))
        self.base = [(p.encode(), re.compile(f"(?= {p} )".encode()), label) for p, label in BASE]

    def detections(self, normal: bytes) -> list[Detection]:
        """Accepted detections in normalised words, which a space begins and ends."""
        found = []
        for keyword in self.by_keyword:
            if keyword not in normal:
                continue
            for rule in self.by_keyword[keyword]:
                for hit in rule.pattern.finditer(normal):
                    start, end = hit.span()
                    found.append(
                        Detection(rule.priority, end - start, start, end, rule.label, rule.confidence)
                    )
        # A detection lies inside an accepted one if, of those that begin no later, the one that
        # reaches furthest ends no earlier.
        found.sort(key=lambda d: (-d.priority, -d.length, d.start, d.label))
        starts: list[int] = []
        reach: list[int] = []
        accepted: list[Detection] = []
        for one in found:
            at = bisect_right(starts, one.start)
            if at and reach[at - 1] >= one.end:
                continue
            accepted.append(one)
            starts.insert(at, one.start)
            reach.insert(at, max(one.end, reach[at - 1] if at else 0))
            for i in range(at + 1, len(reach)):
                if reach[i] >= one.end:
                    break
                reach[i] = one.end
        return accepted

    def scan(self, text: bytes) -> tuple:
        words = text.translate(WORD_OCTETS).split()
        if not words:
            return 0, 0, None, None, "", "", 0.0
        normal = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, pattern, label in self.base:
            if phrase in normal:
                starts = [m.start() for m in pattern.finditer(normal)]
                if starts:
                    places.extend(starts)
                    base.add(label)
        first = normal.count(b" ", 0, min(places)) if places else None
        last = normal.count(b" ", 0, max(places)) if places else None
        labels, score = set(base), 0.6 if base else 0.0
        if self.any_keyword.search(normal):
            for one in self.detections(normal):
                labels.add(one.label)
                score = max(score, one.confidence)
        joined = lambda names: ",".join(sorted(names))
        return len(words), len(places), first, last, joined(base), joined(labels), score


COLUMNS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double"
)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Words, base places, labels and score of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ready: list[Scanner] = []
    kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
    names = ["doc_id"] + [c.split()[0] for c in COLUMNS.split(", ")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not ready:
            ready.append(Scanner())
        rows = [ready[0].scan(t) for t in utf8(batch.column("text"))]
        columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return map_batches(
        docs.select("doc_id", F.col("text").cast("string")), work, f"doc_id {kind}, {COLUMNS}"
    )
