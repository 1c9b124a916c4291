"""Quality rules, pieces, languages and licenses."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridloom.llm import langid, licenses, pieces, quality, queries

MODEL = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def brute_counts(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(found, found[1:], found[2:]))
    hit = {
        j
        for i in range(len(found) - 2)
        if windows[tuple(found[i : i + 3])] > 1
        for j in range(i, i + 3)
    }
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(found),
        sum(map(len, found)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(hit),
    )


def test_quality_counts_and_verdicts(make_docs, messy):
    rows = messy + [(99, "same line\nsame line\n \nother\nsame line", "en", "a")]
    got = quality.judged(make_docs(rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    have = sorted(
        [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=key
    )
    assert have == sorted([(r[0], *brute_counts(r[1])) for r in rows], key=key)
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality.judged(make_docs([])).count() == 0


def test_sketch_quantiles(spark):
    draw = random.Random(3)
    values = [draw.lognormvariate(0, 1) for _ in range(4000)] + [0.0] * 10
    rows = [("en", f"s{i % 3}", v, v, v, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{m} double" for m in quality.MEASURES))
    merged = quality.quartiles(quality.sketches(df), ["lang"]).where("measure = 'symbol_share'").first()
    for name, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
        exact = float(np.quantile(values, q, method="inverted_cdf"))
        assert merged[name] == pytest.approx(exact, rel=1.01 * quality.ACCURACY)
    assert merged.documents == len(values)


def brute_verdicts(rows):
    """Measures, shrunk sketches, fences and verdicts, one document after the other."""
    ratio, names = quality.RATIO, list(quality.MEASURES)
    bin_of = lambda v: quality.ZERO_BIN if v <= 0 else math.ceil(math.log(v) / math.log(ratio))
    value_of = lambda b: 0.0 if b == quality.ZERO_BIN else ratio**b * 2 / (1 + ratio)
    measured, bins = [], {}
    for doc_id, text, lang, source in rows:
        n, chars, symbols, dup, repeat = brute_counts(text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
        values = [v / d if d else None for v, d in ((chars, n), (symbols, n), (dup, lines), (repeat, n))]
        measured.append((doc_id, (lang, source), n < 50 or 100 * repeat > 50 * n, dict(zip(names, values))))
        for name, v in zip(names, values):
            for key in ((), (lang,), (lang, source)):
                if v is not None:
                    bins.setdefault((name, key), Counter())[bin_of(v)] += 1

    def dealt(name, key):
        own = bins[name, key]
        if not key:
            return own
        wide = dealt(name, key[:-1])
        total = sum(wide.values())
        return {b: own.get(b, 0) + quality.PRIOR * wide.get(b, 0) / total for b in {*own, *wide}}

    def rank(sketch, q):
        upto, goal = 0, sum(sketch.values()) * q * (1 - 1e-9)
        for b in sorted(sketch):
            upto += sketch[b]
            if upto >= goal:
                return value_of(b)

    fences = {}
    for name, key in bins:
        if len(key) == 2:
            q1, q2, q3 = (rank(dealt(name, key), q) for q in (0.25, 0.5, 0.75))
            fixed, part = quality.LEAST_SPREAD[name]
            reach = quality.REACH * max(q3 - q1, fixed + part * q2)
            fences[name, key] = (q1 - reach if name in quality.LOWER else -math.inf, q3 + reach)
    verdict = {}
    for doc_id, key, failed, values in measured:
        inside = all(v is None or fences[m, key][0] <= v <= fences[m, key][1] for m, v in values.items())
        verdict[doc_id] = not failed and inside
    return verdict, fences


def test_verdicts_against_brute_force(make_docs):
    draw = random.Random(11)
    rows = []
    for i in range(260):
        # one language has long words, one source has few documents, some texts are odd
        lang = draw.choice(["aa", "aa", "bb", None])
        source = draw.choice(["s", "s", "s", "t", None]) if i % 40 else "rare"
        low, high = {"aa": (2, 5), "bb": (6, 14), None: (1, 9)}[lang]
        kind = draw.choice(["plain"] * 12 + ["short words", "long words", "symbols", "lines", "again"])
        low, high = {"short words": (1, 1), "long words": (40, 60)}.get(kind, (low, high))
        found = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(low, high))) for _ in range(draw.randint(40, 160))]
        if kind == "symbols":
            found = [w if draw.random() < 0.5 else "#" for w in found]
        if kind == "again":
            found += found[: draw.randint(3, 40)]
        lines = ["x y"] * draw.randint(2, 30) if kind == "lines" else []
        rows.append((i, "\n".join([" ".join(found), *lines]), lang, source))
    want, fences = brute_verdicts(rows)
    got = quality.judged(make_docs(rows)).collect()
    assert {r.doc_id: r.kept for r in got} == want and 0 < sum(want.values()) < len(rows)
    for r in got:
        low, high = fences["word_length", (r.lang, r.source)]
        assert (r.least_word_length, r.most_word_length) == (pytest.approx(low), pytest.approx(high))
    assert fences["word_length", ("aa", "s")][1] < fences["word_length", ("bb", "s")][1]
    assert any(r.word_length and r.word_length < r.least_word_length and not r.kept for r in got)


def test_fences_drop_junk_and_keep_prose(make_docs):
    from .conftest import prose

    clean = [(i, prose(i, 120), "en", "a") for i in range(60)]
    junk = [(100 + i, prose(i, 120).replace(" ", " ### "), "en", "a") for i in range(5)]
    kept = {r.doc_id for r in quality.judged(make_docs(clean + junk)).where("kept").collect()}
    assert kept == set(range(60))


def samples():
    draw = random.Random(5)
    letters = " ▁\n\tabcdeé日𝔘thing  "
    texts = ["", " ", "  ", "a  b", " a ", "▁x ▁", "<s> </s> <0x0A>", "日本 \x00 é", "\t\tx\n\n y", " " * 40 + "z", "ab" * 300]
    return texts + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(500)]


def test_pieces_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    model = pieces.Model.read(MODEL)
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    for text in samples():
        ids, begins, ends = encoder.encode(text)
        assert ids.tolist() == library.encode(text)
        assert decoder.decode(ids) == library.decode(ids.tolist())
        data, at = text.encode(), 0
        for begin, end in zip(begins.tolist(), ends.tolist()):
            assert begin in (at, min(at, begin)) and end >= begin
            at = max(at, end)
        assert at == len(data)


def test_many_parts_are_remembered():
    """Parts of a task's texts stay in memory beyond 200,000; cuts and codes are those of the slow way."""
    memory = pieces._Memory(len)
    for n in range(300_000):
        memory[str(n)]
    assert len(memory) == 300_000
    model = pieces.Model.read(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))
    encoder, draw = pieces.Encoder(model), random.Random(4)
    for _ in range(3000):
        part = "".join(draw.choices("\u2581the.e\u00e9\u6f22\n\tan,1", k=draw.randint(1, 47)))
        places = [0, *[i for i in range(1, len(part)) if part[i - 1 : i + 1] not in encoder.pairs], len(part)]
        assert encoder.cut(part) == [part[a:b] for a, b in zip(places, places[1:])]
        fast = encoder._fast_codes(part)
        if fast is not None:
            assert [c >> pieces.WIDTH_BITS for c in fast] == [encoder.ids[s] for s in encoder.merge(part)]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_map_equals_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    normalizer = pieces.Normalizer(pieces.Model.read(library.serialized_model_proto()))
    draw = random.Random(6)
    for _ in range(500):
        text = "".join(draw.choice("ﬁ²Ａé́ ①㌔  　\tabcß½Ⅷガ") for _ in range(draw.randint(0, 20)))
        out, begins, ends = normalizer(text)
        assert out == library.normalize(text)
        size = len(text.encode())
        assert all(0 <= b <= e <= size for b, e in zip(begins, ends))
        assert begins == sorted(begins)


def test_encode_documents(make_docs, messy):
    docs = make_docs(messy)
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    encoded = pieces.encode_documents(docs, MODEL)
    got = queries.piece_digests(pieces.decode_documents(encoded, MODEL)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for id_, text, _, _ in messy:
        ids = library.encode(text or "")
        want[id_, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter(map(tuple, got)) == want
    assert pieces.encode_documents(make_docs([]), MODEL).count() == 0


def test_automaton_accepts_exactly_the_substrings():
    draw = random.Random(0)
    given = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 9))) for _ in range(40)]
    move = langid.automaton(given)
    inside = {w[i:j] for w in given for i in range(len(w)) for j in range(i + 1, len(w) + 1)}

    def accepts(word):
        state = 0
        for letter in word:
            state = move[state].get(letter)
            if state is None:
                return False
        return True

    for word in inside:
        assert accepts(word)
        for letter in "abcd":
            assert accepts(word + letter) == (word + letter in inside)

    def brute(word):
        count = at = 0
        while at < len(word):
            end = at + 1
            while end < len(word) and word[at : end + 1] in inside:
                end += 1
            at, count = end, count + 1
        return count

    for _ in range(300):
        word = "".join(draw.choice("abcd") for _ in range(draw.randint(0, 15)))
        assert langid.phrases(move, word) == brute(word)


def test_languages(make_docs, messy):
    rows = [(100 + i, "the house and the garden of the king " * 3, "en", "a") for i in range(20)]
    rows += [(200 + i, "la maison et le jardin du roi est belle " * 3, "fr", "a") for i in range(20)]
    docs = make_docs(rows + messy)
    got = langid.identify(docs, langid.learned(docs)).collect()
    assert len(got) == len(rows) + len(messy)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[r[0]].lang_pred == r[2] for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    for id_ in (4, 5, 6, 9, 14):
        assert (by_id[id_].lang_pred, by_id[id_].score) == ("und", 0.0)
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + len(messy) - 5
    unlabelled = make_docs([(1, "abc", None, "a")])
    assert langid.identify(unlabelled, langid.learned(unlabelled)).first().lang_pred == "und"
    assert langid.accepted(make_docs([])).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.QUERIES["op6_identify_language"](spark, "/root/testdata/sf0.01")
    held = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_licenses(make_docs, messy):
    rows = messy + [
        (50, "GNU Lesser General Public License v2.1 or later", "en", "a"),
        (51, "cc by 4.0, CC-BY-SA 3.0 cc by cc by", "en", "a"),
        (52, "gnu general public license", "en", "a"),
        (53, "cc byte mit licenses", "en", "a"),
    ]
    got = {r.doc_id: r for r in licenses.scan_documents(make_docs(rows)).collect()}
    assert (got[10].base_labels, got[10].labels, got[10].n_base, got[10].first_word) == ("mit", "mit", 1, 3)
    assert got[50].base_labels == "" and got[50].labels == "lgpl-2.1"
    assert (got[51].n_base, got[51].first_word, got[51].last_word) == (4, 0, 11)
    assert got[51].labels == "cc-by,cc-by-4.0,cc-by-sa-3.0"
    assert got[52].labels == "gpl"
    assert got[53].n_base == 0 and got[53].labels == ""
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].labels, got[4].score) == (0, 0, None, "", 0.0)
    assert licenses.scan_documents(make_docs([])).count() == 0


def test_rules_are_many_and_ordered():
    rules = licenses.rules()
    assert len(rules) > 300
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


def brute_labels(text):
    """Labels and score by all rules, without gates, and containment by comparing all detections."""
    normal = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))) + " "
    hits = []
    for rule in RULES:
        for m in rule.pattern.finditer(normal.encode()):
            hits.append((-rule.priority, -len(m.group()), m.start(), rule.label, m.end(), rule.confidence))
    accepted = []
    for hit in sorted(hits):
        if not any(a[2] <= hit[2] and hit[4] <= a[4] for a in accepted):
            accepted.append(hit)
    base = {label for phrase, label in licenses.BASE if f" {phrase} " in normal}
    score = max([a[5] for a in accepted] + [0.6 if base else 0.0])
    return ",".join(sorted(base | {a[3] for a in accepted})), score


LOWER = {c: c + 32 for c in range(65, 91)}
RULES = licenses.rules()


def test_license_labels_against_brute_force():
    draw = random.Random(17)
    parts = [re.sub(r"\(\?:([^|()]*)[^()]*\)\??", r"\1", re.sub(r"\.\{.*?\}\?", "someone", s[1])) for s in licenses.SIGNATURES]
    names = [n for names, _, _ in licenses.FAMILIES for n in re.split(r"\|(?![^()]*\))", names)]
    parts += [re.sub(r"[(][?]:([^|()]*)[^()]*[)][?]?|[?]", r"\1", n) for n in names]
    parts += ["under the terms of the", "version", "2.0", "v3", "or later", "license", "Licensed under", "plate", "the", "clause"]
    scanner = licenses.Scanner()
    some = 0
    for _ in range(150):
        text = " ".join(draw.choice(parts) if draw.random() < 0.7 else draw.choice(["a", "word", "é"]) for _ in range(draw.randint(1, 14)))
        text = text.title() if draw.random() < 0.3 else text
        got = scanner.scan(text.encode())
        assert got[5:] == brute_labels(text), text
        some += bool(got[5])
    assert some > 90


def test_short_names_need_context():
    scan = licenses.Scanner().scan
    for text in ("The AFL final was played", "plays in the EPL", "MPL flow rate", "python license plate", "provided by the OSL", "a PHP license fee", "gpl"):
        assert scan(text.encode())[5:] == ("", 0.0), text
    for text, label in (
        ("released under the EPL", "epl"), ("license: GPL", "gpl"), ("the MPL license", "mpl"), ("GPLv3", "gpl-3"),
        ("licensed under MPL 2.0", "mpl-2.0"), ("the terms of the python license", "python"), ("uses LGPL code", "lgpl"),
        ("The Software shall be used for Good, not Evil.", "json"), ("plays under the AFL license", "afl"),
    ):
        assert scan(text.encode())[5] == label, text


def test_signatures_hold_their_keywords():
    for keyword, pattern, *_ in licenses.SIGNATURES:
        assert keyword in pattern
    assert len({pattern for _, pattern, *_ in licenses.SIGNATURES}) == len(licenses.SIGNATURES) > 50
