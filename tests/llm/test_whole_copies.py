"""Copies, passages and mixtures as a whole."""

from collections import Counter

import pytest

from gridloom.llm import mixing, suffix

from .conftest import prose


def test_anchors_once_for_all_copies(make_docs, monkeypatch):
    """Of 50 copies that share an anchor with another text only one is given to the anchors."""
    shared, rows = prose(1, 200), []
    rows = [(i, shared + " tail", "en", "a") for i in range(50)] + [(99, "head " + shared, "en", "a")]
    seen, settled = [], suffix.settle

    def counting(df, **options):
        back = settled(df, **options)
        if df.columns == ["t1", "t2", "anchor", "first", "last"]:
            seen.append(back.groupBy("t1", "t2", "anchor", "first").count().agg({"count": "max"}).first()[0])
        return back

    monkeypatch.setattr(suffix, "settle", counting)
    spans = suffix.repeated_spans(suffix.keyed(make_docs(rows))).collect()
    assert seen == [1] and len(spans) == 2


@pytest.mark.parametrize("long", [5000, 5001])
def test_mixture_meets_targets_to_the_word(make_docs, long):
    rows = [(1, " \t" + prose(1, long).replace(" ", "\n "), "en", "a")]
    rows += [(10 + i, prose(i, 100), "en", "ab"[i % 2]) for i in range(40)]
    docs = make_docs(rows)
    spans = mixing.mix(docs)[1].groupBy("src").agg({"tokens": "sum"}).collect()
    out, taken = mixing.mixed_documents(docs).collect(), Counter()
    for row in out:
        taken["a" + row.source] += len(row.text.split())
        assert row.n_chars == len(row.text)
        assert next(r[1] for r in rows if r[0] == row.doc_id).startswith(row.text)
    assert taken == Counter({r[0]: r[1] for r in spans})


def test_passages_of_over_50_words(spark, make_docs):
    import corpus_pipeline

    passage, short, letters = prose(50, 51), prose(51, 50), "x" * 450
    assert len(passage) < 400
    text = lambda i: prose(100 + i, 60)
    rows = [(i, f"{text(i)} {passage} {text(10 + i)}", "en", "a") for i in range(2)]
    rows += [(i, f"{text(i)} {short} {text(10 + i)}", "en", "a") for i in range(2, 4)]
    rows += [(i, f"{text(i)} {letters}{text(10 + i)}", "en", "a") for i in range(4, 6)]
    rows += [(6, None, "en", "a"), (7, "", "en", "a")]
    docs = make_docs(rows)
    out = corpus_pipeline.repeated_passages(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    for i in range(2):
        assert got[i].split() == f"{text(i)} {text(10 + i)}".split()
    assert all(got[i] == rows[i][1] for i in (2, 3, 6, 7))
    # the spaces beside a string of 400 bytes are part of it
    assert all(got[i] == f"{text(i)}{text(10 + i)}" for i in (4, 5))
