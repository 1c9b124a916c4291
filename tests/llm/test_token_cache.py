"""Token counts against the libraries, and what the cache holds."""

from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from gridloom.llm import token_cache

from .conftest import prose

ODD = [
    "<|startoftext|>a<|endoftext|>",
    "<|STARTOFTEXT|> <|endoftext|",
    "T̈ ẗ É É ẞ Σας ΟΔΟΣ",
    "a\x0bb\x0cc\x1cd\x85e f　g \xa0h",
    "don't DON'T it'S we'll 12345 1 2 3",
    " ̈x  \t\n ẍ",
    "x" * 5000,
    "日本語 テキスト 🙂🙂",
    "A  b\n\nC",
    "a b c",
    " a B c ",
]


def whole_count(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    model = tokenizers.Tokenizer.from_file(path)
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(make_docs, messy, tmp_path, name):
    rows = messy + [(50 + i, t, "en", "a") for i, t in enumerate(ODD)]
    tokenizer = token_cache.Tokenizer(public_tokenizers.path(name))
    assert tokenizer.by_word == name.startswith("word")
    count = whole_count(name)
    want = Counter()
    for i, text, _, _ in rows:
        n = count(text or "")
        want[i, len((text or "").encode()), n, n > 100] += 1
    for _ in range(2):  # the second time every count is stored
        got = token_cache.count_tokens(make_docs(rows), tokenizer, str(tmp_path / "cache"), 100)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert Counter(map(tuple, got.collect())) == want


def test_cache_holds_each_text_once_and_by_version(spark, make_docs, tmp_path):
    cache = str(tmp_path / "cache")
    words = token_cache.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    octets = token_cache.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    held = lambda t: token_cache.stored_counts(spark, cache, t.version).count()
    raw = lambda: spark.read.parquet(cache).count()
    first = [(i, t, "en", "a") for i, t in enumerate(["One two", "one  two", "one two ", "three"] * 5)]
    token_cache.count_tokens(make_docs(first), words, cache)
    assert (held(words), held(octets), raw()) == (2, 0, 2)
    token_cache.count_tokens(make_docs(first + [(99, "four", "en", "a")]), words, cache)
    assert (held(words), raw()) == (3, 3)
    token_cache.count_tokens(make_docs(first), octets, cache)
    assert (held(words), held(octets), raw()) == (3, 4, 7)


def test_stored_counts_are_used(spark, make_docs, tmp_path):
    cache = str(tmp_path / "cache")
    words = token_cache.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    docs = make_docs([(1, "one two", "en", "a")])
    token_cache.count_tokens(docs, words, cache)
    wrong = spark.read.schema(token_cache.CACHE).parquet(cache).selectExpr("_digest", "1000L AS n_tokens", "tokenizer")
    other = str(tmp_path / "other")
    wrong.write.partitionBy("tokenizer").parquet(other)
    assert token_cache.count_tokens(docs, words, other).first().n_tokens == 1000


def test_an_append_twice_changes_nothing(spark, make_docs, tmp_path):
    cache = str(tmp_path / "cache")
    words = token_cache.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    docs = make_docs([(i, prose(i, 20), "en", "a") for i in range(5)])
    want = token_cache.count_tokens(docs, words, cache).collect()
    rows = spark.read.schema(token_cache.CACHE).parquet(cache).collect()
    token_cache._append(spark.createDataFrame(rows, token_cache.CACHE), cache)
    got = token_cache.count_tokens(docs, words, cache).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_stretches():
    data = b"ab cd\tef " * 1000 + b"x" * 500
    parts = list(token_cache.stretches(data, 100))
    assert [w for p in parts for w in p.split()] == data.split()
    assert max(map(len, parts)) <= 700 and len(parts) > 50


def test_empty(make_docs, tmp_path):
    words = token_cache.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert token_cache.count_tokens(make_docs([]), words, str(tmp_path / "c")).count() == 0
