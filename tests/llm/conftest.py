import random

import pytest

#: Extra columns whose names the operators use inside.
EXTRA = "shard string, _row string, _key string, size string, fp string, block string, slot string"


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdeghilnorst") for _ in range(draw.randint(1, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def make_docs(spark):
    """``make_docs(rows)`` of (doc_id, text, lang, source), with clashing extra columns."""

    def make(rows):
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
        full = [(*r, len(r[1]) if r[1] is not None else None, *["x"] * 7) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def messy():
    """Nulls in every column, empty and long texts, exact and near copies, repeated rows."""
    base = prose(1, 400)
    near = base.replace(" a", " b", 1)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, None, "b"),
        (4, None, "fr", None),
        (5, "", None, None),
        (6, "  \n\t ", "fr", "a"),
        (7, prose(7, 30_000), "en", "a"),
        (8, "Été à la plage. " * 40, "fr", "b"),
        (9, "#$% " * 80, "fr", "b"),
        (10, "licensed under the MIT License", "en", ""),
        (None, prose(11, 60), "en", "a"),
        (12, prose(12, 80), "en", "c"),
        (12, prose(12, 80), "en", "c"),
        (13, prose(13, 3), "en", "c"),
        (14, "12 345 !!", "en", "c"),
    ]
    return rows
