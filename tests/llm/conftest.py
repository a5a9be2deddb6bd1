"""Awkward documents that every operator has to survive."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, class string, rate double, key string"


def rows_of(texts, langs=None, sources=None):
    return [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, f"s{(i or 0) % 3}"), len(t or ""), 0.5, 1, "c", 1.0, "k") for i, t in texts]


@pytest.fixture
def docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows and ids, a very long text, non-ASCII, clashing column names."""
    long = " ".join(f"word{i % 997} runs" for i in range(20_000))
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, "the cat sat on the mat and looked at the moon"), (5, "the cat sat on the mat and looked at the moon"), (6, "the cat sat on the mat and looked at the moon"), (6, "the cat sat on the mat and looked at the moon"), (7, long), (8, "ÀÉ straße 東京 ½ ٣"), (9, "x"), (None, "a row without an id"), (10, "mail a.b@c.example.org or +1 (202) 555-0143 token = 'abcdefgh12345678'")]
    return spark.createDataFrame(rows_of(texts, sources={4: None}), DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def make(spark):
    return lambda texts, **k: spark.createDataFrame(rows_of(texts, **k), DOCS)
