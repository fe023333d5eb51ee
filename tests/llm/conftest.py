import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("fp", T.StringType()), ("score", T.StringType()), ("length", T.LongType()))])


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long = "naïve words and 4111 1111 1111 1111 stupid " * 4000
    texts = [None, "", "   \n\t", "a", "Ω", "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog", "The Quick brown fox jumps over the lazy dog!", long, long, "x" * 50_000, "日本語のテキスト😀 と 한국어", "mail me at a.b@c.example.org or +1 (555) 555-1234, 10.0.0.1"]
    rows = [(i, t, "en", "s", len(t or ""), "clash", "clash", 1) for i, t in enumerate(texts)]
    rows += [(5, texts[5], None, None, None, None, None, None), (None, "no id", "en", None, 5, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
