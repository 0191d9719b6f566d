import pytest

TEXTS = [
    "The quick brown fox. Jumps over\nthe lazy dog, 12 times!", None, "", " ", "a", "Ünïcödé  straße\t\ttabs\n\n\nlines   end ", "<|endoftext|> in a <|startoftext|>text <|endoftext|>",
    "İstanbul ΑΣ ΑΣ. क़. éé \x1c\x85 日本語 😀", "it's we're I'll 's", "x" * 3000, "ab" * 2500 + " word", "word " * 6000, "The quick brown fox. Jumps over\nthe lazy dog, 12 times!",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, shard string, digest string, start string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and extra columns of clashing names."""
    rows = [(i, t, "en", None, None, "x", "y", None, "z") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "no id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
