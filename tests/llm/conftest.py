import pytest

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog. " * 12, "en", "a", 0, "x"),
    (1, "The quick brown fox jumps over the lazy dog. " * 12, "en", "a", 0, "x"),
    (2, None, "en", None, None, None),
    (3, "", None, "b", 0, "x"),
    (4, " \t\n\r\x0b\x0c ", "de", "b", 0, "x"),
    (5, "one", "de", "b", 3, "x"),
    (6, "one two\nthree  four<|endoftext|> five\u00a0six\x1cseven", "fr", "\U0001f600", 3, "x"),
    (7, " ".join(f"w{i}x{i * i}" for i in range(30_000)), "en", "a", 0, "x"),
    (None, "a row without an id, of some words that no other row has at all", "en", "a", 0, "x"),
    (8, "same line of eight tokens in both of them\nown line here of some tokens number eight", "en", "c", 0, "x"),
    (9, "same line of eight tokens in both of them\nanother line that stands in this one only, nine", "en", "c", 0, "x"),
    (9, "same line of eight tokens in both of them\nanother line that stands in this one only, nine", "en", "c", 0, "x"),
    (10, "order 17 of 2024-01-05 went to a@b.c at http://x.y today as it should", "en", "d", 0, "x"),
    (11, "order 99 of 2023-11-30 went to q@r.s at http://z.w today as it should", "en", "d", 0, "x"),
]
#: Extra columns bear names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"
CLASHES = ("hash", "bucket", "size", "kept", "doc", "perm", "fp", "component_id", "ids", "rule", "verdict", "host", "path", "n_words", "draws", "_keep", "_row", "line", "f")


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in CLASHES}).cache()
