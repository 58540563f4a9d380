"""Native column expressions for words, shared by the training-data operators.

A word is a run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return; everything else, control characters and
no-break spaces included, belongs to words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that end a word.
GAPS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words, without an array of them: each word and the gap behind it become one character."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(trimmed, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "a")).cast("long")


def read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
