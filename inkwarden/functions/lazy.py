"""Pandas and Arrow functions that meet Spark only when they are first used."""

from __future__ import annotations

from functools import lru_cache, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def pandas_function(schema: str):
    """Like ``pandas_udf``, but importable without a session."""
    return _lazy(F.pandas_udf, schema)


def arrow_function(schema: str):
    """Like ``arrow_udf``, but importable without a session: values become Python's one by one, not a batch at once."""
    return _lazy(F.arrow_udf, schema)


def _lazy(kind, schema: str):
    def wrap(f):
        made = lru_cache(maxsize=1)(lambda: kind(f, schema))

        @wraps(f)
        def call(*columns) -> Column:
            return made()(*columns)

        return call

    return wrap
