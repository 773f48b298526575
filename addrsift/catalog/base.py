"""Registry of queries and their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its check SQL."""

    def register(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = fn
        if check is not None:
            CHECKS[key] = check
        return fn

    return register
