"""Queries by name, each beside the SQL it must match. Modules of queries add theirs with ``query``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


from tidemark.plans import editing, exchange, relational, timeline, wording  # noqa: E402, F401  they register their queries
