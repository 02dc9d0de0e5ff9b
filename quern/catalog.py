"""Every registered query with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.suite import chat, layout, metrics, mixing, tokens

SUITES = [tokens.suite, chat.suite, mixing.suite, metrics.suite, layout.suite]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for s in SUITES for name, f in s.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for s in SUITES for name, sql in s.oracle.items()}
