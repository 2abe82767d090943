"""Where queries are registered, each beside its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.plans.telemetry import oracle, telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DAY = 86_400


def register(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """`build` takes the telemetry view; `sql` reads it as t."""
    QUERIES[name] = lambda spark, sf_dir: build(telemetry(spark, sf_dir))
    if sql:
        ORACLE[name] = oracle(sql)


def predicate(name: str, test: Callable[[], Column], sql: str) -> None:
    """Ids at which a predicate holds, and how many rows have a value of its negation: flags are two-valued."""
    register(
        name, lambda t: t.select("event_id", test().alias("hit"), (~test()).alias("miss")),
        f"SELECT event_id, coalesce({sql}, false) AS hit, NOT coalesce({sql}, false) AS miss FROM t",
    )


def pick(names: list, key: str) -> Column:
    """The names in turn, by a number."""
    return F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))


def now() -> Column:
    return F.lit("2024-01-31 00:00:00").cast("timestamp")
